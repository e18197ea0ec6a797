"""Webhook landing rows to a screened audit table and payment observations.

The body is parsed once into a variant; every rule is a typed look at a path of it, so a number in
quotes is not taken for a number and an absent key is told apart from a null one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweir.functions.scalars import from_epoch_seconds, hmac_sha256, sha256_hex

# Names, patterns and bounds of the provider's payloads.
SUPPORTED_EVENTS = ("payment.authorized", "payment.captured", "payment.failed")
IDENTIFIER = "^[A-Za-z0-9_-]+$"
TOKEN = "^[A-Za-z0-9_.-]+$"
OPTIONAL_TOKEN = "^[A-Za-z0-9_.-]*$"
CURRENCY = "^[A-Z]{3}$"
MAXIMUM_EPOCH = 4_102_444_800
MAXIMUM_BODY_BYTES = 262_144
REDACTED = "[REDACTED]"
PAYMENT_REDACTIONS = (
    "acquirer_data", "card", "contact", "description", "email", "ip", "ip_address", "notes", "phone",
    "token_id", "vpa",
)
ORDER_REDACTIONS = ("notes",)


def processing_result(name: str) -> Column:
    return F.when(F.col(name).isin(*SUPPORTED_EVENTS), "processed").otherwise("ignored")


@dataclass(frozen=True)
class Rule:
    """What a value at a path must be. ``limit`` is a length for texts, a bound for counts."""

    name: str
    want: str  # identifier, token, loose_token, currency, count, loose_count, flag, object or =constant
    limit: int = 2**62
    optional: bool = False  # absent or null is fine


# What the provider's documents contain.
ENVELOPE_RULES = (
    Rule("entity", "=event"),
    Rule("event", "token", 100),
    Rule("created_at", "loose_count", MAXIMUM_EPOCH),
    Rule("payload", "object"),
    Rule("account_id", "identifier", 255, optional=True),
)
PAYMENT_RULES = (
    Rule("id", "identifier", 255),
    Rule("entity", "=payment"),
    Rule("order_id", "identifier", 255, optional=True),
    Rule("status", "token", 50),
    Rule("amount", "loose_count"),
    Rule("currency", "currency", 3),
    Rule("method", "token", 50, optional=True),
    Rule("created_at", "loose_count", MAXIMUM_EPOCH),
    *[Rule(c, "loose_token", 100, optional=True) for c in ("error_code", "error_source", "error_step", "error_reason")],
)
EVENT_ALLOWLIST = (
    Rule("entity", "=event"),
    Rule("event", "token", 100),
    Rule("created_at", "count", MAXIMUM_EPOCH),
    Rule("account_id", "identifier", 255),
)
PAYMENT_ALLOWLIST = (
    Rule("id", "identifier", 255),
    Rule("entity", "=payment"),
    Rule("amount", "count"),
    Rule("amount_refunded", "count"),
    Rule("currency", "currency", 3),
    Rule("status", "token", 50),
    Rule("order_id", "identifier", 255, optional=True),
    Rule("invoice_id", "identifier", 255, optional=True),
    Rule("international", "flag"),
    Rule("method", "token", 50, optional=True),
    Rule("captured", "flag"),
    Rule("created_at", "count", MAXIMUM_EPOCH),
    Rule("refund_status", "token", 50, optional=True),
    *[Rule(c, "token", 100, optional=True) for c in ("error_code", "error_source", "error_step", "error_reason")],
)
ORDER_ALLOWLIST = (
    Rule("id", "identifier", 255),
    Rule("entity", "=order"),
    *[Rule(c, "count") for c in ("amount", "amount_paid", "amount_due")],
    Rule("currency", "currency", 3),
    Rule("status", "token", 50),
    Rule("attempts", "count"),
    Rule("created_at", "count", MAXIMUM_EPOCH),
)

# A whole number as a number, or as text; the decision reads 1.0 and "1" as 1.
WHOLE = r"^[ ]*[+-]?[0-9]+([.]0+)?[ ]*$"

def _at(path: str) -> str:
    return f"try_variant_get(v, '{path}', 'variant')"


def _text(path: str) -> str:
    return f"try_variant_get(v, '{path}', 'string')"


def _number(path: str) -> str:
    return f"try_cast(try_cast(trim({_text(path)}) as decimal(20,0)) as bigint)"


def _fields(path: str, names: list[str]) -> str:
    """The named members of the object at ``path`` in one pass, null for what is absent; null if no object is there. Each look at
    a path searches the members of every object on its way, so rules on many members take them from here."""
    return f"try_variant_get(v, '{path}', 'struct<{', '.join(f'{n}: variant' for n in names)}>')"


def _valid(rule: Rule) -> str:
    """Whether the member of ``e`` that ``rule`` names is what it must be."""
    x = f"e.{rule.name}"
    s, kind = f"try_variant_get({x}, '$', 'string')", f"schema_of_variant({x})"
    if rule.want == "count":
        fits = f"{kind} = 'BIGINT' and coalesce(try_variant_get({x}, '$', 'bigint') between 0 and {rule.limit}L, false)"
    elif rule.want == "loose_count":
        fits = (
            f"coalesce({s} rlike '{WHOLE}' and try_cast({s} as decimal(20,0)) between 0 and {rule.limit}L, false)"
            f" and {kind} not like 'OBJECT%' and {kind} not like 'ARRAY%'"
        )
    elif rule.want == "flag":
        fits = f"{kind} = 'BOOLEAN'"
    elif rule.want == "object":
        fits = f"try_variant_get({x}, '$', 'struct<_: variant>') is not null"
    elif rule.want.startswith("="):
        fits = f"if({kind} <> 'STRING', false, {s} = '{rule.want[1:]}')"
    else:
        pattern = {"identifier": IDENTIFIER, "currency": CURRENCY}.get(rule.want, OPTIONAL_TOKEN)
        bad = f"length({s}) > {rule.limit}L" + ("" if rule.want == "loose_token" else f" or {s} = ''")
        fits = f"if({kind} <> 'STRING' or {bad}, false, {s} rlike '{pattern}')"
    return f"(case when {x} is null or is_variant_null({x}) then {str(rule.optional).lower()} else {fits} end)"


def _all_valid(rules: tuple[Rule, ...], path: str) -> str:
    fields = f"coalesce({_fields(path, [r.name for r in rules])}, named_struct({', '.join(f"'{r.name}', cast(null as variant)" for r in rules)}))"
    return f"forall(array({fields}), e -> {' and '.join(_valid(r) for r in rules)})"


def envelope_valid() -> str:
    contains = _at("$.contains")
    return (
        f"v is not null and {_all_valid(ENVELOPE_RULES, '$')} and ({contains} is null"
        f" or (coalesce(schema_of_variant({contains}) in ('ARRAY<STRING>', 'ARRAY<VOID>'), false)"
        " and size(try_variant_get(v, '$.contains', 'array<string>')) <= 20))"
    )


def payment_valid() -> str:
    return _all_valid(PAYMENT_RULES, "$.payload.payment.entity")


def parsed_once(df: DataFrame, text: str) -> DataFrame:
    """Add ``v``, the parsed ``text``. A filter is not pushed below the generator, so rules on ``v``
    read the parsed value instead of parsing once per mention."""
    return df.withColumn("v", F.explode(F.expr(f"array(try_parse_json({text}))")))


def signature_valid(key: bytes) -> Column:
    """HMAC over the exact bytes, before anything is parsed; hex digits in either case."""
    return F.coalesce(
        F.col("signature").rlike("^[0-9a-fA-F]{64}$")
        & (F.lower("signature") == hmac_sha256("body", key)),
        F.lit(False),
    )


def screen(calls: DataFrame, key: bytes, maximum_bytes: int = MAXIMUM_BODY_BYTES) -> DataFrame:
    """Landing rows with ``v`` (parsed body) and ``reject_reason`` (null when accepted)."""
    media = F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1))))
    # Only bodies of the right type and size are hashed, and only those that pass are parsed.
    bounded = (F.coalesce(media, F.lit("")) == "application/json") & (F.octet_length("body") <= maximum_bytes)
    checked = calls.withColumn("signature_ok", F.explode(F.array(F.when(F.coalesce(bounded, F.lit(False)), signature_valid(key)).otherwise(False))))
    parsed = parsed_once(checked, "if(signature_ok, body, null)")
    event_id = F.col("provider_event_id")
    reason = (
        F.when(F.coalesce(media, F.lit("")) != "application/json", "unsupported_content_type")
        .when(F.octet_length("body") > maximum_bytes, "request_too_large")
        .when(F.col("signature").isNull(), "missing_signature")
        .when(~F.col("signature_ok"), "invalid_signature")
        .when(event_id.isNull() | ~F.length(event_id).between(1, 255), "invalid_event_id")
        .when(~F.expr(envelope_valid()), "invalid_webhook_envelope")
        .when(
            F.expr(_text("$.event")).isin(*SUPPORTED_EVENTS) & ~F.expr(payment_valid()),
            "invalid_payment_payload",
        )
    )
    return parsed.withColumn("reject_reason", reason)


def _members(rules: tuple[Rule, ...], redactions: tuple[str, ...], path: str) -> str:
    """JSON members of the allowlisted keys that are present, and marks for the sensitive ones, as one text; null if no object is there."""
    members = [
        f"""if(e.{r.name} is null, null, concat('"{r.name}":', if({_valid(r)}, to_json(e.{r.name}), '"{REDACTED}"')))""" for r in rules
    ]
    members += [f"""if(e.{r} is null, null, '"{r}":"{REDACTED}"')""" for r in redactions]
    fields = _fields(path, [*[r.name for r in rules], *redactions])
    return f"transform(array({fields}), e -> if(e is null, null, concat_ws(',', {', '.join(members)})))[0]"


def sanitised_payload() -> Column:
    """Allowlisted copy of ``v`` as JSON text: unknown keys dropped, bad or sensitive values marked.

    The envelope always carries an account id and a list of contents, so an absent account id is
    marked and an absent list is empty.
    """
    contains = _at("$.contains")
    listed = "try_variant_get(v, '$.contains', 'array<string>')"
    account = f"""if({_at('$.account_id')} is null, array('"account_id":"{REDACTED}"'), array())"""
    contents = (
        f"case when {contains} is null then array('\"contains\":[]')"
        f" when schema_of_variant({contains}) in ('ARRAY<STRING>', 'ARRAY<VOID>') and size({listed}) <= 20"
        f" and forall({listed}, x -> length(x) between 1 and 50 and x rlike '{TOKEN}')"
        f" then array(concat('\"contains\":', to_json({contains}))) else array() end"
    )
    entities = []
    for kind, rules, redactions in (
        ("payment", PAYMENT_ALLOWLIST, PAYMENT_REDACTIONS), ("order", ORDER_ALLOWLIST, ORDER_REDACTIONS),
    ):
        inner = _members(rules, redactions, f"$.payload.{kind}.entity")
        entities.append(f"""concat('"{kind}":{{"entity":{{', {inner}, '}}}}')""")
    payload = (
        f"transform(array(concat_ws(',', {', '.join(entities)})),"
        " w -> if(w = '', array(), array(concat('\"payload\":{', w, '}'))))[0]"
    )
    # an envelope without any of its keys adds no member
    event = f"filter(array({_members(EVENT_ALLOWLIST, (), '$')}), w -> w <> '')"
    return F.expr(
        f"concat('{{', concat_ws(',', concat({event}, {account}, {contents}, {payload})), '}}')"
    )


def first_calls(screened: DataFrame) -> DataFrame:
    """Accepted calls, the first of each provider event id.

    The earliest call of an id is a minimum, which combines map-side: an id delivered a billion
    times costs no more than one.
    """
    first = F.min_by(F.struct("call_no", "body", "received_at_ms"), F.struct("received_at_ms", "call_no"))
    return (
        screened.filter("reject_reason is null")
        .groupBy("provider_event_id")
        .agg(first.alias("call"))
        .select("provider_event_id", "call.*")
    )


def first_deliveries(screened: DataFrame) -> DataFrame:
    """The first calls, parsed again from the kept body."""
    return parsed_once(first_calls(screened), "body")


def audit_rows(deliveries: DataFrame) -> DataFrame:
    """The webhook audit table."""
    return deliveries.select(
        "provider_event_id",
        F.expr(_text("$.event")).alias("event_name"),
        from_epoch_seconds(F.expr(_number("$.created_at"))).alias("provider_created_at"),
        sha256_hex("body").alias("raw_body_sha256"),
        sanitised_payload().alias("sanitized_payload"),
        F.expr(_text("$.event")).alias("_name"),
    ).withColumn("processing_result", processing_result("_name")).drop("_name")


def observations(deliveries: DataFrame) -> DataFrame:
    """One payment fact per processed webhook; later or earlier than others does not matter."""
    p = "$.payload.payment.entity"
    return deliveries.filter(F.expr(_text("$.event")).isin(*SUPPORTED_EVENTS)).select(
        F.col("provider_event_id").alias("webhook_event_id"),
        F.expr(_text(f"{p}.id")).alias("provider_payment_id"),
        F.expr(_text(f"{p}.order_id")).alias("provider_order_id"),
        F.expr(_text("$.event")).alias("event_name"),
        F.expr(_text(f"{p}.status")).alias("payment_status"),
        F.expr(_number(f"{p}.amount")).alias("amount"),
        F.expr(_text(f"{p}.currency")).alias("currency"),
        F.expr(_text(f"{p}.method")).alias("payment_method"),
        *[F.expr(_text(f"{p}.{c}")).alias(c) for c in ("error_code", "error_source", "error_step", "error_reason")],
        from_epoch_seconds(F.expr(_number("$.created_at"))).alias("provider_event_created_at"),
        from_epoch_seconds(F.expr(_number(f"{p}.created_at"))).alias("provider_payment_created_at"),
    )


def observation_of(audit: DataFrame, facts: DataFrame) -> DataFrame:
    """Each audit row with its observation."""
    return audit.join(facts, audit.provider_event_id == facts.webhook_event_id)
