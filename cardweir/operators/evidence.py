"""Facts behind a denial, the factors they entail, and the screen a written explanation must pass.

Word and digit classes are Unicode, written as \\p{..} classes; no lookaround is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweir.functions.scalars import sha256_hex
from cardweir.functions.text import duration_parts, normalise_number
from cardweir.operators.ledger import CONTEXT_KINDS, eligible_for_explanation, entity_context

# Factor codes in their order, with the wording shown for each.
FACTOR_LABELS = {
    "probability_at_or_above_threshold": "risk at or above the locked threshold",
    "device_reuse": "device reused across decisions",
    "network_reuse": "network reused across decisions",
    "instrument_reuse": "instrument reused across decisions",
    "merchant_volume": "elevated merchant volume in window",
    "prior_denials_on_device": "prior denials on this device",
    "prior_denials_on_network": "prior denials on this network",
    "prior_denials_on_instrument": "prior denials on this instrument",
    "rapid_succession": "decisions in rapid succession",
}
MERCHANT_VOLUME = 5
RAPID_DECISIONS = 3
RAPID_SECONDS = 300
MAXIMUM_SUMMARY = 400
MINIMUM_SUMMARY = 20
MAXIMUM_CAVEAT = 300
MAXIMUM_BYTES = 4_096
MAXIMUM_FACTORS = 4

# What free text may not contain.
TOKEN_SHAPE = "(evt|mrc|chk|cus|dev|net|ses|pmt)_[0-9a-f]{32}"
FORBIDDEN_SUBSTRINGS = ("email", "cardholder", "card_number", "ip_address", "cvv", "@", "acquirer", "token_id")
MARKUP_SHAPES = (r"<\s*[a-zA-Z/!]", r"(?i)javascript\s*:", r"(?i)data\s*:\s*[a-z]+/", r"&#[0-9]")
PII_SHAPES = (
    r"(^|[^\p{Nd}.,])[0-9]{13,19}([^\p{Nd}.,]|$)",
    r"(^|[^\p{Nd}.,])\+?\p{Nd}[\p{Nd}\s\p{Z}-]{8,}\p{Nd}([^\p{Nd}.,]|$)",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+",
)
NUMERAL = r"\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
WORD = r"[\p{L}\p{N}_]+"
CONTRADICTIONS = ("approved", "allowed")
NUMBER_WORDS = {
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "hundred": 100, "thousand": 1000,
}


def facts(ledger: DataFrame) -> DataFrame:
    """Eligible decisions with the prior activity of their four entities, no tokens.

    A decision is judged against all others that share a token with it; contexts are computed for eligible
    decisions alone. At most four rows per decision are folded into columns.
    """
    scored = eligible_for_explanation(ledger).filter("calibrated_probability is not null")
    eligible = scored.select(
        "id", "calibrated_probability", "decision_threshold", "risk_decision",
        F.coalesce("action", F.lit("review")).alias("action"), "fail_safe_reason",
        "amount_subunits", "currency", "channel",
    )
    context = entity_context(ledger, exclude_self=True, targets=scored)
    columns = []
    for k, _ in CONTEXT_KINDS:
        columns.append(f"max(if(kind = '{k}', token is not null, null)) as {k}_present")
        for c in ("decision_count", "denied_count", "review_count", "span_seconds"):
            columns.append(f"max(if(kind = '{k}', {c}, null)) as {k}_{c}")
    return eligible.join(context.groupBy("id").agg(*[F.expr(c) for c in columns]), "id")


def _support() -> dict[str, str]:
    kinds = [k for k, _ in CONTEXT_KINDS]
    rapid = " or ".join(
        f"({k}_present and {k}_span_seconds is not null and {k}_decision_count >= {RAPID_DECISIONS}"
        f" and {k}_span_seconds <= {RAPID_SECONDS})"
        for k in kinds
    )
    out = {"probability_at_or_above_threshold": "calibrated_probability >= decision_threshold"}
    for k in ("device", "network", "instrument"):
        out[f"{k}_reuse"] = f"{k}_present and {k}_decision_count > 1"
    out["merchant_volume"] = f"merchant_present and merchant_decision_count >= {MERCHANT_VOLUME}"
    for k in ("device", "network", "instrument"):
        out[f"prior_denials_on_{k}"] = f"{k}_present and {k}_denied_count > 0"
    out["rapid_succession"] = rapid
    return out


def factor_codes() -> Column:
    """Codes the facts entail, in order."""
    return F.expr(
        "array_compact(array(" + ", ".join(f"if({e}, '{c}', null)" for c, e in _support().items()) + "))"
    )


def unsupported_factors(selected: str, entailed: str) -> Column:
    return F.array_except(selected, entailed)


def has_duplicates(codes: str) -> Column:
    return F.size(F.array_distinct(codes)) < F.size(codes)


def render_factors(codes: str) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in FACTOR_LABELS.items() for x in pair])
    return F.transform(codes, lambda c: F.element_at(labels, c))


def facts_json() -> Column:
    """Canonical JSON of the facts: keys in name order, compact, nulls kept."""
    contexts = ", ".join(
        f"named_struct('decision_count', {k}_decision_count, 'denied_count', {k}_denied_count, 'kind', '{k}',"
        f" 'present', {k}_present, 'review_count', {k}_review_count, 'span_seconds', {k}_span_seconds)"
        for k, _ in CONTEXT_KINDS
    )
    return F.to_json(
        F.struct(
            "action", "amount_subunits", factor_codes().alias("available_factor_codes"),
            F.col("calibrated_probability").cast("string").alias("calibrated_probability"),
            "channel", "currency", F.col("decision_threshold").cast("string").alias("decision_threshold"),
            "fail_safe_reason", F.expr(f"array({contexts})").alias("ledger_co_occurrence"),
            (F.col("calibrated_probability") >= F.col("decision_threshold")).alias("probability_exceeds_threshold"),
            "risk_decision",
        ),
        {"ignoreNullFields": "false"},
    )


def input_digest() -> Column:
    return sha256_hex(facts_json())


def permitted_numbers() -> Column:
    """Every numeral a text may use: exact renderings only, nothing rounded or cut off."""
    amount = F.col("amount_subunits")
    plain = [
        amount.cast("string"),
        F.expr("concat(string(amount_subunits div 100), '.', lpad(string(amount_subunits % 100), 2, '0'))"),
    ]
    for c in ("calibrated_probability", "decision_threshold"):
        plain.append(F.col(c).cast("string"))
        plain.append((F.col(c) * F.lit(100)).cast("decimal(38,18)").cast("string"))
    counts, spans = [], []
    for k, _ in CONTEXT_KINDS:
        counts += [F.col(f"{k}_{c}").cast("string") for c in ("decision_count", "denied_count", "review_count")]
        span = f"{k}_span_seconds"
        spans.append(
            F.when(F.col(span).isNotNull(), duration_parts(span)).otherwise(F.array().cast("array<string>"))
        )
    every = F.concat(F.array_compact(F.array(*plain, *counts)), *spans)
    return F.array_distinct(F.transform(every, normalise_number))


def unsupported_numbers(text: str | Column, allowed: str | Column) -> Column:
    """Numerals and number words of a text that are not among the permitted ones."""
    value = F.col(text) if isinstance(text, str) else text
    numerals = F.transform(F.regexp_extract_all(value, F.lit(NUMERAL), F.lit(0)), normalise_number)
    words = F.array_intersect(
        F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(0)), F.array(*[F.lit(w) for w in NUMBER_WORDS])
    )
    numbers = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, str(n))])
    spoken = F.transform(words, lambda w: F.element_at(numbers, w))
    return F.array_except(F.concat(numerals, spoken), allowed)


def forbidden_content(text: str | Column) -> Column:
    value = F.col(text) if isinstance(text, str) else text
    lowered = F.lower(value)
    found = value.rlike(TOKEN_SHAPE)
    for fragment in FORBIDDEN_SUBSTRINGS:
        found = found | F.contains(lowered, F.lit(fragment))
    for shape in (*MARKUP_SHAPES, *PII_SHAPES):
        found = found | value.rlike(shape)
    return found


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def currency_mismatch(text: str, currency: str | Column) -> Column:
    """A three-capital word that is not the decision's currency."""
    own = F.col(currency) if isinstance(currency, str) else currency
    return F.exists(_words(F.col(text)), lambda w: w.rlike("^[A-Z]{3}$") & (w != own))


def contradiction(text: str, action: str | Column) -> Column:
    decided = F.col(action) if isinstance(action, str) else action
    said = F.arrays_overlap(_words(F.lower(F.col(text))), F.array(*[F.lit(w) for w in CONTRADICTIONS]))
    return (decided == "deny") & said


def malformed(summary: str, caveat: str, factors: str) -> Column:
    """Bounds of a draft; a missing summary or factor list breaks them, a missing caveat is empty."""
    s, c = F.col(summary), F.coalesce(F.col(caveat), F.lit(""))
    known = F.array(*[F.lit(code) for code in FACTOR_LABELS])
    broken = (
        ~F.length(s).between(MINIMUM_SUMMARY, MAXIMUM_SUMMARY)
        | (F.length(c) > MAXIMUM_CAVEAT)
        | (F.octet_length(s) + F.octet_length(c) > MAXIMUM_BYTES)
        | ~F.size(factors).between(1, MAXIMUM_FACTORS)
        | F.exists(factors, lambda f: f.isNull() | ~F.array_contains(known, f))
    )
    return F.coalesce(broken, F.lit(True))


def screen_explanations(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, reason): the first check a draft fails, null when it passes all.

    ``drafts`` has id, summary, caveat and factors; ``known`` is ``facts``. A draft for a decision without facts, unknown or not to be
    explained, is refused as malformed.
    """
    joined = drafts.join(known.withColumn("known", F.lit(True)), "id", "left").withColumns({"entailed": factor_codes(), "permitted": permitted_numbers()})

    def either(check) -> Column:
        return check("summary") | F.coalesce(check("caveat"), F.lit(False))

    reason = (
        F.when(F.col("known").isNull() | malformed("summary", "caveat", "factors"), "malformed_response")
        .when(
            has_duplicates("factors") | (F.size(unsupported_factors("factors", "entailed")) > 0),
            "unsupported_factor",
        )
        .when(either(forbidden_content), "forbidden_content")
        .when(either(lambda t: currency_mismatch(t, "currency")), "unsupported_number")
        .when(either(lambda t: contradiction(t, "action")), "contradicts_decision")
        .when(either(lambda t: F.size(unsupported_numbers(t, "permitted")) > 0), "unsupported_number")
    )
    return joined.select("id", reason.alias("reason"))
