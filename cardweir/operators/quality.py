"""Dataset validators; each returns the rows that break its rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweir.functions.scalars import TOKEN_PREFIXES
from cardweir.functions.text import normalise_key
from cardweir.operators.ordering import previous_values

# Keys that may not occur in model-visible data, and evaluation-only columns.
PROHIBITED_KEYS = (
    "address", "billing_address", "card_number", "contact", "cvc", "cvv", "email", "expiry",
    "ip_address", "pan", "phone", "raw_payload", "upi_id", "vpa",
)
GROUND_TRUTH_COLUMNS = ("campaign_id", "generator_metadata", "is_attack", "scenario_type", "split")
IDENTITY_FIELDS = (
    "checkout_id", "customer_token", "device_token", "network_token",
    "payment_instrument_token", "session_token",
)


@dataclass(frozen=True)
class RetryBounds:
    minimum_gap_ms: int = 1_000
    maximum_gap_ms: int = 600_000
    minimum_length: int = 2
    maximum_length: int = 4


@dataclass(frozen=True)
class Placement:
    boundary_bp: int = 6_000
    minimum_before: int = 1
    minimum_after: int = 1
    minimum_gap_ms: int = 60_000


def assign_split(time_ms: str, bounds: list[tuple[str, int, int | None]]) -> Column:
    """Half-open chronological splits; null outside all of them."""
    t = F.col(time_ms)
    out = F.lit(None).cast("string")
    for name, start, end in reversed(bounds):
        inside = (t >= start) if end is None else (t >= start) & (t < end)
        out = F.when(inside, name).otherwise(out)
    return out


def calibration_side(time_ms: str, boundary: Column) -> Column:
    return F.when(F.col(time_ms) < boundary, "calibration_fit").otherwise("policy_selection")


def duplicate_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def outside_split(df: DataFrame, bounds: list[tuple[str, int, int | None]]) -> DataFrame:
    expected = assign_split("occurred_at_ms", bounds)
    return df.filter(~expected.eqNullSafe(F.col("split"))).select("event_id", "split", expected.alias("expected_split"))


def outcome_pair(df: DataFrame) -> DataFrame:
    return df.filter("(outcome = 'failed') <> (failure_category is not null)").select("event_id")


def scenario_quota(df: DataFrame, expected: DataFrame) -> DataFrame:
    """(split, scenario_type, actual, expected) where the counts differ, missing rows included."""
    actual = df.groupBy("split", "scenario_type").agg(F.count(F.lit(1)).alias("actual"))
    return actual.join(expected, ["split", "scenario_type"], "full_outer").filter(
        "coalesce(actual, 0) <> coalesce(expected, 0)"
    )


def retry_gaps(df: DataFrame) -> DataFrame:
    """Gap of each retry to the one before it in its chain, from one global (chain, time, id) order.

    No chain is gathered in one task, however many rows share an instance id.
    """
    rows = df.filter("scenario_type = 'legitimate_retry' and scenario_instance_id is not null").select(
        "scenario_instance_id", "occurred_at_ms", "event_id"
    )
    order = [F.col("scenario_instance_id"), F.col("occurred_at_ms"), F.col("event_id")]
    seen = previous_values(rows, order, ["scenario_instance_id", "occurred_at_ms"])
    return seen.select(
        *rows.columns,
        F.expr(
            "if(scenario_instance_id = prev_scenario_instance_id, occurred_at_ms - prev_occurred_at_ms, null)"
        ).alias("gap_ms"),
    )


def retry_chain_violations(df: DataFrame, bounds: RetryBounds = RetryBounds()) -> DataFrame:
    """(chain, rule): size, first attempt not failed, gaps, changed identity, checkout shared by chains."""
    retries = df.filter("scenario_type = 'legitimate_retry'")
    missing = retries.filter("scenario_instance_id is null").select(
        F.col("event_id").alias("chain"), F.lit("retry_missing_instance").alias("rule")
    )
    present = retries.filter("scenario_instance_id is not null")
    distinct = [
        F.expr(f"min(coalesce({c}, '')) <> max(coalesce({c}, ''))").alias(f"changed_{c}") for c in IDENTITY_FIELDS
    ]
    chains = present.groupBy(F.col("scenario_instance_id").alias("chain")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("outcome", "checkout_id"), F.struct("occurred_at_ms", "event_id")).alias("first"),
        *distinct,
    )
    gaps = (
        retry_gaps(present)
        .filter(f"gap_ms is not null and not gap_ms between {bounds.minimum_gap_ms} and {bounds.maximum_gap_ms}")
        .select(F.col("scenario_instance_id").alias("chain"), F.lit("gap_out_of_bounds").alias("rule"))
        .distinct()
    )
    changed = " or ".join(f"changed_{c}" for c in IDENTITY_FIELDS)
    rules = chains.select(
        "chain",
        F.explode(F.array_compact(F.array(
            F.expr(f"if(n not between {bounds.minimum_length} and {bounds.maximum_length}, 'chain_size_invalid', null)"),
            F.expr("if(first.outcome <> 'failed', 'must_start_failed', null)"),
            F.expr(f"if({changed}, 'identity_changed', null)"),
        ))).alias("rule"),
    )
    shared = (
        chains.groupBy(F.col("first.checkout_id").alias("checkout_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("checkout_id").alias("chain"), F.lit("checkout_reused_across_chains").alias("rule"))
    )
    return rules.unionByName(gaps).unionByName(shared).unionByName(missing)


def campaign_integrity(df: DataFrame, profiles: dict[str, str], quotas: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(split, campaign_id, rule) for attacks without a campaign and campaigns that do not hold together.

    Spans and identities are read off a minimum and a maximum, which combine map-side. ``quotas`` has the
    configured campaigns and attacks of each split; a split that misses them is named without a campaign.
    """
    attacks = df.filter("is_attack")
    expected = F.create_map(*[F.lit(x) for pair in profiles.items() for x in pair])
    grouped = attacks.groupBy("split", "campaign_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("min(merchant_id) <> max(merchant_id)").alias("spans"),
        F.expr("count_if(scenario_instance_id is null) > 0 or min(scenario_instance_id) <> max(scenario_instance_id)").alias("mixed"),
        F.max(~F.col("campaign_profile").eqNullSafe(expected[F.col("split")])).alias("profile"),
    )
    found = grouped.select(
        "split", "campaign_id",
        F.explode(F.array_compact(F.array(
            F.expr("if(campaign_id is null, 'campaign_id_missing', null)"),
            F.expr("if(profile, 'campaign_profile_mismatch', null)"),
            F.expr("if(n >= 2 and not spans, 'merchant_span_invalid', null)"),
            F.expr("if(mixed, 'scenario_identity_mismatch', null)"),
        ))).alias("rule"),
    )
    if quotas is None:
        return found
    wanted = df.sparkSession.createDataFrame([(s, *q) for s, q in quotas.items()], "split string, campaigns long, attacks long")
    counts = grouped.groupBy("split").agg(F.count("campaign_id").alias("have"), F.sum("n").alias("rows"))
    # One row per split on either side.
    missed = wanted.join(F.broadcast(counts), "split", "left").select(
        "split", F.lit(None).cast("string").alias("campaign_id"),
        F.explode(F.array_compact(F.array(
            F.expr("if(coalesce(have, 0) <> campaigns, 'campaign_count_mismatch', null)"),
            F.expr("if(coalesce(rows, 0) <> attacks, 'campaign_event_quota_mismatch', null)"),
        ))).alias("rule"),
    )
    return found.unionByName(missed)


def campaign_envelopes(df: DataFrame) -> DataFrame:
    return df.filter("is_attack and campaign_id is not null").groupBy("split", "campaign_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("occurred_at_ms").alias("first_ms"), F.max("occurred_at_ms").alias("last_ms")
    )


def campaign_gaps(envelopes: DataFrame) -> DataFrame:
    """Gap of each campaign to the previous one of its split."""
    order = [F.col(c) for c in ("split", "first_ms", "last_ms", "campaign_id")]
    seen = previous_values(envelopes, order, ["split", "last_ms"])
    return seen.select(
        *envelopes.columns, F.expr("if(split = prev_split, first_ms - prev_last_ms, null)").alias("gap_ms")
    )


def campaign_placement(
    df: DataFrame, split: str, start_ms: int, end_ms: int, rule: Placement = Placement(), attacks: int | None = None
) -> DataFrame:
    """(campaign_id, rule) around a protected boundary; split-wide findings have no campaign id.

    ``attacks`` is the split's configured number, shared equally by its campaigns; without it the
    attacks that are there are.
    """
    boundary = start_ms + (end_ms - start_ms) * rule.boundary_bp // 10_000
    envelopes = campaign_envelopes(df.filter(F.col("split") == split))
    gaps = campaign_gaps(envelopes)
    total = envelopes.agg(F.expr(f"{'sum(n)' if attacks is None else f'{attacks}L'} div count(1)").alias("n")).scalar()
    per_campaign = gaps.withColumn("expected", total).select(
        "campaign_id",
        F.explode(F.array_compact(F.array(
            F.expr("if(n <> expected, 'quota_not_equal', null)"),
            F.expr(f"if(first_ms < {boundary} and last_ms >= {boundary}, 'crosses_protected_boundary', null)"),
            F.expr(f"if(gap_ms < {rule.minimum_gap_ms}, 'gap_invalid', null)"),
        ))).alias("rule"),
    )
    overall = gaps.agg(
        F.expr(f"count_if(last_ms < {boundary})").alias("before"),
        F.expr(f"count_if(first_ms >= {boundary})").alias("after"),
        F.expr("count(gap_ms) > 1 and min(gap_ms) = max(gap_ms)").alias("regular"),
    ).select(
        F.lit(None).cast("string").alias("campaign_id"),
        F.explode(F.array_compact(F.array(
            F.expr(f"if(before < {rule.minimum_before}, 'missing_before_boundary', null)"),
            F.expr(f"if(after < {rule.minimum_after}, 'missing_after_boundary', null)"),
            F.expr("if(regular, 'not_irregular', null)"),
        ))).alias("rule"),
    )
    return per_campaign.unionByName(overall)


def calibration_campaigns(df: DataFrame, boundary_ms: int, campaigns: int = 10, attacks: int = 34, per_side: int = 5) -> DataFrame:
    """One row: what of the calibration campaigns' contract holds."""
    per = df.filter("split = 'calibration' and is_attack").groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"count_if(occurred_at_ms < {boundary_ms})").alias("early"),
    )
    return per.agg(
        F.expr(f"count(1) = {campaigns}").alias("campaign_count_ok"),
        F.expr(f"coalesce(bool_and(n = {attacks}), false)").alias("attacks_per_campaign_ok"),
        F.expr(f"count_if(early = n) = {per_side} and count_if(early = 0) = {per_side}").alias("sides_ok"),
        F.expr("count_if(early > 0 and early < n)").alias("on_both_sides"),
    )


def entity_rotation_shift(df: DataFrame, multiplier: int = 2) -> DataFrame:
    """Per entity and baseline split: does the test split rotate entities enough (integer products)."""
    attacks = df.filter("is_attack")
    kinds = ("device", "session")
    unique = (
        attacks.select("split", F.expr("inline(array(" + ", ".join(f"struct('{k}' as kind, {k}_token as token)" for k in kinds) + "))"))
        .groupBy("split", "kind", "token").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("split", "kind")
        .agg(F.count("token").alias("unique_tokens"), F.sum("n").alias("attacks"))
    )
    test = unique.filter("split = 'test'").selectExpr("kind", "unique_tokens as test_unique", "attacks as test_attacks")
    # Two rows: one per kind. Without attacks in the test split a baseline is not shifted.
    return unique.filter("split <> 'test'").join(F.broadcast(test), "kind", "left").selectExpr(
        "kind", "split as baseline", "unique_tokens as baseline_unique", "attacks as baseline_attacks",
        "coalesce(test_unique, 0L) as test_unique", "coalesce(test_attacks, 0L) as test_attacks",
        f"unique_tokens > 0 and coalesce(test_unique, 0) > 0 and test_unique * attacks >= {multiplier} * unique_tokens * test_attacks as shifted",
    )


def network_coordination(df: DataFrame, maximum_unique_bp: int = 5_000, minimum_presence_bp: int = 9_000) -> DataFrame:
    """Per split: unique networks and presence among attacks against their bounds."""
    tokens = df.filter("is_attack").groupBy("split", "network_token").agg(F.count(F.lit(1)).alias("n"))
    return tokens.groupBy("split").agg(
        F.sum("n").alias("attacks"),
        F.count("network_token").alias("unique_networks"),
        F.expr("coalesce(sum(if(network_token is not null, n, 0)), 0L)").alias("present"),
    ).selectExpr(
        "*",
        f"unique_networks * 10000 > {maximum_unique_bp} * attacks as too_sparse",
        f"present * 10000 < {minimum_presence_bp} * attacks as presence_too_low",
    )


SEPARATION_FIELDS = {
    "amount_subunits": "string(amount_subunits)",
    "outcome": "outcome",
    "failure_category": "failure_category",
    "channel": "channel",
    "customer_missing": "string(customer_token is null)",
    "device_missing": "string(device_token is null)",
    "network_missing": "string(network_token is null)",
}


def attack_only_values(df: DataFrame) -> DataFrame:
    """(field, v) of values only attacks take: one aggregation finds those no legitimate row has."""
    structs = ", ".join(f"struct('{n}' as field, {e} as v)" for n, e in SEPARATION_FIELDS.items())
    return (
        df.select("is_attack", F.expr(f"inline(array({structs}))"))
        .groupBy("field", "v")
        .agg(F.bool_and("is_attack").alias("only"))
        .filter("only")
        .select("field", "v")
    )


def single_feature_separation(df: DataFrame) -> DataFrame:
    return attack_only_values(df).select("field").distinct()


def json_keys(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep..., key) for every object key at any depth of a JSON text.

    A quoted string is a key exactly when a colon follows it; strings are matched whole, so text
    inside a value never looks like one.
    """
    keys = F.regexp_extract_all(F.col(column), F.lit(r'"((?:[^"\\]|\\.)*)"\s*(:?)'), F.lit(0))
    return df.select(*keep, F.explode(keys).alias("m")).filter(F.col("m").endswith(":")).select(
        *keep, F.regexp_extract("m", r'^"((?:[^"\\]|\\.)*)"', 1).alias("key")
    )


def prohibited_keys(df: DataFrame, column: str, *keep: str) -> DataFrame:
    found = json_keys(df, column, *keep).withColumn("normalised", normalise_key("key"))
    return found.filter(F.col("normalised").isin(*PROHIBITED_KEYS)).select(*keep, "key", "normalised")


# Shapes a whole value must not have. Digits are ASCII here.
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
HANDLE_SHAPE = r"^[^@\s]+@[^@\s]+$"
IPV4_SHAPE = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
IPV6_SHAPE = (
    r"^(([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|([0-9A-Fa-f]{1,4}:){1,7}:|::([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}"
    r"|([0-9A-Fa-f]{1,4}:){1,6}(:[0-9A-Fa-f]{1,4}){1,6})$"
)
PAN_SHAPE = r"^[0-9]{13,19}$"
CVV_SHAPE = r"^[0-9]{3,4}$"


def sensitive_value(value: str | Column) -> Column:
    """Name of the shape a whole value has, or null."""
    v = F.col(value) if isinstance(value, str) else value
    return (
        F.when(v.rlike(EMAIL_SHAPE) | v.rlike(HANDLE_SHAPE), "contact_shaped")
        .when(v.rlike(IPV4_SHAPE) | v.rlike(IPV6_SHAPE), "network_address")
        .when(v.rlike(PAN_SHAPE), "pan_shaped")
        .when(v.rlike(CVV_SHAPE), "cvv_shaped")
    )


def ground_truth_leak(df: DataFrame, column: str) -> DataFrame:
    """(leaked, rows): evaluation-only keys that occur in model-visible JSON lines, at any depth."""
    found = json_keys(df, column).filter(F.col("key").isin(*GROUND_TRUTH_COLUMNS))
    return found.groupBy(F.col("key").alias("leaked")).agg(F.count(F.lit(1)).alias("rows"))


def one_class_partitions(df: DataFrame, partition: str) -> DataFrame:
    return df.groupBy(partition).agg(F.min("y").alias("low"), F.max("y").alias("high")).filter("low = high").select(partition)


LEDGER_RULES = {
    "action_unknown": "action is not null and action not in ('allow', 'review', 'deny')",
    "risk_decision_unknown": "risk_decision is not null and risk_decision not in ('allow', 'deny')",
    "status_unknown": "status not in ('pending', 'final')",
    "final_without_action": "status = 'final' and action is null",
    "amount_not_positive": "amount_subunits <= 0",
    "currency_shape": "not currency rlike '^[A-Z]{3}$'",
    "channel_unknown": "channel not in ('web', 'mobile_web', 'mobile_app')",
    "probability_range": "calibrated_probability < 0 or calibrated_probability > 1",
}
EXPLANATION_RULES = {
    "status_unknown": "status not in ('pending', 'ready', 'failed', 'rejected')",
    "ready_without_summary": "status = 'ready' and summary is null",
    "failed_without_reason": "status in ('failed', 'rejected') and failure_reason is null",
    "attempt_not_positive": "attempt_number < 1",
}


def constraint_violations(df: DataFrame, rules: dict[str, str], *keep: str) -> DataFrame:
    """(keep..., rule): all rules in one pass over the rows."""
    broken = ", ".join(f"if({e}, '{n}', null)" for n, e in rules.items())
    return df.select(*keep, F.explode(F.expr(f"array_compact(array({broken}))")).alias("rule"))


def event_schema_rules() -> dict[str, str]:
    """Per-row rules of an attempt: token shapes, ranges, enums and the outcome pair."""
    rules = {}
    for c, p in TOKEN_PREFIXES.items():
        if c in ("campaign_id", "scenario_instance_id"):
            continue
        shape = f"{c} rlike '^{p}_[0-9a-f]{{32}}$'"
        nullable = c in ("customer_token", "device_token", "network_token")
        rules[f"{c}_shape"] = f"{c} is not null and not {shape}" if nullable else f"{c} is null or not {shape}"
    rules["amount_range"] = "amount_subunits is null or not amount_subunits between 1 and 100000000"
    rules["currency_shape"] = "currency is null or not currency rlike '^[A-Z]{3}$'"
    rules["outcome_unknown"] = "outcome is null or outcome not in ('authorized', 'failed')"
    rules["category_unknown"] = (
        "failure_category not in ('authentication', 'insufficient_funds', 'instrument_declined',"
        " 'temporary_processing', 'unknown')"
    )
    rules["channel_unknown"] = "channel is null or channel not in ('web', 'mobile_web', 'mobile_app')"
    rules["outcome_pair"] = "(outcome = 'failed') <> (failure_category is not null)"
    return rules
