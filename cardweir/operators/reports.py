"""Dataset report: each section one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweir.functions.scalars import fixed_decimal_ratio
from cardweir.operators.ordering import integer_distribution, nearest_ranks

TOKEN_FIELDS = (
    "checkout_id", "customer_token", "device_token", "network_token",
    "payment_instrument_token", "session_token",
)


def amounts(df: DataFrame) -> DataFrame:
    histogram = df.groupBy("amount_subunits").agg(F.count(F.lit(1)).alias("w"))
    ranks = nearest_ranks(histogram, "amount_subunits", "w", {"p50": 50, "p95": 95, "p99": 99})
    total = df.agg(F.sum("amount_subunits").alias("s")).scalar()
    return ranks.withColumn("sum", total)


def prevalence(df: DataFrame) -> DataFrame:
    """Attack share per split and overall."""
    return (
        df.rollup("split")
        .agg(F.count(F.lit(1)).alias("denominator"), F.count_if("is_attack").alias("numerator"))
        .select(
            F.coalesce("split", F.lit("all")).alias("split"), "denominator", "numerator",
            fixed_decimal_ratio("numerator", "denominator").alias("prevalence"),
        )
    )


def value_counts(df: DataFrame) -> DataFrame:
    """Counts by channel, outcome, scenario and failure category, overall and per split."""
    fields = ("channel", "outcome", "scenario_type", "failure_category")
    structs = ", ".join(f"struct('{f}' as field, {f} as value)" for f in fields)
    per_split = (
        df.select("split", F.expr(f"inline(array({structs}))"))
        .filter("value is not null")
        .groupBy("field", "value", "split")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    overall = per_split.groupBy("field", "value").agg(F.sum("n").alias("n")).selectExpr(
        "field", "value", "'all' as split", "n"
    )
    return per_split.unionByName(overall)


def group_sizes(df: DataFrame) -> DataFrame:
    """Distribution of campaign sizes and of events per merchant."""
    sizes = (
        df.select(F.expr("inline(array(struct('campaign' as what, campaign_id as k), struct('merchant' as what, merchant_id as k)))"))
        .filter("k is not null")
        .groupBy("what", "k")
        .agg(F.count(F.lit(1)).alias("size"))
    )
    return integer_distribution(sizes, "size", ("what",))


def retry_chains(df: DataFrame) -> DataFrame:
    chains = (
        df.filter("scenario_type = 'legitimate_retry' and scenario_instance_id is not null")
        .groupBy("scenario_instance_id")
        .agg(F.count(F.lit(1)).alias("length"), F.expr("max(outcome = 'authorized')").alias("ok"))
    )
    success = chains.agg(F.count_if("ok").alias("n")).scalar()
    lengths = integer_distribution(chains, "length")
    return lengths.withColumn("succeeded", success).withColumn(
        "success_rate", fixed_decimal_ratio("succeeded", "count")
    )


def entity_reuse(df: DataFrame) -> DataFrame:
    """Unique tokens and events per token for each token column."""
    structs = ", ".join(f"struct('{f}' as field, {f} as token)" for f in TOKEN_FIELDS)
    per_token = (
        df.select(F.expr(f"inline(array({structs}))"))
        .filter("token is not null")
        .groupBy("field", "token")
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return integer_distribution(per_token, "events", ("field",)).withColumnRenamed("count", "unique_tokens")


def attack_entity_reuse(df: DataFrame) -> DataFrame:
    """Token reuse among attacks per split and entity.

    Distinct tokens are counted in two steps, so no single group holds a split's tokens.
    """
    structs = ", ".join(f"struct('{k}' as entity, {k}_token as token)" for k in ("device", "network", "session"))
    per_token = (
        df.filter("is_attack")
        .select("split", F.expr(f"inline(array({structs}))"))
        .groupBy("split", "entity", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_token.groupBy("split", "entity")
        .agg(
            F.sum("n").alias("attack_events"),
            F.count("token").alias("unique_tokens"),
            F.expr("coalesce(sum(if(token is null, 0L, n)), 0L)").alias("non_missing_events"),
        )
        .withColumns({
            "attack_events_per_unique_token": fixed_decimal_ratio("attack_events", "unique_tokens"),
            "unique_tokens_per_attack_event": fixed_decimal_ratio("unique_tokens", "attack_events"),
        })
    )
