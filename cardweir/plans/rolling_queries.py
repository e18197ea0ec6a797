"""R: rolling features. P1: features of the attempt itself. J4: the interval self join."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardweir.operators import features as X
from cardweir.operators.joins import prior_counts
from cardweir.operators.rolling import (
    CHECKOUT,
    DEVICE,
    FAMILIES,
    INSTRUMENT,
    MERCHANT,
    NETWORK,
    SESSION,
    Family,
    RollingSpec,
    Slicing,
    rolling_features,
)
from cardweir.plans.registry import query
from cardweir.sources import tables as T

COUNTED = tuple(f for f in FAMILIES if f is not CHECKOUT)


def family_sql(f: Family, counts=True, failures=True, distinct=True, rate=False) -> str:
    columns = []
    for w in f.windows:
        inside = f"b.occurred_at_ms > a.occurred_at_ms - {w * 1000}"
        if counts:
            columns.append(f"count(CASE WHEN {inside} THEN 1 END) AS {f.name}_prior_attempt_count_{w}s")
        if failures and f.failures:
            columns.append(
                f"count(CASE WHEN {inside} AND b.outcome = 'failed' THEN 1 END)"
                f" AS {f.name}_prior_failure_count_{w}s"
            )
        if distinct:
            columns += [
                f"count(DISTINCT CASE WHEN {inside} THEN b.{c} END) AS {f.name}_distinct_{plural}_{w}s"
                for plural, c in f.distinct
            ]
    if rate and f.failures:
        inside = "b.occurred_at_ms > a.occurred_at_ms - 300000"
        columns.append(
            f"coalesce(count(CASE WHEN {inside} AND b.outcome = 'failed' THEN 1 END) * 10000"
            f" // nullif(count(CASE WHEN {inside} THEN 1 END), 0), 0)"
            f" AS {f.name}_prior_failure_rate_300s_bp"
        )
    if f.last_seen:
        columns.append(
            f"coalesce(min(a.occurred_at_ms) - max(b.occurred_at_ms), 0)"
            f" AS {f.name}_previous_attempt_age_ms"
        )
        columns.append(f"CASE WHEN count(b.event_id) > 0 THEN 1 ELSE 0 END AS {f.name}_history_present")
    return f"""SELECT a.event_id, {', '.join(columns)}
FROM attempts a LEFT JOIN attempts b ON b.{f.key} = a.{f.key}
  AND b.occurred_at_ms > a.occurred_at_ms - {f.windows[-1] * 1000}
  AND b.occurred_at_ms <= a.occurred_at_ms
  AND (b.occurred_at_ms < a.occurred_at_ms OR b.event_id < a.event_id)
GROUP BY a.event_id"""


def families_sql(families, **parts) -> str:
    names = [f.name for f in families]
    joined = names[0] + "".join(f" JOIN {n} USING (event_id)" for n in names[1:])
    ctes = ", ".join(f"{f.name} AS ({family_sql(f, **parts)})" for f in families)
    return f"WITH {ctes} SELECT * FROM {joined}"


CURRENT_SQL = """amount_subunits, (occurred_at_ms // 3600000) % 24 AS utc_hour,
  (occurred_at_ms // 86400000 + 3) % 7 AS utc_day_of_week,
  CAST(channel = 'web' AS BIGINT) AS channel_web,
  CAST(channel = 'mobile_web' AS BIGINT) AS channel_mobile_web,
  CAST(channel = 'mobile_app' AS BIGINT) AS channel_mobile_app,
  CAST(customer_token IS NULL AS BIGINT) AS customer_token_missing,
  CAST(device_token IS NULL AS BIGINT) AS device_token_missing,
  CAST(network_token IS NULL AS BIGINT) AS network_token_missing"""


def _plain(families, *, counts=False, failures=False):
    def run(spark, sf):
        from dataclasses import replace

        spec = RollingSpec(tuple(replace(f, failures=failures, distinct=()) for f in families))
        out = rolling_features(T.attempts(spark, sf), spec)
        word = "_failure_count_" if failures else "_attempt_count_"
        return out.select("event_id", *[c for c in out.columns if word in c])

    return run


def _distinct(family):
    def run(spark, sf):
        from dataclasses import replace

        spec = RollingSpec((replace(family, failures=False),))
        return rolling_features(T.attempts(spark, sf), spec).select(
            "event_id", *[f"{family.name}_distinct_{p}_{w}s" for w in family.windows for p, _ in family.distinct]
        )

    return run


query("R1_prior_count", families_sql(COUNTED, failures=False, distinct=False))(
    _plain(COUNTED, counts=True)
)
query("R2_prior_failure_count", families_sql(COUNTED, counts=False, distinct=False))(
    _plain(COUNTED, failures=True)
)
for number, fam in ((3, MERCHANT), (4, DEVICE), (5, NETWORK), (6, INSTRUMENT), (7, SESSION)):
    query(f"R{number}_{fam.name}_distinct", family_sql(fam, counts=False, failures=False))(_distinct(fam))


@query(
    "R8_prior_failure_rate_bp",
    families_sql(COUNTED, counts=False, failures=False, distinct=False, rate=True),
)
def prior_failure_rate(spark, sf):
    from dataclasses import replace

    spec = RollingSpec(tuple(replace(f, windows=(300,), distinct=()) for f in COUNTED))
    out = rolling_features(T.attempts(spark, sf), spec)
    return out.select("event_id", *[c for c in out.columns if c.endswith("_rate_300s_bp")])


@query("R9_checkout_history", family_sql(CHECKOUT))
def checkout_history(spark, sf):
    out = rolling_features(T.attempts(spark, sf), RollingSpec((CHECKOUT,)))
    return out.drop("occurred_at_ms")


ALL_SQL = (
    "WITH "
    + ", ".join(f"{f.name} AS ({family_sql(f, rate=True)})" for f in FAMILIES)
    + f", cur AS (SELECT event_id, occurred_at_ms, {CURRENT_SQL} FROM attempts)"
)


@query(
    "R10_feature_vector",
    ALL_SQL + " SELECT * FROM cur " + " ".join(f"JOIN {f.name} USING (event_id)" for f in FAMILIES),
)
def feature_vector(spark, sf):
    return X.feature_vector(T.attempts(spark, sf))


@query(
    "R10_feature_vector_sliced",
    ALL_SQL + " SELECT * FROM cur " + " ".join(f"JOIN {f.name} USING (event_id)" for f in FAMILIES),
)
def feature_vector_sliced(spark, sf):
    """The way of hot entities: all merchants, devices and networks are above this share, and their slices make many blocks."""
    return X.feature_vector(T.attempts(spark, sf), Slicing(share=0.01, minimum_rows=0, sample_modulus=4, slice_ms=60_000, fan=8))


@query(
    "R11_feature_invariants",
    "SELECT event_id, 'one_channel' AS rule FROM attempts WHERE amount_subunits % 2 = 0"
    " UNION ALL SELECT event_id, 'age_without_history' FROM (" + family_sql(CHECKOUT) + ") c"
    " JOIN attempts USING (event_id) WHERE checkout_history_present = 0 AND amount_subunits % 5 = 0",
)
def feature_invariants(spark, sf):
    """Sound vectors with two faults planted in every table-sized run, so violations appear."""
    v = X.feature_vector(T.attempts(spark, sf))
    planted = v.withColumns({
        "channel_web": F.when(
            F.col("amount_subunits") % 2 == 0, F.col("channel_web") + 1
        ).otherwise(F.col("channel_web")),
        "checkout_previous_attempt_age_ms": F.when(
            (F.col("checkout_history_present") == 0) & (F.col("amount_subunits") % 5 == 0), F.lit(1)
        ).otherwise(F.col("checkout_previous_attempt_age_ms")),
    })
    return X.feature_violations(planted)


@query("P1_current_features", f"SELECT event_id, {CURRENT_SQL} FROM attempts")
def current_features(spark, sf):
    return X.current_features(T.attempts(spark, sf))


@query(
    "J4_prior_events",
    """SELECT a.device_token AS entity, count(*) AS pairs, count(DISTINCT a.event_id) AS events,
  CAST(sum(a.occurred_at_ms - b.occurred_at_ms) AS BIGINT) AS total_gap_ms
FROM attempts a JOIN attempts b ON a.device_token = b.device_token
  AND b.occurred_at_ms > a.occurred_at_ms - 300000 AND b.occurred_at_ms <= a.occurred_at_ms
  AND (b.occurred_at_ms < a.occurred_at_ms OR b.event_id < a.event_id)
GROUP BY a.device_token""",
)
def prior_events_by_device(spark, sf):
    counted = prior_counts(T.attempts(spark, sf), "device_token", 300).filter("prior_count > 0")
    return counted.groupBy("entity").agg(
        F.sum("prior_count").alias("pairs"), F.count(F.lit(1)).alias("events"), F.sum("prior_gap_ms").alias("total_gap_ms")
    )
