"""The 75-column feature vector and its invariants."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweir.functions.scalars import bp_floor, int_div
from cardweir.operators.rolling import CHECKOUT, FAMILIES, RollingSpec, Slicing, rolling_features

CURRENT_FEATURES = (
    "amount_subunits",
    "utc_hour",
    "utc_day_of_week",
    "channel_web",
    "channel_mobile_web",
    "channel_mobile_app",
    "customer_token_missing",
    "device_token_missing",
    "network_token_missing",
)


def current_columns() -> list[Column]:
    """Features of the attempt itself; hour and weekday (Monday 0) in UTC by integer arithmetic."""
    t = F.col("occurred_at_ms")
    return [
        F.col("amount_subunits").cast("long").alias("amount_subunits"),
        (int_div(t, F.lit(3_600_000)) % 24).alias("utc_hour"),
        # 1970-01-01 was a Thursday, weekday 3.
        ((int_div(t, F.lit(86_400_000)) + 3) % 7).alias("utc_day_of_week"),
        *[
            (F.col("channel") == c).cast("long").alias(f"channel_{c}")
            for c in ("web", "mobile_web", "mobile_app")
        ],
        *[
            F.col(f"{k}_token").isNull().cast("long").alias(f"{k}_token_missing")
            for k in ("customer", "device", "network")
        ],
    ]


def current_features(df: DataFrame) -> DataFrame:
    return df.select("event_id", *current_columns())


def assume_authorized(df: DataFrame) -> DataFrame:
    """Counterfactual: every attempt went through."""
    return df.withColumns(
        {"outcome": F.lit("authorized"), "failure_category": F.lit(None).cast("string")}
    )


def preflight_to_event(df: DataFrame, occurred_at_ms: str = "assigned_at_ms", keep: tuple[str, ...] = ()) -> DataFrame:
    """A checkout request in the event schema: not yet attempted, so authorized by assumption."""
    kept = (
        "event_id", "merchant_id", "checkout_id", "customer_token", "device_token",
        "network_token", "session_token", "payment_instrument_token", "amount_subunits",
        "currency", "channel",
    )
    return assume_authorized(df.select(*kept, *keep, F.col(occurred_at_ms).alias("occurred_at_ms")))


def feature_names() -> list[str]:
    names = list(CURRENT_FEATURES)
    for f in FAMILIES:
        for w in f.windows:
            names.append(f"{f.name}_prior_attempt_count_{w}s")
            if f.failures:
                names.append(f"{f.name}_prior_failure_count_{w}s")
            names += [f"{f.name}_distinct_{plural}_{w}s" for plural, _ in f.distinct]
        if f.failures:
            names.append(f"{f.name}_prior_failure_rate_300s_bp")
        if f.last_seen:
            names += [f"{f.name}_history_present", f"{f.name}_previous_attempt_age_ms"]
    return sorted(names)


FEATURE_NAMES = tuple(feature_names())


def feature_vector(df: DataFrame, slicing: Slicing | None = Slicing()) -> DataFrame:
    """``event_id``, ``occurred_at_ms`` and the 75 features in name order."""
    prepared = df.select(
        "event_id", "occurred_at_ms", "outcome",
        *sorted({f.key for f in FAMILIES}),
        *current_columns(),
    )
    spec = RollingSpec(FAMILIES, carry=CURRENT_FEATURES, slicing=slicing)
    return rolling_features(prepared, spec).select("event_id", "occurred_at_ms", *FEATURE_NAMES)


def broken_invariants(prefix: str = "") -> Column:
    """The names of the invariants that a row of features breaks; ``prefix`` leads to the features, as ``features.`` does."""

    def c(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    rules: list[tuple[str, Column]] = [
        ("one_channel", c("channel_web") + c("channel_mobile_web") + c("channel_mobile_app") != 1),
        (
            "history_flag",
            (c("checkout_prior_attempt_count_3600s") > 0) != (c("checkout_history_present") == 1),
        ),
        (
            "age_without_history",
            (c("checkout_history_present") == 0) & (c("checkout_previous_attempt_age_ms") != 0),
        ),
    ]
    for f in FAMILIES:
        if f is CHECKOUT:
            continue
        parts = ["prior_attempt_count", "prior_failure_count"]
        parts += [f"distinct_{plural}" for plural, _ in f.distinct]
        for w in f.windows:
            for part in parts[1:]:
                rules.append((
                    f"{f.name}_{part}_within_attempts_{w}s",
                    c(f"{f.name}_{part}_{w}s") > c(f"{f.name}_prior_attempt_count_{w}s"),
                ))
        for narrow, wide in zip(f.windows, f.windows[1:]):
            for part in parts:
                rules.append((
                    f"{f.name}_{part}_grows_{narrow}s_{wide}s",
                    c(f"{f.name}_{part}_{wide}s") < c(f"{f.name}_{part}_{narrow}s"),
                ))
        rules.append((
            f"{f.name}_rate",
            c(f"{f.name}_prior_failure_rate_300s_bp")
            != bp_floor(
                c(f"{f.name}_prior_failure_count_300s"), c(f"{f.name}_prior_attempt_count_300s")
            ),
        ))
        if f.name in ("device", "network"):
            columns = [c(f"{f.name}_{p}_{w}s") for p in parts for w in f.windows]
            total = columns[0]
            for column in columns[1:]:
                total = total + column
            rules.append((f"{f.name}_missing_has_history", (c(f"{f.name}_token_missing") == 1) & (total > 0)))
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def feature_violations(features: DataFrame) -> DataFrame:
    """(event_id, rule) for each broken invariant; empty on sound features. One pass, no shuffle."""
    return features.select("event_id", F.explode(broken_invariants()).alias("rule"))
