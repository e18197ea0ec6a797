"""Checkout attempts, labels, scores and ledgers derived from the given tables.

Each function is a lazy projection of one parquet table (or of another view), so only the columns a
query uses are read. ``sql_views`` states the same formulas in SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardweir.functions.scalars import audit_decimal, hmac_sha256, int_div, token
from cardweir.session import use_utc

START_MS = 1_767_225_600_000  # 2026-01-01T00:00:00Z
TRAIN_END_MS = START_MS + 28_800_000
CALIBRATION_END_MS = START_MS + 36_000_000
#: Where the parts end in which streams get the event set.
PART_EDGES_MS = (TRAIN_END_MS, TRAIN_END_MS + 3_600_000, CALIBRATION_END_MS)
DENY_THRESHOLD = 0.62
WEBHOOK_KEY = b"whk-demo-key-for-tests"

SCENARIO_BY_EVENT_TYPE = {
    "click": "normal",
    "view": "flash_sale",
    "purchase": "legitimate_retry",
    "signup": "shared_infrastructure",
    "error": "legitimate_failure",
}
LEGITIMATE_SCENARIOS = (
    "flash_sale",
    "legitimate_failure",
    "legitimate_retry",
    "normal",
    "shared_infrastructure",
)
ATTACK_SCENARIO = "card_testing_campaign"
SPLITS = ("train", "calibration", "test")
FAILURE_CATEGORIES = (
    "authentication",
    "insufficient_funds",
    "instrument_declined",
    "temporary_processing",
    "unknown",
)
CHANNELS = ("web", "mobile_web", "mobile_app")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on an input with fewer splits than cores; a no-op on any large table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


#: Feature vectors that one task sorts, about 700 bytes each.
WIDE_ROWS_PER_TASK = 250_000
#: Calls that one task builds, signs or screens: each takes a fraction of a millisecond.
CALLS_PER_TASK = 200_000


def spread_rows(df: DataFrame, rows_per_task: int, *keys: str) -> DataFrame:
    """Deal rows that are dear to work on into tasks of about ``rows_per_task``, at least one a core. The splits of a file follow its bytes
    and hold more rows the larger it is; splits without a row group of their own hold none."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows_per_task)), *keys)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    out = F.when(index == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        out = out.when(index == i, F.lit(v))
    return out


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return spread(table(spark, sf_dir, "events"), "event_id").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
        (START_MS + 1000 * int_div(micros - 1_704_067_200_000_000, F.lit(60_000_000))).alias("ms"),
    )


def _attempt_columns() -> dict[str, Column]:
    n, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    failed = F.col("event_type") == "error"
    return {
        "event_id": token("evt", n),
        "event_no": n,
        "occurred_at_ms": F.col("ms"),
        "merchant_id": token("mrc", u % 12),
        "checkout_id": token("chk", int_div(n, F.lit(3))),
        "customer_token": F.when(n % 20 != 0, token("cus", u)),
        "device_token": F.when(n % 33 != 0, token("dev", k % 40)),
        "network_token": F.when(n % 50 != 0, token("net", u % 25)),
        "session_token": token("ses", u * 4 + k % 4),
        "payment_instrument_token": token("pmt", (n * 7) % 500),
        "amount_subunits": (F.floor(F.col("value") * 100 + 0.5) + 1).cast("long"),
        "currency": F.lit("INR"),
        "outcome": F.when(failed, "failed").otherwise("authorized"),
        "failure_category": F.when(failed, _pick(FAILURE_CATEGORIES, k % 5)),
        "channel": _pick(CHANNELS, n % 3),
    }


def _label_columns() -> dict[str, Column]:
    n, k, ms = F.col("event_id"), F.col("k"), F.col("ms")
    attack = (F.col("event_type") == "error") & (k >= 60)
    scenario = F.when(attack, ATTACK_SCENARIO)
    for event_type, name in SCENARIO_BY_EVENT_TYPE.items():
        scenario = scenario.when(F.col("event_type") == event_type, name)
    split = (
        F.when(ms < TRAIN_END_MS, "train")
        .when(ms < CALIBRATION_END_MS, "calibration")
        .otherwise("test")
    )
    return {
        "split": split,
        "is_attack": attack,
        "campaign_id": F.when(attack, token("cmp", k % 10)),
        "scenario_type": scenario,
        "scenario_instance_id": F.when(attack, token("scn", 1_000_000 + k % 10)).when(
            F.col("event_type") == "purchase", token("scn", int_div(n, F.lit(4)))
        ),
        "campaign_profile": F.when(
            attack, F.when(split == "test", "entity_reuse_shift").otherwise("baseline_reuse")
        ),
    }


def _score_columns() -> dict[str, Column]:
    attack = ((F.col("event_type") == "error") & (F.col("k") >= 60)).cast("int")
    value = F.col("value")
    p = F.least(F.lit(100.0), F.floor(100 * value / (value + 50)) + 30 * attack) / 100.0
    return {"y": attack, "p": p}


def _project(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in columns.items()])


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_events(spark, sf_dir), _attempt_columns())


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = {"event_id": token("evt", F.col("event_id")), "occurred_at_ms": F.col("ms")}
    return _project(_events(spark, sf_dir), {**ident, **_label_columns()})


def labelled_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(_events(spark, sf_dir), {**_attempt_columns(), **_label_columns()})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "event_id": token("evt", F.col("event_id")),
        "occurred_at_ms": F.col("ms"),
        **_score_columns(),
        **{n: c for n, c in _label_columns().items() if n in ("split", "scenario_type", "campaign_id")},
    }
    return _project(_events(spark, sf_dir), columns)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per attempt, with every way a decision can end up under review."""
    rows = _project(_events(spark, sf_dir), {**_attempt_columns(), **_score_columns()})
    n = F.col("event_no")
    pending = n % 71 == 0
    known = ~pending & (n % 89 != 0)
    deny = F.col("p") >= DENY_THRESHOLD
    order_failed = n % 53 == 0
    return rows.select(
        token("dec", n).alias("id"),
        "event_id",
        "event_no",
        "merchant_id",
        "checkout_id",
        "session_token",
        "payment_instrument_token",
        "customer_token",
        "device_token",
        "network_token",
        "amount_subunits",
        "currency",
        "channel",
        F.when(~pending & (n % 97 != 0), F.col("occurred_at_ms")).alias("occurred_at_ms"),
        (F.col("occurred_at_ms") + 1000).alias("created_at_ms"),
        F.when(known, audit_decimal(F.col("p"))).alias("calibrated_probability"),
        F.lit(str(DENY_THRESHOLD)).cast("decimal(20,18)").alias("decision_threshold"),
        F.when(known, F.when(deny, "deny").otherwise("allow")).alias("risk_decision"),
        F.when(
            ~pending,
            F.when(~known, "review")
            .when(deny, "deny")
            .when(order_failed, "review")
            .otherwise("allow"),
        ).alias("action"),
        F.when(~pending & ~known, "feature_computation_failed")
        .when(known & ~deny & order_failed, "order_creation_failed")
        .alias("fail_safe_reason"),
        F.when(known & ~deny & ~order_failed, token("order", n)).alias("provider_order_id"),
        F.when(n % 2 == 0, "model_a").otherwise("model_b").alias("model_id"),
        F.lit("1.0.0").alias("feature_schema_version"),
        F.lit("1.0.0").alias("feature_engine_version"),
        F.when(pending, "pending").otherwise("final").alias("status"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        ledger(spark, sf_dir)
        .filter(F.col("action") == "review")
        .select(
            token("rev", F.col("event_no")).alias("review_id"),
            F.col("id").alias("risk_decision_id"),
            F.col("fail_safe_reason").alias("reason"),
            F.lit("pending").alias("status"),
            "created_at_ms",
        )
    )


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero to three attempts per denial, in every state an attempt can be in."""
    n = F.col("event_no")
    state = _pick(("failed", "pending", "ready", "rejected"), (n + F.col("attempt_number")) % 4)
    return (
        ledger(spark, sf_dir)
        .filter((F.col("risk_decision") == "deny") & (n % 4 > 0))
        .select(
            F.col("id").alias("risk_decision_id"),
            "event_no",
            "created_at_ms",
            F.explode(F.sequence(F.lit(1), (n % 4).cast("int"))).alias("attempt_number"),
        )
        .select(
            "risk_decision_id",
            "event_no",
            "attempt_number",
            state.alias("status"),
            (F.col("created_at_ms") + 1000 * F.col("attempt_number")).alias("created_at_ms"),
            F.when(state == "ready", F.concat(F.lit("summary "), n.cast("string"))).alias("summary"),
            F.when(state.isin("failed", "rejected"), "provider_error").alias("failure_reason"),
        )
    )


def reference_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-bin score counts of the training split, the locked side of drift."""
    counts = (
        scored(spark, sf_dir)
        .filter(F.col("split") == "train")
        .groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("bin_count"))
    )
    edges = spark.range(10).select(
        F.col("id").alias("bin"),
        (F.col("id") / F.lit(10.0)).alias("lower_inclusive"),
        ((F.col("id") + 1) / F.lit(10.0)).alias("upper_value"),
        (F.col("id") == 9).alias("upper_inclusive"),
    )
    return edges.join(F.broadcast(counts), "bin", "left").fillna(0, ["bin_count"])


def webhooks(spark: SparkSession, sf_dir: str, key: bytes = WEBHOOK_KEY) -> DataFrame:
    """Signed provider calls built from orders, with every way a call can be refused."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    o = spread_rows(o, CALLS_PER_TASK, *o.columns)
    n = F.col("o_orderkey")
    cents = F.floor(F.col("o_totalprice").cast("double") * 100 + 0.5).cast("long")
    name = (
        F.when(F.col("o_orderstatus") == "F", "payment.failed")
        .when(F.col("o_orderstatus") == "O", "payment.authorized")
        .otherwise(F.when(n % 2 == 0, "payment.captured").otherwise("refund.created"))
    )
    seconds = F.lit(1_700_000_000) + n * 7
    text = lambda c: c.cast("string")
    body = F.concat(
        F.lit('{"entity":"'), F.when(n % 43 == 0, "thing").otherwise("event"),
        F.lit('","event":"'), name,
        F.lit('","account_id":"acc_'), text(F.col("o_custkey")),
        F.lit('","contains":["payment"],"created_at":'), text(seconds),
        F.lit(',"extra":"dropped","payload":{"payment":{"entity":{"id":"pay_'), text(n),
        F.lit('","entity":"payment","amount":'), text(F.when(n % 47 == 0, -cents).otherwise(cents)),
        F.lit(',"amount_refunded":0,"currency":"'), F.when(n % 59 == 0, "inr").otherwise("INR"),
        F.lit('","status":"'), F.substring_index(name, ".", -1),
        F.lit('","order_id":'),
        F.when(n % 5 == 0, "null").otherwise(F.concat(F.lit('"ord_'), text(n), F.lit('"'))),
        F.lit(',"method":"card","captured":'), F.when(name == "payment.captured", "true").otherwise("false"),
        F.lit(',"email":"a@b.example","card":{"last4":"1111"},"error_code":'),
        F.when((name == "payment.failed") & (n % 2 == 0), '"BAD REQUEST"')
        .when(n % 3 == 0, '"GATEWAY_ERROR"').otherwise("null"),
        F.lit(',"created_at":'), text(seconds - 60),
        F.lit("}}}}"),
    )
    calls = o.select(
        n.alias("call_no"),
        F.when(n % 61 != 0, F.concat(F.lit("wh_"), text(n % 1400))).alias("provider_event_id"),
        F.when(n % 31 == 0, "text/plain").otherwise("Application/JSON; charset=utf-8").alias("content_type"),
        body.alias("body"),
        (F.lit(START_MS) + n).alias("received_at_ms"),
    )
    signature = hmac_sha256(F.col("body"), key)
    return calls.withColumn(
        "signature",
        F.when(F.col("call_no") % 41 == 0, F.lit(None).cast("string"))
        .when(F.col("call_no") % 37 == 0, F.lit("0" * 64))
        .when(F.col("call_no") % 29 == 0, F.upper(signature))
        .otherwise(signature),
    )

