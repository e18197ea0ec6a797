"""Read-side queries of the decision ledger: pages, summaries, entity context, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cardweir.functions.scalars import anchor_time, audit_decimal, clamp, int_div, plain_decimal_text
from cardweir.operators.joins import join_on_entity
from cardweir.session import materialise, new_table_path

MAXIMUM_PAGE = 500
DAY_MS = 86_400_000
#: Rows before a page that a top-k may hold in one task.
DEEP = 5_000
MAXIMUM_ATTEMPTS = 3

# Entity kinds and their ledger columns; the merchant is context, never a graph hub.
GRAPH_KINDS = (
    ("device", "device_token"),
    ("network", "network_token"),
    ("instrument", "payment_instrument_token"),
)
CONTEXT_KINDS = (*GRAPH_KINDS, ("merchant", "merchant_id"))


def with_anchor(df: DataFrame) -> DataFrame:
    """``anchor_ms`` as a column; a clustered ledger has it stored."""
    return df if "anchor_ms" in df.columns else df.withColumn("anchor_ms", anchor_time())


def newest_first() -> list[Column]:
    """Newest by the time a decision is filed under; id makes the order total."""
    return [anchor_time().desc(), F.col("created_at_ms").desc(), F.col("id")]


def filed_since(df: DataFrame, since_ms: Column | int) -> Column:
    """Rows filed at or after a time. On a clustered ledger this prunes day folders and skips row groups by ``anchor_ms``."""
    since = F.lit(since_ms) if isinstance(since_ms, int) else since_ms
    if "anchor_ms" not in df.columns:
        return anchor_time() >= since
    kept = F.col("anchor_ms") >= since
    return kept & (F.col("day") >= F.floor(since / DAY_MS)) if "day" in df.columns else kept


def ledger_filter(df: DataFrame, action: str | None = None, since_ms=None) -> DataFrame:
    if action is not None:
        df = df.filter(F.col("action") == action)
    if since_ms is not None:
        df = df.filter(filed_since(df, since_ms))
    return df


def summary_view(df: DataFrame) -> DataFrame:
    """The 22 columns a reader may see; no action yet shows as review, decimals as plain text."""
    return df.select(
        F.col("id").alias("decision_id"),
        "event_id", "merchant_id", "checkout_id", "device_token", "network_token",
        "payment_instrument_token", "session_token", "customer_token", "amount_subunits",
        "currency", "channel", "occurred_at_ms", "created_at_ms",
        plain_decimal_text("calibrated_probability").alias("calibrated_probability"),
        F.coalesce(plain_decimal_text("decision_threshold"), F.lit("0")).alias("decision_threshold"),
        "risk_decision",
        F.coalesce("action", F.lit("review")).alias("action"),
        "fail_safe_reason", "provider_order_id", "status", "model_id",
    )


class PageIndex:
    """The order of a ledger's pages, so that a page far down opens only the slices it lies in.

    Built once for a filter: rows are range-partitioned newest first and written, each slice in a folder of its own, with their number
    per slice beside. A page is then a range of places: the slices that hold it are known from the numbers, and only these are read.
    """

    def __init__(self, df: DataFrame, action=None, since_ms=None) -> None:
        kept = ledger_filter(df, action, since_ms)
        self.spark, self.schema = df.sparkSession, kept.schema
        self.path = new_table_path(self.spark, "pages")
        kept.repartitionByRange(*newest_first()).withColumn("slice", F.spark_partition_id()).write.partitionBy("slice").parquet(self.path)
        counted = [(r.slice, r["count"]) for r in self._read().groupBy("slice").count().orderBy("slice").collect()]  # one row per slice
        self.starts, self.total = [], 0
        for number, n in counted:
            self.starts.append((number, self.total, n))
            self.total += n

    def _read(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("slice", IntegerType())])).parquet(self.path)

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """The rows at places offset to offset + limit, with the total the filter matches."""
        limit, offset = max(1, min(limit, MAXIMUM_PAGE)), max(0, offset)
        touched = [(k, start) for k, start, n in self.starts if start < offset + limit and offset < start + n]
        rows = self._read().filter(F.col("slice").isin([k for k, _ in touched]))
        first = touched[0][1] if touched else 0
        # the slices before hold exactly ``first`` rows, so the rest of the offset lies in the first slice read
        page = rows.orderBy(*newest_first()).offset(offset - first if touched else 0).limit(limit).drop("slice")
        return summary_view(page).withColumn("total", F.lit(self.total).cast("long"))


def ledger_page(df: DataFrame, limit: int = 50, offset: int = 0, action=None, since_ms=None) -> DataFrame:
    """One page newest first, each row with the total the filter matches (a top-k report).

    The first pages are a top-k. From ``DEEP`` on the page comes from its slices, so no task holds the rows before it.
    """
    limit, offset = max(1, min(limit, MAXIMUM_PAGE)), max(0, offset)
    if offset >= DEEP:
        return PageIndex(df, action, since_ms).page(limit, offset)
    kept = ledger_filter(df, action, since_ms)
    total = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    page = kept.orderBy(*newest_first()).offset(offset).limit(limit)
    return summary_view(page).withColumn("total", total)


def since_window(df: DataFrame, now_ms: Column, seconds: int, low: int, high: int) -> DataFrame:
    """Rows of the last ``seconds`` (clamped) before ``now``; ``now`` is given, never the clock."""
    window = clamp(F.lit(seconds), F.lit(low), F.lit(high))
    return df.filter(filed_since(df, now_ms - window * 1000))


def latest_time(df: DataFrame) -> Column:
    return df.agg(F.max("occurred_at_ms").alias("now")).scalar()


def eligible_for_explanation(df: DataFrame) -> DataFrame:
    return df.filter((F.col("status") == "final") & (F.col("risk_decision") == "deny"))


def review_pending(decisions: DataFrame, reviews: DataFrame) -> DataFrame:
    waiting = reviews.select(F.col("risk_decision_id").alias("id")).distinct()
    return decisions.join(waiting.withColumn("_r", F.lit(True)), "id", "left").withColumn(
        "review_pending", F.coalesce("_r", F.lit(False))
    ).drop("_r")


def ledger_summary(df: DataFrame, reviews: DataFrame) -> DataFrame:
    """Totals by action, orders, pending reviews and the newest row's versions, one row."""
    newest = F.struct(anchor_time(), "created_at_ms", "id")
    versions = F.struct("model_id", "feature_schema_version", "feature_engine_version")
    pending = reviews.agg(F.expr("count_if(status = 'pending')").alias("n")).scalar()
    return df.agg(
        F.count(F.lit(1)).alias("total_decisions"),
        F.expr("count_if(action = 'allow')").alias("allow"),
        F.expr("count_if(action = 'review')").alias("review"),
        F.expr("count_if(action = 'deny')").alias("deny"),
        F.count("provider_order_id").alias("orders_created"),
        F.max(anchor_time()).alias("latest_decision_ms"),
        F.max_by(versions, newest).alias("v"),
    ).select("*", "v.*", pending.alias("review_items_pending")).drop("v")


def entity_rows(df: DataFrame, kinds=CONTEXT_KINDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, token, action, anchor): one row per decision and token it carries."""
    structs = ", ".join(f"named_struct('kind', '{k}', 'token', {c})" for k, c in kinds)
    return (
        df.select(
            "id", "action", anchor_time().alias("anchor_ms"), *keep,
            F.expr(f"inline(array({structs}))"),
        )
        .filter("token is not null")
    )


def entity_totals(rows: DataFrame) -> DataFrame:
    """Per (kind, token): counts and its earliest and latest decision, combined map-side."""
    return rows.groupBy("kind", "token").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("count_if(action = 'deny')").alias("n_deny"),
        F.expr("count_if(action = 'review')").alias("n_review"),
        F.min(F.struct("anchor_ms", "id")).alias("low"),
        F.max(F.struct("anchor_ms", "id")).alias("high"),
    )


def entity_context(df: DataFrame, exclude_self: bool, targets: DataFrame | None = None) -> DataFrame:
    """Per decision and entity kind: how often the token was decided on, and how it went.

    With ``exclude_self`` the decision itself is left out by id: counts drop by one and, where it
    was the earliest or latest, the next one takes its place. Tokens are aggregated before they meet
    the decisions again; a token that holds a third of the ledger is joined by broadcast.

    ``targets``: the decisions of ``df`` whose context is wanted. Totals are built for their tokens alone, from all decisions
    that carry one, and only the targets meet them again.
    """
    asked = df if targets is None else targets
    own = entity_rows(asked)
    rows = entity_rows(df)
    if targets is not None:
        # rows of other tokens go before anything is shuffled or summed
        rows = rows.join(own.select("kind", "token").distinct(), ["kind", "token"], "left_semi")
    totals = materialise(entity_totals(rows), "entity-totals")
    if exclude_self:
        # The runner-up at each end: the same minimum with the extreme row removed.
        rest = join_on_entity(
            rows,
            totals.select("kind", "token", "n", F.col("low.id").alias("low_id"), F.col("high.id").alias("high_id")),
            ["kind", "token"], "n",
        )
        second = rest.groupBy("kind", "token").agg(
            F.expr("min(if(id = low_id, null, anchor_ms))").alias("low2"),
            F.expr("max(if(id = high_id, null, anchor_ms))").alias("high2"),
        )
        # joined below in parts that each read it
        totals = materialise(totals.join(second, ["kind", "token"]), "entity-totals")
    joined = join_on_entity(own, totals, ["kind", "token"], "n")
    if exclude_self:
        joined = joined.selectExpr(
            "id", "kind", "token",
            "n - 1 as decision_count",
            "n_deny - if(action = 'deny', 1, 0) as denied_count",
            "n_review - if(action = 'review', 1, 0) as review_count",
            "if(low.id = id, low2, low.anchor_ms) as first_seen_ms",
            "if(high.id = id, high2, high.anchor_ms) as last_seen_ms",
        )
    else:
        joined = joined.selectExpr(
            "id", "kind", "token", "n as decision_count", "n_deny as denied_count",
            "n_review as review_count", "low.anchor_ms as first_seen_ms", "high.anchor_ms as last_seen_ms",
        )
    seen = joined.withColumns({
        "denied_count": F.coalesce("denied_count", F.lit(0)).cast("long"),
        "review_count": F.coalesce("review_count", F.lit(0)).cast("long"),
        "span_seconds": int_div(F.col("last_seen_ms") - F.col("first_seen_ms"), F.lit(1000)),
    })
    absent = ", ".join(f"if({c} is null, '{k}', null)" for k, c in CONTEXT_KINDS)
    missing = asked.select("id", F.explode(F.expr(f"array_compact(array({absent}))")).alias("kind")).selectExpr(
        "id", "kind", "string(null) as token", "0L as decision_count", "0L as denied_count",
        "0L as review_count", "bigint(null) as first_seen_ms", "bigint(null) as last_seen_ms",
        "bigint(null) as span_seconds",
    )
    return seen.unionByName(missing)


def attempts_used(explanations: DataFrame) -> DataFrame:
    return explanations.groupBy("risk_decision_id").agg(F.count(F.lit(1)).alias("attempts_used"))


def latest_explanation(explanations: DataFrame) -> DataFrame:
    """The attempt to show: the last ready one, else the last; and how many attempts remain."""
    best = F.struct((F.col("status") == "ready").alias("ready"), "attempt_number")
    return (
        explanations.groupBy("risk_decision_id")
        .agg(
            F.max_by(F.struct("attempt_number", "status", "summary", "failure_reason"), best).alias("v"),
            F.count(F.lit(1)).alias("used"),
        )
        .select(
            "risk_decision_id", "v.*",
            F.greatest(F.lit(MAXIMUM_ATTEMPTS) - F.col("used"), F.lit(0)).alias("attempts_remaining"),
        )
    )


def attempt_gate(decisions: DataFrame, explanations: DataFrame) -> DataFrame:
    """Whether a new explanation may be tried for each eligible decision."""
    state = explanations.groupBy(F.col("risk_decision_id").alias("id")).agg(
        F.count(F.lit(1)).alias("used"),
        F.expr("bool_or(status = 'pending')").alias("pending"),
        F.expr("bool_or(status = 'ready')").alias("ready"),
    )
    gate = (
        F.when(F.col("pending"), "in_progress")
        .when(F.col("ready"), "ready")
        .when(F.col("used") >= MAXIMUM_ATTEMPTS, "attempts_exhausted")
        .otherwise("open")
    )
    return eligible_for_explanation(decisions).select("id").join(state, "id", "left").select(
        "id", gate.alias("gate")
    )


def order_budget(df: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` allowed attempts keep their action; later ones go to review.

    Only the position within the budget matters, so the budget's last allowed row is found with a
    top-k and every row is compared to it; the ledger is never ranked as a whole.
    """
    key = F.struct(F.col("created_at_ms"), F.col("id"))
    allowed = df.filter("action = 'allow'").orderBy("created_at_ms", "id").limit(budget)
    last = allowed.agg(F.max(key).alias("last")).scalar()
    spent = (F.col("action") == "allow") & F.coalesce(key > last, F.lit(True))
    return df.withColumns({
        "action": F.when(spent, "review").otherwise(F.col("action")),
        "fail_safe_reason": F.when(spent, "order_budget_exhausted").otherwise(F.col("fail_safe_reason")),
    })


def recent_scored(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest scored decisions (a bounded sample by definition; TakeOrdered)."""
    return df.filter("calibrated_probability is not null").orderBy(*newest_first()).limit(n)


def audit_copy(df: DataFrame, p: str = "p") -> DataFrame:
    return df.withColumn("calibrated_probability", audit_decimal(p))
