"""Equi, interval and anti joins between events, labels and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweir.functions.scalars import int_div
from cardweir.operators.ordering import order_violations, running_totals
from cardweir.sources.tables import WIDE_ROWS_PER_TASK


def join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One label per feature row, by event id.

    Vectors compress so well that partitions merged by their shuffled bytes hold very many of them; here they follow the rows, of which
    the labels have as many.
    """
    rows = labels.count()
    if rows > WIDE_ROWS_PER_TASK:
        features = features.repartition(-(-rows // WIDE_ROWS_PER_TASK), "event_id")
    return features.join(labels.drop("occurred_at_ms"), "event_id")


def join_anomalies(left: DataFrame, right: DataFrame, sequence: str | None = None) -> DataFrame:
    """(event_id, problem) for ids missing on a side or repeated on a side, and for rows out of order.

    ``sequence``: the column that numbers the rows of a side as they stand in its source; a side that has it must ascend along it
    by (time, id), and every row that does not exceed the one before it is reported as ``order_left`` or ``order_right``.
    """
    l = left.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_left"))
    r = right.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_right"))
    both = l.join(r, "event_id", "full_outer")
    problems = F.array_compact(F.array(
        F.when(F.col("n_left").isNull(), "missing_left"),
        F.when(F.col("n_right").isNull(), "missing_right"),
        F.when(F.col("n_left") > 1, "duplicate_left"),
        F.when(F.col("n_right") > 1, "duplicate_right"),
    ))
    found = both.select("event_id", F.explode(problems).alias("problem"))
    for side, name in ((left, "order_left"), (right, "order_right")) if sequence else ():
        found = found.unionByName(order_violations(side, sequence).select("event_id", F.lit(name).alias("problem")))
    return found


def lookup_labels(features: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """Attach label columns; Spark picks broadcast or shuffle from the label table's size."""
    return features.join(labels.select("event_id", *columns), "event_id")


def prior_events(
    events: DataFrame,
    key: str,
    window_seconds: int,
    event_id: str = "event_id",
    time_ms: str = "occurred_at_ms",
) -> DataFrame:
    """Every (event, earlier event of the same entity inside its window), the definitional form.

    Both sides are cut into buckets one window long: an earlier event lies in the same bucket or
    the one before, so the earlier side is written to two buckets and the join is an equi join.
    The result has one row per pair by definition; for window values use ``rolling_features``,
    which never builds the pairs.
    """
    width = window_seconds * 1000
    bucket = int_div(F.col(time_ms), F.lit(width))
    late = events.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("entity"),
        F.col(event_id).alias("event_id"),
        F.col(time_ms).alias("t"),
        bucket.alias("bucket"),
    )
    early = events.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("entity"),
        F.col(event_id).alias("prior_event_id"),
        F.col(time_ms).alias("prior_t"),
        F.explode(F.array(bucket, bucket + 1)).alias("bucket"),
    )
    return (
        late.join(early, ["entity", "bucket"])
        .filter(
            (F.col("prior_t") > F.col("t") - width)
            & (
                (F.col("prior_t") < F.col("t"))
                | ((F.col("prior_t") == F.col("t")) & (F.col("prior_event_id") < F.col("event_id")))
            )
        )
        .select("entity", "event_id", "prior_event_id", "t", "prior_t")
    )


def prior_counts(events: DataFrame, key: str, window_seconds: int, event_id: str = "event_id", time_ms: str = "occurred_at_ms") -> DataFrame:
    """(entity, event_id, t, prior_count, prior_gap_ms): how many pairs ``prior_events`` has for each event and the sum of their gaps.

    No pair is built. Each event comes into its entity's sums at its own time and leaves them a window later, so the sums are 0
    wherever an entity ends, and running totals along (entity, time) over the whole table are each entity's own. Their slices cut
    an entity of any size evenly.
    """
    width = window_seconds * 1000
    kept = events.filter(F.col(key).isNotNull()).select(F.col(key).alias("entity"), F.col(event_id).alias("event_id"), F.col(time_ms).alias("own_t"))
    steps = kept.selectExpr(
        "entity", "event_id", "own_t",
        # what leaves does so before what arrives in the same millisecond
        f"inline(array(struct(own_t as t, 1 as arrives), struct(own_t + {width} as t, 0 as arrives)))",
    )
    order = [F.col(c) for c in ("entity", "t", "arrives", "event_id")]
    running = running_totals(steps, order, {"n": "if(arrives = 1, 1L, -1L)", "sum_t": "if(arrives = 1, own_t, -own_t)"})
    return running.filter("arrives = 1").selectExpr(
        "entity", "event_id", "t", "n - 1 as prior_count", "(n - 1) * t - (sum_t - t) as prior_gap_ms"
    )


def compare_rows(actual: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """(event_id, problem) for missing, extra and differing rows; nulls compare equal."""
    a = actual.select("event_id", F.struct(*columns).alias("a"), F.lit(True).alias("in_a"))
    e = expected.select("event_id", F.struct(*columns).alias("e"), F.lit(True).alias("in_e"))
    problem = (
        F.when(F.col("in_a").isNull(), "missing")
        .when(F.col("in_e").isNull(), "extra")
        .when(~F.col("a").eqNullSafe(F.col("e")), "different")
    )
    return (
        a.join(e, "event_id", "full_outer")
        .select("event_id", problem.alias("problem"))
        .filter(F.col("problem").isNotNull())
    )


def overlap(left: DataFrame, right: DataFrame, column: str = "event_id") -> DataFrame:
    """Identities present on both sides; must be empty for a batch to count as unseen."""
    return left.select(column).intersect(right.select(column))


def assign_bin(df: DataFrame, bins: DataFrame, p: str = "p") -> DataFrame:
    """The reference bin of each probability; the last bin is closed, values clamp to [0, 1].

    ``bins`` is a reference of a fixed number of bins (ten): its edges become one array, and each row
    looks its bin up in it. Rows without a probability or a bin are left out.
    """
    value = F.greatest(F.least(F.col(p).cast("double"), F.lit(1.0)), F.lit(0.0))
    edges = bins.agg(F.collect_list(F.struct("bin", "lower_inclusive", "upper_value", "upper_inclusive"))).scalar()
    own = F.filter(
        "_edges",
        lambda e: (e["lower_inclusive"] <= F.col("_v"))
        & ((F.col("_v") < e["upper_value"]) | (e["upper_inclusive"] & (F.col("_v") <= e["upper_value"]))),
    )
    placed = df.withColumns({"_v": value, "_edges": edges}).filter(F.col(p).isNotNull())
    return placed.withColumn("bin", F.get(own, F.lit(0))["bin"]).filter("bin is not null").drop("_v", "_edges")


def join_on_entity(
    rows: DataFrame,
    entities: DataFrame,
    keys: list[str],
    weight: str,
    share: float = 1e-4,
    minimum_rows: int = 50_000,
) -> DataFrame:
    """Inner join of many rows to one row per entity, safe when one entity holds most rows.

    Entities above ``share`` of all rows, of which there are at most ``1 / share``, are broadcast, so
    their rows stay where they are. All others meet in a shuffle of groups no larger than the share.
    ``weight`` is each entity's row count. Below ``minimum_rows`` nothing is hot and
    the join is a plain one. ``entities`` is read several times: pass a written table.
    """
    total = entities.agg(F.sum(weight).alias("n")).scalar()
    least = F.greatest(total * F.lit(share), F.lit(float(minimum_rows)))
    hot = entities.filter(F.col(weight) > least)
    if hot.isEmpty():
        return rows.join(entities, keys)
    cold = entities.filter(F.col(weight) <= least)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)
