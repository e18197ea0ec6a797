"""Totals, ranks and neighbours along one global order, without a single-task window.

Rows are range-partitioned on the order, so even one huge group is cut into even slices. The slice
number and what a row gathers within its slice are written out once, so every later step sees the same cut. What
precedes a slice is carried over from one row per slice (as many rows as shuffle partitions). That holds for any
associative operation, not just sums: a carry is whatever the operation leaves of all slices before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardweir.session import materialise


def ahead() -> WindowSpec:
    """The slices before one slice; like ``every``, over one row per slice."""
    return W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)


def every() -> WindowSpec:
    return W.partitionBy(F.lit(0))


def in_slices(df: DataFrame, *order: Column, local: Callable[[WindowSpec], list[dict[str, Column]]] | None = None) -> DataFrame:
    """``df`` with ``_slice``: slices ascend along ``order`` and never overlap.

    ``local`` gives columns, step by step, over the window of a row and those before it in its slice; they are written along.
    """
    sliced = df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
    for columns in local(W.partitionBy("_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) if local else []:
        sliced = sliced.withColumns(columns)
    return materialise(sliced, "ordered")


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add, per name, the total of its expression over this row and all before it.

    ``order`` must be total. The grand total of each is added as ``<name>_total``.
    """
    sliced = in_slices(
        df, *order, local=lambda w: [{f"_v_{n}": F.expr(e) for n, e in sums.items()}, {f"_l_{n}": F.sum(f"_v_{n}").over(w) for n in sums}]
    )
    per_slice = sliced.groupBy("_slice").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    offsets = per_slice.select(
        "_slice",
        *[F.coalesce(F.sum(f"_s_{n}").over(ahead()), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(every()).alias(f"{n}_total") for n in sums],
    )
    # One row per slice: bounded by the number of shuffle partitions.
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums})
        .drop("_slice", *[f"{p}{n}" for p in ("_v_", "_l_", "_o_") for n in sums])
    )


def row_numbers(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """1-based position along a total order, and the row count as ``<name>_total``."""
    return running_totals(df, list(order), {name: "1L"})


def previous_values(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Add ``prev_<column>`` from the row just before along a total order."""
    sliced = in_slices(df, *order)
    local = W.partitionBy("_slice").orderBy(*order)
    marked = sliced.withColumns({
        "_first": F.row_number().over(local) == 1,
        "_prev": F.lag(F.struct(*columns)).over(local),
        "_next": F.lead(F.lit(1)).over(local),
    })
    tails = marked.filter(F.col("_next").isNull()).select(
        "_slice", F.struct(*columns).alias("_tail")
    )
    carried = tails.select(
        F.col("_slice"), F.lag("_tail").over(W.orderBy("_slice")).alias("_before")
    )
    joined = marked.join(F.broadcast(carried), "_slice", "left").withColumn(
        "_p", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev"))
    )
    return joined.select(
        *df.columns, *[F.col(f"_p.{c}").alias(f"prev_{c}") for c in columns]
    )


def nearest_ranks(
    counts: DataFrame, value: str, weight: str, percents: dict[str, int], by: tuple[str, ...] = ()
) -> DataFrame:
    """Exact nearest-rank percentiles per group from a (group, value, weight) histogram.

    ``by`` names a fixed set of groups (features, token kinds): one row each, which is broadcast. The
    rank of ``p`` percent of ``n`` is ``max(1, (p * n + 99) div 100)``. Distinct values are
    ordered globally by (group, value), so neither a group nor the histogram is held in one task.
    """
    order = [F.col(c) for c in (*by, value)]
    running = running_totals(counts.select(*by, value, weight), order, {"cum": weight})
    if by:
        start = running.groupBy(*by).agg(
            F.min(F.col("cum") - F.col(weight)).alias("_start"), F.sum(weight).alias("_n")
        )
        running = running.join(F.broadcast(start), list(by))
    else:
        running = running.withColumns({"_start": F.lit(0), "_n": F.col("cum_total")})
    picks = [
        F.expr(
            f"min(if(cum - _start >= greatest(1, ({p} * _n + 99) div 100), {value}, null)) as {name}"
        )
        for name, p in percents.items()
    ]
    extra = [
        F.max("_n").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"),
    ]
    return running.groupBy(*by).agg(*extra, *picks)


def integer_distribution(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """count, min, max, p50 and p95 of an integer column."""
    histogram = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("w"))
    return nearest_ranks(histogram, value, "w", {"p50": 50, "p95": 95}, by)


def systematic_sample(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """``k`` rows at evenly spaced positions ``(i * (n - 1)) div (k - 1)``; all rows if fewer."""
    numbered = row_numbers(df, *order)
    # Position q is taken iff some i has i*(n-1) div (k-1) = q, found without listing the i's.
    return numbered.filter(
        f"rn_total <= {k} or"
        f" ((rn - 1) * {k - 1} + rn_total - 2) div (rn_total - 1) * (rn_total - 1) div {k - 1}"
        " = rn - 1"
    ).drop("rn", "rn_total")


def chronological(df: DataFrame) -> DataFrame:
    return df.orderBy("occurred_at_ms", "event_id")


def first_events(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` events in order (a limit that is the feature: TakeOrdered, no full sort)."""
    return chronological(df).limit(n)


def strict_times(df: DataFrame, now_ms: str, *order: Column, after_ms: int | None = None) -> DataFrame:
    """``t_i = max(now_i, t_(i-1) + 1)`` along the order, as ``assigned_at_ms``; the first comes after ``after_ms`` if that is given.

    A slice of n rows maps the last time t before it to ``max(t + n, m + n)``, where m is the largest of its times less
    the row's place in it. Such maps compose, so slices are cut once and a carry per slice does the rest.
    """
    sliced = in_slices(
        df, *order, local=lambda w: [{"_i": F.row_number().over(w).cast("long")}, {"_m": F.max(F.col(now_ms) - F.col("_i")).over(w)}]
    )
    # over all rows before a slice, with places counted from the very first row: the largest of time less place
    per_slice = sliced.groupBy("_slice").agg(F.max("_i").alias("_n"), F.max("_m").alias("_best"))
    placed = per_slice.withColumn("_rows", F.coalesce(F.sum("_n").over(ahead()), F.lit(0)))
    offsets = placed.select("_slice", (F.greatest(F.max(F.col("_best") - F.col("_rows")).over(ahead()), F.lit(after_ms).cast("long")) + F.col("_rows")).alias("_before"))
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumn("assigned_at_ms", F.greatest("_m", "_before") + F.col("_i"))
        .drop("_slice", "_i", "_m", "_before")
    )


def order_violations(df: DataFrame, sequence: str) -> DataFrame:
    """Rows whose (time, id) does not exceed that of the row before them in ``sequence``."""
    seen = previous_values(
        df.select(sequence, "occurred_at_ms", "event_id"),
        [F.col(sequence)],
        ["occurred_at_ms", "event_id"],
    )
    return seen.filter(
        "prev_event_id is not null and (occurred_at_ms < prev_occurred_at_ms or"
        " (occurred_at_ms = prev_occurred_at_ms and event_id <= prev_event_id))"
    ).select("event_id")
