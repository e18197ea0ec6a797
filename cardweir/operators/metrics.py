"""Threshold, ranking, calibration, slice and campaign metrics of a scored table (y, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweir.operators.ordering import nearest_ranks, running_totals
from cardweir.operators.policy import counted, number_of, score_table, scored_rows
from cardweir.session import materialise
from cardweir.sources.tables import LEGITIMATE_SCENARIOS

# Fixed value: the float64 epsilon the log loss clips with.
LOG_LOSS_EPSILON = 2.220446049250313e-16


def confusion(df: DataFrame, y: str, flagged: str, by: tuple[str, ...] = ()) -> DataFrame:
    return counted(df).groupBy(*by).agg(
        number_of(f"{y} = 1 and {flagged}", "true_positive"),
        number_of(f"{y} = 0 and {flagged}", "false_positive"),
        number_of(f"{y} = 0 and not {flagged}", "true_negative"),
        number_of(f"{y} = 1 and not {flagged}", "false_negative"),
    )


def ratio(numerator: str, denominator: str) -> str:
    return f"try_divide(double({numerator}), double({denominator}))"


def metrics_from_counts(counts: DataFrame, false_positive_cost: int, false_negative_cost: int) -> DataFrame:
    """The derived measures of confusion counts and a threshold; null on a zero denominator."""
    base = counts.selectExpr(
        "*",
        "true_positive + false_negative as attack_count",
        "true_negative + false_positive as legitimate_count",
        "true_positive + false_positive as review_count",
        "true_positive + false_positive + true_negative + false_negative as row_count",
        f"false_positive * {false_positive_cost} + false_negative * {false_negative_cost} as cost_units",
        f"{ratio('true_positive', 'true_positive + false_positive')} as precision",
        f"{ratio('true_positive', 'true_positive + false_negative')} as recall",
    )
    return base.selectExpr(
        "*",
        "if(precision + recall > 0, 2 * precision * recall / (precision + recall), null) as f1_score",
        f"{ratio('cost_units * 10000', 'row_count')} as cost_per_10000_events",
        f"{ratio('false_positive * 10000', 'legitimate_count')} as false_positives_per_10000_legitimate",
        f"{ratio('false_positive', 'legitimate_count')} as false_positive_rate",
        f"{ratio('attack_count', 'row_count')} as prevalence",
        f"{ratio('review_count', 'row_count')} as review_rate",
        f"{ratio('true_negative', 'legitimate_count')} as specificity",
    )


def threshold_metrics(
    df: DataFrame, threshold: float, false_positive_cost: int = 1, false_negative_cost: int = 25,
    by: tuple[str, ...] = (),
) -> DataFrame:
    counts = confusion(scored_rows(df), "y", f"p >= {threshold!r}D", by)
    return metrics_from_counts(
        counts.withColumn("threshold", F.lit(float(threshold))), false_positive_cost, false_negative_cost
    )


def score_histogram(df: DataFrame) -> DataFrame:
    """(p, attacks, legitimate) per distinct probability: everything ranking metrics need."""
    return counted(scored_rows(df)).groupBy("p").agg(F.expr("sum(_n * y) as attacks"), F.expr("sum(_n * (1 - y)) as legitimate"))


def cumulative_scores(df: DataFrame, with_ends: bool = False) -> DataFrame:
    """Histogram plus the attacks and legitimate rows at or above each probability."""
    histogram = score_histogram(df)
    if with_ends:
        ends = df.sparkSession.range(2).selectExpr("double(id) as p", "0L as attacks", "0L as legitimate")
        histogram = (
            histogram.unionByName(ends)
            .groupBy("p")
            .agg(F.sum("attacks").alias("attacks"), F.sum("legitimate").alias("legitimate"))
        )
    return running_totals(histogram, [F.col("p").desc()], {"tp": "attacks", "fp": "legitimate"})


def threshold_curve(df: DataFrame, false_positive_cost: int = 1, false_negative_cost: int = 25) -> DataFrame:
    """Metrics at every distinct probability and at 0 and 1."""
    counts = cumulative_scores(df, with_ends=True).selectExpr(
        "p as threshold", "tp as true_positive", "fp as false_positive",
        "fp_total - fp as true_negative", "tp_total - tp as false_negative",
    )
    return metrics_from_counts(counts, false_positive_cost, false_negative_cost)


def select_threshold(curve: DataFrame) -> DataFrame:
    """Cheapest row; ties by fewest false positives, most true positives, precision, threshold."""
    return curve.orderBy(
        F.col("cost_units"),
        F.col("false_positive"),
        F.col("true_positive").desc(),
        F.coalesce("precision", F.lit(0.0)).desc(),
        F.col("threshold").desc(),
    ).limit(1)


def ranking_metrics(df: DataFrame) -> DataFrame:
    """Average precision, trapezoidal PR area and ROC area in one pass over the curve."""
    c = cumulative_scores(df)
    return c.selectExpr(
        "*",
        "try_divide(attacks, double(tp_total)) as d_recall",
        "try_divide(legitimate, double(fp_total)) as d_fpr",
        "tp / double(tp + fp) as precision",
        # Before the first point the precision-recall curve is anchored at precision 1.
        "if(tp + fp = attacks + legitimate, 1D,"
        " (tp - attacks) / double(tp + fp - attacks - legitimate)) as prev_precision",
        "try_divide(tp - attacks + tp, 2D * tp_total) as mean_recall",
    ).agg(
        F.expr("sum(d_recall * precision) as average_precision"),
        F.expr("sum(d_recall * (precision + prev_precision) / 2) as pr_auc_trapezoidal"),
        F.expr("sum(d_fpr * mean_recall) as roc_auc"),
    )


def average_precision_stepwise(df: DataFrame, *order) -> DataFrame:
    """Mean precision at each attack, going rank by rank with ties in row order."""
    ranked = running_totals(
        df, [F.col("p").desc(), *order], {"hits": "bigint(y)", "rank": "1L"}
    )
    return ranked.agg(
        F.expr("try_divide(sum(if(y = 1, hits / double(rank), 0D)), double(max(hits_total))) as average_precision")
    )


def calibration_losses(df: DataFrame) -> DataFrame:
    e = LOG_LOSS_EPSILON
    q = f"least(greatest(p, {e!r}D), 1 - {e!r}D)"
    return counted(df).filter("p is not null").selectExpr(
        "_n", "(p - y) * (p - y) as squared", f"-if(y = 1, ln({q}), ln(1 - {q})) as loss"
    ).agg(*[F.expr(f"try_divide(sum(_n * {c}), double(sum(_n))) as {name}") for c, name in (("squared", "brier_score"), ("loss", "log_loss"))])


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins, empty ones kept; the last is closed."""
    spark = df.sparkSession
    # Edges are index / bins as doubles; the nominal bin is corrected against them.
    nominal = f"least(bigint(floor(p * {bins})), {bins - 1})"
    placed = counted(df).selectExpr("y", "p", "_n", f"{nominal} as b").selectExpr(
        "y", "p", "_n",
        f"case when p < b / {float(bins)}D then b - 1"
        f" when b < {bins - 1} and p >= (b + 1) / {float(bins)}D then b + 1 else b end as bin",
    )
    filled = placed.groupBy("bin").agg(
        F.sum("_n").alias("n"),
        F.expr("sum(_n * p) / double(sum(_n)) as mean_probability"), F.expr("sum(_n * y) / double(sum(_n)) as attack_rate"),
    )
    edges = spark.range(bins).selectExpr(
        "id as bin", f"id / {float(bins)}D as lower_inclusive", f"(id + 1) / {float(bins)}D as upper_value",
        f"id = {bins - 1} as upper_inclusive",
    )
    # At most ``bins`` rows on either side.
    return edges.join(F.broadcast(filled), "bin", "left").selectExpr(
        "bin", "lower_inclusive", "upper_value", "upper_inclusive",
        "coalesce(n, 0L) as bin_count", "mean_probability", "attack_rate",
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(
        F.expr(
            "try_divide(sum(bin_count * abs(mean_probability - attack_rate)), sum(bin_count))"
            " as expected_calibration_error"
        )
    )


def hard_negative_slices(df: DataFrame, threshold: float) -> DataFrame:
    """False positives per legitimate scenario; a scenario without rows keeps its line."""
    found = (
        counted(df).filter("y = 0")
        .groupBy("scenario_type")
        .agg(F.sum("_n").alias("n"), number_of(f"p >= {threshold!r}D", "flagged"))
    )
    names = df.sparkSession.createDataFrame([(s,) for s in LEGITIMATE_SCENARIOS], "scenario_type string")
    return names.join(found, "scenario_type", "left").selectExpr(
        "scenario_type",
        "coalesce(n, 0L) as row_count",
        "coalesce(flagged, 0L) as false_positive_count",
        "coalesce(flagged, 0L) as false_positive_cost_units",
        "try_divide(double(flagged), double(n)) as false_positive_rate",
        "try_divide(double(flagged * 10000), double(n)) as false_positives_per_10000",
    )


def campaigns(df: DataFrame, threshold: float) -> DataFrame:
    """Per campaign: attacks, flagged attacks and the times of the first of each."""
    return (
        df.filter("y = 1 and campaign_id is not null")
        .groupBy("campaign_id")
        .agg(
            F.count(F.lit(1)).alias("attacks"),
            F.expr(f"count_if(p >= {threshold!r}D) as flagged"),
            F.min("occurred_at_ms").alias("first_attack_ms"),
            F.expr(f"min(if(p >= {threshold!r}D, occurred_at_ms, null)) as first_flagged_ms"),
        )
    )


def campaign_metrics(df: DataFrame, threshold: float) -> DataFrame:
    c = materialise(campaigns(df, threshold), "campaigns")
    summary = c.agg(
        F.count(F.lit(1)).alias("campaign_count"),
        F.count("first_flagged_ms").alias("detected_campaign_count"),
        F.expr("try_divide(double(sum(flagged)), double(count(1))) as flagged_mean"),
    )
    delays = (
        c.filter("first_flagged_ms is not null")
        .selectExpr("first_flagged_ms - first_attack_ms as v")
        .groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    )
    flags = c.groupBy(F.col("flagged").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    both = delays.selectExpr("'delay' as what", "v", "w").unionByName(
        flags.selectExpr("'flagged' as what", "v", "w")
    )
    ranks = nearest_ranks(both, "v", "w", {"median": 50, "p95": 95}, ("what",))
    wide = ranks.groupBy().agg(*[
        F.expr(f"max(if(what = '{what}', {source}, null)) as {name}_{label}")
        for what, name in (("delay", "delay_ms"), ("flagged", "flagged"))
        for source, label in (("min", "minimum"), ("median", "median"), ("p95", "p95"), ("max", "maximum"))
    ])
    # One row each: the join is a scalar attachment, not a product.
    return (
        summary.withColumn("one", F.lit(1))
        .join(F.broadcast(wide.withColumn("one", F.lit(1))), "one")
        .drop("one")
        .selectExpr(
            "*",
            "try_divide(double(detected_campaign_count), double(campaign_count)) as campaign_recall",
            "campaign_count - detected_campaign_count as missed_campaign_count",
        )
    )


def flagged_histogram(df: DataFrame, threshold: float) -> DataFrame:
    return campaigns(df, threshold).groupBy("flagged").agg(F.count(F.lit(1)).alias("campaigns"))


def evaluation_report(df: DataFrame, threshold: float) -> DataFrame:
    """One row: threshold metrics, ranking, losses, calibration error, campaign measures; reliability bins and hard-negative
    slices as arrays.

    The scored rows are read twice: for their score table, from which everything but campaigns follows, and for the
    campaigns, whose times no count of scores holds.
    """
    table = score_table(df, "scenario_type")
    bins = materialise(reliability(table), "bins")
    slices = hard_negative_slices(table, threshold)
    parts = [
        threshold_metrics(table, threshold),
        ranking_metrics(table),
        calibration_losses(table),
        expected_calibration_error(bins),
        campaign_metrics(df, threshold),
        # a row per bin and per scenario
        bins.agg(F.array_sort(F.collect_list(F.struct(*bins.columns))).alias("reliability")),
        slices.agg(F.array_sort(F.collect_list(F.struct(*slices.columns))).alias("hard_negative_slices")),
    ]
    out = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        out = out.join(F.broadcast(part.withColumn("one", F.lit(1))), "one")
    return out.drop("one")


def nearest_rank(df: DataFrame, column: str, percent: int) -> DataFrame:
    histogram = df.groupBy(column).agg(F.count(F.lit(1)).alias("w"))
    return nearest_ranks(histogram, column, "w", {"value": percent}).select("value")


def feature_distributions(features: DataFrame, names: list[str]) -> DataFrame:
    """min, max, p50, p95, p99 and zero count of each feature, exactly.

    Values are counted per (feature, value) before anything is ordered, so the unpivot's rows are
    combined map-side. The counts are written once: ranks and zeros both read them, and the features behind them are not computed again.
    """
    histogram = materialise(
        features.select(*names)
        .unpivot([], names, "feature", "value")
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("w")),
        "feature-values",
    )
    ranks = nearest_ranks(histogram, "value", "w", {"p50": 50, "p95": 95, "p99": 99}, ("feature",))
    zeros = histogram.filter("value = 0").selectExpr("feature", "w as zeros")
    return ranks.join(zeros, "feature", "left").selectExpr(
        "feature", "min", "max", "p50", "p95", "p99", "coalesce(zeros, 0L) as zero_count"
    )


def balanced_weights(df: DataFrame) -> DataFrame:
    """(y, weight): n / (2 * n_class)."""
    counts = df.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select("y", "n", (total.cast("double") / (F.col("n") * 2)).alias("weight"))


def partition_summary(df: DataFrame) -> DataFrame:
    """Rows, attacks and legitimate rows per split and in total (split 'all')."""
    return df.rollup("split").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("y").alias("attack_count")
    ).selectExpr(
        "coalesce(split, 'all') as split", "row_count", "attack_count",
        "row_count - attack_count as legitimate_count",
    )
