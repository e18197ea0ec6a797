"""Decisions, two-threshold bands and the choice of thresholds by cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweir.functions.scalars import bp_half_up, rate
from cardweir.operators.ordering import ahead, every, in_slices, systematic_sample
from cardweir.session import materialise


@dataclass(frozen=True)
class Costs:
    false_negative: int = 25
    false_positive: int = 1
    review: int = 3


@dataclass(frozen=True)
class Gates:
    maximum_false_positive_rate_bp: int = 100
    minimum_rows: int = 2000
    minimum_attacks: int = 100


def classify(p: str | Column, threshold: float) -> Column:
    """deny at or above the threshold, else allow; compares the full doubles. No score, no decision."""
    column = F.col(p) if isinstance(p, str) else p
    return F.when(column.isNull() | F.isnan(column), None).when(column >= F.lit(float(threshold)), "deny").otherwise("allow")


def band_route(p: str, lower: float, upper: float) -> Column:
    """allow below the band, deny above it; what lies between or has no score is reviewed."""
    return (
        F.when(F.col(p).isNull() | F.isnan(p), "review")
        .when(F.col(p) >= F.lit(float(upper)), "deny")
        .when(F.col(p) >= F.lit(float(lower)), "review")
        .otherwise("allow")
    )


def fail_safe_action(risk_decision: str, reason: str) -> Column:
    """Any failure reason sends the case to review; the risk decision itself is untouched."""
    return F.when(F.col(reason).isNotNull(), "review").otherwise(F.col(risk_decision))


def counted(df: DataFrame) -> DataFrame:
    """Rows with ``_n``, how many scored rows each stands for: itself, unless it comes from a ``score_table``."""
    return df if "_n" in df.columns else df.withColumn("_n", F.lit(1).cast("long"))


def number_of(condition: str, name: str) -> Column:
    return F.expr(f"coalesce(sum(if({condition}, _n, 0L)), 0L) as {name}")


def score_table(df: DataFrame, *keep: str) -> DataFrame:
    """Scored rows by (p, y) and the columns to keep, with their number ``_n``, written once.

    What takes scored rows takes this table as well. Tables of parts add up: their union is a table of the whole.
    """
    return materialise(counted(scored_rows(df)).groupBy("p", "y", *keep).agg(F.sum("_n").alias("_n")), "score-table")


#: Comparing would count such a score as the highest of all.
_UNSOUND = "isnan(p) or abs(p) = double('infinity')"


def scored_rows(df: DataFrame) -> DataFrame:
    """The rows a policy may be judged on: a score that is no finite number, or a target other than 0 and 1, is an error.

    Rows without a score stay: the band sends them to review, and there they count.
    """
    return df.filter(f"if({_UNSOUND}, raise_error('a score is not a finite number'), true) and if(y in (0, 1), true, raise_error('a target is neither 0 nor 1'))")


def finite_scores(df: DataFrame) -> DataFrame:
    """Rows with a score, which must be a finite number."""
    return df.filter(f"if({_UNSOUND}, raise_error('a score is not a finite number'), p is not null)")


def evaluate_band(df: DataFrame, lower: float, upper: float, costs: Costs = Costs()) -> DataFrame:
    """Confusion counts and cost; a reviewed row is neither a false positive nor a false negative.

    Counts follow ``band_route``, row by row: what has no score is reviewed. Scores that are no finite numbers are refused.
    """
    routed = counted(scored_rows(df)).select("y", "_n", band_route("p", lower, upper).alias("r"))
    counts = routed.agg(
        number_of("r = 'allow'", "allow_count"),
        number_of("r = 'review'", "review_count"),
        number_of("r = 'deny'", "deny_count"),
        number_of("r = 'deny' and y = 1", "true_positive"),
        number_of("r = 'deny' and y = 0", "false_positive"),
        number_of("r = 'allow' and y = 0", "true_negative"),
        number_of("r = 'allow' and y = 1", "false_negative"),
        number_of("true", "row_count"),
        number_of("y = 1", "attack_count"),
        number_of("y = 0", "legitimate_count"),
    )
    return counts.withColumn(
        "cost_units",
        F.expr(
            f"false_negative * {costs.false_negative} + false_positive * {costs.false_positive}"
            f" + review_count * {costs.review}"
        ),
    )


def evaluate_single_threshold(df: DataFrame, threshold: float, costs: Costs = Costs()) -> DataFrame:
    return evaluate_band(df, threshold, threshold, costs)


def band_report(outcome: DataFrame) -> DataFrame:
    return outcome.withColumns({
        "false_positive_rate": rate("false_positive", "legitimate_count"),
        "false_positive_rate_basis_points": bp_half_up("false_positive", "legitimate_count"),
        "false_positives_per_10000_legitimate": rate(
            F.col("false_positive") * 10_000, "legitimate_count"
        ),
        "review_rate": rate("review_count", "row_count"),
    })


def _values(spark, values: tuple[float, ...]) -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], "p double")


def sweep_candidates(df: DataFrame, grid_size: int | None = None, required: tuple[float, ...] = ()) -> DataFrame:
    """Distinct observed probabilities with 0 and 1, plus the required; a grid thins them evenly.

    Rows without a score add none; a score that is no finite number is an error.
    """
    if grid_size is not None and grid_size < 2:
        raise ValueError("a grid needs at least two points")
    spark = df.sparkSession
    observed = finite_scores(df).select("p").union(_values(spark, (0.0, 1.0))).distinct()
    thinned = observed if grid_size is None else systematic_sample(observed, grid_size, F.col("p"))
    if required:
        thinned = thinned.union(_values(spark, required))
    return thinned.distinct()


def select_band(
    df: DataFrame, costs: Costs = Costs(), grid_size: int | None = None, required: tuple[float, ...] = ()
) -> DataFrame:
    """The cheapest (lower <= upper) pair of candidates with its counts, one row.

    The cost of a pair splits into a part of the lower and a part of the upper threshold:
    ``fn(lower) * c_fn - below(lower) * c_r`` plus ``fp(upper) * c_fp + below(upper) * c_r``. So the
    best lower partner of every upper threshold is a running minimum along the candidates, and the
    grid of pairs is never built. Counts and minimum are one scan over slices: rows before a slice move the lower
    parts of its candidates by one amount, so its best stays its best and only that one is carried on.
    Rows without a score are reviewed under every pair and add the same cost to each.
    Ties: cost, false positives, true positives, reviews, upper, lower.
    """
    scored = scored_rows(df)
    candidates = sweep_candidates(scored, grid_size, required).selectExpr(
        "p", "0L as n", "0L as attacks", "1 as candidate"
    )
    histogram = (
        counted(scored).groupBy("p")
        .agg(F.sum("_n").alias("n"), F.expr("sum(_n * y) as attacks"))
        .withColumn("candidate", F.lit(0))
        .unionByName(candidates)
        .groupBy("p")
        .agg(F.sum("n").alias("n"), F.sum("attacks").alias("attacks"), F.max("candidate").alias("candidate"))
    )
    lower_part = f"attacks_below * {costs.false_negative} - below * {costs.review}"
    lowest = f"if(candidate = 1, named_struct('lower_part', {lower_part}, 'neg_below', -below, 'neg_p', -p, 'attacks_below', attacks_below), null)"
    sliced = in_slices(
        histogram.filter("p is not null"), F.col("p"),
        local=lambda w: [
            {"below": F.sum("n").over(w) - F.col("n"), "attacks_below": F.sum("attacks").over(w) - F.col("attacks")},
            {"low": F.min(F.expr(lowest)).over(w)},
        ],
    )

    def moved(low: str) -> Column:
        """A slice's best candidate with what stands before the slice counted in."""
        return F.expr(
            f"if({low} is null, null, named_struct('lower_part', {low}.lower_part + before_attacks * {costs.false_negative} - before_rows * {costs.review},"
            f" 'neg_below', {low}.neg_below - before_rows, 'neg_p', {low}.neg_p, 'attacks_below', {low}.attacks_below + before_attacks))"
        )

    per_slice = sliced.groupBy("_slice").agg(F.sum("n").alias("rows"), F.sum("attacks").alias("hits"), F.min("low").alias("best"))
    carried = (
        per_slice.withColumns({
            "before_rows": F.coalesce(F.sum("rows").over(ahead()), F.lit(0)), "before_attacks": F.coalesce(F.sum("hits").over(ahead()), F.lit(0)),
            "row_count": F.sum("rows").over(every()), "attack_count": F.sum("hits").over(every()),
        })
        .withColumn("before", F.min(moved("best")).over(ahead()))
        .drop("rows", "hits", "best")
    )
    unscored = histogram.filter("p is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    best = (
        sliced.filter("candidate = 1").join(F.broadcast(carried), "_slice")
        .withColumns({"below": F.expr("below + before_rows"), "attacks_below": F.expr("attacks_below + before_attacks"), "low": F.least(moved("low"), F.col("before"))})
        .withColumns({"true_positive": F.expr("attack_count - attacks_below"), "false_positive": F.expr("row_count - below - attack_count + attacks_below"), "unscored": unscored})
    )
    return (
        best.selectExpr(
            "-low.neg_p as lower_threshold",
            "p as upper_threshold",
            f"low.lower_part + false_positive * {costs.false_positive} + (below + unscored) * {costs.review} as cost_units",
            "false_positive",
            "true_positive",
            "low.attacks_below as false_negative",
            "below + low.neg_below + unscored as review_count",
            "-low.neg_below as allow_count",
            "row_count - below as deny_count",
            "row_count + unscored as row_count",
        )
        .orderBy(
            "cost_units", "false_positive", F.col("true_positive").desc(), "review_count",
            F.col("upper_threshold").desc(), F.col("lower_threshold").desc(),
        )
        .limit(1)
        # -0.0 and 0.0 are the same threshold.
        .withColumn("lower_threshold", F.col("lower_threshold") + F.lit(0.0))
    )


def boundary_diagnostics(df: DataFrame, threshold: float) -> DataFrame:
    """How close the observed scores come to a threshold from below, and how many rows tie there.

    Rows without a score tie nowhere; a score that is no finite number is an error.
    """
    t = f"{float(threshold)!r}D"
    histogram = counted(finite_scores(df)).groupBy("p").agg(F.sum("_n").alias("n"), F.expr("sum(_n * y) as attacks"))
    return histogram.agg(
        F.count(F.lit(1)).alias("distinct_probability_count"),
        F.expr(f"max(if(p < {t}, p, null)) as nearest_below"),
        F.expr(f"coalesce(bool_or(p = {t}), false) as threshold_is_observed"),
        F.expr(f"max_by(if(p < {t}, n, null), if(p < {t}, p, null)) as _tied"),
        F.expr(f"max_by(if(p < {t}, attacks, null), if(p < {t}, p, null)) as _attacks"),
    ).selectExpr(
        "distinct_probability_count", "nearest_below", "threshold_is_observed",
        "coalesce(_tied, 0L) as tied_rows", "coalesce(_attacks, 0L) as tied_attacks",
    )


def decision_boundary(df: DataFrame, threshold: float) -> DataFrame:
    return boundary_diagnostics(df, threshold).selectExpr(
        f"{float(threshold)!r}D as decision_threshold", "*",
        "tied_rows - tied_attacks as tied_legitimate",
    )


# Names of the gates a banded policy can fail.
GATE_COST = "banded_policy_does_not_beat_incumbent_cost"
GATE_CEILING = "banded_policy_exceeds_false_positive_rate_ceiling"
GATE_EVIDENCE = "validation_batch_below_minimum_evidence"


def evaluate_gates(incumbent: DataFrame, banded: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """One row saying whether the banded policy may be approved and which gates it fails."""
    i = incumbent.select(F.col("cost_units").alias("incumbent_cost_units"), F.lit(1).alias("one"))
    b = banded.withColumn("one", F.lit(1))
    joined = b.join(F.broadcast(i), "one").withColumn(
        "observed_bp", bp_half_up("false_positive", "legitimate_count")
    )
    beats = F.col("cost_units") < F.col("incumbent_cost_units")
    within = F.coalesce(F.col("observed_bp") <= gates.maximum_false_positive_rate_bp, F.lit(False))
    enough = (F.col("row_count") >= gates.minimum_rows) & (
        F.col("attack_count") >= gates.minimum_attacks
    )
    failed = F.array_compact(F.array(
        F.when(~beats, GATE_COST), F.when(~within, GATE_CEILING), F.when(~enough, GATE_EVIDENCE)
    ))
    return joined.select(
        (F.size(failed) == 0).alias("approval_eligible"),
        beats.alias("beats_incumbent_cost"),
        (F.col("cost_units") - F.col("incumbent_cost_units")).alias("cost_delta_units"),
        F.array_join(failed, ",").alias("failed_gates"),
        F.col("observed_bp").alias("false_positive_rate_basis_points"),
        within.alias("false_positive_rate_within_ceiling"),
        enough.alias("validation_batch_sufficient"),
    )


def compare_policies(
    df: DataFrame, lower: float, upper: float, threshold: float,
    costs: Costs = Costs(), gates: Gates = Gates(),
) -> DataFrame:
    """Incumbent and banded outcome on the same rows, with gates and boundary context, one row.

    The rows are read once: all that follows comes from their score table.
    """
    df = score_table(df)
    incumbent = evaluate_single_threshold(df, threshold, costs)
    banded = evaluate_band(df, lower, upper, costs)
    parts = {
        "incumbent": band_report(incumbent).select(
            "cost_units", "true_positive", "false_positive", "false_negative", "review_count"
        ),
        "banded": band_report(banded).select(
            "cost_units", "true_positive", "false_positive", "false_negative", "review_count"
        ),
        "lower_boundary": boundary_diagnostics(df, lower).select("nearest_below", "tied_rows"),
        "upper_boundary": boundary_diagnostics(df, upper).select("nearest_below", "tied_rows"),
        "incumbent_boundary": boundary_diagnostics(df, threshold).select("nearest_below", "tied_rows"),
    }
    out = evaluate_gates(incumbent, banded, gates).withColumn("one", F.lit(1))
    for prefix, part in parts.items():
        renamed = part.select(*[F.col(c).alias(f"{prefix}_{c}") for c in part.columns], F.lit(1).alias("one"))
        out = out.join(F.broadcast(renamed), "one")
    return out.drop("one").withColumn("has_review_tier", F.lit(upper > lower))


def candidate_ranking(reports: DataFrame) -> DataFrame:
    """Best candidate model by cost, then the threshold ladder, then name."""
    return reports.orderBy(
        "cost_units", "false_positive", F.col("true_positive").desc(),
        F.coalesce("precision", F.lit(0.0)).desc(), F.col("threshold").desc(), "name",
    ).limit(1)
