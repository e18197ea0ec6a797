import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cardweir.operators import drift as D
from cardweir.operators import metrics as M
from cardweir.operators import policy as P


def scored(spark, targets, probabilities):
    return spark.createDataFrame(list(zip(targets, probabilities)), "y int, p double")


@pytest.mark.parametrize("targets,p,fp,fn,threshold", [
    ([0, 0, 1, 1], [.1, .4, .6, .9], 1, 25, .6),
    ([0, 0, 1, 1], [.9, .9, .1, .1], 1, 1, 1.0),
    ([0, 1, 1], [.1, .5, .9], 1, 0, .5),
    ([0, 1, 1], [.6, .6, .6], 1, 1, .6),
])
def test_threshold_choice(spark, targets, p, fp, fn, threshold):
    best = M.select_threshold(M.threshold_curve(scored(spark, targets, p), fp, fn)).first()
    assert best.threshold == threshold


@pytest.mark.parametrize("seed", range(3))
def test_band_equals_exhaustive_search(spark, seed, uncoalesced):
    rng = random.Random(seed)
    rows = [(int(rng.random() < .3), rng.choice([.05, .1, .2, .35, .5, .7, .71, .9])) for _ in range(60)]
    costs = P.Costs(rng.choice([5, 25]), rng.choice([1, 10]), rng.choice([1, 3]))
    candidates = sorted({p for _, p in rows} | {0.0, 1.0, .6})
    best = None
    for lo in candidates:
        for hi in candidates:
            if lo > hi:
                continue
            fn = sum(y for y, p in rows if p < lo)
            fp = sum(1 - y for y, p in rows if p >= hi)
            tp = sum(y for y, p in rows if p >= hi)
            review = sum(lo <= p < hi for _, p in rows)
            key = (fn * costs.false_negative + fp * costs.false_positive + review * costs.review, fp, -tp, review, -hi, -lo)
            best = key if best is None or key < best else best
    df = spark.createDataFrame(rows, "y int, p double")
    got = P.select_band(df, costs, 512, (.6,)).first()
    assert (got.cost_units, got.false_positive, -got.true_positive, got.review_count, -got.upper_threshold, -got.lower_threshold) == best
    outcome = P.evaluate_band(df, got.lower_threshold, got.upper_threshold, costs).first()
    assert outcome.cost_units == got.cost_units and outcome.review_count == got.review_count


def test_rows_without_a_score_are_reviewed_in_every_count(spark, uncoalesced):
    rows = [(i % 7 == 0, None if i % 11 == 0 else (i * 37 % 100) / 100) for i in range(900)]
    df = spark.createDataFrame([(int(y), p) for y, p in rows], "y int, p double")
    for lower, upper in ((0.2, 0.7), (0.5, 0.5)):
        out = P.evaluate_band(df, lower, upper).first()
        routed = {r.r: r["count"] for r in df.groupBy(P.band_route("p", lower, upper).alias("r")).count().collect()}
        assert (out.allow_count, out.review_count, out.deny_count) == tuple(routed.get(k, 0) for k in ("allow", "review", "deny"))
        assert out.allow_count + out.review_count + out.deny_count == out.row_count == 900
    best = P.select_band(df).first()
    outcome = P.evaluate_band(df, best.lower_threshold, best.upper_threshold).first()
    assert (best.cost_units, best.review_count, best.row_count, best.deny_count) == (outcome.cost_units, outcome.review_count, 900, outcome.deny_count)
    assert P.boundary_diagnostics(df, 0.5).first().distinct_probability_count == 100


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), float("-inf")])
def test_scores_that_are_no_numbers_are_refused(spark, odd):
    df = spark.createDataFrame([(0, .1), (1, odd)], "y int, p double")
    for run in (lambda: P.evaluate_band(df, .2, .8), lambda: P.select_band(df), lambda: P.sweep_candidates(df), lambda: P.boundary_diagnostics(df, .5),
                lambda: P.compare_policies(df, .2, .8, .5), lambda: M.threshold_metrics(df, .5), lambda: M.threshold_curve(df)):
        with pytest.raises(PySparkException, match="not a finite number"):
            run().collect()
    with pytest.raises(PySparkException, match="neither 0 nor 1"):
        P.evaluate_band(spark.createDataFrame([(2, .1)], "y int, p double"), .2, .8).collect()


def test_band_routes_and_middle_band(spark):
    p = [0.0, .19, .2, .5, .79, .8, 1.0]
    df = scored(spark, [0] * 7, p).withColumn("r", P.band_route("p", .2, .8))
    assert [r.r for r in df.orderBy("p").collect()] == ["allow"] * 2 + ["review"] * 3 + ["deny"] * 2
    mid = scored(spark, [0] * 40 + [1] + [0] * 19 + [1] * 10, [.01] * 40 + [.5] * 20 + [.99] * 10)
    best = P.select_band(mid, P.Costs(25, 10, 3)).first()
    assert best.review_count == 0


def test_ties_make_the_two_average_precisions_differ(spark):
    rows = [(1, .5, 1), (0, .5, 0), (0, .9, 2), (1, .2, 3)]
    df = spark.createDataFrame(rows, "y int, p double, i int")
    collapsed = M.ranking_metrics(df).first().average_precision
    stepwise = M.average_precision_stepwise(df, F.col("i")).first().average_precision
    assert math.isclose(collapsed, .5 * (1 / 3) + .5 * (2 / 4)) and math.isclose(stepwise, (1 / 3 + 2 / 4) / 2)
    none = M.average_precision_stepwise(df.filter("y = 0"), F.col("i")).first().average_precision
    assert none is None


def test_empty_denominators_are_null(spark):
    row = M.threshold_metrics(scored(spark, [0, 0], [.1, .2]), .9).first()
    assert row.precision is None and row.recall is None and row.f1_score is None and row.specificity == 1.0


@pytest.mark.parametrize("expected,actual,value", [
    ([5, 5], [6, 4], 0.040546510810816), ([5, 5], [7, 3], 0.169459572077441), ([5, 5], [8, 2], 0.415888308335967)])
def test_psi(spark, expected, actual, value):
    counts = spark.createDataFrame([(i, e, a) for i, (e, a) in enumerate(zip(expected, actual))], "bin long, bin_count long, observed_count long")
    assert math.isclose(D.psi(counts).first().psi, value, abs_tol=1e-12)
    bands = spark.createDataFrame([(.05,), (.1,), (.25,), (.26,)], "v double").select("v", D.psi_band("v").alias("b"))
    assert [r.b for r in bands.orderBy("v").collect()] == ["none", "moderate", "moderate", "significant"]


def test_drift_without_enough_rows_or_reference(spark, sf):
    from cardweir.sources import tables as T

    ledger = T.ledger(spark, sf).limit(100)
    report = D.drift_report(ledger, T.reference_bins(spark, sf), F.lit(T.START_MS).cast("long"), 24).collect()
    assert {r.status for r in report} == {"insufficient_data"} and all(r.psi is None and r.band is None for r in report)
    assert D.drift_report(ledger, None, F.lit(0), 24).first().status == "reference_unavailable"
