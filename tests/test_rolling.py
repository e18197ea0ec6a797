import pytest
from fixtures import brute_force, frame, random_rows, row, tok
from pyspark.sql import functions as F

from cardweir.operators.features import FEATURE_NAMES, feature_vector, feature_violations
from cardweir.operators.joins import prior_counts, prior_events
from cardweir.operators.rolling import Slicing

# Every entity is hot and slices are short: windows and runs cross many slices.
FORCED = Slicing(share=0.0, minimum_rows=0, sample_modulus=1, slice_ms=1_000)
# Few slices to a block, so that carries come from blocks as well.
BLOCKS = Slicing(share=0.0, minimum_rows=0, sample_modulus=1, slice_ms=7_000, fan=3)
HOT_ONLY = Slicing(share=0.2, minimum_rows=0, sample_modulus=1, slice_ms=60_000)


def vectors(df, slicing):
    return {r.event_id: r.asDict() for r in feature_vector(df, slicing).collect()}


def test_names():
    assert len(FEATURE_NAMES) == 75 and list(FEATURE_NAMES) == sorted(FEATURE_NAMES)


@pytest.mark.parametrize("slicing", [None, FORCED, HOT_ONLY, BLOCKS], ids=["plain", "all-sliced", "hot-sliced", "blocks"])
def test_equals_brute_force(spark, slicing):
    rows = random_rows()
    want = brute_force(rows)
    got = vectors(frame(spark, rows), slicing)
    assert set(got) == set(want)
    for event, values in want.items():
        assert {k: got[event][k] for k in values} == values


def test_seven_events(spark):
    s = 1000
    rows = [
        row(1, 0), row(2, 30 * s, "failed"), row(3, 60 * s, checkout=2), row(4, 60 * s, checkout=3, device=2, instrument=2, session=2),
        row(5, 90 * s, "failed", checkout=3, device=None, network=None, instrument=2, session=2), row(6, 300 * s, checkout=4), row(7, 3600 * s, checkout=5),
    ]
    v = vectors(frame(spark, rows), Slicing())
    at = lambda n: v[tok("evt", n)]
    assert at(2)["checkout_previous_attempt_age_ms"] == 30_000
    assert (at(3)["merchant_prior_attempt_count_60s"], at(3)["merchant_prior_attempt_count_300s"]) == (1, 2)
    assert at(3)["merchant_prior_failure_rate_300s_bp"] == 5000
    assert (at(4)["merchant_prior_attempt_count_60s"], at(4)["merchant_prior_failure_rate_300s_bp"]) == (2, 3333)
    assert at(5)["device_prior_attempt_count_3600s"] == 0 and at(5)["network_prior_attempt_count_3600s"] == 0
    assert at(5)["merchant_distinct_instruments_60s"] == 2
    assert at(6)["merchant_prior_attempt_count_300s"] == 4 and at(6)["network_distinct_sessions_300s"] == 2
    assert at(6)["network_prior_failure_rate_300s_bp"] == 3333
    assert at(7)["merchant_prior_attempt_count_300s"] == 0 and at(7)["merchant_prior_attempt_count_3600s"] == 5


def test_one_token_on_all_rows_over_many_days(spark):
    import random

    rng = random.Random(4)
    day = 86_400_000
    rows = [row(n, rng.randrange(12) * day + rng.randrange(0, 900_000), rng.choice(["failed", "authorized"]), checkout=rng.randrange(4)) for n in range(180)]
    want = brute_force(rows)
    got = vectors(frame(spark, rows), Slicing(share=0.5, minimum_rows=0, sample_modulus=1, slice_ms=60_000, fan=16))
    for event, values in want.items():
        assert {k: got[event][k] for k in values} == values


def test_window_edges(spark):
    rows = [row(n, t * 1000, device=None) for n, t in ((1, 0), (2, 0), (3, 60), (4, 300), (5, 3600))]
    v = vectors(frame(spark, rows), FORCED)
    counts = lambda w: [v[tok("evt", n)][f"merchant_prior_attempt_count_{w}s"] for n in range(1, 6)]
    assert counts(60)[:3] == [0, 1, 0]
    assert counts(300)[2:4] == [2, 1]
    assert counts(3600)[3:] == [3, 2]
    assert all(v[e][k] == 0 for e in v for k in v[e] if k.startswith(("device_prior", "device_distinct")))


def test_sound_vectors_have_no_violations(spark):
    assert feature_violations(feature_vector(frame(spark, random_rows(200, 3)))).isEmpty()


def test_interval_join_agrees(spark):
    rows = random_rows(200, 5)
    want = brute_force(rows)
    counts = {
        r.event_id: r["count"]
        for r in prior_events(frame(spark, rows), "merchant_id", 300).groupBy("event_id").count().collect()
    }
    assert {e: counts.get(e, 0) for e in want} == {e: v["merchant_prior_attempt_count_300s"] for e, v in want.items()}


def test_prior_counts_equal_the_pairs(spark, uncoalesced):
    rows = random_rows(250, 6)
    df = frame(spark, rows).repartition(6)
    for key in ("merchant_id", "device_token"):
        pairs = prior_events(df, key, 300).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t") - F.col("prior_t")).alias("gap")).collect()
        want = {r.event_id: (r.n, r.gap) for r in pairs}
        got = {r.event_id: (r.prior_count, r.prior_gap_ms) for r in prior_counts(df, key, 300).collect()}
        assert {e: v for e, v in got.items() if v[0]} == want and all(v == (0, 0) for e, v in got.items() if e not in want)


def test_plan_has_no_cartesian_product(spark):
    plan = feature_vector(frame(spark, random_rows(50, 1)))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("slicing", [None, BLOCKS], ids=["plain", "blocks"])
def test_partitions_follow_the_rows(spark, monkeypatch, slicing):
    from cardweir.operators import rolling

    monkeypatch.setattr(rolling, "ROWS_PER_TASK", 100)
    rows = random_rows()
    df = frame(spark, rows)
    assert rolling._partitions(df, 1_000, 20) == 200
    want, got = brute_force(rows), vectors(df, slicing)
    assert set(got) == set(want) and all(got[e][k] == v for e, values in want.items() for k, v in values.items())


@pytest.mark.parametrize("slicing", [None, FORCED], ids=["plain", "all-sliced"])
def test_attempts_are_dealt_before_they_become_several_rows(spark, monkeypatch, slicing):
    """One split of a file is more than one task, also without distinct counts, and groups of entities get finer partitions than rows need."""
    from cardweir.operators import rolling

    monkeypatch.setattr(rolling, "ROWS_PER_TASK", 100)
    rows = random_rows()
    df = frame(spark, rows).coalesce(1)
    assert [rolling._dealt(df, n, 10, "event_id").rdd.getNumPartitions() for n in (10, 1_000, 10_000, 100_000)] == [1, 100, 200, 1250]
    asked = []
    partitions = rolling._partitions
    monkeypatch.setattr(rolling, "_partitions", lambda df, attempts, each: asked.append(each) or partitions(df, attempts, each))
    families = tuple(rolling.Family(f.name, f.key, (300,)) for f in (rolling.MERCHANT, rolling.DEVICE))
    out = rolling.rolling_features(df, rolling.RollingSpec(families, slicing=slicing))
    assert asked == [4 * rolling.ENTITY_PARTS, 2] and rolling.ENTITY_PARTS > 1
    want, got = brute_force(rows), {r.event_id: r.asDict() for r in out.collect()}
    names = [c for c in out.columns if c.endswith("_rate_300s_bp")]
    assert len(names) == 2 and set(got) == set(want)
    assert all(got[e][c] == want[e][c] for e in want for c in names)


def test_two_sums_in_one_long_keep_their_signs(spark):
    from cardweir.operators import rolling

    measures = {"n0": "a", "f0": "b", "n1": "b"}
    packed = rolling._packed(measures)
    assert len(packed) == 2
    df = spark.createDataFrame([(a, b) for a in (-7, 0, 5, 2**31 - 1) for b in (-3, 0, 9)], "a bigint, b bigint")
    out = df.selectExpr("a", "b", *[f"{e} as {n}" for n, e in packed.items()]).selectExpr(
        "a", "b", *[f"{rolling._unpacked(measures, n)} as {n}" for n in measures]
    )
    assert all((r.n0, r.f0, r.n1) == (r.a, r.b, r.b) for r in out.collect())


def test_entities_of_a_twelfth_of_some_million_rows_are_sliced():
    assert Slicing().minimum_rows <= 6_000_000 // 12
