import random

import pytest
from pyspark.sql import functions as F

from cardweir.operators import joins as J
from cardweir.operators import ordering as O


def test_running_totals_and_previous(spark):
    rng = random.Random(1)
    data = [(i, rng.randrange(100)) for i in range(500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k int, v int")
    got = {r.k: (r.s, r.s_total) for r in O.running_totals(df, [F.col("k")], {"s": "v"}).collect()}
    total, seen = sum(v for _, v in data), 0
    for k, v in sorted(data):
        seen += v
        assert got[k] == (seen, total)
    ordered = [k for k, _ in sorted(data)]
    prev = {r.k: r.prev_k for r in O.previous_values(df, [F.col("k")], ["k"]).collect()}
    assert prev == dict(zip(ordered, [None, *ordered]))


@pytest.mark.parametrize("n,k", [(10, 4), (97, 10), (5, 8), (1, 3), (64, 64)])
def test_systematic_sample(spark, n, k):
    df = spark.range(n)
    want = list(range(n)) if n <= k else sorted({i * (n - 1) // (k - 1) for i in range(k)})
    assert sorted(r.id for r in O.systematic_sample(df, k, F.col("id")).collect()) == want


def test_nearest_ranks_per_group(spark):
    rng = random.Random(2)
    data = [(g, rng.randrange(30)) for g in "abc" for _ in range(rng.randrange(1, 80))]
    got = {r.g: r for r in O.integer_distribution(spark.createDataFrame(data, "g string, v int"), "v", ("g",)).collect()}
    for g in "abc":
        values = sorted(v for h, v in data if h == g)
        rank = lambda p: values[max(1, (p * len(values) + 99) // 100) - 1]
        assert (got[g]["count"], got[g]["min"], got[g]["max"], got[g].p50, got[g].p95) == (
            len(values), values[0], values[-1], rank(50), rank(95))


def test_strict_times(spark):
    nows = [5, 5, 5, 9, 2, 20, 20]
    df = spark.createDataFrame(list(enumerate(nows)), "i int, now bigint")
    got = [r.assigned_at_ms for r in O.strict_times(df, "now", F.col("i")).orderBy("i").collect()]
    want, last = [], None
    for now in nows:
        last = now if last is None or now > last else last + 1
        want.append(last)
    assert got == want


def test_strict_times_over_many_slices_and_after_a_carry(spark, uncoalesced):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice([0, 0, 3, rng.randrange(4000)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, now bigint").repartition(7)
    for carry in (None, 1500, 10_000):
        got = {r.i: r.assigned_at_ms for r in O.strict_times(df, "now", F.col("now"), F.col("i"), after_ms=carry).collect()}
        last = carry
        for i, now in sorted(rows, key=lambda r: (r[1], r[0])):
            last = now if last is None or now > last else last + 1
            assert got[i] == last
    plan = O.strict_times(df, "now", F.col("i"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]  # rows meet their slice's carry and nothing else


def test_join_on_entity_splits_without_changing_rows(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0L, id % 50) as k")
    entities = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain = {(r.id, r.n) for r in rows.join(entities, "k").collect()}
    split = J.join_on_entity(rows, entities, ["k"], "n", share=0.1, minimum_rows=0)
    assert {(r.id, r.n) for r in split.collect()} == plain and split.count() == len(plain)
