"""Operator 13 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardweir.llm import hard_negatives as H


def brute(rows, every, k, n):
    best = {}
    for i, label, q in rows:
        if i is not None and label is not None and q is not None:
            best[i] = min(best.get(i, (label, q)), (label, q))
    out = []
    for a, (la, qa) in best.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(qa, qb)) for b, (_, qb) in best.items() if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if best[b][0] == la][:k]:
            s = score[p]
            own = [b for b in order if best[b][0] != la and 80 * s <= 100 * score[b] <= 100 * s][:n]
            out += [(a, p, r, b, s, score[b]) for r, b in enumerate(own, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, 1.0) for r in rows], "vec_id long, label int, q array<long>, score int, cluster double")


def vectors(seed, n, d, groups=6, width=40):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, width, (groups, d))
    own = rng.integers(0, groups, n)
    q = np.floor(centre[own] + rng.normal(0, width / 3, (n, d))).astype(int)
    label = np.where(rng.random(n) < 0.5, own % 3, rng.integers(0, 3, n))
    return [(int(i), int(c), x.tolist()) for i, c, x in zip(rng.permutation(n * 2)[:n], label, q)]


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("block, anchors", [(1 << 25, 1 << 23), (6000, 600)])
def test_negatives_against_brute_force(spark, block, anchors):
    rows = vectors(1, 700, 8)
    rows += [(2000 + i, 1, rows[0][2]) for i in range(60)]  # copies: ties across blocks
    rows += [(3000 + i, 0, [0] * 8) for i in range(30)] + [(4000, 2, [0] * 8), (4010, 2, []), (4020, 1, [5, 7])]
    rows += [rows[5], (rows[6][0], 9, rows[6][2]), (None, 1, rows[0][2]), (5000, None, rows[0][2]), (5010, 1, None)]
    out = got(H.mine(frame(spark, rows), every=10, block_bytes=block, anchor_bytes=anchors))
    assert out == brute(rows, 10, 5, 5) and len(out) > 300


def test_one_label_and_no_rows(spark):
    rows = [(i, 0, [i, 1]) for i in range(50)]
    assert got(H.mine(frame(spark, rows), every=10)) == []
    assert got(H.mine(frame(spark, rows).limit(0))) == []
    assert got(H.mine(frame(spark, [(1, 0, [1])]))) == []


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [(1 << 29) + 3 * i, (1 << 29) - i, 1]) for i in range(40)]
    out = got(H.mine(frame(spark, rows), every=5))
    assert out == brute(rows, 5, 5, 5)
    assert got(H.mine(frame(spark, [(i, i % 2, [(1 << 30) + i, -(1 << 30), i]) for i in range(20)]), every=5))


def test_walk_ends_before_the_list_does():
    rows = vectors(4, 6000, 6, groups=12)
    ids, labels, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    walk = H.Walk(ids, labels, q, True, 5)
    near = np.argsort(-(H.units(q)[0] @ H.units(q)[0][0]))[:10]
    centre = H.units(q[near].mean(0, keepdims=True))[0][0]
    kept = list(walk.cluster(centre, ids[near], labels[near], q[near], [[H._MOST]] * 10, [[H._LEAST]] * 10))
    assert len(kept) == 10 and walk.met < walk.held / 2


def test_rows_that_take_part(spark):
    rows = [(1, [0.5, -0.001]), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf")]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").filter(H.usable("embedding"))
    assert {r.vec_id: r.q for r in df.select("vec_id", H.quantised("embedding").alias("q")).collect()} == {1: [128, -1], 6: []}
    assert df.filter(F.col("vec_id") == 9).count() == 0
