import numpy as np
import pytest

from cardweir.operators import models as L

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 5, .1]
    x[:, 2] = 2.0  # never varies
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(size=400) > 1.2).astype(int)
    rows = [(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "i int, y int, a double, b double, c double").cache(), x, y


def newton(x, y, w, penalty):
    z = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (p - y)) + ridge @ beta)
        beta -= step
    return beta


def test_logistic_equals_newton(data):
    df, x, y = data
    model = L.fit_logistic(df, FEATURES)
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = newton((x - mean) / scale, y, w, 1.0)
    assert np.allclose(model.scaler.mean, mean) and np.allclose(model.scaler.scale, scale)
    assert np.allclose([*model.coefficients, model.intercept], beta, atol=1e-4)
    raw = [r.raw for r in df.orderBy("i").select(L.score_raw(model).alias("raw")).collect()]
    assert np.allclose(raw, (x - mean) / scale @ np.array(model.coefficients) + model.intercept)
    platt = L.fit_platt(df.select("y", L.score_raw(model).alias("raw")))
    want = newton(np.array(raw)[:, None], y, np.ones(len(y)), 1.0)
    assert np.allclose([platt.coefficient, platt.intercept], want, atol=1e-4)
    p = [r.p for r in df.orderBy("i").select(L.score_probability(L.score_raw(model), platt).alias("p")).collect()]
    assert np.allclose(p, 1 / (1 + np.exp(-(platt.coefficient * np.array(raw) + platt.intercept))))


def plain_boosting(x, y, edges, trees, rate, minimum_leaf):
    """The same rule on whole arrays, every candidate tried on the rows themselves."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    raw, out = np.zeros(len(y)), []

    def split(rows, g):
        best = None
        for f, own in enumerate(edges):
            for e in own:
                left = rows & (x[:, f] <= e)
                right = rows & ~left
                if left.sum() < minimum_leaf or right.sum() < minimum_leaf:
                    continue
                wl, wr = w[left].sum(), w[right].sum()
                gain = wl * wr / (wl + wr) * (g[left].sum() / wl - g[right].sum() / wr) ** 2
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, e)
        return best

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (y - p), w * p * (1 - p)

        def grow(rows, depth):
            best = split(rows, g) if depth else None
            if best is None:
                value = g[rows].sum() / h[rows].sum()
                raw[rows] += rate * value
                return value
            left = rows & (x[:, best[1]] <= best[2])
            return (best[1], best[2], grow(left, depth - 1), grow(rows & ~left, depth - 1))

        out.append(grow(np.ones(len(y), bool), 2))
    return out, raw


def nested(tree, node=0):
    if tree.left[node] < 0:
        return tree.value[node]
    return (tree.feature[node], tree.threshold[node], nested(tree, tree.left[node]), nested(tree, tree.right[node]))


def same_tree(a, b):
    if not isinstance(a, tuple):
        return not isinstance(b, tuple) and np.isclose(a, b, rtol=1e-9)
    return isinstance(b, tuple) and a[:2] == b[:2] and same_tree(a[2], b[2]) and same_tree(a[3], b[3])


def test_boosting_equals_the_plain_rule(data, spark):
    df, x, y = data
    model = L.fit_boosting(df.repartition(5), FEATURES, trees=12)
    edges = L.candidate_edges(df, FEATURES)
    assert edges[2] == () and all(len(e) <= L.EDGES for e in edges)
    assert all((x[:, 0] <= e).sum() == max(1, (p * 400 + 99) // 100) for p, e in zip(range(2, 100, 2), edges[0]))
    want, raw = plain_boosting(x, y, edges, 12, L.LEARNING_RATE, L.MINIMUM_LEAF)
    assert all(same_tree(a, nested(t)) for a, t in zip(want, model.trees, strict=True))
    got = L.score_arrays(df.withColumn("portable", L.score_raw(model)), model, "library", "i", "portable").orderBy("i").collect()
    assert np.allclose([r.portable for r in got], raw) and np.allclose([r.library for r in got], raw)
    assert L.feature_importance(spark, model).orderBy("rank").first().feature in ("a", "b")
    assert np.isclose(sum(model.importances), 1)


def test_boosting_without_a_split(spark):
    df = spark.createDataFrame([(i % 2, 1.0) for i in range(50)], "y int, a double")
    model = L.fit_boosting(df, ["a"], trees=2)
    assert [t.left for t in model.trees] == [(-1,), (-1,)] and df.select(L.score_raw(model).alias("r")).first().r == 0.0


def test_slopes_vanish_at_the_fit_and_nowhere_else(data):
    df, _, _ = data
    model = L.fit_logistic(df, FEATURES)
    at = {r.feature: abs(r.slope) / max(r.scale, 1e-9) for r in L.logistic_slopes(df, model).collect()}
    assert set(at) == {*FEATURES, "intercept"} and max(at[f] for f in ("a", "b", "intercept")) < 1e-4
    off = L.LogisticModel(model.scaler, (model.coefficients[0] + 0.1, *model.coefficients[1:]), model.intercept)
    assert {r.feature: abs(r.slope) / r.scale for r in L.logistic_slopes(df, off).filter("feature = 'a'").collect()}["a"] > 1e-3
