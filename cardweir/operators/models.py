"""Model fitting and scoring as plain Column expressions.

Logistic fits are MLlib's; boosting is histograms of gradients and hessians, summed by Spark. A fitted model is a small table of numbers
(coefficients, or the nodes of a few dozen shallow trees), so scoring needs no Python and no MLlib: it is an expression any query can use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweir.functions.scalars import clip_probability, sigmoid_stable
from cardweir.operators import metrics as M
from cardweir.operators.ordering import nearest_ranks, systematic_sample
from cardweir.operators.policy import candidate_ranking
from cardweir.session import materialise

# The candidates' settings.
LOGISTIC_C = 1.0
LOGISTIC_TOLERANCE = 1e-8
MAXIMUM_ITERATIONS = 1000
TREES = 48
LEARNING_RATE = 0.05
MINIMUM_LEAF = 20
CLIP = 1e-15

#: Candidate thresholds of a feature; gains that differ by less than this part are ties; what counts as a gain at all.
EDGES = 49
TIE, GAIN = 1e-9, 1e-12


@dataclass(frozen=True)
class Scaler:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


@dataclass(frozen=True)
class Platt:
    coefficient: float
    intercept: float


@dataclass(frozen=True)
class LogisticModel:
    scaler: Scaler
    coefficients: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class Tree:
    """Nodes by id; a leaf has no left child."""

    left: tuple[int, ...]
    right: tuple[int, ...]
    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    value: tuple[float, ...]


@dataclass(frozen=True)
class BoostedModel:
    features: tuple[str, ...]
    trees: tuple[Tree, ...]
    weights: tuple[float, ...]
    importances: tuple[float, ...]


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, scale): population deviation, 1 where a feature never varies. One pass."""
    wide = df.agg(*[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)],
                  *[F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)])
    rows = ", ".join(f"struct('{f}' as feature, m_{i} as mean, if(s_{i} = 0, 1D, s_{i}) as scale)" for i, f in enumerate(features))
    return wide.select(F.expr(f"inline(array({rows}))"))


def _scaler(df: DataFrame, features: list[str]) -> Scaler:
    rows = {r.feature: r for r in fit_scaler(df, features).collect()}  # one row per feature
    return Scaler(tuple(features), tuple(rows[f].mean for f in features), tuple(rows[f].scale for f in features))


def scaled(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({
        f: (F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in zip(scaler.features, scaler.mean, scaler.scale)
    })


def weighted(df: DataFrame) -> DataFrame:
    """Add the balanced class weight n / (2 * n_class) (two rows, broadcast)."""
    return df.join(F.broadcast(M.balanced_weights(df).select("y", "weight")), "y")


def fit_logistic(df: DataFrame, features: list[str], C: float = LOGISTIC_C) -> LogisticModel:
    """Weighted L2 logistic regression on scaled features; the penalty is that of sum-of-losses / C."""
    scaler = _scaler(df, features)
    train = scaled(weighted(df.select("y", *features)), scaler)
    total = train.agg(F.sum("weight").alias("w")).first().w
    fitted = LogisticRegression(
        featuresCol="x", labelCol="y", weightCol="weight", regParam=1.0 / (C * total), elasticNetParam=0.0,
        standardization=False, maxIter=MAXIMUM_ITERATIONS, tol=LOGISTIC_TOLERANCE,
    ).fit(VectorAssembler(inputCols=features, outputCol="x").transform(train).select("x", "y", "weight"))
    return LogisticModel(scaler, tuple(float(c) for c in fitted.coefficients), float(fitted.intercept))


def logistic_slopes(df: DataFrame, model: LogisticModel, C: float = LOGISTIC_C) -> DataFrame:
    """(feature, slope, scale): the penalised loss's derivative by each coefficient and by the intercept, in one pass over the rows.

    ``scale`` is the sum of the absolute terms that make the derivative up, so their ratio tells how near to 0 it is.
    """
    s = model.scaler
    rows = weighted(df.select("y", *s.features)).withColumn("_r", (sigmoid_stable(score_raw(model)) - F.col("y")) * F.col("weight"))
    terms = {f: (F.col(f) - F.lit(m)) / F.lit(k) * F.col("_r") for f, m, k in zip(s.features, s.mean, s.scale)} | {"intercept": F.col("_r")}
    penalty = dict(zip(s.features, (c / C for c in model.coefficients)))
    wide = rows.agg(*[x for i, t in enumerate(terms.values()) for x in (F.sum(t).alias(f"s_{i}"), F.sum(F.abs(t)).alias(f"a_{i}"))])
    made = ", ".join(f"struct('{f}' as feature, s_{i} + {penalty.get(f, 0.0)!r}D as slope, a_{i} + {abs(penalty.get(f, 0.0))!r}D as scale)" for i, f in enumerate(terms))
    return wide.select(F.expr(f"inline(array({made}))"))


def score_arrays(df: DataFrame, model: BoostedModel, name: str, *keep: str) -> DataFrame:
    """``keep`` and the model's log-odds computed on arrays in Arrow batches: a second way to score, for checks."""
    own = [np.array(t.threshold) for t in model.trees]
    kept = df.select(*keep)
    width = len(keep)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(width + i).to_numpy(zero_copy_only=False) for i in range(len(model.features))], 1)
            total = np.zeros(len(x))
            for tree, threshold, weight in zip(model.trees, own, model.weights, strict=True):
                at = np.zeros(len(x), np.int64)
                left, right, feature = np.array(tree.left), np.array(tree.right), np.array(tree.feature)
                while (left[at] >= 0).any():
                    goes = x[np.arange(len(x)), feature[at]] <= threshold[at]
                    at = np.where(left[at] < 0, at, np.where(goes, left[at], right[at]))
                total += weight * np.array(tree.value)[at]
            yield pa.record_batch([*[batch.column(i) for i in range(width)], pa.array(total)], [*keep, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return df.select(*keep, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(model.features)]).mapInArrow(of, f"{schema}, {name} double")


def candidate_edges(df: DataFrame, features: list[str], edges: int = EDGES) -> list[tuple[float, ...]]:
    """Per feature, the values at evenly spaced exact nearest ranks: at most ``edges`` thresholds, the largest value left out."""
    step = 100 // (edges + 1)
    percents = {f"p{p}": p for p in range(step, 100, step)}
    melted = df.select(F.expr(f"inline(array({', '.join(f'struct({i} as feature, double({f}) as value)' for i, f in enumerate(features))}))"))
    ranks = nearest_ranks(melted.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("w")), "value", "w", percents, ("feature",))
    rows = {r.feature: sorted({r[p] for p in percents if r[p] < r["max_"]}) for r in ranks.withColumnRenamed("max", "max_").collect()}  # a row per feature
    return [tuple(rows.get(i, ())) for i in range(len(features))]


@dataclass(frozen=True)
class Split:
    feature: int
    place: int  # of its threshold among the feature's edges
    gain: float


def best_split(cells: np.ndarray, edges: list[tuple[float, ...]], minimum_leaf: int) -> Split | None:
    """The split of one node by its histogram ``cells`` (feature, bin, [rows, weight, gradient, hessian]).

    The gain is the drop of the weighted squared error of the gradients, ``wl wr / (wl + wr) (ml - mr)**2`` with the sides'
    weights and means. Ties go to the first feature, then the lowest threshold.
    """
    best = None
    whole = cells[0].sum(0)
    for f, own in enumerate(edges):
        if not own:
            continue
        left = cells[f, : len(own)].cumsum(0)
        right = whole - left
        fits = (left[:, 0] >= minimum_leaf) & (right[:, 0] >= minimum_leaf) & (left[:, 1] > 0) & (right[:, 1] > 0)
        if not fits.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[:, 1] * right[:, 1] / whole[1] * (left[:, 2] / left[:, 1] - right[:, 2] / right[:, 1]) ** 2
        gain = np.where(fits, gain, -1.0)
        place = int(np.argmax(gain > gain.max() * (1 - TIE)))
        if gain[place] > GAIN and (best is None or gain[place] > best.gain * (1 + TIE)):
            best = Split(f, place, float(gain[place]))
    return best


def newton_leaf(cell: np.ndarray) -> float:
    """Sum of weighted gradients over sum of weighted hessians: one Newton step of the log loss."""
    return float(cell[2] / cell[3]) if abs(cell[3]) > 1e-150 else 0.0


def _binned_raw(bins: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """Log-odds of binned rows by the trees so far; a tree is nested (feature, place, left, right) tuples with leaf values at the ends."""

    def walk(node, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[rows] += node
            return
        left = bins[rows, node[0]] <= node[1]
        walk(node[2], rows[left], out)
        walk(node[3], rows[~left], out)

    out = np.zeros(len(bins))
    for tree in trees:
        walk(tree, np.arange(len(bins)), out)
    return out


def fit_boosting(
    df: DataFrame, features: list[str], trees: int = TREES, learning_rate: float = LEARNING_RATE, minimum_leaf: int = MINIMUM_LEAF, edges: int = EDGES,
) -> BoostedModel:
    """Gradient boosting of the balanced log loss: start at 0, trees of depth two, Newton leaves, shrunk by the learning rate.

    Rows are binned by candidate thresholds and written once. Each level of a tree is one pass: tasks sum rows, weights, gradients
    and hessians by (node, feature, bin) in arrays, the sums meet by cell, and the driver picks splits from features x bins
    cells. Scores of rows are never stored; a pass computes them from the trees so far.
    """
    thresholds = candidate_edges(df, features, edges)
    width = max((len(e) for e in thresholds), default=0) + 1
    own = [np.array(e) for e in thresholds]

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.searchsorted(e, batch.column(i + 2).to_numpy(zero_copy_only=False), side="left") for i, e in enumerate(own)]
            flat = np.stack(x, 1).astype(np.int16) if len(batch) else np.zeros((0, len(own)), np.int16)
            lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, max(1, len(own)), dtype=np.int32), pa.array(flat.reshape(-1)))
            yield pa.record_batch([batch.column(0), batch.column(1), lists], ["y", "weight", "bins"])

    rows = weighted(df.select("y", *features)).select(F.col("y").cast("int"), F.col("weight").cast("double"), *[F.col(f).cast("double") for f in features])
    binned = materialise(rows.mapInArrow(bin_rows, "y int, weight double, bins array<smallint>"), "binned")

    def histogram(grown: list[tuple], nodes: list[list[tuple[int, int, bool]]]) -> np.ndarray:
        """(node, feature, bin, sums) over the rows that reach each node; a node is its path of (feature, place, goes left)."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((4, len(nodes) * len(own) * width))
            for batch in batches:
                if not len(batch):
                    continue
                y, weight = batch.column(0).to_numpy().astype(float), batch.column(1).to_numpy()
                bins = batch.column(2).flatten().to_numpy().reshape(len(batch), len(own)).astype(np.int64)
                p = 1 / (1 + np.exp(-learning_rate * _binned_raw(bins, grown)))
                values = np.stack([np.ones(len(y)), weight, weight * (y - p), weight * p * (1 - p)])
                for k, path in enumerate(nodes):
                    here = np.ones(len(y), bool)
                    for f, place, left in path:
                        here &= (bins[:, f] <= place) == left
                    cell = ((k * len(own) + np.arange(len(own))) * width + bins[here]).reshape(-1)
                    for j in range(4):
                        total[j] += np.bincount(cell, weights=np.repeat(values[j, here], len(own)), minlength=total.shape[1])
            some = np.flatnonzero(total[0])
            yield pa.record_batch([pa.array(some), *[pa.array(total[j, some]) for j in range(4)]], ["cell", "n", "w", "g", "h"])

        out = np.zeros((len(nodes) * len(own) * width, 4))
        met = binned.mapInArrow(sums, "cell long, n double, w double, g double, h double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "nwgh"])
        for r in met.collect():  # nodes x features x bins cells at most
            out[r.cell] = (r.n, r.w, r.g, r.h)
        return out.reshape(len(nodes), len(own), width, 4)

    grown: list[tuple] = []
    gains = np.zeros(len(own))
    for _ in range(trees):
        tree_gains = np.zeros(len(own))

        def grow(cells: np.ndarray, split: Split | None, deeper=None):
            """A leaf, or a split whose sides are leaves of the same histogram or come from ``deeper``."""
            if split is None:
                return newton_leaf(cells[0].sum(0))
            tree_gains[split.feature] += split.gain
            left = cells[split.feature, : split.place + 1].sum(0)
            right = cells[split.feature].sum(0) - left
            sides = deeper or (newton_leaf(left), newton_leaf(right))
            return (split.feature, split.place, *sides)

        (root_cells,) = histogram(grown, [[]])
        root = best_split(root_cells, thresholds, minimum_leaf)
        sides = None
        if root is not None:
            below = histogram(grown, [[(root.feature, root.place, True)], [(root.feature, root.place, False)]])
            sides = tuple(grow(cells, best_split(cells, thresholds, minimum_leaf)) for cells in below)
        grown.append(grow(root_cells, root, sides))
        if tree_gains.sum() > 0:
            gains += tree_gains / tree_gains.sum()
    importances = gains / gains.sum() if gains.sum() > 0 else gains
    return BoostedModel(tuple(features), tuple(_node_table(t, thresholds) for t in grown), (learning_rate,) * trees, tuple(importances.tolist()))


def _node_table(tree, thresholds: list[tuple[float, ...]]) -> Tree:
    """Nodes by id, a parent before its children and all of the left side before the right one."""
    left, right, feature, threshold, value = [], [], [], [], []

    def add(node) -> int:
        number = len(left)
        inner = isinstance(node, tuple)
        for column, v in ((left, -1), (right, -1), (feature, node[0] if inner else -1), (threshold, thresholds[node[0]][node[1]] if inner else 0.0), (value, 0.0 if inner else node)):
            column.append(v)
        if inner:
            left[number], right[number] = add(node[2]), add(node[3])
        return number

    add(tree)
    return Tree(tuple(left), tuple(right), tuple(feature), tuple(threshold), tuple(value))


def _tree_sql(tree: Tree, features: tuple[str, ...], node: int = 0) -> str:
    if tree.left[node] < 0:
        return f"{tree.value[node]!r}D"
    test = f"{features[tree.feature[node]]} <= {tree.threshold[node]!r}D"
    return (
        f"if({test}, {_tree_sql(tree, features, tree.left[node])}, {_tree_sql(tree, features, tree.right[node])})"
    )


def score_raw(model: LogisticModel | BoostedModel) -> Column:
    """Log-odds as a Column: a dot product, or trees walked with ``x <= threshold`` to the left."""
    if isinstance(model, LogisticModel):
        s = model.scaler
        terms = [
            f"(({f} - {m!r}D) / {k!r}D) * {c!r}D"
            for f, m, k, c in zip(s.features, s.mean, s.scale, model.coefficients)
        ]
        return F.expr(" + ".join([f"{model.intercept!r}D", *terms]))
    walks = [f"{w!r}D * {_tree_sql(t, model.features)}" for w, t in zip(model.weights, model.trees)]
    return F.expr(" + ".join(walks) if walks else "0D")


def fit_platt(df: DataFrame, raw: str = "raw", C: float = 1.0) -> Platt:
    """One-dimensional unweighted logistic regression on the raw score."""
    rows = df.count()
    fitted = LogisticRegression(
        featuresCol="x", labelCol="y", regParam=1.0 / (C * rows), elasticNetParam=0.0, standardization=False,
        maxIter=MAXIMUM_ITERATIONS, tol=1e-10,
    ).fit(VectorAssembler(inputCols=[raw], outputCol="x").transform(df.select(raw, "y")).select("x", "y"))
    return Platt(float(fitted.coefficients[0]), float(fitted.intercept))


def score_probability(raw: str | Column, platt: Platt) -> Column:
    z = (F.col(raw) if isinstance(raw, str) else raw) * F.lit(platt.coefficient) + F.lit(platt.intercept)
    return clip_probability(sigmoid_stable(z), CLIP)


def scoring_parity(df: DataFrame, left: str, right: str, rows: int, *order: Column) -> DataFrame:
    """Largest difference of two scorers over an even sample of rows."""
    sample = systematic_sample(df, rows, *order)
    return sample.agg(
        F.count(F.lit(1)).alias("checked_rows"), F.max(F.abs(F.col(left) - F.col(right))).alias("maximum_error")
    )


def feature_importance(spark, model: LogisticModel | BoostedModel) -> DataFrame:
    """(feature, importance, rank): largest first, ties by name. One row per feature."""
    if isinstance(model, LogisticModel):
        pairs = zip(model.scaler.features, (abs(c) for c in model.coefficients))
    else:
        pairs = zip(model.features, model.importances)
    ranked = sorted(pairs, key=lambda fv: (-fv[1], fv[0]))
    return spark.createDataFrame(
        [(f, float(v), i) for i, (f, v) in enumerate(ranked, start=1)], "feature string, importance double, rank int"
    )


@dataclass(frozen=True)
class Candidate:
    name: str
    model: LogisticModel | BoostedModel
    platt: Platt

    def probability(self) -> Column:
        return score_probability(score_raw(self.model), self.platt)


def fit_candidates(train: DataFrame, calibration: DataFrame, features: list[str], trees: int = TREES) -> list[Candidate]:
    logistic = fit_logistic(train, features)
    boosted = fit_boosting(train, features, trees)
    return [
        Candidate(name, m, fit_platt(calibration.select("y", score_raw(m).alias("raw"))))
        for name, m in (("logistic_regression", logistic), ("gradient_boosting", boosted))
    ]


def candidate_reports(candidates: list[Candidate], policy: DataFrame) -> DataFrame:
    """Each candidate's best threshold on the policy rows."""
    reports = None
    for c in candidates:
        scored = policy.select("y", c.probability().alias("p"))
        best = M.select_threshold(M.threshold_curve(scored)).withColumn("name", F.lit(c.name))
        reports = best if reports is None else reports.unionByName(best)
    return reports


def select_model(train: DataFrame, calibration: DataFrame, policy: DataFrame, features: list[str]) -> DataFrame:
    """Fit both candidates, calibrate, choose thresholds, and keep the better candidate's report."""
    return candidate_ranking(candidate_reports(fit_candidates(train, calibration, features), policy))
