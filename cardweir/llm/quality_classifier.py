"""Operator 7: document quality by a regularised quadratic discriminant.

Each class has a mean and a shrunken covariance over transformed statistics of a text. The score is
the posterior of class 1 from the difference of the Mahalanobis log-densities; the Cholesky factors
are worked out once, when the model is fitted.

Sums for means and covariances come from all labelled training rows, added up on the executors;
2 * (1 + d + d * d) numbers reach the driver.

Defined cases: null and empty texts have the usual statistics and get a score like any other; labels that
are null or not 0 or 1 are passed over, repeated label rows count again; with no row of a class (also
for empty tables) the score of every text is the smoothed share of class 1, (n1 + 1) / (n + 2). Input
columns are kept, extra ones too; result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweir.llm.common import Block, Hasher, slices, small_batches, trimmed

FEATURES = (
    "symbols", "bars", "marks", "upper", "digits", "stops", "repeated", "repeated_apart", "word_length", "short_words",
)
#: Shares are taken over so many words and characters more than a text has, so that a few words of a
#: short text can't make an extreme share; shares that prose has anyway are drawn to a usual value.
MORE_WORDS, MORE_CHARS = 25, 120
USUAL_STOPS, USUAL_LENGTH, USUAL_SHORT = 0.15, 6.0, 0.3
THRESHOLD = 0.3
SHRINK_TO_POOLED = 0.2
SHRINK_TO_DIAGONAL = 0.1
#: Added to each variance: a statistic that never varies in training must not decide alone.
FLOOR = 2e-4

_HASH = Hasher(7)
_BYTE_CLASSES = {
    "symbols": b"#*$%&",
    "bars": b"|<>{}[]~^=\\",
    "marks": b"!?",
    "upper": bytes(range(65, 91)),
    "letters": bytes(range(65, 91)) + bytes(range(97, 123)),
    "digits": b"0123456789",
    "stops": b".,;:",
}


def _lut(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(members)] = 1
    return out


_LUTS = {k: _lut(v) for k, v in _BYTE_CLASSES.items()}


def statistics(texts: pa.Array) -> np.ndarray:
    """The transformed statistics, a row per text."""
    b = Block(texts)
    size = np.diff(b.offsets)
    # bytes of a class per document, from one count of (document, byte) pairs
    counts = np.bincount(np.repeat(np.arange(b.n), size) * 256 + b.data, minlength=b.n * 256).reshape(b.n, 256)
    of = {k: counts @ lut for k, lut in _LUTS.items()}
    words = np.diff(b.first)
    h, doc = _HASH.words(b.data, b.starts, b.ends), b.doc

    def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bincount(at[flags], minlength=b.n)

    same = per_doc((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), doc[1:]) if len(h) > 1 else np.zeros(b.n)
    apart = per_doc((h[2:] == h[:-2]) & (doc[2:] == doc[:-2]), doc[2:]) if len(h) > 2 else np.zeros(b.n)
    length = b.ends - b.starts
    short = per_doc(length <= 3, doc)
    chars = np.bincount(doc, weights=length, minlength=b.n)
    more = words + MORE_WORDS
    of_chars = lambda x: np.sqrt(of[x] / (chars + MORE_CHARS))
    out = np.column_stack([
        of_chars("symbols"), of_chars("bars"), of_chars("marks"), np.sqrt(of["upper"] / (of["letters"] + MORE_CHARS)), of_chars("digits"),
        np.sqrt((of["stops"] + USUAL_STOPS * MORE_WORDS) / more), np.sqrt(same / more), np.sqrt(apart / more),
        np.log((chars + USUAL_LENGTH * MORE_WORDS) / more), np.sqrt((short + USUAL_SHORT * MORE_WORDS) / more),
    ])
    return out


@dataclass(frozen=True)
class Model:
    prior: float  # log odds of class 1
    means: tuple[np.ndarray, np.ndarray] | None  # None: a class had no rows
    factors: tuple[np.ndarray, np.ndarray] | None  # inverses of the Cholesky factors
    log_dets: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.prior)
        if self.means is not None:
            for sign, mean, inverse, log_det in zip((-1, 1), self.means, self.factors, self.log_dets, strict=True):
                odds += sign * (-0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - log_det)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


@trimmed
def _arrow_statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = [statistics(column_of(part)) for part in slices(pa.record_batch([batch], ["text"]), "text")]
        flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
        d = len(FEATURES)
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d, dtype=np.int32)), pa.array(flat))


def column_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(0)


def statistics_column(text: Column) -> Column:
    return F.arrow_udf(_arrow_statistics, "array<double>", F.ArrowUDFType.SCALAR_ITER)(F.coalesce(text, F.lit("")))


def in_training(doc_id: Column) -> Column:
    """Rows that a model may learn from; the rest is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), d)
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    for c in (0, 1):
        if sums[c][0]:
            k = sums.shape[1]
            yield pa.record_batch([pa.array(np.full(k, c, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(sums[c])], ["y", "k", "v"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & in_training(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("y"))
    x = docs.filter(in_training(F.col("doc_id"))).select("doc_id", statistics_column(F.col("text")).alias("x"))
    rows = known.join(x, "doc_id").select("y", "x").mapInArrow(_moments, "y int, k int, v double")
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows.groupBy("y", "k").agg(F.sum("v").alias("v")).collect():
        sums[r.y, r.k] = r.v
    return from_moments(sums)


def from_moments(sums: np.ndarray) -> Model:
    d = len(FEATURES)
    n0, n1 = sums[:, 0]
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return Model(prior, None, None, (0.0, 0.0))
    means = [s[1 : 1 + d] / s[0] for s in sums]
    covs = [s[1 + d :].reshape(d, d) / s[0] - np.outer(m, m) for s, m in zip(sums, means, strict=True)]
    pooled = (n0 * covs[0] + n1 * covs[1]) / (n0 + n1)
    inverses, log_dets = [], []
    for cov in covs:
        cov = (1 - SHRINK_TO_POOLED) * cov + SHRINK_TO_POOLED * pooled
        cov = (1 - SHRINK_TO_DIAGONAL) * cov + SHRINK_TO_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(cov)
        inverses.append(np.linalg.inv(factor))
        log_dets.append(float(np.log(np.diag(factor)).sum()))
    return Model(prior, (means[0], means[1]), (inverses[0], inverses[1]), (log_dets[0], log_dets[1]))


def score_column(model: Model, text: Column) -> Column:
    @trimmed
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [model.score(statistics(column_of(p))) for p in slices(pa.record_batch([batch], ["text"]), "text")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(score, "double", F.ArrowUDFType.SCALAR_ITER)(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1: keep)."""
    scored = docs.withColumn("score", score_column(model, F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    held = (~in_training(F.col("doc_id"))).alias("held_out")
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held, "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier doesn't reject, with their own columns."""
    score = score_column(fit(docs, labels), F.col("text"))
    return docs.filter(score >= THRESHOLD)
