"""Operator 13: hard negatives for contrastive training, by shared candidate lists of anchor clusters.

Anchors are clustered by direction (spherical k-means, fitted on at most ``SAMPLE`` anchors; every anchor is assigned). For a cluster whose members
lie within the angle t of its centre, an item i at the angle s from the centre has with each member a the inner product
|a| |i| cos(max(0, s - t)) at most. So each cluster sorts its candidates by |i| cos(max(0, s - t)) once, and every member walks that one list
from the top, ``STRIDE`` candidates at a time, until it is certified that nothing further down can enter a result: until the bound of what is
left, times the member's length, is below the least score it still needs. Scores are integers, summed exactly (in doubles below 2^53, else as
64-bit integers, which the sums must fit); bounds are doubles with a slack far above their rounding.

Two walks: same-label candidates give each anchor's ``positives`` best; then each positive score p opens a window [share * p, p], and the different-label
candidates give the best ``negatives`` scores of each window. A window is done when it is full and the bound is below its worst score, or the
bound is below its lower end.

On Spark both sides come in blocks of ``BLOCK_BYTES`` (anchors: ``ANCHOR_BYTES``), whose number follows the row count: a stated set of anchors against all
rows. A task holds one block of each; a cluster above a block is split, clusters below share one. Candidates are dealt by a hash of
their id, so labels and clusters of any size spread evenly. The first block of candidates is walked ahead of all; what it fills are
the scores that others must reach, so each further block passes on few rows. The blocks' results are merged by rank.

Defined cases: rows without vec_id, label or vector, or with a null or non-finite component, take no part. Of rows that share a vec_id the one with the
smallest label, then vector, counts. Vectors of other lengths score as if filled with zeros; an empty vector scores 0 with all. A negative positive score
has an empty window. Fewer candidates give fewer rows; an anchor without positives or negatives gives none. Ties go to the smaller vec_id.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardweir.llm.common import Scratch, column

POSITIVES, NEGATIVES, LOW_PERCENT = 5, 5, 80
SAMPLE, CLUSTERS, ROUNDS = 4096, 32, 6
BLOCK_BYTES, ANCHOR_BYTES = 32_000_000, 8_000_000
STRIDE = 512
#: For the rounding of angles, as a share of the lengths' product.
_SLACK = 1e-6
_LEAST, _MOST = -(1 << 62), 1 << 62
_FOUND = "anchor_id long, vec_id long, score long"


def quantised(vector: Column | str, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column | str) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~odd if isinstance(vector, str) else vector.isNotNull() & ~odd


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of vectors, filled with zeros to ``width``; doubles where their inner products stay exact."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    flat, length = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((n, width), np.int64)
    if n and (length == width).all():
        out[:] = flat.reshape(n, width)
    else:
        row = np.repeat(np.arange(n), length)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths); a zero vector stays zero."""
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    return vectors / np.where(length > 0, length, 1.0)[:, None], length


def centres(sample: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of spherical k-means; the first ones are taken farthest from each other."""
    unit, length = units(sample)
    unit = unit[length > 0]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    pick, near = [0], unit @ unit[0]
    for _ in range(min(clusters, len(unit)) - 1):
        pick.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[pick[-1]])
    out = unit[pick]
    for _ in range(rounds):
        own = (unit @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, unit)
        fresh, size = units(sums)
        out = np.where(size[:, None] > 0, fresh, out)
    return out


def angles(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centre, -1.0, 1.0))


class Walk:
    """One block of candidates, walked by the members of clusters."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool, best: int) -> None:
        self.ids, self.labels, self.same, self.best = ids, labels, same, best
        self.vectors = vectors
        self.unit, self.length = units(vectors)
        #: Candidates met and candidates there, summed over members: what the bounds saved.
        self.met, self.held = 0, 0

    def cluster(self, centre: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, caps: list, floors: list) -> Iterator[tuple]:
        """(member, ids, scores) of what each member keeps; ``caps`` and ``floors`` hold each member's windows."""
        unit, length = units(vectors)
        spread = angles(unit, centre).max()
        bound = self.length * np.cos(np.maximum(0.0, angles(self.unit, centre) - spread))
        order = np.argsort(-bound, kind="stable")
        bound, cand_ids, cand_labels, cands, longest = bound[order], self.ids[order], self.labels[order], self.vectors[order], self.length.max(initial=0.0)
        exact = np.float64 if len(cands) and float(length.max()) * longest < 2**52 else np.int64
        cands, members = cands.astype(exact), vectors.astype(exact)
        need = np.array([min(f) for f in floors], np.int64)
        most = np.array([max(c) for c in caps], np.int64)
        kept = {}
        active = np.arange(len(ids))
        self.held += len(ids) * len(cands)
        for at in range(0, len(cands), STRIDE):
            reach = (bound[at] + _SLACK * longest) * length[active] + _SLACK
            active = active[reach >= need[active]]
            if not len(active):
                break
            score = members[active] @ cands[at : at + STRIDE].T
            self.met += score.size
            hit = (score >= need[active][:, None]) & (score <= most[active][:, None])
            alike = labels[active][:, None] == cand_labels[at : at + STRIDE]
            hit &= (alike & (ids[active][:, None] != cand_ids[at : at + STRIDE])) if self.same else ~alike
            who, what = np.nonzero(hit)
            if not len(who):
                continue
            edge = np.flatnonzero(np.diff(who)) + 1
            for one in np.split(np.arange(len(who)), edge):
                m = int(active[who[one[0]]])
                s, i = score[who[one], what[one]].astype(np.int64), cand_ids[at + what[one]]
                if m in kept:
                    s, i = np.concatenate([kept[m][0], s]), np.concatenate([kept[m][1], i])
                ranked = np.lexsort((i, -s))
                s, i = s[ranked], i[ranked]
                used, least = np.zeros(len(s), bool), _MOST
                for cap, floor in zip(caps[m], floors[m], strict=True):
                    first = int(np.searchsorted(-s, -cap))
                    used[first : first + self.best] = True
                    full = first + self.best <= len(s)
                    least = min(least, max(floor, int(s[first + self.best - 1])) if full else floor)
                kept[m], need[m] = (s[used], i[used]), least
        for m, (s, i) in kept.items():
            yield m, i, s


def _walk(members: DataFrame, cands: DataFrame, blocks: range, centre: np.ndarray, width: int, same: bool, best: int) -> DataFrame:
    """What the members keep of the candidates in some blocks."""

    def of(own: pa.Table, other: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(own) and len(other):
            walk = Walk(other.column("vec_id").to_numpy(), other.column("label").to_numpy(), matrix(other.column("q"), width), same, best)
            cluster = own.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                part = own.filter(pa.array(cluster == c))
                ids = part.column("vec_id").to_numpy()
                caps, floors = part.column("caps").to_pylist(), part.column("floors").to_pylist()
                for m, found, score in walk.cluster(centre[c], ids, part.column("label").to_numpy(), matrix(part.column("q"), width), caps, floors):
                    out.append((np.full(len(found), ids[m]), found, score))
        none = np.zeros(0, np.int64)
        return pa.table({n: pa.array(np.concatenate([x[i] for x in out]) if out else none) for i, n in enumerate(("anchor_id", "vec_id", "score"))})

    dealt = cands.filter(F.col("cblock").between(blocks.start, blocks.stop - 1)).withColumn("ablock", F.explode("ablocks")).drop("ablocks")
    asked = members.withColumn("cblock", F.explode(F.sequence(F.lit(blocks.start), F.lit(blocks.stop - 1))))
    keys = ["ablock", "cblock"]
    return asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(of, _FOUND)


def _blocks(rows: int, width: int, most_bytes: int, parallel: int) -> int:
    """Blocks of at most so many bytes; small inputs still give every core one."""
    return max(1, -(-rows * width * 8 // most_bytes), min(parallel, -(-rows // 1024)))


def mine(
    vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT,
    block_bytes: int = BLOCK_BYTES, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    ``vectors``: vec_id, label and q, an array of whole numbers; anchors are the rows whose vec_id is divisible by ``every``.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "q")
    one = scratch.write(rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q"), "rows")
    is_anchor = F.col("vec_id") % every == 0
    size = one.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("q")).alias("width"),
        F.max(F.greatest(F.array_max("q"), -F.array_min("q"))).alias("most"),
    ).first()
    if not size.anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width, most = max(1, size.width), size.most or 0
    kind = "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"
    parallel = spark.sparkContext.defaultParallelism
    blocks = _blocks(size.n, width, block_bytes, parallel)
    short = one.withColumn("q", F.col("q").cast(f"array<{kind}>"))

    sample = short.filter(is_anchor).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").toArrow()
    centre = centres(matrix(sample.column("q"), width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (units(matrix(column(batch, "q"), width))[0] @ centre.T).argmax(1) if len(batch) else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(near.astype(np.int32), pa.int32())], [*batch.schema.names, "cluster"])

    assigned = scratch.write(short.filter(is_anchor).mapInArrow(assign, f"vec_id long, label long, q array<{kind}>, cluster int"), "anchors")
    # at most CLUSTERS rows: a cluster above a block gets blocks of its own, the others are put together
    room = max(1, anchor_bytes // (8 * width))
    base, share, at, used = [0] * len(centre), [1] * len(centre), 0, 0
    for c, n in sorted(((r.cluster, r["count"]) for r in assigned.groupBy("cluster").count().collect()), key=lambda x: (-x[1], x[0])):
        if used and used + n > room:
            at, used = at + 1, 0
        base[c], share[c] = at, max(1, -(-n // room))
        used += n
        if used > room:
            at, used = at + share[c], 0
    ablocks = max(b + s for b, s in zip(base, share, strict=True))
    number = F.get(F.lit(base), F.col("cluster")) + F.pmod(F.xxhash64("vec_id", F.lit("anchors")), F.get(F.lit(share), F.col("cluster"))).cast("int")
    members = assigned.withColumn("ablock", number)
    cands = short.withColumn("cblock", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("ablocks", F.sequence(F.lit(0), F.lit(ablocks - 1)))

    # a window's lower end rises to the worst of its best scores in the first block, where it is full there
    def raised(windows: DataFrame, found: DataFrame, best: int) -> DataFrame:
        met = windows.join(found.withColumnRenamed("vec_id", "other"), windows.vec_id == found.anchor_id).filter(F.col("score").between(F.col("floor"), F.col("cap")))
        order = Window.partitionBy("vec_id", "cap").orderBy(F.desc("score"), "other")
        last = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") == best).select("vec_id", "cap", F.col("score").alias("filled"))
        return windows.join(last, ["vec_id", "cap"], "left").withColumn("floor", F.greatest("floor", F.coalesce("filled", "floor"))).drop("filled")

    def best_of(windows: DataFrame, same: bool, best: int, name: str) -> DataFrame:
        for part in [range(0, 1), range(0, blocks)][blocks == 1 :]:
            lists = windows.groupBy("vec_id").agg(F.collect_list("cap").alias("caps"), F.collect_list("floor").alias("floors"))
            found = scratch.write(_walk(members.join(lists, "vec_id"), cands, part, centre, width, same, best), f"{name}{part.stop}")
            windows = windows if part.stop == blocks else scratch.write(raised(windows, found, best), f"{name}-windows")
        return found

    whole = members.select("vec_id", F.lit(_MOST).alias("cap"), F.lit(_LEAST).alias("floor"))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = best_of(whole, True, positives, "same").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    low = F.ceil(F.col("score").cast("decimal(20,0)") * low_percent / 100).cast("long")
    pairs = scratch.write(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low")), "pairs")
    windows = pairs.filter("positive_score >= 0").select(F.col("anchor_id").alias("vec_id"), F.col("positive_score").alias("cap"), F.col("low").alias("floor")).distinct()
    other = best_of(windows, False, negatives, "other").select("anchor_id", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    inside = F.col("negative_score").between(F.col("low"), F.col("positive_score"))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = pairs.join(other, "anchor_id").filter(inside).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
