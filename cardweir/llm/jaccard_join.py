"""Operator 4: exact Jaccard join of documents on word 5-grams by a grouped prefix join.

1. A count sketch of all shingles fixes one order, rare first. Every order gives right results; a
   good one keeps passages that many documents share out of the prefixes. It has 2^20 bytes at any
   input size.
2. Documents with equal sets become one class. Classes with the same size and the same prefix (the
   first n - ceil(0.8 n) + 1 shingles) become one group, and only groups enter the prefix index.
3. Index rows are dealt by shingle; shingles of one group only drop out. For each group the leader
   (smallest group id) it shares most shingles with gives one candidate pair, so a group of m near
   copies costs m comparisons, not m * m. Classes of one group are compared with their first class.
4. Candidates are verified on their whole texts; verified links give components.
5. Exact rest: groups are expanded into classes, and every pair of classes of different components
   that shares index shingles is counted; those whose shared prefix shingles can reach 0.8 are verified.
   Shingles that very many classes share are worked through block against block, where all pairs of
   two blocks are intersected at once and only links come out. Pairs inside a component need no
   verdict. Before, a second round of leaders, now of components, leaves little open.

No pair is dropped by a cap. Hot shingles are split by a salt from the sketch, and joins on them are
inner joins that adaptive execution splits. Sets hold 64-bit hashes of shingles and classes 64-bit
digests of sets: two different sets meet with a chance of about 1e-2 at 1e9 different texts.

Defined cases: a null, empty or blank text has an empty set, n_shingles 0, and is linked with nothing;
with fewer than five words the whole sequence is the one shingle. Repeated rows and equal texts are
linked; rows that share a doc_id count as one node, whatever their texts. Rows without a doc_id are linked by
their texts; a component's id is its smallest doc_id, null where none of its rows has one. Empty tables give
empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweir.llm.common import Block, Hasher, Scratch, column, mix64, slices, trimmed
from cardweir.llm.components import components

SHINGLE = 5
#: Similarity in hundredths.
SIMILARITY = 80
SKETCH_BITS = 20
_CHUNK = 1 << 14
#: Documents that a part of a hot shingle's list should hold.
PART_ROWS = 200_000
#: Leaders of a shingle in the second round.
LEADERS = 4
#: A shingle of so many classes is compared in blocks of about so many.
HOT_ROWS, HOT_BLOCK = 64, 512
#: log2 of the bits of the filter that spares clean documents a shuffle.
FILTER_BITS = 24

_HASH = Hasher(4)


def _shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and where each document's begin; repeats are still there."""
    words = _HASH.words(block.data, block.starts, block.ends)
    count = np.diff(block.first)
    grams = _HASH.windows(words, SHINGLE)
    keep = np.zeros(len(grams), bool)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, 0)
    # windows that start where at least five words of the same document are left
    if len(grams):
        left = np.repeat(block.first[1:], count) - np.arange(len(words))
        keep = left[: len(grams)] >= SHINGLE
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    if not len(few):
        return grams[keep], np.concatenate([[0], np.cumsum(size)])
    own = {d: np.sort(_whole(words[block.first[d] : block.first[d + 1]])) for d in few}
    size[few] = 1
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint64)
    fill = np.ones(len(out), bool)
    fill[ends[few]] = False
    out[fill] = grams[keep]
    for d, v in own.items():
        out[ends[d]] = v[0]
    return out, ends


def _whole(words: np.ndarray) -> np.ndarray:
    return mix64(_HASH.windows(words, len(words)) + np.uint64(len(words)))


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted set of each text."""
    grams, ends = _shingles(Block(texts, lower=True))
    return [np.unique(grams[ends[i] : ends[i + 1]]) for i in range(len(ends) - 1)]


@trimmed
def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            grams, _ = _shingles(Block(column(part, "text"), lower=True))
            total += np.bincount((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
    yield from _chunks(total, 1)


def _chunks(total: np.ndarray, level: int) -> Iterator[pa.RecordBatch]:
    used = [i for i in range(len(total) // _CHUNK) if total[i * _CHUNK : (i + 1) * _CHUNK].any()]
    packed = [zlib.compress(total[i * _CHUNK : (i + 1) * _CHUNK].tobytes(), level) for i in used]
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])


@trimmed
def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(zlib.decompress(packed), np.int64)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes()) for v in total.values()], pa.binary())], ["chunk", "counts"])


def shingle_sketch(docs: DataFrame) -> np.ndarray:
    """Counts of all shingles by the first bits of their hashes."""
    rows = docs.select("text").mapInArrow(_sketch_rows, "chunk int, counts binary").repartition("chunk").mapInArrow(_add_chunks, "chunk int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows.collect():  # 64 chunks at most
        out[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    return out


def _prefix_length(n: int) -> int:
    return n - -(-SIMILARITY * n // 100) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prefixes(rank: np.ndarray, parts: np.ndarray):
    """doc_id, key, n, class, group and prefix of each document, given the order's classes of rarity."""

    @trimmed
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, sizes, classes, groups, prefixes = column(part, "doc_id"), [], [], [], []
                for s in _sets(column(part, "text")):
                    n = len(s)
                    sizes.append(n)
                    if not n:
                        classes.append(None), groups.append(None), prefixes.append(None)
                        continue
                    digest = hashlib.blake2b(s.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest()
                    bucket = (s >> shift).astype(np.int64)
                    p = _prefix_length(n)
                    first = np.lexsort((s, rank[bucket]))[:p]
                    head = s[first]
                    classes.append(int.from_bytes(digest, "little", signed=True))
                    groups.append(int.from_bytes(hashlib.blake2b(head.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
                    # the last byte: 0, or into which part of a hot shingle's list the group goes
                    split = parts[bucket[first]]
                    salt = np.where(split > 1, 1 + np.uint64(groups[-1] & 0xFFFF) % split, np.uint64(0)).astype(np.uint64)
                    prefixes.append(_signed((head & np.uint64(0xFFFFFFFFFFFFFF00)) | salt))
                flat = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, np.int64)])
                ends = np.cumsum([0] + [0 if p is None else len(p) for p in prefixes]).astype(np.int32)
                yield pa.record_batch(
                    [ids.cast(pa.int64()), column(part, "key"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(groups, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["doc_id", "key", "n", "cls", "grp", "prefix"],
                )

    return of


@trimmed
def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, grp): those whose token has several groups, each with the token's first group.

    A part of a split token stays even if it has one group: the other parts may have more.
    """
    lead: tuple[int, int, int] | None = None  # the first row of the run that is open
    passed = False  # it has been passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        token, grp, n = (batch.column(i).to_numpy() for i in range(3))
        if lead is not None:
            token, grp, n = (np.concatenate([[x], y]) for x, y in zip(lead, (token, grp, n), strict=True))
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.concatenate([starts, [len(token)]]))
        first = np.repeat(starts, length)
        stays = np.repeat(length > 1, length) | (token & 0xFF != 0)
        last = starts[-1]
        passed_now = bool(stays[last]) or (passed and last == 0)
        if passed:
            stays[0] = False
        lead, passed = (token[last], grp[last], n[last]), passed_now
        out = np.flatnonzero(stays)
        yield pa.record_batch([pa.array(x) for x in (token[out], grp[out], n[out], grp[first[out]], n[first[out]])], ["token", "grp", "n", "lead", "lead_n"])


@trimmed
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text_a", 2_000_000):
            keep = []
            for i, (x, y) in enumerate(zip(_sets(column(part, "text_a")), _sets(column(part, "text_b")), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= SIMILARITY * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.record_batch([column(part, "a"), column(part, "b")], ["a", "b"]).take(pa.array(keep, pa.int32()))


def _near_in_size(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {SIMILARITY} * greatest({a}, {b})"


def _may_pass(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose key may be among ``wanted``, by a bit table of fixed size; others never are."""
    words = 1 << (FILTER_BITS - 6)
    h = F.pmod(F.xxhash64("key"), F.lit(1 << FILTER_BITS))
    bits = wanted.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))
    table = np.zeros(words, np.uint64)
    rows = bits.collect()  # 2^18 rows at most
    table[[r.w for r in rows]] = np.array([r.bits & 0xFFFFFFFFFFFFFFFF for r in rows], np.uint64)

    def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = b.to_numpy()
            yield pa.array((table[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return docs.filter(F.arrow_udf(test, "boolean", F.ArrowUDFType.SCALAR_ITER)(h))


def _needed(na: str, nb: str) -> str:
    """Prefix shingles that two sets must share to reach the similarity, as SQL.

    Past the prefix that reaches less far at most n - p shingles can be common, so the rest of the
    least overlap must be among the prefix shingles that both have.
    """
    tail = lambda n: f"(ceil({SIMILARITY} * {n} / 100) - 1)"  # noqa: E731  n - p
    return f"ceil({SIMILARITY} * ({na} + {nb}) / {100 + SIMILARITY}) - greatest({tail(na)}, {tail(nb)})"


def _links_in_block(table: pa.Table) -> pa.Table:
    """Links within two blocks (or one) of a hot shingle's classes, counted exactly.

    Intersections of all pairs come from products of 0-1 matrices over the shingles that two or more
    classes have. Of the links only those that join components are given.
    """
    table = table.combine_chunks()
    cls, comp = table.column("cls").to_numpy(), table.column("comp").to_numpy()
    sets = _sets(pa.concat_arrays(table.column("text").chunks))
    size = np.array([len(x) for x in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    renumbered = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(sets)), size)
    keep = count[code] > 1
    owner, code = owner[keep], renumbered[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        x, y = np.searchsorted(code, [low, low + 2048])
        m = np.zeros((len(sets), 2048), np.float32)
        m[owner[x:y], code[x:y] - low] = 1
        both += m @ m.T
    linked = 100 * both >= SIMILARITY * (size[:, None] + size[None, :] - both)
    _, label = np.unique(comp, return_inverse=True)
    out = []
    for i in range(len(sets)):
        near = np.flatnonzero(linked[i])
        near = near[label[near] != label[i]]
        if len(near):
            others, first = np.unique(label[near], return_index=True)
            out += [(int(cls[i]), int(cls[j])) for j in near[first]]
            label[np.isin(label, others)] = label[i]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


class _Join:
    def __init__(self, docs: DataFrame) -> None:
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "jaccard")
        # the key finds a row's text again: the doc_id, or a hash of the text
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), _text_key()).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
        sketch = shingle_sketch(self.docs)
        rank = np.floor(4 * np.log2(sketch + 1)).astype(np.int16)
        parts = np.clip((sketch - 2 * int(np.median(sketch))) // PART_ROWS, 1, 254).astype(np.uint64)
        self.rows = self.scratch.write(self.docs.mapInArrow(_prefixes(rank, parts), "doc_id long, key long, n long, cls long, grp long, prefix array<long>"), "rows")
        full = self.rows.filter("cls is not null")
        self.classes = self.scratch.write(full.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min("doc_id"), F.min("key")).alias("key"), F.first("n").alias("n"), F.first("grp").alias("grp")), "classes")

    def index(self) -> DataFrame:
        """(token, grp, n, lead, lead_n) of all shingles that two or more groups have in their prefixes."""
        groups = self.rows.filter("cls is not null").groupBy("grp").agg(F.first("prefix").alias("prefix"), F.first("n").alias("n"))
        entries = groups.select(F.explode("prefix").alias("token"), "grp", "n")
        dealt = entries.repartition("token").sortWithinPartitions("token", "grp")
        return dealt.mapInArrow(_shared_runs, "token long, grp long, n long, lead long, lead_n long")

    def with_text(self, rows: DataFrame, *keys: str) -> DataFrame:
        """``rows`` with the text of the class in each of the columns ``keys``; only texts that rows name are dealt."""
        named = rows.select(F.explode(F.array(*keys)).alias("cls")).distinct()
        wanted = self.scratch.write(self.classes.join(named, "cls", "left_semi").select("cls", "key"), "wanted")
        texts = _may_pass(self.docs, wanted).join(wanted, "key").select("key", "cls", "text")
        # a key may stand on several texts: take the one that makes the class
        texts = texts.mapInArrow(_of_class, "cls long, text string").dropDuplicates(["cls"])
        if len(keys) > 1:
            texts = self.scratch.write(texts, "texts")
        for key in keys:
            rows = rows.join(texts.select(F.col("cls").alias(key), F.col("text").alias(f"text_{key}")), key)
        return rows

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs(a, b)`` of classes, those that reach the similarity."""
        pairs = self.scratch.write(pairs, "pairs")
        return self.with_text(pairs, "a", "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")

    def same_id(self) -> DataFrame:
        """Links (a, b) between the classes of one doc_id."""
        own = self.rows.filter("cls is not null and doc_id is not null").select("doc_id", "cls")
        several = own.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a <> z").select("doc_id", "a")
        return own.join(several, "doc_id").filter("cls <> a").select("a", F.col("cls").alias("b")).distinct()

    def run(self) -> DataFrame:
        """(cls, comp, comp_doc) of all classes; comp_doc: the smallest doc_id of the component, if it has one."""
        scratch = self.scratch
        runs = scratch.write(self.index(), "runs")
        shared = scratch.write(runs.groupBy("grp").agg(F.count(F.lit(1)).alias("shared")), "shared")
        member = scratch.write(self.classes.join(shared, "grp", "left").select("cls", "n", "grp", F.coalesce("shared", F.lit(0)).alias("shared")), "member")
        crowded = member.groupBy("grp").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).filter("first <> last")
        together = member.join(crowded.select("grp", "first"), "grp")  # classes of groups with several

        # a pair can't have more prefix shingles in common than either has in common with anyone
        size = shared.withColumnsRenamed({"grp": "lead", "shared": "lead_shared"})
        rep = self.classes.groupBy("grp").agg(F.min("cls").alias("cls"))
        best = (
            runs.filter(f"grp <> lead and {_near_in_size('n', 'lead_n')}").groupBy("grp", "n", "lead", "lead_n").count()
            .join(shared, "grp").join(size, "lead").filter(f"least(shared, lead_shared) >= {_needed('n', 'lead_n')}")
            .groupBy("grp").agg(F.max_by("lead", F.struct("count", F.col("lead"))).alias("lead"))
        )
        pairs = best.join(rep.withColumnRenamed("cls", "a"), "grp").join(rep.select(F.col("grp").alias("lead"), F.col("cls").alias("b")), "lead").select("a", "b")
        pairs = pairs.union(together.filter("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b")))
        links = scratch.write(self.links(pairs.filter("a <> b").distinct()).union(self.same_id()), "links")
        label = components(links, scratch)

        for last in (False, True):
            named = member.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n", "grp", "shared", F.coalesce("comp", "cls").alias("comp"))
            named = scratch.write(named, "named")
            open_ = self._open(runs, named)
            if last:
                # a group is one more token that its classes share; tokens that few have give pairs, those that many have are compared in blocks
                grouped = scratch.write(self._open_groups(named), "grouped")
                of_all = open_.select("token", "cls", "comp").union(grouped)
                count = scratch.write(of_all.groupBy("token").agg(F.count(F.lit(1)).alias("rows")), "count")
                hot, usual = count.filter(F.col("rows") >= HOT_ROWS), count.filter(F.col("rows") < HOT_ROWS)
                cold = open_.join(usual, "token", "left_semi")
                pairs = self._pairs(cold).union(self._pairs_in_groups(grouped.join(usual, "token", "left_semi")))
                more = self.links(pairs.distinct()).union(self._hot_links(of_all, hot))
            else:
                more = self.links(self._leader_pairs(open_).distinct())
            more = scratch.write(more, "links")
            if last:
                scratch.drop(grouped, count)
            links = scratch.write(links.union(more), "links")
            if not more.isEmpty():
                label = components(links, scratch)
            scratch.drop(open_, named)
        named = self.classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("comp", "cls").alias("comp"))
        low = named.groupBy("comp").agg(F.min("doc_id").alias("comp_doc"))
        out = scratch.write(named.join(low, "comp").select("cls", "comp", "comp_doc"), "result")
        scratch.drop(runs, shared, member, links)
        return out

    def _open(self, runs: DataFrame, named: DataFrame) -> DataFrame:
        """(token, cls, n, shared, comp) of shingles that classes of several components have."""
        rows = runs.select(F.col("token").bitwiseAND(F.lit(-256)).alias("token"), "grp").distinct()
        rows = rows.join(named, "grp").select("token", "cls", "n", "shared", "comp")
        several = rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
        return self.scratch.write(rows.join(several, "token", "left_semi"), "open")

    @staticmethod
    def _leader_pairs(open_: DataFrame) -> DataFrame:
        """For each class and seed the leader of another component that it shares most shingles with.

        A leader is a shingle's first class by a seeded hash; several seeds give a class several chances.
        """
        one = lambda seed: F.min_by(F.struct("cls", "comp", "n", "shared", F.lit(seed).alias("seed")), F.xxhash64("cls", F.lit(seed)))
        lead = open_.groupBy("token").agg(F.array(*[one(i) for i in range(LEADERS)]).alias("l")).select("token", F.explode("l").alias("l"))
        fits = f"comp <> l.comp and {_near_in_size('n', 'l.n')} and least(shared, l.shared) >= {_needed('n', 'l.n')}"
        counted = open_.join(lead, "token").filter(fits).groupBy("cls", "l.seed", F.col("l.cls").alias("b")).count()
        best = counted.groupBy("cls", "seed").agg(F.max_by("b", F.struct("count", F.col("b"))).alias("b"))
        return best.select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b"))

    @staticmethod
    def _pairs(cold: DataFrame) -> DataFrame:
        """Pairs of classes of different components whose shared prefix shingles leave the similarity in reach.

        Pairs that share hot shingles too are counted too low here; those are looked at by ``_hot_links``.
        """
        side = lambda x: cold.select("token", *[F.col(c).alias(c + x) for c in ("cls", "n", "shared", "comp")])
        fits = f"clsa < clsb and compa <> compb and {_near_in_size('na', 'nb')} and least(shareda, sharedb) >= {_needed('na', 'nb')}"
        pairs = side("a").join(side("b"), "token").filter(fits).groupBy("clsa", "clsb", "na", "nb").count()
        return pairs.filter(f"count >= {_needed('na', 'nb')}").select(F.col("clsa").alias("a"), F.col("clsb").alias("b"))

    @staticmethod
    def _open_groups(named: DataFrame) -> DataFrame:
        """(token, cls, comp) of the classes of groups that several components have; the token is the group."""
        several = named.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("grp")
        return named.join(several, "grp", "left_semi").select(F.col("grp").alias("token"), "cls", "comp")

    @staticmethod
    def _pairs_in_groups(grouped: DataFrame) -> DataFrame:
        """Pairs of different components within small groups: all their prefix shingles are the same."""
        x = grouped.select("token", F.col("cls").alias("a"), F.col("comp").alias("ca"))
        y = grouped.select("token", F.col("cls").alias("b"), F.col("comp").alias("cb"))
        return x.join(y, "token").filter("a < b and ca <> cb").select("a", "b")

    def _hot_links(self, open_: DataFrame, hot: DataFrame) -> DataFrame:
        """Links among the classes of shingles that very many have, block against block."""
        blocks = hot.select("token", F.ceil(F.col("rows") / HOT_BLOCK).cast("int").alias("blocks"))
        rows = open_.join(blocks, "token").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
        rows = self.scratch.write(rows.select("token", low, high, "cls", "comp"), "hot")
        full = self.with_text(rows, "cls").withColumnRenamed("text_cls", "text")
        return full.groupBy("token", "x", "y").applyInArrow(_links_in_block, "a long, b long")


@trimmed
def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets, classes = _sets(column(part, "text")), column(part, "cls").to_pylist()
            digest = [int.from_bytes(hashlib.blake2b(s.tobytes() + len(s).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True) for s in sets]
            keep = [i for i, (x, y) in enumerate(zip(digest, classes, strict=True)) if x == y]
            yield pa.record_batch([column(part, "cls"), column(part, "text")], ["cls", "text"]).take(pa.array(keep, pa.int32()))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, comp, comp_doc) of each row; an empty set has no comp, and the comp_doc of its doc_id."""
    join = _Join(docs)
    linked = join.rows.select("doc_id", "key", "n", "cls").join(join.run(), "cls", "left").select("doc_id", "key", "n", "comp", "comp_doc")
    full, empty = linked.filter("comp is not null"), linked.filter("comp is null")
    # other rows of an empty one's doc_id may have texts
    own = full.filter("doc_id is not null").join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("comp_doc").alias("own"))
    empty = empty.join(own, "doc_id", "left").select("doc_id", "key", "n", "comp", F.coalesce("own", "doc_id").alias("comp_doc"))
    return join.scratch.write(full.unionByName(empty), "labelled")


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    return _labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), F.col("comp_doc").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with its own columns.

    Of several rows with that doc_id those with different texts stay, equal ones become one. Of a component
    without any doc_id one row stays, and of rows without doc_id all whose sets are empty, as nothing is linked with them.
    """
    label = _labelled(docs)
    keep = label.filter("doc_id = comp_doc").select("doc_id").distinct()
    left = docs.join(keep, "doc_id", "left_semi").withColumn("_text_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    left = left.dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    nameless = label.filter("doc_id is null and comp_doc is null")
    one = nameless.filter("comp is not null").groupBy("comp").agg(F.min("key").alias("_key")).select("_key")
    empty = nameless.filter("comp is null").select(F.col("key").alias("_key")).distinct()
    rest = docs.filter("doc_id is null").withColumn("_key", _text_key())
    rest = rest.join(one, "_key", "left_semi").dropDuplicates(["_key"]).unionByName(rest.join(empty, "_key", "left_semi"))
    return left.select(docs.columns).unionByName(rest.select(docs.columns))
