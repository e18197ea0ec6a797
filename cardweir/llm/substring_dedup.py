"""Operator 1: removal of repeated word sequences with prefix-partitioned suffix trees.

A suffix starts at each word that has at least 12 more words after it. Two suffixes that agree on 13
words meet in an internal node of depth 13 or more of the corpus' suffix tree; the leaves below such
a node are the places of a repeat, and a run of adjacent places is a maximal repeat.

1. Counts of all prefixes of 1, 2, 4, 8 and 13 words, in tables of fixed size, give each suffix the
   shortest prefix whose suffixes fit a group's memory. Prefix groups are binned to ``GROUP_SUFFIXES``.
2. Most suffixes are leaves right below the root's branches and have no deep node. They are pruned:
   each 13-word window has one anchor, the least hash of its 7-grams, equal windows have equal
   anchors, and a window stays only if its anchor occurs in two documents. A quarter of the places are anchors.
3. The suffixes left go to their prefix's group. There the subtree is built by sorting its paths, kept
   as a node at depth 8 (64 bits) and the edge from it to depth 13 (32 bits); each node at depth 13
   marks its leaves in all documents but the smallest.
4. Marks return to their documents, whose words are kept or removed.

A passage that more than ``HOT_SUFFIXES`` documents share would fill one group: its smallest document
is found by partial aggregation over blocks instead, and joined to the blocks' own leaves. Which way
a node goes does not change results. 96 bits of a path are random hashes: two different sequences
meet with a chance of 1e-3 among 1e13 windows.

Rows travel packed: documents of one bucket and suffixes of one group share a row.

Defined cases: null and empty texts have no words and keep the digest of the empty string; a repeat
within one document only stays; rows that share a doc_id don't remove each other's words; rows
without doc_id come after all others: they lose what others have and remove nothing. Empty tables
give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweir.llm.common import Block, Hasher, column, mix64, slices
from cardweir.llm.sketch import count_table

WINDOW = 13
_DEPTHS = (1, 2, 4, 8, 13)
_GRAM = 7
_ANCHORS = WINDOW - _GRAM + 1
_TABLE = 1 << 16
#: Suffixes of a group, bytes of text of a bucket of documents, suffixes from which a node is hot.
GROUP_SUFFIXES, BUCKET_BYTES, HOT_SUFFIXES = 1_000_000, 6_000_000, 1_000_000
_NO_ID = (1 << 63) - 1

_HASH, _EDGE = Hasher(1), Hasher(11)


class _Suffixes:
    """Hashes of the suffixes of some documents."""

    def __init__(self, texts: pa.Array) -> None:
        self.block = b = Block(texts)
        words = _HASH.words(b.data, b.starts, b.ends)
        count = np.diff(b.first)
        n = max(0, len(words) - WINDOW + 1)
        left = np.repeat(b.first[1:], count) - np.arange(len(words))  # words to the document's end
        #: Places with 13 words, and the word's place in its document.
        self.at = np.flatnonzero(left[:n] >= WINDOW)
        self.doc = b.doc[self.at]
        self.place = (self.at - b.first[self.doc]).astype(np.int64)
        self.words = words

    def prefix(self, size: int) -> np.ndarray:
        return _HASH.windows(self.words, size)[self.at]

    def paths(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node at depth 8 and the edge to depth 13 of chosen suffixes."""
        edge = _EDGE.windows(self.words, WINDOW - 8)[self.at[which] + 8]
        return _EDGE.windows(self.words, 8)[self.at[which]], (edge >> np.uint64(32)).astype(np.uint32)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the anchors, their positions among all words, and each suffix's anchor (index of the first two)."""
        grams = _HASH.windows(self.words, _GRAM)
        best, where = grams[self.at], self.at.copy()
        for k in range(1, _ANCHORS):
            h = grams[self.at + k]
            less = h < best
            best = np.where(less, h, best)
            where = np.where(less, self.at + k, where)
        position, own = np.unique(where, return_inverse=True)
        return grams[position] if len(position) else np.zeros(0, np.uint64), position, own


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Integers by their bytes' rank, compressed."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unsqueeze(data: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out, at = [], 0
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


_HEAD = struct.Struct("<III")


def _pack(doc: np.ndarray, place: np.ndarray, ids: np.ndarray, extra: np.ndarray, raw: bytes = b"") -> bytes:
    """Entries (document index, place) in order of the index, the ids and a further number of the documents, fixed-size raw data."""
    used, own = np.unique(doc, return_inverse=True)
    body = _squeeze(np.diff(ids[used], prepend=0), extra[used].astype(np.int32), np.diff(own, prepend=0).astype(np.int32), place.astype(np.int32))
    return _HEAD.pack(len(used), len(doc), len(body)) + body + raw


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    docs, n, size = _HEAD.unpack_from(data)
    ids, extra, own, place = _unsqueeze(data[_HEAD.size : _HEAD.size + size], (np.int64, docs), (np.int32, docs), (np.int32, n), (np.int32, n))
    return np.cumsum(own), place, np.cumsum(ids), extra, data[_HEAD.size + size :]


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of a key with the places that have it, in order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(key[part[0]]), part


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _several_docs(table: pa.Table) -> pa.Table:
    """Of a range of anchors: the places of those that stand in two or more documents, by bucket."""
    hashes, ids, places, buckets = [], [], [], []
    for data in table.column("data").to_pylist():
        doc, place, own, bucket, raw = _unpack(data)
        hashes.append(np.frombuffer(raw, np.uint64)), ids.append(own[doc]), places.append(place), buckets.append(bucket[doc])
    h, doc_id, place, bucket = (np.concatenate(x) for x in (hashes, ids, places, buckets))
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    ordered = doc_id[order]
    several = np.minimum.reduceat(ordered, starts) != np.maximum.reduceat(ordered, starts)
    keep = np.zeros(len(h), bool)
    keep[order[np.repeat(several, np.diff(np.append(starts, len(h))))]] = True
    out = []
    for b, part in _by(bucket[keep]):
        own_ids, own_place = doc_id[keep][part], place[keep][part]
        distinct, index = np.unique(own_ids, return_inverse=True)
        order = np.argsort(index, kind="stable")
        out.append((b, _pack(index[order], own_place[order], distinct, np.zeros(len(distinct)))))
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "data": pa.array([x[1] for x in out], pa.binary())})


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A bucket's documents in a fixed order: ids, ordinal among rows of an id, texts."""
    table = table.select(["doc_id", "text_key", "text"]).sort_by([("doc_id", "ascending"), ("text_key", "ascending")]).combine_chunks()
    ids = table.column("doc_id").to_numpy()
    first = np.searchsorted(ids, ids)
    chunks = table.column("text").chunks
    return ids, (np.arange(len(ids)) - first).astype(np.int64), chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks or [pa.array([], pa.string())])


def _parts(texts: pa.Array, ids: np.ndarray, ordinal: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    batch = pa.record_batch([texts, pa.array(ids), pa.array(ordinal)], ["text", "doc_id", "ordinal"])
    for part in slices(batch, "text"):
        yield part.column(0), part.column(1).to_numpy(), part.column(2).to_numpy()


class _Dedup:
    def __init__(self, docs: DataFrame, group_suffixes: int, hot_suffixes: int) -> None:
        self.spark = docs.sparkSession
        text = F.coalesce("text", F.lit(""))
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), text.alias("text"))
        n = len(_DEPTHS) * _TABLE

        def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
            for part in slices(batch, "text"):
                s = _Suffixes(column(part, "text"))
                for i, depth in enumerate(_DEPTHS):
                    total[i * _TABLE : (i + 1) * _TABLE] += np.bincount(_slot(s.prefix(depth)), minlength=_TABLE)
                total[n : n + _TABLE] += np.bincount(_slot(s.anchors()[0]), minlength=_TABLE)
                total[n + _TABLE] += len(s.block.data)

        total = count_table(rows.select("text"), add, n + _TABLE + 1)
        tables = total[: n + _TABLE].reshape(len(_DEPTHS) + 1, _TABLE)
        usual = 2 * np.median(tables, axis=1).astype(np.int64)[:, None]
        suffixes, anchors = int(tables[0].sum()), int(tables[-1].sum())
        #: Slots of prefixes, by depth, that need a longer prefix; slots of hot windows and anchors.
        self.long = tables[:-2] > usual[:-2] + group_suffixes // 4
        self.hot_window, self.hot_anchor = (tables[i] > usual[i] + hot_suffixes for i in (-2, -1))
        self.any_hot = bool(self.hot_window.any())
        self.groups = max(1, -(-suffixes // group_suffixes))
        self.ranges = max(1, -(-anchors // group_suffixes))
        self.buckets = max(1, -(-int(total[-1]) // BUCKET_BYTES))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        self.rows = rows.withColumn("bucket", bucket)
        self.dealt = self.rows.withColumn("text_key", F.xxhash64("text")).groupBy("bucket")

    def anchors(self) -> DataFrame:
        """Places of anchors that several documents have, by bucket; hot ones are left out, they always count."""
        ranges, hot = self.ranges, self.hot_anchor

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 6_000_000):
                    s = _Suffixes(column(part, "text"))
                    h, position, _ = s.anchors()
                    doc = np.searchsorted(s.block.first, position, side="right") - 1
                    keep = np.flatnonzero(~hot[_slot(h)])
                    h, doc, place = h[keep], doc[keep], (position - s.block.first[doc])[keep]
                    ids, bucket = column(part, "doc_id").to_numpy(), column(part, "bucket").to_numpy()
                    rows = [(r, _pack(doc[at], place[at], ids, bucket, h[at].tobytes())) for r, at in _by((mix64(h) % np.uint64(ranges)).astype(np.int64))]
                    yield _rows(rows, ["range", "data"], [pa.int64(), pa.binary()])

        packed = self.rows.mapInArrow(of, "range long, data binary")
        return packed.groupBy("range").applyInArrow(_several_docs, "bucket int, data binary")

    def suffixes(self, anchors: DataFrame, hot: bool) -> DataFrame:
        """Suffixes with a repeated anchor, by prefix group; or those of hot nodes, by node."""
        groups, long, hot_window, hot_anchor = self.groups, self.long, self.hot_window, self.hot_anchor

        def of(texts: pa.Table, found: pa.Table) -> pa.Table:
            wanted = []
            for data in found.column("data").to_pylist():
                doc, place, own, _, _ = _unpack(data)
                wanted.append(np.column_stack([own[doc], place]))
            listed = np.concatenate(wanted) if wanted else np.zeros((0, 2), np.int64)
            listed = listed[np.lexsort((listed[:, 1], listed[:, 0]))]
            rows = []
            bucket = texts.column("bucket")[0].as_py() if len(texts) else 0
            for text, ids, ordinal in _parts(*(lambda i, o, t: (t, i, o))(*_texts(texts))):
                s = _Suffixes(text)
                h, position, own = s.anchors()
                doc = np.searchsorted(s.block.first, position, side="right") - 1
                keep = hot_anchor[_slot(h)] | _among(listed, ids[doc], position - s.block.first[doc])
                which = np.flatnonzero(keep[own]) if len(own) else np.zeros(0, np.int64)
                is_hot = hot_window[_slot(s.prefix(WINDOW)[which])]
                which = which[is_hot == hot]
                if not len(which):
                    continue
                node, edge = s.paths(which)
                if hot:
                    for _, at in _by(_ranked(node, edge)):
                        key = node[at[0]].tobytes() + edge[at[0]].tobytes()
                        low = int(ids[s.doc[which[at]]].min())
                        rows.append((key, low, bucket, _pack(s.doc[which[at]], s.place[which[at]], ids, ordinal)))
                    continue
                group = np.zeros(len(which), np.uint64)
                open_ = np.ones(len(which), bool)
                for i, depth in enumerate(_DEPTHS):
                    prefix = s.prefix(depth)[which]
                    ends = open_ & (True if i == len(long) else ~long[i][_slot(prefix)])
                    group[ends] = prefix[ends]
                    open_ &= ~ends
                for g, at in _by((mix64(group) % np.uint64(groups)).astype(np.int64)):
                    rows.append((g, bucket, _pack(s.doc[which[at]], s.place[which[at]], ids, ordinal, node[at].tobytes() + edge[at].tobytes())))
            names = ["node", "low", "bucket", "data"] if hot else ["grp", "bucket", "data"]
            types = [pa.binary(), pa.int64(), pa.int32(), pa.binary()] if hot else [pa.int64(), pa.int32(), pa.binary()]
            return pa.Table.from_batches([_rows(rows, names, types)])

        schema = "node binary, low long, bucket int, data binary" if hot else "grp long, bucket int, data binary"
        return self.dealt.cogroup(anchors.groupBy("bucket")).applyInArrow(of, schema)

    def marks(self) -> DataFrame:
        """Places of removed windows, by bucket."""
        anchors = self.anchors()
        out = self.suffixes(anchors, False).groupBy("grp").applyInArrow(_subtree, "bucket int, data binary")
        if not self.any_hot:
            return out
        hot = self.suffixes(anchors, True)
        low = hot.groupBy("node").agg(F.min("low").alias("first"))
        return out.unionByName(hot.join(low, "node").select("bucket", "first", "data").mapInArrow(_later, "bucket int, data binary"))

    def result(self) -> DataFrame:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>"
        return self.dealt.cogroup(self.marks().groupBy("bucket")).applyInArrow(_cut, schema)


def _ranked(node: np.ndarray, edge: np.ndarray) -> np.ndarray:
    order = np.lexsort((edge, node))
    new = np.concatenate([[False], (node[order][1:] != node[order][:-1]) | (edge[order][1:] != edge[order][:-1])])
    out = np.empty(len(node), np.int64)
    out[order] = np.cumsum(new)
    return out


def _among(listed: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each (id, place) is in the sorted list."""
    if not len(listed):
        return np.zeros(len(ids), bool)
    known, start = np.unique(listed[:, 0], return_index=True)
    own = np.searchsorted(known, ids)
    there = (own < len(known)) & (known[np.minimum(own, len(known) - 1)] == ids)
    key = lambda rank, p: rank * (1 << 32) + p
    keys = key(np.repeat(np.arange(len(known)), np.diff(np.append(start, len(listed)))), listed[:, 1])
    mine = key(own, place)
    at = np.searchsorted(keys, mine)
    return there & (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == mine)


def _subtree(table: pa.Table) -> pa.Table:
    """The nodes at depth 13 of one prefix group: their leaves outside the smallest document, by bucket."""
    nodes, edges, ids, ordinals, places, buckets = [], [], [], [], [], []
    for bucket, data in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True):
        doc, place, own, ordinal, raw = _unpack(data)
        n = len(doc)
        nodes.append(np.frombuffer(raw, np.uint64, n)), edges.append(np.frombuffer(raw, np.uint32, n, 8 * n))
        ids.append(own[doc]), ordinals.append(ordinal[doc]), places.append(place), buckets.append(np.full(n, bucket, np.int32))
    node, edge, doc_id, ordinal, place, bucket = (np.concatenate(x) for x in (nodes, edges, ids, ordinals, places, buckets))
    rank = _ranked(node, edge)
    low = np.full(rank.max() + 1, _NO_ID, np.int64)
    np.minimum.at(low, rank, doc_id)
    later = np.flatnonzero(doc_id > low[rank])
    return _marks(doc_id[later], ordinal[later], place[later], bucket[later])


def _marks(doc_id: np.ndarray, ordinal: np.ndarray, place: np.ndarray, bucket: np.ndarray) -> pa.Table:
    out = []
    for b, at in _by(bucket):
        order = at[np.lexsort((place[at], ordinal[at], doc_id[at]))]
        ids, ords = doc_id[order], ordinal[order]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (ords[1:] != ords[:-1])])
        first = np.flatnonzero(new)
        out.append((b, _pack(np.cumsum(new) - 1, place[order], ids[first], ords[first])))
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "data": pa.array([x[1] for x in out], pa.binary())})


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for bucket, first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            doc, place, own, ordinal, _ = _unpack(data)
            at = np.flatnonzero(own[doc] > first)
            if len(at):
                rows.append((bucket, _pack(doc[at], place[at], own, ordinal)))
        yield _rows(rows, ["bucket", "data"], [pa.int32(), pa.binary()])


def _cut(texts: pa.Table, found: pa.Table) -> pa.Table:
    """Each document of a bucket without the words that marked windows cover."""
    parts = []
    for data in found.column("data").to_pylist():
        doc, place, own, ordinal, _ = _unpack(data)
        parts.append(np.column_stack([own[doc], ordinal[doc], place]))
    marks = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    marks = marks[np.lexsort((marks[:, 2], marks[:, 1], marks[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (marks[1:, :2] != marks[:-1, :2]).any(1)])) if len(marks) else np.zeros(0, np.int64)
    of = {(int(marks[i, 0]), int(marks[i, 1])): marks[i:j, 2] for i, j in zip(new, np.append(new, len(marks))[1:], strict=True)}
    rows = []
    for text, ids, ordinal in _parts(*(lambda i, o, t: (t, i, o))(*_texts(texts))):
        b = Block(text)
        data = b.data.tobytes()
        for d in range(b.n):
            first, last = int(b.first[d]), int(b.first[d + 1])
            n = last - first
            places = of.get((int(ids[d]), int(ordinal[d])))
            gone = np.zeros(n + 1, np.int64)
            if places is not None:
                np.add.at(gone, places, 1)
                np.add.at(gone, places + WINDOW, -1)
            covered = np.cumsum(gone)[:n] > 0
            keep = np.flatnonzero(~covered) + first
            digest = hashlib.sha256(b" ".join([data[x:y] for x, y in zip(b.starts[keep].tolist(), b.ends[keep].tolist(), strict=True)])).hexdigest()
            edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
            spans = [{"first": x, "last": y - 1} for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
            rows.append((None if ids[d] == _NO_ID else int(ids[d]), n, int(covered.sum()), digest, spans))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
    return pa.Table.from_batches([_rows(rows, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"], types)])


def remove_repeats(docs: DataFrame, group_suffixes: int = GROUP_SUFFIXES, hot_suffixes: int = HOT_SUFFIXES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans); spans: the maximal runs of removed words."""
    return _Dedup(docs, group_suffixes, hot_suffixes).result()
