"""Operator 12: ranked lexical search of stated items by an Aho-Corasick scan of all documents.

No index of the documents is built: the terms of the items make one automaton, and each text runs through it. Terms stand in it
between guards (one blank on either side), and a text is scanned with every separator turned into a blank, so a term matches as
a whole word only; guards may overlap, as the automaton reports every match. Each match is one occurrence, so term frequencies
come straight from the text. An output of the automaton is a term's number, and a table maps it to the items that hold
the term and how often.

Two scans: the first counts, for the whole corpus, documents, terms and in how many documents each item term stands; the second
scores. Each task keeps the ``TOP`` best documents of every item and passes on no more; these lists are merged in two
steps. What is broadcast has a bound: items are dealt by their id into blocks of about ``TERM_BYTES`` of text, each with its own automaton
and its own two scans, so many items cost more scans and not more memory.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z in lower case. With N documents that have a term,
L terms in them all, a document's length n, df and tf: w = floor(1000 ln((2N+2)/(2df+1))), m = 75 + 25nN div L, and a term adds
w ((10^9 tf) div (1000 tf + 12 m)) for each time it stands in the item, in 64-bit integers.

Defined cases: null, empty and term-less texts count nowhere and are found by nothing; items without terms give no rows. Rows that share
an item_id (or have none) are one item with all their terms. Documents that share a doc_id are documents of their own; one without doc_id
comes after all others with its score. Ties go to the smaller doc_id. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardweir.llm.common import Block, column, slices

TOP = 20
#: Item text behind one automaton; at some 60 bytes a node that is 60 MB at most, and less where terms share beginnings.
TERM_BYTES = 1_000_000
#: Scores held at once: documents of a block times items.
_CELLS = 2_000_000
_NO_ID = (1 << 63) - 1
#: Scores of equal rank are merged within so many parts of an item before the last merge.
_MERGERS = 32

_BYTES = np.arange(256)
#: ASCII characters other than letters and digits.
SEPARATES = (_BYTES < 0x80) & ~(((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)))
_SCANNED = bytes(0x20 if SEPARATES[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def plain(text: str | None) -> str:
    """The text as it is scanned: lower case, one blank for each separator, a blank before and after."""
    return " " + (text or "").encode().translate(_SCANNED).decode() + " "


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(column(batch, "item_id").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            words = [w for w in plain(text).split(" ") if w]
            yield pa.record_batch([pa.array([item] * len(words), pa.int64()), pa.array(words, pa.string())], ["item_id", "term"])


class Items:
    """Some items: the automaton of their terms, and by term the items that hold it and how often."""

    def __init__(self, rows: pa.Table) -> None:
        import ahocorasick

        self.ids = sorted(set(rows.column("item_id").to_pylist()), key=lambda x: (x is None, x))
        at = {item: i for i, item in enumerate(self.ids)}
        terms = rows.column("term").to_pylist()
        self.terms = sorted(set(terms))
        number = {t: i for i, t in enumerate(self.terms)}
        self.automaton = ahocorasick.Automaton()
        for t, i in number.items():
            self.automaton.add_word(f" {t} ", i)
        if self.terms:
            self.automaton.make_automaton()
        term = np.array([number[t] for t in terms], np.int64)
        order = np.argsort(term, kind="stable")
        self.list_item = np.array([at[i] for i in rows.column("item_id").to_pylist()], np.int64)[order]
        self.list_times = rows.column("times").to_numpy()[order].astype(np.int64)
        self.list = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def counts(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of the documents; document, term and tf of each pair."""
        texts = column(part, "text")
        length = np.diff(Block(texts, apart=SEPARATES).first)
        doc, term, tf = [], [], []
        for i in np.flatnonzero(length).tolist():
            found = np.array([x for _, x in self.automaton.iter(plain(texts[i].as_py()))], np.int64)
            which, times = np.unique(found, return_counts=True)
            doc.append(np.full(len(which), i))
            term.append(which)
            tf.append(times)
        none = [np.zeros(0, np.int64)]
        return length, *(np.concatenate(x or none) for x in (doc, term, tf))


class Best:
    """The k best documents of each item seen so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: documents by items."""
        d, item = np.nonzero(scores >= self.least)
        item, doc, score = (np.concatenate(x) for x in ((self.item, item), (self.doc, ids[d]), (self.score, scores[d, item])))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, np.arange(len(self.least)))[item]
        keep = place < self.k
        self.item, self.doc, self.score = item[keep], doc[order][keep], score[order][keep]
        held = np.bincount(self.item, minlength=len(self.least))
        last = np.cumsum(held) - 1
        full = held == self.k
        self.least[full] = self.score[last[full]]


def _scan(docs: DataFrame, shared, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of items."""

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        df, documents, total = np.zeros(len(items.terms), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                length, _, term, _ = items.counts(part)
                df += np.bincount(term, minlength=len(df))
                documents, total = documents + int((length > 0).sum()), total + int(length.sum())
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [documents, total]))], ["term", "n"])

    counted = {r.term: r.n for r in docs.select("text").mapInArrow(statistics, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, total = counted.pop(-1, 0), counted.pop(-2, 0)
    weight = np.zeros(len(shared.value.terms), np.int64)
    for term, df in counted.items():
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        n, best = len(items.ids), Best(len(items.ids), k)
        size = np.diff(items.list)
        rows = max(1, _CELLS // max(n, 1))
        for batch in batches:
            for block in slices(batch, "text"):
                for at in range(0, len(block), rows):
                    part = block.slice(at, rows)
                    length, doc, term, tf = items.counts(part)
                    m = 75 + (25 * length * documents) // max(total, 1)
                    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                    many = size[term]
                    where = np.arange(int(many.sum())) + np.repeat(items.list[term] - (np.cumsum(many) - many), many)
                    scores = np.zeros((len(part), n), np.int64)
                    np.add.at(scores, (np.repeat(doc, many), items.list_item[where]), np.repeat(value, many) * items.list_times[where])
                    best.add(scores, column(part, "doc_id").to_numpy())
        yield pa.record_batch([pa.array([items.ids[i] for i in best.item.tolist()], pa.int64()), pa.array(best.doc), pa.array(best.score)], ["item_id", "doc_id", "score"])

    order = [F.desc("score"), F.col("doc_id")]
    found = docs.mapInArrow(score, "item_id long, doc_id long, score long").withColumn("part", F.spark_partition_id() % _MERGERS)
    for by in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def search_items(docs: DataFrame, items: DataFrame, k: int = TOP, term_bytes: int = TERM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // term_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        terms = own.mapInArrow(_item_terms, "item_id long, term string").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")).toArrow()
        if len(terms):
            out = out.unionByName(_scan(rows, spark.sparkContext.broadcast(Items(terms)), k))
    return out
