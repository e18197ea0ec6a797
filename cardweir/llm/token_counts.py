"""Operator 11: token counts, exact for texts of any length, by overlap resynchronisation.

Texts of at most ``CHUNK`` characters are encoded as they are. A longer one is cut into chunks that overlap, and the
chunks are dealt to all executors, so no task encodes a huge text alone. Each chunk is encoded with offsets. Two
neighbours are spliced at the first place of their overlap where a piece of text (what the vocabulary's pattern
cuts a text into before any merge) starts in both. That place is proven stable:

* the pattern is matched from left to right and never looks back, so from a start that both scans share on, both cut
  alike, and merges never leave a piece;
* a match looks one character ahead at most and a special token is found wherever it lies whole, so a start of the left
  chunk holds if ``margin`` characters of that chunk follow it: the longest special token and two more.

The count is the sum over chunks less what each pair counts outside its splice. A text with a pair that shares no such place
(a run of letters or blanks longer than the overlap) is cut again with an overlap ``WIDER`` times as wide and chunks to match,
until every pair fits or one chunk holds the text. The proof needs a vocabulary file without normaliser, with the byte-level pattern
and special tokens that take no blanks along (``resyncs``); other files, and sentencepiece models, are given whole texts.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Each row gives one row, repeated ids and null ids too; equal
long texts are encoded once. Strings of special tokens inside a text count as the library's default has it: one token each.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweir.llm.common import Scratch, column, slices
from cardweir.llm.tokens import TOKENIZER, tokenizer_path

LIMIT = 512
#: Characters of a chunk, of the overlap at first, and how much wider each further overlap is.
CHUNK, OVERLAP, WIDER = 32_768, 256, 8
_ROW = "key string, chunk int, total long, heads array<struct<place: long, spare: long>>, tails array<struct<place: long, spare: long>>"


class Counter:
    """A tokenizer file in its own library, and what is known of its cuts."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            self.margin = None
            model = SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.margin = resyncs(json.loads(self.tokenizer.to_str()))
        self.lengths = lambda texts: [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of tokens; characters where pieces start, and the tokens before each."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        piece = np.array(e.word_ids, np.int64)
        at = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else np.zeros(0, np.int64)
        offsets = e.offsets
        return len(piece), np.array([offsets[i][0] for i in at.tolist()], np.int64), at


def resyncs(settings: dict) -> int | None:
    """The margin that makes a shared start stable, or None where the proof does not hold."""
    own = settings.get("pre_tokenizer") or {}
    plain = own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space", True)
    special = settings.get("added_tokens") or []
    apart = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in special)
    if settings.get("normalizer") or settings.get("post_processor") or not plain or not apart:
        return None
    return max([len(t["content"]) for t in special], default=0) + 2


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker's counter; tasks of one worker share it."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def spans(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Where the chunks of a text start and end; each but the last reaches ``overlap`` into the next."""
    n = max(1, -(-(length - overlap) // chunk))
    return [(i * chunk, min(length, (i + 1) * chunk + overlap)) for i in range(n)]


def _places(place: np.ndarray, spare: np.ndarray) -> list[dict]:
    return [{"place": int(p), "spare": int(s)} for p, s in zip(place, spare, strict=True)]


def _resync(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of long texts; n_tokens is null where a pair of chunks shares no stable start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, text = column(batch, "key")[i].as_py(), column(batch, "text")[i].as_py()
                at = spans(len(text), chunk, overlap)
                for some in range(0, len(at), 64):  # a few chunks at a time, whatever the text's length
                    part = list(enumerate(at[some : some + 64], some))
                    yield pa.record_batch([
                        pa.array([key] * len(part)), pa.array([k for k, _ in part], pa.int32()), pa.array([s for _, (s, _) in part], pa.int64()),
                        pa.array([k == len(at) - 1 for k, _ in part]), pa.array([text[s:e] for _, (s, e) in part]),
                    ], ["key", "chunk", "start", "last", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            key, number, start, last, text = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                t, s, k = text[i].as_py(), start[i].as_py(), number[i].as_py()
                total, place, before = own.starts(t)
                head = (place <= overlap - own.margin) if k else np.zeros(len(place), bool)
                tail = (place >= chunk) & (place <= len(t) - own.margin) if not last[i].as_py() else np.zeros(len(place), bool)
                yield pa.record_batch([
                    key.slice(i, 1), number.slice(i, 1), pa.array([total], pa.int64()),
                    pa.array([_places(s + place[head], before[head])], pa.list_(pa.struct([("place", pa.int64()), ("spare", pa.int64())]))),
                    pa.array([_places(s + place[tail], total - before[tail])], pa.list_(pa.struct([("place", pa.int64()), ("spare", pa.int64())]))),
                ], ["key", "chunk", "total", "heads", "tails"])

    pieces = texts.mapInArrow(cut, "key string, chunk int, start long, last boolean, text string").dropDuplicates(["key", "chunk"])
    return pieces.mapInArrow(encode, _ROW)


def _spliced(encoded: DataFrame) -> DataFrame:
    sides = encoded.select("key", F.col("chunk").alias("pair"), F.inline("tails")).union(
        encoded.select("key", (F.col("chunk") - 1).alias("pair"), F.inline("heads"))
    )
    shared = sides.groupBy("key", "pair", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("spare").alias("spare")).filter("n = 2")
    splices = shared.groupBy("key", "pair").agg(F.min_by("spare", "place").alias("spare"))
    out = splices.groupBy("key").agg(F.count(F.lit(1)).alias("met"), F.sum("spare").alias("spare"))
    sums = encoded.groupBy("key").agg(F.sum("total").alias("total"), F.max("chunk").alias("pairs"))
    fits = F.coalesce("met", F.lit(0)) == F.col("pairs")
    return sums.join(out, "key", "left").select("key", F.when(fits, F.col("total") - F.coalesce("spare", F.lit(0))).alias("n_tokens"))


def count_tokens(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    path = tokenizer_path(name)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long_ = F.lit(counter(path).margin is not None) & (F.length("text") > chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n = own.lengths(column(part, "text").to_pylist())
                yield pa.record_batch([column(part, "doc_id"), column(part, "n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    measured = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    short = measured.filter(~long_).mapInArrow(whole, f"doc_id {kind}, n_bytes long, n_tokens long")
    keyed = measured.filter(long_).withColumn("key", F.sha2("text", 256))
    scratch, counts, left = Scratch(docs.sparkSession, "counts"), [], keyed.select("key", "text")
    while True:
        encoded = scratch.write(_resync(left, path, chunk, overlap), "chunks")
        done = scratch.write(_spliced(encoded), "counts")
        scratch.drop(encoded)
        counts.append(done.filter("n_tokens IS NOT NULL"))
        failed = done.filter("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            break
        overlap *= WIDER
        chunk = max(chunk, 2 * overlap)
        left = keyed.select("key", "text").join(failed, "key", "left_semi")
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    whole_rows = short.unionByName(keyed.select("doc_id", "n_bytes", "key").join(found, "key").select("doc_id", "n_bytes", "n_tokens"))
    return whole_rows.withColumn("over_limit", F.col("n_tokens") > limit)
