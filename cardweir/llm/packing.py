"""Operator 3: best-fit packing of documents into sequences by minimum bin slack.

A document's ids and an end id make one piece, or pieces of ``capacity`` ids if it is longer (the
first takes what is left over). Which pieces go together depends on their lengths only, and there are
at most ``capacity`` different ones, so the histogram of lengths is solved on the driver whatever the
size of the corpus: for each bin the longest length left is set, a bitset subset-sum over the
available lengths finds the fullest combination, and it is taken out as often as all its lengths last.
The patterns are then laid out over the pieces: pieces of a length are numbered on the executors,
by counts of (bucket, length) and running sums over buckets, and a table of the patterns' slots, whose
size depends on ``capacity`` alone, is broadcast to turn a number into a sequence and an offset.

Defined cases: null and empty texts are one piece with the end id only; repeated rows are packed once
each; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardweir.llm.common import Scratch, column, slices, trimmed
from cardweir.llm.tokens import REMEMBERED, encode_column, forget, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Pieces of one bucket, within which pieces of a length are numbered by one task.
BUCKET_PIECES = 2000
MOST_BUCKETS = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of each document; ``ids`` (little-endian unsigned 32-bit) on request."""
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    @trimmed
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[list] = [[] for _ in names]
                for doc_id, ids in zip(column(part, "doc_id").to_pylist(), encode_column(column(part, "text"), path, remembered), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at = 0
                    for piece, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        own = ids[4 * at : 4 * stop]
                        for values, v in zip(rows, (doc_id, piece, at, stop - at, zlib.crc32(own), own), strict=False):
                            values.append(v)
                        at = stop
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(rows, types, strict=False)], names)
        forget(remembered)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(of, PIECES + ", ids binary" * with_ids)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """Of so many pieces of each length the combination with the largest sum up to ``room``; long ones first."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(available, reverse=True):
        left, times = min(available[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... and the rest make every number of them
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach >> room:
            break
    target = reach.bit_length() - 1
    out: dict[int, int] = {}
    for before, length, times in reversed(steps):
        if not before >> target & 1:
            out[length] = out.get(length, 0) + times
            target -= length * times
    return out


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how often each is used, until no piece is left."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        pattern = fullest({k: v for k, v in rest.items() if v and k <= capacity - seed}, capacity - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[k] // m for k, m in pattern.items())
        for k, m in pattern.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        out.append((pattern, times))
    return out


def slots(found: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end, pieces in a sequence, first sequence, offset of the first) by pattern and length."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in found:
        offset = 0
        for length in sorted(pattern, reverse=True):
            m = pattern[length]
            at = used.get(length, 0)
            out.append((length, at, at + m * times, m, sequence, offset))
            used[length] = at + m * times
            offset += m * length
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the pieces are written to the shared folder first."""
    scratch = Scratch(pieces.sparkSession, "packing")
    pieces = scratch.write(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table = slots(patterns(counts, capacity))
    slot = pieces.sparkSession.createDataFrame(table or [(0, 0, 0, 1, 0, 0)], "l long, low long, high long, m long, first long, base long")

    buckets = min(MOST_BUCKETS, -(-sum(counts.values()) // BUCKET_PIECES) or 1)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.rand(7)), F.lit(buckets)))
    rows = scratch.write(rows, "dealt") if buckets > 1 else rows.withColumn("_bucket", F.lit(0))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("_own", F.row_number().over(own)).join(offsets, ["length", "_bucket"]).withColumn("_no", F.col("_before") + F.col("_own") - 1)
    placed = numbered.join(F.broadcast(slot), (F.col("length") == F.col("l")) & (F.col("_no") >= F.col("low")) & (F.col("_no") < F.col("high")))
    at = F.col("_no") - F.col("low")
    sequence = F.col("first") + F.floor(at / F.col("m")).cast("long")
    offset = F.col("base") + F.pmod(at, F.col("m")) * F.col("length")
    return placed.select(*pieces.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """``remembered``: pieces of text whose ids each worker keeps, memory for time."""
    return pack(token_pieces(docs, path or tokenizer_path(), remembered=remembered))
