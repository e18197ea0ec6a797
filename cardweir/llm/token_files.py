"""Operator 5: token ids of documents in binary files of independent zstandard frames.

One file (numbers little-endian unless said otherwise):

    frames        each a zstandard frame of the ids (uint32) of some documents, with zstandard's content
                  checksum; frames do not depend on each other
    index frame   zstandard frame with doc_id (int64) and id count (uint32) of each document, in order
    seek table    skippable frame (magic 0x184D2A5E, uint32 size) of
                    a row for each frame: compressed size, raw size, documents (3 x uint32), XXH64 of
                    the raw bytes (8 bytes, big-endian)
                    the index frame's row, alike
                    uint32 rows, uint64 place of the file among those of its writer, 8 bytes "TOKSEEK\\n"

A reader takes the table from the end of the file, then decompresses only the frames with the
documents asked for. The file ends with a line feed, so that Spark's text writer, which commits tasks and reaches
every file system Spark can, writes it byte for byte as one line.

Documents are dealt into ranges of doc_id and sorted in them, so files in order of their first doc_id
(then place) hold the corpus in ascending order. A file has about ``FILE_IDS`` ids.

Defined cases: null and empty texts have the end id only; rows that share a doc_id stand next to each
other, ordered by text; rows without doc_id come first; an empty table writes no file and reads as no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardweir.llm.common import column, slices
from cardweir.llm.tokens import MANY, encode_column, tokenizer_path
from cardweir.session import new_table_path

END_ID = 2
#: Ids in a frame and in a file, at least, unless documents end before.
FRAME_IDS, FILE_IDS = 1 << 16, 4 << 20
SKIPPABLE = 0x184D2A5E
MAGIC = b"TOKSEEK\n"
#: Stands for a missing doc_id in the index frame.
NO_ID = -(1 << 63)
_ROW = struct.Struct("<III8s")
_END = struct.Struct("<IQ8s")


def _row(raw: bytes, packed: bytes, documents: int) -> bytes:
    return _ROW.pack(len(packed), len(raw), documents, xxhash.xxh64_digest(raw))


class FileWriter:
    """Collects documents and gives the bytes of one file."""

    def __init__(self, place: int) -> None:
        self.place, self.ids_written = place, 0
        self.frames: list[bytes] = []
        self.rows: list[bytes] = []
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        self.held: list[bytes] = []
        self.held_ids = 0
        self.zstd = zstandard.ZstdCompressor(level=1, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        self.ids_written += len(ids) // 4
        if self.held_ids >= FRAME_IDS:
            self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.held)
        self.frames.append(self.zstd.compress(raw))
        self.rows.append(_row(raw, self.frames[-1], len(self.held)))
        self.held, self.held_ids = [], 0

    def close(self) -> bytes:
        if self.held:
            self._frame()
        raw = np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes()
        index = self.zstd.compress(raw)
        rows = [*self.rows, _row(raw, index, len(self.doc_ids))]
        body = b"".join(rows) + _END.pack(len(rows), self.place, MAGIC)
        return b"".join([*self.frames, index, struct.pack("<II", SKIPPABLE, len(body)), body])


class FileReader:
    """Reads single documents of a file's bytes."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        count, self.place, magic = _END.unpack(self.data[-_END.size :])
        if magic != MAGIC:
            raise ValueError("no seek table at the end of the file")
        table = self.data[-_END.size - count * _ROW.size : -_END.size]
        rows = [_ROW.unpack_from(table, i * _ROW.size) for i in range(count)]
        self.starts = np.cumsum([0] + [r[0] for r in rows])
        self.rows = rows
        self.zstd = zstandard.ZstdDecompressor()
        n = rows[-1][2]
        raw = self.frame(count - 1)
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.counts = np.frombuffer(raw, "<u4", n, 8 * n)
        #: The first document of each frame of ids.
        self.first = np.cumsum([0] + [r[2] for r in rows[:-1]])

    def frame(self, i: int) -> bytes:
        size, raw_size, _, digest = self.rows[i]
        raw = self.zstd.decompress(self.data[self.starts[i] : self.starts[i] + size], max_output_size=raw_size)
        if len(raw) != raw_size or xxhash.xxh64_digest(raw) != digest:
            raise ValueError(f"frame {i} does not fit its checksum")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, its ids); only frames with wanted documents are decompressed."""
        before = np.concatenate([[0], np.cumsum(self.counts.astype(np.int64))])
        for f in range(len(self.rows) - 1):
            own = range(self.first[f], self.first[f + 1])
            if wanted is not None and not any(int(self.doc_ids[d]) in wanted for d in own):
                continue
            raw = self.frame(f)
            for d in own:
                doc_id = int(self.doc_ids[d])
                if wanted is None or doc_id in wanted:
                    at = 4 * int(before[d] - before[own[0]])
                    yield None if doc_id == NO_ID else doc_id, int(before[d]), raw[at : at + 4 * int(self.counts[d])]


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` in ascending order of doc_id to files in a new folder."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    end = end_id.to_bytes(4, "little")

    # the text writer adds a file's last byte, the line feed
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, place = None, 0
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, ids in zip(column(part, "doc_id").to_pylist(), encode_column(column(part, "text"), path, MANY), strict=True):
                    writer = writer or FileWriter(place)
                    writer.add(doc_id, ids + end)
                    if writer.ids_written >= FILE_IDS:
                        yield pa.record_batch([pa.array([writer.close()[:-1]], pa.binary())], ["file"])
                        writer, place = None, place + 1
        if writer:
            yield pa.record_batch([pa.array([writer.close()[:-1]], pa.binary())], ["file"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(of, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)


def read_token_files(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32); start: ids of all documents before it in the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            readers = [FileReader(x.as_py()) for x in column(batch, "content")]
            yield pa.record_batch(
                [column(batch, "path"), pa.array([int(r.doc_ids[0]) for r in readers], pa.int64()), pa.array([r.place for r in readers], pa.int64()), pa.array([int(r.counts.sum(dtype=np.int64)) for r in readers], pa.int64())],
                ["path", "first", "place", "total"],
            )

    chosen = None if wanted is None else set(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(column(batch, "path").to_pylist(), column(batch, "content"), strict=True):
                found = list(FileReader(content.as_py()).documents(chosen))
                yield pa.record_batch(
                    [pa.array([path] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([len(x[2]) // 4 for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary()), pa.array([zlib.crc32(x[2]) for x in found], pa.int64())],
                    ["path", "doc_id", "within", "n_tokens", "ids", "ids_crc32"],
                )

    heads_ = files.mapInArrow(heads, "path string, first long, place long, total long")
    # one row per file of about FILE_IDS ids
    before = Window.orderBy("first", "place").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads_.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).select("path", "before")
    docs = files.mapInArrow(rows, "path string, doc_id long, within long, n_tokens long, ids binary, ids_crc32 long")
    return docs.join(starts, "path").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids", "ids_crc32")


def token_file_rows(docs: DataFrame) -> DataFrame:
    """Write the files to the shared folder and return what they hold."""
    folder = new_table_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder)
    return read_token_files(docs.sparkSession, folder).drop("ids")
