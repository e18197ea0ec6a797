"""Helpers shared by the operators: written tables, word blocks as numpy arrays, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cardweir.session import freed_shuffles, new_table_path

#: Bytes of text that are hashed at once; longer documents are taken alone.
BLOCK_BYTES = 1_500_000
_HASH_SPAN = 1 << 20


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows that travel to a Python worker at once. They are whole documents, so Spark's own default of 10,000 is tens of megabytes,
#: held by the JVM and by the worker.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let no more than ``BATCH_ROWS`` rows travel at once in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Owner of the tables an operator writes to the shared folder.

    ``write`` cuts lineage: a lost executor rereads files, and those of the shuffles before go at once. ``drop`` deletes a table that nothing
    reads any more; what a lazy result still reads goes when the driver process ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label, self.paths = spark, label, {}
        small_batches(spark)
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_table_path(self.spark, f"{self.label}-{name}")
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                delete_path(self.spark, path)

    def close(self) -> None:
        try:
            self.drop(*[table for table, _ in list(self.paths.values())])
        except Exception:  # noqa: BLE001  the session may have ended before
            self.paths.clear()


def trimmed(fn: Callable) -> Callable:
    """A function of a task's batches that gives its memory back when the task ends.

    Workers live on for the next stage's tasks, and what numpy and Arrow freed stays with the process unless it is asked for.
    """

    @functools.wraps(fn)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Random 64-bit polynomial hashes of words, computed over whole byte arrays."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(0, 1 << 62)) * 2 + 1
        self.power = np.multiply.accumulate(np.full(_HASH_SPAN, base, np.uint64))
        self.inverse = np.multiply.accumulate(np.full(_HASH_SPAN, pow(base, -1, 1 << 64), np.uint64))
        self.base = base

    def _span(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=total[1:])
        return (total[ends] - total[starts]) * self.inverse[starts]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each word, in order of start."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            first = int(starts[i])
            j = int(np.searchsorted(ends, first + _HASH_SPAN, side="right"))
            if j <= i:  # one word longer than a span: fold its pieces
                value = np.uint64(0)
                for at in range(first, int(ends[i]), _HASH_SPAN):
                    piece = data[at : min(at + _HASH_SPAN, int(ends[i]))]
                    part = self._span(piece, np.array([0]), np.array([len(piece)]))[0]
                    value = mix64(np.array([value + part], np.uint64))[0]
                out[i] = value
                i += 1
                continue
            out[i:j] = self._span(data[first : int(ends[j - 1])], starts[i:j] - first, ends[i:j] - first)
            i = j
        return mix64(out ^ mix64((ends - starts).astype(np.uint64)))

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hash of every run of ``size`` words; len(words) - size + 1 values."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = out * np.uint64(self.base) + words[k : k + n]
        return mix64(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


class Block:
    """Texts of some documents: their bytes, and the words ``[^\\x20\\x09-\\x0D]+`` in them.

    ``apart`` gives other bytes (256 flags) that stand between words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE) -> None:
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        self.n = len(texts)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + self.n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.data = LOWER_ASCII[raw] if lower else raw
        self.offsets = off - off[0]
        full = ~apart[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True  # a document's first byte starts a word, whatever stands before it
        before = np.concatenate([[False], full[:-1]]) if len(raw) else np.zeros(0, bool)
        starts = full & (~before | edge[:-1])
        after = np.concatenate([full[1:], [False]]) if len(raw) else np.zeros(0, bool)
        ends = full & (~after | edge[1:])
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        #: Words of document i: first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, self.offsets)

    @property
    def doc(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.first))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or with one document."""
    texts = column(batch, text)
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
    at, total = 0, 0
    for i, n in enumerate(size):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < len(size):
        yield batch.slice(at)
