"""Count tables of fixed size, added up over all tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_CHUNK = 1 << 14
_SCHEMA = "chunk int, counts binary"


def _rows(total: np.ndarray, chunks: list[int]) -> pa.RecordBatch:
    packed = [zlib.compress(total[i * _CHUNK : (i + 1) * _CHUNK].tobytes(), 1) for i in chunks]
    return pa.record_batch([pa.array(chunks, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(zlib.decompress(packed), np.int64)
    packed = [zlib.compress(v.tobytes(), 1) for v in total.values()]
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])


def count_table(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> np.ndarray:
    """An array of ``size`` sums; ``add`` adds a batch's counts to a task's array.

    Tasks pass on compressed pieces of the array, which are added piece by piece; the driver gets
    size / 16384 rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-size // _CHUNK) * _CHUNK, np.int64)
        for batch in batches:
            add(batch, total[:size])
        yield _rows(total, [i for i in range(len(total) // _CHUNK) if total[i * _CHUNK : (i + 1) * _CHUNK].any()])

    out = np.zeros(-(-size // _CHUNK) * _CHUNK, np.int64)
    for r in rows.mapInArrow(count, _SCHEMA).repartition("chunk").mapInArrow(_add, _SCHEMA).collect():
        out[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    return out[:size]
