"""Sums of fixed-size arrays over all tasks of a job, and the labelled sample."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KIND = "chunk int, part int, sums binary"
_CHUNK = 16384


def array_sums(build: Callable[[Iterator[pa.RecordBatch]], np.ndarray]):
    """A function for mapInArrow that emits the float64 array `build` makes of a task's batches, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = build(batches).astype(np.float64).ravel()
        part = TaskContext.get().partitionId() % 1024
        used = [i for i in range(0, len(sums), _CHUNK) if sums[i : i + _CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i // _CHUNK for i in used], pa.int32()), pa.array([part] * len(used), pa.int32()), pa.array([zlib.compress(sums[i : i + _CHUNK].tobytes(), 1) for i in used], pa.binary())], names=["chunk", "part", "sums"])

    return run


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.float64)


def _add(table: pa.Table) -> pa.Table:
    total = sum(_unpack(c) for c in table.column("sums").to_pylist())
    return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def total(parts: DataFrame, size: int) -> np.ndarray:
    """Sum over all tasks; first over the tasks of each of 1024 groups, so that no group grows with the input's square."""
    out = np.zeros(size)
    some = parts.groupBy("chunk", "part").applyInArrow(_add, KIND)
    for chunk, _, sums in some.groupBy("chunk").applyInArrow(_add, KIND).toLocalIterator():
        values = _unpack(sums)
        out[chunk * _CHUNK : chunk * _CHUNK + len(values)] = values
    return out


def remainder(divisor: int):
    """crc32 of doc_id as text modulo divisor; it decides which rows a label may be learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def labelled_sample(labels: DataFrame, label: str, divisor: int, held: int, most: int) -> DataFrame:
    """doc_id and label of at most `most` rows that may be learnt from, those of the smallest hash.

    Several labels of one document count as their largest; null ones as none.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(remainder(divisor) != held)
    one = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
