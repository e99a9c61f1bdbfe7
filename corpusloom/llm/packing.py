"""Best-fit packing of documents into fixed-length sequences, in hierarchical rounds.

A document is its token ids and id 0. One longer than `length` is cut into
pieces of `length` ids, of which the first may be shorter; a full piece is a
sequence of its own. The other pieces are packed best-fit decreasing in each
partition. Bins filled to `nearly` or more are final; the rest are merged as
items, `fan_in` partitions into one, and packed again, until one partition is
left, or no more than `task_items` fit a task and a round saves less than a
thousandth of the bins.

Null and empty texts are the one id 0. Rows of the same id are packed as
separate documents. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep
from .tokens import default_tokenizer, encoded, encoder

_MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
_BIN = f"sequence_id bigint, size int, members array<{_MEMBER}>"
_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
_FULL = 62


def _sequence_ids(turn: int, n: int, first: int = 0) -> np.ndarray:
    return (turn << 56) + (TaskContext.get().partitionId() << 36) + first + np.arange(n)


def _pieces(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n_full = encoder(path), 0
        for batch in batches:
            out: list[tuple] = []
            for doc, found in encoded(batch, enc):
                raw, n = found.astype("<u4").tobytes(), len(found)
                cuts = [0, *range(n % length or length, n + 1, length)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    out.append((doc, piece, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
            full = np.array([r[3] == length for r in out], bool)
            ids = np.full(len(out), -1, np.int64)
            ids[full] = _sequence_ids(_FULL, int(full.sum()), n_full)
            n_full += int(full.sum())
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)), pa.array(ids, mask=~full)], names=_COLUMNS[:6])

    return run


def best_fit(sizes: list[int], length: int) -> tuple[np.ndarray, int]:
    """Bin of each item, items taken in the given order, and the number of bins.

    Open bins stand in lists by the room they have; a bit mask of rooms in use finds the smallest that is enough.
    """
    rooms: list[list[int]] = [[] for _ in range(length + 1)]
    mask, n_bins, bins = 0, 0, np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, at, n_bins = length, n_bins, n_bins + 1
        bins[i] = at
        if room > size:
            left = room - size
            if not rooms[left]:
                mask |= 1 << left
            rooms[left].append(at)
    return bins, n_bins


def _pack(turn: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        size = table.column("size").to_numpy()
        members = table.column("members").combine_chunks()
        members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
        starts = members.offsets.to_numpy()[:-1] - members.offsets[0].as_py()
        head = members.flatten()
        key = [head.field(c).take(pa.array(starts)).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("ids_crc32", "start", "piece", "doc_id")]
        order = np.lexsort([*key, -size.astype(np.int64)])  # the same in whatever order the rows arrived
        bins, n = best_fit(size[order].tolist(), length)
        by_bin = order[np.argsort(bins, kind="stable")]
        taken = members.take(pa.array(by_bin))
        counts = np.diff(members.offsets.to_numpy())[by_bin]
        per_bin = np.bincount(np.sort(bins), counts, minlength=n).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)), taken.flatten())
        total = np.bincount(bins, size[order], minlength=n).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(_sequence_ids(turn, n)), pa.array(total), lists], names=["sequence_id", "size", "members"])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column("members")
        n = np.diff(members.offsets.to_numpy())
        flat = members.flatten()
        size = flat.field("length").to_numpy()
        run = np.concatenate([[0], np.cumsum(size)])[:-1]
        first = np.cumsum(n) - n
        offset = run - np.repeat(run[first] if len(run) else run, n)
        yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in _COLUMNS[:5]), pa.array(np.repeat(batch.column("sequence_id").to_numpy(), n)), pa.array(offset.astype(np.int64))], names=_COLUMNS)


def pack(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, nearly: float = 0.99, fan_in: int = 8, task_items: int = 250_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of a document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kind = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint"
    pieces = keep(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), length), kind), "pieces")
    full = pieces.where("sequence_id is not null").withColumn("offset", F.lit(0).cast("long"))
    item = F.array(F.struct(*_COLUMNS[:5])).cast(f"array<{_MEMBER}>")
    open_bins = pieces.where("sequence_id is null").select(F.lit(None).cast("bigint").alias("sequence_id"), F.col("length").cast("int").alias("size"), item.alias("members"))
    parts, count, turn, done = max(1, open_bins.rdd.getNumPartitions()), None, 0, []
    while True:
        packed = keep(open_bins.mapInArrow(_pack(turn, length), _BIN), "bins")
        left = packed.where(F.col("size") < int(nearly * length))
        now = left.count()
        smaller = max(1, -(-now // task_items), parts // fan_in)
        if parts == 1 or now < 2 or (smaller >= parts and count is not None and now > 0.999 * count):
            done.append(packed)
            break
        done.append(packed.where(F.col("size") >= int(nearly * length)))
        parts, count, turn = min(parts, smaller) if smaller < parts else parts, now, turn + 1
        mixed = F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["piece"], F.lit(turn))
        open_bins = left.repartition(parts, mixed)
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return full.select(*_COLUMNS).unionByName(bins.mapInArrow(_placed, kinds))
