"""Benchmark decontamination with an FM-index for each shard of the training text.

Words are lower-cased (A-Z only) runs of ASCII letters, digits and characters
beyond ASCII. A window is `width` consecutive words of an item; an item of
fewer words, but not none, is one window. A shard's index holds each run of
words that all occur in some window and that is as long as the shortest
window: no other place can hold an occurrence. Words are compared by a 64-bit
hash.

Null and empty texts have no words and no hits; items without words have no
windows. Repeated rows are each answered. An empty benchmark gives no hits.
Documents keep their order of rows and are never shuffled; the benchmark is
read in blocks of at most `block_windows` windows, each of which is passed to
the tasks in turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .kernels import alphanumeric, blocks, find_words, hash_spans, text_bytes

_FOUND = "n_words bigint, spans array<struct<first:int,last:int,start_byte:bigint,end_byte:bigint>>, items array<bigint>, covered binary"


class Phrases:
    """Windows of a block of benchmark items, as codes of a small vocabulary."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        ids = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        data, offsets = text_bytes(column)
        starts, ends, first = find_words(data, offsets, alphanumeric())
        words = hash_spans(data, starts, ends)
        self.vocabulary = np.unique(words)
        codes = np.searchsorted(self.vocabulary, words) + 2
        patterns, lengths, owner = [], [], []
        for k, item in enumerate(ids):
            own = codes[first[k] : first[k + 1]]
            if len(own):
                views = np.lib.stride_tricks.sliding_window_view(own, width) if len(own) >= width else [own]
                for v in views:
                    patterns.append(v)
                    lengths.append(len(v))
                    owner.append(item)
        self.lengths = np.array(lengths, np.int64)
        self.patterns = np.zeros((len(patterns), width), np.int64)
        for k, p in enumerate(patterns):
            self.patterns[k, : len(p)] = p
        self.owner = np.array(owner, np.int64)

    def occurrences(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word of each occurrence in the shard, and which pattern it is."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths) or not len(words):
            return none, none
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        codes = np.where(self.vocabulary[at] == words, at + 2, 1)
        # runs of known words within a row, as long as the shortest window
        edge = np.zeros(len(codes) + 1, bool)
        edge[first] = True
        known = codes > 1
        begin = np.flatnonzero(known & np.concatenate([[True], ~known[:-1] | edge[1:-1]]))
        end = np.flatnonzero(known & np.concatenate([~known[1:] | edge[1:-1], [True]])) + 1
        long = end - begin >= self.lengths.min()
        begin, end = begin[long], end[long]
        if not len(begin):
            return none, none
        size = end - begin + 1  # and a separator
        stop = np.cumsum(size)
        place = np.arange(stop[-1]) - np.repeat(stop - size, size) + np.repeat(begin, size)
        seq = codes[np.minimum(place, len(codes) - 1)]
        seq[stop - 1] = 1
        seq[-1] = 0
        index = FMIndex(seq, len(self.vocabulary) + 2)
        low, high = index.search(self.patterns, self.lengths)
        n = high - low
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return place[index.locate(rows)], np.repeat(np.arange(len(n)), n)


def _spans_of(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _annotate(phrases: Phrases, text: str, schema: pa.Schema, more: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, text, 8 << 20):
                yield _shard(phrases, batch, text, schema, more)

    return run


def _shard(phrases: Phrases, batch: pa.RecordBatch, text: str, schema: pa.Schema, more: bool) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column(text))
    starts, ends, first = find_words(data, offsets, alphanumeric())
    words = hash_spans(data, starts, ends)
    at, pattern = phrases.occurrences(words, first)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + phrases.lengths[pattern], -1)
    hit = np.cumsum(change)[:-1] > 0
    row = np.searchsorted(first, at, "right") - 1
    pairs = np.unique(np.stack([row, phrases.owner[pattern]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    spans, items, covered = [], [], []
    was_items = batch.column("items").to_pylist() if more else [[]] * batch.num_rows
    was_cover = batch.column("covered").to_pylist() if more else [None] * batch.num_rows
    item_at = np.searchsorted(pairs[:, 0], np.arange(batch.num_rows + 1))
    for k in range(batch.num_rows):
        a, b = first[k], first[k + 1]
        own, found = hit[a:b], pairs[item_at[k] : item_at[k + 1], 1].tolist()
        if was_cover[k]:
            own = own | np.unpackbits(np.frombuffer(was_cover[k], np.uint8), count=b - a).astype(bool)
        items.append(sorted({*was_items[k], *found}))
        if not own.any():
            spans.append([])
            covered.append(None)
            continue
        s, e = _spans_of(own)
        spans.append([{"first": int(x), "last": int(y) - 1, "start_byte": int(starts[a + x] - offsets[k]), "end_byte": int(ends[a + y - 1] - offsets[k])} for x, y in zip(s, e, strict=True)])
        covered.append(np.packbits(own).tobytes())
    new = {"n_words": pa.array(np.diff(first), pa.int64()), "spans": pa.array(spans, schema.field("spans").type), "items": pa.array(items, pa.list_(pa.int64())), "covered": pa.array(covered, pa.binary())}
    return pa.RecordBatch.from_arrays([new.get(f.name, None) if f.name in new else batch.column(f.name) for f in schema], schema=schema)


def item_blocks(benchmark: DataFrame, item_id: str, text: str, width: int, block_windows: int) -> Iterator[Phrases]:
    """Blocks of items with at most block_windows words; an item of more is a block of its own.

    Items are streamed to the driver a partition at a time and dropped after use.
    """
    held, n = [], 0
    for r in benchmark.select(item_id, text).where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).toLocalIterator():
        size = len(r[1].split()) + r[1].count("-") + 1
        if held and n + size > block_windows:
            yield Phrases(held, width)
            held, n = [], 0
        held.append((r[0], r[1]))
        n += size
    yield Phrases(held, width)


def find_phrases(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_windows: int = 400_000) -> DataFrame:
    """Columns of docs and: n_words, spans (merged hits: first and last word, bytes), items (found, ascending)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    clash = [c for c in ("n_words", "spans", "items", "covered") if c in docs.columns]
    out = docs.drop(*clash)
    more = False
    for phrases in item_blocks(benchmark, item_id, item_text, width, block_windows):
        base = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name not in ("n_words", "spans", "items", "covered")]
        kind = ", ".join([*base, _FOUND])
        shape = docs.sparkSession.createDataFrame([], kind).schema
        out = out.mapInArrow(_annotate(phrases, text, to_arrow_schema(shape), more), kind)
        more = True
    return out.drop("covered")


def digest(items: list[int] | None) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items or []))).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = find_phrases(docs.select("doc_id", "text"), benchmark, width=width)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_phrases(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Documents without the passages found; those of which no word is left go.

    A passage goes from the first byte of its first word to the last byte of its
    last; documents without hits are returned as they are, null and empty ones too.
    Repeated rows are each treated. Any other columns may be there; n_chars is counted
    again where a passage went.
    """
    others = [c for c in docs.columns if c != "text"]
    found = find_phrases(docs.select("text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")), benchmark, width=width)
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["kept"], _bytes(acc["at"], s["start_byte"])).alias("kept"), s["end_byte"].alias("at")),
        lambda acc: F.concat(acc["kept"], _bytes(acc["at"], F.lit(2**31 - 1).cast("long"))),
    )
    hit = F.size("spans") > 0
    left = F.col("n_words") > F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    kept = found.where(~hit | left).select("row", hit.alias("hit"), F.when(hit, F.trim(cut)).otherwise(F.col("text")).alias("text"))
    columns = {c: F.col("row").getField(c) for c in others} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return kept.select(*(columns[c].alias(c) for c in docs.columns))


def _bytes(start, end):
    """Text of the bytes from start to end; spans begin and end at word edges, so at characters."""
    return F.decode(F.substring(F.encode("text", "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")
