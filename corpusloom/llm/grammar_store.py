"""Token-id files by Re-Pair grammar compression.

Documents in ascending doc_id order are encoded, id 0 is appended to each, and
shards of about `shard_tokens` ids (whole documents) are compressed: in each
round the most frequent pairs of neighbouring symbols become nonterminals, until
no pair occurs `least` times.
Pairs never reach over a document's end, so each document keeps a place of its
own in the shard's sequence and can be decoded alone. A shard is one row:

part, shard: its order; start: ids of the part before it; doc_ids; lengths: ids of
each document; places: its first symbol in the sequence; rules: pairs of symbols
as 32-bit numbers, rule i being symbol BASE + i; expanded: ids that each rule
stands for; sequence: symbols as planes of bytes, low to high, after the number of
planes. A part is a range of doc_ids; a shard's ids stand at the ids of all parts
before its own and its start.

Null and empty texts are the one id 0. Rows of the same id follow each other.
Rows with a null id come first. An empty table gives no rows. A document longer
than shard_tokens is a shard of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path
from .tokens import default_tokenizer, encoded, encoder

BASE = 1 << 18  # ids lie below; write_shards refuses tokenizers with more
KIND = "part int, shard int, start bigint, n_ids bigint, doc_ids array<bigint>, lengths array<int>, places array<int>, rules binary, expanded binary, sequence binary"
_HASH = np.uint64(0x9E3779B97F4A7C15)


def compress(seq: np.ndarray, last: np.ndarray, least: int = 16, round_rules: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence of symbols, rules (pairs) and ends of documents after Re-Pair.

    Rounds of up to round_rules pairs, the most frequent first, go on until no pair
    occurs `least` times; of overlapping places the first, third and so on are replaced.
    """
    seq, rules = seq.astype(np.uint32), [np.zeros((0, 2), np.uint32)]
    n_rules = 0
    while len(seq) > 1:
        key = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        slot = ((key * _HASH) >> np.uint64(46)).astype(np.int32)
        often = (np.bincount(slot, minlength=1 << 18) >= least)[slot] & ~last[:-1]
        at = np.flatnonzero(often)
        there = key[at]
        ordered = np.sort(there)
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
        pairs, count = ordered[heads], np.diff(np.append(heads, len(ordered)))
        chosen = np.flatnonzero(count >= least)
        chosen = chosen[np.argsort(-count[chosen], kind="stable")][:round_rules]
        if not len(chosen):
            break
        by_key = np.argsort(chosen)
        wanted = pairs[chosen[by_key]]
        near = np.zeros(1 << 18, bool)
        near[((wanted * _HASH) >> np.uint64(46)).astype(np.int32)] = True
        some = near[slot[at]]
        at, there = at[some], there[some]
        place = np.minimum(np.searchsorted(wanted, there), len(wanted) - 1)
        use = wanted[place] == there
        at, symbol = at[use], by_key[place[use]]
        # of places that overlap in succession take every second one
        first = np.concatenate([[True], np.diff(at) != 1])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - begin) % 2 == 0
        at, symbol = at[take], symbol[take]
        # another pair may have taken the places of a chosen one
        used = np.flatnonzero(np.bincount(symbol, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.int64)
        number[used] = np.arange(len(used))
        seq[at] = BASE + n_rules + number[symbol]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        own = pairs[chosen[used]]
        rules.append(np.stack([own >> np.uint64(32), own & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        n_rules += len(used)
    return seq, np.concatenate(rules), last


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids that each rule stands for; a rule's symbols come from earlier rounds."""
    out = np.ones(len(rules), np.int64)
    depth = 0
    while len(rules):
        size = lambda s: np.where(s >= BASE, out[np.maximum(s.astype(np.int64) - BASE, 0)], 1)
        new = size(rules[:, 0]) + size(rules[:, 1])
        if (new == out).all() or depth > len(rules):
            break
        out, depth = new, depth + 1
    return out


def _gather(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """What symbols stand for: ids themselves, rules the `size` ids of flat from `start`."""
    rule = symbols >= BASE
    own = np.maximum(symbols.astype(np.int64) - BASE, 0)
    n = np.where(rule, size[own], 1)
    stop = np.cumsum(n)
    where = np.arange(stop[-1]) + np.repeat(start[own] - stop + n, n)
    out = np.repeat(symbols, n)
    inside = np.repeat(rule, n)
    out[inside] = flat[where[inside]]
    return out


def expand(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Ids that the symbols stand for; rules are written out first, those of one depth after the other."""
    seq = seq.astype(np.uint32)
    if not len(seq) or not len(rules) or not (seq >= BASE).any():
        return seq
    size = expansion_lengths(rules)
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint32)
    known = np.zeros(len(rules), bool)
    while not known.all():
        ready = np.flatnonzero(~known & ((rules < BASE) | known[np.maximum(rules.astype(np.int64) - BASE, 0)]).all(1))
        where = np.repeat(start[ready] - np.cumsum(size[ready]) + size[ready], size[ready]) + np.arange(size[ready].sum())
        flat[where] = _gather(rules[ready].ravel(), start, size, flat)
        known[ready] = True
    return _gather(seq, start, size, flat)


def pack_symbols(seq: np.ndarray) -> bytes:
    planes = max(1, (int(seq.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T.tobytes()


def unpack_symbols(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).astype(np.uint32)
    return sum((p << np.uint32(8 * i) for i, p in enumerate(planes)), np.zeros(planes.shape[1], np.uint32))


def _expand_some(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Ids that a few symbols stand for, looking at their rules only."""
    while len(seq):
        is_rule = seq >= BASE
        if not is_rule.any():
            break
        at = np.cumsum(1 + is_rule) - 1 - is_rule
        out = np.empty(int(at[-1]) + 1 + int(is_rule[-1]), np.uint32)
        rule = rules[seq[is_rule] - BASE]
        out[at[~is_rule]] = seq[~is_rule]
        out[at[is_rule]] = rule[:, 0]
        out[at[is_rule] + 1] = rule[:, 1]
        seq = out
    return seq


def decode_document(shard: dict, k: int, start: int = 0, length: int | None = None) -> np.ndarray:
    """Ids start to start + length of the shard's k-th document, expanding only the symbols that hold them."""
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    expanded = np.frombuffer(shard["expanded"], "<u4")
    seq = unpack_symbols(shard["sequence"])
    stop = shard["places"][k + 1] if k + 1 < len(shard["places"]) else len(seq)
    own = seq[shard["places"][k] : stop]
    ends = np.cumsum(np.where(own >= BASE, expanded[np.maximum(own.astype(np.int64) - BASE, 0)] if len(expanded) else 1, 1))
    length = shard["lengths"][k] - start if length is None else length
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left") + 1
    before = int(ends[a - 1]) if a else 0
    return _expand_some(own[a:b], rules)[start - before : start - before + length]


def _write(path: str, shard_tokens: int, least: int):
    def shard_row(part: int, number: int, start: int, ids: list, found: list[np.ndarray]) -> list:
        lengths = np.array([len(r) for r in found])
        seq = np.concatenate(found)
        last = np.zeros(len(seq), bool)
        last[np.cumsum(lengths) - 1] = True
        out, rules, last = compress(seq, last, least)
        places = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        return [part, number, start, len(seq), ids, lengths, places, rules.astype("<u4").tobytes(), expansion_lengths(rules).astype("<u4").tobytes(), pack_symbols(out)]

    def batch_of(row: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in KIND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start, ids, found, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        enc = encoder(path)
        if enc.n_ids > BASE:
            raise ValueError(f"the tokenizer has {enc.n_ids} ids, more than the {BASE} below the rules")
        for batch in batches:
            for doc, own in encoded(batch, enc):
                if found and size + len(own) > shard_tokens:
                    yield batch_of(shard_row(part, number, start, ids, found))
                    number, start, ids, found, size = number + 1, start + size, [], [], 0
                ids.append(doc)
                found.append(own)
                size += len(own)
        if found:
            yield batch_of(shard_row(part, number, start, ids, found))

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_tokens: int = 1_000_000, least: int = 16) -> None:
    """Write the shards of all documents as a Parquet table, in ascending doc_id order over part and shard."""
    parts = max(1, docs.rdd.getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    rows.mapInArrow(_write(tokenizer, shard_tokens, least), KIND).write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
            raw = expand(unpack_symbols(row["sequence"]), rules).astype("<u4").tobytes()
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["before"] + ends - lengths, pa.int64()), pa.array(lengths), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 from decoded shards, which stay where they are read."""
    shards = spark.read.parquet(path)
    # a row for each part, of which there are as many as the writing job had tasks
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = shards.join(F.broadcast(before), "part").withColumn("before", F.col("before") + F.col("start"))
    return placed.select("doc_ids", "lengths", "rules", "sequence", "before").mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def stored_documents(docs: DataFrame, tokenizer: str | None = None, **parameters) -> DataFrame:
    """Write the shards to a new table in the shared folder and report what its files hold."""
    spark = docs.sparkSession
    path = new_path(spark, "token-shards")
    write_shards(docs, path, tokenizer or default_tokenizer(), **parameters)
    return read_documents(spark, path)
