"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct k-word shingles (64-bit hashes). Two
documents link when 100 * |x and y| >= 80 * |x or y|, so at most
t = |x| - ceil(0.8 |x|) tokens of x are missing from y. All tokens stand in one
global order, those that a count sketch shows as rare first; the sketch decides
the order only. The first t + 1 tokens of two linked documents share one, and
the first t + 1 + e share e + 1. Every document's longest prefix is counted;
tokens in more than `frequent` of these prefixes are frequent, by exact counts
at any size of the corpus. A document without frequent tokens among its first
t + 1 is indexed by the single tokens there. Another is indexed by all its rare
tokens of the extended prefix and, as frequent ones fall into e groups by hash,
of which one must hold two shared ones, by all pairs of frequent tokens of a
group. e is a power of two near |x| / 8; a document is indexed for the e of all
sizes it can link to. No link is lost at any setting.

Copies (equal sets) are found by a digest first and one of each is indexed.
Each key's documents are compared with one of them, then, where they are still
in different components, with one of the largest other component. The rest are
compared by bit sketches (parity of the number of tokens by bucket) in blocks
of at most about BLOCK documents, across components only. Pairs that sketches
don't rule out are verified on the whole sets.

Null, empty and white-space texts have no tokens and link with nothing. Fewer
than k words count as one token, the whole sequence. Rows whose id is null are
returned without component; rows of the same id are one node. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import blocks, mix, row_sets
from .shared import discard, keep, only_marked
from .tokens import release_encoders

SKETCH_BITS = 21
CHUNK = 4096
BLOCK = 1024
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def odd_sketch(value: np.ndarray) -> bytes:
    """A bit for each of 2**j buckets, at least twice as many as values: whether an odd number of values is in it."""
    bits = max(8, (2 * len(value) - 1).bit_length())
    return np.packbits(np.bincount((value & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1, bitorder="little").tobytes() if len(value) else b""


def least_difference(x: bytes, y: bytes) -> int:
    """Values that are in one of two sets only, at least, by their odd sketches; the larger is folded to the smaller's size."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _close(percent: int):
    """Pairs whose sketches don't show more differences than a link allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            differ = np.array([least_difference(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)], np.int64)
            # linked: differences <= (1 - s) / (1 + s) of the sum of sizes
            yield batch.select(["a", "b"]).filter(pa.array(differ * (100 + percent) <= (100 - percent) * n))

    return run


def _summary(k: int):
    """Rows of each document (id, n, digest), then this task's part of the count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        seen: set[bytes] = set()
        for whole in batches:
            for batch in blocks(whole, "text"):
                value, at = row_sets(batch, k)
                raw = value.tobytes()
                digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
                fresh = np.zeros(batch.num_rows, bool)
                for i, d in enumerate(digests):
                    if d is not None and d not in seen:
                        seen.add(d)
                        fresh[i] = True
                size = np.diff(at)
                counts += np.bincount((value[np.repeat(fresh, size)] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
                n = batch.num_rows
                odd = [odd_sketch(value[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(odd, pa.binary())], names=["doc_id", "n", "digest", "chunk", "part", "counts"])
        chunks = [(i, counts[i * CHUNK : (i + 1) * CHUNK]) for i in range(len(counts) // CHUNK)]
        used = [(i, c) for i, c in chunks if c.any()]
        n, part = len(used), TaskContext.get().partitionId() % 1024
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([i for i, _ in used], pa.int32()), pa.array([part] * n, pa.int32()), pa.array([c.tobytes() for _, c in used], pa.binary())], names=["doc_id", "n", "digest", "chunk", "part", "counts"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64 if len(c) == 8 * CHUNK else np.int32).astype(np.int64) for c in table.column("counts").to_pylist())
    return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(parts: DataFrame) -> np.ndarray:
    """Number of documents for each bucket of the sketch, of 2**SKETCH_BITS buckets at any input."""
    kind = "chunk int, counts binary"
    some = parts.groupBy("chunk", "part").applyInArrow(_add, kind)
    sums = np.zeros(1 << SKETCH_BITS, np.int64)
    for chunk, counts in some.groupBy("chunk").applyInArrow(_add, kind).toLocalIterator():
        sums[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, np.int64)
    return sums


def token_levels(sums: np.ndarray) -> np.ndarray:
    """Level of each bucket of the sketch: 0 for counts that chance explains, else by how far they exceed the mean."""
    mean = float(sums.mean())
    noise = 8 + 8 * mean**0.5
    return np.ceil(2 * np.log2(np.maximum(sums - mean, noise) / noise)).astype(np.uint8)


def extensions(n: int) -> list[int]:
    """Numbers of extra prefix tokens for a set of n tokens: those of every size it can link to."""
    sizes = ((4 * n + 4) // 5, n, 5 * n // 4)
    return sorted({(1 << ((s // 8).bit_length() - 1)) if s >= 8 else 0 for s in sizes})


def longest_extension(n: np.ndarray) -> np.ndarray:
    most = np.maximum(5 * n // 4 // 8, 0)
    return np.where(most > 0, 1 << np.maximum(np.frexp(most.astype(float))[1] - 1, 0), 0)


def prefix_entries(value: np.ndarray, at: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, row and place of the longest prefix of each set, by level and value."""
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((value, level, row))
    place = np.arange(len(value)) - at[:-1][row]
    inside = place <= (size // 5 + longest_extension(size))[row]
    return value[order][inside], row[inside], place[inside]


def _pairs(tokens: np.ndarray, e: int) -> np.ndarray:
    """Keys of all pairs of tokens in the same of e groups."""
    group = (tokens >> np.uint64(7)) % np.uint64(e)
    order = np.lexsort((tokens, group))
    tokens, group = tokens[order], group[order]
    out, d = [], 1
    while d < len(tokens):
        same = group[d:] == group[:-d]
        if not same.any():
            break
        out.append(mix(tokens[:-d][same] * _A + mix(tokens[d:][same] + _B) + np.uint64(e)))
        d += 1
    return np.concatenate(out) if out else tokens[:0]


def combination_keys(tokens: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Keys of the frequent tokens of a set of n: for each extension, pairs of those in its prefix."""
    keys = []
    for e in extensions(n):
        own = tokens[place <= n // 5 + e]
        keys.append(_pairs(own, e) if e else own)
    return np.unique(np.concatenate(keys))


def _index(k: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for whole in batches:
            for batch in blocks(whole, "text"):
                value, at = row_sets(batch, k)
                token, row, place = prefix_entries(value, at, levels[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])
                ids = batch.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), ids, pa.array(np.diff(at)[row].astype(np.int32)), pa.array(place.astype(np.int32))], names=["key", "node", "n", "place"])

    return run


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, places = batch.column("tokens"), batch.column("places")
        ends = np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy())])
        token, place = tokens.flatten().to_numpy().view(np.uint64), places.flatten().to_numpy()
        keys = [combination_keys(token[a:b], place[a:b], n) for a, b, n in zip(ends[:-1], ends[1:], batch.column("n").to_pylist(), strict=True)]
        row = pa.array(np.repeat(np.arange(batch.num_rows), [len(k) for k in keys]))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column("node").take(row), batch.column("n").take(row)], names=["key", "node", "n"])


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                value, at = row_sets(batch, k)
                raw = value.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["node", "tokens"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def folded(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sketches as matrices by size, with the rows they are of; each also folded to half its size, as `-size`."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    size = np.array([len(s) for s in sketches])
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        matrix = np.frombuffer(b"".join(sketches[i] for i in rows), np.uint8).reshape(len(rows), n)
        out[n] = rows, matrix
        if n > 32:
            out[-n] = rows, matrix[:, : n // 2] ^ matrix[:, n // 2 :]
    return out


def near_pairs(node: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray, sketches: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, across components and, where there are two sides, across sides, that sizes and sketches don't rule out."""
    found_a, found_b = [], []
    two = side.any() and not side.all()
    matrices = folded(sketches)
    for size, (rows, matrix) in matrices.items():
        if size < 0:
            continue
        # the others are of the same size or of twice the size
        for others, rest in [(rows, matrix), *([matrices[-2 * size]] if -2 * size in matrices else [])]:
            for i, r in enumerate(rows.tolist()):
                at = np.flatnonzero((component[others] != component[r]) & (5 * np.minimum(n[others], n[r]) >= 4 * np.maximum(n[others], n[r])))
                at = at[others[at] > r] if others is rows else at
                at = at[side[others[at]] != side[r]] if two else at
                if not len(at):
                    continue
                differ = np.bitwise_count(rest[at] ^ matrix[i]).sum(1, dtype=np.int64)
                at = others[at[differ * (100 + percent) <= (100 - percent) * (n[others[at]] + n[r])]]
                found_a.append(np.full(len(at), node[r]))
                found_b.append(node[at])
    a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
    return np.minimum(a, b), np.maximum(a, b)


def _near(percent: int):
    """near_pairs of each (key, p, q); rows come sorted by these, those of one in one partition."""

    def of_group(table: pa.Table) -> pa.RecordBatch:
        column = lambda c: table.column(c).to_numpy()
        a, b = near_pairs(column("node"), column("n").astype(np.int64), column("component"), column("block") != column("p"), table.column("odd").to_pylist(), percent)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            group = np.stack([held.column(c).to_numpy() for c in ("key", "p", "q")])
            edges = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
            for a, b in zip([0, *edges[:-1]], edges, strict=False):
                yield of_group(held.slice(a, b - a))
            held = held.slice(edges[-1]) if len(edges) else held
        if held is not None:
            yield of_group(held)

    return run


class _Search:
    """The tables that the rounds of comparisons share."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, k: int, percent: int):
        self.docs, self.sketches, self.k, self.percent = docs, sketches, k, percent

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs that sketches don't rule out."""
        one = self.sketches.select(F.col("doc_id").alias("a"), "n", F.col("odd").alias("x"))
        other = self.sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("odd").alias("y"))
        # a is the node that many pairs share, so what it brings is joined last
        return pairs.join(other, "b").join(one, "a").mapInArrow(_close(self.percent), "a bigint, b bigint").distinct()

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that link by their whole sets. Each set is made once for a side; b's goes to each of its pairs."""
        pairs = keep(pairs, "close")

        def sets(column: str, tokens: str) -> DataFrame:
            some = only_marked(self.docs, "doc_id", pairs.select(column).distinct())
            return some.mapInArrow(_sets(self.k), "node bigint, tokens binary").select(F.col("node").alias(column), F.col("tokens").alias(tokens))

        out = keep(pairs.join(sets("b", "y"), "b").join(sets("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(_verify(self.percent), "a bigint, b bigint").distinct(), name)
        discard(pairs)
        return out


def _star(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs of each node and its key's pivot, without those of sizes too different to link."""
    near = F.expr("5 * least(n, m) >= 4 * greatest(n, m)")
    return rows.join(pivots.select("key", "pivot", "m"), "key").where("node <> pivot").where(near).select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()


def _labels(links: DataFrame) -> DataFrame:
    """node, component: the smallest neighbour's smallest neighbour. Equal ones are in one component; it needn't be all of it."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("v"))
    further = least.select(F.col("node").alias("v"), F.col("v").alias("w"))
    return least.join(further, "v", "left").select("node", F.coalesce("w", "v").alias("component"))


def _still_open(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Rows, with their component, of the keys whose nodes are in several components so far."""
    own = keep(rows.join(_labels(links), "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    still = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("nodes")).where("low <> high and nodes > 2").select("key", "nodes")
    out = keep(own.join(still, "key"), name)
    discard(own)
    return out


def _live_keys(texts: DataFrame, levels: np.ndarray, k: int, frequent: int) -> DataFrame:
    """key, node, n: rare tokens and combinations of frequent ones by which nodes are compared."""
    index = keep(texts.mapInArrow(_index(k, levels), "key bigint, node bigint, n int, place int"), "index")
    groups = keep(index.groupBy("key").agg(F.count("*").alias("nodes"), F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "nodes"), "groups")
    shared = keep(only_marked(index, "key", groups.select("key")).join(groups, "key"), "shared")
    discard(index)
    discard(groups)
    often, basic = F.col("nodes") > frequent, F.col("place") <= F.floor(F.col("n") / 5)
    extended = shared.where(often & basic).select("node").distinct()
    rare = shared.where(~often).select("key", "node", "n", basic.alias("basic"))
    single = rare.where("basic").union(rare.where("not basic").join(extended, "node", "left_semi").select(*rare.columns)).drop("basic")
    some = shared.where(often).join(extended, "node", "left_semi").groupBy("node", "n").agg(F.collect_list(F.struct("key", "place")).alias("t"))
    combined = some.select("node", "n", F.col("t.key").alias("tokens"), F.col("t.place").alias("places")).mapInArrow(_combined, "key bigint, node bigint, n int")
    return keep(single.union(combined).distinct(), "live")


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80, frequent: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), copy_of (smallest id of an equal set).

    `percent` must be 80 or more, for which the prefix lengths hold.
    """
    if percent < 80:
        raise ValueError("prefixes are sized for a similarity of 80 percent or more")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    summary = keep(docs.mapInArrow(_summary(k), "doc_id bigint, n bigint, digest binary, chunk int, part int, counts binary"), "summary")
    levels = token_levels(_sketch(summary.where("chunk is not null")))
    rows = summary.where("chunk is null").select("doc_id", "n", "digest")
    sketches = summary.where("chunk is null and n > 0").select("doc_id", "n", F.col("counts").alias("odd"))
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies")).where("copies > 1")
    copies = keep(rows.where("doc_id is not null and digest is not null").select("doc_id", "digest").join(classes, "digest").groupBy("doc_id").agg(F.min("copy_of").alias("copy_of")), "copies")
    # an id of several rows stays a node of its own, linked with what it is a copy of
    gone = copies.where("doc_id <> copy_of").join(several, "doc_id", "left_anti")
    of_several = rows.where("digest is not null").select("doc_id", "digest").join(several, "doc_id", "left_semi").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("copy_of").alias("b"))
    nodes = docs.where("doc_id is not null").join(gone.select("doc_id"), "doc_id", "left_anti")
    live = _live_keys(nodes, levels, k, frequent)

    search = _Search(docs, sketches, k, percent)
    least = F.min(F.struct("node", "n"))
    firsts = live.groupBy("key").agg(least.alias("f"), F.max("node").alias("last")).where("f.node <> last").select("key", F.col("f.node").alias("pivot"), F.col("f.n").alias("m"))
    firsts = keep(firsts, "firsts")
    links = search.linked(search.close(_star(live, firsts)), "linked")
    rest = _still_open(live.join(firsts, "key").drop("m"), links, "open").drop("nodes")
    # second star: around the smallest node of the largest component of each key but the first star's
    groups = rest.groupBy("key", "pivot", "component").agg(F.count("*").alias("nodes"), least.alias("f")).where("f.node <> pivot")
    seconds = groups.groupBy("key").agg(F.max(F.struct("nodes", "f")).alias("s")).select("key", F.col("s.f.node").alias("pivot"), F.col("s.f.n").alias("m"))
    links = keep(links.union(search.linked(search.close(_star(rest.drop("pivot"), seconds)), "linked")), "links")
    rest = _still_open(rest.drop("component", "pivot"), links, "open")
    parts = F.ceil(F.col("nodes") / BLOCK).cast("int")
    blocked = rest.join(sketches.select(F.col("doc_id").alias("node"), "odd"), "node").withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocked = blocked.withColumn("p", F.least("block", "to")).withColumn("q", F.greatest("block", "to")).select("key", "p", "q", "block", "node", "n", "component", "odd")
    near = blocked.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_near(percent), "a bigint, b bigint").distinct()
    further = search.linked(near.join(links, ["a", "b"], "left_anti"), "linked")
    found = connected_components(links.union(further).union(of_several)).select(F.col("node").alias("_node"), "component")
    own = rows.join(copies, "doc_id", "left").join(gone.select("doc_id", F.lit(True).alias("gone")), "doc_id", "left")
    own = own.withColumn("_node", F.when(F.col("gone"), F.col("copy_of")).otherwise(F.col("doc_id")))
    return own.join(found, "_node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "_node").alias("component_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document of the smallest id of each component; rows without an id stay, and all rows of a kept id."""
    found = similar_documents(docs, k, percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    return kept.select(*docs.columns)
