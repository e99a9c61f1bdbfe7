"""Nearest neighbours by vantage-point trees, one per shard of vectors.

A tree's node splits its vectors at the median distance to a vantage point and
keeps the range of distances of both halves. A search descends into the half
where the query lies, then into the other unless the triangle inequality shows
that it holds nothing nearer than the k-th nearest so far. With `factor` above
one that bound is scaled up, which prunes more and may lose neighbours; factor
one is exact. All queries of a block go down a tree together.

Every vector is in one shard's tree. Queries are gathered in blocks of about
`block`, and each task searches its shards for all blocks that are sent to it; the driver holds
one slice of them at a time, of a fixed size. Vectors that are null, empty, zero or hold null or non-finite
components are neither queries nor candidates. A row of the query's own id is not
its candidate; of several vectors of such an id the smallest, by components, is the
query. Queries are compared with vectors of their own dimension only. Ties go to
the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

_SHARD = "dim int, ids binary, vectors binary, vantage binary, first binary, last binary, bounds binary"
LEAF = 64


def usable(batch: pa.RecordBatch, key: str, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors (float64) of the usable rows, for each dimension."""
    ids, vectors = batch.column(key), batch.column(column)
    ok = np.ones(batch.num_rows, bool) if not ids.null_count else ~np.asarray(ids.is_null())
    size = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[ok & (size > 0)]):
        rows = np.flatnonzero(ok & (size == dim))
        values = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        good = np.isfinite(values).all(1) & (values != 0).any(1)
        yield number[rows[good]], values[good]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


class Tree:
    """Arrays of a vantage-point tree; node i's halves are nodes 2 i + 1 (near) and 2 i + 2 (far)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids.copy(), vectors.copy()
        n_nodes = 1
        while len(ids) / ((n_nodes + 1) // 2) > LEAF:
            n_nodes = 2 * n_nodes + 1
        self.first, self.last = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
        self.vantage = np.full(n_nodes, -1, np.int64)
        self.bounds = np.zeros((n_nodes, 4))  # least and greatest distance of the near half, of the far half
        self.last[0] = len(ids)
        for node in range(n_nodes // 2):
            a, b = self.first[node], self.last[node]
            near, far = 2 * node + 1, 2 * node + 2
            if b - a < 2:
                self.first[near] = self.first[far] = self.last[near] = self.last[far] = a
                self.first[near], self.last[near] = a, b
                self.first[far] = self.last[far] = b
                self.bounds[node] = [0, np.inf, np.inf, np.inf]
                self.vantage[node] = a
                continue
            sample = self.vectors[a : b : max(1, (b - a) // 16)]
            spread = [distances(self.vectors[a:b:max(1, (b - a) // 256)], v).var() for v in sample]
            point = sample[int(np.argmax(spread))].copy()
            d = distances(self.vectors[a:b], point)
            order = np.argsort(d, kind="stable")
            self.ids[a:b], self.vectors[a:b], d = self.ids[a:b][order], self.vectors[a:b][order], d[order]
            middle = (b - a) // 2
            self.first[near], self.last[near], self.first[far], self.last[far] = a, a + middle, a + middle, b
            self.bounds[node] = [d[0], d[middle - 1], d[middle], d[-1]]
            self.vantage[node] = node
            self._points = getattr(self, "_points", {})
            self._points[node] = point
        points = getattr(self, "_points", {})
        self.points = np.array([points.get(i, np.zeros(vectors.shape[1])) for i in range(n_nodes // 2)]).reshape(n_nodes // 2, vectors.shape[1])

    def row(self) -> list:
        return [self.vectors.shape[1], self.ids.tobytes(), self.vectors.tobytes(), self.points.tobytes(), self.first.tobytes(), self.last.tobytes(), self.bounds.tobytes()]

    @classmethod
    def of(cls, row: dict) -> Tree:
        tree = cls.__new__(cls)
        tree.ids = np.frombuffer(row["ids"], np.int64)
        tree.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        tree.points = np.frombuffer(row["vantage"], np.float64).reshape(-1, row["dim"])
        tree.first, tree.last = (np.frombuffer(row[c], np.int64) for c in ("first", "last"))
        tree.bounds = np.frombuffer(row["bounds"], np.float64).reshape(-1, 4)
        return tree


class Nearest:
    """The k nearest found so far of a block of queries of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.d = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.measured = 0

    def add(self, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        for some in np.array_split(q, len(q) * vectors.size // 4_000_000 + 1):
            d = distances(self.vectors[some][:, None, :], vectors[None])
            self.measured += d.size
            d[ids[None] == self.ids[some][:, None]] = np.inf
            some_ids = np.where(np.isinf(d), np.iinfo(np.int64).max, ids[None])
            d, some_ids = np.concatenate([self.d[some], d], 1), np.concatenate([self.found[some], some_ids], 1)
            order = np.lexsort((some_ids, d), axis=1)[:, : self.k]
            self.d[some], self.found[some] = np.take_along_axis(d, order, 1), np.take_along_axis(some_ids, order, 1)

    def search(self, tree: Tree, factor: float) -> None:
        def visit(node: int, q: np.ndarray) -> None:
            if not len(q) or tree.first[node] >= tree.last[node]:
                return
            if 2 * node + 1 >= len(tree.first):
                self.add(q, tree.ids[tree.first[node] : tree.last[node]], tree.vectors[tree.first[node] : tree.last[node]])
                return
            d = distances(self.vectors[q], tree.points[node])
            low, high, far_low, far_high = tree.bounds[node]
            near_first = d <= (high + far_low) / 2 if np.isfinite(far_low) else np.ones(len(q), bool)

            def may(which: np.ndarray, a: float, b: float) -> np.ndarray:
                outside = np.maximum(np.maximum(a - d[which], d[which] - b), 0) if np.isfinite(a) else np.full(int(which.sum()), np.inf)
                return q[which][factor * outside <= self.d[q[which], -1] * (1 + 1e-12)]

            visit(2 * node + 1, may(near_first, low, high))
            visit(2 * node + 2, may(~near_first, far_low, far_high))
            visit(2 * node + 2, may(near_first, far_low, far_high))
            visit(2 * node + 1, may(~near_first, low, high))

        visit(0, np.arange(len(self.ids)))


def _build(key: str, column: str, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def emit(dim: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(Tree(ids, vectors).row(), [pa.int32(), *[pa.binary()] * 6], strict=True)], names=[c.split()[0] for c in _SHARD.split(", ")])

        for batch in batches:
            for ids, vectors in usable(batch, key, column):
                dim = vectors.shape[1]
                was = held.get(dim)
                ids, vectors = (np.concatenate([was[0], ids]), np.concatenate([was[1], vectors])) if was else (ids, vectors)
                while len(ids) >= shard:
                    yield emit(dim, ids[:shard], vectors[:shard])
                    ids, vectors = ids[shard:], vectors[shard:]
                held[dim] = [ids, vectors]
        for dim, (ids, vectors) in held.items():
            if len(ids):
                yield emit(dim, ids, vectors)

    return run


def _gathered(key: str, column: str):
    """One row of the usable queries of each dimension of a task's rows: their block, ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            number = batch.column("block").to_numpy()
            for b in np.unique(number).tolist():
                for ids, vectors in usable(batch.filter(pa.array(number == b)), key, column):
                    held.setdefault((b, vectors.shape[1]), []).append((ids, vectors))
        rows = [(b, dim, np.concatenate([i for i, _ in x]).tobytes(), np.concatenate([v for _, v in x]).tobytes()) for (b, dim), x in held.items()]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["block", "dim", "query_ids", "query_vectors"])

    return run


def _search(shared, k: int, factor: float):
    """The nearest of each query among the shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, list[Nearest]] = {}
        for dim, ids, vectors in shared.value:
            states.setdefault(dim, []).append(Nearest(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim), k))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tree = Tree.of(row)
                for state in states.get(row["dim"], []):
                    state.search(tree, factor)
        for own in states.values():
            for state in own:
                q, place = np.nonzero(np.isfinite(state.d))
                yield pa.RecordBatch.from_arrays([pa.array(state.ids[q]), pa.array(state.found[q, place]), pa.array(state.d[q, place])], names=["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, factor: float = 1.0, shard: int = 4096, block: int = 8192, sent: int = 64 << 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`.

    Shards stay where they are. The queries are sent to all tasks in slices of about
    `sent` bytes, searched one after the other; a task leaves k rows of each query.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias(key), column)
    index = keep(rows.mapInArrow(_build(key, column, shard), _SHARD), "trees")
    fit = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    chosen = keep(rows.where((F.col(key) % every == 0) & fit).groupBy(key).agg(F.min(column).alias(column)), "queries")
    blocks = max(1, -(-chosen.count() // block))
    numbered = chosen.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    gathered = keep(numbered.repartition(blocks, "block").mapInArrow(_gathered(key, column), "block int, dim int, query_ids binary, query_vectors binary"), "blocks")
    size = gathered.agg(F.sum(F.length("query_ids") + F.length("query_vectors"))).first()[0] or 0
    slices = max(1, min(gathered.count(), -(-size // sent)))
    found = []
    for i in range(slices):
        some = gathered.where(F.pmod(F.xxhash64("query_ids"), F.lit(slices)) == i).select("dim", "query_ids", "query_vectors").collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in some])
        found.append(index.mapInArrow(_search(shared, k, factor), "query_id bigint, vec_id bigint, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return reduce(DataFrame.unionByName, found).select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
