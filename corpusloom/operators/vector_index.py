"""Exact searches by inner product over blocks of vectors, stored or made on the way.

Vectors are packed in shards of up to SHARD rows, and in each shard cut at medians
of their widest components into blocks of up to BLOCK with a centre c and radius r. No vector of a block has
a product with q above q.c + |q| r, so a task that keeps the k best of each query
so far leaves out the blocks that can't reach the k-th. In a stored index near vectors
are put in the same shards first, and the k-th best product with its sample of vectors is where
a search starts from.

Rows whose key is null or whose vector is null, empty or holds null or non-finite
components are left out, of the vectors and of the queries. A query meets vectors of its
own length only. Products are rounded to six places; ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import entries, kept

SHARD, BLOCK, QUERIES, PIVOTS = 4096, 256, 1024, 1024
#: Bytes of queries that are sent to the tasks at a time.
MOST_SENT = 64 << 20
SLACK = 1e-6
_SHARDS = "dim int, ids binary, vectors binary, starts binary, centres binary, radii binary"
_ASKED = "dim int, q_ids binary, q_vectors binary, q_floor binary"
_FOUND = "query_id bigint, doc_id bigint, score double"
_COUNTED = "visited bigint, pairs bigint"


def usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, keys and vectors of a batch (key, vector), for each length."""
    keys, vectors = batch.column(0), batch.column(1)
    size = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends, known = np.cumsum(size), np.asarray(keys.is_valid())
    ids = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(size[known & (size > 0)]).tolist():
        rows = np.flatnonzero(known & (size == dim))
        values = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        good = np.isfinite(values).all(1)
        if good.any():
            yield rows[good], ids[rows[good]], values[good]


def cut(vectors: np.ndarray) -> list[np.ndarray]:
    """Rows of blocks: halves at the median of the widest component, until they are small."""
    out, left = [], [np.arange(len(vectors))]
    while left:
        rows = left.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        own = vectors[rows]
        order = np.argpartition(own[:, int(np.ptp(own, axis=0).argmax())], len(rows) // 2)
        left += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def _shard(ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    """One row of all these vectors; blocks don't go over from cell to cell."""
    blocks = [part[b] for c in np.unique(cells) for part in [np.flatnonzero(cells == c)] for b in cut(vectors[part])]
    order = np.concatenate(blocks)
    starts = np.cumsum([0, *map(len, blocks)])
    centres = np.array([vectors[b].mean(0) for b in blocks])
    radii = np.array([np.sqrt(((vectors[b] - c) ** 2).sum(1).max()) for b, c in zip(blocks, centres, strict=True)])
    row = [vectors.shape[1], ids[order].tobytes(), vectors[order].tobytes(), starts.astype(np.int64).tobytes(), centres.tobytes(), radii.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), *[pa.binary()] * 5], strict=True)], names=[c.split()[0] for c in _SHARDS.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a task's rows (key, vector and, where they are near by it, cell)."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        cell = batch.column(2).to_numpy() if batch.num_columns > 2 else np.zeros(batch.num_rows, np.int64)
        for rows, ids, vectors in usable(batch):
            new = [ids, vectors, cell[rows]]
            dim = vectors.shape[1]
            own = [np.concatenate(x) for x in zip(held[dim], new, strict=True)] if dim in held else new
            while len(own[0]) >= SHARD:
                yield _shard(*(x[:SHARD] for x in own))
                own = [x[SHARD:] for x in own]
            held[dim] = own
    for own in held.values():
        if len(own[0]):
            yield _shard(*own)


def _asked(shared):
    """Rows of up to QUERIES queries: their number, length, ids, vectors, and a product that k vectors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, k = shared.value
        for batch in batches:
            for _, ids, vectors in usable(batch):
                some = pivots.get(vectors.shape[1])
                for i in range(0, len(ids), QUERIES):
                    q = vectors[i : i + QUERIES]
                    floor = np.full(len(q), -np.inf)
                    if some is not None and len(some) >= k:
                        floor = np.partition(q @ some.T, len(some) - k, axis=1)[:, len(some) - k] - SLACK
                    row = [vectors.shape[1], ids[i : i + QUERIES].tobytes(), q.tobytes(), floor.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), *[pa.binary()] * 3], strict=True)], names=["dim", "q_ids", "q_vectors", "q_floor"])

    return run


class Best:
    """The k best of some queries so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.vectors, self.floor, self.k = ids, vectors, floor, k
        self.length = np.sqrt((vectors**2).sum(1))
        self.score, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.visited = self.pairs = 0

    def meet(self, ids: np.ndarray, vectors: np.ndarray, starts: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> None:
        """Look at a shard's blocks, the most promising ones first."""
        bound = self.vectors @ centres.T + self.length[:, None] * radii
        self.pairs += bound.size
        for b in np.argsort(-bound.max(0), kind="stable"):
            some = np.flatnonzero(bound[:, b] >= np.maximum(self.floor, self.score[:, -1]) - SLACK)
            if len(some):
                self.visited += len(some)
                block = slice(starts[b], starts[b + 1])
                score = np.round(self.vectors[some] @ vectors[block].T, 6)
                score = np.concatenate([self.score[some], score], 1)
                found = np.concatenate([self.found[some], np.broadcast_to(ids[block], (len(some), starts[b + 1] - starts[b]))], 1)
                order = np.lexsort((found, -score), axis=1)[:, : self.k]
                self.score[some], self.found[some] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)


def _best(shared, k: int, count: bool, pack: bool):
    """The k best of every query among a task's shards, or how many blocks were looked at. pack: the rows are vectors, to be put in shards first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[Best]] = {}
        for dim, ids, vectors, floor in shared.value:
            own.setdefault(dim, []).append(Best(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim), np.frombuffer(floor, np.float64), k))
        for batch in _packed(batches) if pack else batches:
            for i in range(batch.num_rows):
                dim, *rest = (batch.column(c)[i].as_py() for c in range(6))
                ids, vectors, starts, centres, radii = (np.frombuffer(x, kind) for x, kind in zip(rest, (np.int64, np.float64, np.int64, np.float64, np.float64), strict=True))
                for some in own.get(dim, []):
                    some.meet(ids, vectors.reshape(-1, dim), starts, centres.reshape(-1, dim), radii)
        known = [b for some in own.values() for b in some]
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([sum(b.visited for b in known)]), pa.array([sum(b.pairs for b in known)])], names=["visited", "pairs"])
            return
        for b in known:
            q, place = np.nonzero(np.isfinite(b.score))
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[q]), pa.array(b.found[q, place]), pa.array(b.score[q, place])], names=["query_id", "doc_id", "score"])

    return run


def _search(rows: DataFrame, queries: DataFrame, k: int, pivots: dict[int, np.ndarray], count: bool = False, pack: bool = False) -> DataFrame:
    """Vectors stay where they are; queries go to all tasks, in slices of about MOST_SENT bytes that are sent and searched one after the other."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((pivots, k))
    asked = kept(queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding").mapInArrow(_asked(shared), _ASKED), "queries")
    size = asked.agg(F.sum(F.length("q_vectors") + F.length("q_ids") + F.length("q_floor"))).first()[0] or 0
    slices = max(1, -(-size // MOST_SENT))
    found = []
    for i in range(slices):
        blocks = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("q_ids"), F.lit(slices)) == i).collect()]
        found.append(rows.mapInArrow(_best(spark.sparkContext.broadcast(blocks), k, count, pack), _COUNTED if count else _FOUND))
    return reduce(DataFrame.unionByName, found)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank of the k greatest inner products. vectors: doc_id, embedding; queries: query_id, embedding.

    Each task packs its own vectors; k rows a query leave it.
    """
    rows = vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), "embedding")
    return _ranked(_search(rows, queries, k, {}, pack=True), k)


class VectorIndex:
    """Shards of near vectors in a folder; each addition is a batch of its own, which counts once it is written in full."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self, table: str) -> list[str]:
        names = [n for n in entries(self.spark, f"{self.path}/shards") if "_SUCCESS" in entries(self.spark, f"{self.path}/shards/{n}")]
        return [f"{self.path}/{table}/{n}" for n in names]

    def shards(self) -> DataFrame:
        paths = self._batches("shards")
        return self.spark.read.schema(_SHARDS).parquet(*paths) if paths else self.spark.createDataFrame([], _SHARDS)

    def pivots(self) -> dict[int, np.ndarray]:
        """The samples of all batches, PIVOTS vectors of each length at most."""
        paths = self._batches("pivots")
        rows = self.spark.read.schema("dim int, vector array<double>").parquet(*paths).collect() if paths else []
        found: dict[int, list] = {}
        for dim, vector in rows:
            found.setdefault(dim, []).append(vector)
        return {dim: np.array(some[:PIVOTS]) for dim, some in found.items()}

    def add(self, vectors: DataFrame, key: str = "doc_id", column: str = "embedding") -> VectorIndex:
        """Add vectors of new keys. The sample is of the rows of the smallest hashes."""
        name = f"{len(self._batches('shards')):06d}"
        rows = vectors.select(F.col(key).cast("bigint").alias("doc_id"), F.col(column).cast("array<double>").alias("embedding"))
        fit = F.col("doc_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        sample = rows.where(fit).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PIVOTS).select(F.size("embedding").alias("dim"), F.col("embedding").alias("vector"))
        sample.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pivots/{name}")
        own: dict[int, list] = {}
        for dim, vector in self.spark.read.parquet(f"{self.path}/pivots/{name}").limit(max(1, rows.count() // BLOCK)).collect():
            own.setdefault(dim, []).append(vector)  # so many that a cell has about a block
        shared = self.spark.sparkContext.broadcast({dim: np.array(v) for dim, v in own.items()})
        near = rows.mapInArrow(_nearest_pivot(shared), "doc_id bigint, embedding array<double>, cell bigint")
        near.hint("rebalance", "cell").sortWithinPartitions("cell", "doc_id").mapInArrow(_packed, _SHARDS).write.parquet(f"{self.path}/shards/{name}")
        return self

    def keys(self) -> DataFrame:
        """doc_id of all vectors."""
        return self.shards().select("ids").mapInArrow(_unpacked, "doc_id bigint")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """As dense_topk over the vectors of the index."""
        return _ranked(_search(self.shards(), queries, k, self.pivots()), k)

    def blocks_visited(self, queries: DataFrame, k: int = 10) -> tuple[int, int]:
        """How many (query, block) pairs a search looks into, and how many there are."""
        return tuple(_search(self.shards(), queries, k, self.pivots(), count=True).agg(F.coalesce(F.sum("visited"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first())


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64))], names=["doc_id"])


def _nearest_pivot(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for rows, _, vectors in usable(batch):
                dim = vectors.shape[1]
                some = pivots.get(dim)
                cell = np.zeros(len(rows), np.int64) if some is None else (vectors @ some.T - (some**2).sum(1) / 2).argmax(1)
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array((dim << 32) + cell)], names=["doc_id", "embedding", "cell"])

    return run
