"""A stored inverted index for BM25: written once, added to and removed from in batches, searched by bounds on blocks.

Tables under the index's folder, each with a folder for a batch:

- documents: doc_id, dl, terms, tfs of the batch's documents.
- blocks, by bucket of the term: the postings of a term in a window, as places in the window
  (differences of 16 bits) and frequencies (32 bits). A window is some documents of one task in order of
  length, and each `per_cell` of them are a cell; its keys and lengths are a row of bucket -1.
- terms, by bucket: what the batch adds to the document frequency of a term.
- gone: documents of earlier batches that the batch removes or replaces.

A batch counts once its state is written, which names the batches and holds the
number of documents, their length and the vocabulary's mean idf; what a failed
batch left is never read, and of two batches written at once one fails.

Windows are made where the documents lie, so postings are dealt out once, to their buckets. No
document of a cell gets more from a term than the one that gets most. A search takes the documents that
have most of a query's rarest terms for a first floor, then goes through the cells, and scores a query's
terms in those where these bounds add up to its k-th best score so far. The k best are exact.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..sources.tables import entries, kept
from . import retrieval as R

_DOCUMENTS = "doc_id bigint, dl int, terms array<string>, tfs array<int>"
_BLOCKS = "term string, window bigint, n int, places binary, tfs binary, keys array<bigint>, dls array<int>"
_TERMS = "term string, df bigint"
_GONE = "home string, doc_id bigint, dl int"
#: Postings of a query's rarest terms that its first floor is taken from, and what rounding may hide in comparisons.
RARE, SLACK = 1000, 1e-5
#: Documents of a window (places have 16 bits) and postings at most, and bytes of marks that are sent to the tasks at a time.
WINDOW, POSTINGS, MARKS = 10_000, 2_000_000, 32 << 20

@dataclass(frozen=True)
class State:
    """What a version of the index consists of; layout is that of the tables."""

    version: int = 0
    batches: tuple[str, ...] = ()
    n_docs: int = 0
    total_dl: int = 0
    mean_idf: float = 0.0
    buckets: int = 64
    per_cell: int = 128
    layout: int = 2


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a task's documents: one row of their keys and lengths, then one for each term."""
    schema = pa.schema([("term", pa.string()), ("window", pa.int64()), ("n", pa.int32()), ("places", pa.binary()), ("tfs", pa.binary()), ("keys", pa.list_(pa.int64())), ("dls", pa.list_(pa.int32()))])
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            most = np.searchsorted(ends, POSTINGS + (ends[at - 1] if at else 0), "right")
            size = int(max(1, min(WINDOW, most - at)))
            some, at, number = batch.slice(at, size), at + size, number + 1
            some = some.take(pc.sort_indices(some, [("dl", "ascending"), ("doc_id", "ascending")]))
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), c)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number]), pa.array([size], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), whole(some.column("doc_id")), whole(some.column("dl"))], schema=schema)
            lists = some.column("terms")
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy()
            if not len(code):
                continue
            order = np.argsort(code, kind="stable")
            place = np.repeat(np.arange(size), lists.value_lengths().to_numpy(zero_copy_only=False))[order]
            n = np.bincount(code)
            start = np.cumsum(n) - n
            gap = np.diff(place, prepend=0)
            gap[start] = place[start]
            tf = some.column("tfs").flatten().to_numpy(zero_copy_only=False)[order]
            packed = lambda values, kind: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.append(start, len(values)) * np.dtype(kind).itemsize).astype("<i4").tobytes()), pa.py_buffer(values.astype(kind).tobytes())])  # noqa: E731, B023
            lacking = [pa.nulls(len(n), schema.field(c).type) for c in ("keys", "dls")]
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(np.full(len(n), number)), pa.array(n, pa.int32()), packed(gap, "<u2"), packed(tf, "<u4"), *lacking], schema=schema)


def _places(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all rows one after the other, and the row of each."""
    gap = np.frombuffer(b"".join(packed.to_pylist()), "<u2").astype(np.int64)
    n = pc.binary_length(packed).to_numpy(zero_copy_only=False) // 2
    run, start = np.cumsum(gap), np.cumsum(n) - n
    return run - np.repeat(run[start] - gap[start], n), np.repeat(np.arange(len(n)), n)


@F.arrow_udf(BinaryType())
def _marks(places: pa.Array) -> pa.Array:
    """A bit for each place, those given set."""
    return pa.array([np.packbits(np.bincount(p) > 0).tobytes() for p in places.to_pylist()], pa.binary())


def _count_marked(shared):
    """term, df: less by the places of each row (term, batch, window, places) that are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = WINDOW // 8 + 1
        number = {k: i for i, k in enumerate(shared.value)}
        marks = np.frombuffer(b"".join(v.ljust(wide, b"\0") for v in [*shared.value.values(), b""]), np.uint8)  # the last is of windows without any
        for batch in batches:
            own = np.array([number.get(k, len(number)) for k in zip(batch.column("batch").to_pylist(), batch.column("window").to_pylist(), strict=True)], np.int64)
            place, row = _places(batch.column("places"))
            marked = (marks[own[row] * wide + (place >> 3)] >> (7 - (place & 7))) & 1
            lost = np.bincount(row, marked, batch.num_rows).astype(np.int64)
            hit = pa.array(lost > 0)
            yield pa.RecordBatch.from_arrays([batch.column("term").filter(hit), pa.array(-lost).filter(hit)], names=["term", "df"])

    return run


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written meanwhile go with its end; else they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class SparseIndex:
    """The index in a folder, at its latest version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, per_cell: int = 128):
        self.spark, self.path = spark, path.rstrip("/")
        versions = [v for v in entries(spark, f"{self.path}/states") if "_SUCCESS" in entries(spark, f"{self.path}/states/{v}")]
        if versions:
            row = json.loads(spark.read.text(f"{self.path}/states/{versions[-1]}").first()[0])
            if row.get("layout", 1) != State.layout:
                raise ValueError(f"{self.path} has tables of another layout; build the index anew")
            self.state = State(**row | {"batches": tuple(row["batches"])})
        else:
            self.state = State(buckets=buckets, per_cell=per_cell)

    def _read(self, table: str, schema: str, batches: tuple[str, ...] | None = None) -> DataFrame:
        names = self.state.batches if batches is None else batches
        bucket = ", bucket int" if table in ("blocks", "terms") else ""
        schema = f"{schema}, batch string{bucket}"
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/batch={b}" for b in names))

    def _write(self, frame: DataFrame, table: str, batch: str) -> None:
        with _shuffles_dropped(self.spark):
            if table in ("blocks", "terms"):  # of like size, each of few buckets, sorted so that a term's rows are next to each other
                bucket = F.when(F.col("term").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("term"), F.lit(self.state.buckets)).cast("int"))
                frame = frame.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
                frame.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{table}/batch={batch}")
            else:
                frame.write.option("compression", "zstd").parquet(f"{self.path}/{table}/batch={batch}")

    def documents(self) -> DataFrame:
        """doc_id, dl, terms, tfs, batch of what is in the index."""
        return self._read("documents", _DOCUMENTS).join(self._gone(), ["batch", "doc_id"], "left_anti")

    def _gone(self, batches: tuple[str, ...] | None = None) -> DataFrame:
        """batch, doc_id; joins sort them, as their files are far smaller than a table of them that is sent to the tasks."""
        return self._read("gone", _GONE, batches).select(F.col("home").alias("batch"), "doc_id").hint("merge")

    def _members(self) -> DataFrame:
        """batch, window, keys, dls."""
        return self._read("blocks", _BLOCKS).where("bucket = -1").select("batch", "window", "keys", "dls")

    def _lost(self, gone: DataFrame) -> DataFrame:
        """batch, window, lost: marks of the places of these documents, for windows that have any."""
        each = self._members().select("batch", "window", F.posexplode("keys").alias("place", "doc_id"))
        return each.join(gone, ["batch", "doc_id"], "left_semi").groupBy("batch", "window").agg(_marks(F.collect_list("place")).alias("lost"))

    def add(self, docs: DataFrame, key: str = "doc_id") -> SparseIndex:
        """Add documents (key, a number that no other of them has, and text); those of a key that is there replace it. Null keys are left out."""
        batch = uuid.uuid4().hex
        rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
        self._write(R.term_counts(rows), "documents", batch)
        return self._commit(batch, self._read("documents", _DOCUMENTS, (batch,)).select("doc_id"))

    def remove(self, keys: DataFrame, key: str = "doc_id") -> SparseIndex:
        """Remove the documents of these keys; others aren't minded."""
        batch = uuid.uuid4().hex
        self._write(self.spark.createDataFrame([], _DOCUMENTS), "documents", batch)
        return self._commit(batch, keys.select(F.col(key).cast("bigint").alias("doc_id")))

    def compact(self) -> SparseIndex:
        """The same documents as one batch."""
        batch = uuid.uuid4().hex
        self._write(self.documents().select("doc_id", "dl", "terms", "tfs"), "documents", batch)
        self.state = State(version=self.state.version, buckets=self.state.buckets, per_cell=self.state.per_cell)
        return self._commit(batch, self.spark.createDataFrame([], "doc_id bigint"))

    def _commit(self, batch: str, replaced: DataFrame) -> SparseIndex:
        docs = self._read("documents", _DOCUMENTS, (batch,))
        gone = self.documents().select("batch", "doc_id", "dl").join(replaced.hint("merge"), "doc_id", "left_semi").select(F.col("batch").alias("home"), "doc_id", "dl")
        self._write(gone, "gone", batch)
        self._write(docs.select("doc_id", "dl", "terms", "tfs").mapInArrow(_windows, _BLOCKS), "blocks", batch)
        changes = self._read("blocks", _BLOCKS, (batch,)).where("bucket <> -1").select("term", F.col("n").cast("bigint").alias("df"))
        for less in self._less(self._gone((batch,))):
            changes = changes.unionByName(less)
        self._write(changes.groupBy("term").agg(F.sum("df").alias("df")), "terms", batch)
        sizes = F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")
        more, fewer = docs.agg(*sizes).first(), self._read("gone", _GONE, (batch,)).agg(*sizes).first()
        state = replace(self.state, version=self.state.version + 1, batches=(*self.state.batches, batch), n_docs=self.state.n_docs + more["n"] - fewer["n"], total_dl=self.state.total_dl + more["dl"] - fewer["dl"])
        with _shuffles_dropped(self.spark):
            df = self._read("terms", _TERMS, state.batches).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            state = replace(state, mean_idf=df.agg(F.avg(R.raw_idf(state.n_docs))).first()[0] or 0.0)
        self.spark.createDataFrame([(json.dumps(asdict(state)),)], "value string").coalesce(1).write.text(f"{self.path}/states/{state.version:08d}")
        self.state = state
        return self

    def _less(self, gone: DataFrame) -> Iterator[DataFrame]:
        """term, df: what the terms lose by these documents; their marks, a bit for each document of a window, are sent to the tasks in slices."""
        lost = kept(self._lost(gone), "lost")
        slices = max(1, -(-lost.count() * WINDOW // 8 // MARKS))
        for i in range(slices):
            marks = {(r["batch"], r["window"]): bytes(r["lost"]) for r in lost.where(F.pmod(F.xxhash64("batch", "window"), F.lit(slices)) == i).collect()}
            if marks:
                homes = [r[0] for r in gone.select("batch").distinct().collect()]
                rows = self._read("blocks", _BLOCKS).where((F.col("bucket") != -1) & F.col("batch").isin(homes)).select("term", "batch", "window", "places")
                yield rows.mapInArrow(_count_marked(self.spark.sparkContext.broadcast(marks)), _TERMS)

    def _mean_dl(self) -> float:
        return self.state.total_dl / self.state.n_docs if self.state.total_dl else 1.0

    def _in_buckets(self, table: str, schema: str, asked: DataFrame) -> DataFrame:
        """Rows of a table in the buckets of the asked terms, of which there are few at most; they are partitions of its files."""
        return self._read(table, schema).where(F.col("bucket").isin([r[0] for r in asked.select("bucket").distinct().collect()]))

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Weights (query_id, term, weight, df) of the queries' terms, and their blocks."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.state.buckets)).cast("int").alias("bucket")
        asked = kept(R.asked_terms(queries).select("query_id", "term", bucket, "qtf"), "asked")
        wanted = _few(asked.select("bucket", "term").distinct())
        df = self._in_buckets("terms", _TERMS, asked).join(wanted, ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        weights = asked.join(df, "term").select("query_id", "term", (F.col("qtf") * R.idf_of(self.state.n_docs, F.lit(self.state.mean_idf))).alias("weight"), "df")
        return kept(weights, "weights"), self._in_buckets("blocks", _BLOCKS, asked).join(wanted, ["bucket", "term"], "left_semi")

    def _floors(self, weights: DataFrame, blocks: DataFrame, lost: DataFrame, k: int) -> DataFrame:
        """query_id, floor: the k-th best score of those documents that have most of a query's rarest terms."""
        before = F.sum("df").over(Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
        rare = kept(weights.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < RARE), "rare")
        met = self._cells(rare, blocks.join(_few(rare.select("term").distinct()), "term", "left_semi"), lost, {}, k)
        first = _few(kept(R.top(met, k).select("doc_id").distinct(), "first"))
        some = self._read("documents", _DOCUMENTS).join(first, "doc_id", "left_semi").join(self._gone(), ["batch", "doc_id"], "left_anti")
        return R.top(R.score_counts(some, weights, k, self._mean_dl()), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    def _cells(self, weights: DataFrame, blocks: DataFrame, lost: DataFrame, floors: dict, k: int, count: bool = False) -> DataFrame:
        """What the tasks find in these blocks, each window's with its documents."""
        own = self._members().join(lost, ["batch", "window"], "left")
        rows = own.unionByName(blocks.select("batch", "window", "term", "places", "tfs"), allowMissingColumns=True)
        dealt = rows.select("batch", "window", "term", "places", "tfs", "keys", "dls", "lost").repartition("batch", "window").sortWithinPartitions("batch", "window")
        kinds = "looked bigint, pairs bigint" if count else "query_id bigint, doc_id bigint, score double"
        found = []
        for shared in R.sent_weights(weights):
            least = np.array([floors.get(q, -np.inf) for q in shared.value.ids.to_pylist()])
            found.append(dealt.mapInArrow(_score_cells(shared, self.spark.sparkContext.broadcast(least), k, self._mean_dl(), self.state.per_cell, count), kinds))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], kinds)

    def _found(self, queries: DataFrame, k: int, count: bool = False) -> DataFrame:
        weights, blocks = self._asked(queries)
        lost = kept(self._lost(self._gone()), "lost")
        with _shuffles_dropped(self.spark):
            floors = dict(self._floors(weights, blocks, lost, k).collect())  # a number for each query
        return self._cells(weights, blocks, lost, floors, k, count)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, doc_id, score, rank as by bm25_topk. queries: query_id (a whole number), text."""
        return R.with_zeros(self._found(queries, k), queries, self.documents(), k)

    def blocks_read(self, queries: DataFrame, k: int = 10) -> tuple[int, int]:
        """How many (query, block) pairs a search scores, and how many there are of the queries' terms; a block is a term in a cell."""
        return tuple(self._found(queries, k, count=True).agg(F.coalesce(F.sum("looked"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first())


def _few(frame: DataFrame) -> DataFrame:
    """The rows to be sent to the tasks, unless they are more than is sent at a time."""
    return F.broadcast(frame) if frame.count() <= R.MOST_SENT else frame


def _score_cells(shared, floors, k: int, mean_dl: float, per_cell: int, count: bool):
    """The k best of each query among a task's windows, or how many blocks were scored for it; a query leaves out cells whose blocks' bounds add up to less than its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        best, looked, pairs = R.Leaders(w, k, pa.int64(), floors.value.copy()), 0, 0

        def score(window: pa.Table) -> None:
            own = window.filter(pc.is_null(window.column("term"))).to_pylist()[0]
            term = pc.index_in(window.column("term"), w.terms).fill_null(-1).to_numpy()
            window, term = window.filter(pa.array(term >= 0)), term[term >= 0]
            if not len(term):
                return
            keys, dl = np.array(own["keys"], np.int64), np.array(own["dls"], np.float64)
            place, row = _places(window.column("places").combine_chunks())
            tf = np.frombuffer(b"".join(window.column("tfs").to_pylist()), "<u4").astype(np.float64)
            if own["lost"]:
                left = np.unpackbits(np.frombuffer(own["lost"], np.uint8), count=len(keys))[place] == 0
                place, row, tf = place[left], row[left], tf[left]
            order = np.argsort(place // per_cell, kind="stable")  # by cell, term and place
            place, row = place[order], row[order]
            use = R.saturation(tf[order], dl[place], mean_dl)
            ends = np.searchsorted(place // per_cell, np.arange(-(-len(keys) // per_cell)), "right")
            for first, a, b in zip(np.arange(len(ends)) * per_cell, [0, *ends[:-1]], ends, strict=True):
                if a < b:
                    cell(term, keys[first : first + per_cell], place[a:b] - first, row[a:b], use[a:b])

        def cell(term, keys, place, row, use) -> None:
            nonlocal looked, pairs
            start = np.flatnonzero(np.diff(row, prepend=-1))
            size, most = np.diff(start, append=len(row)), np.maximum.reduceat(use, start)
            at, pair = w.pairs(term[row[start]])
            bound = np.bincount(w.query[pair], np.maximum(w.weight[pair] * most[at], 0.0), best.n)
            pairs += len(pair)
            may = (bound >= best.floor - SLACK)[w.query[pair]]
            at, pair = at[may], pair[may]
            looked += len(pair)
            if not len(pair):
                return
            of = np.repeat(np.arange(len(at)), size[at])
            post = np.arange(len(of)) - np.repeat(np.cumsum(size[at]) - size[at], size[at]) + np.repeat(start[at], size[at])
            asked, q = np.unique(w.query[pair], return_inverse=True)
            slot = place[post] * len(asked) + q[of]
            total = np.round(np.bincount(slot, w.weight[pair][of] * use[post], len(keys) * len(asked)), 6).reshape(len(keys), -1)
            there = (np.bincount(slot, minlength=len(keys) * len(asked)) > 0).reshape(len(keys), -1)
            r, c = np.nonzero(there & (total >= best.floor[asked] - SLACK))
            if len(r):
                best.add(asked[c], total[r, c], pa.array(keys[r]))

        held: list[pa.Table] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            window, home = batch.column("window").to_numpy(), batch.column("batch").to_pylist()
            cut = [i for i in range(1, len(home)) if window[i] != window[i - 1] or home[i] != home[i - 1]]
            for a, b in zip([0, *cut], [*cut, len(home)], strict=True):
                if held and (held[-1].column("window")[0].as_py() != window[a] or held[-1].column("batch")[0].as_py() != home[a]):
                    score(pa.concat_tables(held))
                    held = []
                held.append(rows.slice(a, b - a))
        if held:
            score(pa.concat_tables(held))
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([looked]), pa.array([pairs])], names=["looked", "pairs"])
        else:
            yield best.batch("doc_id")

    return run
