"""Sparse and dense retrieval, rank fusion, merging, shaping and context blocks over ranked tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import contains_any
from ..sources.tables import kept
from .vector_index import dense_topk

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Scores that a task works out at a time, and rows of weights that are sent to the tasks at a time.
SCORES, MOST_SENT = 1 << 21, 500_000


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            some = batch.slice(start, 1000)
            counts = [Counter(T.tokens_of(t)) for t in some.column("text").to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
            own = [
                pa.array([sum(c.values()) for c in counts], pa.int32()),
                pa.ListArray.from_arrays(ends, pa.array([t for c in counts for t in c], pa.string())),
                pa.ListArray.from_arrays(ends, pa.array([n for c in counts for n in c.values()], pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([some.column(0), *own], names=[some.schema.names[0], "dl", "terms", "tfs"])


def term_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, dl, terms, tfs: the number of search tokens of each text, its distinct ones and how often it has each.

    One pass in which no row leaves its task.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(_count_terms, f"`{key}` {kind}, dl int, terms array<string>, tfs array<int>")


def each_term(counts: DataFrame, *columns: str) -> DataFrame:
    """The columns, term and tf, a row for each term of term_counts."""
    return counts.select(*columns, F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(*columns, F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))


def postings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """term, key, tf, dl."""
    return each_term(term_counts(docs, key), key, "dl").select("term", key, F.col("tf").cast("bigint").alias("tf"), "dl")


def raw_idf(n_docs: int, df: str = "df") -> Column:
    return F.log(F.lit(float(n_docs)) - F.col(df) + 0.5) - F.log(F.col(df) + 0.5)


def idf_of(n_docs: int, mean: Column, df: str = "df") -> Column:
    """The raw idf; a negative one becomes EPSILON times the mean of the vocabulary's."""
    raw = raw_idf(n_docs, df)
    return F.when(raw < 0, EPSILON * mean).otherwise(raw)


def term_idf(post: DataFrame, n_docs: int) -> DataFrame:
    """term, df, idf of rows of which each is one document's term."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    mean = df.agg(F.avg(raw_idf(n_docs)).alias("mean"))  # one row
    return df.crossJoin(F.broadcast(mean)).select("term", "df", idf_of(n_docs, F.col("mean")).alias("idf"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf of queries (query_id, text)."""
    return each_term(term_counts(queries, "query_id"), "query_id").groupBy("query_id", "term").agg(F.sum("tf").alias("qtf"))


def saturation(tf, dl, mean_dl: float):
    """What tf counts for, of columns or arrays; it grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean_dl))


class Weights:
    """What the terms of some queries weigh, to be sent to tasks."""

    def __init__(self, rows: pa.Table):
        self.ids = pc.unique(rows.column("query_id").combine_chunks())
        self.terms = pc.unique(rows.column("term").combine_chunks())
        query = pc.index_in(rows.column("query_id"), self.ids).to_numpy()
        term = pc.index_in(rows.column("term"), self.terms).to_numpy()
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order].astype(np.int64), rows.column("weight").to_numpy()[order]
        self.size = np.bincount(term, minlength=len(self.terms))
        self.start = np.cumsum(self.size) - self.size

    def pairs(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query of each of these terms: place of the term in the list, and number of the pair."""
        size = self.size[term]
        at = np.repeat(np.arange(len(term)), size)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[term], size)


class Leaders:
    """The k best keys of each query so far."""

    def __init__(self, weights: Weights, k: int, kind: pa.DataType, floor: np.ndarray | None = None):
        self.weights, self.k, self.n = weights, k, len(weights.ids)
        self.rows = pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "key": pa.array([], kind)})
        self.floor = np.full(self.n, -np.inf) if floor is None else floor

    def add(self, query: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        more = pa.table({"q": pa.array(query), "score": pa.array(score), "key": keys})
        rows = pa.concat_tables([self.rows, more.cast(self.rows.schema)])
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("score", "descending"), ("key", "ascending")]))
        q = rows.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.rows = rows.filter(pa.array(place < self.k)).combine_chunks()
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], rows.column("score").to_numpy()[last])

    def batch(self, key: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.weights.ids.take(self.rows.column("q").combine_chunks()), self.rows.column("key").combine_chunks(), self.rows.column("score").combine_chunks()], names=["query_id", key, "score"])


def _score_counts(shared, k: int, mean_dl: float):
    """The k best of each query among a task's documents (key, dl, terms, tfs); one without its terms has the score 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, best = shared.value, None
        step = max(1, SCORES // max(1, len(w.ids)))
        for batch in batches:
            best = best or Leaders(w, k, batch.schema.field(0).type)
            for i in range(0, batch.num_rows, step):
                some = batch.slice(i, step)
                some = some.take(pc.sort_indices(some.column(0)))
                lists = some.column("terms")
                row = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                term = pc.index_in(lists.flatten(), w.terms).fill_null(-1).to_numpy(zero_copy_only=False)
                hit = term >= 0
                row, term, tf = row[hit], term[hit], some.column("tfs").flatten().to_numpy(zero_copy_only=False)[hit]
                use = saturation(tf.astype(np.float64), some.column("dl").to_numpy()[row].astype(np.float64), mean_dl)
                at, pair = w.pairs(term)
                score = np.bincount(row[at] * best.n + w.query[pair], w.weight[pair] * use[at], some.num_rows * best.n).reshape(-1, best.n)
                score = np.round(score, 6)
                may = (score >= best.floor) & (score != 0)
                may[:k] |= best.floor <= 0  # of those without a term the smallest keys
                r, q = np.nonzero(may)
                best.add(q, score[r, q], some.column(0).take(pa.array(r)))
        if best:
            yield best.batch(batch.schema.names[0])

    return run


def sent_weights(weights: DataFrame) -> Iterator:
    """The weights (query_id, term, weight) as broadcast variables of about MOST_SENT rows, a query's rows in one of them."""
    weights = kept(weights.select("query_id", "term", "weight"), "weights")
    slices = max(1, -(-weights.count() // MOST_SENT))
    for i in range(slices):
        rows = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i).toArrow()
        if rows.num_rows:
            yield weights.sparkSession.sparkContext.broadcast(Weights(rows))


def score_counts(counts: DataFrame, weights: DataFrame, k: int, mean_dl: float, key: str = "doc_id") -> DataFrame:
    """query_id, key, score of each query's best among the documents of each task; documents are neither joined nor shuffled."""
    kinds = f"query_id {weights.schema['query_id'].dataType.simpleString()}, `{key}` {counts.schema[key].dataType.simpleString()}, score double"
    found = [counts.select(key, "dl", "terms", "tfs").mapInArrow(_score_counts(shared, k, mean_dl), kinds) for shared in sent_weights(weights)]
    return reduce(DataFrame.unionByName, found) if found else counts.sparkSession.createDataFrame([], kinds)


def with_zeros(found: DataFrame, queries: DataFrame, counts: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best of found (query_id, key, score), where the k smallest keys have at least the score 0 in each list; no others can enter with it."""
    least = [r[0] for r in counts.select(key).orderBy(key).limit(k).collect()]
    every = F.explode(F.array(*(F.lit(v) for v in least)).cast(f"array<{counts.schema[key].dataType.simpleString()}>"))
    zeros = queries.select("query_id", every.alias(key)).distinct().withColumn("zero", F.lit(True))
    both = found.select("query_id", key, "score").join(zeros, ["query_id", key], "full_outer")
    return top(both.select("query_id", key, F.coalesce("score", F.lit(0.0)).alias("score")), k, key)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """query_id, key, score (six places), rank. queries: query_id, text; repeated query tokens count each time.

    The documents' terms are counted once and kept as a table. The queries' terms and weights
    go to the tasks, which score their documents and keep k for each query. Documents
    without a query's terms have the score 0 and, smallest key first, fill lists of fewer than k.
    """
    counts = kept(term_counts(docs, key), "terms")
    n, mean_dl = counts.agg(F.count("*"), F.avg("dl")).first()
    df = kept(counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    mean = df.agg(F.avg(raw_idf(n))).first()[0] or 0.0
    weights = asked_terms(queries).join(df, "term").select("query_id", "term", (F.col("qtf") * idf_of(n, F.lit(mean))).alias("weight"))
    return with_zeros(score_counts(counts, weights, k, float(mean_dl or 1.0), key), queries, counts, k, key)


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


FUSIONS = {
    "rrf": lambda d, s, k: fuse_rrf(d, s, k),
    "weighted": lambda d, s, k: fuse_scores(d, s, k),
    "weighted_rrf": lambda d, s, k: fuse_rrf(d, s, k, dense_weight=0.5, sparse_weight=0.5),
    "combmnz": lambda d, s, k: fuse_scores(d, s, k, times_lists=True),
}


def retrieve(docs: DataFrame, vectors: DataFrame, queries: DataFrame, mode: str = "hybrid", k: int = 10, fetch: int = 120, method: str = "rrf") -> DataFrame:
    """query_id, doc_id, score, rank, source of a sparse, dense or hybrid search; closedbook finds nothing.

    queries: query_id, text, embedding. A hybrid search takes `fetch` of each list; a fusion
    method that isn't known counts as rrf.
    """
    if mode == "closedbook":
        return queries.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank int, source string")
    if mode not in ("sparse", "dense", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    n = max(fetch, k) if mode == "hybrid" else k
    sparse = bm25_topk(docs, queries.select("query_id", "text"), n) if mode != "dense" else None
    dense = dense_topk(vectors, queries.select("query_id", "embedding"), n) if mode != "sparse" else None
    found = FUSIONS.get(method, FUSIONS["rrf"])(dense, sparse, k) if mode == "hybrid" else sparse if dense is None else dense
    return found.select("query_id", "doc_id", "score", "rank", F.lit(mode).alias("source"))


def annotate(ranked: DataFrame, variant: str) -> DataFrame:
    """Ranked rows with the name of the query variant that found them."""
    return ranked.withColumn("query_variant", F.lit(variant))


def distinct_variants(variants: DataFrame) -> DataFrame:
    """query_id, place, variant: the first of each wording, whatever its case and white space, in order of place."""
    key = F.lower(T.normalize_whitespace(F.col("variant")))
    own = Window.partitionBy("query_id", key).orderBy("place")
    rows = variants.where(key != "").withColumn("o", F.row_number().over(own)).where("o = 1")
    return rows.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).alias("place"), "variant")


def _both(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    d = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    return d.join(s, ["query_id", "doc_id"], "full_outer")


def _ranked(fused: DataFrame, k: int, *ties) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties, "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def fuse_rrf(dense: DataFrame, sparse: DataFrame, k: int = 10, constant: int = 60, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """Sum of weight / (constant + rank); ties keep the dense list's order, then the sparse one's."""
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (constant + F.col(rank)), F.lit(0.0))
    fused = _both(dense, sparse).withColumn("score", F.round(part("dense_rank", dense_weight) + part("sparse_rank", sparse_weight), 9))
    return _ranked(fused, k, F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))


def fuse_scores(dense: DataFrame, sparse: DataFrame, k: int = 10, alpha: float = 0.5, times_lists: bool = False) -> DataFrame:
    """alpha dense + (1 - alpha) sparse of scores scaled to 0..1 per list; times the number of lists for CombMNZ."""
    per = Window.partitionBy("query_id")

    def scaled(c: str):
        low, high = F.min(c).over(per), F.max(c).over(per)
        return F.coalesce((F.col(c) - low) / F.when(high > low, high - low).otherwise(1.0), F.lit(0.0))

    both = _both(dense, sparse)
    score = alpha * scaled("dense_score") + (1 - alpha) * scaled("sparse_score")
    if times_lists:
        score = score * (F.col("dense_score").isNotNull().cast("int") + F.col("sparse_score").isNotNull().cast("int"))
    return _ranked(both.withColumn("score", F.round(score, 6)), k)


def merge_lists(lists: DataFrame, keep_n: int, bonus: float = 0.002) -> DataFrame:
    """query_id, doc_id, score, votes, rank of several ranked lists (list_no, rank): best score and a bonus for up to three more votes."""
    per = Window.partitionBy("query_id", "doc_id")
    best = lists.withColumn("votes", F.count("*").over(per)).withColumn("first", F.min(F.struct("list_no", "rank")).over(per)).withColumn("o", F.row_number().over(per.orderBy(F.desc("score"), "list_no", "rank"))).where("o = 1")
    scored = best.withColumn("score", F.round(F.col("score") + bonus * F.least(F.lit(3), F.col("votes") - 1), 6))
    return _kept(scored, keep_n, F.desc("score"), "first").select("query_id", "doc_id", "score", "votes", "rank")


def _kept(rows: DataFrame, n: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)


def preserve_primary(primary: DataFrame, merged: DataFrame, preserve_n: int, keep_n: int) -> DataFrame:
    """query_id, doc_id, score, rank: the first preserve_n of the primary list, then the merged list, then the rest of the primary; scores are the merged list's where it has a row."""
    p = primary.select("query_id", "doc_id", F.col("rank").alias("p"), F.col("score").alias("own"))
    m = merged.select("query_id", "doc_id", F.col("rank").alias("m"), F.col("score").alias("score"))
    tier = F.when(F.col("p") <= preserve_n, 0).when(F.col("m").isNotNull(), 1).otherwise(2)
    place = F.when(tier == 1, F.col("m")).otherwise(F.col("p"))
    both = p.join(m, ["query_id", "doc_id"], "full_outer").withColumn("tier", tier).withColumn("place", place)
    return _kept(both, keep_n, "tier", "place", "doc_id").select("query_id", "doc_id", F.coalesce("score", "own").alias("score"), "rank")


def diversify(ranked: DataFrame, group: str, cap: int, k: int) -> DataFrame:
    """At most `cap` rows of each group in rank order, then the others, cut to k."""
    own = Window.partitionBy("query_id", group).orderBy("rank", "doc_id")
    return _kept(ranked.withColumn("over", F.row_number().over(own) > cap).withColumnRenamed("rank", "old_rank"), k, "over", "old_rank", "doc_id").drop("over")


def _snippets(ranked: DataFrame, budget: int) -> DataFrame:
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    text = T.strip(F.col("text"))
    room = F.lit(budget) - F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    return ranked.withColumn("room", room).where("room > 0").withColumn("snippet", F.substring(text, F.lit(1), F.col("room").cast("int"))).drop("room")


def context_snippets(ranked: DataFrame, budget: int = 5000) -> DataFrame:
    """query_id, doc_id, rank, snippet: texts cut to what is left of a budget of characters, in rank order."""
    return _snippets(ranked, budget).select("query_id", "doc_id", "rank", "snippet")


def context_blocks(ranked: DataFrame, budget: int = 5000) -> DataFrame:
    """query_id, context: numbered snippets under headers of title and source_url, where a row has them. Headers aren't counted."""
    has = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) if c in ranked.columns else F.lit(None).cast("string")
    header = F.concat_ws(" | ", F.concat(F.lit("["), F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("string"), F.lit("]")), has("title"), has("source_url"))
    parts = _snippets(ranked, budget).select("query_id", "rank", F.concat(header, F.lit("\n"), "snippet").alias("part"))
    return parts.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("context"))


# fixed values: words in titles and addresses of pages that list things
LIST_HINTS = ("list of", "/list", "directory", "/directory", "/people", "/faculty", "/staff")


def shape_scores(ranked: DataFrame, question: str = "question") -> DataFrame:
    """Scores with additions for the question's terms, and ranks by them.

    .06 for each term in the title (at most .24), .03 in source_url or source_path (.12), .015 in
    the text's first 1200 characters (.12); .08 less where title or address look like a list. Columns
    that aren't there count as empty. Adds shape_adj and pre_shape_score.
    """
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c in ranked.columns else F.lit("") for c in ("title", "source_url", "source_path", "text")}
    rows = ranked.withColumns({f"_{c}": v for c, v in low.items()} | {"_terms": T.query_terms(F.col(question))})
    hits = lambda test: F.size(F.filter("_terms", test))
    inside = lambda c: lambda t: F.contains(F.col(c), t)
    boost = (
        F.least(F.lit(0.24), 0.06 * hits(inside("_title")))
        + F.least(F.lit(0.12), 0.03 * hits(lambda t: F.contains(F.col("_source_url"), t) | F.contains(F.col("_source_path"), t)))
        + F.least(F.lit(0.12), 0.015 * hits(lambda t: F.contains(F.substring("_text", 1, 1200), t)))
    )
    names = F.concat_ws(" ", "_title", "_source_url", "_source_path")
    listed = contains_any(names, LIST_HINTS)
    rows = rows.withColumn("shape_adj", F.when(F.size("_terms") == 0, 0.0).otherwise(F.round(boost - F.when(listed, 0.08).otherwise(0.0), 6)))
    rows = rows.withColumn("pre_shape_score", F.col("score")).withColumn("score", F.round(F.col("score") + F.col("shape_adj"), 6)).withColumnRenamed("rank", "_rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_rank")
    return rows.withColumn("rank", F.row_number().over(order)).drop("_rank", "_terms", *(f"_{c}" for c in low))


def parent_contexts(ranked: DataFrame, chunks: DataFrame, min_hits: int = 2, window: int = 1, max_chars: int = 2400, most: int = 3) -> DataFrame:
    """query_id, place, doc_id, first_chunk, last_chunk, text: found chunks of a document and their neighbours as one text.

    ranked: query_id, doc_id, chunk_index, score, rank. Documents of `min_hits`
    found chunks or more count, the `most` best per query; a longer text is cut at
    the last space before `max_chars`. A query without such a document keeps its
    chunks in rank order. Only found chunks and their neighbours are gathered.
    """
    parents = ranked.groupBy("query_id", "doc_id").agg(F.max("score").alias("best"), F.count("*").alias("hits"), F.min("rank").alias("seen")).where(F.col("hits") >= min_hits)
    around = F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index")
    wanted = ranked.join(parents, ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", around).distinct()
    texts = wanted.join(chunks, ["doc_id", "chunk_index"]).groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    whole = T.normalize_whitespace(F.array_join(F.col("c.text"), " "))
    cut = F.when(F.length(whole) > max_chars, F.regexp_replace(F.substring(whole, 1, max_chars), " [^ ]*$", "")).otherwise(whole)
    order = Window.partitionBy("query_id").orderBy(F.desc("best"), "seen", "doc_id")
    merged = (
        texts.join(parents, ["query_id", "doc_id"])
        .select("query_id", F.row_number().over(order).alias("place"), "doc_id", F.array_min("c.chunk_index").alias("first_chunk"), F.array_max("c.chunk_index").alias("last_chunk"), cut.alias("text"))
        .where(F.col("place") <= most)
    )
    children = ranked.join(merged.select("query_id").distinct(), "query_id", "left_anti").join(chunks, ["doc_id", "chunk_index"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("place")
    return merged.unionByName(children.select("query_id", place, "doc_id", F.col("chunk_index").alias("first_chunk"), F.col("chunk_index").alias("last_chunk"), "text"))
