"""The stored indexes and the answer path against plain loops and against indexes built anew."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answering, retrieval, sparse_index, vector_index
from corpusloom.sources.tables import entries

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, 61)
    return [(i, " ".join(rng.choice(WORDS, int(rng.integers(0, 80)), p=share / share.sum()))) for i in range(n)]


def plain_bm25(docs, queries, k):
    tokens = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    n, mean = len(tokens), sum(map(len, tokens.values())) / max(1, len(tokens)) or 1.0
    df = Counter(w for t in tokens.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    low = 0.25 * sum(raw.values()) / max(1, len(raw))
    out = []
    for q, text in queries:
        scores = {}
        for i, t in tokens.items():
            tf = Counter(t)
            scores[i] = round(sum((raw[w] if raw[w] >= 0 else low) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in re.findall("[a-z0-9]+", text.lower()) if w in tf), 6)
        ranked = sorted(scores, key=lambda i: (-scores[i], i))[:k]
        out += [(q, i, scores[i], r) for r, i in enumerate(ranked, 1)]
    return out


def same(got, want):
    got, want = sorted(got), sorted(want)
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]
    assert [s for *_, s, _ in got] == pytest.approx([s for *_, s, _ in want], abs=2e-6)


def rows(frame):
    return sorted(tuple(r[c] for c in ("query_id", "doc_id", "score", "rank")) for r in frame.collect())


def docs_of(spark, some):
    return spark.createDataFrame(some, "doc_id bigint, text string")


QUERIES = [(0, "w0 w1 w50"), (1, "w3 w3 w44 w59"), (2, "nothing"), (3, " ".join(WORDS)), (4, "")]


def test_bm25(spark):
    docs, asked = texts(300), spark.createDataFrame(QUERIES, "query_id bigint, text string")
    for k in (1, 10, 400):
        same(rows(retrieval.bm25_topk(docs_of(spark, docs).repartition(5), asked, k)), plain_bm25(docs, QUERIES, k))
    named = docs_of(spark, docs).select(F.format_string("d%03d", "doc_id").alias("doc_id"), "text")
    got = sorted((r.query_id, int(r.doc_id[1:]), r.score, r["rank"]) for r in retrieval.bm25_topk(named, asked, 7).collect())
    same(got, plain_bm25(docs, QUERIES, 7))
    assert retrieval.bm25_topk(docs_of(spark, []), asked).count() == 0
    assert retrieval.bm25_topk(docs_of(spark, docs), asked.limit(0)).count() == 0


def test_weights_are_sent_in_slices(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_SENT", 2)
    monkeypatch.setattr(retrieval, "SCORES", 40)
    docs, asked = texts(90, 5), spark.createDataFrame(QUERIES, "query_id bigint, text string")
    same(rows(retrieval.bm25_topk(docs_of(spark, docs), asked, 5)), plain_bm25(docs, QUERIES, 5))


def test_sparse_index(spark, tmp_path):
    path, asked = f"file://{tmp_path}/index", spark.createDataFrame(QUERIES, "query_id bigint, text string")
    docs = dict(texts(400, 1))
    open_index = lambda: sparse_index.SparseIndex(spark, path, buckets=8, per_cell=16)

    def check(k=10):
        same(rows(open_index().search(asked, k)), plain_bm25(docs.items(), QUERIES, k))

    assert open_index().search(asked).count() == 0
    open_index().add(docs_of(spark, list(docs.items())))
    check()
    more = {i: t for i, t in texts(450, 2) if i >= 350}  # fifty keys are there already
    open_index().add(docs_of(spark, list(more.items())))
    docs |= more
    check()
    open_index().remove(docs_of(spark, [(i, "") for i in range(0, 450, 3)] + [(9999, "not there")]))
    docs = {i: t for i, t in docs.items() if i % 3}
    check(k=25)
    open_index().add(docs_of(spark, [(3, "w50 w50 w59"), (None, "w1")]))  # a removed key again, and none
    docs[3] = "w50 w50 w59"
    check()
    assert open_index().state.n_docs == len(docs) == open_index().documents().count()
    open_index().compact()
    assert len(open_index().state.batches) == 1
    check(k=300)


def test_sparse_index_survives_a_failed_batch(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = texts(50)
    sparse_index.SparseIndex(spark, path).add(docs_of(spark, docs))
    broken = sparse_index.SparseIndex(spark, path)
    broken._write(retrieval.term_counts(docs_of(spark, [(1000, "w0")])), "documents", "half-written")  # and then its driver is lost
    late = sparse_index.SparseIndex(spark, path)
    sparse_index.SparseIndex(spark, path).add(docs_of(spark, [(60, "w7")]))
    with pytest.raises(Exception, match="exists"):  # another has written that version meanwhile
        late.add(docs_of(spark, [(61, "w8")]))
    index = sparse_index.SparseIndex(spark, path)
    assert index.state.version == 2 and {r.doc_id for r in index.documents().collect()} == {*range(50), 60}
    assert entries(spark, f"{path}/states") == ["00000001", "00000002"]


def test_sparse_index_reads_its_terms_buckets_only(spark, tmp_path):
    """A search's scans are limited to partitions of the terms' buckets, and short queries score few of the blocks."""
    index = sparse_index.SparseIndex(spark, f"file://{tmp_path}/index", buckets=16, per_cell=8).add(docs_of(spark, texts(2000, 3)))
    asked = spark.createDataFrame([(0, "w58"), (1, "w55 w57")], "query_id bigint, text string")
    _, blocks = index._asked(asked)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert blocks.select("bucket").distinct().count() <= 3
    looked, pairs = index.blocks_read(asked, k=3)
    assert 0 < looked < 0.5 * pairs


def test_sparse_index_takes_little_disk(spark, tmp_path):
    """The tables of an index that is built, added to and removed from, and the shuffle files that this leaves, take less than twice what the documents do."""

    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(f.length() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_"))

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/docs")
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).rglob("*.parquet"))
    before, index = shuffled(), sparse_index.SparseIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.add(docs.where("doc_id % 2 = 0")).add(docs.where("doc_id % 2 = 1")).remove(docs.where("doc_id % 4 = 1"))
    assert shuffled() - before + size("index") < 2 * size("docs")


def test_sparse_index_windows(spark, tmp_path, monkeypatch):
    """Postings of several cells and windows, long and short lists, frequencies beyond 16 bits, and removals of which marks are sent in slices."""
    monkeypatch.setattr(sparse_index, "MARKS", 2000)
    rng = np.random.default_rng(8)
    docs = dict(texts(700, 6)) | {1000 + i: " ".join(f"r{j}" for j in rng.integers(0, 500, 30)) for i in range(300)} | {2000: "w1 " * 70_000, 2001: None, -5: "w1 w2"}
    index = sparse_index.SparseIndex(spark, f"file://{tmp_path}/index", buckets=4, per_cell=32).add(docs_of(spark, list(docs.items())).repartition(3))
    asked = [*QUERIES, (5, "r1 r2 r3 w1"), (6, "w1")]
    frame = spark.createDataFrame(asked, "query_id bigint, text string")
    same(rows(index.search(frame)), plain_bm25(docs.items(), asked, 10))
    index.remove(docs_of(spark, [(i, "") for i in docs if i % 5 == 0]))
    docs = {i: t for i, t in docs.items() if i % 5}
    same(rows(index.search(frame)), plain_bm25(docs.items(), asked, 10))
    df = {r.term: r.df for r in index._read("terms", sparse_index._TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect()}
    assert df == Counter(w for t in docs.values() for w in set((t or "").split()))


def test_sparse_index_of_another_layout(spark, tmp_path):
    spark.createDataFrame([('{"version": 1, "batches": []}',)], "value string").coalesce(1).write.text(f"file://{tmp_path}/index/states/00000001")
    with pytest.raises(ValueError, match="another layout"):
        sparse_index.SparseIndex(spark, f"file://{tmp_path}/index")


def test_dense(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 5
    vectors = [(i, (centres[i % 12] + rng.normal(size=8) * 0.3).tolist()) for i in range(6000)]
    odd = [(9000, None), (9001, []), (9002, [float("nan")] * 8), (9003, [None] + [1.0] * 7), (9004, [float("inf")] * 8), (None, [9.0] * 8), (9005, [1.0, 2.0]), *[(9010 + i, vectors[5][1]) for i in range(300)]]
    frame = spark.createDataFrame(vectors + odd, "doc_id bigint, embedding array<double>")
    asked = [(i, v) for i, v in vectors if i % 97 == 0] + [(7777, [float("nan")] * 8), (7778, [3.0, 1.0]), (7779, None)]
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<double>")
    known = [(i, v) for i, v in vectors + odd if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for dim in (8, 2):
        ids, m = np.array([i for i, v in known if len(v) == dim]), np.array([v for _, v in known if len(v) == dim])
        for q, v in asked:
            if v and len(v) == dim and np.isfinite(v).all():
                s = np.round(m @ np.array(v), 6)
                want += [(q, int(ids[j]), float(s[j]), r) for r, j in enumerate(np.lexsort((ids, -s))[:10], 1)]
    same(rows(retrieval.dense_topk(frame.repartition(3), queries)), sorted(want))
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/index")
    assert index.search(queries).count() == 0
    index.add(frame.where("coalesce(doc_id, 0) % 2 = 0")).add(frame.where("doc_id % 2 = 1"))
    same(rows(index.search(queries)), sorted(want))
    assert index.keys().count() == len(known)
    visited, pairs = index.blocks_visited(queries)
    assert visited < 0.5 * pairs


def test_queries_are_sent_in_slices(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "MOST_SENT", 100)
    monkeypatch.setattr(vector_index, "QUERIES", 2)
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "doc_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "query_id bigint, embedding array<double>")
    got = rows(retrieval.dense_topk(vectors, asked, 2))
    assert [(q, i) for q, i, *_ in got] == [(q, i) for q in range(9) for i in (6, 13)]


def test_answer_path(spark):
    """One question with variants and one without; a lost title or address counts as empty."""
    chunks = spark.createDataFrame(
        [("a:0", 1, 0, "The tower was built in 1900.", "Old Tower", None), ("a:1", 1, 1, "The tower has many stairs.", "Old Tower", None), ("a:2", 1, 2, "Nothing else.", "Old Tower", None), ("b:0", 2, 0, "A tower far away.", None, "http://h/list"), ("c:0", 3, 0, "Trees.", None, None)],
        "chunk_id string, doc_id bigint, chunk_index int, text string, title string, source_url string",
    )
    asked = spark.createDataFrame([(5, "When was the tower built?"), (6, "trees")], "query_id bigint, question string")
    lists = {(r.query_id, r.list_no): r.text for r in answering.variants(asked).collect()}
    assert lists == {(5, 0): "When was the tower built?", (5, 1): "the tower built", (5, 2): "tower built", (5, 3): "in what year was the tower built?", (6, 0): "trees"}
    search = answering.search_in(chunks.select(F.col("chunk_id").alias("doc_id"), "text"))
    ranked = answering.answer_ranking(chunks, asked, search, k=4)
    first = {(r.query_id, r["rank"]): r.chunk_id for r in ranked.collect()}
    assert [first[5, i] for i in (1, 2)] == ["a:0", "a:1"] and first[6, 1] == "c:0" and len(first) == 8
    contexts = answering.answer_contexts(chunks, ranked)
    got = {(r.query_id, r.place): (r.doc_id, r.first_chunk, r.last_chunk, r.text) for r in contexts.collect()}
    assert got[5, 1] == (1, 0, 2, "The tower was built in 1900. The tower has many stairs. Nothing else.")
    alone = answering.answer_contexts(chunks, ranked, parents=False)
    assert {r.place for r in alone.where("query_id = 6").collect()} == {1, 2, 3, 4}
    about = chunks.select("doc_id", "title", "source_url").distinct()
    requests = {r.query_id: r.user for r in answering.answer_requests(asked.union(spark.createDataFrame([(7, "x?")], asked.schema)), contexts, about).collect()}
    assert requests[5].startswith("Question: When was the tower built?\n\nContext:\n[1] | Old Tower\nThe tower was") and "(no retrieved context provided)" in requests[7]


def test_hybrid_answers(spark):
    docs = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, "blue fox", [0.0, 1.0]), (3, "green", [0.6, 0.8])], "doc_id bigint, text string, embedding array<double>")
    asked = spark.createDataFrame([(9, "green", [0.0, 1.0])], "query_id bigint, question string, embedding array<double>")
    search = answering.search_in(docs.select("doc_id", "text"), docs.select("doc_id", "embedding"), "hybrid")
    got = answering.retrieve_variants(asked, search, 2, embeddings=asked)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == [3, 2]
