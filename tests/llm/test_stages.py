"""The pipeline and its stages on odd tables and against brute force."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from corpusloom.llm import quality, shared, tokens, toxicity, vantage

FOLDER = "/root/testdata/sf0.001"
CLASHES = ("score", "label", "n_words", "spans", "items", "covered", "wanted", "row", "n", "key", "node", "_spans", "component_id")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def test_the_subpackage_can_be_imported():
    import __spark_entry__

    assert __spark_entry__.llm is not None and sum(n.startswith("op") and n[2].isdigit() for n in __spark_entry__.queries()) == 13


def test_stages_keep_columns_of_any_name(spark):
    """Nulls, empty texts, repeated rows, null ids, and columns named like the stages' own."""
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (None, "no id here"), (9004, "twice the same row"), (9004, "twice the same row")], "doc_id bigint, text string")
    docs = base.unionByName(odd, allowMissingColumns=True)
    for i, c in enumerate(CLASHES):
        docs = docs.selectExpr("*", f"concat('{c}', coalesce(doc_id, -1)) as `{c}`")
    docs = shared.keep(docs, "odd")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)
        if stage is not corpus_pipeline.filter_quality:
            kept = [r.doc_id for r in rows]
            assert {None, 9001, 9002, 9003} <= set(kept) and kept.count(9004) == 2
    pieces = corpus_pipeline.pack_sequences(spark, docs, FOLDER).collect()
    assert {(r.doc_id, r.length) for r in pieces} >= {(9001, 1), (9002, 1)} and len(pieces) >= docs.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_pipeline_against_brute_force(spark):
    """Each stage against a plain loop over what its predecessor kept."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.score(docs, labels).collect() if r.score >= 0.5}
    docs = shared.keep(corpus_pipeline.filter_quality(spark, docs, FOLDER), "one")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts == {i: t for i, t in kept.items() if i in good}

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    docs = shared.keep(corpus_pipeline.join_near_duplicates(spark, docs, FOLDER), "two")
    assert {r.doc_id: r.text for r in docs.collect()} == {i: t for i, t in texts.items() if find(i) == i}
    texts = {i: t for i, t in texts.items() if find(i) == i}

    runs = {}
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k : k + 50]), set()).add(i)
    docs = shared.keep(corpus_pipeline.cut_repeated_passages(spark, docs, FOLDER), "three")
    cut = {r.doc_id: r.text for r in docs.collect()}
    again = {}
    for i in sorted(cut):
        own, before = words(cut[i]), words(texts[i])
        for k in range(len(own) - 49):
            again.setdefault(tuple(own[k : k + 50]), set()).add(i)
        if own != before:
            # something goes only where a run of 50 words, nearly equal at least, stands in a smaller document
            others = {w for j in texts if j < i for w in words(texts[j])}
            assert len(before) - len(own) >= 50 and len(others & set(before)) > 0
    assert all(len(ids) == 1 for run, ids in again.items() if run in runs)
    assert set(cut) <= set(texts) and all(cut[i] == texts[i] for i in cut if words(cut[i]) == words(texts[i]))

    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    expected = {}
    for i, t in cut.items():
        spots = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))]
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit:
            expected[i] = t
        elif len(hit) < len(w):
            out, at, k = "", 0, 0
            while k < len(w):
                if k in hit:
                    last = k
                    while last + 1 in hit:
                        last += 1
                    out, at, k = out + t[at : spots[k][0]], spots[last][1], last
                k += 1
            expected[i] = (out + t[at:]).strip(" ")
    docs = shared.keep(corpus_pipeline.cut_benchmark_phrases(spark, docs, FOLDER), "four")
    got = {r.doc_id: r.text for r in docs.collect()}
    differ = [(i, (got[i] or "")[k - 60 : k + 60], t[k - 60 : k + 60]) for i, t in expected.items() if got[i] != t for k in [next(k for k in range(len(t) + 1) if (got[i] or "")[: k + 1] != t[: k + 1])]]
    assert differ == [] and got.keys() == expected.keys()

    enc = tokens.Encoder(tokens.default_tokenizer())
    pieces = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.pack_sequences(spark, docs, FOLDER).collect())
    wanted = []
    for i, t in expected.items():
        ids = np.array([*enc.encode(t).tolist(), 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        wanted += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert pieces == sorted(wanted)


def test_labels_of_repeated_rows_count_once(spark):
    """A sampled id of many rows gives one row to learn from."""
    docs = spark.createDataFrame([(1, f"bad words number {i}") for i in range(300)] + [(i, f"fine text {i} of some words") for i in range(2, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i == 1), int(i == 1)) for i in range(1, 40)], "doc_id bigint, quality int, toxic int")
    for rows in (toxicity.score(docs, labels).collect(), quality.score(docs, labels).collect()):
        assert len(rows) == 338 and all(0 <= r.score <= 1 for r in rows)


def brute_neighbours(rows, every, k):
    best = {}
    for i, v in rows:
        if i is not None and i % every == 0 and v and (i not in best or v < best[i]):
            best[i] = v
    return {(i, n + 1, j) for i, v in best.items() for n, (_, j) in enumerate(sorted((np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, w in rows if j != i and w and len(w) == len(v))[:k])}


@pytest.mark.parametrize("sizes", [(4096, 8192, 1 << 20), (50, 3, 200), (64, 1, 1)])
def test_neighbours_in_blocks(spark, sizes):
    """Small shards and blocks, two dimensions, and an id of two vectors."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4 if i % 7 else 3).tolist()) for i in range(400)] + [(100, [0.5, 0.25, 0.125, 1.0]), (9, None), (8, [])]
    shard, block, sent = sizes
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = vantage.nearest_neighbours(frame, k=3, every=20, shard=shard, block=block, sent=sent).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == brute_neighbours(rows, 20, 3)
