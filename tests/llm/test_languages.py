"""Language identification: n-grams, training steps and held-out accuracy, with nulls, texts without letters and repeated rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import languages

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
    found = Counter()
    for w in words:
        for n in range(1, languages.LONGEST + 1):
            padded = w if n == 1 else f" {w} "
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return found


TEXTS = ["Ab c", None, "", " 12\n", "é x\n\nYz.", "q", "-Über-", "ab ab abba", "Ünïcode 漢字 и кириллица", "x" * 5000]


def test_ngrams():
    got = [Counter(g.tolist()) for g in languages.ngrams(TEXTS)]
    for text, buckets in zip(TEXTS, got, strict=True):
        assert sorted(buckets.values()) == sorted(plain(text).values())  # no two of these share a bucket
    assert [len(g) for g in languages.ngrams([])] == []
    alone = [next(languages.ngrams([t])).tolist() for t in TEXTS]
    assert alone == [g.tolist() for g in languages.ngrams(TEXTS)]


def test_counts():
    rng = np.random.default_rng(0)
    counter = languages.Counter()
    for _ in range(20):
        grams = rng.integers(0, 50, rng.integers(0, 400))
        bucket, n = counter.counts(grams)
        assert dict(zip(bucket.tolist(), n.tolist(), strict=True)) == Counter(grams.tolist())


def test_leader_is_the_formula():
    """The weights of each step against follow the regularised leader written for single numbers."""
    rng = np.random.default_rng(1)
    alpha, beta, l1, l2 = 0.7, 0.3, 1.0, 0.2
    leader = languages.Leader(np.zeros((9, 2)), np.zeros((9, 2)), alpha, beta, l1, l2)
    z, n = np.zeros((9, 2)), np.zeros((9, 2))
    for _ in range(60):
        bucket, y = rng.choice(9, 4, replace=False), int(rng.integers(2))
        value = rng.normal(size=4)
        w = np.zeros((4, 2))
        for i, b in enumerate(bucket):
            for k in range(2):
                if abs(z[b, k]) > l1:
                    w[i, k] = -(z[b, k] - np.sign(z[b, k]) * l1) / ((beta + n[b, k] ** 0.5) / alpha + l2)
        p = np.exp(value @ w)
        p /= p.sum()
        for i, b in enumerate(bucket):
            for k in range(2):
                g = value[i] * (p[k] - (k == y))
                z[b, k] += g - ((n[b, k] + g * g) ** 0.5 - n[b, k] ** 0.5) / alpha * w[i, k]
                n[b, k] += g * g
        leader.learn(bucket, value, y)
        assert np.allclose(leader.z, z) and np.allclose(leader.n, n)
    assert (leader.weights()[leader.n > 0] == 0).any() and leader.weights().any()


def test_temperature():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(4000, 3)) * 2
    p = languages.softmax(scores)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert languages.temperature(scores * 3, y) == pytest.approx(3, rel=0.15)


def test_identify(spark):
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id", "text", "lang", "source as score", "n_chars as number")
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "12 %\n", None), (None, "Words of a row without an id", "zz"), (9004, "tre les que", None), (9005, "Eins und zwei " * 20_000, "de"), *[(9006, "the and of", "en")] * 3]
    docs = base.unionByName(spark.createDataFrame([(*r, "x", 1) for r in odd], "doc_id bigint, text string, lang string, score string, number bigint"))
    got = languages.identify(docs)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    own = {r.doc_id: r for r in rows}
    assert [own[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and own[9001].score == 0
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "es", "und"}  # the language of the row without an id isn't learnt
    known = {r.doc_id: r.lang for r in docs.where("length(text) > 100").collect()}
    held = [(r.lang_pred, known[r.doc_id]) for r in rows if r.held_out and known.get(r.doc_id)]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) >= 0.95


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in languages.identify(docs).collect()] == [("und", 0.0)] * 2
    assert languages.identify(docs.limit(0)).count() == 0
