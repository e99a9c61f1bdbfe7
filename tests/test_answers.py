"""Literal cases of answers, augmented queries and parent contexts."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import questions as Q
from corpusloom.operators import retrieval

CASES = [
    (None, None, ""),
    ("", "", ""),
    ("Answer: The answer is: 'Ann'.", "who is it", "Ann'"),
    ("Paris [1] [2]", None, "Paris"),
    ("first line\nsecond", None, "first line"),
    ("A; a; B", None, "A; B"),
    ("Bob; Bob Smith", None, "Bob"),
    ("red; blue", "what is it", "red"),
    ("IBM (IBM Corporation)", None, "IBM"),
    ("Rome - because it is the old capital", None, "Rome"),
    ("It began in 1921 I think", "what year was it", "1921"),
    ("It was on May 3, 1900 then", "when was it", "May 3, 1900"),
    ("In 1900 or 1901", "when was it", "In 1900 or 1901"),
    ("One. Two. Three. Four.", "why is it so", "One. Two. Three"),
    ("One. Two.", None, "One"),
    ("Not found", None, "UNKNOWN"),
]


def test_postprocess(spark):
    rows = spark.createDataFrame([(i, a, q) for i, (a, q, _) in enumerate(CASES)], "i int, a string, q string")
    got = {r.i: r.x for r in rows.select("i", A.postprocess(F.col("a"), F.col("q")).alias("x")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]


@pytest.mark.parametrize(
    ("question", "most", "wanted"),
    [
        ("When was Old Main built?", 9, ["Old Main built", "Old Main", "main built"]),
        ("When was Old Main built?", 2, ["Old Main built", "Old Main"]),
        (None, 2, []),
        ("rivers", 2, []),
    ],
)
def test_augmentations(spark, question, most, wanted):
    rows = spark.createDataFrame([(question,)], "q string")
    assert rows.select(Q.augmentations(F.col("q"), most).alias("x")).first().x == wanted


def test_parent_contexts(spark):
    chunks = spark.createDataFrame([(d, i, f"d{d} c{i}") for d in (1, 2) for i in range(5)], "doc_id long, chunk_index int, text string")
    found = [(1, 1, 1, 3.0, 1), (1, 2, 0, 2.0, 2), (1, 1, 3, 1.0, 3), (2, 2, 4, 1.0, 1), (2, 1, 0, 0.5, 2)]
    ranked = spark.createDataFrame(found, "query_id long, doc_id long, chunk_index int, score double, rank int")
    got = sorted(tuple(r) for r in retrieval.parent_contexts(ranked, chunks).collect())
    assert got == [(1, 1, 1, 0, 4, "d1 c0 d1 c1 d1 c2 d1 c3 d1 c4"), (2, 1, 2, 4, 4, "d2 c4"), (2, 2, 1, 0, 0, "d1 c0")]
    short = retrieval.parent_contexts(ranked, chunks, max_chars=10).where("query_id = 1").first()
    assert short.text == "d1 c0 d1"
    assert retrieval.parent_contexts(ranked.limit(0), chunks).count() == 0
