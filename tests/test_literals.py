"""Literal cases and plain loops for rules that the given tables don't reach."""

import json
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import questions as Q
from corpusloom.functions import text as T
from corpusloom.functions.patterns import contains_any, literals_in
from corpusloom.operators import corpus, mining, retrieval, training
from corpusloom.plans.catalog import ORACLES, QUERIES
from corpusloom.sources import crawl, file_source, files, html
from corpusloom.sources.tables import numbered
from corpusloom.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def column(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(f(F.col("v"))).collect()]


def test_cleaning_and_tokens(spark):
    assert column(spark, ["\ufb01\u2460 a\u00a0\tb", "x\n\n\n\ny", None, " \n "], T.clean_basic) == ["fi1 a b", "x\n\ny", "", ""]
    assert column(spark, ["\uff28ello \ufb01x-\u2460 \u00e9t\u00e9", "", None], T.search_tokens) == [["hello", "fix", "1", "t"], [], []]


def test_rewrites(spark):
    long = "When was " + "x" * 12_000
    cases = ["When was the hall built?", "Where is it?", "When did Alpha Beta open", "what", "", None, long]
    got = column(spark, cases, Q.rewrites)
    assert got[0] == ["in what year was the hall built?", "hall built"] and got[1] == ["what is the location of it?"]
    assert got[2] == ["in what year did Alpha Beta open", "alpha beta open"] and got[3:6] == [[], [], []]
    assert got[6][0] == "in what year was " + "x" * 12_000


PAGE = """<html><head><title> A  <!-- c -->title</title></head><body><nav><p>menu</p></nav>
<article class="x"><h1>Head &amp; <b>shoulders</b></h1><p>One<p>Two <span aria-hidden="true">hidden</span>&nbsp;x<ul><li>Three<li>4</ul>
<table><tr><td>cell<td>other</table><div class="infobox big"><p>box</p></div><script>var p;</script></article><p>after</p></body></html>"""


def test_html_documents():
    title, text = html.document_of(PAGE, "stem")
    assert title == "Head & shoulders"  # a title of several parts is none
    assert text.split("\n") == ["Head & shoulders", "One Two x Three 4 cell other", "Two x Three 4 cell other", "Three 4", "cell other", "other"]
    assert html.document_of("<title>T</title><main><p>Only</p> <p>two</main>", "s") == ("T", "Only\ntwo")
    assert html.document_of("plain &lt; text", "s") == ("s", "plain < text") and html.document_of("", "s") == ("s", "")
    assert html.document_of("<div class='content'>in</div>out" , "s")[1] == "in" and html.document_of("<h2>Only head</h2>", "s")[0] == "Only head"
    deep = "<div>" * 20_000 + "deep</b>" + "</div>" * 20_000
    assert html.document_of(deep, "s") == ("s", "deep")


def test_html_references_without_a_semicolon(spark):
    """They are read like others by default; else they stay as they are, wherever they stand, as html_document's SQL has them."""
    page = "<title>a &amp;&amp &am</title><main><h1 id='x&amp'>h &lt;&copy &notit; &#65;&#66 &</h1><p>\U000f0000 &amp;lt; &quot;q</main>"
    assert html.document_of(page, "s") == ("a && &am", "h <\u00a9 \u00acit; AB &\n\U000f0000 &lt; \"q")
    assert html.document_of(page, "s", open_references=False) == ("a &&amp &am", "h <&copy &notit; A&#66 &\n\U000f0000 &lt; \"q")
    assert html.Tree("<p id='x&amp'>", open_references=False).elements[0]["id"] == "x&amp"
    rows = spark.createDataFrame([(page,), (None,)], "html string").select(html.html_document("html", F.lit("s"), open_references=False).alias("d")).collect()
    assert [r.d.title for r in rows] == ["a &&amp &am", "s"]


def test_html_document_of_cut_references(spark, tmp_path):
    """The query gives the rows of its SQL where a title or heading ends within a reference."""
    cut = [f"<title>T &amp;{r}</title><article><h1>T &amp;{r}</h1><p>one</p><p>two</p><p>three</p><p>four &quot;</p></article>" for r in ("", "&", "&a", "&am", "&amp", "&quo", "&quot", "&amp;")]
    spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(cut)], "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(ORACLES["html_document"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["html_document"](spark, str(tmp_path)).collect()) == sorted(want) and len(want) == 8


def test_file_documents_of_cut_references(spark, tmp_path):
    """The query gives the rows of its SQL where a title ends within a reference; texts that aren't HTML keep theirs."""
    cut = [f"<title>T &amp;{r}</title><article><h1>T</h1><p>one</p><p>two</p><p>three</p><p>four</p></article>" for r in ("&", "&am", "&amp", "&quot")]
    spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(cut)], "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "a &amp;&amp b"), (2, None)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        for t in ("pages", "documents"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = con.execute(ORACLES["file_documents"]).fetchall()
    got = [tuple(r) for r in QUERIES["file_documents"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) == 6


def test_html_takes_linear_time():
    """A hundred thousand end tags without a start, or with many elements open, and many blocks around each other."""
    began = time.time()
    for page in ("</b>" * 100_000 + "x", "<div>" * 20_000 + "</b>" * 100_000 + "x", "<div><i>" * 20_000 + "x" + "</i></p></div>" * 20_000, "<p>y</p>" * 50_000):
        html.document_of(page, "s")
    assert time.time() - began < 15
    nested = html.document_of("<main>" + "".join(f"<li>t{i}" for i in range(200)) + "</main>", "s")[1].split("\n")
    assert nested == [" ".join(f"t{j}" for j in range(i, 200)) for i in range(200)]


def test_links():
    page = """<a href="b.html">1</a><A HREF='../c'>2</A><a class=k href=?q=1>3</a><a
      href="//cdn.org/z">4</a><a href=" /root#f ">5</a><a>no</a><a href="">6</a><a href="mailto:a@b">7</a><a href="http://[bad">8</a><a href="x?a=1&amp;b=2">9</a>"""
    assert html.links_of(page, "http://h.org/d/a.html") == ["http://h.org/d/b.html", "http://h.org/c", "http://h.org/d/a.html?q=1", "http://cdn.org/z", "http://h.org/root#f", "http://h.org/d/x?a=1&b=2"]


def test_crawl_of_a_graph(spark):
    """A cycle, a link without a page, repeated links, a depth limit, a page limit and filters."""
    web = {"http://a/": ["http://a/b", "http://a/c", "http://a/b"], "http://a/b": ["http://a/", "http://a/d"], "http://a/c": ["http://a/gone", "http://x/e", "ftp://a/f"], "http://a/d": ["http://a/g"], "http://a/g": ["http://a/h"], "http://a/h": [], "http://x/e": []}
    pages = spark.createDataFrame([(u,) for u in web], "url string")
    links = spark.createDataFrame([(u, i, h) for u, hs in web.items() for i, h in enumerate(hs)], "url string, place int, href string")
    seeds = spark.createDataFrame([(0, "http://a/#top"), (1, "HTTP://A")], "place int, url string")

    def visited(**kw):
        rows = crawl.crawl(pages, links, seeds, **kw)
        return [(r.url, r.depth, r.status) for r in rows.orderBy("depth", "place").collect()]

    every = [("http://a/", 0, "ok"), ("http://a/b", 1, "ok"), ("http://a/c", 1, "ok"), ("http://a/d", 2, "ok"), ("http://a/gone", 2, "error"), ("http://x/e", 2, "ok"), ("http://a/g", 3, "ok"), ("http://a/h", 4, "ok")]
    assert visited() == every and visited(max_depth=2) == every[:6] and visited(max_pages=4) == every[:4]
    assert visited(domains=["a"], deny_substrings=["gone"]) == [e for e in every if e[0] not in ("http://x/e", "http://a/gone")]
    kinds = pages.withColumn("content_type", F.expr("case url when 'http://a/b' then 'image/png' when 'http://a/c' then 'Text/HTML; charset=x' when 'http://x/e' then 'application/pdf' else 'text/html' end"))
    found = {r.url: (r.status, r.reason, r.resource_type) for r in crawl.crawl(kinds, links, seeds, download_pdfs=True).collect()}
    assert found == {"http://a/": ("ok", None, "html"), "http://a/b": ("skipped", "unsupported_content_type", None), "http://a/c": ("ok", None, "html"), "http://a/gone": ("error", None, None), "http://x/e": ("ok", None, "pdf")}
    assert crawl.summary(crawl.crawl(kinds, links, seeds)).first().asDict() == {"ok": 2, "html": 2, "pdf": 0, "skipped": 2, "errors": 1}
    without = spark.createDataFrame([("http://a/c#x",), ("http://a/d/",)], "url string")
    assert visited(skip=without) == every[:2]
    assert crawl.summary(crawl.crawl(pages, links, seeds)).first().asDict() == {"ok": 7, "html": 7, "pdf": 0, "skipped": 0, "errors": 1}


def test_bm25_of_a_tiny_corpus(spark):
    """Fewer matches than k, and a term of most documents, whose idf is a part of the vocabulary's mean."""
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a d e")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "c"), (2, "zzz"), (3, "a")], "query_id bigint, text string")
    got = {}
    for r in retrieval.bm25_topk(docs, asked, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score > 0))
    assert got[1] == [(2, True), (1, False), (3, False)] and got[2] == [(1, False), (2, False), (3, False)] and len(got[3]) == 3


def test_modes(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "green")], "doc_id bigint, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "doc_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(9, "green", [0.0, 1.0])], "query_id bigint, text string, embedding array<double>")
    first = lambda **kw: [r.doc_id for r in retrieval.retrieve(docs, vectors, asked, k=2, **kw).orderBy("rank").collect()]
    assert first(mode="sparse") == [3, 1] and first(mode="dense") == [2, 3] and first(mode="closedbook") == []
    assert first(method="no such") == first() == [3, 2] and first(method="combmnz") == [3, 2]
    with pytest.raises(ValueError):
        first(mode="other")


def test_shaping(spark):
    rows = [(1, 1, 1, 0.10, "Museum tower", "http://h/list", "the museum"), (1, 2, 2, 0.09, "Museum hours", "http://h/x", "museum hours"), (1, 3, 3, 0.05, None, None, None)]
    ranked = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, rank int, score double, title string, source_url string, text string").withColumn("question", F.lit("What are the museum hours?"))
    got = [(r.doc_id, r["rank"], r.score) for r in retrieval.shape_scores(ranked).orderBy("rank").collect()]
    assert got == [(2, 1, 0.24), (1, 2, 0.095), (3, 3, 0.05)]


def test_chunk_places(spark):
    docs = spark.createDataFrame([(1, "a b a b  c", "pdf", {"doc_type": "own", "k": "v"}), (2, "x\ny z", "html", None)], "doc_id bigint, text string, doc_type string, metadata map<string,string>")
    chunks = spark.createDataFrame([(1, 0, "a b"), (1, 1, " "), (1, 2, "a b"), (1, 3, "b c"), (1, 4, "c"), (2, 0, "x y"), (2, 1, "y z")], "doc_id bigint, chunk_index int, text string")
    got = [(r.doc_id, r.chunk_index, r.start_char, r.end_char) for r in corpus.emit_chunks(docs, chunks).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, 0, 0, 3), (1, 2, 4, 7), (1, 3, None, None), (1, 4, 9, 10), (2, 0, None, None), (2, 1, 2, 5)]
    meta = {(r.doc_id, r.metadata["doc_type"], len(r.metadata)) for r in corpus.emit_chunks(docs, chunks).collect()}
    assert meta == {(1, "own", 2), (2, "html", 1)}


def test_chunk_spans_query(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    by = {}
    for r in QUERIES["chunk_spans"](spark, FOLDER).collect():
        by.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.start_char, r.end_char))
    for doc, rows in by.items():
        cursor = 0
        for _, piece, start, end in sorted(rows):
            at = text[doc].find(piece, cursor)
            assert (start, end) == ((None, None) if at < 0 else (at, at + len(piece)))
            cursor = cursor if at < 0 else at + 1


def test_mining(spark):
    rows = [
        (0, "data/raw/a", "Old Hall | Site", None, "The hall was Founded by Jane Roe in 1900. It is located in Big City; near a river. Opened to all on May 5, 1902."),
        (1, "data/raw/b", "", "http://h/some-old_place.html", "It began in 1950. Its mascot name is the Owl [3]. It is headquartered in A | B."),
        (2, "data/raw/c", "Top guide", None, "It was founded in 1800."),
        (3, "other", "Elsewhere", None, "It was founded in 1801."),
        (4, "data/raw/d", "Old Hall", None, "It is located at Small Town."),
    ]
    docs = spark.createDataFrame(rows, "ord int, source_path string, title string, source_url string, text string")
    got = [(r.question, r.answer) for r in mining.mine(docs).orderBy("place").collect()]
    assert got == [
        ("When was Old Hall founded?", "1900"),
        ("Who founded Old Hall?", "Jane Roe in 1900"),
        ("Where is Old Hall located?", "Big City"),
        ("When was Old Hall opened?", "May 5, 1902"),
        ("When did Some Old Place begin?", "1950"),
        ("What is the mascot of Some Old Place?", "the Owl"),
    ]
    assert {r.question for r in mining.mine(docs, only_scraped=False).collect()} == {q for q, _ in got} | {"When was Elsewhere founded?"}
    assert [r.place for r in mining.mine(docs, most=2).collect()] == [1, 2]


def test_training_rows(spark):
    asked = spark.createDataFrame([(0, "a"), (1, " "), (2, "b"), (3, "c")], "ord int, question string")
    answers = spark.createDataFrame([("1", "x"), ("2", "  "), ("3", " z ")], "key string, answer string")
    assert [(r.line, r.question, r.answer) for r in training.join_references(asked, answers).orderBy("line").collect()] == [(1, "a", "x"), (3, "c", "z")]
    rows = spark.range(101).withColumnRenamed("id", "key")
    split = [r.key for r in training.split_rows(rows, "key", 0.25).where("eval").collect()]
    hashed = [r.key for r in rows.withColumn("h", F.xxhash64(F.lit(42), F.col("key"))).orderBy("h").collect()]
    assert sorted(split) == sorted(hashed[:25]) and set(split) == {r.key for r in training.split_rows(rows.repartition(7), "key", 0.25).where("eval").collect()}
    assert training.split_rows(rows, "key", 0.9).where("eval").count() == 50 and training.split_rows(rows, "key", 0.0).where("eval").count() == 0
    some = spark.createDataFrame([([1, 2], [-100, 2]), ([9], [1]), ([1], [9]), ([1, 1], [-100, -100]), ([], [])], "ids array<int>, labels array<int>")
    assert [r[0] for r in some.select(training.drop_reason(5)).collect()] == ["", "bad_token", "bad_label", "all_ignored", ""]
    batches = training.number_batches(spark.range(500), "id", 8, 4).groupBy("batch").count().collect()
    assert max(r["count"] for r in batches) == 8 and sum(r["count"] for r in batches) == 500


def test_nth_smallest(spark):
    rng = random.Random(0)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(200)] + [5] * 30 + [-1, 0, 2**63 - 1, -(2**63)] + [rng.randrange(65536) for _ in range(50)]
    rows, ordered = spark.createDataFrame([(v,) for v in values], "h bigint").cache(), sorted(values)
    for n in (1, 2, 100, 130, 140, len(values)):
        value, left = training.nth_smallest(rows, n)
        assert value == ordered[n - 1] and left == n - ordered.index(value)


def test_split_plan_has_no_sorted_limit(spark):
    plan = training.split_rows(spark.range(10_000).withColumnRenamed("id", "key"), "key", 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Exchange" not in plan
    same = training.split_rows(spark.createDataFrame([(1,)] * 10 + [(2,)] * 10, "key int"), "key", 0.3).where("eval").collect()
    assert len(same) == 10 and len({r.key for r in same}) == 1


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 37 % 1000, i) for i in range(1000)] + [(500, -1)], "a int, b int").repartition(7)
    got = sorted((r.line, r.a, r.b) for r in numbered(rows, "a", "b").collect())
    assert got == [(n, a, b) for n, (a, b) in enumerate(sorted([(i * 37 % 1000, i) for i in range(1000)] + [(500, -1)]), 1)]
    assert numbered(rows.limit(0), "a").count() == 0


def test_many_literals(spark):
    words = ["he", "she", "", "hers", "he", "zzz"]
    assert column(spark, ["ushers", "he", "", None, "HE"], lambda c: literals_in(c, words)) == [[0, 1, 3], [0], [], [], []]
    assert column(spark, ["x"], lambda c: literals_in(c, [])) == [[]]
    many = [f"w{i}" for i in range(10_000)]
    for some in (many, many[:5]):
        assert column(spark, ["a w3 b", "W3", None, "w"], lambda c, some=some: contains_any(c, some)) == [True, False, False, False]
    # plain words are looked for together, patterns each: the reasons are the same
    texts = ["About W77!", "w1x", "none", None, "100% plain"]
    wanted = column(spark, texts, lambda c: T.matches_any(c, ["w77", "^w1", "(bad", "plain"]))
    assert wanted == [True, True, False, False, True]
    assert column(spark, texts, lambda c: T.matches_any(c, ["w77", "^w1", "(bad", "plain", *(f"q{i}" for i in range(500))])) == wanted


def test_files(spark, tmp_path):
    (tmp_path / "docs" / "p_files").mkdir(parents=True)
    for name, data in {"a.HTML": b"<title>T</title><p>x", "b.md": "caf\u00e9\u00a0\xe9".encode() + b"\xff", "c.pdf": b"%", "load.php": b"", "d.exe": b"", "p_files/e.html": b"<p>asset"}.items():
        (tmp_path / "docs" / name).write_bytes(data)
    (tmp_path / "single.bin").write_bytes(b"z")
    found = files.scan_files(spark, [str(tmp_path / "docs"), str(tmp_path / "none"), str(tmp_path / "single.bin")])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.HTML", "b.md", "c.pdf", "single.bin"]
    read = file_source.read_files(spark, [str(tmp_path / "docs"), f"file://{tmp_path}/none", f"file://{tmp_path}/single.bin"], most=10)
    assert {(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in read.collect()} == {(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in found.collect()}
    assert read.rdd.getNumPartitions() > 1 and file_source.read_files(spark, [str(tmp_path / "none")]).count() == 0
    urls = found.where("path like '%HTML'").select("path", F.lit("http://u/a").alias("url"))
    got = {r.title: (r.text, r.doc_type, r.source_url) for r in files.file_documents(found, urls).collect()}
    assert got == {"T": ("T\nx", "html", "http://u/a"), "b": ("caf\u00e9 \xe9", "text", None)}
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert sorted(r.a for r in files.read_lines(spark, str(tmp_path / "rows.jsonl"), "a int, b string").collect()) == [1, 2]
    assert files.read_lines(spark, str(tmp_path / "no.jsonl"), "a int").count() == 0


def test_questions_and_submission(spark):
    contents = spark.createDataFrame([('["one?", {"qid": "7", "question": "two?"}, {"id": "x", "question": "three?"}]',), ('{"5": "four?", "name": "me"}',)], "value string")
    assert {(r.qid, r.question) for r in files.questions(contents, skip=("name",)).collect()} == {("1", "one?"), ("7", "two?"), ("x", "three?"), ("5", "four?")}
    answers = spark.createDataFrame([("10", "j"), ("9", 'quote " \u00e9'), ("b", "w")], "qid string, answer string")
    text = files.submission(answers, {"name": "me"}).first()[0]
    assert list(json.loads(text).items()) == [("name", "me"), ("9", 'quote " \u00e9'), ("10", "j"), ("b", "w")] and "\u00e9" in text


def test_ingest_after_a_failure(spark, tmp_path):
    """A batch whose first attempt fails is taken once; files that come again replace rows; what a lost attempt left isn't read."""
    arriving, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "doc_id bigint, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(arriving)

    def run(after=None):
        ingest.ingest(spark, spark.readStream.schema(schema).parquet(arriving), path, after)

    def held():
        return sorted(tuple(r) for r in ingest.current(spark, path, schema).collect())

    def fail(batch, number):
        raise RuntimeError("lost")

    assert held() == []
    arrive([(1, "a"), (2, "b")])
    with pytest.raises(Exception, match="lost"):
        run(fail)
    seen = []
    run(lambda batch, number: seen.append((number, batch.count())))
    run()
    assert held() == [(1, "a"), (2, "b")] and seen == [(0, 2)]
    arrive([(2, "c"), (3, "d")])
    run()
    (tmp_path / "out" / "batches" / "batch=9").mkdir()  # an attempt that never ended
    assert held() == [(1, "a"), (2, "c"), (3, "d")]
