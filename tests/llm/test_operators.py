"""Each operator against brute force on small tables with nulls, empty and repeated rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import decontaminate, grammar_store, jaccard_join, main_text, packing, passages, quality, shared, tokens, toxicity, vantage, warc
from corpusloom.llm.components import connected_components

FOLDER = "/root/testdata/sf0.001"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def docs(spark):
    """The table with an extra column of a clashing name, nulls, empty, white-space and repeated rows."""
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("doc_id", "text", "lang as n", "source as key")
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    odd = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "One two"), (9005, "one  TWO"), (None, "some words without an id"), (9006, long), (9007, long + " end"), (9007, long + " end")]
    return base.unionByName(spark.createDataFrame([(i, t, "x", None) for i, t in odd], "doc_id bigint, text string, n string, key string")).cache()


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(parent) if any(x in p and p[0] != p[1] for p in links)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = toxicity.score(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert toxicity.score(docs, labels.limit(0)).where("score <> 0").count() == 0


def test_segments_are_maximal():
    rng = np.random.default_rng(1)
    for _ in range(300):
        score = rng.integers(-4, 4, rng.integers(0, 30)).astype(float)

        def best(a, b):  # repeated split at the best segment, the shortest and then first of equal ones
            found = [(score[i:j].sum(), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not found or max(found)[0] <= 0:
                return []
            s, n, i = max(found)
            return best(a, -i) + [s] + best(-i - n, b)

        assert sorted(s for *_, s in toxicity.segments(score)) == pytest.approx(sorted(best(0, len(score))))


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    y = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert np.mean([a == b for a, b in held]) >= 0.85
    assert quality.score(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_sets_of_a_large_batch_take_little_memory():
    """Numbers of a batch's words are never all in memory at once, so that several tasks fit beside an executor's heap."""
    import tracemalloc

    import pyarrow as pa

    from corpusloom.llm import kernels

    texts = [" ".join(f"w{i * j % 9973}" for j in range(1000)) for i in range(1, 1001)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    for block in kernels.blocks(batch, "text"):
        kernels.row_sets(block, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_live_keys_join_no_row_that_stays_anyway(spark, docs, monkeypatch):
    """Rare tokens of the basic prefix are live whatever else their node has; only the others are joined."""
    plans = {}

    def kept(frame, name):
        plans[name] = frame._jdf.queryExecution().optimizedPlan().toString()
        return shared.keep(frame, name)

    monkeypatch.setattr(jaccard_join, "keep", kept)
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    live = {tuple(r) for r in jaccard_join._live_keys(texts, np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8), 5, 2).collect()}
    assert "LeftOuter" not in plans["live"] and "LeftSemi" in plans["live"]
    index = texts.mapInArrow(jaccard_join._index(5, np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8)), "key bigint, node bigint, n int, place int").collect()
    count, nodes = Counter(r.key for r in index), defaultdict(set)
    for r in index:
        nodes[r.key].add(r.node)
    extended = {r.node for r in index if count[r.key] > 2 and len(nodes[r.key]) > 1 and r.place <= r.n // 5}
    single = {(r.key, r.node, r.n) for r in index if len(nodes[r.key]) > 1 and count[r.key] <= 2 and (r.place <= r.n // 5 or r.node in extended)}
    assert extended and single and single <= live


@pytest.mark.parametrize("frequent", [256, 1])
def test_jaccard_join(spark, docs, frequent):
    rows = [(r.doc_id, shingle_set(r.text)) for r in docs.select("doc_id", "text").collect()]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in rows if i is not None and s]
    for k, (i, s) in enumerate(known):
        for j, t in known[:k]:
            both = len(s & t)
            if 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = jaccard_join.similar_documents(docs, frequent=frequent).collect()
    assert len(got) == len(rows)
    sizes = dict(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(sizes[i]), find(i)) for i in parent}


def test_prefix_keys_lose_no_link():
    rng = np.random.default_rng(2)
    for n in [1, 2, 5, 7, 8, 9, 12, 20, 63, 64, 65, 100, 130, 200]:
        for _ in range(6):
            x = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
            m = int(len(x) * rng.uniform(0.8, 1.25))
            keep = rng.choice(x, min(len(x), int(np.ceil(0.8 / 1.8 * (len(x) + m)))), replace=False)
            y = np.unique(np.concatenate([keep, rng.integers(1, 2**63, max(0, m - len(keep)), dtype=np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if 100 * shared < 80 * (len(x) + len(y) - shared):
                continue
            assert jaccard_join.least_difference(jaccard_join.odd_sketch(x), jaccard_join.odd_sketch(y)) <= len(x) + len(y) - 2 * shared
            for often in (0, 2, 4, 7):  # none, some, most, all tokens frequent
                keys = [document_keys(z, often) for z in (x, y)]
                assert keys[0] & keys[1], (n, often)


def document_keys(z, often):
    token, _, place = jaccard_join.prefix_entries(z, np.array([0, len(z)]), (z % np.uint64(7)).astype(np.uint8))
    frequent = (token >> np.uint64(20)) % np.uint64(7) < often
    basic = place <= len(z) // 5
    if not (frequent & basic).any():
        return set(token[basic].tolist())
    return set(token[~frequent].tolist()) | set(jaccard_join.combination_keys(token[frequent], place[frequent], len(z)).tolist())


@pytest.mark.parametrize("frequent", [256, 16])
def test_jaccard_join_of_large_groups(spark, frequent):
    """Large groups of copies and of near copies, and a passage that most documents share."""
    rng = random.Random(7)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    common, base, other = words(60), words(150), words(150)
    texts = [" ".join(base)] * 300
    for k in range(300):
        near = list(base if k % 2 else other)
        near[rng.randrange(len(near))] = f"x{k}"
        texts.append(" ".join(near))
    texts += [" ".join(words(20) + common + words(rng.randrange(1, 40))) for _ in range(400)]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(frame, frequent=frequent).collect()}
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if find(i) != find(j) and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    assert got == {i: (len(x), find(i)) for i, x in sets}


def test_decontamination(spark, docs):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").unionByName(spark.createDataFrame([(901, None), (902, ""), (903, "one two"), (904, "W5 w6-w7")], "item_id bigint, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items.collect():
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[k : k + 10])].add(i)
    expected = []
    for i, t in docs.select("doc_id", "text").collect():
        w = word.findall(low(t))
        hit, found = set(), set()
        for n in {len(p) for p in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit.update(range(k, k + n))
        expected.append((i, len(w), len(hit), len(found), decontaminate.digest(list(found)), bool(hit)))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in decontaminate.report(docs, items).collect())
    # small blocks of items give the same
    blocks = decontaminate.find_phrases(docs, items, block_windows=300).selectExpr("doc_id", "size(items) as n").collect()
    assert sorted((str(r[0]), r[1]) for r in blocks) == sorted((str(e[0]), e[3]) for e in expected)
    assert decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8).astype(np.float32)]) for i in range(700)]
    rows += [(700, rows[3][1]), (701, None), (702, [0.0] * 8), (703, [float("nan")] * 8), (704, []), (800, [None] * 8), (900, rows[5][1])]
    got = defaultdict(list)
    for r in vantage.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), shard=100, block=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    assert set(got) == {i for i in good if i % 100 == 0}
    for q, found in got.items():
        d = sorted((round(float(np.sqrt(((good[q] - v) ** 2).sum())), 9), i) for i, v in good.items() if i != q)
        assert found == [(i, s) for s, i in d[:10]]


def test_token_files_and_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    tok.encode_special_tokens = True
    rows = docs.select("doc_id", "text").collect()
    ids = [np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in rows]
    got = grammar_store.stored_documents(docs, shard_tokens=20_000).orderBy("start").collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(r.doc_id), len(i), zlib.crc32(i.tobytes())) for r, i in zip(rows, ids))
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    by = defaultdict(list)
    for r, i in zip(rows, ids):
        by[r.doc_id].append(i)
    used = defaultdict(list)
    for r in packing.pack(docs).collect():
        used[r.sequence_id].append((r.offset, r.length))
        assert any(zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in by[r.doc_id])
    for s in used.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s])[:-1]) and sum(n for _, n in s) <= 2048
    total = sum(map(len, ids))
    assert sum(n for s in used.values() for _, n in s) == total and len(used) <= 1.02 * total / 2048 + 2


def test_added_tokens_are_one_id(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["<|endoftext|>", "before <|endoftext|> after", " a\n<|endoftext|>b c", "x<|endoftext|><|endoftext|>", " <|endoftext|", "plain words", None, "", "d\xe9j\xe0 <|endoftext|> vu \u2014 it's"]
    plain = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert plain[0] == [tok.token_to_id("<|endoftext|>")]
    assert [ids.tolist() for ids in tokens.Encoder(tokens.default_tokenizer()).encode_all(texts)] == [[*x, 0] for x in plain]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    wanted = {i: (len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(plain)}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in grammar_store.stored_documents(docs).collect()} == wanted
    assert {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs).collect()} == wanted


def test_steps_without_tokens_release_encoders():
    """A worker that goes on to another step holds no encoder of an earlier one."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "one two three four five six"}])
    levels = np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8)
    for step in (jaccard_join._index(5, levels), passages._seeds(8, 12, 50), lambda batches: [quality._contexts(batches)]):
        tokens.encoder(tokens.default_tokenizer()).encode("some words")
        assert tokens._encoders
        list(step(iter([batch])))
        assert not tokens._encoders


def test_encoder_on_odd_strings():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    rng = random.Random(3)
    signs = [*"aZé9 '\n\t.-<|>ßµªº", "  ", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "漢", "字", "'s", "'ll", " it", "\r\n", "🙂", "e\u0301", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(4000)] + ["a" * 3000, " b" * 3000, "\n" * 500]
    few = tokens.Encoder(tokens.default_tokenizer(), most=500)  # forgets its runs again and again
    wanted = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [x.tolist() for part in range(0, len(texts), 100) for x in few.encode_all(texts[part : part + 100])] == wanted


def test_random_access(spark, docs):
    """Any range of any stored document, decoded alone."""
    path = shared.new_path(spark, "shards")
    grammar_store.write_shards(docs, path, tokens.default_tokenizer(), shard_tokens=30_000)
    enc, rng, texts = tokens.Encoder(tokens.default_tokenizer()), random.Random(1), defaultdict(set)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].add((*enc.encode(r.text).tolist(), 0))
    some_rules = False
    for shard in spark.read.parquet(path).collect():
        some_rules |= len(shard["rules"]) > 0
        for k, doc in enumerate(shard["doc_ids"]):
            n = shard["lengths"][k]
            a = rng.randrange(n)
            b = rng.randrange(a, n) + 1
            whole = tuple(grammar_store.decode_document(shard, k).tolist())
            assert whole in texts[doc] and tuple(grammar_store.decode_document(shard, k, a, b - a).tolist()) == whole[a:b]
    assert some_rules


def test_compress_and_expand():
    rng = np.random.default_rng(4)
    for _ in range(30):
        seq = rng.integers(0, 6, rng.integers(1, 3000)).astype(np.uint32)
        last = rng.random(len(seq)) < 0.02
        last[-1] = True
        out, rules, ends = grammar_store.compress(seq, last.copy(), least=4)
        assert (grammar_store.expand(out, rules) == seq).all() and (grammar_store.unpack_symbols(grammar_store.pack_symbols(out)) == out).all()
        pairs = Counter(p for p, e in zip(zip(out[:-1].tolist(), out[1:].tolist()), ends) if not e)
        assert not pairs or max(pairs.values()) < 4  # no frequent pair is left
        lengths = grammar_store.expansion_lengths(rules)
        size = np.where(out >= grammar_store.BASE, lengths[np.maximum(out.astype(int) - grammar_store.BASE, 0)] if len(rules) else 1, 1)
        assert (np.flatnonzero(last) == np.cumsum(size)[ends] - 1).all()


def test_warc(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3", "same"), (4, "u", None), (5, None, ""), (None, "x", "WARC/1.1\r\n\r\n"), (6, "x\r\ny", "a\r\n\r\nWARC/1.1\r\n"), (7, "é", "é" * 3000), (3, "http://a/3", "same")]
    rows += [(8, "u", "\r\n\r\nWARC/1.1\r\n" * 3), (9, "u", "\r\n\r\n\r\n\r\nWARC/1.1\r\n\r\n"), (10, "u", "\r\n\r\n"), (11, "u", "x" * 3_000_000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (12, "u", "\r\n" * 40_000)]
    got = warc.archived_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    last = {"same": 3, "": 5}
    expected = []
    for i, _, h in rows:
        h = h or ""
        to = last.get(h) if i is not None and last.get(h, i) != i else None
        expected.append((i, len(h.encode()), warc.base32_sha1(h.encode()), "revisit" if to else "response", to))
    assert sorted(map(repr, expected)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert all(r.request_target is not None for r in got)


def test_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 50_000, n)]
    shared = word(80)
    fuzzy = [w if k % 20 else "changed" for k, w in enumerate(shared)]
    texts = {1: word(300) + shared + word(50), 2: word(100) + shared, 3: fuzzy + word(200), 4: word(400), 5: shared[:40] + word(100)}
    docs = spark.createDataFrame([(i, " ".join(t).upper() if i == 2 else " ".join(t)) for i, t in texts.items()] + [(6, None), (7, ""), (None, " ".join(shared))], "doc_id bigint, text string")
    got = {(r.doc_id, r.other_id): (r.start_word, r.end_word) for r in passages.repeated_passages(docs).collect()}
    assert set(got) == {(2, 1), (3, 1)} and got[2, 1] == (100, 180)
    left = {r.doc_id: r.text for r in passages.remove_repeats(docs).collect()}
    assert left[1] == " ".join(texts[1]) and left[4] == " ".join(texts[4]) and left[2] == " ".join(texts[2][:100]).upper() and len(left[3].split()) < 225


def test_passages_of_one_chain(spark):
    """Passages with other words between them, and passages moved into the gap of a chain."""
    rng = np.random.default_rng(6)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 50_000, n)]
    p, q, r = word(120), word(100), word(100)
    a = p + word(60) + q + word(120) + r
    c = p[:60] + word(60) + p[60:]
    d = word(30) + q + word(120) + r
    m = word(5) + q + p[:60] + r  # the middle one stands before both in 1
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(c)), (3, " ".join(d)), (4, " ".join(m))], "doc_id bigint, text string")
    got = {(x.doc_id, x.start_word, x.end_word, x.other_start_word, x.other_end_word) for x in passages.repeated_passages(docs).where("other_id = 1").collect()}
    assert got == {(2, 0, 60, 0, 60), (2, 120, 180, 60, 120), (3, 30, 130, 180, 280), (3, 250, 350, 400, 500), (4, 5, 105, 180, 280), (4, 105, 165, 0, 60), (4, 165, 265, 400, 500)}


def exact_passages(texts, n):
    """Word places of runs of n words that a document of a smaller id holds too."""
    out = {}
    for i, w in texts.items():
        before = {tuple(v[j : j + n]) for o, v in texts.items() if o < i for j in range(len(v) - n + 1)}
        out[i] = {p for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in before for p in range(j, j + n)}
    return out


def test_passages_of_common_sentences(spark):
    """Smaller documents hold each sentence of a passage singly, only a later one all of it."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 50_000, n)]
    texts, sentences = {}, [word(28) for _ in range(40)]
    for i, s in enumerate(sentences):
        texts[i] = word(60) + s + word(60)
    for i in range(40):  # pairs of sentences that follow each other in two documents
        both = sentences[i] + sentences[(i * 7 + 1) % 40]
        texts[100 + i], texts[200 + i] = word(70) + both + word(30), both + word(70)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string")
    got = {i: set() for i in texts}
    for r in passages.repeated_passages(docs).collect():
        assert r.other_id < r.doc_id and r.end_word - r.start_word >= 50
        got[r.doc_id].update(range(r.start_word, r.end_word))
    wanted = exact_passages(texts, 50)
    assert sum(map(len, wanted.values())) >= 40 * 56 and all(wanted[i] <= got[i] for i in texts)


def test_passages_with_changed_words_and_seeds_of_others(spark, monkeypatch):
    """Two documents share a passage of which every 30th word differs; smaller documents hold its seeds singly."""
    rng = np.random.default_rng(10)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 50_000, n)]
    shared = word(300)
    changed = [w if 20 <= i < 280 and i % 30 else f"c{i}" for i, w in enumerate(shared)]
    texts = {i: word(60) + shared[10 * i : 10 * i + 30] + word(60) for i in range(28)}
    texts |= {50: word(40) + shared + word(40), 60: word(80) + changed + word(30), 70: word(70) + shared[100:129] + word(50)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string")
    for block in (1024, 4):
        monkeypatch.setattr(passages, "BLOCK", block, raising=False)
        got = passages.repeated_passages(docs).collect()
        assert [(r.doc_id, r.other_id, r.start_word, r.end_word) for r in got] == [(60, 50, 100, 360)]


def test_passages_without_long_equal_runs_beside_their_seed(spark, monkeypatch):
    """Every fifth word beside the seed differs, so no equal words lead on from it; a group of such documents gives rows by places, not by pairs."""
    rng = np.random.default_rng(12)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 50_000, n)]
    shared = word(62)
    changed = lambda i: [w if 20 <= j < 42 or j % 5 else f"c{i}x{j}" for j, w in enumerate(shared)]
    texts = {0: word(60) + shared[20:42] + word(60), 1: word(40) + shared + word(40)}
    texts |= {i: word(30) + changed(i) + word(30) for i in range(2, 40)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string")
    for block in (1024, 8):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = passages.repeated_passages(docs).collect()
        assert {(r.doc_id, r.start_word, r.end_word) for r in got if r.other_id == 1} >= {(2, 31, 92)}
        held = {i: set() for i in texts}
        for r in got:
            held[r.doc_id].update(range(r.start_word, r.end_word))
            own, other = (np.array([int.from_bytes(w.encode(), "big") % (1 << 61) for w in texts[d][s:e]]) for d, s, e in ((r.doc_id, r.start_word, r.end_word), (r.other_id, r.other_start_word, r.other_end_word)))
            assert len(own) >= 50 and passages._table(own, other)[-1, -1] >= r.matched >= 0.8 * max(len(own), len(other))
        assert all(held[i] >= set(range(31, 92)) for i in range(2, 40)) and not held[0] and not held[1]
        assert block < 1024 or len(got) <= 4 * len(texts)


def test_parity_sketches():
    """Sketches never show more differences than there are."""
    rng = np.random.default_rng(11)
    for _ in range(50):
        a, b = rng.integers(0, 1 << 63, 40, dtype=np.uint64)[rng.integers(0, 40, (2, 90))]
        odd = passages.parity_sketches(np.concatenate([a, b]), np.repeat([0, 1], 90), 2)
        x, y = Counter(a.tolist()), Counter(b.tolist())
        assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= ((x - y) + (y - x)).total()


def test_passages_cover_all_equal_runs_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    expected, seen = {}, set()
    for row in docs.select("doc_id", "text").orderBy("doc_id").collect():
        w = words.findall(low(row.text).encode())
        runs = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        expected[row.doc_id] = {p for j, run in enumerate(runs) if run in seen for p in range(j, j + 50)}
        seen.update(runs)
    covered = defaultdict(set)
    for r in passages.repeated_passages(docs).collect():
        assert r.other_id < r.doc_id and r.end_word - r.start_word >= 50
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    assert sum(map(len, expected.values())) > 1000
    assert all(places <= covered[i] for i, places in expected.items())


def test_passages_of_periodic_text(spark):
    """A short line said often, with and without a smaller document that says it less often; seeds on one side of a long passage only."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 50_000, n)]
    line, long = word(6), word(1500)
    texts = {1: word(40) + line * 50, 2: line * 50 + word(80), 3: word(30) + line * 12 + word(30), 4: word(30) + ["one"] * 5000, 5: ["one"] * 70 + word(20), 6: word(3) + ["one"] * 900 + word(9)}
    texts[0] = line * 5 + word(30)
    texts.update({10 + i: word(50) + long[40 * i : 40 * i + 40] + word(50) for i in range(1, 37)})  # smaller holders of most of its seeds
    texts[90], texts[91] = word(20) + long, long + word(20)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id bigint, text string")
    got = {i: set() for i in texts}
    for r in passages.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    wanted = exact_passages(texts, 50)
    assert len(wanted[2]) >= 300 and len(wanted[6]) == 900 and len(wanted[91]) == 1500
    assert all(wanted[i] <= got[i] for i in texts)


def test_chain_goes_on_to_its_end(spark):
    """The chain's extension is followed past the first slices: words differ so often that no other seeds join in."""
    a = np.arange(3000, dtype=np.uint32)
    b = a.copy()
    b[400::9] += 100_000
    row = {"doc_id": 2, "other_id": 1, "first": 380, "anchors": [380, 380, 19], "low": 380 - 128, "other_low": 380 - 128, "n": 3000, "other_n": 3000, "a": b[252:527].tobytes(), "b": a[252:527].tobytes()}
    import pyarrow as pa

    align = lambda r: next(passages._align(50, 0.8)(iter([pa.RecordBatch.from_pylist([r])]))).to_pylist()
    assert [r["open"] for r in align(row)] == [True]
    found = align({**row, "low": 0, "other_low": 0, "a": b.tobytes(), "b": a.tobytes()})
    assert [(r["start_word"], r["end_word"], r["open"]) for r in found] == [(0, 2992, False)]  # seven equal words are left
    words = [f"w{x}" for x in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(w if i < 400 or i % 9 else f"c{i}" for i, w in enumerate(words)))], "doc_id bigint, text string")
    got = passages.repeated_passages(docs).collect()
    assert [(r.start_word, r.end_word) for r in got] == [(0, 2997)]


def test_stretches_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(300):
        a, b = rng.integers(0, 9, (2, rng.integers(1, 40)))
        pairs, table = passages._common(a, b), passages._table(a, b)
        assert len(pairs) == table[-1, -1] == len(passages._common(a, b, 8)) and all(a[i] == b[j] for i, j in pairs)
        runs, x, y = [], 0, 0
        for _ in range(rng.integers(1, 12)):
            n = int(rng.integers(1, 12))
            runs.append((x, y, n))
            x, y = x + n + int(rng.integers(0, 6)), y + n + int(rng.integers(0, 6))
        wanted = set()
        for i, (s, t, _) in enumerate(runs):
            for j in range(i, len(runs)):
                e, u = runs[j][0] + runs[j][2], runs[j][1] + runs[j][2]
                if e - s >= 20 and sum(n for *_, n in runs[i : j + 1]) >= 0.8 * max(e - s, u - t):
                    wanted.update(range(s, e))
        got = passages.stretches(runs, 20, 0.8)
        assert {w for s, e, *_ in got for w in range(s, e)} == wanted
        assert all(m >= 0.8 * max(e - s, u - t) and e - s >= 20 for s, e, t, u, m in got)


def test_chain_is_best():
    found = passages.chain([(0, 0, 8), (10, 12, 8), (20, 5, 8), (30, 40, 8)], 0.25, 8)
    assert found[0] == [(0, 0, 8), (10, 12, 8)] or found[0] == [(0, 0, 8), (10, 12, 8), (30, 40, 8)]


def test_main_text(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    odd = spark.createDataFrame([(901, "u", None), (902, "u", ""), (903, None, "<p>only &amp; <b>this"), (904, "u", "<" * 50), (905, "u", "<article><p>" + "long words here, " * 5000)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in main_text.main_text(pages.unionByName(odd)).collect()}
    assert len(got) == pages.count() + 5 and all(r.n_chars == len(r.text) for r in got.values())
    assert got[901].text == got[902].text == ""
    assert len(got[905].text) > 80_000
    for r in pages.collect():
        import html

        inner = re.search(r"<article[^>]*>(.*?)</article>", r.html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in lines if x)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    for frame in (toxicity.score(none, labels), quality.score(none, labels), jaccard_join.similar_documents(none), decontaminate.report(none, items), vantage.nearest_neighbours(vectors), grammar_store.stored_documents(none), warc.archived_pages(pages), packing.pack(none), passages.repeated_passages(none), main_text.main_text(pages)):
        assert frame.count() == 0


def test_pipeline(spark):
    """Each stage against what its operator says of its predecessor's rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, rows[-1], FOLDER)
        assert out.columns == columns
        rows.append(out.cache())
    assert rows[2].count() == jaccard_join.similar_documents(rows[1]).select("component_id").distinct().count()
    assert passages.repeated_passages(rows[3]).join(rows[3], "doc_id").count() <= passages.repeated_passages(rows[2]).count()
    packed = corpus_pipeline.STAGES[4][1](spark, rows[4], FOLDER)
    assert packed.select("doc_id").distinct().count() == rows[4].count() > 100
