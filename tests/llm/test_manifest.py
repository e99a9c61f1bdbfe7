"""The Merkle manifest against a plain loop, on small tables with nulls, ties, repeats and long texts."""

import hashlib
import zlib

import pytest

from corpusloom.llm import merkle

COLUMNS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, part int, idx int"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def up(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h("".join(found[-1][i : i + 16])) for i in range(0, len(found[-1]), 16)])
    return found


def way(found, i):
    for nodes in found[:-1]:
        a = i // 16 * 16
        yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])
        i //= 16


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for k in sources:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = [up([leaf(r, r[4]) for r in by[k]]) for k in sources]
    top = up([t[-1][0] for t in trees]) if trees else []
    for j, k in enumerate(sources):
        for i, r in enumerate(by[k]):
            steps = [*way(trees[j], i), *way(top, j)]
            node = leaf(r, lower(r[4]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4])
            for a, b in steps:
                node = h(a + node + b)
            yield r[0], leaf(r, r[4]), trees[j][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), node, node == top[-1][0]


def held(spark, rows, **parameters):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS)
    got = merkle.manifest(docs, **parameters)
    return sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(rows))), got.columns


@pytest.mark.parametrize("per_part", [7, 50_000])
def test_manifest(spark, per_part):
    sizes = {None: 3, "": 1, "a": 16, "b": 17, "é": 257, "z" * 500: 300, "Z": 2}
    rows = [(i * 7, s, "en" if i % 3 else None, i if i % 4 else None, f"Text {i} É of {s}" if i % 5 else None) for s, n in sizes.items() for i in range(n)]
    rows += [(None, "a", None, None, ""), (None, None, "x", 1, "Without an id"), (14, "b", "en", 2, "A repeated id"), *[(28, "b", "en", 2, "A repeated ROW")] * 40]
    rows += [(9000, "a", "en", 1, "Long TEXT " * 40_000)]
    ok, columns = held(spark, rows, per_part=per_part)
    assert ok
    assert columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_many_sources(spark):
    assert held(spark, [(i, f"s{i}", "en", i, "Word") for i in range(300)], per_part=20)[0]


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_few_rows(spark, n):
    assert held(spark, [(i, "s", "en", 1, "A B") for i in range(n)])[0]


def test_missing_nodes_are_few(spark):
    """A part asks for no node that its own leaves give, and for 30 of a level at most."""
    spans = spark.createDataFrame([(0, 5, 100, 5000, 100_000)], "part int, tree bigint, low bigint, high bigint, n bigint")
    got = [(r.level, r.idx) for r in merkle.missing(spans, 5).collect()]
    want = []
    for level in range(5):
        a, b, last = 100 >> 4 * level, 5000 >> 4 * level, 99_999 >> 4 * level
        want += [(level, i) for i in range(a // 16 * 16, min(b // 16 * 16 + 15, last) + 1) if not a <= i <= b]
    assert sorted(got) == want and len(got) <= 30 * 5
