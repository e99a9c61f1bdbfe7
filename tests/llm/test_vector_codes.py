"""Vector codes against a plain loop, with odd vectors, ties and labels; and that cells lose no nearest entry."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import vector_codes


def plain(rows, rounds=2):
    """(vec_id, code, error, label_error, sha) of (vec_id, vector, label) rows."""
    kept = []
    for i, v, label in rows:
        if v and len(v) % 16 == 0 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-vector_codes.LARGEST, min(vector_codes.LARGEST, math.floor(256 * x))) for x in v], label, [*v]))
    out = []
    for dim in {len(v) for _, v, *_ in kept}:
        own, width = [r for r in kept if len(r[1]) == dim], dim // 16
        first = sorted((r for r in own if r[0] is not None), key=lambda r: (r[0], r[3]))[:64]
        if not first:
            continue
        books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(16)]

        def assign(p, part, books=books):
            return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

        for _ in range(rounds):
            sums = [defaultdict(list) for _ in range(16)]
            for _, v, *_ in own:
                for p in range(16):
                    part = v[p * width : (p + 1) * width]
                    sums[p][assign(p, part)[1]].append(part)
            for p in range(16):
                for k, parts in sums[p].items():
                    books[p][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, v, label, _ in own:
            found = [assign(p, v[p * width : (p + 1) * width]) for p in range(16)]
            out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label, sha))
    by = defaultdict(int)
    for _, _, e, label, _ in out:
        by[label] += e
    return [(i, c, e, by[label], sha) for i, c, e, label, sha in out]


def held(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, code string, error int")
    got = vector_codes.encode(frame)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, plain([(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])))


def test_encode(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=32).tolist(), int(i % 3) if i % 5 else None) for i in rng.permutation(400)]
    rows += [(1000 + i, [0.5] * 32, 1) for i in range(150)]  # a group of copies
    rows += [(5, rng.normal(size=32).tolist(), 2), (None, [1.0] * 32, None), (7, None, 1), (8, [None] + [1.0] * 31, 1), (9, [float("nan")] * 32, 1), (10, [float("inf")] + [0.0] * 31, 1), (11, [], 1), (12, [1.0] * 5, 1), (13, [0.0] * 32, 1), (14, [3e38, -3e38] * 16, 9)]
    rows += [(2000 + i, rng.normal(size=16).tolist(), 4) for i in range(70)] + [(None, [0.25] * 48, 4)]
    got, want = held(spark, rows)
    assert got == want and len(got) == 400 + 150 + 2 + 2 + 70


@pytest.mark.parametrize("n", [0, 1, 63])
def test_few_rows(spark, n):
    got, want = held(spark, [(i, [i / 7 + j for j in range(16)], i % 2) for i in range(n)])
    assert got == want and len(got) == n


def test_cells_are_exact(monkeypatch):
    """Nearest entries are those of all distances, ties to the lower index, and few are measured; also when cells are forgotten."""
    rng = np.random.default_rng(3)
    for most in (1 << 20, 50):
        monkeypatch.setattr(vector_codes, "MOST_CELLS", most)
        for spread in (20, 300, 5000):
            book = rng.integers(-spread, spread, (64, 4))
            book[40:44] = book[3]
            cells = vector_codes.Cells(book)
            for _ in range(3):
                parts = rng.integers(-spread, spread, (700, 4))
                entry, distance = cells.nearest(parts)
                d = ((parts[:, None] - book[None]) ** 2).sum(-1)
                assert (entry == d.argmin(1)).all() and (distance == d.min(1)).all()
            if spread == 5000:
                assert cells.measured < 0.1 * 3 * d.size
