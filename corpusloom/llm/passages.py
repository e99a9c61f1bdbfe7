"""Substring dedup: repeated passages by collinear chaining of shared k-mer seeds.

Words are lower-cased (A-Z) runs of ASCII letters, digits and characters beyond
ASCII, compared by hash. Seeds are the minimizers of `k`-word shingles: of each
`window` consecutive shingles the one of the smallest hash, so that any k +
window - 1 equal words share one. Each seed links its documents to the first
place it has (smallest doc_id), never all pairs. The shared seeds of a pair of
documents become anchors (runs on one diagonal), a Fenwick tree over the other
document's places finds the best chain of ordered anchors under a linear gap
cost, and again on what is left. Chains are then aligned on the words: anchors
are extended to both sides and the gaps aligned. A passage is reported when it
has `min_words` words or more and `identity` of them match; of a chain with
less, the parts for which that holds.

Null and empty texts have no passages. Rows without an id take no part; rows of
one id are not compared with each other. Repetition inside a document is not
looked for. Columns but doc_id and text are ignored.

A seed names one partner, which may hold too little of a passage. So all runs of
`min_words` words in the neighbourhood of repeated seeds are looked up as a
whole too: each names the smallest document that holds all of it, and every
word of a run of `min_words` equal words or more is found whatever documents hold
its sentences singly. Seeds that lie in no passage so far are then compared with
all smaller documents that hold them, one of those with the same words beside the
seed: parity sketches of the words beside it rule out pairs that can't share
`identity` of `min_words` words there, for the rest the words on either side of the
seed are aligned. So a passage with changed words is found whatever documents hold
its seeds singly, if a seed lies in `min_words` words of it of which `identity` match.
Of all that are found about a place two are returned, that which begins first and that
which ends last: they hold every word that any does. Only their pairs are chained by
all seeds they share, so rows grow with the places, not with the pairs of a group.

In text of a period up to `window` words the seeds after the first repeat it. They
lead to no chains, which would all begin at one place, but keep the whole text
in the neighbourhood of seeds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import alphanumeric, blocks, find_words, hash_spans, mix, row_shingles, text_bytes
from .shared import discard, free_name, keep, only_marked
from .tokens import release_encoders

_CHAIN = "doc_id bigint, other_id bigint, first int, last int, other_first int, other_last int, anchors array<int>"
_PASSAGE = "doc_id bigint, other_id bigint, start_word int, end_word int, other_start_word int, other_end_word int, matched int"
_ALIGNED = _PASSAGE + ", first int, open boolean"
#: Words beside a chain that are fetched at first; edits an extension may cross, and equal words that must follow them.
MARGIN, SLACK, AFTER = 128, 3, 8
#: Bits of the parity sketch of the words beside a seed, and places of one seed in a block of comparisons.
BITS, BLOCK = 2048, 1024


def _words(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, first = find_words(data, offsets, alphanumeric())
    return data, offsets, starts, ends, first


def minimizers(value: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the smallest of each `window` consecutive values of a row, and which of them repeat the one before."""
    if len(value) < window:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    inside = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    views = np.lib.stride_tricks.sliding_window_view(value, window)
    chosen = np.zeros(len(value), bool)
    for some in np.array_split(inside, len(inside) // 500_000 + 1):
        chosen[some + views[some].argmin(1)] = True
    at = np.flatnonzero(chosen)
    again = (value[at[1:]] == value[at[:-1]]) & (row[at[1:]] == row[at[:-1]])
    return at, np.concatenate([[False], again]) if len(at) else again


def _seeds(k: int, window: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        for whole in batches:
            for batch in blocks(whole, "text"):
                data, _, starts, ends, first = _words(batch)
                value, row, place = row_shingles(hash_spans(data, starts, ends), first, k)
                long = (np.diff(first) >= min_words)[row]
                value, row, place = value[long], row[long], place[long]
                at, again = minimizers(value, row, window)
                yield pa.RecordBatch.from_arrays([pa.array(value[at].view(np.int64)), batch.column("doc_id").take(pa.array(row[at])), pa.array(place[at].astype(np.int32)), pa.array(again)], names=["seed", "doc_id", "place", "again"])

    return run


class Fenwick:
    """Largest (value, item) at or before a place."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, value: float, item: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at][0]:
                self.best[at] = (value, item)
            at += at & -at

    def get(self, at: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while at > 0:
            if self.best[at][0] > found[0]:
                found = self.best[at]
            at -= at & -at
        return found


def chain(anchors: list[tuple[int, int, int]], gap: float, least: float) -> list[list[tuple[int, int, int]]]:
    """Chains of anchors (x, y, length) that ascend in both, best first, until none has a score of `least`.

    A chain's score is the words its anchors hold less `gap` for each word skipped on either side. Every
    anchor is in one chain. One search gives all chains that share no anchor with a better one of it.
    """
    out = []
    anchors = sorted(anchors)
    while anchors:
        ys = sorted({y + n for _, y, n in anchors})
        tree, score, before = Fenwick(len(ys)), [0.0] * len(anchors), [-1] * len(anchors)
        waiting = sorted(range(len(anchors)), key=lambda i: anchors[i][0] + anchors[i][2])
        w = 0
        for i, (x, y, n) in enumerate(anchors):
            while w < len(waiting) and anchors[waiting[w]][0] + anchors[waiting[w]][2] <= x:
                j = waiting[w]
                xe, ye = anchors[j][0] + anchors[j][2], anchors[j][1] + anchors[j][2]
                tree.put(bisect_left(ys, ye), score[j] + gap * (xe + ye), j)
                w += 1
            value, j = tree.get(bisect_left(ys, y + 1))
            value -= gap * (x + y)
            score[i], before[i] = (n + value, j) if j >= 0 and value > 0 else (float(n), -1)
        gone: set[int] = set()
        for i in sorted(range(len(anchors)), key=lambda i: -score[i]):
            if i in gone or score[i] < least:
                continue
            members = []
            while i >= 0 and i not in gone:
                members.append(i)
                i = before[i]
            if i < 0:
                out.append([anchors[m] for m in reversed(members)])
                gone.update(members)
        if not gone:
            break
        anchors = [a for m, a in enumerate(anchors) if m not in gone]
    return out


def _chains(k: int, gap: float):
    """Chains of pairs of documents; rows come sorted by pair and place, a pair within one partition."""

    def of_pairs(doc, other, x, y) -> Iterator[tuple]:
        new_pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])])
        new = new_pair | np.concatenate([[True], (y[1:] - x[1:] != y[:-1] - x[:-1]) | (x[1:] - x[:-1] > 4 * k)])
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(x)]]) - 1
        length = x[end] - x[begin] + k
        pair = np.concatenate([np.flatnonzero(new_pair[begin]), [len(begin)]])
        for a, b in zip(pair[:-1], pair[1:], strict=True):
            anchors = list(zip(x[begin[a:b]].tolist(), y[begin[a:b]].tolist(), length[a:b].tolist(), strict=True))
            for found in [anchors] if b - a == 1 else chain(anchors, gap, k):
                (x0, y0, _), (x1, y1, n) = found[0], found[-1]
                yield int(doc[begin[a]]), int(other[begin[a]]), x0, x1 + n, y0, y1 + n, [v for t in found for v in t]

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        rows = list(of_pairs(*columns))
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "other_id", "first", "last", "other_first", "other_last", "anchors"])

    return _by_pair(emit)


def _by_pair(emit: Callable[[list[np.ndarray]], pa.RecordBatch]):
    """Call emit with the columns of whole pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "other_id", "place", "other_place")]
            held = now if held is None else [np.concatenate(z) for z in zip(held, now, strict=True)]
            if not len(held[0]):
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = int(np.argmax(last))  # the last pair may go on in the next batch
            if cut:
                yield emit([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield emit(held)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in blocks(whole, "text"):
            data, _, starts, ends, first = _words(batch)
            words = hash_spans(data, starts, ends).astype(np.uint32)
            out: list[tuple] = []
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                own = words[first[i] : first[i + 1]]
                out += [(q["doc_id"], q["other_id"], q["first"], q["side"], max(0, q["low"]), own[max(0, q["low"]) : q["high"]].tobytes(), len(own)) for q in wanted]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["doc_id", "other_id", "first", "side", "low", "words", "n"])


def _table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of all prefixes."""
    out = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, w in enumerate(a):
        np.maximum(out[i, 1:], out[i, :-1] + (b == w), out=out[i + 1, 1:])
        np.maximum.accumulate(out[i + 1], out=out[i + 1])
    return out


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int32)
    for w in a:
        step = row.copy()
        np.maximum(row[1:], row[:-1] + (b == w), out=step[1:])
        row = np.maximum.accumulate(step)
    return row


def _common(a: np.ndarray, b: np.ndarray, most: int = 1_000_000) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; tables of more than `most` numbers are halved (Hirschberg)."""
    in_a, in_b = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    if not len(in_a):
        return []
    a, b = a[in_a], b[in_b]
    if len(a) > 1 and len(a) * len(b) > most:
        half = len(a) // 2
        cut = int((_last_row(a[:half], b) + _last_row(a[half:][::-1], b[::-1])[::-1]).argmax())
        pairs = _common(a[:half], b[:cut], most) + [(i + half, j + cut) for i, j in _common(a[half:], b[cut:], most)]
    else:
        length, pairs = _table(a, b), []
        i, j = len(a), len(b)
        while i and j:
            if length[i, j] == length[i - 1, j]:
                i -= 1
            elif length[i, j] == length[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        pairs.reverse()
    return [(int(in_a[i]), int(in_b[j])) for i, j in pairs]


def _same(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def align(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int, int]], slack: int = SLACK) -> list[tuple[int, int, int]]:
    """Runs of equal words (place in a, place in b, length) of the chain of anchors as aligned and extended.

    Ends are extended over equal words, and over up to `slack` edits that at least AFTER equal words follow.
    """
    out: list[tuple[int, int, int]] = []

    def put(x: int, y: int, n: int) -> None:
        if n and out and out[-1][0] + out[-1][2] == x and out[-1][1] + out[-1][2] == y:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        elif n:
            out.append((x, y, n))

    def extend(p: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
        i = j = 0
        found = []
        raw_p, raw_q, size = p.tobytes(), q.tobytes(), p.itemsize
        ahead = [(d, e) for d in range(slack + 1) for e in range(slack + 1) if d + e]

        def next_words(raw: bytes, at: int) -> bytes:
            return raw[at * size : (at + AFTER) * size]

        while True:
            n = _same(p[i:], q[j:])
            found.append((i, j, n))
            i, j = i + n, j + n
            if min(len(p) - i, len(q) - j) < AFTER:
                return found
            steps = [(d, e) for d, e in ahead if max(i + d + AFTER - len(p), j + e + AFTER - len(q)) <= 0 and next_words(raw_p, i + d) == next_words(raw_q, j + e)]
            if not steps:
                return found
            d, e = min(steps, key=lambda s: (max(s), sum(s)))
            i, j = i + d, j + e

    at, other_at, _ = anchors[0]
    for i, j, n in reversed(extend(a[:at][::-1], b[:other_at][::-1])):
        put(at - i - n, other_at - j - n, n)
    for x, y, n in anchors:
        gap_a, gap_b = a[at:x], b[other_at:y]
        head = _same(gap_a, gap_b)
        tail = _same(gap_a[head:][::-1], gap_b[head:][::-1])
        put(at, other_at, head)
        for i, j in _common(gap_a[head : len(gap_a) - tail], gap_b[head : len(gap_b) - tail]):
            put(at + head + i, other_at + head + j, 1)
        put(x - tail, y - tail, tail)
        n = min(n, len(a) - x, len(b) - y)
        edge = np.diff(np.concatenate([[0], (a[x : x + n] == b[y : y + n]).astype(np.int8), [0]]))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            put(x + i, y + i, j - i)
        at, other_at = x + n, y + n
    for i, j, n in extend(a[at:], b[other_at:]):
        put(at + i, other_at + j, n)
    return out


def cover(found: Iterable[tuple]) -> list[tuple]:
    """Of spans (start, end, ...) that ascend by start some that cover the same places."""
    out: list[tuple] = []
    for span in found:
        if out and span[1] <= out[-1][1]:
            continue
        if len(out) > 1 and span[0] <= out[-2][1]:
            out.pop()
        out.append(span)
    return out


def stretches(runs: list[tuple[int, int, int]], min_words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """Start and end in a, in b, and matching words: all of the runs if `identity` holds, else the longest parts of them for which it does.

    A part begins and ends with a whole run, as equal words more can only raise its identity. Every word of such parts is covered.
    """
    if not runs:
        return []
    x, y, n = np.array(runs, np.int64).T
    x_end, y_end, matched = x + n, y + n, np.cumsum(n)
    out, last = [], -1
    for i in range(len(x)):
        if last == len(x) - 1 or x_end[-1] - x[i] < min_words:
            break
        same = matched[i:] - matched[i] + n[i]
        good = np.flatnonzero((x_end[i:] - x[i] >= min_words) & (same >= identity * np.maximum(x_end[i:] - x[i], y_end[i:] - y[i])))
        if len(good) and i + good[-1] > last:
            last = i + int(good[-1])
            out.append((int(x[i]), int(x_end[last]), int(y[i]), int(y_end[last]), int(same[good[-1]])))
    return cover(out)


def _unfinished(left: int, more: bool, other_left: int, other_more: bool) -> bool:
    """Whether an extension could go on in words that were not fetched: those left of the slices, and whether their documents go on."""
    if not left + more or not other_left + other_more:
        return False
    return (more and left < SLACK + AFTER) or (other_more and other_left < SLACK + AFTER)


def _align(min_words: int, identity: float):
    """Passages of chains; for a chain that needs longer slices one row that says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["a"], np.uint32), np.frombuffer(r["b"], np.uint32)
                flat, low, other_low = r["anchors"], r["low"], r["other_low"]
                runs = align(a, b, [(flat[i] - low, flat[i + 1] - other_low, flat[i + 2]) for i in range(0, len(flat), 3)])
                ids = r["doc_id"], r["other_id"]
                if runs:
                    (x, y, _), (x1, y1, n) = runs[0], runs[-1]
                    before = _unfinished(x, low > 0, y, other_low > 0)
                    if before or _unfinished(len(a) - x1 - n, low + len(a) < r["n"], len(b) - y1 - n, other_low + len(b) < r["other_n"]):
                        out.append((*ids, *[None] * 5, r["first"], True))
                        continue
                for s, e, t, u, matched in stretches(runs, min_words, identity):
                    out.append((*ids, s + low, e + low, t + other_low, u + other_low, matched, r["first"], False))
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _ALIGNED.split(", ")])

    return run


def long_shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place, from hashes of two overlapping halves."""
    value, size = mix(words), 1
    while size < n and len(value):
        step = min(size, n - size)
        value = mix(value[:-step] * np.uint64(0x9E3779B97F4A7C15) + value[step:]) if len(value) > step else value[:0]
        size += step
    return value


def _runs(k: int, window: int, min_words: int):
    """Runs of min_words words all of whose seeds are repeated, that is, none lies beyond the reach of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                data, _, starts, ends, first = _words(batch)
                value = long_shingles(hash_spans(data, starts, ends), min_words)
                spots = batch.column("spots")
                place, row = spots.flatten().to_numpy(), spots.value_parent_indices().to_numpy()
                low = first[row] + np.maximum(place - (window - 1), 0)
                high = np.minimum(first[row] + place + k + window - 1, first[row + 1])
                inside = low < high  # places of another row of this id may lie beyond this one
                edge = np.zeros(len(starts) + 1, np.int32)
                np.add.at(edge, low[inside], 1)
                np.add.at(edge, high[inside], -1)
                near = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                of = np.repeat(np.arange(batch.num_rows), np.diff(first))
                at = np.flatnonzero((near[min_words:] - near[:-min_words] == min_words) & (of[: len(value)] == of[min_words - 1 :])) if len(value) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value[at].view(np.int64)), batch.column("doc_id").take(pa.array(of[at])), pa.array((at - first[of[at]]).astype(np.int32))], names=["seed", "doc_id", "place"])

    return run


def _equal(min_words: int):
    """Passages of equal words of pairs of documents from shared runs, sorted like the rows of _chains."""

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        doc, other, x, y = columns
        new_pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])])
        begin = np.flatnonzero(new_pair | np.concatenate([[True], (x[1:] - x[:-1] != 1) | (y[1:] - y[:-1] != 1)]))
        last = np.concatenate([begin[1:], [len(x)]]) - 1
        s, e, t = x[begin].tolist(), (x[last] + min_words).tolist(), y[begin].tolist()
        pair = np.concatenate([np.flatnonzero(new_pair[begin]), [len(begin)]])
        rows = []
        for a, b in zip(pair[:-1].tolist(), pair[1:].tolist(), strict=True):
            ids = int(doc[begin[a]]), int(other[begin[a]])
            rows += [(*ids, f, g, h, h + g - f, g - f) for f, g, h in cover(zip(s[a:b], e[a:b], t[a:b], strict=True))]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _PASSAGE.split(", ")])

    return _by_pair(emit)


def _firsts(seeds: DataFrame, name: str) -> DataFrame:
    """Seeds of more than one document and the first place of the smallest."""
    found = seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("f"), F.max("doc_id").alias("last")).where("f.doc_id <> last")
    return keep(found.select("seed", F.col("f.doc_id").alias("other_id"), F.col("f.place").alias("other_place")), name)


def parity_sketches(words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows of words a bit of each bucket: whether an odd number of its words, counted as often as they occur, is in it."""
    key = np.sort((row.astype(np.uint64) << np.uint64(32)) | (words >> np.uint64(32)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    time = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    bucket = mix((key & np.uint64(0xFFFFFFFF)) | (time.astype(np.uint64) << np.uint64(32))) % np.uint64(BITS)
    count = np.bincount((key >> np.uint64(32)).astype(np.int64) * BITS + bucket.astype(np.int64), minlength=n * BITS)
    return np.packbits((count & 1).astype(np.uint8).reshape(n, BITS), axis=1)


def _contexts(k: int, reach: int):
    """For each seed of a document the words up to `reach` beside it, their number, sketch and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                data, _, starts, ends, first = _words(batch)
                words = hash_spans(data, starts, ends)
                spots = batch.column("spots")
                row, flat = spots.value_parent_indices().to_numpy(), spots.flatten()
                place = flat.field("place").to_numpy().astype(np.int64)
                fits = np.flatnonzero(place + k <= np.diff(first)[row])  # places of another row of this id may lie beyond this one
                for some in np.array_split(fits, len(fits) // 1000 + 1):
                    at = first[row[some]] + place[some]
                    low, high = np.maximum(at - reach, first[row[some]]), np.minimum(at + k + reach, first[row[some] + 1])
                    n = high - low
                    spot = np.repeat(np.arange(len(some)), n)
                    where = np.arange(len(spot)) + np.repeat(low - np.cumsum(n) + n, n)
                    near = words[where]
                    same = np.add.reduceat(mix(near + (where - at[spot] + reach).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.cumsum(n) - n) if len(some) else near
                    odd = parity_sketches(near, spot, len(some))
                    own = flat.take(pa.array(some))
                    raw, edge = near.astype(np.uint32).tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [own.field("seed"), batch.column("doc_id").take(pa.array(row[some])), own.field("open"), own.field("place"), pa.array(n.astype(np.int32)), pa.array((at - low).astype(np.int32)), pa.array(same.view(np.int64)), pa.array([o.tobytes() for o in odd], pa.binary()), pa.array([raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())],
                        names=["seed", "doc_id", "open", "place", "n", "before", "same", "odd", "words"],
                    )

    return run


def beside(a: np.ndarray, b: np.ndarray, identity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of b and 0, 1, ... first words of a: the words of b that suit best, the words in common, and what these exceed `identity` of the longer side by.

    The last word of a is one in common, else the excess is minus infinity.
    """
    row, n = np.zeros((len(b), b.shape[1] + 1), np.int16), np.arange(b.shape[1] + 1)
    ends, same, over = np.zeros((len(b), len(a) + 1), np.int32), np.zeros((len(b), len(a) + 1), np.int32), np.full((len(b), len(a) + 1), -np.inf)
    over[:, 0] = 0
    every = np.arange(len(b))
    for i in np.flatnonzero(np.isin(a, b)).tolist():  # other words change no length
        was = row.copy()
        np.maximum.accumulate(np.maximum(row[:, 1:], row[:, :-1] + (b == a[i])), axis=1, out=row[:, 1:])
        value = np.where(row > was, row - identity * np.maximum(i + 1, n), -np.inf)
        j = value.argmax(1)
        ends[:, i + 1], same[:, i + 1], over[:, i + 1] = j, row[every, j], value[every, j]
    return ends, same, over


def about_seed(left: tuple, right: tuple, k: int, min_words: int, identity: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of what `beside` gives for both sides of a seed: rows with a passage, words before and after the seed in a, and words in common.

    First the longest before the seed that each row has, and with that the longest after it; then the other way.
    """
    i, j = np.ogrid[: left[2].shape[1], : right[2].shape[1]]
    good = (left[2][:, :, None] + right[2][:, None, :] + (1 - identity) * k >= -1e-9) & (i + k + j >= min_words)
    row = np.flatnonzero(good.any((1, 2)))
    last = lambda x: x.shape[1] - 1 - x[:, ::-1].argmax(1)
    out = []
    for one in (True, False):
        x = last(good[row].any(2 if one else 1)) if len(row) else row
        y = last(good[row, x] if one else good[row, :, x]) if len(row) else row
        before, after = (x, y) if one else (y, x)
        out.append((row, before, after, left[1][row, before] + right[1][row, after] + k))
    return out


def _beside(words: list[np.ndarray], before: list[int], k: int) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Words before (nearest first) and after each seed, and the same as matrices filled up with -1."""
    left, right = [w[:n][::-1] for w, n in zip(words, before, strict=True)], [w[n + k :] for w, n in zip(words, before, strict=True)]
    matrices = []
    for side in (left, right):
        out = np.full((len(side), max(map(len, side), default=0)), -1, np.int64)
        for x, w in zip(out, side, strict=True):
            x[: len(w)] = w
        matrices.append(out)
    return left, right, *matrices


def _near(k: int, min_words: int, identity: float):
    """Passages about open places from the words beside them: of all smaller documents' that which reaches farthest before the seed, and that after it.

    Together these hold every word that any of them does. Sketches rule out most others first. Rows come sorted by (seed, p, q).
    """
    least = -int(-identity * min_words // 1)

    def of_group(table: pa.Table, two: bool) -> list[tuple]:
        doc, n, is_open, place = (table.column(c).to_numpy() for c in ("doc_id", "n", "open", "place"))
        side = table.column("block").to_numpy() != table.column("p").to_numpy()
        odd = np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint64).reshape(len(doc), BITS // 64)
        words = [np.frombuffer(w, np.uint32).astype(np.int64) for w in table.column("words").to_pylist()]
        left, right, lefts, rights = _beside(words, table.column("before").to_pylist(), k)
        out = []
        for r in np.flatnonzero(is_open).tolist():
            at = np.flatnonzero((doc < doc[r]) & ((side != side[r]) | (not two)))
            at = at[np.bitwise_count(odd[at] ^ odd[r]).sum(1, dtype=np.int64) <= n[at].astype(np.int64) + int(n[r]) - 2 * least]
            best: list[tuple | None] = [None, None]
            for some in np.array_split(at, len(at) // 256 + 1) if len(at) else ():
                one, other = beside(left[r], lefts[some], identity), beside(right[r], rights[some], identity)
                for i, (row, before, after, same) in enumerate(about_seed(one, other, k, min_words, identity)):
                    span = np.maximum(before + k + after, one[0][row, before] + k + other[0][row, after])
                    row, before, after, same = (x[same >= identity * span] for x in (row, before, after, same))
                    if not len(row):
                        continue
                    order = (-before, -after) if i == 0 else (-after, -before)
                    f = np.lexsort((doc[some[row]], *order[::-1]))[0]
                    key = (*(int(o[f]) for o in order), int(doc[some[row[f]]]))
                    if best[i] is None or key < best[i][0]:
                        x, y, q = int(before[f]), int(after[f]), int(place[some[row[f]]])
                        best[i] = key, (int(doc[r]), key[2], int(place[r]) - x, int(place[r]) + k + y, q - int(one[0][row[f], x]), q + k + int(other[0][row[f], y]), int(same[f]))
            out += dict.fromkeys(b[1] for b in best if b)
        return out

    def of_groups(table: pa.Table, edges: list[int]) -> pa.RecordBatch:
        p, q = table.column("p").to_numpy(), table.column("q").to_numpy()
        rows = [row for a, b in zip(edges[:-1], edges[1:], strict=True) for row in of_group(table.slice(a, b - a), p[a] != q[a])]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _PASSAGE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            group = np.stack([held.column(c).to_numpy() for c in ("seed", "p", "q")])
            edges = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist()]
            yield of_groups(held, edges)
            held = held.slice(edges[-1])
        if held is not None:
            yield of_groups(held, [0, held.num_rows])

    return run


def _by_pairs(matches: DataFrame) -> DataFrame:
    pairs = matches.where("doc_id <> other_id").select("doc_id", "other_id", "place", "other_place")
    return pairs.repartition("doc_id", "other_id").sortWithinPartitions("doc_id", "other_id", "place", "other_place")


def repeated_passages(docs: DataFrame, min_words: int = 50, k: int = 8, window: int = 12, gap: float = 0.25, identity: float = 0.8) -> DataFrame:
    """Passages of doc_id that other_id, a smaller id, has too: word places (end excluded) in both, and words that match.

    Of passages of one pair those that lie inside another's place in doc_id are left out.
    """
    if k + window - 1 > min_words:
        raise ValueError("a passage of min_words must be sure to share a seed")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seeds = keep(docs.mapInArrow(_seeds(k, window, min_words), "seed bigint, doc_id bigint, place int, again boolean"), "seeds")
    firsts = _firsts(seeds, "firsts")
    repeated = keep(only_marked(seeds, "seed", firsts.select("seed")).join(firsts, "seed"), "repeated")
    discard(seeds)
    discard(firsts)
    chains = keep(_by_pairs(repeated.where("not again")).mapInArrow(_chains(k, gap), _CHAIN), "chains")
    equal = _equal_passages(docs, repeated, k, window, min_words)
    found = keep(equal.unionByName(_aligned_passages(docs, chains, min_words, identity)), "found")
    found = found.unionByName(_further_passages(docs, repeated, found, k, min_words, gap, identity))
    discard(repeated)
    order = Window.partitionBy("doc_id", "other_id").orderBy("start_word", F.desc("end_word"), "other_start_word", "other_end_word")
    reached = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("reached", reached).where("reached is null or end_word > reached").drop("reached")


def _equal_passages(docs: DataFrame, repeated: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    spots = repeated.groupBy("doc_id").agg(F.collect_list("place").alias("spots"))
    texts = only_marked(docs, "doc_id", repeated.select("doc_id"))
    runs = keep(texts.join(spots, "doc_id").mapInArrow(_runs(k, window, min_words), "seed bigint, doc_id bigint, place int"), "runs")
    firsts = _firsts(runs, "run-firsts")
    found = keep(_by_pairs(runs.join(firsts, "seed")).mapInArrow(_equal(min_words), _PASSAGE), "equal")
    discard(runs)
    discard(firsts)
    return found


def _further_passages(docs: DataFrame, repeated: DataFrame, found: DataFrame, k: int, min_words: int, gap: float, identity: float) -> DataFrame:
    """Passages about seeds that lie in none found: by the words beside them, and all of the pairs of documents that these are of."""
    places = _open_places(docs, repeated, found, k, min_words, identity)
    near = keep(_blocked(places).mapInArrow(_near(k, min_words, identity), _PASSAGE), "near")
    discard(places)
    pairs = keep(near.select("doc_id", "other_id").distinct(), "pairs")
    chains = keep(_by_pairs(_shared_seeds(repeated, pairs)).mapInArrow(_chains(k, gap), _CHAIN), "chains")
    return near.unionByName(_aligned_passages(docs, chains, min_words, identity))


def _open_places(docs: DataFrame, repeated: DataFrame, found: DataFrame, k: int, min_words: int, identity: float) -> DataFrame:
    """Seeds that lie in no passage found, all places of the same seeds, and the words beside them."""
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    held = repeated.where("not again")
    inside = F.expr(f"exists(spans, s -> s.start_word <= place and s.end_word >= place + {k})")
    left = held.where("doc_id <> other_id").join(spans, "doc_id", "left").where(~F.coalesce(inside, F.lit(False)))
    left = keep(left.select("seed", "doc_id", "place", F.lit(True).alias("open")), "left")
    seeds = left.select("seed").distinct()
    holders = only_marked(held, "seed", seeds).join(seeds, "seed", "left_semi").select("seed", "doc_id", "place").join(left, ["seed", "doc_id", "place"], "left")
    spots = holders.groupBy("doc_id").agg(F.collect_list(F.struct("seed", "place", F.coalesce("open", F.lit(False)).alias("open"))).alias("spots"))
    spots = keep(spots, "spots")
    texts = only_marked(docs, "doc_id", spots.select("doc_id"))
    # min_words words of which identity match lie this far from a seed at most, in either document
    reach = int(min_words / identity) - k
    kind = "seed bigint, doc_id bigint, open boolean, place int, n int, before int, same bigint, odd binary, words binary"
    contexts = keep(texts.join(spots, "doc_id").mapInArrow(_contexts(k, reach), kind), "contexts")
    # of equal contexts the smallest document's stands for all: the others lie in passages of equal words
    firsts = contexts.groupBy("seed", "same").agg(F.min(F.struct("doc_id", "open", "place", "n", "before", "odd", "words")).alias("f")).select("seed", "f.*")
    places = keep(firsts, "places")
    for table in (left, spots, contexts):
        discard(table)
    return places


def _blocked(places: DataFrame) -> DataFrame:
    """Places of seeds that have an open one, in pairs of blocks of about BLOCK, sorted by these."""
    several = places.groupBy("seed").agg(F.count("*").alias("places"), F.max("open").alias("any")).where("places > 1 and any").select("seed", F.ceil(F.col("places") / BLOCK).cast("int").alias("parts"))
    blocked = places.join(several, "seed").withColumn("block", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocked = blocked.select("seed", F.least("block", "to").alias("p"), F.greatest("block", "to").alias("q"), "block", "doc_id", "open", "place", "n", "before", "odd", "words")
    return blocked.repartition("seed", "p", "q").sortWithinPartitions("seed", "p", "q")


def _shared_seeds(repeated: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places of all seeds that pairs share, the first one in the smaller document."""
    held = repeated.where("not again").select("seed", "doc_id", "place")
    mine = only_marked(held, "doc_id", pairs.select("doc_id")).join(pairs, "doc_id")
    theirs = only_marked(held, "doc_id", pairs.select("other_id")).groupBy(F.col("doc_id").alias("other_id"), "seed").agg(F.min("place").alias("other_place"))
    return mine.join(theirs, ["other_id", "seed"])


def _aligned_passages(docs: DataFrame, chains: DataFrame, min_words: int, identity: float) -> DataFrame:
    """Passages of all chains; those whose extension meets the end of its slice are aligned again with longer ones."""
    keys = ["doc_id", "other_id", "first"]
    parts, margin = [], MARGIN
    while True:
        aligned = keep(_with_slices(docs, chains, margin).mapInArrow(_align(min_words, identity), _ALIGNED), "aligned")
        parts.append(aligned.where("not open").drop("first", "open"))
        again = aligned.where("open").select(*keys).distinct()
        if again.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        chains, margin = keep(chains.join(again, keys, "left_semi"), "chains"), 4 * margin


def _with_slices(docs: DataFrame, chains: DataFrame, margin: int) -> DataFrame:
    """Chains with the words of both documents around them."""
    salts = 64 + chains.count() // 1_000_000
    mine = F.struct("doc_id", "other_id", "first", F.lit(0).alias("side"), (F.col("first") - margin).alias("low"), (F.col("last") + margin).alias("high"))
    theirs = F.struct("doc_id", "other_id", "first", F.lit(1).alias("side"), (F.col("other_first") - margin).alias("low"), (F.col("other_last") + margin).alias("high"))
    wanted = (
        chains.select(F.explode(F.array(F.struct(F.col("doc_id").alias("need"), mine.alias("q")), F.struct(F.col("other_id").alias("need"), theirs.alias("q")))).alias("r"))
        .select("r.need", "r.q", F.pmod(F.xxhash64("r.q.doc_id"), F.lit(salts)).alias("salt"))
        .groupBy("need", "salt")
        .agg(F.collect_list("q").alias("wanted"))
        .select(F.col("need").alias("doc_id"), "wanted")
    )
    texts = only_marked(docs, "doc_id", chains.select(F.explode(F.array("doc_id", "other_id")).alias("id")))
    slices = keep(texts.join(wanted, "doc_id").select("text", "wanted").mapInArrow(_slices, "doc_id bigint, other_id bigint, first int, side int, low int, words binary, n int"), "slices")
    keys = ["doc_id", "other_id", "first"]
    a = slices.where("side = 0").select(*keys, "low", "n", F.col("words").alias("a"))
    b = slices.where("side = 1").select(*keys, F.col("low").alias("other_low"), F.col("n").alias("other_n"), F.col("words").alias("b"))
    return chains.select(*keys, "anchors").join(a, keys).join(b, keys)


def _cut(schema: pa.Schema, spans_of: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                data, offsets, starts, ends, first = _words(batch)
                texts = batch.column("text").to_pylist()
                keep_row = np.ones(len(texts), bool)
                for i, spans in enumerate(batch.column(spans_of).to_pylist()):
                    if not spans:
                        continue
                    n = first[i + 1] - first[i]
                    gone = np.zeros(n, bool)
                    for s in spans:
                        gone[s["start_word"] : s["end_word"]] = True
                    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    raw, parts, at = data[offsets[i] : offsets[i + 1]].tobytes(), [], 0
                    for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                        parts.append(raw[at : starts[first[i] + s] - offsets[i]])
                        at = int(ends[first[i] + e - 1] - offsets[i])
                    texts[i] = (b"".join(parts) + raw[at:]).decode().strip()
                    keep_row[i] = not gone.all()
                columns = {"text": pa.array(texts, pa.string())}
                if "n_chars" in schema.names:
                    was = batch.column("n_chars").to_pylist()
                    spans = batch.column(spans_of).to_pylist()
                    columns["n_chars"] = pa.array([len(t) if s else n for t, n, s in zip(texts, was, spans, strict=True)], schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns.get(f.name, None) if f.name in columns else batch.column(f.name) for f in schema], schema=schema).filter(pa.array(keep_row))

    return run


def remove_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """Documents without the passages that a smaller doc_id has; those of which no word is left go.

    Null and empty texts and rows without an id stay as they are. Rows of one id lose the
    words of all passages found in any of them. Any other columns may be there; n_chars is
    counted again where words went.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = free_name("spans", docs.columns)
    found = repeated_passages(docs, **parameters)
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias(own))
    joined = docs.join(keep(spans, "spans"), "doc_id", "left").select(*docs.columns, own)
    return joined.mapInArrow(_cut(to_arrow_schema(docs.schema), own), docs.schema)
