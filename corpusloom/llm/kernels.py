"""Vectorised helpers that run inside Spark tasks on Arrow batches.

A text column is seen as one byte array with row offsets; words are found and
hashed there without making a Python string for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = 0x9E3779B97F4A7C1B  # odd and 3 modulo 8, so that its powers stay far from one
_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_WINDOW = 1 << 18  # bytes hashed at once; tables and sums of them fit a core's cache
_powers: dict[str, np.ndarray] = {}


def space_separated() -> np.ndarray:
    """Bytes of words that only ASCII white space (0x20, 0x09 to 0x0D) separates."""
    table = np.ones(256, bool)
    table[9:14] = table[32] = False
    return table


def alphanumeric() -> np.ndarray:
    """Bytes of words made of ASCII letters, digits and anything beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, _WINDOW + 1)
        for key, base in (("up", _STEP), ("down", pow(_STEP, -1, 2**64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[key] = np.cumprod(factors)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's first word (one more for the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = table[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; starts ascend and spans are not nested."""
    out = np.empty(len(starts), np.uint64)
    table = _BYTE_LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _WINDOW, "right")))
        low, high = int(starts[i]), int(ends[i:j].max())
        up, down = _power(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * up[: high - low], out=total[1:])
        s = starts[i:j] - low
        out[i:j] = (total[ends[i:j] - low] - total[s]) * down[s] + (ends[i:j] - starts[i:j]).astype(np.uint64)
        i = j
    return mix(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each place; k - 1 fewer than words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += words[i : i + n] * _MULT[i]
    return mix(out + np.uint64(k))


def row_shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that stay within a row: their hash, row, and place in the row."""
    every = shingles(words, k)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = row[: len(every)] == row[k - 1 :] if len(every) else np.zeros(0, bool)
    place = np.arange(len(every)) - first[:-1][row[: len(every)]] if len(every) else np.zeros(0, np.int64)
    return every[inside], row[: len(every)][inside], place[inside]


def row_sets(batch: pa.RecordBatch, k: int, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending within the row, and row offsets.

    A row of fewer than k words, but not none, has its whole sequence as one.
    """
    data, offsets = text_bytes(batch.column(column))
    starts, ends, first = find_words(data, offsets, space_separated())
    words = hash_spans(data, starts, ends)
    value, row, _ = row_shingles(words, first, k)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.array([shingles(words[first[i] : first[i + 1]], int(count[i]))[0] for i in short], np.uint64)
        value, row = np.concatenate([value, whole]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(batch.num_rows + 1))
