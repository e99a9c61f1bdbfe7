"""Token ids of whole texts inside Spark tasks."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
# white space and letters, white space and other signs (with letters after an apostrophe), or white space
_RUNS = re.compile(rf"\s*[{_LETTER}]+|\s*[^\s{_LETTER}]+(?:(?<=')[{_LETTER}]+)?|\s+")
# letters that _LETTER lacks, and white space that libraries do not agree on: such texts are split at plain white space only, or not
_NOT_PLAIN = b"\x1c\x1d\x1e\x1f\x85\xa0\xaa\xb5\xba"
_WORDS = re.compile(r"\s*\S+|\s+")
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Runs that are looked up together, runs that are encoded as one text, and characters from which a run is encoded alone.
GROUP, CHAIN, LONG = 100_000, 10_000, 1_000
_encoders: dict[tuple[str, int], Encoder] = {}


class _Codes(dict):
    """Numbers of runs, in the order of their first look-up; `new` holds those that got one since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, run: str) -> int:
        code = self[run] = len(self) + 1
        self.new.append(run)
        return code


class Encoder:
    """Ids of a byte-level BPE tokenizer, with id 0 at the end of each text.

    The tokenizer splits text into pieces that never go on from a character to
    white space, nor from a letter to another sign, nor from another sign to a
    letter but after an apostrophe. The runs between such places are encoded
    once and kept, about `most` of them at a time. An added token's string is one
    id, as by the library's default; texts that hold one are encoded whole.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenizer, self.most = tokenizer, most
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.n_ids = tokenizer.get_vocab_size()
        self.n_bytes = np.zeros(self.n_ids + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a character stands for a byte
        self._forget()

    def _forget(self) -> None:
        """No runs; number 0 is the end of a text."""
        self.codes = _Codes()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 1
        self.start, self.size = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids without the end."""
        return next(self.encode_all([text]))[:-1]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, with 0 at the end; unknown runs of some texts at a time, GROUP runs or a text more, are encoded together."""
        held, n = [], 0
        for text in texts:
            held.append([text] if text and self.added and self.added.search(text) else runs(text))
            n += len(held[-1])
            if n >= GROUP:
                yield from self._encode_runs(held)
                held, n = [], 0
        yield from self._encode_runs(held)

    def _encode_runs(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self.codes) > self.most:
            self._forget()
        number = self.codes.__getitem__
        counts = np.array([len(own) for own in held], np.int64)
        last = np.cumsum(counts + 1) - 1
        codes = np.zeros(int(counts.sum()) + len(held), np.int64)
        within = np.ones(len(codes), bool)
        within[last] = False
        codes[within] = np.fromiter(map(number, chain.from_iterable(held)), np.int64, int(counts.sum()))
        self._learn()
        size = self.size[codes]
        stop = np.cumsum(size)
        ids = self.flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.start[codes] - stop + size, size)]
        ends = stop[last]
        yield from (ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False))

    def _learn(self) -> None:
        """Encode the new runs."""
        new = self.codes.new
        if not new:
            return
        first = len(self.codes) - len(new) + 1
        # runs that begin with white space and go on can follow each other in one text
        together, alone = [], []
        for i, r in enumerate(new):
            (together if r[0] in " \n" and len(r) < LONG and not r.isspace() and not (self.added and self.added.search(r)) else alone).append(i)
        for i in range(0, len(together), CHAIN):
            own = together[i : i + CHAIN]
            found = self._cut([new[j] for j in own])
            if found is None:
                alone += own
            else:
                self._store(np.array(own) + first, *found)
        for i in range(0, len(alone), CHAIN):
            own = alone[i : i + CHAIN]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([new[j] for j in own], add_special_tokens=False)]
            self._store(np.array(own) + first, np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64))
        self.codes.new = []

    def _cut(self, some: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of runs encoded as one text, and how many each has; None if they don't end where ids do."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(self.n_bytes[ids])
        stops = np.cumsum([len(r.encode()) for r in some])
        at = np.searchsorted(ends, stops)
        if len(ends) and ends[-1] == stops[-1] and (ends[at] == stops).all():
            return ids, np.diff(at, prepend=-1)
        return None

    def _store(self, codes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        most = int(codes.max()) + 1
        if most > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(max(most, len(x)), np.int64)]) for x in (self.start, self.size))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[codes], self.size[codes] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)


def runs(text: str | None) -> list[str]:
    if not text:
        return []
    try:
        raw = text.encode("latin-1")
        plain = len(raw.translate(None, _NOT_PLAIN)) == len(raw)
    except UnicodeEncodeError:
        plain = False
    if plain:
        return _RUNS.findall(text)
    return [text] if _ODD.search(text) else _WORDS.findall(text)


def encoder(path: str) -> Encoder:
    """This worker's encoder; the tokenizer file is read on the executor, once in a process."""
    key = (path, os.getpid())
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]


def release_encoders() -> None:
    """Free this worker's encoders, which a task of another step may have left in it, and give the memory back to the system."""
    if not _encoders:
        return
    _encoders.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(batch: pa.RecordBatch, enc: Encoder, key: str = "doc_id", column: str = "text") -> Iterator[tuple[int | None, np.ndarray]]:
    """Key and ids, with 0 at the end, of each row."""
    texts = (text.as_py() for text in batch.column(column))
    for k, ids in zip(batch.column(key), enc.encode_all(texts), strict=True):
        yield k.as_py(), ids
