"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are lower-cased (A-Z) runs of ASCII letters, digits and characters
beyond ASCII, in 2**BITS hash buckets, with a bucket for a token's first
PREFIX bytes too. A token's score is its log-odds in toxic against other
labelled documents, under a Dirichlet prior whose strength grows with the
token's frequency in the whole corpus and whose mean is the odds of its prefix,
which has such a prior around the labels' base rate. Less `drift`, scores are
negative on average; one linear scan then gives every maximal scoring segment.
A segment of score S in a document of n tokens has the expected number E = K n
exp(-lambda S) of such segments by chance (extreme-value theory); those with E
below `most_expected` are passages. A document's best and summed -log E go
through a logistic curve that is fitted on the labelled sample with scores
learnt from its other folds.

Null, empty and wordless texts have no tokens and get the score of a document
without passages. Repeated rows are each scored. An empty labels table gives
every document the score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import alphanumeric, blocks, find_words, hash_spans, text_bytes
from .sums import KIND, array_sums, labelled_sample, remainder, total

BITS, PREFIX, FOLDS = 18, 6, 4
SIZE = 1 << BITS
# tables of counts: corpus words, corpus prefixes, then for each fold: words and prefixes of toxic, of other documents
_TABLES = 2 + 4 * FOLDS


def _tokens(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, first = find_words(data, offsets, alphanumeric())
    shift = np.uint64(64 - BITS)
    word = (hash_spans(data, starts, ends) >> shift).astype(np.int64)
    prefix = (hash_spans(data, starts, np.minimum(ends, starts + PREFIX)) >> shift).astype(np.int64)
    return word, prefix, first


def _count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    counts = np.zeros((_TABLES, SIZE), np.int64)
    for whole in batches:
        for batch in blocks(whole, "text"):
            word, prefix, first = _tokens(batch)
            counts[0] += np.bincount(word, minlength=SIZE)
            counts[1] += np.bincount(prefix, minlength=SIZE)
            label, fold = batch.column("label").to_pylist(), batch.column("fold").to_pylist()
            for i, (y, f) in enumerate(zip(label, fold, strict=True)):
                if y is not None:
                    at = 2 + 4 * f + 2 * (1 - y)
                    a, b = first[i], first[i + 1]
                    np.add.at(counts[at], word[a:b], 1)
                    np.add.at(counts[at + 1], prefix[a:b], 1)
    return counts


def log_odds(corpus, corpus_prefix, toxic, toxic_prefix, other, other_prefix, floor: float = 4.0, strength: float = 20_000.0):
    """Log-odds of each word bucket, to be read with the word's prefix: returns functions of (word, prefix)."""
    n1, n0 = toxic.sum() + 1.0, other.sum() + 1.0
    base = n1 / (n1 + n0)
    weight = floor + strength * corpus_prefix / max(1.0, corpus_prefix.sum())
    mean = (toxic_prefix + weight * base) / (toxic_prefix + other_prefix + weight)
    weight = floor + strength * corpus / max(1.0, corpus.sum())
    edge = np.log(base / (1 - base))

    def of(word: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        m, w = mean[prefix], weight[word]
        return np.log(toxic[word] + w * m) - np.log(other[word] + w * (1 - m)) - edge

    return of


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (start, end, score) in one pass over the scores.

    Only places of positive score can begin or end one, so the rest enters through running sums.
    """
    at = np.flatnonzero(score > 0)
    run = np.concatenate([[0.0], np.cumsum(score)])
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    for i, low, high in zip(at.tolist(), run[at].tolist(), run[at + 1].tolist(), strict=True):
        start, end = i, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        found.append((start, end, low, high))
    return [(s, e, h - x) for s, e, x, h in found]


def chance(score: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """lambda and K of the extreme-value law for tokens of these scores drawn with these weights."""
    p = weight / weight.sum()
    if (p * score).sum() >= 0 or score[p > 0].max() <= 0:
        return 1.0, 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * score, 700))).sum() < 1:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * score, 700))).sum() < 1 else (low, mid)
    lam = (low + high) / 2
    # relative entropy of the tilted law; K is of the order of (drift / entropy) times the share of steps up
    tilted = p * np.exp(np.minimum(lam * score, 700))
    entropy = max(1e-9, lam * (tilted * score).sum())
    return lam, min(1.0, entropy * float(p[score > 0].sum()))


class Model:
    """Token scores, extreme-value law and logistic curve."""

    def __init__(self, counts: np.ndarray, drift: float, most_expected: float):
        self.counts, self.drift, self.most_expected = counts, drift, most_expected
        self.curve = self.law = None

    def fit(self, but: int | None):
        c = self.counts
        folds = [f for f in range(FOLDS) if f != but]
        t, tp, o, op = (sum(c[2 + 4 * f + k] for f in folds) for k in range(4))
        of = log_odds(c[0], c[1], t, tp, o, op)
        # a bucket's own prefix is not known here, so the law takes the base rate as the mean of all priors
        flat = log_odds(c[0], np.full(SIZE, c[1].mean()), t, np.zeros(SIZE), o, np.zeros(SIZE))(np.arange(SIZE), np.arange(SIZE)) - self.drift
        self.law = chance(flat, o + 1e-3)
        return of, self.law

    def passages(self, word, prefix, fitted) -> list[tuple[int, int, float]]:
        """(start, end, -log E) of all significant segments of a document."""
        of, (lam, k) = fitted
        if not len(word):
            return []
        found = segments(of(word, prefix) - self.drift)
        shift = np.log(k * len(word))
        return [(s, e, x) for s, e, x in ((s, e, lam * v - shift) for s, e, v in found) if x > -np.log(self.most_expected)]


def features(found: list[tuple[int, int, float]], n: int) -> list[float]:
    best = max((x for *_, x in found), default=0.0)
    return [1.0, np.log1p(max(0.0, best)), np.log1p(sum(max(0.0, x) for *_, x in found)), np.log1p(len(found)), np.log1p(n), np.log1p(len(found)) * np.log1p(n)]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Coefficients by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _fold_features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        fitted = [m.fit(f) for f in range(FOLDS)]
        for whole in batches:
            for batch in blocks(whole, "text"):
                word, prefix, first = _tokens(batch)
                out = []
                for i, f in enumerate(batch.column("fold").to_pylist()):
                    a, b = first[i], first[i + 1]
                    out.append(features(m.passages(word[a:b], prefix[a:b], fitted[f]), int(b - a)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for batch in blocks(whole, "text"):
                word, prefix, first = _tokens(batch)
                scores, lists = [], []
                for i in range(batch.num_rows):
                    a, b = first[i], first[i + 1]
                    found = m.passages(word[a:b], prefix[a:b])
                    x = np.array(features(found, int(b - a)))
                    scores.append(0.0 if m.curve is None else float(1 / (1 + np.exp(-np.clip(x @ m.curve, -30, 30)))))
                    lists.append([{"start_word": s, "end_word": e, "significance": v} for s, e, v in found])
                kind = pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("significance", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(lists, kind)], names=["doc_id", "score", "passages"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 5, held: int = 0, most: int = 20_000, drift: float = 1.5, most_expected: float = 1.0) -> Model:
    """Counts over all documents; labels from a sample of at most `most` rows that may be learnt from."""
    sample = F.broadcast(labelled_sample(labels, label, divisor, held, most))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = docs.select("doc_id", "text")
    parts = rows.join(sample, "doc_id", "left").select("text", "label", fold).mapInArrow(array_sums(_count), KIND)
    model = Model(total(parts, _TABLES * SIZE).reshape(_TABLES, SIZE).astype(np.float32), drift, most_expected)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = rows.join(sample, "doc_id").select("doc_id", "text", "label", fold).mapInArrow(_fold_features(shared), "doc_id bigint, label int, x array<double>")
    # one row of each sampled id, however often it is repeated
    got = found.groupBy("doc_id").agg(F.first("label"), F.min("x")).select("first(label)", "min(x)").collect()
    y = np.array([r[0] for r in got], float)
    if 0 < y.sum() < len(y):
        model.curve = logistic(np.array([r[1] for r in got]), y)
    elif len(y):
        model.curve = np.array([30.0 if y[0] else -30.0, 0, 0, 0, 0, 0])
    model.fit(None)
    return model


def score(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (words from start to end, -log of the number expected by chance)."""
    model = train(docs, labels, **parameters)
    shared = docs.sparkSession.sparkContext.broadcast(_Slim(model))
    out = docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id bigint, score double, passages array<struct<start_word:int,end_word:int,significance:double>>")
    divisor, held = parameters.get("divisor", 5), parameters.get("held", 0)
    return out.select("doc_id", F.coalesce(remainder(divisor) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


class _Slim:
    """What scoring needs of a model: one table of scores instead of the counts."""

    def __init__(self, model: Model):
        c = model.counts
        self.tables = [c[0], c[1], *(sum(c[2 + 4 * f + k] for f in range(FOLDS)) for k in range(4))]
        self.drift, self.most_expected, self.curve, self.law = model.drift, model.most_expected, model.curve, model.law
        self._of = None

    def passages(self, word, prefix):
        if self._of is None:
            self._of = (log_odds(*self.tables), self.law)
        return Model.passages(self, word, prefix, self._of)

    def __getstate__(self):
        return {**self.__dict__, "_of": None}
