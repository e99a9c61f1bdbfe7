"""Language of a text by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased and every run of other characters is one separator;
features are the runs of one to LONGEST characters within a word and its
separators, in 2**BITS hash buckets. A document's value for an n-gram is
(1 + log count) times its inverse document frequency, over the norm of all its values.
Document frequencies are counted over all documents that may be learnt from.

Weights are learnt by follow the regularised leader (per-coordinate rates, an elastic
net of l1 and l2) on at most `most` documents, taken in turn from each language
by hash. They are dealt to `shards` tasks; in each round every task goes once
through its documents from the same state, and the states are averaged. A quarter of
the sample is left out of this, and gives the temperature that divides the scores
before they become probabilities. Memory is of the order of languages times buckets.

Null texts and texts without a letter (Unicode category L) are `und` with score 0; so are
all texts where nothing can be learnt from. A null language isn't learnt from, nor
is a row without an id; repeated rows are each predicted, and learnt from as one. Ties
between languages go to the first in order. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import blocks, mix
from .shared import discard, keep
from .sums import KIND, array_sums, remainder, total

BITS, LONGEST = 16, 3
SIZE = 1 << BITS
BIAS = SIZE  # a feature that every document has
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it isn't a letter."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _letters.append(table)
    return _letters[0]


def ngrams(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of each text; none where it has no letter."""
    joined = "\n" + "".join(f"{t or ''}\n" for t in texts)
    code = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts) + 1), [1, *(len(t or "") + 1 for t in texts)]) - 1
    kept = code != 0
    kept[1:] |= code[:-1] != 0
    kept[0] = True
    code, row = code[kept].astype(np.uint64), row[kept]
    letter = code != 0
    own = np.where(letter, row, np.append(row[1:], row[-1:]))  # a separator belongs to the word after it
    found, first = [], []
    value = np.zeros(len(code), np.uint64)
    inside = np.ones(len(code), bool)
    for n in range(1, LONGEST + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(0x110003) + code[n - 1 :]
        if n > 2:
            inside = inside[:m] & letter[n - 2 : n - 2 + m]
        at = np.flatnonzero(inside[:m] & (letter[:m] if n == 1 else letter[:m] | letter[1 : m + 1]))
        found.append((mix(value[at] + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - BITS)).astype(np.int64))
        first.append(np.searchsorted(own[at], np.arange(len(texts) + 1)))
    for i in range(len(texts)):
        yield np.concatenate([g[f[i] : f[i + 1]] for g, f in zip(found, first, strict=True)]) if found else np.zeros(0, np.int64)


class Counter:
    """Distinct buckets and their counts, without sorting."""

    def __init__(self):
        self.last = np.zeros(SIZE, np.int64)

    def counts(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.last[grams] = np.arange(len(grams))
        n = np.bincount(self.last[grams], minlength=len(grams))
        at = np.flatnonzero(n)
        return grams[at], n[at]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Documents of each bucket, and at the end all documents."""
    counts, counter = np.zeros(SIZE + 1, np.int64), Counter()
    for whole in batches:
        for batch in blocks(whole, "text"):
            for grams in ngrams(batch.column("text").to_pylist()):
                counts[counter.counts(grams)[0]] += 1
            counts[SIZE] += batch.num_rows
    return counts


class Features:
    """TF-IDF values of n-grams; the last feature is the bias."""

    def __init__(self, idf: np.ndarray):
        self.idf, self.counter = idf, Counter()

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket, n = self.counter.counts(grams)
        value = (1 + np.log(n)) * self.idf[bucket]
        return np.append(bucket, BIAS), np.append(value / max(1e-12, np.sqrt((value**2).sum())), 1.0)


class Leader:
    """Follow the regularised leader: state (z, n) of each language and feature."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, bucket: np.ndarray, value: np.ndarray, language: int) -> None:
        w = self.weights(bucket)
        error = softmax(value @ w)
        error[language] -= 1
        g = value[:, None] * error
        n = self.n[bucket]
        self.z[bucket] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[bucket] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _round(shared, settings: tuple[float, float, float, float]):
    """The states after each shard's documents, times their number, and that number; a task's rows come by shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        idf, z, n = shared.value
        features, out = Features(idf), np.zeros(2 * z.size + 1)
        leader, shard, seen = None, None, 0

        def finish() -> None:
            if leader:
                out[:-1] += np.concatenate([leader.z.ravel(), leader.n.ravel()]) * seen
                out[-1] += seen

        for whole in batches:
            for batch in blocks(whole, "text"):
                for grams, language, own in zip(ngrams(batch.column("text").to_pylist()), batch.column("number").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                    if own != shard:
                        finish()
                        leader, shard, seen = Leader(z.copy(), n.copy(), *settings), own, 0
                    leader.learn(*features.of(grams), language)
                    seen += 1
        finish()
        return out

    return array_sums(build)


class Model:
    """Languages, and what scoring needs: inverse document frequencies, weights and temperature."""

    def __init__(self, names: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.names, self.idf, self.weights, self.temperature = names, idf, weights, temperature

    def scores(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Scores of the languages, None where a text has no letter."""
        features = Features(self.idf)
        for grams in ngrams(texts):
            if len(grams):
                bucket, value = features.of(grams)
                yield value @ self.weights[bucket]
            else:
                yield None


def _calibration(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in blocks(whole, "text"):
                found = [None if s is None else s.tolist() for s in model.scores(batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(found, pa.list_(pa.float64()))], names=["number", "scores"])

    return run


def temperature(scores: np.ndarray, languages: np.ndarray) -> float:
    """What to divide scores by so that the languages are likeliest, from 1/4 to 100, by golden-section search; without mistakes the likelihood alone would have no bound."""

    def loss(log_t: float) -> float:
        return -np.log(softmax(scores / np.exp(log_t))[np.arange(len(languages)), languages] + 1e-300).mean()

    low, high, part = np.log(0.25), np.log(100.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, divisor: int = 4, held: int = 2, most: int = 8_000, shards: int = 4, rounds: int = 5, alpha: float = 1.0, beta: float = 0.1, l1: float = 0.02, l2: float = 0.01) -> Model | None:
    """None where there is nothing to learn from."""
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(divisor) != held) & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(12)).alias("h")).distinct()
    turn = hashed.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("turn") <= most)
    chosen = turn.orderBy("turn", "h", "doc_id", "lang").limit(most).select("doc_id", "lang", "h")
    sample = chosen.collect()  # at most `most` rows of an id, a language and a number
    names = sorted({r["lang"] for r in sample})
    if not names:
        return None
    own = spark.createDataFrame([(r["doc_id"], r["lang"], r["h"], names.index(r["lang"])) for r in sample], "doc_id bigint, lang string, h bigint, number int")
    counts = total(rows.select("text").mapInArrow(array_sums(_frequencies), KIND), SIZE + 1)
    idf = np.log((1 + counts[SIZE]) / (1 + counts[:SIZE])) + 1
    picked = keep(rows.join(F.broadcast(own), ["doc_id", "lang"]).groupBy("doc_id", "h", "number").agg(F.min("text").alias("text")), "sample")
    fold = F.pmod(F.shiftright("h", 20), F.lit(4))
    dealt = picked.where(fold != 0).withColumn("shard", F.pmod("h", F.lit(shards)))
    taught = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "doc_id", "number").select("text", "number", "shard")
    shape = (SIZE + 1, len(names))
    state, settings = np.zeros((2, *shape)), (alpha, beta, l1, l2)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((idf, state[0], state[1]))
        sums = total(taught.mapInArrow(_round(shared, settings), KIND), 2 * state[0].size + 1)
        shared.unpersist()
        if sums[-1]:
            state = (sums[:-1] / sums[-1]).reshape(2, *shape)
    model = Model(names, idf, Leader(state[0], state[1], *settings).weights())
    shared = spark.sparkContext.broadcast(model)
    found = picked.where(fold == 0).select("text", "number").mapInArrow(_calibration(shared), "number int, scores array<double>").collect()
    shared.unpersist()
    discard(picked)
    found = [r for r in found if r[1]]
    if found:
        model.temperature = temperature(np.array([r[1] for r in found]), np.array([r[0] for r in found]))
    return model


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in blocks(whole, "text"):
                names, likely = [], []
                for scores in model.scores(batch.column("text").to_pylist()) if model else [None] * batch.num_rows:
                    p = None if scores is None else softmax(scores / model.temperature)
                    names.append("und" if p is None else model.names[int(p.argmax())])
                    likely.append(0.0 if p is None else float(p.max()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(likely, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the probability of lang_pred) of every document."""
    model = train(docs, **parameters)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    divisor, held = parameters.get("divisor", 4), parameters.get("held", 2)
    out = docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder(divisor) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
