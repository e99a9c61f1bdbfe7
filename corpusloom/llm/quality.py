"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Tokens are runs of letters (ASCII letters and characters beyond ASCII), of
digits and of other signs. Each has one of 2**BITS hash buckets and one of
SHAPES shapes (kind, case, length). Each bucket and shape has a fixed index
vector of two signed units in DIM places; its word vector is the sum of the
index vectors of all neighbours up to REACH tokens away over the whole corpus
(counted over all documents), scaled to unit length about the mean. A
document's features are the means of its tokens' word vectors and of its
shapes' vectors, the mean over its distinct buckets, and a few counts. Two
layers of weights, learnt by Adam on the labelled sample, give a logit that a
temperature, fitted on a part held back from the sample, turns into a
probability.

Null, empty and tokenless texts have zero vectors and counts and get the score
of such a document. Repeated rows are each scored. An empty labels table gives
every document the score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import blocks, find_words, hash_spans, mix, text_bytes
from .shared import free_name
from .sums import KIND, array_sums, labelled_sample, remainder, total
from .tokens import release_encoders

BITS, DIM, REACH, SHAPES = 15, 32, 2, 128
ROWS = (1 << BITS) + SHAPES


def _kinds() -> list[np.ndarray]:
    letters, digits, signs = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
    letters[65:91] = letters[97:123] = letters[128:] = True
    digits[48:58] = True
    signs[9:14] = signs[32] = False
    return [letters, digits, signs & ~letters & ~digits]


def _tokens(batch: pa.RecordBatch):
    """Bucket and shape of all tokens in text order, and each row's first token."""
    data, offsets = text_bytes(batch.column("text"))
    found = [find_words(data, offsets, table) for table in _kinds()]
    bucket = np.concatenate([(hash_spans(data, s, e) >> np.uint64(64 - BITS)).astype(np.int64) for s, e, _ in found])
    shape = []
    for kind, (s, e, _) in enumerate(found):
        size = np.minimum(np.log2(np.maximum(e - s, 1)).astype(np.int64) * 2 + ((e - s) % 2), 9)
        capital = lambda at: (data[at] >= 65) & (data[at] <= 90)
        case = capital(s) * 1 + capital(np.maximum(e - 1, 0)) * 2 if len(s) else np.zeros(0, np.int64)
        shape.append(kind * 40 + (case * 10 + size if kind == 0 else size))
    starts = np.concatenate([s for s, _, _ in found])
    order = np.argsort(starts, kind="stable")
    return bucket[order], np.concatenate(shape)[order], np.searchsorted(starts[order], offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two places and two signs of each bucket's and shape's index vector."""
    h = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    places = np.stack([h % np.uint64(DIM), (h >> np.uint64(8)) % np.uint64(DIM)], 1).astype(np.int64)
    signs = np.stack([(h >> np.uint64(40)) & np.uint64(1), (h >> np.uint64(41)) & np.uint64(1)], 1).astype(np.float64) * 2 - 1
    return places, signs


def _contexts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Sums of neighbours' index vectors for every bucket and shape."""
    release_encoders()
    places, signs = index_vectors()
    sums = np.zeros(ROWS * DIM)
    for whole in batches:
        for batch in blocks(whole, "text", 2 << 20):
            bucket, shape, first = _tokens(batch)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            shape = shape + (1 << BITS)
            for d in range(1, REACH + 1):
                same = row[d:] == row[:-d]
                for a, b in ((bucket[:-d][same], bucket[d:][same]), (bucket[d:][same], bucket[:-d][same]), (shape[:-d][same], shape[d:][same]), (shape[d:][same], shape[:-d][same])):
                    for k in range(2):
                        sums += np.bincount(a * DIM + places[b, k], signs[b, k], minlength=ROWS * DIM)
    return sums


def word_vectors(sums: np.ndarray) -> np.ndarray:
    v = sums.reshape(ROWS, DIM)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    v = v / np.maximum(size, 1e-9)
    used = size[:, 0] > 0
    return np.where(used[:, None], v - (v[used].mean(0) if used.any() else 0), 0).astype(np.float32)


def _pooled(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    bucket, shape, first = _tokens(batch)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)

    def mean(index: np.ndarray, of: np.ndarray, count: np.ndarray) -> np.ndarray:
        out = np.zeros((len(n), DIM))
        edges = np.searchsorted(of, np.arange(len(n) + 1))
        for i in np.flatnonzero(count):
            out[i] = vectors[index[edges[i] : edges[i + 1]]].mean(0)
        return out

    kinds = np.unique(row * (1 << BITS) + bucket)
    kind_row, kind_bucket = kinds >> BITS, kinds & ((1 << BITS) - 1)
    n_kinds = np.bincount(kind_row, minlength=len(n))
    share = lambda flag: np.bincount(row, flag, minlength=len(n)) / np.maximum(n, 1)
    same = np.concatenate([[False], (bucket[1:] == bucket[:-1]) & (row[1:] == row[:-1])]) if len(row) else np.zeros(0, bool)
    pair = bucket.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.roll(bucket, -1).astype(np.uint64)
    pairs = np.unique(np.stack([row.astype(np.uint64), pair], 1), axis=0)[:, 0] if len(row) else np.zeros(0)
    n_pairs = np.bincount(pairs.astype(np.int64), minlength=len(n))
    counts = np.stack([np.log1p(n), n_kinds / np.maximum(n, 1), np.log1p(n_kinds), n_pairs / np.maximum(n, 1), share(same), share(shape >= 80), share((shape >= 40) & (shape < 80)), share((shape >= 30) & (shape < 40)), (n == 0)], 1)
    return np.concatenate([mean(bucket, row, n), mean(kind_bucket, kind_row, n_kinds), mean(shape + (1 << BITS), row, n), counts], 1).astype(np.float32)


class Network:
    """relu(x W1 + b1) W2 + b2 over standardised features, with a temperature."""

    def __init__(self, n_in: int, hidden: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, n_in**-0.5, (n_in, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(n_in), np.ones(n_in), 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> None:
        rng = np.random.default_rng(5)
        order = rng.permutation(len(y))
        back, on = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[on].mean(0), x[on].std(0) + 1e-4
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        z = (x - self.mean) / self.scale
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(on), max(1, len(on) // 128)):
                w1, b1, w2, b2 = self.p
                h = np.maximum(z[part] @ w1 + b1, 0)
                d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30))) - y[part]) / len(part)
                dh = np.outer(d, w2) * (h > 0)
                grads = [z[part].T @ dh + decay * w1, dh.sum(0), h.T @ d + decay * w2, np.array([d.sum()])]
                t += 1
                step = rate * (1 - epoch / epochs)
                for p, g, a, b in zip(self.p, grads, m, v, strict=True):
                    a[:] = 0.9 * a + 0.1 * g
                    b[:] = 0.999 * b + 0.001 * g * g
                    p -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        if len(back):
            logits = self.logit(x[back])
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
            loss = [np.logaddexp(0, np.where(y[back] == 1, -1, 1) * logits / s).mean() for s in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                x = _pooled(batch, vectors.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    return run


def _score(vectors, network, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                p = network.value.probability(_pooled(batch, vectors.value)) if network.value else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(p)], names=[*batch.schema.names, column])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 3, held: int = 1, most: int = 20_000, hidden: int = 32):
    """Broadcast word vectors (counted over all documents) and the network, learnt from at most `most` labelled rows."""
    spark = docs.sparkSession
    sums = total(docs.select("text").mapInArrow(array_sums(_contexts), KIND), ROWS * DIM)
    vectors = spark.sparkContext.broadcast(word_vectors(sums))
    sample = F.broadcast(labelled_sample(labels, label, divisor, held, most))
    found = docs.select("doc_id", "text").join(sample, "doc_id").mapInArrow(_features(vectors), "doc_id bigint, label int, x binary")
    # one row of each sampled id, however often it is repeated
    got = found.groupBy("doc_id").agg(F.first("label"), F.min("x")).select("first(label)", "min(x)").collect()
    network = None
    if got:
        x, y = np.array([np.frombuffer(r[1], np.float32) for r in got], np.float64), np.array([r[0] for r in got], float)
        order = np.lexsort([*x.T[:8], y])  # the same whatever order the rows arrived in
        network = Network(x.shape[1], hidden)
        network.fit(x[order], y[order])
    return vectors, spark.sparkContext.broadcast(network)


def scored(docs: DataFrame, labels: DataFrame, column: str = "score", **parameters) -> DataFrame:
    """docs and `column`, the probability of label 1; docs may not have such a column."""
    if column in docs.columns:
        raise ValueError(f"there is a column {column} already")
    vectors, network = train(docs, labels, **parameters)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score(vectors, network, column), f"{kind}, `{column}` double")


def score(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs.select("doc_id", "text"), labels, **parameters)
    divisor, held = parameters.get("divisor", 3), parameters.get("held", 1)
    return out.select("doc_id", F.coalesce(remainder(divisor) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **parameters) -> DataFrame:
    """Rows whose score reaches the threshold, as they are; any columns may be there beside doc_id and text.

    Null and empty texts are scored as texts without tokens; an empty labels table rejects nothing at 0.5.
    """
    own = free_name("score", docs.columns)
    return scored(docs, labels, own, **parameters).where(F.col(own) >= threshold).select(*docs.columns)
