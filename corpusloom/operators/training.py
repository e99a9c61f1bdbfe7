"""Preparation of training rows: examples, splits, label masks, checks and padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import numbered

IGNORED = -100


def join_references(questions: DataFrame, references: DataFrame) -> DataFrame:
    """line, question, answer: the answer whose key is the question's number; empty ones are dropped.

    questions: ord, question, of which empty ones aren't counted; references: key, answer.
    """
    rows = questions.select("ord", T.strip(F.col("question")).alias("question")).where("question <> ''")
    lines = numbered(rows, "ord").select(F.col("line").cast("int").alias("line"), "question")
    answers = references.select(F.col("key").cast("string").alias("key"), T.strip(F.col("answer")).alias("answer")).where("answer <> ''")
    return lines.join(answers, F.col("line").cast("string") == F.col("key")).select("line", "question", "answer")


def nth_smallest(rows: DataFrame, n: int) -> tuple[int, int]:
    """The n-th smallest (from 1) of a bigint column `h`, and how many rows of that value are among the n smallest.

    Found digit by digit, of 16 bits each, by counts of at most 2**16 groups; no row is sorted or gathered.
    """
    known, value = F.lit(True), 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("h", shift)  # the first digit has the sign
        digit = digit if shift == 48 else digit.bitwiseAND(F.lit(0xFFFF))
        for d, count in sorted(rows.where(known).groupBy(digit.alias("d")).count().collect()):
            if n <= count:
                break
            n -= count
        value = d if shift == 48 else (value << 16) + d
        known = F.shiftright("h", shift) == value
    return value, n


def split_rows(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Rows with `eval`: true for floor(n * ratio) of them, ratio held to 0 to 0.5, those of the smallest hash of seed and key; rows of one key stay together."""
    ratio = min(0.5, max(0.0, ratio))
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    n = int(rows.count() * ratio)
    if not n:
        return rows.withColumn("eval", F.lit(False))
    value, left = nth_smallest(hashed.select(F.col("_h").alias("h")), n)
    chosen = F.col("_h") < value
    for k, count in sorted((tuple(r) for r in hashed.where(F.col("_h") == value).groupBy(key).count().collect()), key=lambda r: r[0]):  # keys of one hash
        if left <= 0:
            break
        chosen, left = chosen | ((F.col("_h") == value) & F.col(key).eqNullSafe(F.lit(k))), left - count
    return hashed.withColumn("eval", chosen).drop("_h")


def mask_prompt(rows: DataFrame, ids: str = "ids", prompt_len: str = "prompt_len") -> DataFrame:
    """Adds labels: the ids, with the first prompt_len of them ignored."""
    return rows.withColumn("labels", F.transform(ids, lambda x, i: F.when(i < F.col(prompt_len), F.lit(IGNORED)).otherwise(x)))


def drop_reason(vocab_size: int, ids: str = "ids", labels: str = "labels"):
    """Why a row can't be trained on, or '': an id or a label outside the vocabulary, or all labels ignored."""
    outside = lambda x: (x < 0) | (x >= vocab_size)
    return (
        F.when(F.exists(ids, outside), "bad_token")
        .when(F.exists(labels, lambda x: (x != IGNORED) & outside(x)), "bad_label")
        .when((F.size(labels) > 0) & F.forall(labels, lambda x: x == IGNORED), "all_ignored")
        .otherwise("")
    )


def number_batches(rows: DataFrame, key: str, size: int, buckets: int = 1024) -> DataFrame:
    """Rows with `batch`, a string; batches of `size` rows, one of each bucket of the keys' hashes may have fewer."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(key)) - 1
    return rows.withColumn("batch", F.concat_ws("-", bucket.cast("string"), F.floor(place / size).cast("string")))


def pad_batches(rows: DataFrame, batch: str, ids: str = "ids", pad_id: int = 0, labels: str | None = None) -> DataFrame:
    """Ids padded to the longest of their batch, with an attention mask, and labels padded with IGNORED where they are named."""
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("longest"))
    gap = F.col("longest") - F.size(ids)
    padded = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("int"), gap))
    new = {"mask": padded(F.array_repeat(F.lit(1), F.size(ids)), 0), ids: padded(ids, pad_id)}
    if labels:
        new[labels] = padded(labels, IGNORED)
    return rows.join(longest, batch).select(*(new.pop(c).alias(c) if c in new else c for c in rows.columns), "longest", *(v.alias(k) for k, v in list(new.items())))
