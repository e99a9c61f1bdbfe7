"""Corpus building: length and quality filters, exact deduplication, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def quality_reason(text: Column, min_alpha: float = 0.45, max_digit: float = 0.45, max_repeat: float = 0.5, patterns: dict | None = None) -> Column:
    """Why a text is dropped: the first rule that applies, or ''.

    patterns: by reason (such as url_pattern), a column and the patterns that must not be
    found in it; they come before the other rules, in their order.
    """
    found = F.coalesce(text, F.lit(""))
    count = lambda other: F.length(F.regexp_replace(found, other, ""))

    def by_shares(dense: Column) -> Column:
        return (
            F.when(dense == 0, "empty")
            .when(count(r"[^\p{L}]+") / dense < min_alpha, "low_alpha_ratio")
            .when(count(r"[^\p{Nd}]+") / dense > max_digit, "high_digit_ratio")
            .when(T.repeat_line_ratio(found) > max_repeat, "repeat_lines")
            .otherwise("")
        )

    reason = T.let(T.dense_length(found), by_shares)
    for name, (column, some) in reversed(list((patterns or {}).items())):
        reason = F.when(T.matches_any(column, some), name).otherwise(reason)
    return reason


def _text_key(c: Column) -> Column:
    return F.sha2(F.encode(F.lower(T.normalize_whitespace(c)), "UTF-8"), 256)


def dedupe_exact(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each lower-cased, white-space-normalised text.

    Only hashes and orders are grouped, with partial sums, so a text of very many
    copies is no hot group; the kept orders then join the rows.
    """
    first = docs.select(F.col(order), _text_key(F.col(text)).alias("_key")).groupBy("_key").agg(F.min(order).alias(order)).select(order)
    return docs.join(first, order, "left_semi")


def build_corpus(docs: DataFrame, min_chars: int = 100, order: str = "doc_id", **quality) -> DataFrame:
    """Rows, by their unique `order`, that are long enough, of good quality, and the first of their text.

    The rules are worked out once, on a table of orders and hashes, which then joins the rows.
    """
    key = T.let(T.strip(F.col("text")), lambda t: F.when((F.length(t) >= min_chars) & (quality_reason(t, **quality) == ""), _text_key(t)))
    first = docs.select(F.col(order), key.alias("_key")).where("_key is not null").groupBy("_key").agg(F.min(order).alias(order)).select(order)
    return docs.join(first, order, "left_semi").withColumn("text", T.strip(F.col("text")))


def fixed_chunks(docs: DataFrame, size: int = 250, overlap: int = 50, least: int = 20) -> DataFrame:
    """doc_id, chunk_index, text: windows of `size` words, each `overlap` words into the one before.

    A last window of fewer than `least` words is appended, overlap included, to the one before it.
    """
    step = max(1, size - min(overlap, size - 1))
    w = docs.select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.greatest(F.ceil((F.size("w") - size) / F.lit(step)), F.lit(0)).cast("int") + 1)
    w = w.withColumn("tail", F.size("w") - (F.col("n") - 1) * step)
    w = w.withColumn("merged", (F.col("n") > 1) & (F.col("tail") < least))
    piece = lambda i: F.array_join(F.slice("w", (i * step + 1).cast("int"), F.lit(size)), " ")
    rows = w.select("doc_id", "w", "n", "merged", F.explode(F.sequence(F.lit(0), F.when(F.col("merged"), F.col("n") - 2).otherwise(F.col("n") - 1))).alias("chunk_index"))
    last = F.col("merged") & (F.col("chunk_index") == F.col("n") - 2)
    body = F.when(last, F.concat_ws(" ", piece(F.col("chunk_index")), piece(F.col("chunk_index") + 1))).otherwise(piece(F.col("chunk_index")))
    return rows.select("doc_id", "chunk_index", body.alias("text"))


def sentence_chunks(docs: DataFrame, size: int = 250, overlap: int = 50, least: int = 20) -> DataFrame:
    """doc_id, chunk_index, text: whole sentences packed up to `size` words.

    Paragraphs of up to `size` words are units, longer ones give their sentences.
    A full chunk is closed and its last `overlap` words open the next one.
    """
    paragraphs = F.filter(F.transform(F.split(T.strip(F.col("text")), "\n\n"), T.strip), lambda p: p != "")
    # each unit as its words; a long paragraph gives its sentences
    units = F.flatten(F.transform(paragraphs, lambda p: T.let(T.words(p), lambda w: F.when(F.size(w) <= size, F.array(w)).otherwise(F.transform(T.sentences(p), T.words)))))
    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def add(acc, n):
        """The open chunk is the words from first to last; a full one is closed and the next begins `overlap` words before its end."""
        full = (acc["last"] > acc["first"]) & (acc["last"] - acc["first"] + n > size)
        done = F.when(full, F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))).otherwise(acc["done"])
        first = F.when(full, F.greatest(acc["first"], acc["last"] - overlap)).otherwise(acc["first"])
        return F.struct(done.alias("done"), first.alias("first"), (acc["last"] + n).alias("last"))

    def close(acc):
        return F.when(acc["last"] > acc["first"], F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))).otherwise(acc["done"])

    def texts(w, spans):
        text = lambda a, b: F.array_join(F.slice(w, a["first"] + 1, b["last"] - a["first"]), " ")
        whole = F.transform(spans, lambda x: text(x, x))
        n, end, before = F.size(spans), F.element_at(spans, -1), F.get(spans, F.size(spans) - 2)
        short = (n >= 2) & (end["last"] - end["first"] < least)
        return F.when(short, F.concat(F.transform(F.slice(spans, 1, F.greatest(n - 2, F.lit(0))), lambda x: text(x, x)), F.array(F.concat_ws(" ", text(before, before), text(end, end))))).otherwise(whole)

    # every intermediate array is bound once
    chunks = T.let(units, lambda u: T.let(F.flatten(u), lambda w: T.let(F.aggregate(F.transform(u, F.size), start, add, close), lambda spans: texts(w, spans))))
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk_index", "text"))


def emit_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with identity and place: chunk_id, start_char, end_char, metadata and the document's columns.

    A chunk's place is where its text is found in the document's after the start of the
    last chunk that was found; texts joined anew by spaces are often not found, and null.
    docs: doc_id (unique), text and, where they are there, title, source_path, source_url,
    doc_type, metadata (a map, whose entries win).
    """
    pieces = chunks.withColumn("text", T.strip(F.col("text"))).where("text <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(1).alias("cursor"))

    def find(acc, piece):
        return T.let(F.position(piece["text"], F.col("whole"), acc["cursor"]), lambda at: F.struct(F.concat(acc["at"], F.array(at)).alias("at"), F.when(at > 0, at + 1).otherwise(acc["cursor"]).alias("cursor")))

    meta = F.create_map(F.lit("doc_type"), F.col("doc_type") if "doc_type" in docs.columns else F.lit(None).cast("string"))
    if "metadata" in docs.columns:
        own = F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        meta = F.map_concat(F.map_filter(meta, lambda k, v: ~F.map_contains_key(own, k)), own)
    carried = [c for c in ("title", "source_path", "source_url") if c in docs.columns]
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole"), *carried, meta.alias("metadata"))
    rows = whole.join(pieces, "doc_id").withColumn("at", F.aggregate("c", start, find, lambda acc: acc["at"]))
    each = rows.select("doc_id", *carried, "metadata", F.explode(F.arrays_zip("c", "at")).alias("z"))
    text, at = F.col("z.c.text"), F.col("z.at")
    return each.select(T.chunk_id(F.col("doc_id"), F.col("z.c.chunk_index"), text).alias("chunk_id"), "doc_id", F.col("z.c.chunk_index").alias("chunk_index"), text.alias("text"), F.when(at > 0, at - 1).alias("start_char"), F.when(at > 0, at - 1 + F.length(text)).alias("end_char"), *carried, "metadata")
