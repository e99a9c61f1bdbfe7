"""From questions to the contexts their answers are read from, for all questions and their variants in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import questions as Q
from ..sources.tables import kept
from . import retrieval as R

Search = Callable[[DataFrame, int], DataFrame]
ORIGINAL = "original_query"


def variants(questions: DataFrame, augment: int = 2, rewrite: int = 2) -> DataFrame:
    """query_id, list_no, query_variant, text: the question as list 0, then its augmentations and rewrites without repetitions.

    questions: query_id, question. augment and rewrite are the most there are of each, 0 for none.
    """
    own = questions.select("query_id", F.lit(0).alias("list_no"), F.lit(ORIGINAL).alias("query_variant"), F.col("question").alias("text"))
    found = [f(F.col("question"), n) for f, n in ((Q.augmentations, augment), (Q.rewrites, rewrite)) if n]
    if not found:
        return own
    others = R.distinct_variants(questions.select("query_id", F.posexplode(F.concat(*found)).alias("place", "variant")))
    return own.unionByName(others.select("query_id", F.col("place").alias("list_no"), F.concat(F.lit("augmented_query:"), "variant").alias("query_variant"), F.col("variant").alias("text")))


def search_in(docs: DataFrame, vectors: DataFrame | None = None, mode: str = "sparse", fetch: int = 120, method: str = "rrf") -> Search:
    """A search over docs (doc_id, text) and vectors (doc_id, embedding) in one of retrieve's modes."""
    return lambda queries, k: R.bm25_topk(docs, queries, k) if mode == "sparse" else R.retrieve(docs, vectors, queries, mode, k, fetch, method)


def retrieve_variants(questions: DataFrame, search: Search, k: int = 10, augment: int = 2, rewrite: int = 2, embeddings: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank of each question's list merged with those of its variants; its own first three stay in front.

    One search ranks all variants of all questions. embeddings: query_id, embedding, where a search needs them;
    a question's variants share its own. query_id is a whole number.
    """
    lists = 1 + augment + rewrite
    asked = variants(questions, augment, rewrite).select((F.col("query_id") * lists + F.col("list_no")).alias("query_id"), "text")
    if embeddings is not None:
        asked = asked.join(embeddings.select(F.col("query_id").alias("_of"), "embedding"), F.expr(f"query_id div {lists}") == F.col("_of")).drop("_of")
    found = search(asked, k).select(F.expr(f"query_id div {lists}").alias("query_id"), F.pmod("query_id", F.lit(lists)).cast("int").alias("list_no"), "doc_id", "score", "rank")
    found = kept(found, "ranked")
    return R.preserve_primary(found.where("list_no = 0").drop("list_no"), R.merge_lists(found, k), min(3, max(1, k)), k)


def answer_ranking(chunks: DataFrame, questions: DataFrame, search: Search, k: int = 10, augment: int = 2, rewrite: int = 2, cap: int | None = 2, embeddings: DataFrame | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ranked chunks of each question: retrieved, shaped by the question's terms, ranked anew where `rerank` is given, and at most `cap` of a document before others.

    chunks: chunk_id, doc_id, chunk_index, text and, where they are there, title, source_url and
    source_path. questions: query_id, question. search finds chunk_ids, as doc_id.
    """
    found = retrieve_variants(questions, search, k, augment, rewrite, embeddings).withColumnRenamed("doc_id", "chunk_id")
    ranked = R.shape_scores(found.join(chunks, "chunk_id").join(questions, "query_id"))
    if rerank:
        ranked = rerank(ranked).where(F.col("rank") <= k)
    if cap:
        part = lambda name, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(name), F.col(c).cast("string"))) if c in ranked.columns else F.lit(None).cast("string")
        group = F.coalesce(part("doc:", "doc_id"), part("path:", "source_path"), part("url:", "source_url"), part("chunk:", "chunk_id"))
        ranked = R.diversify(ranked.withColumn("doc_group", group), "doc_group", cap, k).drop("old_rank")
    return ranked


def answer_contexts(chunks: DataFrame, ranked: DataFrame, parents: bool = True, **parameters) -> DataFrame:
    """query_id, place, doc_id, first_chunk, last_chunk, text that a reader is given for each question. parents: found chunks with their neighbours, where a document has several."""
    if parents:
        return R.parent_contexts(ranked.select("query_id", "doc_id", "chunk_index", "score", "rank"), chunks.select("doc_id", "chunk_index", "text"), **parameters)
    place = F.col("chunk_index")
    return ranked.select("query_id", F.col("rank").alias("place"), "doc_id", place.alias("first_chunk"), place.alias("last_chunk"), "text")


def answer_requests(questions: DataFrame, contexts: DataFrame, about: DataFrame | None = None, budget: int = 5000, subject: str = "the given documents") -> DataFrame:
    """query_id, system, user: what a reader is asked for each question; one without contexts is asked without.

    about: doc_id and, where they are there, title and source_url for the headers of contexts.
    """
    rows = contexts.withColumnRenamed("place", "rank")
    rows = rows.join(about, "doc_id", "left") if about is not None else rows
    blocks = R.context_blocks(rows, budget)
    return questions.join(blocks, "query_id", "left").select("query_id", F.lit(P.answer_system(subject)).alias("system"), P.answer_user(F.col("question"), F.col("context")).alias("user"))
