"""Corpus pipeline: five stages over `documents`, each of one operator of corpusloom.llm.

All but the last return the columns they are given, whatever their names. Null and
empty texts and repeated rows are rows like others; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, jaccard_join, packing, passages, quality
from corpusloom.llm.shared import keep


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from `labels` on the given documents, doesn't reject.

    Null and empty texts are scored as texts without tokens; repeated rows are each scored.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id, that links of 80 % of five-word shingles connect.

    Null and empty texts and rows without an id stay; so do all rows of a kept id.
    """
    return jaccard_join.keep_one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a document of a smaller id holds.

    A document of which no word is left goes; null and empty texts and rows without an id stay.
    """
    return passages.remove_repeats(docs)


def cut_benchmark_phrases(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items.

    A document of which no word is left goes; null and empty texts stay.
    """
    return decontaminate.remove_phrases(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and the sequence each is in; null and empty texts are one id, repeated rows documents of their own."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("n-gram Jaccard join", join_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", cut_benchmark_phrases),
    ("best-fit packing", pack_sequences),
]

#: The stages are learnt models and hash-ordered searches, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
