"""Incremental ingest: documents that arrive as files, kept so that a corpus can be read at any time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus
from ..sources.tables import entries


def ingest(spark: SparkSession, arriving: DataFrame, path: str, after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Take what has arrived since the last call of a streamed table into the folder, then end.

    Each micro-batch is written to a folder of its own number, in place of what a failed attempt
    left there, so a run after a failure loses and repeats nothing. `after` is called with each batch's rows and
    number once they are written, for an index that takes changes; it may see a batch twice.
    """

    def keep(batch: DataFrame, number: int) -> None:
        target = f"{path}/batches/batch={number}"
        batch.write.mode("overwrite").parquet(target)
        if after:
            after(spark.read.schema(batch.schema).parquet(target), number)

    writer = arriving.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/progress")
    writer.foreachBatch(keep).start().awaitTermination()


def current(spark: SparkSession, path: str, schema: str, key: str = "doc_id") -> DataFrame:
    """The last row of each key, of those batches that are written in full; `rank` decides between a batch's rows of a key, if there is such a column."""
    done = [b for b in entries(spark, f"{path}/batches") if "_SUCCESS" in entries(spark, f"{path}/batches/{b}")]
    if not done:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{path}/batches").parquet(*(f"{path}/batches/{b}" for b in done))
    order = [F.desc("batch"), *([F.desc("rank")] if "rank" in rows.columns else [])]
    last = rows.withColumn("_o", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_o = 1")
    return last.drop("_o", "batch")


def current_corpus(spark: SparkSession, path: str, schema: str, **rules) -> DataFrame:
    """The corpus of what is current: long enough, of good quality, the first of each text. Of a text whose first document has changed the next one takes its place."""
    return corpus.build_corpus(current(spark, path, schema), **rules)
