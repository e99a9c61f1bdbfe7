"""Tables kept between jobs in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset on one machine, as in tests, a new one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_own: list[str] = []


def _own_folder() -> str:
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _own[0]


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores before it while a column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it, which cuts its lineage."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Delete the files of a kept table."""
    spark = frame.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids that are marked in a broadcast bit map at most; eight bits for each, so 4 MB of bits in 2**19 rows of two numbers.
MOST_MARKED = 1 << 22


def with_mark(frame: DataFrame, key: str, ids: DataFrame, mark: str) -> DataFrame:
    """Adds whether a row's key may be among `ids` (one column); it is true for all that are.

    Up to MOST_MARKED ids are marked in a bit map, whose size is so bounded, and
    the rows are not shuffled; an exact join follows where exactness matters. More
    ids are joined themselves. A null key has no mark.
    """
    column = ids.columns[0]
    n = ids.agg(F.approx_count_distinct(column)).first()[0]
    if n > MOST_MARKED:
        own = ids.select(F.col(column).alias(key), F.lit(True).alias(mark)).distinct()
        return frame.join(own, key, "left").select(*frame.columns, F.coalesce(mark, F.lit(False)).alias(mark))
    bits = max(12, (8 * n - 1).bit_length())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    marks = (
        ids.select(slot(F.col(column)).alias("_slot"))
        .groupBy(F.shiftright("_slot", 6).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_slot & 63 as int)))").alias("_bits"))
    )
    hit = F.expr("coalesce((shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1) = 1, false)") & F.col(key).isNotNull()
    return frame.withColumn("_slot", slot(F.col(key))).withColumn("_word", F.shiftright("_slot", 6)).join(F.broadcast(marks), "_word", "left").withColumn(mark, hit).drop("_slot", "_word", "_bits")


def only_marked(frame: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of frame whose key may be among `ids`, and all that are."""
    return with_mark(frame, key, ids, "_mark").where("_mark").drop("_mark")
