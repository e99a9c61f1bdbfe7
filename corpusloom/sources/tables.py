"""Tables kept between jobs in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a session on one machine, as in tests, that has none gets a folder of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = _own[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a written table, which cuts their lineage and lets what follows read only the columns it needs."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def numbered(frame: DataFrame, *order: str, name: str = "line") -> DataFrame:
    """Rows with their number from 1 in this order, which may be of any length.

    They are sorted in ranges and numbered within them; the driver adds up the ranges' sizes.
    """
    spark = frame.sparkSession
    rows = kept(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", 33)  # the upper bits are the range, the lower ones the place in it
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = [(r["part"], sum(s["n"] for s in sizes[:i])) for i, r in enumerate(sizes)]
    known = F.broadcast(spark.createDataFrame(starts, "_part bigint, _before bigint"))  # two numbers for each range
    return rows.join(known, part == F.col("_part")).select(*frame.columns, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
