"""Stage borders: a table written once to the shared checkpoint folder and read by every branch after it.

A cached table repeats its whole plan in every plan above it, and is lost with its executors; a checkpoint is neither.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. A local session without one gets a folder of its own; on a cluster that is an error, since
    executors do not share a local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="queryvitals-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows from files by column in the same folder: who reads a few columns of a wide table reads no others, and
    the files' sizes tell what is small enough to be broadcast."""
    folder = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the given order. Rows are sorted over all tasks; only the counts of the tasks
    meet in one."""
    parts = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    place = F.shiftright("_at", 33).alias("_part")
    counts = parts.groupBy(place).agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.withColumn("_part", place).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_at", "_before")
