"""Sessions of a search log: a new one starts where the gap to the search before is above a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 1800


def sessionize(log: DataFrame, time: str = "ts", order: str = "id", gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """``log`` with session_no (from 1) and session_id over the whole log, which has no user."""
    return _numbered(log, [], time, order, gap_seconds).withColumn("session_id", F.concat(F.lit("s"), _padded("session_no")))


def sessionize_by(log: DataFrame, key: str, time: str = "ts", order: str = "id", gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """``log`` with session_no (from 1) within each ``key``; rows without a key are one more."""
    return _numbered(log, [key], time, order, gap_seconds)


def _numbered(log: DataFrame, keys: list[str], time: str, order: str, gap_seconds: int) -> DataFrame:
    """One window over the log, or over a key that makes a third of it, would be one task. Instead each key's log is cut into
    buckets of a gap's length: the search before a bucket's first one is the last of the nearest earlier bucket that
    is not empty. Buckets are few rows (one per half hour and key), and session numbers are a local count plus the
    count of the buckets before."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    # A key that is null joins like any other value.
    own = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)] + [F.col(k).isNull().alias(f"_n{i}") for i, k in enumerate(keys)]
    by = [f"_{x}{i}" for x in "kn" for i in range(len(keys))]
    rows = log.select("*", *own, micros.alias("_t")).withColumn("_bucket", F.floor(F.col("_t") / (gap_seconds * 1_000_000)))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_t", order)
    over = Window.partitionBy(*by).orderBy("_bucket")
    rows = rows.withColumn("_before", F.lag("_t").over(inside)).withColumn("_rank", F.row_number().over(inside))
    buckets = rows.groupBy(*by, "_bucket").agg(F.max("_t").alias("_last"))
    buckets = buckets.withColumn("_came", F.lag("_last").over(over)).drop("_last")
    rows = rows.join(buckets, [*by, "_bucket"])
    before = F.when(F.col("_rank") == 1, F.col("_came")).otherwise(F.col("_before"))
    rows = rows.withColumn("_new", F.coalesce((F.col("_t") - before > gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    starts = rows.groupBy(*by, "_bucket").agg(F.sum("_new").alias("_n"))
    starts = starts.select(*by, "_bucket", (F.sum("_n").over(over) - F.col("_n")).alias("_base"))
    local = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("_local", local).join(starts, [*by, "_bucket"])
    return out.select(*[F.col(f"`{c}`") for c in log.columns], (F.col("_base") + F.col("_local")).alias("session_no"))


def _padded(number: str):
    n = F.col(number).cast("string")
    return F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)
