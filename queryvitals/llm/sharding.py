"""Two-pass external shuffle into shards.

Pass one scatters records uniformly, by a seeded hash, into buckets that fit in memory. Pass two sorts each bucket by
that hash (so that the order of arrival does not matter), shuffles it with a seeded Fisher-Yates permutation, and
writes it. Buckets lie one after the other, so bucket sizes alone give every record its global place; place modulo the
number of shards is its shard, and the quotient its slot. Law ``rows``: counts of shards differ by one at most.

The hash covers id and text. Buckets that still come out several times too large (very many equal rows) are split by
row number; among equal rows it does not matter which goes where. The number of buckets grows with the input.

Defined cases: null ids and texts are records like all others; repeated rows are separate records; fewer records than
shards leave the last shards empty; an empty table gives no rows; other columns travel along, and columns named
``shard`` or ``slot`` are replaced; names that start with two underscores are the operator's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryvitals.llm import kernel as K

BUCKET_BYTES = 16 << 20


def shard(docs: DataFrame, shards: int = 16, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with shard (int) and slot (long), shuffled."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    # The row travels as one column, so that no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__of"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("__h"), F.monotonically_increasing_id().alias("__row"), (F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)) + 64).alias("__size"))
    buckets = K.bucket_count(docs, bucket_bytes, text_col)
    rows = rows.withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    # Sizes of the buckets; the few that are far too large get sub-buckets by row number.
    sizes = K.checkpoint(rows.groupBy("__bucket").agg(F.count("*").alias("__n"), F.sum("__size").alias("__bytes")))
    rows = rows.drop("__size")
    large = {r["__bucket"]: int(r["__bytes"] // (8 * bucket_bytes)) + 1 for r in sizes.where(F.col("__bytes") > 8 * bucket_bytes).collect()}
    if large:
        # Written once: the row numbers that split a bucket must be those that are counted.
        rows = K.checkpoint(rows)
        parts = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("__bucket")], F.lit(1))
        rows = rows.withColumn("__part", F.pmod(F.xxhash64("__row", F.lit(seed)), parts).cast("int"))
        sizes = rows.groupBy("__bucket", "__part").agg(F.count("*").alias("__n"))
    else:
        rows = rows.withColumn("__part", F.lit(0))
        sizes = sizes.select("__bucket", F.lit(0).alias("__part"), "__n")
    # One row per bucket: 64 runs of buckets are summed first, so no task orders more than its share of them.
    run = F.floor(F.col("__bucket") / max(1, buckets // 64))
    runs = sizes.groupBy(run.alias("__run")).agg(F.sum("__n").alias("__n"))
    runs = runs.select("__run", (F.sum("__n").over(Window.orderBy("__run")) - F.col("__n")).alias("__base"))
    inside = Window.partitionBy(run).orderBy("__bucket", "__part")
    starts = sizes.withColumn("__run", run).withColumn("__in", F.sum("__n").over(inside) - F.col("__n"))
    starts = K.checkpoint(starts.join(runs, "__run").select("__bucket", "__part", (F.col("__base") + F.col("__in")).alias("__start")))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def permute(table: pa.Table) -> pa.Table:
        bucket, part, start = (table.column(c)[0].as_py() for c in ("__bucket", "__part", "__start"))
        order = pc.sort_indices(table, sort_keys=[("__h", "ascending"), ("__row", "ascending")]).to_numpy()
        order = np.random.default_rng([seed, bucket, part]).permutation(order)  # Fisher-Yates
        place = start + np.arange(len(order))
        kept = table.column("__of").take(pa.array(order)).combine_chunks()
        return pa.table([*kept.flatten(), pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], names=[*names, "shard", "slot"])

    joined = rows.join(F.broadcast(starts), ["__bucket", "__part"]) if buckets <= 1 << 16 else rows.join(starts, ["__bucket", "__part"])
    return joined.groupBy("__bucket", "__part").applyInArrow(permute, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Files by shard, rows in order of slot."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op3_shard(spark, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
