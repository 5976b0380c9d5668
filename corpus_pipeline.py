"""The corpus pipeline: language, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Documents that the language stage calls ``und``, or finds hardly any known n-gram in, go; one document of each
near-duplicate group stays; documents with a benchmark passage go; the mix repeats or drops documents; the last stage
adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queryvitals.llm import decontaminate, kernel, language, minhash, mixing, sharding

#: Share of a text's n-grams that its language must contain. Text of a learned language has 0.6 and more.
MIN_LANGUAGE_SCORE = 0.3
MIX_WEIGHTS = [5, 2, 1]
SHARDS = 16


def _whole(docs: DataFrame) -> Column:
    """The row as one column, so that a caller's columns keep their values under any name."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _opened(rows: DataFrame, docs: DataFrame, row: str = "row") -> DataFrame:
    return rows.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = language.fit(docs.where(language.fold_of() != 0))
    judged = language.predict(docs.select(_whole(docs), "text"), filters)
    return _opened(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one id and text, which are one document, the row whose other columns come first as JSON stays."""
    found = minhash.near_duplicates(docs)
    keepers = found.where("keeper").select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none"), "th").distinct()
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    rows = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("th"), _whole(docs), others.alias("others"))
    kept = rows.join(keepers, ["id", "none", "th"], "left_semi").groupBy("id", "none", "th").agg(F.min_by("row", "others").alias("row"))
    return _opened(kept, docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # The whole row is the index's document id, so nothing is joined back.
    found = decontaminate.index_and_search(docs.select(_whole(docs), "text"), items, id_col="row")
    return _opened(found.where(F.size("items") == 0), docs, "id")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(_whole(docs), "doc_id", "source", "text"), MIX_WEIGHTS, columns=["row"])
    return _opened(mixing.repeated(mixed), docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: The learned language filters and the seeded permutations are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = kernel.checkpoint(docs)
    return docs
