"""Corrections for single-word queries that name no product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryvitals.functions import text as T
from queryvitals.operators import catalog as C

MIN_CONFIDENCE = 0.45
FULL_SUPPORT = 300


def query_frequencies(events: DataFrame, query_count: DataFrame) -> DataFrame:
    """(norm_query, searches): logged searches, or the largest lifetime counter of any spelling if that is more."""
    logged = events.groupBy("norm_query").agg(F.count("*").alias("_a"))
    counted = query_count.groupBy("norm_query").agg(F.max("count").alias("_b"))
    both = logged.join(counted, "norm_query", "full_outer")
    return both.select("norm_query", F.greatest(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))).alias("searches"))


def confidence(distance: Column, support: Column, observed: Column) -> Column:
    """Ceiling by distance, scaled by the logarithm of support, and a margin if shoppers made the same correction."""
    base = F.when(distance == 1, 0.90).when(distance == 2, 0.72).otherwise(0.5)
    share = F.least(F.lit(1.0), F.log10(F.greatest(support, F.lit(1)) + 1) / F.log10(F.lit(FULL_SUPPORT + 1.0)))
    score = base * (0.6 + 0.4 * share) + F.when(observed > 0, 0.05).otherwise(0.0)
    return T.round_even(F.least(score, F.lit(0.99)), 3)


def spelling_candidates(frequencies: DataFrame, corrections: DataFrame, shop, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(kind, source_term, target_term, lang, confidence, searches, edit_distance, target_product_count, self_corrections)."""
    single = frequencies.where((F.col("norm_query") != "") & ~F.contains("norm_query", F.lit(" ")))
    unknown = C.coverage(single.withColumnRenamed("norm_query", "term").select("term"), shop.vocabulary).where("coverage = 0").drop("coverage")
    near = C.nearest_terms(unknown, shop.vocabulary, near_by=shop.reach).where("distance > 0")
    out = near.join(single.withColumnRenamed("norm_query", "term"), "term")
    seen = corrections.select(F.col("source").alias("term"), F.col("target").alias("match"), F.col("observations").alias("_seen"))
    out = out.join(seen, ["term", "match"], "left").withColumn("self_corrections", F.coalesce("_seen", F.lit(0)))
    out = out.select(
        F.when(T.is_prefix_of("term", "match"), "partial_query").otherwise("misspelling").alias("kind"),
        F.col("term").alias("source_term"),
        F.col("match").alias("target_term"),
        F.col("match_lang").alias("lang"),
        confidence(F.col("distance"), F.col("support"), F.col("self_corrections")).alias("confidence"),
        "searches",
        F.col("distance").alias("edit_distance"),
        F.col("support").alias("target_product_count"),
        "self_corrections",
    )
    return out.where(F.col("confidence") >= min_confidence)


def ordered(found: DataFrame) -> DataFrame:
    """The order in which corrections are reported: surest first, then the most searched, then by their terms."""
    return found.orderBy(F.desc("confidence"), F.desc("searches"), "source_term", "target_term")


def as_candidates(found: DataFrame) -> DataFrame:
    """The queue's form: kind, source_term, target_term, lang, confidence, rationale, evidence (JSON)."""
    n = F.format_number("target_product_count", 0)
    why = F.when(
        F.col("kind") == "partial_query", F.concat(T.isolate("source_term"), F.lit(" is no catalogue word but begins "), T.isolate("target_term"), F.lit(", which "), n, F.lit(" products use."))
    ).otherwise(F.concat(T.isolate("source_term"), F.lit(" names no product; "), T.isolate("target_term"), F.lit(" is "), F.col("edit_distance").cast("string"), F.lit(" edits away and names "), n, F.lit(" products.")))
    again = F.when(F.col("self_corrections") > 0, F.concat(F.lit(" Shoppers re-typed it so "), F.col("self_corrections").cast("string"), F.lit(" times."))).otherwise("")
    evidence = F.to_json(F.struct("searches", "edit_distance", "target_product_count", F.lit(0).alias("source_product_count"), F.col("self_corrections").alias("self_corrections_observed")))
    return found.select("kind", "source_term", "target_term", "lang", "confidence", F.concat(why, again).alias("rationale"), evidence.alias("evidence"))
