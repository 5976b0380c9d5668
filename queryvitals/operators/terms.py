"""Terms behind the searches: misspellings fold onto the catalogue word they aim at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.functions import text as T
from queryvitals.operators import catalog as C
from queryvitals.plans.stage import written

TERM_LIMIT = 25


def term_drivers(quality: DataFrame, shop) -> DataFrame:
    """One row per canonical term: searches, failing ones, spellings, severity, impact, coverage and verdict.

    A query with two words that fold onto one term counts twice there, once for each word.
    """
    words = quality.select("norm_query", "display_query", "searches", "is_problem", "severity", "impact", "retrieval_gap", F.explode(F.array_distinct(T.tokenize("norm_query"))).alias("token"))
    near = C.nearest_terms(words, shop.vocabulary, "token", shop.reach).select(F.col("term").alias("token"), F.col("match").alias("_canonical"))
    members = words.join(near, "token", "left").withColumn("term", F.coalesce("_canonical", "token"))
    n = F.sum("searches")
    out = members.groupBy("term").agg(
        n.alias("searches"),
        F.coalesce(F.sum(F.when(F.col("is_problem"), F.col("searches"))), F.lit(0)).alias("failing_searches"),
        F.count_distinct("token").alias("distinct_spellings"),
        F.sort_array(F.collect_set("display_query")).alias("spellings"),
        F.sort_array(F.collect_set(F.when(F.col("token") != F.col("term"), F.col("token")))).alias("misspellings"),
        (F.sum(F.col("severity") * F.col("searches")) / n).alias("x_severity"),
        T.round_even(F.sum("impact"), 4).alias("total_impact"),
        F.bool_or("retrieval_gap").alias("has_gap"),
    )
    out = written(out)  # one row per term, read by three lookups
    out = C.coverage(out.select("term"), shop.vocabulary).join(out, "term")
    ends = C.completions(out.where("coverage = 0"), shop.vocabulary, best=shop.best_completions)
    out = out.join(ends, "term", "left").withColumn("mean_severity", T.round_even(F.col("x_severity"), 3))
    verdict = (
        F.when((F.col("coverage") == 0) & F.col("completion").isNotNull(), "partial query")
        .when(F.col("coverage") == 0, "assortment gap")
        .when((F.size("misspellings") > 0) & F.col("has_gap"), "spelling")
        .when(F.col("has_gap"), "retrieval gap")
        .when(F.col("failing_searches") > 0, "relevance")
        .otherwise("healthy")
    )
    out = out.withColumn("verdict", verdict).withColumn("script", T.script_of("term"))
    return out.withColumn("headline", _headline())


def _headline():
    term = T.isolate("term")
    searches = F.concat(F.col("searches").cast("string"), F.when(F.col("searches") == 1, " search").otherwise(" searches"))
    return (
        F.when(F.col("verdict") == "partial query", F.concat(term, F.lit(" begins "), T.isolate("completion"), F.lit(" ("), F.format_number("completion_support", 0), F.lit(" products); "), searches, F.lit(" from shoppers still typing.")))
        .when(F.col("verdict") == "assortment gap", F.concat(F.lit("No product uses "), term, F.lit(": "), searches, F.lit(" for something not stocked.")))
        .when(F.col("verdict") == "spelling", F.concat(term, F.lit(" names "), F.format_number("coverage", 0), F.lit(" products but was also typed "), F.array_join("misspellings", ", "), F.lit(", which found nothing relevant.")))
        .when(F.col("verdict") == "retrieval gap", F.concat(F.lit("The catalogue has "), F.format_number("coverage", 0), F.lit(" products for "), term, F.lit("; searches returned none of them.")))
        .when(F.col("verdict") == "relevance", F.concat(F.col("failing_searches").cast("string"), F.lit(" of "), searches, F.lit(" for "), term, F.lit(" were flagged.")))
        .otherwise(F.concat(term, F.lit(" performs normally over "), searches, F.lit(".")))
    )


def ranked(drivers: DataFrame, limit: int = TERM_LIMIT) -> DataFrame:
    return drivers.orderBy(F.desc("total_impact"), F.desc("failing_searches"), "term").limit(limit)
