"""Lookups in the product catalogue: vocabulary, titles, categories, nearest terms and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.functions import text as T

CATEGORY_SHARE = 0.10
CORRECTION_SUPPORT = 3
COMPLETION_PREFIX = 3
MOST_EDITS = 2


def name_terms(product_name: DataFrame) -> DataFrame:
    """(product_id, lang, term): words of a product's folded name and their stems, once for each name."""
    words = F.explode(F.array_distinct(F.flatten(F.transform(T.tokenize("norm_name"), T.term_variants)))).alias("term")
    return product_name.select("product_id", "lang", words).distinct()


def vocabulary(product_name: DataFrame) -> DataFrame:
    """(term, lang, product_count): product names that have the term."""
    words = F.explode(F.array_distinct(F.flatten(F.transform(T.tokenize("norm_name"), T.term_variants)))).alias("term")
    return product_name.select(words, "lang").groupBy("term", "lang").agg(F.count("*").alias("product_count"))


def title_map(product_name: DataFrame) -> DataFrame:
    """(norm_name, product_id): the largest id where several products share a folded name."""
    return product_name.where("norm_name <> ''").groupBy("norm_name").agg(F.max("product_id").alias("product_id"))


def category_usage(product_category: DataFrame) -> DataFrame:
    return product_category.distinct().groupBy("category_id").agg(F.count("*").alias("products"))


def discriminative_categories(product_category: DataFrame, product: DataFrame, share: float = CATEGORY_SHARE) -> DataFrame:
    """(category_id, products): categories of at most a tenth of all products."""
    ceiling = product.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("ceiling"))
    return category_usage(product_category).join(F.broadcast(ceiling)).where("products <= ceiling").drop("ceiling")


def category_labels(category_name: DataFrame) -> DataFrame:
    """(category_id, label): the English name where there is one, else the Arabic one."""
    return category_name.groupBy("category_id").agg(F.max_by(F.trim("name"), "lang").alias("label"))


def coverage(terms: DataFrame, vocab: DataFrame, term: str = "term") -> DataFrame:
    """``terms`` (distinct) with coverage: the most products of any variant in any language, 0 if none."""
    each = terms.select(term, F.explode(T.term_variants(term)).alias("_v"))
    counts = vocab.groupBy(F.col("term").alias("_v")).agg(F.max("product_count").alias("_n"))
    best = each.join(counts, "_v").groupBy(term).agg(F.max("_n").alias("coverage"))
    return terms.join(best, term, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))


def query_coverage(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(norm_query, coverage): that of the best covered word."""
    words = queries.select("norm_query").distinct().select("norm_query", F.explode_outer(T.tokenize("norm_query")).alias("term"))
    covered = coverage(words.select("term").where("term IS NOT NULL").distinct(), vocab)
    return words.join(covered, "term", "left").groupBy("norm_query").agg(F.coalesce(F.max("coverage"), F.lit(0)).alias("coverage"))


def within_edits(left: DataFrame, right: DataFrame, a: str, b: str, most: int = MOST_EDITS) -> DataFrame:
    """(a, b, distance) of the distinct strings within ``most`` edits: two such strings share a string that both reach
    by at most ``most`` deletions, so the sides are joined on their deletions and no others are ever compared."""
    x = left.select(a, F.explode(T.deletions(a, most)).alias("_k"))
    y = right.select(b, F.explode(T.deletions(b, most)).alias("_k"))
    met = x.join(y, "_k").where(F.abs(F.length(a) - F.length(b)) <= most).select(a, b).distinct()
    return met.where(F.levenshtein(a, b) <= 2 * most).withColumn("distance", T.osa_distance(a, b)).where(F.col("distance") <= most)


def _stocked(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.col("product_count") >= CORRECTION_SUPPORT).select(F.col("term").alias("match"), F.col("lang").alias("match_lang"), F.col("product_count").alias("support"))


def reach(vocab: DataFrame) -> DataFrame:
    """(short, match): what is left of each stocked term after up to ``MOST_EDITS`` deletions."""
    return _stocked(vocab).select("match").distinct().select(F.explode(T.deletions("match", MOST_EDITS)).alias("short"), "match")


def nearest_terms(terms: DataFrame, vocab: DataFrame, term: str = "term", near_by: DataFrame | None = None) -> DataFrame:
    """(term, match, match_lang, distance, support) of the terms that have a vocabulary term in reach.

    Exact variants win (the term before its stem, Arabic before English). Only what is left is compared: two strings
    within k edits share a string that both reach by at most k deletions, so both sides are joined on their deletions,
    and the distance is computed once for each pair that meets. ``near_by`` is ``reach(vocab)``, if the caller has it.
    Ties: nearest, best stocked, shortest, then by code point.
    """
    distinct = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    each = distinct.select("term", F.posexplode(T.term_variants("term")).alias("_p", "_v"))
    exact = each.join(vocab.select(F.col("term").alias("_v"), "lang", "product_count"), "_v")
    exact = exact.groupBy("term").agg(F.min_by(F.struct(F.col("_v").alias("match"), F.col("lang").alias("match_lang"), F.lit(0).alias("distance"), F.col("product_count").alias("support")), F.struct("_p", "lang")).alias("m"))
    rest = distinct.join(exact, "term", "left_anti").withColumn("budget", T.edit_budget("term")).where("budget > 0")
    stocked = _stocked(vocab)
    left = rest.select("term", "budget", F.explode(F.when(F.col("budget") == 1, T.deletions("term", 1)).otherwise(T.deletions("term", MOST_EDITS))).alias("_k"))
    right = (reach(vocab) if near_by is None else near_by).select("match", F.col("short").alias("_k"))
    met = left.join(right, "_k").where(F.abs(F.length("term") - F.length("match")) <= F.col("budget")).select("term", "match", "budget").distinct()
    near = met.where(F.levenshtein("term", "match") <= 2 * F.col("budget")).withColumn("distance", T.osa_distance("term", "match")).where("distance <= budget")
    near = near.join(stocked, "match").groupBy("term").agg(
        F.min_by(F.struct("match", "match_lang", "distance", "support"), F.struct("distance", -F.col("support"), F.length("match"), "match", "match_lang")).alias("m")
    )
    return exact.select("term", "m.*").unionByName(near.select("term", "m.*"))


def query_matches(queries: DataFrame, vocab: DataFrame, near_by: DataFrame | None = None) -> DataFrame:
    """(norm_query, intended_term, intended_lang, correction_distance, intended_coverage): the best match of any word."""
    words = queries.select("norm_query").distinct().select("norm_query", F.posexplode(T.tokenize("norm_query")).alias("_p", "term"))
    near = nearest_terms(words, vocab, near_by=near_by)
    best = F.min_by(F.struct("match", "match_lang", "distance", "support"), F.struct("distance", -F.col("support"), "_p"))
    out = words.join(near, "term").groupBy("norm_query").agg(best.alias("m"))
    return out.select("norm_query", F.col("m.match").alias("intended_term"), F.col("m.match_lang").alias("intended_lang"), F.col("m.distance").alias("correction_distance"), F.col("m.support").alias("intended_coverage"))


def best_completions(vocab: DataFrame) -> DataFrame:
    """(prefix, completion, completion_lang, completion_support): for each prefix of the vocabulary the best stocked longer
    term; a partial aggregate, so a prefix that begins very many terms is one row when it meets what is asked."""
    words = vocab.where(F.length("term") > COMPLETION_PREFIX)
    prefixes = F.transform(F.sequence(F.lit(COMPLETION_PREFIX), F.length("term") - 1), lambda n: F.substring("term", F.lit(1), n))
    each = words.select(F.explode(prefixes).alias("prefix"), F.col("term").alias("completion"), F.col("lang").alias("completion_lang"), F.col("product_count").alias("completion_support"))
    best = F.min_by(F.struct("completion", "completion_lang", "completion_support"), F.struct(-F.col("completion_support"), "completion", "completion_lang"))
    return each.groupBy("prefix").agg(best.alias("m")).select("prefix", "m.*")


def completions(terms: DataFrame, vocab: DataFrame, term: str = "term", best: DataFrame | None = None) -> DataFrame:
    """(term, completion, completion_lang, completion_support): the best stocked longer term that starts with it. ``best``
    is ``best_completions(vocab)``, if the caller has it."""
    short = terms.select(F.col(term).alias("term")).distinct().where(F.length("term") >= COMPLETION_PREFIX)
    return short.join((best_completions(vocab) if best is None else best).withColumnRenamed("prefix", "term"), "term")
