"""Quality of single searches: what came back, and whether it belongs together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.functions import text as T
from queryvitals.operators import catalog as C
from queryvitals.plans.stage import written

RESULT_CAP = 5


def result_titles(events: DataFrame) -> DataFrame:
    """(id, norm_query, pos, title_en, title_ar): both languages side by side, a missing one ''."""
    both = F.arrays_zip(F.coalesce("results_en", F.array().cast("array<string>")).alias("en"), F.coalesce("results_ar", F.array().cast("array<string>")).alias("ar"))
    rows = events.select("id", "norm_query", F.posexplode(both).alias("pos", "t"))
    return rows.select("id", "norm_query", "pos", F.coalesce("t.en", F.lit("")).alias("title_en"), F.coalesce("t.ar", F.lit("")).alias("title_ar"))


def lexical_hits(titles: DataFrame) -> DataFrame:
    """(id, lexical_hit_rate): share of result places that mention the query.

    Each distinct (query, title pair) is compared once and joined back, since popular answers repeat.
    """
    distinct = titles.select("norm_query", "title_en", "title_ar").distinct()
    # Folded once, before the words of the query are looked for one by one.
    folded = distinct.withColumns({f"_{c}": T.raw_tokens(T.normalize(c)) for c in ("title_en", "title_ar")})
    terms = T.raw_tokens("norm_query")
    hit = T.mentions(terms, F.col("_title_en")) | T.mentions(terms, F.col("_title_ar"))
    judged = folded.select(*distinct.columns, hit.alias("hit"))
    return titles.join(judged, ["norm_query", "title_en", "title_ar"]).groupBy("id").agg(F.avg(F.col("hit").cast("int")).alias("lexical_hit_rate"))


def resolved(titles: DataFrame, title_map: DataFrame) -> DataFrame:
    """``titles`` with product_id: of the English title, else of the Arabic one; null where neither is known."""
    named = lambda c, out: titles.select(c).distinct().withColumn("_n", T.normalize(c)).join(title_map.withColumnRenamed("norm_name", "_n").withColumnRenamed("product_id", out), "_n").drop("_n")
    return titles.join(named("title_en", "_en"), "title_en", "left").join(named("title_ar", "_ar"), "title_ar", "left").withColumn("product_id", F.coalesce("_en", "_ar")).drop("_en", "_ar")


def coherence(found: DataFrame, product_category: DataFrame, usable: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, coherence, dominant_category): share of resolved products in their commonest category, from two products on."""
    known = found.where("product_id IS NOT NULL").select("id", "product_id")
    several = known.groupBy("id").agg(F.count("*").alias("n")).where("n >= 2")
    member = product_category.distinct().join(usable.select("category_id"), "category_id")
    tally = known.join(member, "product_id").groupBy("id", "category_id").agg(F.count("*").alias("k"))
    top = tally.groupBy("id").agg(F.max(F.struct("k", (-F.col("category_id")).alias("c"))).alias("t"))
    out = several.join(top, "id").select("id", (F.col("t.k") / F.col("n")).alias("coherence"), (-F.col("t.c")).alias("category_id"))
    named = out.join(labels, "category_id", "left")
    return named.select("id", "coherence", F.coalesce("label", F.concat(F.lit("category "), F.col("category_id").cast("string"))).alias("dominant_category"))


def answers(events: DataFrame, shop) -> DataFrame:
    """(_key, _en, _ar, _folded, coherence, dominant_category): each distinct list of results that is not empty, with its
    folded titles and what they have in common. Searches of one answer differ only in their words."""
    lists = events.select(*_lists()).where(F.size("_en") + F.size("_ar") > 0).distinct()
    lists = written(lists.withColumn("_id", F.monotonically_increasing_id()))
    both = lists.select("_id", F.posexplode(F.arrays_zip("_en", "_ar")).alias("pos", "t"))
    titles = both.select(F.col("_id").alias("id"), F.coalesce("t._en", F.lit("")).alias("title_en"), F.coalesce("t._ar", F.lit("")).alias("title_ar"))
    every = titles.select(F.explode(F.array("title_en", "title_ar")).alias("title")).distinct().withColumn("_n", T.normalize("title"))
    every = written(every.join(shop.title_map.withColumnRenamed("norm_name", "_n"), "_n", "left").select("title", F.concat(F.lit(" "), "_n", F.lit(" ")).alias("_f"), "product_id"))
    named = lambda c: every.select(F.col("title").alias(f"title_{c}"), F.col("_f").alias(c), F.col("product_id").alias(f"_{c}"))
    found = titles.join(named("en"), "title_en").join(named("ar"), "title_ar").select("id", "en", "ar", F.coalesce("_en", "_ar").alias("product_id"))
    found = written(found)
    folded = found.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("en", "ar")).alias("_folded"))
    alike = coherence(found, shop.product_category, shop.usable_categories, shop.category_labels).withColumnRenamed("id", "_id")
    return written(lists.join(folded, "_id").join(alike, "_id", "left").select(_key().alias("_key"), "_en", "_ar", "_folded", "coherence", "dominant_category"))


def _lists() -> list:
    """Both lists of results, never null."""
    return [F.coalesce(f"results_{c}", F.array().cast("array<string>")).alias(f"_{c}") for c in ("en", "ar")]


def _key():
    """A number of a pair of lists, by which tasks sort them before they compare the lists themselves."""
    return F.xxhash64("_en", "_ar")


def event_quality(events: DataFrame, shop, cap: int = RESULT_CAP) -> DataFrame:
    """``events`` with every per-search measure. Catalogue matches are computed once per distinct query, what results have in
    common once per distinct answer; each search meets either once."""
    queries = written(events.select("norm_query").distinct())
    queries = written(queries.withColumn("_needles", T.needles(T.raw_tokens("norm_query"))).join(C.query_coverage(queries, shop.vocabulary), "norm_query", "left").join(C.query_matches(queries, shop.vocabulary, shop.reach), "norm_query", "left"))
    # Searches without an answer look for one under numbers of their own, else they would all meet in one task.
    keyed = events.select("*", *_lists()).withColumn("_key", F.when(F.size("_en") + F.size("_ar") > 0, _key()).otherwise(F.xxhash64("id")))
    out = keyed.join(answers(events, shop), ["_key", "_en", "_ar"], "left").drop("_key", "_en", "_ar").join(queries, "norm_query", "left")
    hits = F.filter("_folded", lambda t: F.exists("_needles", lambda w: F.contains(t["en"], w) | F.contains(t["ar"], w)))
    out = out.withColumn("lexical_hit_rate", F.size(hits) / F.size("_folded")).drop("_folded", "_needles")
    out = out.withColumns(
        {
            "lexical_hit_rate": F.coalesce("lexical_hit_rate", F.lit(0.0)),
            "coverage": F.coalesce("coverage", F.lit(0)),
            "intended_coverage": F.coalesce("intended_coverage", F.lit(0)),
            "under_filled": F.col("result_count") < cap,
            "zero_results": F.col("result_count") == 0,
        }
    )
    out = out.withColumn("lexical_miss", (F.col("result_count") > 0) & (F.col("lexical_hit_rate") == 0))
    return out.withColumn("retrieval_gap", (F.col("intended_coverage") > 0) & (F.col("lexical_miss") | F.col("zero_results")))
