"""Synonym pairs from four signals: rewording, shared results, aligned names, shared translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryvitals.functions import text as T
from queryvitals.operators import catalog as C
from queryvitals.operators import events as E
from queryvitals.plans.stage import written

# Thresholds and what each signal is worth.
MIN_OVERLAP, MIN_SHARED = 0.30, 2
MIN_ALIGNMENT, MIN_SUPPORT = 0.25, 8
MIN_CONFIDENCE = 0.45
SIGNALS = {"reworded_by_shopper": 0.40, "shared_translation": 0.62, "result_overlap": 0.60, "catalogue_alignment": 0.58}
BONUS = 0.12
#: Queries of one product that meet in one task.
MEETING_BLOCK = 4096


def searched_terms(events: DataFrame, query_count: DataFrame) -> DataFrame:
    """(term): words and stems of everything searched."""
    queries = events.select("norm_query").union(query_count.select("norm_query")).distinct()
    return queries.select(F.explode(F.flatten(F.transform(T.tokenize("norm_query"), T.term_variants))).alias("term")).distinct()


def query_products(events: DataFrame, shop) -> DataFrame:
    """(norm_query, product_id) of queries that some own result mentions; English and Arabic titles count alike."""
    titles = E.result_titles(events)
    each = titles.select("norm_query", F.explode(F.array("title_en", "title_ar")).alias("title")).where("title <> ''").distinct()
    folded = each.withColumn("norm_name", T.normalize("title"))
    relevant = folded.where(T.mentions(T.raw_tokens("norm_query"), T.raw_tokens("norm_name"))).select("norm_query").distinct()
    return folded.join(shop.title_map, "norm_name").select("norm_query", "product_id").distinct().join(relevant, "norm_query", "left_semi")


def result_overlap(products: DataFrame, min_shared: int = MIN_SHARED, min_overlap: float = MIN_OVERLAP, block: int = MEETING_BLOCK) -> DataFrame:
    """(source, target, shared, overlap) of queries whose products coincide.

    Each query's products are put in one order, the rarest first. Two sets of n and m products with Jaccard overlap t share at
    least need = max(min_shared, t (n + m) / (1 + t)) of them, so they meet in the first n - max(min_shared, t n) + 1 of
    the one and in as many of the other, and where they meet at places i and j, what can lie before and after must
    reach need. A product that more than ``block`` queries bring to the meeting is dealt to pairs of blocks of its queries, so
    no task has all of them. The sets of each pair that met are then intersected.
    """
    products = written(products)
    found_by = products.groupBy("product_id").agg(F.count("*").alias("_df"))
    sets = products.join(found_by, "product_id").groupBy("norm_query").agg(F.array_sort(F.collect_set(F.struct("_df", "product_id"))).alias("_s"))
    sets = written(sets.select("norm_query", F.transform("_s", lambda x: x["product_id"]).alias("_p")).where(F.size("_p") >= min_shared))
    n = F.size("_p")
    own_need = F.greatest(F.lit(min_shared), F.ceil(n * min_overlap - 1e-9).cast("int"))
    prefix = sets.select("norm_query", n.alias("_n"), F.posexplode(F.slice("_p", F.lit(1), n - own_need + 1)).alias("_i", "product_id"))
    # A product that one query alone brings meets nothing.
    brought = prefix.groupBy("product_id").agg(F.count("*").alias("_w")).where("_w > 1")
    dealt = prefix.join(brought.select("product_id", F.ceil(F.col("_w") / block).alias("_k")), "product_id")
    own, every = F.pmod(F.xxhash64("norm_query"), F.col("_k")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1))
    a = dealt.select("product_id", own.alias("_x"), every.alias("_y"), F.col("norm_query").alias("source"), F.col("_n").alias("_na"), F.col("_i").alias("_ia"))
    b = dealt.select("product_id", every.alias("_x"), own.alias("_y"), F.col("norm_query").alias("target"), F.col("_n").alias("_nb"), F.col("_i").alias("_ib"))
    need = F.greatest(F.lit(float(min_shared)), F.lit(min_overlap / (1 + min_overlap)) * (F.col("_na") + F.col("_nb")) - 1e-9)
    possible = F.least("_ia", "_ib") + 1 + F.least(F.col("_na") - 1 - F.col("_ia"), F.col("_nb") - 1 - F.col("_ib"))
    near = (F.least("_na", "_nb") >= need) & (possible >= need)
    met = a.join(b, ["product_id", "_x", "_y"]).where((F.col("source") < F.col("target")) & near).select("source", "target").distinct()
    named = lambda name, out: sets.select(F.col("norm_query").alias(name), F.col("_p").alias(out))
    both = met.join(named("source", "_a"), "source").join(named("target", "_b"), "target")
    counted = both.select("source", "target", F.size(F.array_intersect("_a", "_b")).cast("bigint").alias("shared"), (F.size("_a") + F.size("_b")).alias("_sum")).where(F.col("shared") >= min_shared)
    out = counted.withColumn("x_overlap", F.col("shared") / (F.col("_sum") - F.col("shared"))).where(F.col("x_overlap") >= min_overlap)
    return out.select("source", "target", "shared", T.round_even(F.col("x_overlap"), 3).alias("overlap"))


def dice_alignment(product_name: DataFrame, terms: DataFrame, min_support: int = MIN_SUPPORT, min_dice: float = MIN_ALIGNMENT) -> DataFrame:
    """(source, target, source_lang, shared, alignment): searched terms and the other language's terms that name the same
    products. Terms meet through one product's names, which hold a few words each, so no product makes many pairs."""
    names = written(C.name_terms(product_name))
    frequency = names.groupBy(F.col("term").alias("target"), F.col("lang").alias("target_lang")).agg(F.count("*").alias("_df"))
    asked = names.join(terms, "term", "left_semi").select("product_id", F.col("term").alias("source"), F.col("lang").alias("source_lang"))
    totals = asked.groupBy("source", "source_lang").agg(F.count("*").alias("_total"))
    other = names.select("product_id", F.col("term").alias("target"), F.col("lang").alias("target_lang"))
    met = asked.join(other, "product_id").where("source_lang <> target_lang AND source <> target")
    shared = met.groupBy("source", "source_lang", "target", "target_lang").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_support)
    scored = shared.join(totals, ["source", "source_lang"]).join(frequency, ["target", "target_lang"])
    scored = scored.withColumn("x", 2 * F.col("shared") / (F.col("_total") + F.col("_df"))).where(F.col("x") >= min_dice)
    best = scored.groupBy("source", "target").agg(F.max(F.struct("x", F.col("source_lang"), "shared")).alias("m"))
    return best.select("source", "target", F.col("m.source_lang").alias("source_lang"), F.col("m.shared").alias("shared"), T.round_even(F.col("m.x"), 3).alias("alignment"))


def shared_translation(aligned: DataFrame) -> DataFrame:
    """(source, target, lang, translation): terms of one language aligned with one word; the word with the best weaker
    alignment is named. A word's alignment has a floor and a product's name few words, so few terms align with one word."""
    a = aligned.select(F.col("target").alias("translation"), F.col("source").alias("source"), F.col("source_lang").alias("lang"), F.col("alignment").alias("_a"))
    b = aligned.select(F.col("target").alias("translation"), F.col("source").alias("target"), F.col("source_lang").alias("lang"), F.col("alignment").alias("_b"))
    pairs = a.join(b, ["translation", "lang"]).where("source < target")
    best = F.min_by("translation", F.struct(-F.least("_a", "_b"), "translation"))
    return pairs.groupBy("source", "target", "lang").agg(best.alias("translation"))


def confidence(signals: Column) -> Column:
    """The strongest signal, and a bonus for each further one."""
    worth = F.create_map(*[c for k, v in SIGNALS.items() for c in (F.lit(k), F.lit(v))])
    base = F.array_max(F.transform(signals, lambda s: F.coalesce(worth[s], F.lit(0.4))))
    return T.round_even(F.least(F.lit(0.99), base + BONUS * (F.size(signals) - 1)), 3)


def synonym_candidates(reworded: DataFrame, overlap: DataFrame, aligned: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(source_term, target_term, lang, confidence, signals, observations, shared_products, overlap, alignment, translation).

    Pairs are unordered; observations of both directions add up; the language is that of the first signal in order."""
    aligned = written(aligned)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = [
        reworded.select("source", "target", F.lit(0).alias("_o"), F.lit("reworded_by_shopper").alias("signal"), F.lit("ar").alias("lang"), "observations", none("bigint", "shared_products"), none("double", "overlap"), none("double", "alignment"), none("string", "translation")),
        overlap.select("source", "target", F.lit(1).alias("_o"), F.lit("result_overlap").alias("signal"), F.lit("ar").alias("lang"), none("bigint", "observations"), F.col("shared").alias("shared_products"), "overlap", none("double", "alignment"), none("string", "translation")),
        aligned.select("source", "target", F.lit(2).alias("_o"), F.lit("catalogue_alignment").alias("signal"), F.col("source_lang").alias("lang"), none("bigint", "observations"), none("bigint", "shared_products"), none("double", "overlap"), "alignment", none("string", "translation")),
        shared_translation(aligned).select("source", "target", F.lit(3).alias("_o"), F.lit("shared_translation").alias("signal"), "lang", none("bigint", "observations"), none("bigint", "shared_products"), none("double", "overlap"), none("double", "alignment"), "translation"),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    every = every.withColumn("source_term", F.least("source", "target")).withColumn("target_term", F.greatest("source", "target"))
    merged = every.groupBy("source_term", "target_term").agg(
        F.sort_array(F.collect_set("signal")).alias("signals"),
        F.min_by("lang", F.struct("_o", "lang")).alias("lang"),
        F.sum("observations").alias("observations"),
        F.max("shared_products").alias("shared_products"),
        F.max("overlap").alias("overlap"),
        F.max("alignment").alias("alignment"),
        F.max("translation").alias("translation"),
    )
    spelling = T.is_prefix_of("source_term", "target_term") | T.is_prefix_of("target_term", "source_term") | T.within_osa("source_term", "target_term", 2) | (F.col("source_term") == F.col("target_term"))
    out = merged.withColumn("confidence", confidence(F.col("signals"))).where(F.col("confidence") >= min_confidence).where(~spelling)
    return out.select("source_term", "target_term", "lang", "confidence", "signals", "observations", "shared_products", "overlap", "alignment", "translation")


def ordered(found: DataFrame) -> DataFrame:
    """The order in which pairs are reported: surest first, then by their terms."""
    return found.orderBy(F.desc("confidence"), "source_term", "target_term")


def as_candidates(found: DataFrame) -> DataFrame:
    """The queue's form of the pairs."""
    parts = F.array_compact(
        F.array(
            F.when(F.array_contains("signals", "reworded_by_shopper"), F.concat(F.lit("shoppers reworded one as the other "), F.col("observations").cast("string"), F.lit(" times"))),
            F.when(F.array_contains("signals", "result_overlap"), F.concat(F.lit("their results share "), T.round_even(F.col("overlap") * 100, 0).cast("int").cast("string"), F.lit("% of products"))),
            F.when(F.array_contains("signals", "catalogue_alignment"), F.lit("product names use them for each other across languages")),
            F.when(F.array_contains("signals", "shared_translation"), F.concat(F.lit("both translate to "), T.isolate("translation"))),
        )
    )
    why = F.concat(F.lit("Treat "), T.isolate("source_term"), F.lit(" and "), T.isolate("target_term"), F.lit(" as equal: "), F.array_join(parts, "; "), F.lit("."))
    evidence = F.to_json(F.struct("signals", "observations", "shared_products", F.col("overlap").alias("result_overlap"), "alignment", F.col("translation").alias("shared_translation")))
    return found.select(F.lit("synonym").alias("kind"), "source_term", "target_term", "lang", "confidence", why.alias("rationale"), evidence.alias("evidence"))
