"""Source rows to store tables: typing, last row wins, sessions, vocabulary, orphans, and what was skipped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryvitals.functions import text as T
from queryvitals.operators import catalog as C
from queryvitals.operators import sessions as S
from queryvitals.plans.stage import stage
from queryvitals.schemas import SOURCES, TABLES

LANGUAGES = {"arabic": "ar", "ar": "ar", "english": "en", "en": "en"}


def language_code(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[F.lower(F.trim(text))]


def parse_time(text: Column) -> Column:
    """Timestamps with or without fractions; null for anything else."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$")
    return F.when(ok, F.try_to_timestamp(text).cast("timestamp_ntz"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the largest ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _typed(source: DataFrame, name: str) -> DataFrame:
    at = SOURCES[name]
    return source.where(F.col("table") == name).select("ordinal", *[F.col("cols").getItem(i).alias(c) for c, i in at.items()])


def build(source: DataFrame, gap_seconds: int = S.GAP_SECONDS) -> tuple[dict[str, DataFrame], DataFrame]:
    """Store tables, and the report (table, emitted, skipped, reasons) of a load. ``source``: rows (table, cols), and their
    place, by which the last row of a key wins.

    The parsed rows are written once; without a place they are numbered as they come, and the numbers are then the
    same for all tables. ``reasons`` counts the skipped rows by what was wrong with them first.
    """
    source = stage(source.withColumnRenamed("place", "ordinal") if "place" in source.columns else source.withColumn("ordinal", F.monotonically_increasing_id()))
    number = lambda c, kind="bigint": F.expr(f"try_cast({c} AS {kind})")
    product = _typed(source, "catalog_product").select("ordinal", number("id").alias("id"), "sku", "url_key", number("price", "double").alias("default_price"), (F.col("price").isNotNull() & number("price", "double").isNull()).alias("_bad"))
    names = _typed(source, "catalog_productname").select("ordinal", number("product_id").alias("product_id"), language_code(F.col("language")).alias("lang"), "name", T.normalize("name").alias("norm_name"))
    category = _typed(source, "catalog_category").select("ordinal", number("id").alias("id"), number("parent").alias("parent_id"))
    labels = _typed(source, "catalog_categoryname").select("ordinal", number("category_id").alias("category_id"), language_code(F.col("language")).alias("lang"), "name", T.normalize("name").alias("norm_name"))
    member = _typed(source, "catalog_product_categories").select("ordinal", number("product_id").alias("product_id"), number("category_id").alias("category_id"))
    counter = _typed(source, "recommendations_querycount").select("ordinal", "query", T.normalize("query").alias("norm_query"), number("count").alias("count"))
    searches = _typed(source, "recommendations_searches").select("ordinal", number("id").alias("id"), F.col("query").alias("raw_query"), T.split_lines("ar").alias("results_ar"), T.split_lines("en").alias("results_en"), number("count", "int").alias("result_count"), parse_time(F.col("at")).alias("ts"))

    missing = lambda *cs: [(F.col(c).isNull(), f"no valid {c}") for c in cs]
    good = {
        "product": (product, [*missing("id"), (F.col("_bad"), "malformed price")], ["id"]),
        "product_name": (names, missing("product_id", "lang", "name"), ["product_id", "lang"]),
        "category": (category, missing("id"), ["id"]),
        "category_name": (labels, missing("category_id", "lang", "name"), ["category_id", "lang"]),
        "product_category": (member, missing("product_id", "category_id"), ["product_id", "category_id"]),
        "query_count": (counter, missing("query", "count"), ["query"]),
        "search_event": (searches, missing("id", "result_count", "ts"), ["id"]),
    }
    tables, reports = {}, []
    for name, (rows, faults, keys) in good.items():
        reason = F.coalesce(*[F.when(wrong, said) for wrong, said in faults])
        ok = reason.isNull()
        counts = F.map_from_arrays(F.array(*[F.lit(said) for _, said in faults]), F.array(*[F.count_if(F.coalesce(reason == said, F.lit(False))) for _, said in faults]))
        report = rows.agg(F.count_if(ok).alias("emitted"), F.count_if(~ok).alias("skipped"), F.map_filter(counts, lambda _, n: n > 0).alias("reasons"))
        reports.append(report.select(F.lit(name).alias("table"), "emitted", "skipped", "reasons"))
        tables[name] = last_wins(rows.where(ok).drop("_bad"), keys, "ordinal").drop("ordinal")
    tables = remove_orphans(tables)
    events = S.sessionize(tables["search_event"], "ts", "id", gap_seconds)
    tables["search_event"] = events.select(
        "id", F.coalesce("raw_query", F.lit("")).alias("raw_query"), T.normalize("raw_query").alias("norm_query"), T.script_of("raw_query").alias("script"), "result_count", "results_ar", "results_en",
        T.result_signature("results_en", "results_ar").alias("result_signature"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("occurred_at"), "session_id", F.lit(None).cast("int").alias("clicked_rank"), F.lit(None).cast("boolean").alias("converted"),
    )
    tables["catalog_term"] = C.vocabulary(tables["product_name"])
    ordered = {k: v.select(*[c.split()[0] for c in _fields(TABLES[k])]) for k, v in tables.items()}
    return ordered, reduce(DataFrame.unionByName, reports)


def _fields(ddl: str) -> list[str]:
    import re

    return [x.strip() for x in re.split(r",(?![^<]*>)", ddl)]


def remove_orphans(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Names and memberships of unknown products or categories go; an unknown parent becomes null."""
    products = tables["product"].select(F.col("id").alias("product_id"))
    categories = tables["category"].select(F.col("id").alias("category_id"))
    out = dict(tables)
    out["product_name"] = tables["product_name"].join(products, "product_id", "left_semi")
    out["category_name"] = tables["category_name"].join(categories, "category_id", "left_semi")
    out["product_category"] = tables["product_category"].join(products, "product_id", "left_semi").join(categories, "category_id", "left_semi")
    parents = tables["category"].select(F.col("id").alias("_p"))
    out["category"] = tables["category"].join(parents, F.col("parent_id") == F.col("_p"), "left").select("id", F.col("_p").alias("parent_id"))
    return out


def violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference has no parent."""
    keys = parent.select(F.col(key).alias("_k"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_k"), "left_anti")


def check_references(tables: dict[str, DataFrame]) -> None:
    """RuntimeError where a stored reference dangles."""
    for child, column, parent in (("product_name", "product_id", "product"), ("product_category", "product_id", "product"), ("product_category", "category_id", "category"), ("category_name", "category_id", "category"), ("category", "parent_id", "category")):
        if not violations(tables[child], column, tables[parent], "id").isEmpty():
            raise RuntimeError(f"{child}.{column} refers to rows that {parent} lacks")


def latest_results(events: DataFrame) -> DataFrame:
    """(norm_query, results_ar, results_en) of the newest search of each query."""
    return events.groupBy("norm_query").agg(F.max_by(F.struct("results_ar", "results_en"), F.struct("occurred_at", "id")).alias("r")).select("norm_query", "r.*")

