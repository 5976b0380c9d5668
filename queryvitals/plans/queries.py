"""Registered queries: each runs one operator over the whole benchmark tables, beside the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.functions import text as T
from queryvitals.operators import behaviour as B
from queryvitals.operators import catalog as C
from queryvitals.operators import events as E
from queryvitals.operators import ingest as I
from queryvitals.operators import metrics as M
from queryvitals.operators import reports as R
from queryvitals.operators import review as V
from queryvitals.operators import sessions as S
from queryvitals.operators import spelling as P
from queryvitals.operators import states as A
from queryvitals.operators import substrings as G
from queryvitals.operators import synonyms as Y
from queryvitals.operators import terms as D
from queryvitals.plans.oracles import compose
from queryvitals.plans.stage import stage
from queryvitals.sources.surrogate import Surrogate

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: On the benchmark's two vocabularies the strongest alignment is near 0.2; the queries use a lower bar than a shop would.
ALIGN = 0.1


def query(name: str, sql: str | None = None, recursive: str = ""):
    """Register ``fn(surrogate)`` under a name, with the SQL of the same rows."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Surrogate(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = compose(sql, recursive, min_dice=str(ALIGN))
        return fn

    return add


def _stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# Loading rules.


@query("dedupe_last_wins", "SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, arg_max(l_partkey, (l_suppkey, l_partkey)) AS partkey FROM lineitem GROUP BY 1, 2")
def dedupe_last_wins(s: Surrogate) -> DataFrame:
    rows = s.table("lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_partkey").alias("partkey"), F.struct("l_suppkey", "l_partkey").alias("o"))
    return I.last_wins(rows, ["orderkey", "linenumber"], "o").drop("o")


@query("orphan_anti_join", "SELECT l_orderkey AS orderkey, l_partkey AS partkey, l_linenumber AS linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def orphan_anti_join(s: Surrogate) -> DataFrame:
    kept = s.table("part").where("p_size > 25").select("p_partkey")
    rows = s.table("lineitem").join(kept, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return rows.select(F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"), F.col("l_linenumber").alias("linenumber"))


@query("fk_violations", "SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def fk_violations(s: Surrogate) -> DataFrame:
    parent = s.table("customer").where("c_acctbal > 0")
    return I.violations(s.table("orders"), "o_custkey", parent, "c_custkey").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"))


# Text.

_NORM = r"trim(regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("normalize_documents", f"SELECT doc_id, {_NORM} AS norm FROM documents")
def normalize_documents(s: Surrogate) -> DataFrame:
    return s.table("documents").select("doc_id", T.normalize("text").alias("norm"))


@query("compatibility_forms", "SELECT p_partkey, concat(lower(p_name), ' fi لا 12 ', lower(p_type)) AS norm FROM part")
def compatibility_forms(s: Surrogate) -> DataFrame:
    """Part names in full-width letters, a ligature, an Arabic presentation form and superscripts fold to the plain ones."""
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + i) for i in range(26)))
    return s.table("part").select("p_partkey", T.normalize(F.concat(wide, F.lit(" \ufb01 \ufefb \u00b9\u00b2 "), "p_type")).alias("norm"))


@query("folded_marks", "SELECT p_partkey, concat(lower(p_name), ' ậ ậ 한 οδοσ x2 strasse ', lower(p_type)) AS norm FROM part")
def folded_marks(s: Surrogate) -> DataFrame:
    """Marks in both orders, a syllable in parts, a final sigma in capitals, a superscript and a sharp s fold as one string does."""
    odd = " a\u0302\u0323 a\u0323\u0302 \u1112\u1161\u11ab ΟΔΟΣ X² STRAẞE "
    return s.table("part").select("p_partkey", T.normalize(F.concat(F.upper("p_name"), F.lit(odd), F.upper("p_type"))).alias("norm"))


@query("token_counts", f"SELECT term, count(*) AS uses FROM (SELECT unnest(string_split({_NORM}, ' ')) AS term FROM conversations) WHERE length(term) >= 2 GROUP BY 1")
def token_counts(s: Surrogate) -> DataFrame:
    return s.table("conversations").select(F.explode(T.tokenize(T.normalize("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("uses"))


@query("script_profile", "SELECT lang, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(text, '[0-9]') THEN 'digits' ELSE 'other' END AS script, count(*) AS docs FROM documents GROUP BY 1, 2")
def script_profile(s: Surrogate) -> DataFrame:
    return s.table("documents").groupBy("lang", T.script_of("text").alias("script")).agg(F.count("*").alias("docs"))


@query(
    "stem_variants",
    "SELECT term, CASE WHEN length(term) >= 6 THEN substr(term, 4) ELSE term END AS stem FROM (SELECT DISTINCT concat('بال', lower(p_type)) AS term FROM part UNION SELECT DISTINCT lower(p_type) FROM part) t0 WHERE starts_with(term, 'بال') UNION SELECT DISTINCT lower(p_type), lower(p_type) FROM part",
)
def stem_variants(s: Surrogate) -> DataFrame:
    plain = s.table("part").select(F.lower("p_type").alias("term"))
    return plain.union(plain.select(F.concat(F.lit("بال"), "term"))).distinct().select("term", T.light_stem("term").alias("stem"))


@query("edit_distance", "SELECT a.term AS a, b.term AS b, CAST(damerau_levenshtein(a.term, b.term) AS INTEGER) AS distance FROM {words} a JOIN (SELECT DISTINCT term FROM {vocab}) b ON abs(length(a.term) - length(b.term)) <= 2 AND damerau_levenshtein(a.term, b.term) <= 2")
def edit_distance(s: Surrogate) -> DataFrame:
    return C.within_edits(_words(s).select(F.col("term").alias("a")), s.shop().vocabulary.select(F.col("term").alias("b")).distinct(), "a", "b", 2)


def _words(s: Surrogate) -> DataFrame:
    return s.log().select("norm_query").distinct().select(F.explode(T.tokenize("norm_query")).alias("term")).distinct()


# Catalogue.


@query("vocabulary", "SELECT * FROM {vocab}")
def vocabulary(s: Surrogate) -> DataFrame:
    return s.shop().vocabulary


@query("category_ceiling", "SELECT category_id, products FROM {usable}")
def category_ceiling(s: Surrogate) -> DataFrame:
    return s.shop().usable_categories.select("category_id", "products")


@query("category_label", "SELECT * FROM {labels}")
def category_label(s: Surrogate) -> DataFrame:
    return s.shop().category_labels


@query("title_resolution", "SELECT id, CAST(pos AS INTEGER) AS pos, product_id FROM {reso}")
def title_resolution(s: Surrogate) -> DataFrame:
    return E.resolved(E.result_titles(s.log()), s.shop().title_map).select("id", "pos", "product_id")


@query("query_coverage", "SELECT * FROM {qcov}")
def query_coverage(s: Surrogate) -> DataFrame:
    return C.query_coverage(s.log(), s.shop().vocabulary)


@query("nearest_term", "SELECT * FROM {near}")
def nearest_term(s: Surrogate) -> DataFrame:
    return C.nearest_terms(_words(s), s.shop().vocabulary)


@query("best_query_match", "SELECT norm_query, intended_term, intended_lang, correction_distance, intended_coverage FROM {qmatch}")
def best_query_match(s: Surrogate) -> DataFrame:
    return C.query_matches(s.log(), s.shop().vocabulary)


@query("best_completion", "SELECT * FROM {compl}")
def best_completion(s: Surrogate) -> DataFrame:
    return C.completions(_words(s), s.shop().vocabulary)


@query("example_products", "SELECT p_partkey AS product_id, p_name AS name FROM part WHERE contains(p_name, 'gear') ORDER BY 1 LIMIT 8")
def example_products(s: Surrogate) -> DataFrame:
    names = s.product_name().where("lang = 'en'")
    return names.where(F.contains("norm_name", F.lit("gear"))).orderBy("product_id", "lang").limit(8).select("product_id", "name")


@query("names_by_substring", "SELECT needle, p_partkey AS product_id FROM (SELECT DISTINCT substr(p_name, 2, length(p_name) % 5 + 2) AS needle FROM part) n JOIN part p ON contains(p.p_name, n.needle)")
def names_by_substring(s: Surrogate) -> DataFrame:
    """The English names that contain any of many pieces of names, by their grams."""
    names = s.product_name().where("lang = 'en'")
    needles = s.table("part").select(F.expr("substr(p_name, 2, length(p_name) % 5 + 2)").alias("needle"))
    return G.containing(needles, G.postings(names, ["product_id"]), names, ["product_id"]).select("needle", "product_id")


# Sessions and behaviour.


@query("sessionize_global", "SELECT id, session_id FROM {ev}")
def sessionize_global(s: Surrogate) -> DataFrame:
    return S.sessionize(s.table("search").select("id", "ts")).select("id", "session_id")


@query(
    "sessionize_by_user",
    "SELECT id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM (SELECT *, CASE WHEN coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id)) > 1800000000, true) THEN 1 ELSE 0 END AS fresh FROM {search})",
)
def sessionize_by_user(s: Surrogate) -> DataFrame:
    return S.sessionize_by(s.table("search").select("id", "ts", "user_id"), "user_id").select("id", "user_id", "session_no")


def _followed(s: Surrogate) -> DataFrame:
    return B.follow_ups(s.events())


def _kinds(s: Surrogate) -> DataFrame:
    return B.reformulation_kinds(_followed(s))


@query("follow_up", "SELECT id, session_id, follow_up, next_norm_query, CAST(gap AS DOUBLE) AS seconds_to_next, dissatisfied FROM {beh}")
def follow_up(s: Surrogate) -> DataFrame:
    return _followed(s).select("id", "session_id", "follow_up", "next_norm_query", "seconds_to_next", "dissatisfied")


@query("follow_up_without_sessions", "SELECT id, next_norm_query, CASE WHEN gap IS NULL THEN 'none' WHEN gap > 300 THEN 'new_intent' WHEN next_norm_query = norm_query THEN 'repeat' ELSE 'reformulation' END AS follow_up FROM (SELECT id, norm_query, lead(norm_query) OVER o AS next_norm_query, epoch(lead(occurred_at) OVER o) - epoch(occurred_at) AS gap FROM {log} WINDOW o AS (ORDER BY occurred_at, id))")
def follow_up_without_sessions(s: Surrogate) -> DataFrame:
    """All searches in the one session of those without a session."""
    return B.follow_ups(s.log().withColumn("session_id", F.lit(None).cast("string"))).select("id", "next_norm_query", "follow_up")


@query("reformulation_kind", "SELECT reformulation, count(*) AS searches FROM {kind} WHERE reformulation IS NOT NULL GROUP BY 1")
def reformulation_kind(s: Surrogate) -> DataFrame:
    return _kinds(s).where("reformulation IS NOT NULL").groupBy("reformulation").agg(F.count("*").alias("searches"))


@query("rapid_repeat", "SELECT id, rapid_repeat FROM {beh}")
def rapid_repeat(s: Surrogate) -> DataFrame:
    return _followed(s).select("id", "rapid_repeat")


@query("self_corrections", "SELECT * FROM {corr}")
def self_corrections(s: Surrogate) -> DataFrame:
    return B.self_corrections(_kinds(s))


@query("reworded_pairs", "SELECT * FROM {rew}")
def reworded_pairs(s: Surrogate) -> DataFrame:
    return B.reworded_pairs(_kinds(s))


@query("dissatisfaction_by_query", "SELECT norm_query, scored, dissatisfied, xdis AS dissatisfaction_rate FROM {scored}")
def dissatisfaction_by_query(s: Surrogate) -> DataFrame:
    return B.dissatisfaction(_followed(s), "norm_query")


# Quality of searches.


@query("result_signature", "SELECT id, result_signature FROM {log}")
def result_signature(s: Surrogate) -> DataFrame:
    return s.log().select("id", "result_signature")


@query("lexical_hit_rate", "SELECT id, lexical_hit_rate FROM {lex}")
def lexical_hit_rate(s: Surrogate) -> DataFrame:
    return E.lexical_hits(E.result_titles(s.log()))


@query("coherence", "SELECT * FROM {coh}")
def coherence(s: Surrogate) -> DataFrame:
    shop = s.shop()
    return E.coherence(E.resolved(E.result_titles(s.log()), shop.title_map), shop.product_category, shop.usable_categories, shop.category_labels)


@query("event_quality", "SELECT id, norm_query, lexical_hit_rate, coherence, dominant_category, coverage, intended_term, intended_coverage, coalesce(correction_distance, -1) AS correction_distance, under_filled, zero_results, lexical_miss, retrieval_gap FROM {evg}")
def event_quality(s: Surrogate) -> DataFrame:
    q = E.event_quality(s.log(), s.shop())
    return q.select("id", "norm_query", "lexical_hit_rate", "coherence", "dominant_category", "coverage", "intended_term", "intended_coverage", F.coalesce("correction_distance", F.lit(-1)).alias("correction_distance"), "under_filled", "zero_results", "lexical_miss", "retrieval_gap")


@query("under_fill", "SELECT norm_query, floor(xunder * 1e6 + 0.5) / 1e6 AS under_fill FROM {rolled}")
def under_fill(s: Surrogate) -> DataFrame:
    rate = F.sum(F.greatest(F.lit(0), 5 - F.col("result_count"))) / (5 * F.count("*"))
    return s.log().groupBy("norm_query").agg((F.floor(rate * 1e6 + 0.5) / 1e6).alias("under_fill"))


@query("instability", "SELECT norm_query, xinst AS instability FROM {rolled}")
def instability(s: Surrogate) -> DataFrame:
    n = F.count("*")
    rate = F.when(n > 1, (F.count_distinct("result_signature") - 1) / (n - 1)).otherwise(F.lit(0.0))
    return s.log().groupBy("norm_query").agg(rate.alias("instability"))


# Scores.

_QUALITY = ["norm_query", "display_query", "searches", "sessions", "mean_results", "min_results", "zero_result_rate", "under_fill", "lexical_miss_rate", "incoherence", "instability", "dissatisfaction_rate", "engagement_rate", "rapid_repeat_rate", "coverage", "retrieval_gap", "dominant_category", "intended_term", "intended_coverage", "severity", "impact", "is_problem"]
_QUALITY_SQL = ", ".join(_QUALITY)


def _quality(s: Surrogate) -> DataFrame:
    return M.query_quality(s.events(), s.shop())


@query("query_quality", f"SELECT {_QUALITY_SQL}, CAST(epoch(first_seen) AS BIGINT) AS first_seen_s, CAST(epoch(last_seen) AS BIGINT) AS last_seen_s FROM {{qq}}")
def query_quality(s: Surrogate) -> DataFrame:
    second = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).alias(f"{c}_s")
    return _quality(s).select(*_QUALITY, second("first_seen"), second("last_seen"))


_REASONS = "CASE WHEN retrieval_gap AND misspelled AND intended_term IS NOT NULL THEN 'misspelling_gap' WHEN retrieval_gap THEN 'retrieval_gap' END, CASE WHEN xlex > 0 THEN 'lexical_miss' END, CASE WHEN xinc >= 0.5 THEN 'scattered' END, CASE WHEN xunder > 0 THEN 'under_filled' END, CASE WHEN xinst > 0 THEN 'unstable' END, CASE WHEN xdis > 0 THEN 'retried' END, CASE WHEN xrapid > 0 THEN 'automated' END, CASE WHEN coverage = 0 AND intended_coverage = 0 THEN 'assortment_gap' END"


@query("query_reasons", f"SELECT norm_query, concat_ws('|', {_REASONS}) AS reasons FROM {{qq}}")
def query_reasons(s: Surrogate) -> DataFrame:
    return _quality(s).select("norm_query", F.array_join("reason_codes", "|").alias("reasons"))


def _percent(x: str) -> str:
    return f"concat(CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR), '%')"


def _isolated(x: str) -> str:
    return f"concat(chr(8296), {x}, chr(8297))"


_REASON_TEXTS = ", ".join(
    f"CASE WHEN {condition} THEN concat({said}) END"
    for condition, said in [
        ("retrieval_gap AND misspelled AND intended_term IS NOT NULL", f"'Retrieval gap: a likely misspelling of ', {_isolated('intended_term')}, ', which ', format('{{:,}}', intended_coverage), ' products use; none came back.'"),
        ("retrieval_gap AND NOT (misspelled AND intended_term IS NOT NULL)", "'Retrieval gap: the catalogue has ', format('{:,}', intended_coverage), ' matching products; none came back.'"),
        ("xlex > 0", f"{_percent('xlex')}, ' of searches returned nothing that mentions the query.'"),
        ("xinc >= 0.5", f"'Results are scattered over categories (', {_percent('(1 - xinc)')}, ' share one).'"),
        ("xunder > 0", "'On average ', format('{:.1f}', xmean), ' of 5 result places were filled.'"),
        ("xinst > 0", f"'Ranking is unstable: ', {_percent('xinst')}, ' of repeats returned other products.'"),
        ("xdis > 0", f"{_percent('xdis')}, ' of these searches were retried or reworded at once.'"),
        ("xrapid > 0", f"{_percent('xrapid')}, ' were fired again within two seconds with equal results; these look automated and are left out.'"),
        ("coverage = 0 AND intended_coverage = 0", "'No product uses this word or one close to it: possibly an assortment gap.'"),
    ]
)


@query("query_reason_texts", f"SELECT norm_query, concat_ws(' ', {_REASON_TEXTS}) AS reasons FROM {{qq}}")
def query_reason_texts(s: Surrogate) -> DataFrame:
    return M.reason_texts(_quality(s)).select("norm_query", F.array_join("reasons", " ").alias("reasons"))


@query("problem_queries", "SELECT norm_query, searches, severity, impact FROM {qq} WHERE is_problem ORDER BY impact DESC, searches DESC, norm_query LIMIT 10")
def problem_queries(s: Surrogate) -> DataFrame:
    return M.problem_queries(_quality(s)).select("norm_query", "searches", "severity", "impact")


_OVERVIEW = "CAST(coalesce(sum(searches), 0) AS BIGINT) AS total_searches, count(*) AS distinct_queries, count(*) FILTER (is_problem) AS problem_queries, round_even(sum(zeros) / CAST(sum(searches) AS DOUBLE), 3) AS zero_result_rate, round_even(sum(unders) / CAST(sum(searches) AS DOUBLE), 3) AS under_filled_rate, round_even(sum(lexical_miss_rate * searches) / sum(searches), 3) AS lexical_miss_rate, round_even(sum(dissatisfaction_rate * searches) / sum(searches) FILTER (dissatisfaction_rate IS NOT NULL), 3) AS dissatisfaction_rate, round_even(100 * (1 - sum(severity * searches) / sum(searches)), 1) AS health_score, round_even(sum(rapids) / CAST(sum(searches) AS DOUBLE), 3) AS automated_rate, CASE WHEN count(*) = 0 THEN 'no data' WHEN bool_or(engagement_rate IS NOT NULL) THEN 'measured' ELSE 'proxy' END AS engagement_source, concat_ws('|', CASE WHEN NOT bool_or(engagement_rate IS NOT NULL) THEN 'Dissatisfaction is inferred from what shoppers did next; no clicks are recorded.' END, CASE WHEN round_even(sum(rapids) / CAST(sum(searches) AS DOUBLE), 3) > 0.02 THEN 'Some searches repeat at machine speed and are left out of the engagement figures.' END, CASE WHEN round_even(sum(zeros) / CAST(sum(searches) AS DOUBLE), 3) = 0 THEN 'No search came back empty: failures show as wrong results.' END) AS notes"


@query("overview", f"SELECT {_OVERVIEW} FROM {{qq}}")
def overview(s: Surrogate) -> DataFrame:
    return _noted(M.overview(_quality(s)))


def _noted(df: DataFrame) -> DataFrame:
    return df.withColumn("notes", F.array_join("notes", "|"))


@query("overview_empty_period", "SELECT CAST(0 AS BIGINT) AS total_searches, CAST(0 AS BIGINT) AS distinct_queries, CAST(0 AS BIGINT) AS problem_queries, 0.0::DOUBLE AS zero_result_rate, 0.0::DOUBLE AS under_filled_rate, 0.0::DOUBLE AS lexical_miss_rate, CAST(NULL AS DOUBLE) AS dissatisfaction_rate, 100.0::DOUBLE AS health_score, 0.0::DOUBLE AS automated_rate, 'no data' AS engagement_source, 'No searches in this period.' AS notes FROM (SELECT count(*) AS n FROM {ev} WHERE strftime(occurred_at, '%Y-%m-%d') >= '2031-01-01') WHERE n = 0")
def overview_empty_period(s: Surrogate) -> DataFrame:
    return M.overview(M.query_quality(M.in_period(s.events(), "2031-01-01"), s.shop())).transform(_noted)


@query("period_filter", "SELECT id, session_id FROM {ev} WHERE strftime(occurred_at, '%Y-%m-%d %H:%M:%S') >= '2024-01-08' AND strftime(occurred_at, '%Y-%m-%d %H:%M:%S') <= '2024-01-20'")
def period_filter(s: Surrogate) -> DataFrame:
    return M.in_period(s.events(), "2024-01-08", "2024-01-20").select("id", "session_id")


@query("daily_health", f"SELECT day, {_OVERVIEW} FROM {{qq_day}} GROUP BY day")
def daily_health(s: Surrogate) -> DataFrame:
    return _noted(M.daily_health(s.events(), s.shop())).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _states(s: Surrogate) -> tuple[DataFrame, DataFrame]:
    scored = stage(E.event_quality(B.follow_ups(s.events()), s.shop()))
    return A.states(scored), A.tails(scored)


@query("quality_from_states", f"SELECT {_QUALITY_SQL} FROM {{qq}}")
def quality_from_states(s: Surrogate) -> DataFrame:
    return A.query_quality(*_states(s)).select(*_QUALITY)


@query("daily_health_from_states", f"SELECT day, {_OVERVIEW} FROM {{qq_day}} GROUP BY day")
def daily_health_from_states(s: Surrogate) -> DataFrame:
    return _noted(M.overview(A.query_quality(*_states(s), by_day=True), ("day",))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_METRICS = ["health_score", "total_searches", "lexical_miss_rate", "dissatisfaction_rate", "zero_result_rate"]


@query(
    "compare_periods",
    "SELECT metric, before, after, round_even(after - before, 3) AS delta FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST(a.{m} AS DOUBLE) AS before, CAST(b.{m} AS DOUBLE) AS after FROM (SELECT {_OVERVIEW} FROM {{qq_a}}) a, (SELECT {_OVERVIEW} FROM {{qq_b}}) b" for m in _METRICS)
    + ")",
)
def compare_periods(s: Surrogate) -> DataFrame:
    events, shop = s.events(), s.shop()
    half = lambda a, b: M.overview(M.query_quality(M.in_period(events, a, b), shop))
    return M.compare_periods(half("2024-01-01", "2024-01-15"), half("2024-01-15", "2024-01-31"))


@query("daily_trend", "SELECT strftime(occurred_at, '%Y-%m-%d') AS day, count(*) AS searches, count(*) FILTER (result_count = 0) AS zero_results FROM {log} GROUP BY 1")
def daily_trend(s: Surrogate) -> DataFrame:
    return R.daily_trend(s.log())


@query("result_count_histogram", "SELECT result_count, count(*) AS searches FROM {log} GROUP BY 1")
def result_count_histogram(s: Surrogate) -> DataFrame:
    return R.result_count_histogram(s.log())


@query("low_engagement", "SELECT norm_query, searches, dissatisfaction_rate FROM {qq} WHERE dissatisfaction_rate >= 0.5")
def low_engagement(s: Surrogate) -> DataFrame:
    return R.low_engagement(_quality(s)).select("norm_query", "searches", "dissatisfaction_rate")


@query("zero_result_causes", "SELECT norm_query, searches, zero_result_rate, CASE WHEN coverage > 0 THEN 'retrieval gap' ELSE 'assortment gap' END AS cause FROM {qq} WHERE zero_result_rate > 0 ORDER BY zero_result_rate * searches DESC, searches DESC, norm_query LIMIT 8")
def zero_result_causes(s: Surrogate) -> DataFrame:
    return R.zero_result_causes(_quality(s)).select("norm_query", "searches", "zero_result_rate", "cause")


@query("dataset_profile", "SELECT count(*) AS searches, count(DISTINCT norm_query) AS distinct_queries, count(DISTINCT session_id) AS sessions, CAST(epoch(min(occurred_at)) AS BIGINT) AS first_s, CAST(epoch(max(occurred_at)) AS BIGINT) AS last_s, (SELECT count(*) FROM part) AS products, bool_or(clicked_rank IS NOT NULL) AS has_clicks FROM {ev}")
def dataset_profile(s: Surrogate) -> DataFrame:
    return R.dataset_profile(s.events(), s.table("product"))


@query("recent_searches", "SELECT id, raw_query, session_id FROM {ev} ORDER BY occurred_at DESC, id DESC LIMIT 20")
def recent_searches(s: Surrogate) -> DataFrame:
    return R.recent_searches(s.events(), 20).select("id", "raw_query", "session_id")


@query(
    "latest_results",
    "SELECT norm_query, coalesce(string_agg(title_en, '|' ORDER BY t.pos), '') AS results_en, coalesce(string_agg(nullif(title_ar, ''), '|' ORDER BY t.pos), '') AS results_ar FROM (SELECT norm_query, arg_max(id, (occurred_at, id)) AS id FROM {log} GROUP BY 1) l LEFT JOIN (SELECT id, pos, title_en, title_ar FROM {titles}) t USING (id) GROUP BY 1",
)
def latest_results(s: Surrogate) -> DataFrame:
    return I.latest_results(s.log()).select("norm_query", F.array_join("results_en", "|").alias("results_en"), F.array_join("results_ar", "|").alias("results_ar"))


# Terms and discovery.


@query("term_drivers", "SELECT term, searches, failing_searches, distinct_spellings, spellings, mean_severity, total_impact, coverage, verdict FROM {drivers}")
def term_drivers(s: Surrogate) -> DataFrame:
    d = D.term_drivers(_quality(s), s.shop())
    return d.select("term", "searches", "failing_searches", "distinct_spellings", F.array_join("spellings", "|").alias("spellings"), "mean_severity", "total_impact", "coverage", "verdict")


@query("top_terms", "SELECT term, total_impact, failing_searches FROM {drivers} ORDER BY total_impact DESC, failing_searches DESC, term LIMIT 25")
def top_terms(s: Surrogate) -> DataFrame:
    return D.ranked(D.term_drivers(_quality(s), s.shop())).select("term", "total_impact", "failing_searches")


@query("query_frequencies", "SELECT norm_query, CAST(searches AS BIGINT) AS searches FROM {freq}")
def query_frequencies(s: Surrogate) -> DataFrame:
    return P.query_frequencies(s.log(), s.query_count())


def _spelling(s: Surrogate) -> DataFrame:
    return P.spelling_candidates(P.query_frequencies(s.log(), s.query_count()), B.self_corrections(_kinds(s)), s.shop())


@query("spelling_candidates", "SELECT * FROM {spell} WHERE confidence >= 0.45")
def spelling_candidates(s: Surrogate) -> DataFrame:
    return _spelling(s)


@query("result_overlap", "SELECT * FROM {ovl}")
def result_overlap(s: Surrogate) -> DataFrame:
    return Y.result_overlap(Y.query_products(s.log(), s.shop()))


def _aligned(s: Surrogate) -> DataFrame:
    return Y.dice_alignment(s.product_name(), Y.searched_terms(s.log(), s.query_count()), min_dice=ALIGN)


@query("dice_alignment", "SELECT source, target, source_lang, shared, alignment FROM {dice}")
def dice_alignment(s: Surrogate) -> DataFrame:
    return _aligned(s)


@query("shared_translation", "SELECT * FROM {strans}")
def shared_translation(s: Surrogate) -> DataFrame:
    return Y.shared_translation(_aligned(s))


def _synonyms(s: Surrogate) -> DataFrame:
    return Y.synonym_candidates(B.reworded_pairs(_kinds(s)), Y.result_overlap(Y.query_products(s.log(), s.shop())), _aligned(s))


@query("synonym_candidates", "SELECT source_term, target_term, lang, confidence, signals, coalesce(observations, 0) AS observations, coalesce(shared_products, 0) AS shared_products, overlap, alignment, translation FROM {syn}")
def synonym_candidates(s: Surrogate) -> DataFrame:
    return _synonyms(s).withColumn("signals", F.array_join("signals", "|")).fillna(0, ["observations", "shared_products"])


_SPELLING_WHY = f"concat(CASE WHEN kind = 'partial_query' THEN concat({_isolated('source_term')}, ' is no catalogue word but begins ', {_isolated('target_term')}, ', which ', format('{{:,}}', target_product_count), ' products use.') ELSE concat({_isolated('source_term')}, ' names no product; ', {_isolated('target_term')}, ' is ', CAST(edit_distance AS VARCHAR), ' edits away and names ', format('{{:,}}', target_product_count), ' products.') END, CASE WHEN self_corrections > 0 THEN concat(' Shoppers re-typed it so ', CAST(self_corrections AS VARCHAR), ' times.') ELSE '' END)"
_SPELLING_JSON = "concat(chr(123), '\"searches\":', searches, ',\"edit_distance\":', edit_distance, ',\"target_product_count\":', target_product_count, ',\"source_product_count\":0,\"self_corrections_observed\":', self_corrections, chr(125))"


@query("spelling_evidence", f"SELECT kind, source_term, target_term, lang, confidence, {_SPELLING_WHY} AS rationale, {_SPELLING_JSON} AS evidence FROM {{spell}} WHERE confidence >= 0.45")
def spelling_evidence(s: Surrogate) -> DataFrame:
    """Corrections as the queue takes them."""
    return P.as_candidates(_spelling(s))


@query("ordered_corrections", "SELECT source_term, target_term, confidence FROM {spell} WHERE confidence >= 0.45 ORDER BY confidence DESC, searches DESC, source_term, target_term LIMIT 25")
def ordered_corrections(s: Surrogate) -> DataFrame:
    return P.ordered(_spelling(s)).limit(25).select("source_term", "target_term", "confidence")


_SYNONYM_WHY = f"concat('Treat ', {_isolated('source_term')}, ' and ', {_isolated('target_term')}, ' as equal: ', concat_ws('; ', CASE WHEN contains(signals, 'reworded_by_shopper') THEN concat('shoppers reworded one as the other ', observations, ' times') END, CASE WHEN contains(signals, 'result_overlap') THEN concat('their results share ', {_percent('overlap')}, ' of products') END, CASE WHEN contains(signals, 'catalogue_alignment') THEN 'product names use them for each other across languages' END, CASE WHEN contains(signals, 'shared_translation') THEN concat('both translate to ', {_isolated('translation')}) END), '.')"
_known = lambda name, c, mark="": f"CASE WHEN {c} IS NOT NULL THEN concat(',\"{name}\":{mark}', {c}, '{mark}') ELSE '' END"
_SYNONYM_JSON = f"concat(chr(123), '\"signals\":[\"', replace(signals, '|', '\",\"'), '\"]', {_known('observations', 'observations')}, {_known('shared_products', 'shared_products')}, {_known('result_overlap', 'overlap')}, {_known('alignment', 'alignment')}, " + _known("shared_translation", "translation", '"') + ", chr(125))"


@query("synonym_evidence", f"SELECT 'synonym' AS kind, source_term, target_term, lang, confidence, {_SYNONYM_WHY} AS rationale, {_SYNONYM_JSON} AS evidence FROM {{syn}}")
def synonym_evidence(s: Surrogate) -> DataFrame:
    """Pairs as the queue takes them."""
    return Y.as_candidates(_synonyms(s))


@query("ordered_synonyms", "SELECT source_term, target_term, confidence FROM {syn} ORDER BY confidence DESC, source_term, target_term LIMIT 25")
def ordered_synonyms(s: Surrogate) -> DataFrame:
    return Y.ordered(_synonyms(s)).limit(25).select("source_term", "target_term", "confidence")


# The review queue. The old queue is made from customers: every key that the new candidates also have, and others.

_STATUS = "CASE WHEN c_nationkey % 3 = 0 THEN 'pending' WHEN c_nationkey % 3 = 1 THEN 'approved' ELSE 'rejected' END"


def _old_queue(s: Surrogate) -> DataFrame:
    c = s.table("customer")
    n = F.col("c_nationkey") % 3
    rows = c.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "misspelling").otherwise("synonym").alias("kind"),
        F.concat(F.lit("t"), (F.col("c_custkey") % 700).cast("string")).alias("source_term"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("target_term"),
        F.lit("ar").alias("lang"), ((F.col("c_custkey") % 50) / 100 + 0.45).alias("confidence"), F.lit("old").alias("rationale"), F.lit("{}").alias("evidence"),
        F.when(n == 0, "pending").when(n == 1, "approved").otherwise("rejected").alias("status"), F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-01").alias("updated_at"),
        F.lit(None).cast("string").alias("reviewer"), F.lit(None).cast("string").alias("review_note"),
    )
    return rows


_OLD = f"SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'misspelling' ELSE 'synonym' END AS kind, 't' || CAST(c_custkey % 700 AS VARCHAR) AS source_term, 't' || CAST(c_custkey AS VARCHAR) AS target_term, CAST(c_custkey % 50 AS DOUBLE) / 100 + 0.45::DOUBLE AS confidence, {_STATUS} AS status FROM customer"
_NEW = "SELECT 'synonym' AS kind, 't' || CAST(o_custkey % 700 AS VARCHAR) AS source_term, 't' || CAST(o_custkey AS VARCHAR) AS target_term, max(CAST(o_orderkey % 40 AS DOUBLE)) / 100 + 0.5::DOUBLE AS confidence FROM orders GROUP BY o_custkey"


def _new_candidates(s: Surrogate) -> DataFrame:
    o = s.table("orders").groupBy("o_custkey").agg((F.max((F.col("o_orderkey") % 40).cast("double")) / 100 + 0.5).alias("confidence"))
    return o.select(F.lit("synonym").alias("kind"), F.concat(F.lit("t"), (F.col("o_custkey") % 700).cast("string")).alias("source_term"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("target_term"), F.lit("ar").alias("lang"), "confidence", F.lit("new").alias("rationale"), F.lit("{}").alias("evidence"))


@query(
    "queue_refresh",
    f"SELECT coalesce(o.id, (SELECT max(c_custkey) FROM customer) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY n.confidence DESC, n.source_term, n.target_term)) AS id, coalesce(o.kind, n.kind) AS kind, coalesce(o.source_term, n.source_term) AS source_term, coalesce(o.target_term, n.target_term) AS target_term, CASE WHEN o.id IS NULL OR (o.status = 'pending' AND n.kind IS NOT NULL) THEN n.confidence ELSE o.confidence END AS confidence, coalesce(o.status, 'pending') AS status, CASE WHEN o.id IS NULL THEN 'inserted' WHEN o.status <> 'pending' THEN 'kept' WHEN n.kind IS NULL THEN 'withdrawn' ELSE 'rescored' END AS action FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.kind = n.kind AND o.source_term = n.source_term AND o.target_term = n.target_term",
)
def queue_refresh(s: Surrogate) -> DataFrame:
    return V.refresh(_old_queue(s), _new_candidates(s), "2024-02-01").select("id", "kind", "source_term", "target_term", "confidence", "status", "action")


@query("queue_list", f"SELECT id, kind, status, confidence FROM ({_OLD}) ORDER BY status = 'pending' DESC, confidence DESC, id LIMIT 100")
def queue_list(s: Surrogate) -> DataFrame:
    return V.listed(_old_queue(s)).select("id", "kind", "status", "confidence")


@query("queue_pending_by_kind", f"SELECT kind, count(*) AS pending FROM ({_OLD}) WHERE status = 'pending' GROUP BY 1")
def queue_pending_by_kind(s: Surrogate) -> DataFrame:
    return V.pending_by_kind(_old_queue(s))


@query("queue_filters", f"SELECT id, kind, status, confidence FROM ({_OLD}) WHERE status = 'approved' AND kind = 'synonym' ORDER BY confidence DESC, id LIMIT 100")
def queue_filters(s: Surrogate) -> DataFrame:
    return V.listed(_old_queue(s), "approved", "synonym").select("id", "kind", "status", "confidence")


@query("queue_decision", f"SELECT id, CASE WHEN id = 1 THEN 'rejected' ELSE status END AS status, CASE WHEN id = 1 THEN 'me' END AS reviewer, CASE WHEN id = 1 THEN 'no' END AS review_note FROM ({_OLD})")
def queue_decision(s: Surrogate) -> DataFrame:
    return V.decide(_old_queue(s), 1, "reject", "2024-02-02", "me", "no").select("id", "status", "reviewer", "review_note")


@query("queue_status_counts", f"SELECT kind, status, count(*) AS suggestions FROM ({_OLD}) GROUP BY 1, 2")
def queue_status_counts(s: Surrogate) -> DataFrame:
    return V.status_counts(_old_queue(s))


@query(
    "synonym_groups",
    "SELECT v AS term, min(g) AS group_term FROM reach GROUP BY v",
    f"links AS (SELECT source_term AS a, target_term AS b FROM ({_OLD}) WHERE status = 'approved' AND kind = 'synonym' UNION SELECT target_term, source_term FROM ({_OLD}) WHERE status = 'approved' AND kind = 'synonym'), reach AS (SELECT a AS v, a AS g FROM links UNION SELECT l.b, r.g FROM reach r JOIN links l ON l.a = r.v)",
)
def synonym_groups(s: Surrogate) -> DataFrame:
    return V.synonym_groups(_old_queue(s))


@query("export_rules", f"SELECT kind, source_term, arg_min(target_term, (confidence, -id)) AS target_term FROM ({_OLD}) WHERE status = 'approved' AND kind <> 'synonym' GROUP BY 1, 2")
def export_rules(s: Surrogate) -> DataFrame:
    return V.rules(_old_queue(s))


# Reporting tables.


@query("fact_search", "SELECT e.id, e.norm_query, strftime(e.occurred_at, '%Y-%m-%d') AS date, CAST(hour(e.occurred_at) AS INTEGER) AS hour, e.result_count, CAST(e.result_count = 0 AS INTEGER) AS is_zero, CAST(q.is_problem AS INTEGER) AS is_problem, q.severity FROM {ev} e LEFT JOIN {qq} q USING (norm_query)")
def fact_search(s: Surrogate) -> DataFrame:
    events = s.events()
    return R.fact_search(events, M.query_quality(events, s.shop())).select("id", "norm_query", "date", "hour", "result_count", "is_zero", "is_problem", "severity")


@query("dim_query", f"SELECT norm_query, searches, severity, impact, CAST(is_problem AS INTEGER) AS is_problem, CAST(retrieval_gap AS INTEGER) AS retrieval_gap, len(string_split(concat_ws('|', 'x', {_REASONS}), '|')) - 1 AS reason_count, display_query, sessions, coverage, intended_term, mean_results, zero_result_rate, lexical_miss_rate, dissatisfaction_rate FROM {{qq}}")
def dim_query(s: Surrogate) -> DataFrame:
    return R.dim_query(_quality(s)).select("norm_query", "searches", "severity", "impact", "is_problem", "retrieval_gap", F.col("reason_count").cast("bigint").alias("reason_count"), "display_query", "sessions", "coverage", "intended_term", "mean_results", "zero_result_rate", "lexical_miss_rate", "dissatisfaction_rate")


@query("dim_term", "SELECT term, searches, failing_searches, spellings, verdict FROM (SELECT *, replace(spellings, '|', ' | ') AS sp FROM {drivers}) ORDER BY total_impact DESC, failing_searches DESC, term LIMIT 200")
def dim_term(s: Surrogate) -> DataFrame:
    d = R.dim_term(D.term_drivers(_quality(s), s.shop()))
    return d.select("term", "searches", "failing_searches", F.replace("spellings", F.lit(" | "), F.lit("|")).alias("spellings"), "verdict")


@query("fact_daily", f"SELECT day, {_OVERVIEW} FROM {{qq_day}} GROUP BY day")
def fact_daily(s: Surrogate) -> DataFrame:
    return R.fact_daily(s.events(), s.shop()).withColumn("notes", F.replace("notes", F.lit(" | "), F.lit("|")))


@query("dim_overview", f"SELECT {_OVERVIEW} FROM {{qq}}")
def dim_overview(s: Surrogate) -> DataFrame:
    return R.dim_overview(_quality(s)).withColumn("notes", F.replace("notes", F.lit(" | "), F.lit("|")))


@query("fact_suggestion", f"SELECT id, kind, source_term, target_term, confidence, status FROM ({_OLD})")
def fact_suggestion(s: Surrogate) -> DataFrame:
    return R.fact_suggestion(_old_queue(s)).select("id", "kind", "source_term", "target_term", "confidence", "status")


@query("zero_result_view", "SELECT norm_query, searches, zero_result_rate FROM {qq} WHERE zero_result_rate > 0")
def zero_result_view(s: Surrogate) -> DataFrame:
    return R.zero_result_view(_quality(s)).select("norm_query", "searches", "zero_result_rate")


@query("text_filter", "SELECT norm_query, searches FROM {qq} WHERE contains(lower(display_query), 're')")
def text_filter(s: Surrogate) -> DataFrame:
    return R.matching(_quality(s), "RE").select("norm_query", "searches")


@query("sorted_nulls_last", "SELECT norm_query, dissatisfaction_rate FROM (SELECT norm_query, dissatisfaction_rate FROM {qq} ORDER BY dissatisfaction_rate DESC NULLS LAST, norm_query LIMIT 40)")
def sorted_nulls_last(s: Surrogate) -> DataFrame:
    return R.sorted_by(_quality(s), "dissatisfaction_rate").orderBy(F.desc_nulls_last("dissatisfaction_rate"), "norm_query").limit(40).select("norm_query", "dissatisfaction_rate")


@query("similarity", "SELECT a.term AS a, b.term AS b, 1 - damerau_levenshtein(a.term, b.term) / CAST(greatest(length(a.term), length(b.term)) AS DOUBLE) AS similarity FROM {words} a JOIN (SELECT DISTINCT term FROM {vocab}) b ON abs(length(a.term) - length(b.term)) <= 2 AND damerau_levenshtein(a.term, b.term) <= 2")
def similarity(s: Surrogate) -> DataFrame:
    return edit_distance(s).select("a", "b", T.similarity("a", "b").alias("similarity"))


@query("split_lines", "SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e]'), lambda x: trim(x)), lambda x: length(x) > 0)) AS lines FROM documents")
def split_lines(s: Surrogate) -> DataFrame:
    return s.table("documents").select("doc_id", F.size(T.split_lines("text")).cast("bigint").alias("lines"))


@query("isolated_names", "SELECT p_partkey, concat(chr(8296), p_name, chr(8297)) AS shown, p_name AS plain FROM part")
def isolated_names(s: Surrogate) -> DataFrame:
    shown = T.isolate("p_name")
    return s.table("part").select("p_partkey", shown.alias("shown"), T.strip_isolates(shown).alias("plain"))


_LOGGED = "CASE l_returnflag WHEN 'A' THEN strftime(l_shipdate, '%Y-%m-%d') || ' 10:00:00' WHEN 'N' THEN strftime(l_shipdate, '%Y-%m-%d') || ' 10:00:00.5' END"


@query("load_report", "SELECT 'product' AS \"table\", count(*) FILTER (p_size <= 45) AS emitted, count(*) FILTER (p_size > 45) AS skipped, CAST(count(*) FILTER (p_size > 48) AS BIGINT) AS no_id, CAST(count(*) FILTER (p_size > 45 AND p_size <= 48) AS BIGINT) AS bad_price FROM part")
def load_report(s: Surrogate) -> DataFrame:
    """Parts as dump rows, some without a number for an id and some with a price that is none."""
    cell = F.when(F.col("p_size") > 48, F.lit("none")).otherwise(F.col("p_partkey").cast("string"))
    price = F.when(F.col("p_size") > 45, F.lit("dear")).otherwise(F.col("p_retailprice").cast("string"))
    null = F.lit(None).cast("string")
    source = s.table("part").select(F.lit("catalog_product").alias("table"), F.array(cell, null, F.lit("sku"), null, null, F.lit("key"), price, null).alias("cols"))
    report = I.build(source)[1].where("table = 'product'")
    count = lambda why: F.coalesce(F.try_element_at("reasons", F.lit(why)), F.lit(0).cast("bigint"))
    return report.select("table", "emitted", "skipped", count("no valid id").alias("no_id"), count("malformed price").alias("bad_price"))


@query("language_codes", "SELECT lang, CASE lang WHEN 'en' THEN 'en' WHEN 'ar' THEN 'ar' END AS code, count(*) AS docs FROM documents GROUP BY 1, 2")
def language_codes(s: Surrogate) -> DataFrame:
    code = I.language_code(F.concat(F.lit("  "), F.upper("lang"), F.lit(" ")))
    return s.table("documents").groupBy("lang", code.alias("code")).agg(F.count("*").alias("docs"))


@query("parsed_times", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(epoch_us(CAST({_LOGGED} AS TIMESTAMP)) AS BIGINT) AS micros FROM lineitem")
def parsed_times(s: Surrogate) -> DataFrame:
    """Times with and without fractions; a bare date is none."""
    day, flag = F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_returnflag")
    text = F.when(flag == "A", F.concat(day, F.lit(" 10:00:00"))).when(flag == "N", F.concat(day, F.lit(" 10:00:00.5"))).otherwise(day)
    return s.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_micros(I.parse_time(text).cast("timestamp")).alias("micros"))


@query("top_demand", "SELECT norm_query, searches FROM {rolled} ORDER BY searches DESC, norm_query LIMIT 15")
def top_demand(s: Surrogate) -> DataFrame:
    return R.top_demand(s.log())


@query("severity_bands", "SELECT CASE WHEN severity >= 0.5 THEN 'severe' WHEN severity >= 0.3 THEN 'needs attention' ELSE 'healthy' END AS band, count(*) AS queries, CAST(sum(searches) AS BIGINT) AS searches FROM {qq} GROUP BY 1")
def severity_bands(s: Surrogate) -> DataFrame:
    return R.severity_bands(_quality(s))


@query("digest_markdown")
def digest_markdown(s: Surrogate) -> DataFrame:
    spark = s.spark
    d = R.digest(s.events(), s.shop(), _old_queue(s), days=7)
    return spark.createDataFrame([(d["period_start"], d["period_end"], d["body_md"])], "period_start string, period_end string, body_md string")


@query("dump_scan_roundtrip", "SELECT 'catalog_product' AS \"table\", p_partkey AS id, concat('it''s ', p_name, chr(10), 'INSERT INTO x; \\ ', p_type) AS name, CAST(NULL AS VARCHAR) AS nothing FROM part")
def dump_scan_roundtrip(s: Surrogate) -> DataFrame:
    """Parts written as a dump, in statements of two rows over several lines, and read back by the dump source."""
    from queryvitals.plans.stage import shared_folder
    from queryvitals.sources.dump import read_dump

    said = F.concat(F.lit("it\\'s "), "p_name", F.lit("\nINSERT INTO x; \\\\ "), "p_type")
    row = F.concat(F.lit("("), F.col("p_partkey").cast("string"), F.lit(",'x','"), said, F.lit("',NULL)"))
    text = F.concat(F.lit("INSERT INTO `catalog_product` VALUES "), row, F.lit(",\n"), F.replace(row, F.concat(F.lit("("), F.col("p_partkey").cast("string")), F.lit("(-")), F.lit(";\nCREATE TABLE `z`;\nINSERT INTO `skipped` VALUES (1,'a;b');"))
    folder = f"{shared_folder(s.spark)}/dump-{uuid.uuid4().hex}"
    s.table("part").select(text.alias("value")).write.text(folder)
    return read_dump(s.spark, f"{folder}/*.txt", ["catalog_product"]).where("cols[0] <> '-'").select("table", F.col("cols")[0].cast("bigint").alias("id"), F.col("cols")[2].alias("name"), F.col("cols")[3].alias("nothing"))


@query("ask_planner")
def ask_planner(s: Surrogate) -> DataFrame:
    from queryvitals.plans.planner import Planner

    planner = Planner(s.events(), s.shop(), _old_queue(s))
    asked = ["How healthy is search?", "What are the worst queries?", "What searches came in recently?", "What does the data cover?"]
    return s.spark.createDataFrame([(q, *planner.ask(q)) for q in asked], "question string, tool string, answer string")
