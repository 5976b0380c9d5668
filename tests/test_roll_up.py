"""Scores of large logs: tasks add up in hash tables, and each search meets its answer once."""

import contextlib
import io

from pyspark.sql import functions as F

from queryvitals.operators import behaviour as B
from queryvitals.operators import events as E
from queryvitals.operators import metrics as M
from queryvitals.sources.surrogate import Surrogate

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_searches_are_not_multiplied_or_sorted_to_be_counted(spark):
    s = Surrogate(spark, SF)
    text = plan(M.roll_up(E.event_quality(B.follow_ups(s.events()), s.shop())))
    assert "Expand" not in text
    # Each search once for the answers and once for its followers, never one row for each of its results.
    assert "Generate" not in text


def test_answers_give_what_single_searches_give(spark):
    s = Surrogate(spark, SF)
    events, shop = s.events(), s.shop()
    titles = E.result_titles(events)
    rates = {r["id"]: r["lexical_hit_rate"] for r in E.lexical_hits(titles).collect()}
    alike = {r["id"]: (r["coherence"], r["dominant_category"]) for r in E.coherence(E.resolved(titles, shop.title_map), shop.product_category, shop.usable_categories, shop.category_labels).collect()}
    rows = E.event_quality(events, shop).collect()
    assert len(rows) == events.count() and len(alike) > 100
    for r in rows:
        assert r["lexical_hit_rate"] == rates.get(r["id"], 0.0)
        assert (r["coherence"], r["dominant_category"]) == alike.get(r["id"], (None, None))


def test_first_values_go_by_time_then_id(spark):
    time = "2024-01-01 00:00:0"
    rows = [(12, "B", time + "1", None, "s1", "x"), (3, "C", time + "1", "late", "s1", "y"), (4, "A", time + "1", "later", "s2", "x"), (1, "D", time + "2", "last", None, None), (-7, "E", time + "3", None, "s2", "x")]
    df = spark.createDataFrame(rows, "id bigint, raw_query string, at string, dominant_category string, session_id string, result_signature string")
    more = {
        "norm_query": F.lit("q"), "occurred_at": F.col("at").cast("timestamp_ntz"), "script": F.lower("raw_query"), "intended_term": F.lit(None).cast("string"), "result_count": F.col("id").cast("int"),
        "coherence": F.lit(0.5), "follow_up": F.lit("none"), "clicked_rank": F.lit(None).cast("int"), "coverage": F.lit(1), "intended_coverage": F.lit(0), "correction_distance": F.lit(None).cast("int"),
    }
    flags = {c: F.lit(False) for c in ("zero_results", "lexical_miss", "rapid_repeat", "dissatisfied", "retrieval_gap", "under_filled")}
    one = M.roll_up(df.withColumns(more | flags)).first()
    assert (one["display_query"], one["script"], one["dominant_category"], one["intended_term"]) == ("C", "c", "late", None)
    assert (one["searches"], one["sessions"], one["x_mean_results"], one["min_results"], one["x_instability"]) == (5, 2, 2.6, -7, 0.25)


def test_folded_titles_mention_as_their_words_do(spark):
    from queryvitals.functions import text as T

    words = ["a", "ab", "abc", "abcd", "bc", "xabc", ""]
    pairs = [(f"{a} {b}".strip(), f"{c} {d}".strip()) for a in words for b in words for c in words for d in words]
    df = spark.createDataFrame(pairs, "query string, title string")
    terms, padded = T.raw_tokens("query"), F.concat(F.lit(" "), "title", F.lit(" "))
    got = df.select(T.mentions(terms, T.raw_tokens("title")).alias("a"), F.exists(T.needles(terms), lambda w: F.contains(padded, w)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and any(r["a"] for r in got) and not all(r["a"] for r in got)


def test_distances_are_not_computed_for_each_search(spark):
    kinds = B.reformulation_kinds(B.follow_ups(Surrogate(spark, SF).events()))
    for tally in (B.reworded_pairs(kinds), B.self_corrections(kinds)):
        assert "levenshtein" not in plan(tally).lower() and tally.count() > 0
