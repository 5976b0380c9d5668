import contextlib
import io

import pytest

from queryvitals.plans.planner import Planner, date_ranges
from queryvitals.plans.queries import ORACLES, QUERIES
from queryvitals.streaming import live

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["normalize_documents", "follow_up", "lexical_hit_rate", "nearest_term", "result_overlap", "dice_alignment"])
def test_hot_paths_stay_native(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "CartesianProduct" not in text


def test_scan_reads_the_columns_it_needs(spark):
    text = plan(QUERIES["normalize_documents"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize("name", sorted(set(ORACLES) & {"vocabulary", "sessionize_global", "nearest_term", "query_quality", "queue_refresh", "synonym_groups"}))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("part", "events", "customer", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    answer = c.sql(ORACLES[name])
    names, want = answer.columns, answer.fetchall()
    got = QUERIES[name](spark, SF).select(*names).collect()
    plain = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(got) == plain(want)


def test_routing():
    p = Planner.__new__(Planner)
    p.named_query = lambda q: "milk" if "milk" in q else None
    assert p.plan("How healthy is search?") == ("health", {})
    assert p.plan("What is wrong with milk?") == ("detail", {"query": "milk"})
    assert p.plan("Do we stock milk?") == ("coverage", {"term": "milk"})
    assert p.plan("any synonym suggestions?")[0] == "suggestions"
    assert p.plan("latest searches")[0] == "recent"
    assert p.plan("compare 2025-03-01 2025-03-07 with 2025-03-08 2025-03-14")[0] == "compare"
    assert date_ranges(["2025-03-08", "2025-03-14"]) == (("2025-03-01", "2025-03-07"), ("2025-03-08", "2025-03-14"))


def test_live_sessions_and_follow_ups(spark, tmp_path):
    schema = "user_id bigint, id bigint, ts timestamp, norm_query string"
    rows = [(1, 1, "2024-01-01 00:00:00", "a"), (1, 2, "2024-01-01 00:00:30", "a"), (1, 3, "2024-01-01 00:02:00", "b"), (2, 4, "2024-01-01 00:01:00", "c")]
    late = [(1, 5, "2024-01-01 05:00:00", "z"), (2, 6, "2024-01-01 05:00:00", "z")]
    last = [(3, 7, "2024-01-01 09:00:00", "z")]
    for i, part in enumerate((rows, late, last)):
        spark.createDataFrame(part, "user_id bigint, id bigint, t string, norm_query string").selectExpr("user_id", "id", "CAST(t AS timestamp) AS ts", "norm_query").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for name, df in (("live_s", live.live_sessions(stream)), ("live_f", live.live_follow_ups(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    sessions = {(r["user_id"], r["searches"]) for r in spark.table("live_s").collect()}
    assert {(1, 3), (2, 1)} <= sessions
    found = {r["id"]: r["follow_up"] for r in spark.table("live_f").collect()}
    assert found[1] == "repeat" and found[2] == "reformulation" and found[3] in ("new_intent", "none")
