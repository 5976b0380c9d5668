"""The whole engine over a mock dump: loading, scores, discovery, the queue, reports, the service's three faces."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from queryvitals import api, cli
from queryvitals.operators import behaviour as B
from queryvitals.operators import metrics as M
from queryvitals.operators import reports as R
from queryvitals.operators import review as V
from queryvitals.operators import sessions as S
from queryvitals.schemas import Settings
from queryvitals.service import Service
from queryvitals.sources.sample import generate


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    path = folder / "mock.sql"
    path.write_text(generate(days=8), encoding="utf-8")
    s = Service(spark, Settings(store=str(folder / "store")))
    assert not s.store.exists()
    with pytest.raises(api.HttpError) as e:
        api.handle(s, "GET", "/api/overview")
    assert e.value.status == 503
    s.load_dump(str(path))
    return s


@pytest.fixture(scope="module")
def quality(service):
    return service.quality()


def test_load(service):
    counts = {t: service.store.read(t).count() for t in ("product", "product_name", "category", "search_event")}
    assert counts["product"] == 240 and counts["product_name"] == 480 and counts["category"] == 6 and counts["search_event"] > 48
    assert service.store.read("catalog_term").where("term = 'honey' AND lang = 'en'").first()["product_count"] == 20
    assert service.store.read("search_event").select("session_id").distinct().count() == 48


def test_quality_properties(quality):
    rows = quality.collect()
    total = sum(r["searches"] for r in rows)
    for r in rows:
        assert 0 <= r["severity"] <= 1 and r["is_problem"] == (r["severity"] >= 0.3)
        assert r["impact"] == pytest.approx(r["x_severity"] * r["searches"] / total, abs=1e-4)
        assert r["engagement_rate"] is None
    assert sum(M.WEIGHTS.values()) == pytest.approx(1)


def test_severity_leaves_out_what_was_not_measured(spark):
    one = spark.range(1).select(M.severity({k: F.lit(None).cast("double") if k == "incoherence" else F.lit(1.0) for k in M.WEIGHTS}).alias("s"))
    assert one.first()["s"] == pytest.approx(1.0)


def test_days_add_up(service):
    events = service.events()
    daily = M.daily_health(events, service.shop()).collect()
    assert sum(r["total_searches"] for r in daily) == events.count()
    day = daily[0]["day"]
    alone = M.overview(service.quality(f"{day} 00:00:00", f"{day} 23:59:59")).first()
    assert alone["health_score"] == daily[0]["health_score"]


def test_empty_period(service):
    r = service.overview("2031-01-01").first()
    assert r["total_searches"] == 0 and r["health_score"] == 100.0 and r["engagement_source"] == "no data"


def test_verdicts(service):
    found = {r["term"]: r["verdict"] for r in service.terms(100).collect()}
    assert found.get("umbrella", "assortment gap") == "assortment gap"
    assert found.get("len", "partial query") == "partial query"


def test_discovery_and_queue(service):
    counts = service.discover()
    assert set(counts) == {"inserted"}
    rows = {(r["kind"], r["source_term"]): r for r in service.queue().collect()}
    assert rows[("misspelling", "hony")]["target_term"] == "honey"
    assert rows[("partial_query", "napkin")]["target_term"] == "napkins"
    assert any(k == "synonym" and {"honey", "عسل"} == {s, r["target_term"]} for (k, s), r in rows.items())
    first, second = sorted(r["id"] for r in rows.values())[:2]
    service.decide(first, "approve", reviewer="me", note="yes")
    service.decide(second, "reject")
    assert service.discover().get("kept") == 2
    again = {r["id"]: r for r in service.queue().collect()}
    assert again[first]["status"] == "approved" and again[first]["reviewer"] == "me" and again[second]["status"] == "rejected"
    service.decide(first, "reopen")
    assert {r["id"]: r for r in service.queue().collect()}[first]["reviewer"] is None
    with pytest.raises(ValueError):
        service.decide(first, "maybe")
    with pytest.raises(KeyError):
        service.decide(10**9, "approve")


def test_unsupported_pending_rows_go_and_decided_rows_stay(spark):
    old = spark.createDataFrame(
        [(1, "synonym", "a", "b", "ar", 0.5, "", "{}", "pending", "x", "x", None, None), (2, "synonym", "c", "d", "ar", 0.5, "", "{}", "approved", "x", "x", None, None)], V.QUEUE
    )
    none = spark.createDataFrame([], "kind string, source_term string, target_term string, lang string, confidence double, rationale string, evidence string")
    kept = V.kept(V.refresh(old, none, "now")).collect()
    assert [r["id"] for r in kept] == [2]


def test_groups_are_transitive(spark):
    chain = [(i, "synonym", f"t{i:02d}", f"t{i + 1:02d}", "ar", 0.9, "", "{}", "approved", "", "", None, None) for i in range(9)]
    q = spark.createDataFrame([*chain, (50, "synonym", "x", "y", "ar", 0.9, "", "{}", "approved", "", "", None, None)], V.QUEUE)
    assert V.export(q)["synonyms"] == [[f"t{i:02d}" for i in range(10)], ["x", "y"]]


def test_sessions_across_buckets(spark):
    seconds = [0, 1800, 3601, 3602, 9000, 9000, 20_000, 21_800, 21_801]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = [r["session_no"] for r in S.sessionize(rows).orderBy("id").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 4]


def test_rapid_repeats_are_not_dissatisfied(spark):
    rows = [(1, "s", "a", "x", 0), (2, "s", "a", "x", 1), (3, "s", "a", "y", 2), (4, "s", "ab", "y", 50), (5, "s", "zz", "y", 500)]
    events = spark.createDataFrame(rows, "id bigint, session_id string, norm_query string, result_signature string, t bigint").withColumn("occurred_at", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = {r["id"]: r for r in B.reformulation_kinds(B.follow_ups(events)).collect()}
    assert [got[i]["follow_up"] for i in range(1, 6)] == ["repeat", "repeat", "reformulation", "new_intent", "none"]
    assert [got[i]["rapid_repeat"] for i in range(1, 6)] == [True, False, False, False, False]
    assert [got[i]["dissatisfied"] for i in range(1, 6)] == [False, True, True, False, False]
    assert got[3]["reformulation"] == "refinement"


def test_api(service):
    get = lambda p: api.handle(service, "GET", p)
    assert get("/api/status")["ready"]
    assert get("/api/overview")["total_searches"] == service.events().count()
    top = get("/api/queries?limit=3")
    assert len(top) == 3 and get(f"/api/queries/{top[0]['norm_query']}")["searches"] == top[0]["searches"]
    for path, status in (("/api/queries/never", 404), ("/api/queries?limit=0", 422), ("/api/terms?limit=x", 422), ("/api/bi/none", 404), ("/nowhere", 404)):
        with pytest.raises(api.HttpError) as e:
            get(path)
        assert e.value.status == status
    assert get("/api/catalogue/honey")["coverage"] == 20
    with pytest.raises(api.HttpError):
        api.handle(service, "POST", "/api/ask", {"question": " "})
    assert api.handle(service, "POST", "/api/ask", {"question": "How healthy is search?"})["tool"] == "health"


def test_api_says_what_it_refuses_and_describes_its_tools(service):
    with pytest.raises(api.HttpError) as e:
        api.handle(service, "GET", "/api/digest?format=pdf")
    assert e.value.status == 422
    tools = {t["name"]: t for t in api.handle(service, "GET", "/api/agent/tools")}
    assert tools["detail"]["parameters"]["required"] == ["query"] and all(t["description"] for t in tools.values())
    last, start = service.period(3)[1], service.period(3)[0]
    within = api.handle(service, "GET", "/api/overview?days=3")["total_searches"]
    assert within == service.events(start, last).count() < service.events().count() and service.period(None) == (None, None)


def test_load_report_by_reason(spark):
    from queryvitals.operators import ingest as I

    rows = [("catalog_product", ["1", None, "s", None, None, "k", "2.5", None]), ("catalog_product", ["x", None, "s", None, None, "k", "2.5", None]), ("catalog_product", ["3", None, "s", None, None, "k", "dear", None]), ("catalog_productname", ["1", "name", "Klingon", "t", "1"])]
    tables, report = I.build(spark.createDataFrame(rows, "table string, cols array<string>"))
    found = {r["table"]: r for r in report.collect()}
    assert (found["product"]["emitted"], found["product"]["skipped"]) == (1, 2)
    assert found["product"]["reasons"] == {"no valid id": 1, "malformed price": 1} and found["product_name"]["reasons"] == {"no valid lang": 1}
    assert tables["product"].count() == 1


def test_store_keeps_unchanged_tables_and_loses_no_change(spark, tmp_path):
    from queryvitals.schemas import TABLES
    from queryvitals.sources.store import Store

    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    row = lambda i: spark.createDataFrame([(str(i), "v")], TABLES["meta"])
    a.write({"meta": row(1), "query_count": spark.createDataFrame([("q", "q", 1)], TABLES["query_count"])})
    kept = a.versions("query_count")
    b.write({"meta": row(2)})
    assert a.version() == 2 and a.versions("query_count") == kept and a.meta() == {"2": "v"}
    # Another writer takes the number between the look and the rename: its table must stay.
    seen = iter([2, 3])
    b.version = lambda: next(seen)
    a.write({"category": spark.createDataFrame([(7, None)], TABLES["category"])})
    b.write({"meta": row(3)})
    assert a.version() == 4 and a.read("category").count() == 1 and a.meta() == {"3": "v"}
    assert len(a.collect(1)) == 2 and a.meta() == {"3": "v"} and a.read("query_count").count() == 1


def test_numbers_follow_the_order(spark):
    from queryvitals.plans.stage import numbered

    rows = numbered(spark.range(1000).repartition(7).selectExpr("id", "id % 10 AS g"), ["g", F.desc("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001))
    assert [(r["g"], r["id"]) for r in rows] == sorted(((i % 10, i) for i in range(1000)), key=lambda x: (x[0], -x[1]))


def test_overlap_by_prefixes_finds_every_pair(spark):
    import random

    from queryvitals.operators import synonyms as Y

    rng = random.Random(4)
    sets = {f"q{i}": {p for p in range(30) if rng.random() < rng.choice([0.1, 0.3, 0.6])} | {99} for i in range(60)}
    rows = spark.createDataFrame([(q, p) for q, ps in sets.items() for p in ps], "norm_query string, product_id bigint")
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}
    assert {(r["source"], r["target"], r["shared"]) for r in Y.result_overlap(rows).collect()} == want


def test_reports(service, tmp_path):
    assert cli.main(["--store", service.settings.store, "export-bi", str(tmp_path / "bi")], service.spark) == 0
    manifest = json.loads((tmp_path / "bi" / "manifest.json").read_text())
    assert {t["name"] for t in manifest["tables"]} == {"fact_search", "dim_query", "dim_term", "fact_daily", "fact_suggestion", "dim_overview"}
    for t in manifest["tables"]:
        rows = []
        for file in t["files"]:
            raw = (tmp_path / "bi" / file).read_bytes()
            assert raw.startswith(b"\xef\xbb\xbf") and raw.endswith(b"\r\n") and b"true" not in raw
            header, *own = csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""))
            assert header == t["columns"] or (header == ["(empty)"] and not own)
            rows += own
        assert len(rows) == t["rows"]
    assert next(t for t in manifest["tables"] if t["name"] == "fact_search")["rows"] == service.events().count()
    assert not (tmp_path / "bi" / "queryvitals.pbids").exists()
    few = {"fact_suggestion": service.tables()["fact_suggestion"].limit(0)}
    assert R.export_tables(few, f"file://{tmp_path}/served", "https://host/bi/") == {"fact_suggestion": 0}
    assert (tmp_path / "served" / "fact_suggestion" / "part-00000.csv").read_bytes() == b"\xef\xbb\xbf(empty)\r\n"
    assert json.loads((tmp_path / "served" / "queryvitals.pbids").read_text())["connections"][0]["details"]["address"]["url"] == "https://host/bi/manifest.json"
    d = service.digest(3)
    assert "health stands at" in d["body_md"] and "| health_score |" in d["body_md"] and service.store.read("digest").count() == 1
    service.digest(3)
    assert service.store.read("digest").count() == 1
    cli.site(service, str(tmp_path / "site"))
    index = json.loads((tmp_path / "site" / "index.json").read_text())
    details = [x for f in index["query-details"]["files"] for x in json.loads((tmp_path / "site" / f).read_text(encoding="utf-8"))]
    assert index["query-details"]["rows"] == len(details) and (tmp_path / "site" / "digest-7.json").exists()
    assert len(details) == service.quality().count() and "results_en" in details[0]


def test_what_is_derived_from_the_catalogue_outlives_the_process(spark, service):
    from queryvitals.operators import catalog as C
    from queryvitals.operators.shop import DERIVED

    tables = [table for table, _ in DERIVED.values()]
    service.shop()
    before = service.store.versions(*tables)
    other = Service(spark, service.settings)
    shop = other.shop()
    assert other.store.versions(*tables) == before and set(shop.derived) == set(DERIVED)
    asked = spark.createDataFrame([("hony",), ("sesamme",), ("lentils",), ("wal",), ("zzzz",)], "term string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    fresh = C.vocabulary(shop.product_name)
    assert rows(C.nearest_terms(asked, shop.vocabulary, near_by=shop.reach)) == rows(C.nearest_terms(asked, fresh)) != []
    assert rows(C.completions(asked, shop.vocabulary, best=shop.best_completions)) == rows(C.completions(asked, fresh)) != []
    assert rows(shop.title_map) == rows(C.title_map(shop.product_name))
    # Other names make other tables, which the first process then sees as well.
    other.store.write({"product_name": other.store.read("product_name").where("product_id > 20")})
    assert service.shop().vocabulary.where("term = 'lentils'").count() == 0 and service.store.versions(*tables) != before
    assert Service(spark, service.settings).shop() is not None


def test_cli(service, tmp_path, capsys):
    assert cli.main([]) == 1
    assert cli.main(["--store", str(tmp_path / "s"), "etl", str(tmp_path / "no.sql")], service.spark) == 2
    assert cli.main(["--store", service.settings.store, "status"], service.spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["ready"]


def test_settings():
    assert Settings.from_environment({"QUERYVITALS_RESULT_CAP": "3"}).result_cap == 3
    with pytest.raises(ValueError):
        Settings.from_environment({"QUERYVITALS_RESULT_CAP": "x"})
