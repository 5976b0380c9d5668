"""Followers and sessions by user against one ordered pass, with hot keys; period bounds that prune the store's days."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from queryvitals.operators import behaviour as B
from queryvitals.operators import metrics as M
from queryvitals.operators import sessions as S
from queryvitals.sources.store import Store


def log(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, session_id string, user string, norm_query string, result_signature string, us bigint")
    return df.withColumn("occurred_at", F.timestamp_micros("us").cast("timestamp_ntz"))


def mostly_without_session(n=1500, seed=3):
    """Nine of ten searches have no session; many share a time; some gaps are longer than any bucket."""
    rng, at, rows = random.Random(seed), 1_700_000_000_000_000, []
    for i in range(n):
        at += rng.choice([0, 0, 500_000, 1_500_000, 40_000_000, 290_000_000, 301_000_000, 2_000_000_000, 90_000_000_000])
        rows.append((i, None if rng.random() < 0.9 else f"s{rng.randint(1, 20):04d}", rng.choice(["bot"] * 6 + ["u1", "u2", None]), rng.choice("abc"), rng.choice("xy"), at))
    rng.shuffle(rows)
    return rows


def brute_followers(rows):
    sessions = {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        sessions.setdefault(r[1] or "s0000", []).append(r)
    out = {}
    for held in sessions.values():
        for r, after in zip(held, [*held[1:], None], strict=True):
            if after is None:
                out[r[0]] = ("none", None, None, False, False)
                continue
            gap = (after[5] - r[5]) / 1e6
            kind = "new_intent" if gap > 300 else "repeat" if after[3] == r[3] else "reformulation"
            rapid = kind == "repeat" and after[4] == r[4] and gap < 2
            out[r[0]] = (kind, after[3], gap, rapid, not rapid and kind in ("repeat", "reformulation"))
    return out


@pytest.mark.parametrize("bucket", [1, 60, 900, 10**6])
def test_followers_with_most_searches_in_one_session(spark, bucket):
    rows = mostly_without_session()
    made = B.follow_ups(log(spark, rows), bucket_seconds=bucket)
    got = {r["id"]: (r["follow_up"], r["next_norm_query"], r["seconds_to_next"], r["rapid_repeat"], r["dissatisfied"]) for r in made.collect()}
    assert got == brute_followers(rows)


def test_no_task_gets_more_of_a_session_than_a_bucket(spark):
    """Windows over searches are dealt by session and bucket; what is dealt by session alone has one row a bucket."""
    rows = [(i, None, "u", "a", "x", 1_700_000_000_000_000 + i * 1_000_000) for i in range(4000)]
    made = B.follow_ups(log(spark, rows), bucket_seconds=100)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[(.*)\]", plan)
    assert len(windows) == 2 and all("_bucket" in w for w in windows)
    inside = next(w for w in windows if "_first" not in w)
    assert re.search(r"windowspecdefinition\(_session#\d+, _bucket#\d+", inside)
    largest = log(spark, rows).groupBy(F.floor(F.col("us") / 100_000_000)).count().agg(F.max("count")).first()[0]
    assert largest <= 100


def test_followers_by_day_and_empty(spark):
    rows = mostly_without_session(400)
    dated = log(spark, rows).withColumn("day", F.to_date("occurred_at"))
    got = {r["id"]: r["follow_up"] for r in B.follow_ups(dated, ("day",), 60).collect()}
    want = {}
    for day in {r[5] // 86_400_000_000 for r in rows}:
        want |= {k: v[0] for k, v in brute_followers([r for r in rows if r[5] // 86_400_000_000 == day]).items()}
    assert got == want
    assert B.follow_ups(log(spark, [])).count() == 0


@pytest.mark.parametrize("gap", [30, 1800])
def test_sessions_of_a_bot_and_of_no_user(spark, gap):
    rows = mostly_without_session()
    got = {r["id"]: r["session_no"] for r in S.sessionize_by(log(spark, rows).withColumn("ts", F.col("occurred_at")), "user", gap_seconds=gap).collect()}
    want, last, number = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        if r[2] not in last or r[5] - last[r[2]] > gap * 1_000_000:
            number[r[2]] = number.get(r[2], 0) + 1
        last[r[2]], want[r[0]] = r[5], number[r[2]]
    assert got == want


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=7 * i, microseconds=i)) for i in range(60)] + [(100, datetime(2024, 1, 9)), (101, datetime(2024, 1, 9, 0, 0, 0, 5)), (102, datetime(2024, 1, 8, 23, 59, 59, 999_999))]
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    df = spark.createDataFrame([(i, str(t)) for i, t in rows], "id bigint, t string").select("id", F.col("t").cast("timestamp_ntz").alias("occurred_at"))
    store.write({"search_event": df})
    return store, rows


BOUNDS = [(None, None), ("2024-01-03", None), ("2024-01-03", "2024-01-09"), (None, "2024-01-08 23:59:59"), ("2024-01-05 10:00:00", "2024-01-05 20:00:00"), ("2024-01", "2024-01-1"), ("2024-01-0", "2024"), ("2024-13-45", None), (None, "2024-01-99"), ("", ""), ("2024-01-08 23:59:59", "2024-01-09 00:00:00")]


@pytest.mark.parametrize(("since", "until"), BOUNDS)
@pytest.mark.parametrize("whole_day", [False, True])
def test_period_bounds_are_text_whatever_is_pruned(stored, since, until, whole_day):
    store, rows = stored
    last = f"{until} 23:59:59" if whole_day and until and len(until) == 10 else until
    want = {i for i, t in rows if (not since or f"{t:%Y-%m-%d %H:%M:%S}" >= since) and (not last or f"{t:%Y-%m-%d %H:%M:%S}" <= last)}
    events = store.read("search_event")
    for df in (events, events.drop("day")):
        assert {r["id"] for r in M.in_period(df, since, until, whole_day).collect()} == want


def test_period_bounds_prune_the_stored_days(spark, stored):
    store, _ = stored
    df = M.in_period(store.read("search_event"), "2024-01-03", "2024-01-05 12:00:00").drop("day")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    partitions, pushed = (re.search(rf"{name}: \[(.*)\]\n", plan).group(1) for name in ("PartitionFilters", "PushedFilters"))
    assert "day" in partitions and ">= 2024-01-03" in partitions and "<= 2024-01-05" in partitions
    assert "GreaterThanOrEqual(occurred_at" in pushed and "LessThan(occurred_at" in pushed
    assert {f.rsplit("/", 2)[1] for f in (r[0] for r in df.select(F.input_file_name()).collect())} == {"day=2024-01-03", "day=2024-01-04", "day=2024-01-05"}
