"""Daily states merged for a period equal the scores computed from the period's log."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from queryvitals.operators import behaviour as B
from queryvitals.operators import events as E
from queryvitals.operators import metrics as M
from queryvitals.operators import states as S
from queryvitals.plans.stage import stage
from queryvitals.sources.surrogate import Surrogate


@pytest.fixture(scope="module")
def scored(spark):
    """A log in which many sessions go on past midnight: times are pressed together around the days' borders."""
    s = Surrogate(spark, "/root/testdata/sf0.001")
    near = F.timestamp_micros((F.floor(F.col("id") / 40) * 86_400_000_000 + F.lit(1_704_067_200_000_000) - 200_000_000 + F.col("id") % 40 * 11_000_000)).cast("timestamp_ntz")
    events = stage(s.events().where("id < 320").withColumn("occurred_at", near).withColumn("session_id", F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))))
    shop = s.shop()
    whole = stage(E.event_quality(B.follow_ups(events), shop))
    return events, shop, stage(S.states(whole)), stage(S.tails(whole))


def rows(df, keys=("norm_query",)):
    # Sums of halves in another order may differ in the last bit of what is kept in full precision.
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    names = sorted(c for c in df.columns if c not in keys)
    return {tuple(r[k] for k in keys): {n: tidy(r[n]) for n in names} for r in df.collect()}


PERIODS = [(None, None), ("2024-01-02", None), ("2024-01-02", "2024-01-05"), (None, "2024-01-03 23:59:59"), ("2024-01-04", "2024-01-05"), ("2024-02-01", None)]


@pytest.mark.parametrize(("since", "until"), PERIODS)
def test_any_period_of_whole_days(scored, since, until):
    events, shop, kept, cut = scored
    got = S.query_quality(kept, cut, *S.whole_days(since, until))
    want = M.query_quality(M.in_period(events, since, until), shop)
    assert set(got.columns) == set(want.columns)
    assert rows(got.select(*want.columns)) == rows(want)


def test_every_day_by_itself(scored):
    events, shop, kept, cut = scored
    assert cut.count() > 5
    dated = events.withColumn("day", F.to_date("occurred_at"))
    want = rows(M.query_quality(dated, shop, by=("day",)), ("day", "norm_query"))
    assert rows(S.query_quality(kept, cut, by_day=True), ("day", "norm_query")) == want and len({d for d, _ in want}) >= 8


def test_bounds_that_cut_a_day_are_no_whole_days():
    assert S.whole_days("2024-01-02", "2024-01-05") == (date(2024, 1, 2), date(2024, 1, 4))
    assert S.whole_days(None, "2024-01-05 23:59:59") == (None, date(2024, 1, 5))
    for since, until in (("2024-01-02 10:00:00", None), (None, "2024-01-05 12:00:00"), ("2024-01", None), (None, "2024"), ("2024-13-01", None)):
        assert S.whole_days(since, until) is None


def test_a_new_day_leaves_the_states_of_the_others(scored, spark):
    events, shop, kept, _ = scored
    cut_at = "2024-01-05"
    earlier = stage(S.states(E.event_quality(B.follow_ups(M.in_period(events, None, cut_at)), shop)))
    # Only what a follower says of a search may change: sessions that the new days continue.
    names = [c for c in kept.columns if c not in ("scored", "dissatisfied", "rapid", "signatures", "sessions")]
    assert earlier.select(*names).exceptAll(kept.where(F.col("day") < cut_at).select(*names)).count() == 0
