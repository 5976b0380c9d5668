"""Query scores of any period of whole days, from states that are kept by day and merge.

A state holds, for one day and query, sums, extremes, first values with their time, and the exact sets of sessions and
result lists. Searches are scored in the whole log, so a session that goes on past midnight has its followers; where a
period cuts such a session, its last search has none. ``tails`` keeps these searches with what they added, and the merge
takes it back for the ones whose follower lies behind the period's end. A new day adds its states and tails, and changes
only the tails of sessions that it continues.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryvitals.operators import events as E
from queryvitals.operators import metrics as M

_FIRST = {"display_query": "raw_query", "script": "script", "intended_term": "intended_term", "dominant_category": "dominant_category"}
_MAX = ("coverage", "intended_coverage", "correction_distance")
_SUMS = ("searches", "results", "results_n", "zero", "zero_n", "unfilled", "miss", "miss_n", "coherence", "coherence_n", "scored", "dissatisfied", "rapid", "clicked", "under_filled")
_SETS = {"signatures": "result_signature", "sessions": "session_id"}


def _scored() -> Column:
    return (F.col("follow_up") != "none") & ~F.col("rapid_repeat")


def states(scored: DataFrame, cap: int = E.RESULT_CAP) -> DataFrame:
    """One row per day and query of the scored log."""
    count = lambda c: F.count_if(F.col(c))
    first = {out: F.min(F.when(F.col(c).isNotNull(), F.struct("occurred_at", "id", F.col(c).alias("v")))) for out, c in _FIRST.items()}
    sums = {
        "searches": F.count("*"), "results": F.sum(F.col("result_count").cast("bigint")), "results_n": F.count("result_count"),
        "zero": count("zero_results"), "zero_n": F.count("zero_results"), "unfilled": F.sum(F.greatest(F.lit(0), cap - F.col("result_count")).cast("bigint")),
        "miss": count("lexical_miss"), "miss_n": F.count("lexical_miss"), "coherence": F.sum("coherence"), "coherence_n": F.count("coherence"),
        "scored": F.count_if(_scored()), "dissatisfied": count("dissatisfied"), "rapid": count("rapid_repeat"), "clicked": F.count("clicked_rank"), "under_filled": count("under_filled"),
    }
    return scored.groupBy(F.to_date("occurred_at").alias("day"), "norm_query").agg(
        *[c.alias(n) for n, c in {**first, **sums}.items()],
        *[F.max(c).alias(c) for c in _MAX],
        *[F.collect_set(c).alias(n) for n, c in _SETS.items()],
        F.bool_or("retrieval_gap").alias("retrieval_gap"),
        F.min("result_count").alias("min_results"),
        F.min("occurred_at").alias("first_seen"),
        F.max("occurred_at").alias("last_seen"),
    )


def tails(scored: DataFrame) -> DataFrame:
    """(day, next_day, norm_query, scored, dissatisfied, rapid): searches whose follower is of a later day, with what they add."""
    after = F.unix_micros(F.col("occurred_at").cast("timestamp")) + F.round(F.col("seconds_to_next") * 1_000_000).cast("bigint")
    rows = scored.where("follow_up <> 'none'").select(
        F.to_date("occurred_at").alias("day"), F.to_date(F.timestamp_micros(after).cast("timestamp_ntz")).alias("next_day"), "norm_query", _scored().cast("int").alias("scored"), F.col("dissatisfied").cast("int").alias("dissatisfied"), F.col("rapid_repeat").cast("int").alias("rapid")
    )
    return rows.where("next_day > day")


def _between(df: DataFrame, since: date | None, until: date | None) -> DataFrame:
    """Days from ``since`` to ``until``, both included."""
    if since is not None:
        df = df.where(F.col("day") >= F.lit(since))
    return df if until is None else df.where(F.col("day") <= F.lit(until))


def query_quality(kept: DataFrame, cut: DataFrame, since: date | None = None, until: date | None = None, by_day: bool = False, cap: int = E.RESULT_CAP) -> DataFrame:
    """The rows of ``metrics.query_quality`` for the days from ``since`` to ``until``, or for each day by itself, from
    the states ``kept`` and the tails ``cut``."""
    by = ["day"] if by_day else []
    keys = [*by, "norm_query"]
    q = _between(kept, since, until).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        *[F.min(c)["v"].alias(c) for c in _FIRST],
        *[F.max(c).alias(c) for c in _MAX],
        *[F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("bigint").alias(c) for c in _SETS],
        F.bool_or("retrieval_gap").alias("retrieval_gap"),
        F.min("min_results").alias("min_results"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    lost = _between(cut, since, until)
    lost = lost if by_day else lost.where(F.col("next_day") > F.lit(until)) if until is not None else lost.where(F.lit(False))
    lost = lost.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in ("scored", "dissatisfied", "rapid")])
    q = q.join(lost, keys, "left")
    less = lambda c: F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    q = q.select(
        *keys, *_FIRST, *_MAX, "searches", "sessions", "retrieval_gap", "min_results", "first_seen", "last_seen",
        rate("results", "results_n").alias("x_mean_results"), rate("zero", "zero_n").alias("x_zero_result_rate"), (F.col("unfilled") / (cap * F.col("searches"))).alias("x_under_fill"),
        rate("miss", "miss_n").alias("x_lexical_miss_rate"), (1 - rate("coherence", "coherence_n")).alias("x_incoherence"),
        F.col("signatures").alias("_signatures"), F.col("clicked").alias("_clicked"), less("scored").alias("scored"), less("dissatisfied").alias("dissatisfied"),
        (less("rapid") / F.col("searches")).alias("x_rapid_repeat_rate"), less("rapid").alias("rapid_repeats"), F.col("zero").alias("zero_result_searches"), F.col("under_filled").alias("under_filled_searches"),
    )
    return M.finished(q, tuple(by))


def whole_days(since: str | None, until: str | None) -> tuple[date | None, date | None] | None:
    """The days of a period whose text bounds cut no day (see ``metrics.in_period``: a bare date as ``until`` ends before
    it); None for other periods."""
    from datetime import timedelta

    try:
        first = date.fromisoformat(since) if since else None
        last = None if not until else date.fromisoformat(until) - timedelta(days=1) if len(until) == 10 else date.fromisoformat(until[:10]) if until[10:] == " 23:59:59" else False
    except ValueError:
        return None
    if last is False or (since and len(since) != 10):
        return None
    return first, last
