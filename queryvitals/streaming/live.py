"""Sessions and follow-ups of a live search stream (an extension: the batch operators rebuild a whole log).

Input rows: user_id, id, ts, norm_query. Late rows within ``delay`` of the newest time seen are still counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REWORD_SECONDS = 300


def live_sessions(searches: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(user_id, started, ended, searches) of sessions that are over."""
    marked = searches.withWatermark("ts", delay)
    windows = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("searches"), F.max("ts").alias("ended"))
    return windows.select("user_id", F.col("w.start").alias("started"), "ended", "searches")


def live_counts(searches: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(started, norm_query, searches) of each hour."""
    return searches.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "norm_query").agg(F.count("*").alias("searches")).select(F.col("w.start").alias("started"), "norm_query", "searches")


def live_follow_ups(searches: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(user_id, id, norm_query, follow_up) of each search, once the next one of the user or five minutes have come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = [tuple(r) for b in batches for r in b[["ts", "id", "norm_query"]].itertuples(index=False)]
        rows = sorted([(pd.Timestamp(t), i, q) for t, i, q in held] + [(pd.Timestamp(t), int(i), q) for t, i, q in rows])
        out = []
        for (t, i, q), (after, _, nxt) in zip(rows, rows[1:], strict=False):
            late = (after - t).total_seconds() > REWORD_SECONDS
            out.append((key[0], i, q, "new_intent" if late else "repeat" if nxt == q else "reformulation"))
        last = rows[-1] if rows else None
        if state.hasTimedOut and last is not None:
            out.append((key[0], last[1], last[2], "none"))
            state.remove()
        elif last is not None:
            state.update(([(last[0].isoformat(), last[1], last[2])],))
            state.setTimeoutTimestamp(max(int(last[0].timestamp() * 1000) + REWORD_SECONDS * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "id", "norm_query", "follow_up"])

    marked = searches.withWatermark("ts", delay)
    return marked.groupBy("user_id").applyInPandasWithState(step, "user_id long, id long, norm_query string, follow_up string", "held array<struct<ts:string,id:long,norm_query:string>>", "append", GroupStateTimeout.EventTimeTimeout)
