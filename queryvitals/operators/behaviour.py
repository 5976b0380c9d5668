"""What a session does after each search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queryvitals.functions import text as T
from queryvitals.plans.stage import written

REWORD_SECONDS = 300
RAPID_SECONDS = 2.0
TYPO_DISTANCE = 2
#: Width of the time buckets in which followers are looked for.
BUCKET_SECONDS = 900


def follow_ups(events: DataFrame, by: tuple[str, ...] = (), bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``events`` with follow_up, reformulation, next_norm_query, seconds_to_next, results_unchanged, rapid_repeat, dissatisfied.

    A period filter belongs before this: the last search of a cut has no follower. ``by`` adds keys that cut sessions
    further (a calendar day), which scores all periods in one pass.

    Searches without a session are one session, which may hold most of the log. So windows run inside buckets of time;
    the last search of a bucket is followed by the first one of the session's next bucket, and only sessions that
    have several buckets need to look there. No task has more of a session than ``bucket_seconds`` of it.
    """
    key = [*by, "_session"]
    moment = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    rows = events.withColumn("_session", F.coalesce("session_id", F.lit("s0000"))).withColumn("_bucket", F.floor(moment / (bucket_seconds * 1_000_000)))
    shown = F.struct(F.col("occurred_at").alias("at"), F.col("norm_query").alias("query"), F.col("result_signature").alias("signature"))
    firsts = rows.groupBy(*key, "_bucket").agg(F.min_by(shown, F.struct("occurred_at", "id")).alias("_first"))
    later = firsts.withColumn("_later", F.lead("_first").over(Window.partitionBy(*key).orderBy("_bucket"))).where(F.col("_later").isNotNull()).drop("_first")
    inside = Window.partitionBy(*key, "_bucket").orderBy("occurred_at", "id")
    out = rows.withColumn("_next", F.lead(shown).over(inside))
    out = out.join(later, [*key, "_bucket"], "left").withColumn("_next", F.coalesce("_next", "_later")).withColumn("next_norm_query", F.col("_next.query"))
    gap = (F.unix_micros(F.col("_next.at").cast("timestamp")) - moment) / 1e6
    out = out.withColumn("seconds_to_next", gap)
    follow = (
        F.when(F.col("_next").isNull(), "none")
        .when(F.col("seconds_to_next") > REWORD_SECONDS, "new_intent")
        .when(F.col("next_norm_query") == F.col("norm_query"), "repeat")
        .otherwise("reformulation")
    )
    out = out.withColumn("follow_up", follow)
    out = out.withColumn("results_unchanged", F.coalesce(F.col("_next.signature") == F.col("result_signature"), F.lit(False)))
    out = out.withColumn("rapid_repeat", (F.col("follow_up") == "repeat") & F.col("results_unchanged") & (F.col("seconds_to_next") < RAPID_SECONDS))
    out = out.withColumn("dissatisfied", ~F.col("rapid_repeat") & F.col("follow_up").isin("repeat", "reformulation"))
    names = [*events.columns, "next_norm_query", "seconds_to_next", "follow_up", "results_unchanged", "rapid_repeat", "dissatisfied"]
    return out.withColumn("rapid_repeat", F.coalesce("rapid_repeat", F.lit(False))).select(*dict.fromkeys(names))


def reformulation_kinds(followed: DataFrame) -> DataFrame:
    """``followed`` with reformulation: refinement, typo_fix or switch. Distances are computed once per distinct pair,
    which are written, since a filter on the kind would else be moved to the searches, distances and all."""
    pairs = followed.where("follow_up = 'reformulation'").select("norm_query", "next_norm_query").distinct()
    prefix = T.is_prefix_of("norm_query", "next_norm_query") | T.is_prefix_of("next_norm_query", "norm_query")
    kind = F.when(prefix, "refinement").when(T.within_osa("norm_query", "next_norm_query", TYPO_DISTANCE), "typo_fix").otherwise("switch")
    known = written(written(pairs).select(F.col("norm_query").alias("_a"), F.col("next_norm_query").alias("_b"), kind.alias("_kind")))
    joined = followed.join(known, (F.col("norm_query") == F.col("_a")) & (F.col("next_norm_query") == F.col("_b")), "left")
    return joined.withColumn("reformulation", F.when(F.col("follow_up") == "reformulation", F.col("_kind"))).drop("_a", "_b", "_kind")


def pair_tally(kinds: DataFrame, wanted: list[str]) -> DataFrame:
    """(source, target, observations) of rewordings of the given kinds."""
    rows = kinds.where(F.col("reformulation").isin(*wanted) & (F.col("norm_query") != "") & (F.col("next_norm_query") != ""))
    return rows.groupBy(F.col("norm_query").alias("source"), F.col("next_norm_query").alias("target")).agg(F.count("*").alias("observations"))


def self_corrections(kinds: DataFrame) -> DataFrame:
    return pair_tally(kinds, ["typo_fix", "refinement"])


def reworded_pairs(kinds: DataFrame) -> DataFrame:
    return pair_tally(kinds, ["switch"])


def dissatisfaction(followed: DataFrame, *keys: str) -> DataFrame:
    """Per key: scored searches, dissatisfied ones, and their rate (null where nothing is scored)."""
    scored = F.count_if((F.col("follow_up") != "none") & ~F.col("rapid_repeat"))
    out = followed.groupBy(*keys).agg(scored.alias("scored"), F.count_if("dissatisfied").alias("dissatisfied"))
    return out.withColumn("dissatisfaction_rate", F.when(F.col("scored") > 0, F.col("dissatisfied") / F.col("scored")))
