"""Per-query scores, the overview, daily series and period comparison."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryvitals.functions.text import isolate, round_even
from queryvitals.operators import behaviour as B
from queryvitals.operators import events as E
from queryvitals.plans.stage import written

# Signal weights and the rounded severity from which a query is a problem.
WEIGHTS = {"lexical_miss_rate": 0.30, "dissatisfaction_rate": 0.25, "incoherence": 0.20, "under_fill": 0.15, "instability": 0.10}
PROBLEM = 0.30
AUTOMATED = 0.02


def _moment(text: str) -> datetime | None:
    """The time that a full date or timestamp names; None for other text, which is compared as text only."""
    try:
        return datetime.strptime(text, "%Y-%m-%d %H:%M:%S" if len(text) == 19 else "%Y-%m-%d") if len(text) in (10, 19) else None
    except ValueError:
        return None


def in_period(events: DataFrame, since: str | None = None, until: str | None = None, inclusive_day: bool = False) -> DataFrame:
    """Searches between two text bounds, both included, compared as text: a bare date as ``until`` ends at its first
    second, unless ``inclusive_day`` extends it to its last. What follows from a bound for the plain time is added, since it
    reaches the files' statistics, and what follows for the day, if ``events`` still has the store's partitions."""
    stamp = F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss")
    day = F.col("day").cast("string") if "day" in events.columns else None
    if until and inclusive_day and len(until) == 10:
        until = f"{until} 23:59:59"
    out = events
    if since:
        if day is not None:
            out = out.where(day >= since[:10])
        if _moment(since):
            out = out.where(F.col("occurred_at") >= F.lit(str(_moment(since))).cast("timestamp_ntz"))
        out = out.where(stamp >= since)
    if until:
        if day is not None:
            out = out.where(day <= until[:10])
        if _moment(until):
            # The text has whole seconds, so the time may be up to a second later.
            out = out.where(F.col("occurred_at") < F.lit(str(_moment(until) + timedelta(seconds=1))).cast("timestamp_ntz"))
        out = out.where(stamp <= until)
    return out


def severity(signals: dict[str, Column]) -> Column:
    """Weighted mean of the signals that could be measured; a missing one is not a zero."""
    total = sum((F.when(c.isNotNull(), F.lit(WEIGHTS[k])).otherwise(F.lit(0.0)) for k, c in signals.items()), F.lit(0.0))
    score = sum((F.coalesce(c * F.lit(WEIGHTS[k]), F.lit(0.0)) for k, c in signals.items()), F.lit(0.0))
    return F.when(total == 0, F.lit(0.0)).otherwise(score / total)


def query_quality(events: DataFrame, shop, cap: int = E.RESULT_CAP, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per folded query (and per ``by`` keys): rates, severity, impact, reasons. Full precision stays in
    columns that start with ``x_``; the others are rounded as reported."""
    scored = E.event_quality(B.follow_ups(events, by), shop, cap)
    # One row per distinct query, which every summary reads more than once.
    return written(roll_up(scored, cap, by))


def roll_up(scored: DataFrame, cap: int = E.RESULT_CAP, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals of each query. What is text is first a key, and the order of searches one number, so that tasks add up in
    hash tables instead of sorting their searches; the first values are then sought among few rows."""
    keys = [*by, "norm_query"]
    texts = ["raw_query", "script", "intended_term", "dominant_category"]
    parts = scored.groupBy(*keys, *texts).agg(
        F.min(_place()).alias("_place"),
        F.count("*").alias("searches"),
        F.min("occurred_at").alias("first_seen"),
        F.max("occurred_at").alias("last_seen"),
        F.sum(F.col("result_count").cast("bigint")).alias("_results"),
        F.count("result_count").alias("_counted"),
        F.min("result_count").alias("min_results"),
        F.count("zero_results").alias("_zeros_known"),
        F.count_if("zero_results").alias("zero_result_searches"),
        F.sum(F.greatest(F.lit(0), cap - F.col("result_count")).cast("bigint")).alias("_unfilled"),
        F.count("lexical_miss").alias("_misses_known"),
        F.count_if("lexical_miss").alias("_misses"),
        F.sum("coherence").alias("_coherence"),
        F.count("coherence").alias("_coherent"),
        F.count_if((F.col("follow_up") != "none") & ~F.col("rapid_repeat")).alias("scored"),
        F.count_if("dissatisfied").alias("dissatisfied"),
        F.count("rapid_repeat").alias("_rapid_known"),
        F.count_if("rapid_repeat").alias("rapid_repeats"),
        F.count("clicked_rank").alias("_clicked"),
        F.max("coverage").alias("coverage"),
        F.max(F.col("retrieval_gap").cast("int")).alias("_gap"),
        F.max("intended_coverage").alias("intended_coverage"),
        F.max("correction_distance").alias("correction_distance"),
        F.count_if("under_filled").alias("under_filled_searches"),
    )
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_place")))
    total = lambda *names: [F.sum(c).alias(c) for c in names]
    share = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    q = parts.groupBy(*keys).agg(
        F.min_by("raw_query", "_place").alias("display_query"),
        F.min_by("script", "_place").alias("script"),
        *total("searches"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        share("_results", "_counted").alias("x_mean_results"),
        F.min("min_results").alias("min_results"),
        share("zero_result_searches", "_zeros_known").alias("x_zero_result_rate"),
        (F.sum("_unfilled") / (cap * F.sum("searches"))).alias("x_under_fill"),
        share("_misses", "_misses_known").alias("x_lexical_miss_rate"),
        (1 - share("_coherence", "_coherent")).alias("x_incoherence"),
        *total("scored", "dissatisfied"),
        share("rapid_repeats", "_rapid_known").alias("x_rapid_repeat_rate"),
        *total("_clicked"),
        F.max("coverage").alias("coverage"),
        (F.max("_gap") > 0).alias("retrieval_gap"),
        first("intended_term").alias("intended_term"),
        F.max("intended_coverage").alias("intended_coverage"),
        F.max("correction_distance").alias("correction_distance"),
        first("dominant_category").alias("dominant_category"),
        *total("zero_result_searches", "under_filled_searches", "rapid_repeats"),
    )
    # A distinct count beside other sums would make each search three rows; these read two columns of the log.
    for name, of in (("sessions", "session_id"), ("_signatures", "result_signature")):
        several = scored.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], of).distinct()
        counted = several.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count(of).alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        q = q.join(counted, same).drop(*[f"_k{i}" for i in range(len(keys))])
    return finished(q, by)


def _place() -> Column:
    """Time and id of a search as one number, in their order (a missing time first), of which tasks keep the least in place."""
    whole = lambda c: c.cast("decimal(19,0)")
    micros = (F.col("occurred_at") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second").cast("decimal(20,6)") * 1_000_000
    return F.coalesce(whole(micros), whole(F.lit(-(2**62)))) * F.lit("20000000000000000000").cast("decimal(20,0)") + whole(F.col("id"))


def finished(q: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Scores from the totals of each query: what rates and counts amount to."""
    q = q.withColumn("x_instability", F.when(F.col("searches") > 1, (F.col("_signatures") - 1) / (F.col("searches") - 1)).otherwise(F.lit(0.0)))
    q = q.withColumn("x_dissatisfaction_rate", F.when(F.col("scored") > 0, F.col("dissatisfied") / F.col("scored")))
    q = q.withColumn("x_engagement_rate", F.when(F.col("_clicked") > 0, F.col("_clicked") / F.col("searches")))
    q = q.withColumn("misspelled", F.coalesce(F.col("correction_distance") > 0, F.lit(False)))
    q = q.withColumn("x_severity", severity({k: F.col(f"x_{k}") for k in WEIGHTS}))
    totals = q.groupBy(*by).agg(F.sum("searches").alias("_total"))
    q = q.join(F.broadcast(totals), list(by)) if by else q.join(F.broadcast(totals))
    q = q.withColumn("x_impact", F.col("x_severity") * F.col("searches") / F.col("_total"))
    rounded = {"mean_results": 2, "impact": 4}
    for name in ("mean_results", "zero_result_rate", "under_fill", "lexical_miss_rate", "incoherence", "instability", "dissatisfaction_rate", "engagement_rate", "rapid_repeat_rate", "severity", "impact"):
        q = q.withColumn(name, round_even(F.col(f"x_{name}"), rounded.get(name, 3)))
    q = q.withColumn("is_problem", F.col("severity") >= PROBLEM)
    q = q.withColumn("reason_codes", reason_codes())
    return q.withColumn("total_searches", F.col("_total")).drop("_signatures", "_clicked", "_total")


def reason_codes() -> Column:
    """Codes of the reasons, in the order in which a reader should meet them."""
    gap = F.col("retrieval_gap")
    rules = [
        (gap & F.col("misspelled") & F.col("intended_term").isNotNull(), "misspelling_gap"),
        (gap & ~(F.col("misspelled") & F.col("intended_term").isNotNull()), "retrieval_gap"),
        (F.col("x_lexical_miss_rate") > 0, "lexical_miss"),
        (F.col("x_incoherence") >= 0.5, "scattered"),
        (F.col("x_under_fill") > 0, "under_filled"),
        (F.col("x_instability") > 0, "unstable"),
        (F.col("x_dissatisfaction_rate") > 0, "retried"),
        (F.col("x_rapid_repeat_rate") > 0, "automated"),
        ((F.col("coverage") == 0) & (F.col("intended_coverage") == 0), "assortment_gap"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in rules]))


def reason_texts(quality: DataFrame, cap: int = E.RESULT_CAP) -> DataFrame:
    """``quality`` with reasons: one sentence for each code."""
    pct = lambda c: F.concat(round_even(F.col(c) * 100, 0).cast("int").cast("string"), F.lit("%"))
    count = F.format_number("intended_coverage", 0)
    said = {
        "misspelling_gap": F.concat(F.lit("Retrieval gap: a likely misspelling of "), isolate("intended_term"), F.lit(", which "), count, F.lit(" products use; none came back.")),
        "retrieval_gap": F.concat(F.lit("Retrieval gap: the catalogue has "), count, F.lit(" matching products; none came back.")),
        "lexical_miss": F.concat(pct("x_lexical_miss_rate"), F.lit(" of searches returned nothing that mentions the query.")),
        "scattered": F.concat(F.lit("Results are scattered over categories ("), F.concat(round_even((1 - F.col("x_incoherence")) * 100, 0).cast("int").cast("string"), F.lit("%")), F.lit(" share one).")),
        "under_filled": F.concat(F.lit("On average "), F.format_number("x_mean_results", 1), F.lit(f" of {cap} result places were filled.")),
        "unstable": F.concat(F.lit("Ranking is unstable: "), pct("x_instability"), F.lit(" of repeats returned other products.")),
        "retried": F.concat(pct("x_dissatisfaction_rate"), F.lit(" of these searches were retried or reworded at once.")),
        "automated": F.concat(pct("x_rapid_repeat_rate"), F.lit(" were fired again within two seconds with equal results; these look automated and are left out.")),
        "assortment_gap": F.lit("No product uses this word or one close to it: possibly an assortment gap."),
    }
    table = F.create_map(*[c for k, v in said.items() for c in (F.lit(k), v)])
    return quality.withColumn("reasons", F.transform("reason_codes", lambda k: table[k]))


def ranked(quality: DataFrame) -> DataFrame:
    return quality.orderBy(F.desc("impact"), F.desc("searches"), "norm_query")


def problem_queries(quality: DataFrame, limit: int = 10) -> DataFrame:
    """The problems with the largest impact; the limit is held between 1 and 50."""
    return ranked(quality.where("is_problem")).limit(max(1, min(limit, 50)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean that leaves nulls out of both sums; null where nothing was measured."""
    w = F.sum(F.when(value.isNotNull(), weight))
    return F.when(w > 0, F.sum(value * weight) / w)


def overview(quality: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals of a period (or of each ``by`` key) from its scored queries; a period without searches is healthy."""
    w = F.col("searches")
    total = F.sum(w)
    agg = quality.groupBy(*by).agg(
        F.coalesce(total, F.lit(0)).alias("total_searches"),
        F.count("*").alias("distinct_queries"),
        F.count_if("is_problem").alias("problem_queries"),
        F.coalesce(round_even(F.sum("zero_result_searches") / total, 3), F.lit(0.0)).alias("zero_result_rate"),
        F.coalesce(round_even(F.sum("under_filled_searches") / total, 3), F.lit(0.0)).alias("under_filled_rate"),
        F.coalesce(round_even(F.sum(F.col("lexical_miss_rate") * w) / total, 3), F.lit(0.0)).alias("lexical_miss_rate"),
        round_even(weighted_mean(F.col("dissatisfaction_rate"), w), 3).alias("dissatisfaction_rate"),
        F.coalesce(round_even(100 * (1 - F.sum(F.col("severity") * w) / total), 1), F.lit(100.0)).alias("health_score"),
        F.coalesce(round_even(F.sum("rapid_repeats") / total, 3), F.lit(0.0)).alias("automated_rate"),
        F.coalesce(F.bool_or(F.col("engagement_rate").isNotNull()), F.lit(False)).alias("_clicks"),
    )
    source = F.when(F.col("total_searches") == 0, "no data").when(F.col("_clicks"), "measured").otherwise("proxy")
    notes = F.array_compact(
        F.array(
            F.when(F.col("total_searches") == 0, F.lit("No searches in this period.")),
            F.when((F.col("total_searches") > 0) & ~F.col("_clicks"), F.lit("Dissatisfaction is inferred from what shoppers did next; no clicks are recorded.")),
            F.when(F.col("automated_rate") > AUTOMATED, F.lit("Some searches repeat at machine speed and are left out of the engagement figures.")),
            F.when((F.col("total_searches") > 0) & (F.col("zero_result_rate") == 0), F.lit("No search came back empty: failures show as wrong results.")),
        )
    )
    return agg.withColumn("engagement_source", source).withColumn("notes", notes).drop("_clicks")


def newest_days(dated: DataFrame, days: int) -> DataFrame:
    """Rows of the newest ``days`` calendar days up to the last ``day``."""
    last = dated.agg(F.max("day").alias("_last"))
    return dated.join(F.broadcast(last)).where(F.date_diff("_last", "day") < days).drop("_last")


def daily_health(events: DataFrame, shop, days: int = 90, cap: int = E.RESULT_CAP) -> DataFrame:
    """The overview of each calendar day with searches, the newest ``days`` up to the last one, in one pass: the day is
    a key of the session window and of the roll-up."""
    last = events.agg(F.to_date(F.max("occurred_at")).alias("_last"))
    dated = events.withColumn("day", F.to_date("occurred_at")).join(F.broadcast(last)).where(F.date_diff("_last", "day") < days).drop("_last")
    return overview(query_quality(dated, shop, cap, ("day",)), ("day",))


def compare_periods(first: DataFrame, second: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two overviews; a delta of an unmeasured value is null."""
    names = ["health_score", "total_searches", "lexical_miss_rate", "dissatisfaction_rate", "zero_result_rate"]
    long = lambda df, out: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(out)) for n in names])).alias("r")).select("r.*")
    return long(first, "before").join(long(second, "after"), "metric").withColumn("delta", round_even(F.col("after") - F.col("before"), 3))
