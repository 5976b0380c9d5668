"""The review queue: proposals that re-runs refresh and people decide. A decided row is never changed by a re-run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.plans.stage import numbered, stage

QUEUE = "id bigint, kind string, source_term string, target_term string, lang string, confidence double, rationale string, evidence string, status string, created_at string, updated_at string, reviewer string, review_note string"
DECISIONS = {"approve": "approved", "reject": "rejected", "reopen": "pending"}
KEY = ["kind", "source_term", "target_term"]


def refresh(queue: DataFrame, candidates: DataFrame, now: str) -> DataFrame:
    """The queue after a mining run, with ``action``: inserted, rescored, kept (decided), or withdrawn (pending and no
    longer supported; these rows are to be dropped). One full outer join on the key."""
    c = candidates.select(*KEY, *[F.col(x).alias(f"_{x}") for x in ("lang", "confidence", "rationale", "evidence")], F.lit(True).alias("_new"))
    queue, c = stage(queue), stage(c)
    both = queue.withColumn("_old", F.lit(True)).join(c, KEY, "full_outer")
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("status") != "pending", "kept").when(F.col("_new").isNull(), "withdrawn").otherwise("rescored")
    both = both.withColumn("action", action)
    last = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    fresh = both.where("action = 'inserted'")
    # New ids follow the order in which a reviewer meets the rows.
    fresh = numbered(fresh, [F.desc("_confidence"), *KEY], "_n").join(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("_n")).drop("_n", "_last")
    rest = both.where("action <> 'inserted'")
    out = rest.unionByName(fresh)
    changed = F.col("action").isin("inserted", "rescored")
    pick = lambda name: F.when(changed, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)
    return out.select(
        "id", *KEY, pick("lang"), pick("confidence"), pick("rationale"), pick("evidence"),
        F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("created_at", F.lit(now)).alias("created_at"),
        F.when(changed, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"), "reviewer", "review_note", "action",
    )


def kept(refreshed: DataFrame) -> DataFrame:
    return refreshed.where("action <> 'withdrawn'").drop("action")


def listed(queue: DataFrame, status: str | None = None, kind: str | None = None, limit: int | None = 100) -> DataFrame:
    """Pending first, then by confidence and id; all rows without a limit."""
    out = queue
    if status:
        out = out.where(F.col("status") == status)
    if kind:
        out = out.where(F.col("kind") == kind)
    out = out.orderBy((F.col("status") == "pending").desc(), F.desc("confidence"), "id")
    return out if limit is None else out.limit(limit)


def decide(queue: DataFrame, suggestion_id: int, decision: str, now: str, reviewer: str | None = None, note: str | None = None) -> DataFrame:
    """The queue with one row decided. Unknown decisions are a ValueError, unknown ids a KeyError."""
    if decision not in DECISIONS:
        raise ValueError(f"unknown decision {decision!r}")
    if queue.where(F.col("id") == suggestion_id).isEmpty():
        raise KeyError(suggestion_id)
    here = F.col("id") == suggestion_id
    reopened = decision == "reopen"
    return queue.withColumns(
        {
            "status": F.when(here, DECISIONS[decision]).otherwise(F.col("status")),
            "updated_at": F.when(here, F.lit(now)).otherwise(F.col("updated_at")),
            "reviewer": F.when(here, F.lit(None if reopened else reviewer)).otherwise(F.col("reviewer")),
            "review_note": F.when(here, F.lit(None if reopened else note)).otherwise(F.col("review_note")),
        }
    )


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("kind", "status").agg(F.count("*").alias("suggestions"))


def pending_by_kind(queue: DataFrame) -> DataFrame:
    return queue.where("status = 'pending'").groupBy("kind").agg(F.count("*").alias("pending"))


def rules(queue: DataFrame) -> DataFrame:
    """(kind, source_term, target_term): approved spelling and completion rules; where a source has several, the one
    that a list by confidence meets last."""
    ok = queue.where("status = 'approved' AND kind <> 'synonym'")
    return ok.groupBy("kind", "source_term").agg(F.min_by("target_term", F.struct("confidence", -F.col("id"))).alias("target_term"))


def synonym_groups(queue: DataFrame) -> DataFrame:
    """(term, group_term) of approved synonyms: the smallest term each can reach, by label passing with checkpoints
    until nothing changes."""
    pairs = queue.where("status = 'approved' AND kind = 'synonym'").select(F.col("source_term").alias("a"), F.col("target_term").alias("b"))
    both = stage(pairs.union(pairs.select("b", "a")).distinct())
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("term"), F.least("a", "m").alias("group_term")))
    while True:
        passed = both.join(labels.withColumnRenamed("term", "b"), "b").groupBy(F.col("a").alias("term")).agg(F.min("group_term").alias("m"))
        # Each round also jumps to the label's own label, so chains shorten by half.
        jump = labels.select(F.col("term").alias("group_term"), F.col("group_term").alias("j"))
        least = F.least("group_term", "m", "j")
        new = stage(labels.join(passed, "term", "left").join(jump, "group_term", "left").select("term", least.alias("group_term"), (least != F.col("group_term")).alias("_moved")))
        labels = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return labels


def export(queue: DataFrame) -> dict:
    """All approved rules, whole groups among them, as plain data for the search engine, streamed to the driver: these
    are decisions that people made one by one."""
    chosen = sorted((r["kind"], r["source_term"], r["target_term"]) for r in rules(queue).toLocalIterator())
    groups: dict[str, list[str]] = {}
    for r in synonym_groups(queue).toLocalIterator():
        groups.setdefault(r["group_term"], []).append(r["term"])
    return {
        "spelling": {source: target for kind, source, target in chosen if kind == "misspelling"},
        "completions": {source: target for kind, source, target in chosen if kind == "partial_query"},
        "synonyms": sorted(sorted(v) for v in groups.values()),
    }
