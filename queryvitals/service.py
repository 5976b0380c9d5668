"""One store, its measures, and the actions on its queue: what the command line and the HTTP service call."""

from __future__ import annotations

import json
import os
from dataclasses import replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryvitals.functions import text as T
from queryvitals.operators import behaviour as B
from queryvitals.operators import events as E
from queryvitals.operators import ingest as I
from queryvitals.operators import metrics as M
from queryvitals.operators import reports as R
from queryvitals.operators import review as V
from queryvitals.operators import spelling as P
from queryvitals.operators import states
from queryvitals.operators import substrings as G
from queryvitals.operators import synonyms as Y
from queryvitals.operators import terms as D
from queryvitals.operators.shop import DERIVED, Shop
from queryvitals.plans.planner import Planner
from queryvitals.plans.stage import stage
from queryvitals.schemas import SOURCES, TABLES, Settings
from queryvitals.sources.dump import read_database, read_dump
from queryvitals.sources.store import Store


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")


class Service:
    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self.store = Store(spark, settings.store)
        self._shop: tuple[tuple, Shop] | None = None

    # Loading.

    def load(self, source: DataFrame, origin: str) -> list[dict]:
        """Replace the store's tables by those of ``source`` (table, cols); the report by table."""
        tables, report = I.build(source, self.settings.session_gap_seconds)
        found = [r.asDict() for r in report.collect()]
        self.store.reload(tables)
        I.check_references({k: self.store.read(k) for k in tables})
        self.score()
        self.store.write_meta({"loaded_at": _now(), "origin": origin})
        return found

    def load_dump(self, path: str) -> list[dict]:
        return self.load(read_dump(self.spark, path, list(SOURCES)), path)

    def load_database(self, url: str | None = None, properties: dict | None = None) -> list[dict]:
        """The same from a live database, of which the settings name the address and the user."""
        url = url or self.settings.database_url
        if not url:
            raise ValueError("QUERYVITALS_DATABASE_URL must name the database")
        user = self.settings.database_user
        given = {"user": user, "password": os.environ.get("QUERYVITALS_DATABASE_PASSWORD", "")} if user else {}
        return self.load(read_database(self.spark, url, given | (properties or {})), f"database: {user + ' at ' if user else ''}{url.split('?')[0].split(';')[0]}")

    def score(self) -> None:
        """Score the log once and keep its daily states, from which periods of whole days are read; and index the names."""
        scored = stage(E.event_quality(B.follow_ups(self.events()), self.shop(), self.settings.result_cap))
        self.store.write({"query_state": states.states(scored, self.settings.result_cap), "query_tail": states.tails(scored)})
        self.store.write({"name_gram": G.ordered(G.postings(self.store.read("product_name"), ["product_id", "lang"]))})

    # Reading.

    def shop(self) -> Shop:
        """The catalogue with what is derived from it, which is kept in the store: derived once for each version of its
        tables, by whoever needs it first."""
        version = self.store.versions("product", "product_name", "product_category", "category_name")
        if self._shop is None or self._shop[0] != version:
            self._shop = (version, self._catalogue(version))
        return self._shop[1]

    def _catalogue(self, version: tuple) -> Shop:
        r, mark = self.store.read, json.dumps(version)
        plain = Shop(r("product"), r("product_name"), r("product_category"), r("category_name"))
        if not self.store.exists():
            return plain
        if self.store.meta().get("catalogue_of") != mark:
            made = {table: getattr(plain, name).repartitionByRange(key).sortWithinPartitions(key) for name, (table, key) in DERIVED.items()}
            self.store.write(made)
            self.store.write_meta({"catalogue_of": mark})
        return replace(plain, derived={name: r(table) for name, (table, _) in DERIVED.items()})

    def events(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """The log, without the days by which the store keeps it."""
        return M.in_period(self.store.read("search_event"), since, until).drop("day")

    def quality(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """Scores of a period: merged from the daily states if the bounds cut no day, else computed from the log."""
        days = states.whole_days(since, until)
        if days is None:
            return M.query_quality(self.events(since, until), self.shop(), self.settings.result_cap)
        return stage(states.query_quality(self.store.read("query_state"), self.store.read("query_tail"), *days, cap=self.settings.result_cap))

    def daily_health(self, days: int = 90) -> DataFrame:
        """The overview of each of the newest ``days`` days, from the daily states."""
        kept, cut = (self.store.read(t) for t in ("query_state", "query_tail"))
        return M.overview(states.query_quality(M.newest_days(kept, days), cut, by_day=True, cap=self.settings.result_cap), ("day",))

    def overview(self, since: str | None = None, until: str | None = None) -> DataFrame:
        return M.overview(self.quality(since, until))

    def queries(self, since: str | None = None, until: str | None = None, problems_only: bool = False, limit: int = 100) -> DataFrame:
        q = M.reason_texts(self.quality(since, until), self.settings.result_cap)
        return M.ranked(q.where("is_problem") if problems_only else q).limit(min(limit, 500))

    def query(self, text: str) -> dict:
        """One query with its newest answer; KeyError where it was never searched."""
        rows = self.planner().run("detail", query=text)["rows"]
        if not rows:
            raise KeyError(text)
        return rows[0]

    def terms(self, limit: int = D.TERM_LIMIT) -> DataFrame:
        return D.ranked(D.term_drivers(self.quality(), self.shop()), min(limit, 100))

    def queue(self) -> DataFrame:
        return self.store.read("suggestion")

    def period(self, days: int | None) -> tuple[str | None, str | None]:
        """The last ``days`` of the log, up to its newest search; no bounds for all of it."""
        last = self.events().agg(F.max("occurred_at").alias("t")).first()["t"] if days else None
        return (None, None) if last is None else (str(last - timedelta(days=days)), str(last))

    def planner(self) -> Planner:
        return Planner(self.events(), self.shop(), self.queue(), self.quality, self.store.read("name_gram"))

    def tables(self, days: int = 90) -> dict[str, DataFrame]:
        return R.tables(self.events(), self.shop(), self.queue(), days, self.quality(), self.daily_health(days))

    def status(self) -> dict:
        return {"store": self.settings.store, "ready": self.store.exists(), "meta": self.store.meta()}

    # Acting.

    def discover(self) -> dict[str, int]:
        """Mine candidates and refresh the queue: rows by what became of them."""
        events, shop = self.events(), self.shop()
        counters = self.store.read("query_count")
        kinds = B.reformulation_kinds(B.follow_ups(events))
        spelling = P.spelling_candidates(P.query_frequencies(events, counters), B.self_corrections(kinds), shop)
        pairs = Y.synonym_candidates(B.reworded_pairs(kinds), Y.result_overlap(Y.query_products(events, shop)), Y.dice_alignment(shop.product_name, Y.searched_terms(events, counters)))
        found = P.as_candidates(spelling).unionByName(Y.as_candidates(pairs))
        refreshed = V.refresh(self.queue(), found, _now())
        counts = {r["action"]: r["count"] for r in refreshed.groupBy("action").count().collect()}
        self.store.write({"suggestion": V.kept(refreshed)})
        return counts

    def decide(self, suggestion_id: int, decision: str, reviewer: str | None = None, note: str | None = None) -> None:
        self.store.write({"suggestion": V.decide(self.queue(), suggestion_id, decision, _now(), reviewer, note)})

    def export(self) -> dict:
        return V.export(self.queue())

    def digest(self, days: int = 7, end: str | None = None) -> dict:
        """A digest, also stored under its period."""
        d = R.digest(self.events(), self.shop(), self.queue(), days, end)
        if d["period_start"]:
            old = self.store.read("digest")
            number = (old.agg(F.max("id").alias("m")).first()["m"] or 0) + 1
            row = (number, d["period_start"], d["period_end"], _now(), "deterministic", d["body_md"], json.dumps(d["metrics"], default=str))
            self.store.write({"digest": R.upsert_digest(old, self.spark.createDataFrame([row], TABLES["digest"]))})
        return d

    def coverage(self, term: str) -> dict:
        return self.planner().run("coverage", term=T.fold_string(term))["rows"][0]
