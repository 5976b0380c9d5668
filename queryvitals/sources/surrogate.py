"""A search log and a catalogue made from the benchmark tables ``part`` and ``events``, by SQL that two engines share.

Parts are products: their names are the English names, their types the second language; brands and types are their
categories. Each event is a search for a word of a part's name, some misspelt, cut short or with two words; its
answer is a few neighbouring parts. Every statement is plain SQL over the tables before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryvitals.functions import text as T
from queryvitals.operators import sessions as S
from queryvitals.operators.shop import Shop
from queryvitals.plans.stage import written

#: name -> SQL; each may refer to the tables part and events and to any earlier name in braces.
SHARED = {
    "product": "SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR(20)) AS sku, p_name AS url_key, p_retailprice AS default_price FROM {part}",
    "product_name": "SELECT p_partkey AS product_id, 'en' AS lang, p_name AS name FROM {part} UNION ALL SELECT p_partkey, 'ar', lower(p_type) FROM {part}",
    "product_category": "SELECT p_partkey AS product_id, CAST(substr(p_brand, 7) AS BIGINT) AS category_id FROM {part} UNION ALL SELECT p_partkey, 1000 + 100 * length(p_type) + ascii(p_type) FROM {part}",
    "category_name": "SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS category_id, 'en' AS lang, p_brand AS name FROM {part} UNION ALL SELECT DISTINCT 1000 + 100 * length(p_type) + ascii(p_type), 'ar', p_type FROM {part} UNION ALL SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT), 'ar', lower(p_brand) FROM {part}",
    "asked": "SELECT event_id AS id, ts, user_id, event_type, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT) AS k FROM {events}",
    "aimed": "SELECT a.id, a.ts, a.user_id, a.event_type, a.k, (a.id * 7 + a.k) % n.n AS pid, n.n AS n FROM {asked} a CROSS JOIN (SELECT count(*) AS n FROM {part}) n",
    "worded": "SELECT a.*, p.p_name AS pname, split_part(p.p_name, ' ', CAST(1 + a.id % 2 AS INT)) AS w FROM {aimed} a JOIN {part} p ON p.p_partkey = a.pid",
    "search": "SELECT id, ts, user_id, event_type, k, pid, n, CASE k % 10 WHEN 0 THEN substr(w, 1, length(w) - 1) WHEN 1 THEN concat(substr(w, 2, 1), substr(w, 1, 1), substr(w, 3)) WHEN 2 THEN concat(w, 'n') WHEN 3 THEN substr(w, 1, 3) WHEN 4 THEN pname WHEN 5 THEN pname WHEN 6 THEN 'quinoa' ELSE w END AS raw_query, k % 6 AS result_count, CASE WHEN k % 3 = 0 THEN 0 ELSE id % 50 END AS shift FROM {worded}",
}


class Surrogate:
    """Domain tables over the benchmark files in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict = {}

    def table(self, name: str) -> DataFrame:
        """A benchmark table or one of the shared statements."""
        if name not in self._made:
            if name in SHARED:
                import re

                needs = re.findall(r"\{(\w+)\}", SHARED[name])
                self._made[name] = self.spark.sql(SHARED[name], **{n: self.table(n) for n in set(needs)})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]

    def answers(self) -> DataFrame:
        """(start, titles): the five parts from each one on, by which any search from there is answered."""
        n = self.table("part").agg(F.count("*").alias("_n"))
        p = self.table("part").join(F.broadcast(n)).where("p_partkey >= 0 AND p_partkey < _n").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(4))))
        title = F.struct("pos", F.col("p_name").alias("en"), F.lower("p_type").alias("ar"))
        return p.groupBy(F.pmod(F.col("p_partkey") - F.col("pos"), "_n").alias("start")).agg(F.sort_array(F.collect_list(title)).alias("titles"))

    def log(self) -> DataFrame:
        """The search log with full-precision times, before sessions; kept, since every measure reads it several times.
        Where the log with sessions is there already, it is that one."""
        if "_events" in self._made:
            return self._made["_events"]
        if "_log" not in self._made:
            self._made["_log"] = written(self._log(self.table("search")))
        return self._made["_log"]

    def _log(self, search: DataFrame) -> DataFrame:
        """``search`` with its answers; Arabic titles for every second search."""
        more = [c for c in search.columns if c.startswith("session_")]
        start = F.when(F.col("result_count") > 0, (F.col("pid") + F.col("shift")) % F.col("n")).alias("_start")
        s = search.select("id", "ts", "user_id", "event_type", "k", "raw_query", F.col("result_count").cast("int").alias("result_count"), *more, start)
        # Searches without an answer look for one under numbers of their own, else they would all meet in one task.
        s = s.withColumn("_start", F.coalesce("_start", -1 - F.col("id"))).join(self.answers().withColumnRenamed("start", "_start"), "_start", "left")
        empty = F.array().cast("array<string>")
        shown = lambda c: F.transform(F.filter("titles", lambda x: x["pos"] < F.col("result_count")), lambda x: x[c])
        s = s.withColumn("results_en", F.coalesce(shown("en"), empty)).withColumn("results_ar", F.coalesce(F.when(F.col("id") % 2 == 0, F.filter(shown("ar"), lambda x: x.isNotNull())), empty)).drop("titles", "_start")
        # Folded once for each spelling, which many searches share.
        spelt = written(self.table("search").select("raw_query").distinct().withColumn("norm_query", T.normalize("raw_query")).withColumn("script", T.script_of("raw_query")))
        s = s.join(spelt.withColumnRenamed("raw_query", "_raw"), F.col("raw_query").eqNullSafe(F.col("_raw"))).drop("_raw")
        s = s.withColumn("result_signature", T.result_signature("results_en", "results_ar"))
        clicked = F.when(F.col("event_type") == "click", (F.col("id") % 5 + 1).cast("int"))
        return s.withColumn("occurred_at", F.date_trunc("second", "ts").cast("timestamp_ntz")).withColumn("clicked_rank", clicked).withColumn("converted", F.when(F.col("event_type") == "purchase", F.lit(True)))

    def events(self) -> DataFrame:
        """search_event: the log with its sessions, which are cut before rows get their answers."""
        if "_events" not in self._made:
            rows = self._made["_log"] if "_log" in self._made else self.table("search")
            rows = S.sessionize(rows, "ts", "id").drop("session_no")
            full = rows if "_log" in self._made else self._log(rows)
            self._made["_events"] = written(full.drop("ts", "k", "user_id", "event_type"))
        return self._made["_events"]

    def product_name(self) -> DataFrame:
        """Names with their folded form, kept, since the vocabulary and the titles both read them."""
        if "_names" not in self._made:
            self._made["_names"] = written(self.table("product_name").withColumn("norm_name", T.normalize("name")))
        return self._made["_names"]

    def query_count(self) -> DataFrame:
        """Lifetime counters of all searches, one for each spelling: above the log's count for some, below for others."""
        more = F.when(F.length("query") % 2 == 0, F.count("*") * 2).otherwise(F.lit(1).cast("bigint"))
        rows = self.table("search").groupBy(F.col("raw_query").alias("query")).agg(more.alias("count"))
        return rows.select("query", T.normalize("query").alias("norm_query"), "count")

    def shop(self) -> Shop:
        if "_shop" not in self._made:
            self._made["_shop"] = self._shop()
        return self._made["_shop"]

    def _shop(self) -> Shop:
        return Shop(self.table("product"), self.product_name(), self.table("product_category"), self.table("category_name")).staged()
