"""Reporting tables, digests and exports over the scored log."""

from __future__ import annotations

import json
import os
from datetime import timedelta

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from queryvitals.operators import metrics as M
from queryvitals.operators import review as V
from queryvitals.operators import terms as D

LOW_ENGAGEMENT = 0.5
DIGEST_ROWS, ZERO_ROWS, TERM_ROWS, DEMAND_ROWS = 5, 8, 200, 15
#: Whether a rise of a digest metric is good.
BETTER_UP = {"health_score": True, "total_searches": True, "lexical_miss_rate": False, "dissatisfaction_rate": False, "zero_result_rate": False}


def daily_trend(events: DataFrame) -> DataFrame:
    day = F.date_format("occurred_at", "yyyy-MM-dd").alias("day")
    return events.groupBy(day).agg(F.count("*").alias("searches"), F.count_if(F.col("result_count") == 0).alias("zero_results"))


def result_count_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("result_count").agg(F.count("*").alias("searches"))


def low_engagement(quality: DataFrame, threshold: float = LOW_ENGAGEMENT) -> DataFrame:
    return quality.where(F.col("dissatisfaction_rate") >= threshold).orderBy(F.desc("dissatisfaction_rate"), F.desc("searches"), "norm_query")


def zero_result_view(quality: DataFrame) -> DataFrame:
    return quality.where("zero_result_rate > 0").orderBy(F.desc("searches"), "norm_query")


def zero_result_causes(quality: DataFrame, limit: int = ZERO_ROWS) -> DataFrame:
    """The queries with the most empty answers, and whether the shop has what they ask for."""
    cause = F.when(F.col("coverage") > 0, "retrieval gap").otherwise("assortment gap")
    rows = quality.where("zero_result_rate > 0").withColumn("cause", cause)
    return rows.orderBy(F.desc(F.col("zero_result_rate") * F.col("searches")), F.desc("searches"), "norm_query").limit(limit)


def severity_bands(quality: DataFrame) -> DataFrame:
    band = F.when(F.col("severity") >= 0.5, "severe").when(F.col("severity") >= 0.3, "needs attention").otherwise("healthy")
    return quality.groupBy(band.alias("band")).agg(F.count("*").alias("queries"), F.sum("searches").alias("searches"))


def top_demand(events: DataFrame, limit: int = DEMAND_ROWS) -> DataFrame:
    return events.groupBy("norm_query").agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), "norm_query").limit(limit)


def recent_searches(events: DataFrame, limit: int = 20) -> DataFrame:
    return events.orderBy(F.desc("occurred_at"), F.desc("id")).limit(max(1, min(limit, 100)))


def matching(quality: DataFrame, text: str) -> DataFrame:
    """Queries whose display form contains the text, whatever the case."""
    return quality.where(F.contains(F.lower("display_query"), F.lit(text.lower())))


def sorted_by(rows: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Sorted with nulls last in either direction."""
    return rows.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column))


def dataset_profile(events: DataFrame, product: DataFrame) -> DataFrame:
    second = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)
    one = events.agg(
        F.count("*").alias("searches"),
        F.count_distinct("norm_query").alias("distinct_queries"),
        F.count_distinct("session_id").alias("sessions"),
        second(F.min("occurred_at")).alias("first_s"),
        second(F.max("occurred_at")).alias("last_s"),
        F.coalesce(F.bool_or(F.col("clicked_rank").isNotNull()), F.lit(False)).alias("has_clicks"),
    )
    return one.join(F.broadcast(product.agg(F.count("*").alias("products"))))


def _flags(df: DataFrame) -> DataFrame:
    """Booleans as 0 and 1, as reporting tools expect."""
    return df.withColumns({n: F.col(n).cast("int") for n, t in df.dtypes if t == "boolean"})


def fact_search(events: DataFrame, quality: DataFrame) -> DataFrame:
    scored = quality.select("norm_query", "severity", "is_problem", "retrieval_gap", "dominant_category")
    out = events.select("id", "raw_query", "norm_query", "script", "result_count", "occurred_at", "session_id", "clicked_rank", "converted")
    out = out.withColumn("date", F.date_format("occurred_at", "yyyy-MM-dd")).withColumn("hour", F.hour("occurred_at")).withColumn("is_zero", F.col("result_count") == 0)
    return _flags(out.join(scored, "norm_query", "left"))


def dim_query(quality: DataFrame) -> DataFrame:
    said = M.reason_texts(quality)
    out = said.withColumn("reason_count", F.size("reason_codes")).withColumn("reasons", F.array_join("reasons", " | ")).drop("reason_codes")
    return _flags(out.drop(*[c for c in out.columns if c.startswith("x_")]))


def dim_term(drivers: DataFrame, limit: int = TERM_ROWS) -> DataFrame:
    out = D.ranked(drivers, limit).withColumn("spellings", F.array_join("spellings", " | ")).withColumn("misspellings", F.array_join("misspellings", " | "))
    return _flags(out.drop("x_severity"))


def fact_daily(events: DataFrame, shop, days: int = 90, daily: DataFrame | None = None) -> DataFrame:
    daily = M.daily_health(events, shop, days) if daily is None else daily
    return _flags(daily.withColumn("notes", F.array_join("notes", " | ")).withColumn("day", F.date_format("day", "yyyy-MM-dd")))


def fact_suggestion(queue: DataFrame) -> DataFrame:
    return _flags(queue)


def dim_overview(quality: DataFrame) -> DataFrame:
    return _flags(M.overview(quality).withColumn("notes", F.array_join("notes", " | ")))


def tables(events: DataFrame, shop, queue: DataFrame, days: int = 90, quality: DataFrame | None = None, daily: DataFrame | None = None) -> dict[str, DataFrame]:
    """All reporting tables over one scored log: ``quality`` and ``daily`` if the caller has them, else computed once."""
    quality = M.query_quality(events, shop) if quality is None else quality
    return {
        "fact_search": fact_search(events, quality),
        "dim_query": dim_query(quality),
        "dim_term": dim_term(D.term_drivers(quality, shop)),
        "fact_daily": fact_daily(events, shop, days, daily),
        "fact_suggestion": fact_suggestion(queue),
        "dim_overview": dim_overview(quality),
    }


def _written(df: DataFrame, folder: str, name: str, ending: str, lines, line_end: str) -> dict:
    """Write ``lines(rows of one task)`` as part files of ``folder/name`` from the executors; the files and the rows."""
    import pyarrow as pa

    spark = df.sparkSession
    seen = Observation()

    def run(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        held: list[str] = []
        for line in lines(rows):
            held.append(line)
            if len(held) == 4096:
                yield pa.RecordBatch.from_pydict({"value": held})
                held = []
        if held:
            yield pa.RecordBatch.from_pydict({"value": held})

    target = f"{folder.rstrip('/')}/{name}"
    df.observe(seen, F.count(F.lit(1)).alias("rows")).mapInArrow(run, "value string").write.option("lineSep", line_end).mode("overwrite").text(target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(target)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(f.getPath().getName() for f in files.listStatus(at) if f.getPath().getName().startswith("part-"))
    rows = int(seen.get["rows"])
    if not rows:
        # Spark need not run a task for a table without rows.
        for old in found:
            files.delete(path(f"{target}/{old}"), False)
        _save(spark, f"{target}/part-00000.{ending}", line_end.join([*lines(iter(())), ""]))
        return {"files": [f"{name}/part-00000.{ending}"], "rows": 0}
    named = [f"part-{i:05d}.{ending}" for i in range(len(found))]
    for old, new in zip(found, named, strict=True):
        files.rename(path(f"{target}/{old}"), path(f"{target}/{new}"))
    return {"files": [f"{name}/{n}" for n in named], "rows": rows}


def write_csv(df: DataFrame, folder: str, name: str) -> dict:
    """CSV part files, each with a byte-order mark, its header and CRLF; a part without rows is the header ``(empty)``."""
    columns = df.columns

    def lines(rows):
        import csv
        import io

        def line(values):
            out = io.StringIO()
            csv.writer(out, dialect="excel", lineterminator="").writerow(values)
            return out.getvalue()

        n = 0
        for n, row in enumerate(rows, 1):
            if n == 1:
                yield "\ufeff" + line(columns)
            yield line(["" if v is None else v for v in row.values()])
        if not n:
            yield "\ufeff(empty)"

    # Few files for what is small, as many as there are tasks for what is not.
    return _written(df.hint("rebalance"), folder, name, "csv", lines, "\r\n")


def _save(spark, path: str, text: str) -> None:
    """A small text file in any store that Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def export_tables(found: dict[str, DataFrame], folder: str, base_url: str = "") -> dict[str, int]:
    """CSV part files of each table, written by the executors, and a manifest and a README that name them. With a
    ``base_url`` under which the folder is served, also a connection file that points there."""
    spark = next(iter(found.values())).sparkSession
    folder, base = folder.rstrip("/"), base_url.rstrip("/")
    made = {name: write_csv(df, folder, name) for name, df in found.items()}
    url = lambda file: f"{base}/{file}" if base else file
    tables_ = [{"name": n, "files": m["files"], "urls": [url(f) for f in m["files"]], "rows": m["rows"], "columns": found[n].columns} for n, m in made.items()]
    _save(spark, f"{folder}/manifest.json", json.dumps({"tables": tables_}, ensure_ascii=False, indent=1))
    if base:
        connection = {"details": {"protocol": "http", "address": {"url": f"{base}/manifest.json"}}, "mode": "Import"}
        _save(spark, f"{folder}/queryvitals.pbids", json.dumps({"version": "0.1", "connections": [connection]}, indent=1))
    _save(spark, f"{folder}/README.md", "# Reporting tables\n\n" + "".join(f"- `{n}/`: {m['rows']} rows in {len(m['files'])} files\n" for n, m in made.items()))
    return {n: m["rows"] for n, m in made.items()}


def export_json(documents: dict[str, DataFrame], folder: str, more: dict | None = None) -> dict:
    """Result tables, whole, as part files that are JSON arrays, written by the executors; ``more`` are small values, one
    file each. ``index.json`` names all files."""
    spark = next(iter(documents.values())).sparkSession
    folder = folder.rstrip("/")

    def lines(rows):
        n = 0
        for n, row in enumerate(rows, 1):
            yield ("[" if n == 1 else ",") + row["j"]
        yield "]" if n else "[]"

    index = {name: _written(df.select(F.to_json(F.struct("*")).alias("j")), folder, name, "json", lines, "\n") for name, df in documents.items()}
    for name, value in (more or {}).items():
        _save(spark, f"{folder}/{name}.json", json.dumps(value, ensure_ascii=False, default=str))
        index[name] = {"files": [f"{name}.json"]}
    _save(spark, f"{folder}/index.json", json.dumps(index, indent=1))
    return index


def delta_label(name: str, before, after) -> str:
    """A change with its sign and whether it is for the better."""
    if before is None or after is None:
        return "n/a"
    d = after - before
    shown = f"{100 * d:+.1f} pp" if name.endswith("_rate") else f"{d:+.3g}"
    if not d:
        return shown
    return f"{shown} ({'better' if (d > 0) == BETTER_UP.get(name, True) else 'worse'})"


def value_label(name: str, value) -> str:
    if value is None:
        return "n/a"
    return f"{100 * value:.1f}%" if name.endswith("_rate") else f"{value:.1f}" if isinstance(value, float) else f"{value:,}"


def narrative(before: dict, now: dict, gaps: int) -> str:
    """What a period amounts to, in sentences made from its figures alone."""
    if not now["total_searches"]:
        return "Nothing was searched in this period."
    said = [f"Shoppers searched {now['total_searches']:,} times; health stands at {now['health_score']:.1f} of 100"]
    if not before["total_searches"]:
        said[0] += ", and no earlier period is on record to set it against."
    else:
        d = now["health_score"] - before["health_score"]
        said[0] += f", {abs(d):.1f} points {'above' if d > 0 else 'below'} the period before." if abs(d) >= 0.1 else ", as in the period before."
    if now["problem_queries"]:
        said.append(f"{now['problem_queries']} queries need attention; for {gaps} of them the shop has what search did not show.")
    return " ".join(said)


def digest(events: DataFrame, shop, queue: DataFrame, days: int = 7, end: str | None = None) -> dict:
    """A period of ``days`` up to the newest search, against the period before; both own the instant between them.

    Each period is scored once; only rows that the digest prints come to the driver.
    """
    last = events.agg(F.max("occurred_at").alias("t")).first()["t"]
    if end is not None:
        import datetime

        last = datetime.datetime.fromisoformat(end)
    if last is None:
        return {"period_start": None, "period_end": None, "metrics": {}, "body_md": "# Search digest\n\nNo searches.\n"}
    start, earlier = last - timedelta(days=days), last - timedelta(days=2 * days)
    now = M.query_quality(M.in_period(events, str(start), str(last)), shop)
    old = M.query_quality(M.in_period(events, str(earlier), str(start)), shop)
    a, b = M.overview(old).first(), M.overview(now).first()
    known = old.where("is_problem").select("norm_query", F.lit(True).alias("_known"))
    problems = M.ranked(now.where("is_problem").join(known, "norm_query", "left").withColumn("is_new", F.col("_known").isNull())).limit(DIGEST_ROWS)
    gaps = now.where("is_problem AND retrieval_gap").count()
    lines = ["# Search digest", "", f"{start} to {last}", "", narrative(a.asDict(), b.asDict(), gaps), "", "| metric | before | now | change |", "|-|-|-|-|"]
    for name in BETTER_UP:
        lines.append(f"| {name} | {value_label(name, a[name])} | {value_label(name, b[name])} | {delta_label(name, a[name], b[name])} |")
    lines += ["", "## Problems", ""]
    lines += [f"- {r['display_query']}: impact {r['impact']:.4f}{' (new)' if r['is_new'] else ''}" for r in problems.collect()] or ["- none"]
    lines += ["", "## Empty answers", ""]
    lines += [f"- {r['display_query']}: {r['cause']}" for r in zero_result_causes(now).collect()] or ["- none"]
    lines += ["", "## For review", ""]
    lines += [f"- {r['kind']}: {r['source_term']} -> {r['target_term']} ({r['confidence']:.2f})" for r in V.listed(queue, "pending", limit=DIGEST_ROWS).collect()] or ["- none"]
    lines += ["", ", ".join(f"{r['pending']} {r['kind']}" for r in V.pending_by_kind(queue).orderBy("kind").collect()) or "Nothing is pending.", ""]
    return {"period_start": str(start), "period_end": str(last), "metrics": {"before": a.asDict(), "now": b.asDict()}, "body_md": "\n".join(lines)}


def upsert_digest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Digests with the new ones replacing those of the same period."""
    return old.join(new, ["period_start", "period_end"], "left_anti").select(*old.columns).unionByName(new)
