"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source gets a target number of words. A document's expected copies are target / source words (in proportion to a
weight column, if one is given); the whole part is allocated for certain, and the rest is the inclusion probability p
of one further copy. Random odds u / (1 - u), divided by inclusion odds p / (1 - p), rank the source's documents; the
sample is the start of that order whose words come nearest to what the target still lacks, so its size is fixed by the
target and misses it by half a document at most.

The cut of a source is found by two passes over sums of 4096 rank cells each and a sort of the one cell that holds it,
so no task orders a whole source, however large; every row then compares its own rank with its source's cut. The
random number is a hash of the id (of the text where the id is null), so reruns agree.

The table of one row for each source is ordered in one task: sources may be thousands, not hosts by the hundred million
(``mix`` refuses more than ``MOST_SOURCES``).

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source, last in order; a table
without words has targets 0; repeated rows rank together, each counts, and a cut may fall between them; columns of
``docs`` of any name are kept, and those of the result win a clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queryvitals.llm import kernel as K

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096
#: Sources up to which the table of one row per source is broadcast.
BROADCAST_SOURCES = 100_000
#: Sources whose targets one task may order (some 100 bytes each).
MOST_SOURCES = 10_000_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sizes: DataFrame, weights: list[int], most: int = 3) -> DataFrame:
    """(source, source_size) -> with target: shares of all sizes by weight, at most ``most`` times the size of the source.

    Weights repeat over the sources in code-point order, null last. The source with the smallest limit for its weight
    is filled first; a source is at its limit if its share of what the ones before it leave is above that. One row per
    source is ordered, never a row per document.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("bigint")
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int")).withColumn("w", w)
    ranked = ranked.withColumn("limit", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("limit") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    ranked = ranked.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two longs
    ranked = ranked.withColumn("full", wide("limit") * wide("w_left") <= wide("w") * wide("left"))
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0))
    w_rest = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    share = F.try_divide((wide("w") * rest.cast("decimal(19,0)")).cast("double"), w_rest.cast("double"))
    return ranked.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.coalesce(share, F.lit(0.0))).alias("target"))


def _rank(seed: str, odds: Column) -> Column:
    """Random odds over inclusion odds."""
    key = F.coalesce(F.col("__id").cast("string"), F.col("__th").cast("string"))
    v = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 13), 16, 10).cast("bigint")
    u = (v.cast("double") + 0.5) / float(1 << 52)
    return (u / (1.0 - u)) / odds


def _with_source(rows: DataFrame, table: DataFrame, few: bool = False) -> DataFrame:
    """Rows with the columns of their source's row (key ``__s``), a null source being a source. ``few``: the table has
    been counted and may be sent to every executor; otherwise the join shuffles, and AQE splits a hot source."""
    return rows.join(F.broadcast(table) if few else table, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s")


def mix(docs: DataFrame, weights: list[int], most: int = 3, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or the ``columns`` of it) with size, source_size, target and copies (how often the mix takes the document).

    With ``weight_col``, expected copies within a source are in proportion to that column (nulls and negatives: 0) as
    far as the limit of ``most`` copies allows.
    """
    weight = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ("size", "source_size", "target", "copies")]
    # Written once: row ids, which part equal rows, must be the same for the cuts and for the answer.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row_of"),  # as one column, so that no name can clash
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.xxhash64(text_col).alias("__th"), F.monotonically_increasing_id().alias("__row"), word_count(text_col).alias("__size"), weight.alias("__weight"),
    )
    rows = K.checkpoint(rows)
    narrow = K.checkpoint(rows.select("__id", "__source", "__th", "__row", "__size", "__weight"))
    sums = K.checkpoint(narrow.groupBy("__source").agg(F.sum("__size").alias("__all"), F.sum(F.col("__size") * F.col("__weight")).alias("__weighted")))
    sources = sums.count()
    if sources > MOST_SOURCES:
        raise ValueError(f"{sources} sources: targets are set for at most {MOST_SOURCES}")
    filled = water_fill(sums.select(F.col("__source").alias("source"), F.col("__all").alias("source_size")), weights, most)
    table = K.checkpoint(_with_source(sums, filled.select(F.col("source").alias("__s"), F.col("target").alias("__target"))).withColumnRenamed("__source", "__s"))
    few = sources <= BROADCAST_SOURCES

    def expected(rows: DataFrame, table: DataFrame) -> DataFrame:
        """Rows with whole copies, the inclusion probability of one more, and the rank (null where that is 0)."""
        if weight_col is None:
            share = F.try_divide(F.col("__target"), F.col("__all").cast("double"))
        else:
            share = F.try_divide(F.col("__target") * F.col("__weight"), F.col("__weighted"))
        joined = _with_source(rows, table, few).withColumn("__share", F.least(F.coalesce(share, F.lit(0.0)), F.lit(float(most))))
        joined = joined.withColumn("__whole", F.floor("__share")).withColumn("__p", F.col("__share") - F.floor("__share"))
        joined = joined.withColumn("__q", F.when(F.col("__p") > 0, _rank(seed, F.col("__p") / (1.0 - F.col("__p")))))
        cell = F.col("__q") / (1.0 + F.col("__q"))
        return joined.withColumn("__c1", F.floor(cell * CELLS)).withColumn("__c2", F.floor(cell * (CELLS * CELLS)))

    given = expected(narrow, table).groupBy(F.col("__source")).agg(F.sum(F.col("__size") * F.col("__whole")).alias("__given"))
    table = _with_source(table.withColumnRenamed("__s", "__source"), given.withColumnRenamed("__source", "__s"))
    table = K.checkpoint(table.withColumn("__want", F.col("__target") - F.col("__given")).drop("__given").withColumnRenamed("__source", "__s"))
    ranked = expected(narrow.where("__size > 0"), table).where("__q IS NOT NULL").withColumn("__before", F.lit(0).cast("bigint"))
    first = K.checkpoint(_cut_cell(ranked, "__c1"))
    inside = _with_source(ranked.drop("__before"), first, few).where("__c1 = __cut").drop("__cut")
    second = K.checkpoint(_cut_cell(inside, "__c2"))
    inside = _with_source(inside.drop("__before"), second, few).where("__c2 = __cut").drop("__cut")
    rank = F.struct("__q", "__id", "__th", "__row")
    order = Window.partitionBy("__source").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__mid", F.col("__before") + F.sum("__size").over(order) - F.col("__size") / 2.0)
    last = inside.where("__mid <= __want").groupBy("__source").agg(F.max(rank).alias("__last")).withColumnRenamed("__source", "__s")
    for cut in (first.select("__s", F.col("__cut").alias("__cut1")), second.select("__s", F.col("__cut").alias("__cut2")), last):
        table = _with_source(table.withColumnRenamed("__s", "__source"), cut).withColumnRenamed("__source", "__s")
    final = expected(rows, K.checkpoint(table))
    # A source without a first cut wants all its candidates; one without a second cut has its cut between two cells.
    drawn = (
        F.when(F.col("__cut1").isNull(), F.lit(True))
        .when(F.col("__c1") != F.col("__cut1"), F.col("__c1") < F.col("__cut1"))
        .when(F.col("__cut2").isNull(), F.lit(True))
        .when(F.col("__c2") != F.col("__cut2"), F.col("__c2") < F.col("__cut2"))
        .otherwise(F.coalesce(rank <= F.col("__last"), F.lit(False)))
    )
    more = F.when(F.col("__q").isNotNull() & drawn, 1).otherwise(0)
    copies = F.when(F.col("__size") > 0, F.col("__whole") + more).otherwise(0)
    return final.select(*[F.col("__row_of").getField(c).alias(c) for c in kept], F.col("__size").alias("size"), F.col("__all").alias("source_size"), F.col("__target").alias("target"), copies.cast("bigint").alias("copies"))


def _cut_cell(ranked: DataFrame, cell: str) -> DataFrame:
    """(__s, __cut, __before) of each source: the cell in which its wanted words end, and the words before that cell.
    Sources whose candidates have no more words than wanted have no row."""
    sums = ranked.groupBy("__source", "__want", "__before", cell).agg(F.sum("__size").alias("__sum"))
    upto = F.sum("__sum").over(Window.partitionBy("__source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    crossing = sums.withColumn("__upto", upto).where("__upto > __want")
    one = crossing.groupBy("__source").agg(F.min(F.struct(F.col(cell).alias("c"), (F.col("__upto") - F.col("__sum")).alias("b"))).alias("x"))
    return one.select(F.col("__source").alias("__s"), F.col("x.c").alias("__cut"), F.col("x.b").alias("__before"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it is taken."""
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("row.copies")))
    rows = mixed.where("copies > 0").select(F.struct(*[F.col(f"`{c}`") for c in mixed.columns]).alias("row")).select("row", again)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in mixed.columns])


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), [5, 2, 1], columns=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, 3 * source_size AS lim FROM s),
w AS (SELECT *, CAST([5, 2, 1][CAST((place - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS w FROM r),
b AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER o, 0) AS lft, (SELECT sum(w) FROM w) - coalesce(sum(w) OVER o, 0) AS w_left
      FROM w WINDOW o AS (ORDER BY lim / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, lim * w_left <= w * lft AS is_full FROM b),
g AS (SELECT (SELECT sum(source_size) FROM s) - coalesce(sum(lim) FILTER (is_full), 0) AS rest, sum(w) FILTER (NOT is_full) AS w_rest FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(lim AS DOUBLE) ELSE coalesce(CAST(w * rest AS DOUBLE) / CAST(w_rest AS DOUBLE), 0) END AS target FROM f, g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / CAST(source_size AS DOUBLE), 3.0) ELSE 0 END AS share FROM t),
x AS (SELECT d.doc_id, d.size, e.source, source_size, target, floor(share) AS whole, share - floor(share) AS p,
             (CAST(CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0 - u)) / (p / (1.0 - p)) END AS q FROM x),
c AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) END AS upto FROM q)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0 <= target - source_size * whole THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
