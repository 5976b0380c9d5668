"""Fill-in-the-middle transformation by relations over a document's units.

Units are runs of ASCII letters and single other characters. A text is matched into pieces of ``piece`` units each, which
``posexplode`` turns into rows; a window sums the pieces' lengths, so that every piece knows where it begins. The two cut
requests of a document name unit ordinals; they are joined to the pieces that hold those units, only these are opened into
single units, whose lengths are summed up to the cut, and an aggregate leaves both offsets of each document. The
text itself is shuffled once, to meet its offsets; of the units, numbers alone are shuffled.

Documents are keyed by two hashes of (id, text); equal rows have equal cuts and share their offsets. Choices come from
sha256 of ``<seed>:<id>``, so a rerun gives the same output.

Defined cases: a null text is an empty one; an empty text, or one that holds a marker, stays plain; a null id is hashed
as an empty string; repeated rows each get their row; cuts before the first or behind the last unit leave empty parts, and
equal cuts an empty middle; an empty table gives no rows; other columns travel along, columns named like the output
are replaced, and names that start with two underscores are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = "[A-Za-z]++|[^A-Za-z]"
OUTPUT = ("n", "form", "prefix_chars", "middle_chars", "output")


def _draw(seed: int, id_col: str) -> list[Column]:
    """Four numbers below 2**32 of each id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def units(text: Column) -> Column:
    """How many units a text has: letter runs become one character, then characters are counted."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "a")).cast("bigint")


def _planned(docs: DataFrame, id_col: str, text_col: str, seed: int, plain: int, spm: int) -> DataFrame:
    """The documents with their text, number of units, form and cuts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    h1, h2, h3, h4 = (F.col(f"__h{i}") for i in range(1, 5))
    marked = F.contains("__t", F.lit(PREFIX)) | F.contains("__t", F.lit(SUFFIX)) | F.contains("__t", F.lit(MIDDLE))
    form = F.when((F.col("__n") == 0) | marked | (h3 % 100 >= 100 - plain), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = docs.withColumns({"__t": text, **{f"__h{i + 1}": h for i, h in enumerate(_draw(seed, id_col))}})
    rows = rows.withColumns({"__n": units(F.col("__t")), "__k1": F.xxhash64(F.lit(1), F.col(f"`{id_col}`"), "__t"), "__k2": F.xxhash64(F.lit(2), F.col("__t"), F.col(f"`{id_col}`"))})
    rows = rows.withColumns({"__form": form, "__a": h1 % (F.col("__n") + 1), "__b": h2 % (F.col("__n") + 1)})
    return rows.withColumns({"__lo": F.least("__a", "__b"), "__hi": F.greatest("__a", "__b")}).drop("__a", "__b", *[f"__h{i}" for i in range(1, 5)])


def offsets(planned: DataFrame, piece: int) -> DataFrame:
    """(__k1, __k2, __o1, __o2): code points before each cut of every document that is not plain."""
    key = ["__k1", "__k2"]
    cut = planned.where(F.col("__form") != "plain").select(*key, "__t", "__lo", "__hi", F.monotonically_increasing_id().alias("row"))
    # Pieces: matches of ``piece`` units (the last one of fewer). Copies of a document stay apart by row until they are summed.
    matches = F.posexplode(F.regexp_extract_all("__t", F.lit(f"(?:{_UNIT}){{1,{piece}}}+"), F.lit(0))).alias("piece", "body")
    before = Window.partitionBy(*key, "row").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.select(*key, "row", matches).select(*key, "row", "piece", F.length("body").cast("bigint").alias("chars"))
    placed = placed.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0))).groupBy(*key, "piece").agg(F.max("start").alias("start"))
    # A cut request names the last unit before the cut; a cut before the first unit asks for nothing. The piece that
    # holds that unit is opened where it was matched, and only the sum of its units up to it leaves the task.
    asked = F.filter(F.array(*[F.struct(F.lit(i).alias("cut"), (F.col(c) - 1).alias("unit")) for i, c in ((1, "__lo"), (2, "__hi"))]), lambda r: (r["unit"] >= 0) & (F.floor(r["unit"] / piece) == F.col("piece")))
    requests = cut.select(*key, "row", "__lo", "__hi", matches).select(*key, "row", "piece", "body", F.explode(asked).alias("r"))
    opened = requests.select(*key, "row", "piece", "r.cut", (F.col("r.unit") % piece).alias("last"), F.posexplode(F.regexp_extract_all("body", F.lit(_UNIT), F.lit(0))).alias("at", "unit"))
    within = opened.where(F.col("at") <= F.col("last")).groupBy(*key, "row", "piece", "cut").agg(F.sum(F.length("unit")).alias("chars"))
    within = within.groupBy(*key, "piece", "cut").agg(F.max("chars").alias("chars"))
    ends = within.join(placed, [*key, "piece"])
    return ends.groupBy(*key).agg(*[F.max(F.when(F.col("cut") == i, F.col("start") + F.col("chars"))).alias(f"__o{i}") for i in (1, 2)])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20, piece: int = 256) -> DataFrame:
    """All columns of ``docs`` with n (units), form (plain, psm, spm), prefix_chars, middle_chars and output.

    ``plain`` percent of the documents stay as they are; of the others, ``spm`` percent begin with their suffix."""
    names = [c for c in docs.columns if c not in OUTPUT]
    planned = _planned(docs, id_col, text_col, seed, plain, spm)
    # The text travels under its own name only.
    rows = planned.select(*[F.col(f"`{c}`") for c in names], "__k1", "__k2", "__n", "__form").join(offsets(planned, piece), ["__k1", "__k2"], "left")
    cut = F.col("__form") != "plain"
    text, o1, o2 = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.coalesce("__o1", F.lit(0)).cast("int"), F.coalesce("__o2", F.lit(0)).cast("int")
    first, middle, last = F.substr(text, F.lit(1), o1), F.substr(text, o1 + 1, o2 - o1), F.substr(text, o2 + 1)
    psm = F.concat(F.lit(PREFIX), first, F.lit(SUFFIX), last, F.lit(MIDDLE), middle)
    swapped = F.concat(F.lit(SUFFIX), last, F.lit(PREFIX), first, F.lit(MIDDLE), middle)
    return rows.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("__n").alias("n"),
        F.col("__form").alias("form"),
        F.when(cut, o1.cast("bigint")).alias("prefix_chars"),
        F.when(cut, (o2 - o1).cast("bigint")).alias("middle_chars"),
        F.when(F.col("__form") == "psm", psm).when(F.col("__form") == "spm", swapped).otherwise(text).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The exact text, from the output and its form alone. A text with markers is never cut, so each marker is one of ours."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]'), []) AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS lo, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS hi,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
