"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words (and pairs of neighbouring words) are hashed into a fixed number of buckets. Two multinomials over the buckets
are counted over the whole corpus: one over all texts (raw) and one over the trusted texts (target; by default those
of ten words or more without symbols, without repeated lines and not written in capitals). A text's score is the sum
of log(target / raw) over its n-grams, divided by their number; it is kept if that reaches ``threshold``. Log ratios
are held as whole millionths, so a score is an exact sum and the verdict the same whatever the order of addition.

Counts of a text never leave its row; the only shuffle is that of the bucket counts, at most one row for each bucket
and task. The ratios are one row with as many numbers as buckets (a parameter), which becomes an array literal of
the scoring plan; the driver handles nothing else.

Repeated windows are compared word by word: their hashes only tell which texts need the comparison.

Defined cases: null and empty texts have no words, zero counts, and fail the base rules; a text with one word has one
n-gram; repeated rows and repeated ids are separate texts; an empty corpus has ratios of 0; without any trusted text the
ratio is that of smoothing alone; columns of any name travel through ``judged``, and those of the result win a clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryvitals.llm.mixing import WORD

BUCKETS = 1 << 14
MICRO = 1_000_000
#: Whole multiplier that makes the code of a pair from the codes of its words.
PAIR = 1_000_003
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "llr_sum", "base_failed", "kept")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The row (``__row_of``), its words and their crc32 codes, and n_words, word_chars, n_symbols, n_dup_lines and n_capitals."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row_of"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    count = lambda pattern: F.regexp_count("__text", F.lit(pattern)).cast("bigint")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD))
    out = packed.select("__row_of", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)).alias("__words"), lines.alias("__lines"), count(SYMBOLS).alias("n_symbols"), count("[A-Z]").alias("n_capitals"))
    out = out.withColumn("__codes", F.transform("__words", lambda w: F.crc32(w))).withColumn("n_words", F.size("__words").cast("bigint"))
    out = out.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("bigint"))
    return out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint")).drop("__lines")


def _shifted(a: str, by: int) -> Column:
    return F.slice(F.col(a), by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _in_twos(docs: DataFrame, keyed: Column, out: str) -> DataFrame:
    """``docs`` with ``out``: places i of the entries (h, i) of ``keyed`` whose h another entry has too."""
    ordered = docs.withColumn("__sorted", F.sort_array(keyed))
    same = ordered.withColumn("__same", F.zip_with("__sorted", _shifted("__sorted", 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    either = F.zip_with("__same", F.concat(F.array(F.lit(False)), F.col("__same")), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    flagged = same.withColumn("__flag", F.zip_with("__sorted", either, lambda s, f: F.when(f & s.isNotNull(), s["i"])))
    return flagged.withColumn(out, F.array_compact("__flag")).drop("__sorted", "__same", "__flag")


def repeated_words(counted: DataFrame) -> DataFrame:
    """``counted`` with n_repeat_words: words inside windows of five that the text has twice or more.

    A text without two equal window hashes has none. In others, the windows that share a hash are sorted by their
    words and count only if these are equal.
    """
    hashes = F.transform(_shifted("__codes", WINDOW - 1), lambda last, i: F.xxhash64(*[F.get("__codes", i + k) for k in range(WINDOW - 1)], last))
    hashed = counted.withColumn("__five", hashes)
    hashed = hashed.withColumn("__some", F.size(F.array_distinct("__five")) < F.size("__five"))
    alike = _in_twos(hashed, F.when(F.col("__some"), F.transform("__five", lambda h, i: F.struct(h.alias("h"), i.alias("i")))), "__alike")
    equal = _in_twos(alike, F.transform("__alike", lambda i: F.struct(F.slice("__words", i + 1, WINDOW).alias("h"), i.alias("i"))), "__equal")
    places = equal.withColumn("__at", F.sort_array("__equal"))
    steps = F.zip_with("__at", _shifted("__at", 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    done = places.withColumn("n_repeat_words", F.when(F.col("__some"), F.coalesce(covered, F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
    return done.drop("__five", "__some", "__alike", "__equal", "__at")


def grams(codes: str = "__codes") -> Column:
    """Bucket numbers of all words and all pairs."""
    pairs = F.slice(F.zip_with(F.col(codes), _shifted(codes, 1), lambda a, b: F.pmod(a * PAIR + b, F.lit(BUCKETS))), 1, F.greatest(F.size(codes) - 1, F.lit(0)))
    return F.concat(F.transform(F.col(codes), lambda c: F.pmod(c, F.lit(BUCKETS))), pairs)


def trusted() -> Column:
    """The default target: by the base counts alone."""
    return (F.col("n_words") >= 10) & (F.col("n_symbols") == 0) & (F.col("n_dup_lines") == 0) & (10 * F.col("n_capitals") <= 3 * F.col("word_chars"))


def log_ratios(docs: DataFrame, is_trusted: Column | None = None, text_col: str = "text") -> list[int]:
    """Millionths of log(target / raw) of every bucket, add-one smoothed, from all texts: one row of fixed size."""
    counted = base_counts(docs.select(F.col(text_col).alias("text")))
    is_trusted = trusted() if is_trusted is None else is_trusted
    judged_once = counted.select(F.coalesce(is_trusted, F.lit(False)).alias("t"), grams().alias("a"))
    # Not ``explode``: its inferred filter on the array would make the optimizer compute the array twice.
    each = judged_once.select("t", F.explode_outer("a").alias("g")).groupBy("g", "t").agg(F.count("*").alias("n"))
    sums = each.groupBy("g").agg(F.sum("n").alias("raw"), F.sum(F.when(F.col("t"), F.col("n"))).alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("g")).join(sums, "g", "left")
    smoothed = every.select("g", (F.coalesce("raw", F.lit(0)) + 1).alias("raw"), (F.coalesce("target", F.lit(0)) + 1).alias("target"))
    one = smoothed.agg(F.array_sort(F.collect_list(F.struct("g", "raw", "target"))).alias("b"), F.sum("raw").cast("double").alias("n"), F.sum("target").cast("double").alias("m"))
    ratio = lambda x: F.floor(F.log((x["target"].cast("double") * F.col("n")) / (x["raw"].cast("double") * F.col("m"))) * MICRO + 0.5).cast("bigint")
    return one.select(F.transform("b", ratio).alias("ratios")).first()["ratios"]


def judged(docs: DataFrame, ratios: list[int], threshold: float = -0.15, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, llr_sum (millionths), n_grams and kept. ``ratios``: see ``log_ratios``."""
    out = repeated_words(base_counts(docs, text_col))
    # A foldable expression: the optimizer makes it one array literal.
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    out = out.withColumn("n_grams", F.greatest(2 * F.col("n_words") - 1, F.lit(0)).cast("bigint"))
    out = out.withColumn("llr_sum", F.aggregate(grams(), F.lit(0).cast("bigint"), lambda s, g: s + F.get(table, g.cast("int"))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~failed & (F.col("llr_sum") >= int(threshold * MICRO) * F.col("n_grams")))
    return out.select(*[F.col("__row_of").getField(c).alias(c) for c in docs.columns if c not in RESULT], *RESULT)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, log_ratios(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _crc_table() -> list[int]:
    """The byte table of the public CRC-32 polynomial, by its rule."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


OP9_SQL = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
voc AS (SELECT DISTINCT unnest(w) AS x FROM d),
tab AS (SELECT """
    + str(_crc_table())
    + r"""::BIGINT[] AS t),
bytes AS (SELECT x, hex(encode(x)) AS h FROM voc),
lists AS (SELECT x, list_transform(range(0, CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM bytes),
crc AS (SELECT x, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, y: xor(a >> 8, tab.t[CAST(xor(a, y) & 255 AS BIGINT) + 1]))) AS c FROM lists, tab),
tok AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
cod AS (SELECT doc_id, i, c, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS c2 FROM tok JOIN crc USING (x)),
gr AS (SELECT doc_id, c % 16384 AS g FROM cod UNION ALL SELECT doc_id, (c * 1000003 + c2) % 16384 FROM cod WHERE c2 IS NOT NULL),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM win) WHERE k > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
                CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS caps
         FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rw USING (doc_id)),
tr AS (SELECT *, n_words >= 10 AND n_symbols = 0 AND n_dup_lines = 0 AND 10 * caps <= 3 * word_chars AS ok FROM base),
cnt AS (SELECT g, count(*) + 1 AS r, count(*) FILTER (ok) + 1 AS t FROM gr JOIN tr USING (doc_id) GROUP BY g),
tot AS (SELECT sum(r) + 16384 - count(*) AS n, sum(t) + 16384 - count(*) AS m FROM cnt),
rat AS (SELECT g, CAST(floor(ln((CAST(t AS DOUBLE) * CAST(n AS DOUBLE)) / (CAST(r AS DOUBLE) * CAST(m AS DOUBLE))) * 1000000 + 0.5) AS BIGINT) AS v FROM cnt, tot),
sc AS (SELECT doc_id, sum(v) AS s, count(*) AS k FROM gr JOIN rat USING (g) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(s >= -150000 * k, true) AS kept
FROM tr LEFT JOIN sc USING (doc_id)
"""
)
