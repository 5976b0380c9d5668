"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds, in each slot, one bit for each language: the AND of an n-gram's slots is the set of
all languages that contain it. A text's n-grams are looked up at once, the bits are counted by language, and each
count is corrected for the false positives that the fill of that language's slice predicts; the largest corrected
count decides, and its share of the text's n-grams is the score.

N-grams are four bytes of the text with ASCII letters in lower case and runs of other ASCII made one blank, so that
word borders count. A language contains an n-gram if its rate there is at least ``share`` of the highest rate of any
language and it was seen twice; rates and not counts, so that a language with many documents does not take all bits.

The classifier is fitted on at most about ``train_rows`` labelled rows of each language, chosen by a hash of the id
(a documented bound; whole texts), and learns the ``most_languages`` most frequent labels, since a filter of fixed size
is kept for each. Prediction reads nothing but the text, and whole texts.

Defined cases: text null or without a letter gives ``und`` and score 0; a text with letters but without any known
n-gram gets the language with the most training rows and score 0; ties go to the language with more training rows, then the
smaller name; no labelled rows gives ``und`` for all. Repeated rows and clashing columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryvitals.llm import kernel as K

GRAM = 4
PLANE = 62
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def fold_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of every text, in order, and the row borders."""
    texts = [b" " + (t or "").encode() + b" " for t in column.to_pylist()]
    sizes = np.array([len(t) for t in texts], np.int64)
    data = _FOLD[np.frombuffer(b"".join(texts), np.uint8)]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    blank = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (row[1:] != row[:-1])
    data, row = data[keep].astype(np.uint32), row[keep]
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    value = np.zeros(n, np.uint32)
    for i in range(GRAM):
        value = (value << np.uint32(8)) | data[i : i + n]
    inside = row[:n] == row[GRAM - 1 :]
    return value[inside], np.searchsorted(row[:n][inside], np.arange(len(texts) + 1))


def slots(values: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
    """Bloom slots of each n-gram, by double hashing."""
    h = K.mix(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    a, b = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64) | 1
    return [(a + i * b) & (size - 1) for i in range(hashes)]


class Filters:
    """A fitted bit-sliced Bloom filter: ``table`` has one plane of slots for each 62 languages."""

    def __init__(self, languages: list[str], table: np.ndarray, hashes: int):
        self.languages, self.hashes = languages, hashes
        kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint32 if len(languages) <= 32 else np.uint64
        self.table = table.astype(kind)
        fill = [((self.table[i // PLANE] & kind(1 << (i % PLANE))) != 0).mean() for i in range(len(languages))]
        #: The chance that an n-gram which the language lacks reads as contained.
        self.false_rate = np.array(fill) ** hashes

    def containing(self, values: np.ndarray) -> np.ndarray:
        """Masks of all languages that contain each n-gram: (planes, n-grams)."""
        at = slots(values, self.table.shape[1], self.hashes)
        found = self.table[:, at[0]]
        for more in at[1:]:
            found = found & self.table[:, more]
        return found

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages): n-grams of each row that each language contains, corrected; and n-grams of each row."""
        values, at = grams(column)
        n = np.diff(at)
        out = np.zeros((len(n), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            masks = self.containing(values)
            heads = at[:-1][some]
            for i in range(len(self.languages)):
                bit = masks.dtype.type(1 << (i % PLANE))
                hits = np.add.reduceat((masks[i // PLANE] & bit) != 0, heads, dtype=np.int64)
                # Rounded, so that what the correction leaves beyond a millionth of an n-gram breaks no tie.
                out[some, i] = np.round(np.maximum(0, (hits - n[some] * self.false_rate[i]) / max(1 - self.false_rate[i], 1e-9)), 6)
        return out, n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 5_000, size: int = 1 << 20, hashes: int = 3, share: float = 0.25, most_languages: int = 1_000) -> Filters:
    """Filters from the labelled rows of ``docs``, at most about ``train_rows`` of each language."""
    K.small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    inventory = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    languages = [r["lang"] for r in inventory]
    if not languages:
        return Filters([], np.zeros((1, size), np.uint64), hashes)
    # At most most_languages rows.
    known = [(lang, i, int(min(1.0, train_rows / r["n"]) * (1 << 30))) for i, (lang, r) in enumerate(zip(languages, inventory, strict=True))]
    known = F.broadcast(docs.sparkSession.createDataFrame(known, "lang string, number int, upto long"))
    sample = labelled.join(known, "lang").where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) <= F.col("upto"))
    sample = sample.select(F.col("number").alias("lang"), "text")

    def count(batches):
        pending, held = [], 0
        for part in K.chunks(batches, "text", 1 << 20):
            values, at = grams(part.column(1))
            lang = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))
            pending.append(np.unique((lang << 32) | values.astype(np.int64), return_counts=True))
            held += len(pending[-1][0])
            if held > 1 << 21:
                pending = [_summed(pending)]
                held = len(pending[0][0])
        if pending:
            keys, n = _summed(pending)
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array(k & 0xFFFFFFFF), pa.array(n[i : i + (1 << 16)].astype(np.int64))], names=["lang", "gram", "n"])

    counted = K.checkpoint(sample.mapInArrow(count, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = F.broadcast(counted.groupBy("lang").agg(F.sum("n").cast("double").alias("total")))
    rated = counted.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total")).select("lang", "gram", "n", "rate")
    by_gram = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("has"))
    owned = by_gram.select("gram", F.explode("has").alias("o"), "top").where((F.col("o.n") >= 2) & (F.col("o.rate") >= share * F.col("top")))
    masks = owned.groupBy("gram", F.floor(F.col("o.lang") / PLANE).cast("int").alias("plane")).agg(F.bit_or(F.expr(f"shiftleft(1L, o.lang % {PLANE})")).alias("mask"))

    def place(batches):
        for b in batches:
            at = np.concatenate(slots(b.column(0).to_numpy().astype(np.uint32), size, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(b.column(1).to_numpy(), hashes)), pa.array(at), pa.array(np.tile(b.column(2).to_numpy(), hashes))], names=["plane", "slot", "mask"])

    filled = masks.mapInArrow(place, "plane int, slot bigint, mask bigint").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(((len(languages) - 1) // PLANE + 1, size), np.uint64)
    table[filled.column("plane").to_numpy(), filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().astype(np.uint64)
    return Filters(languages, table, hashes)


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; rows and other columns are kept, and those of the result win a clash."""
    K.small_batches(docs.sparkSession)
    # Plain values only: a broadcast is not pickled together with this package.
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table, filters.hashes))
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        f = Filters(*sent.value)
        for part in K.chunks(batches, docs_text, 1 << 20):
            column = part.column(place)
            counts, n = f.counts(column)
            letters = np.array([t is not None and _has_letter(t) for t in column.to_pylist()], bool)
            if f.languages:
                best = counts.argmax(axis=1)
                score = np.clip(counts[np.arange(len(n)), best] / np.maximum(n, 1), 0, 1)
            else:
                best, score = np.zeros(len(n), np.int64), np.zeros(len(n))
            named = [f.languages[b] if ok and f.languages else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(named, pa.string()), pa.array(np.where(letters, score, 0.0))], names=[*part.schema.names, "lang_pred", "score"])

    docs_text = text_col
    return docs.mapInArrow(run, schema)


def _has_letter(text: str) -> bool:
    for i in range(0, len(text), 64):
        if any(map(str.isalpha, text[i : i + 64])):
            return True
    return False


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows outside the held-out fold and predict every row: (id, held_out, lang_pred, score)."""
    filters = fit(docs.where(fold_of(id_col) != 0), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), F.coalesce(fold_of(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col))
    return predict(rows, filters, text_col)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    found = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "held_out", "lang_pred", "score")
