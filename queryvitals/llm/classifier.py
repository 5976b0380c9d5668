"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of the whole text (lengths, shares of character classes, repetition of words and lines) are scaled,
mapped to ``features`` cosines that approximate a Gaussian kernel, and fitted to the label by ridge regression. The
normal equations are sums of outer products, so each partition sends one matrix of fixed size; the raw score is then
made a probability by isotonic regression on a part of the training rows that the ridge fit does not see.

The classifier is fitted on at most about ``train_rows`` labelled rows, chosen by a hash of the id (a documented
bound, which also bounds the label rows that are broadcast). Every text is scored from the whole text alone.

Defined cases: null and empty texts have statistics of zero words and get the score that the model gives these; no
usable label gives 0.5 for all; one label value only gives its smoothed rate; an id with several labels counts with
the smallest, and one with several texts with the smallest of these; null labels and labels without a document are not
used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.llm import kernel as K
from queryvitals.llm.language import fold_of

# Byte classes of the statistics.
_CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b"#*$%&|<>",
    b".,;:?",
    b"!",
    b"\"'()-",
    b"=@/\\_+~^`[]{}",
    b"\n",
    bytes(range(0x80, 0x100)),
]
STATS = 2 * len(_CLASSES) + 9


def _distinct(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct hashes of each row."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=rows)


_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, STATS) numbers of the whole texts; all zero for null and empty ones."""
    w = K.Words(column)
    data, offsets = K.column_bytes(column)
    rows = w.rows
    size = np.diff(offsets).astype(float)
    out = np.zeros((rows, STATS))
    if not len(data):
        return out
    sums = np.zeros(len(data) + 1, np.int64)
    for i, members in enumerate(_CLASSES):
        np.cumsum(K._byte_mask(members)[data], out=sums[1:])
        share = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)
        out[:, 2 * i] = share
        out[:, 2 * i + 1] = np.sqrt(share)
    at = 2 * len(_CLASSES)
    words = w.count.astype(float)
    some = np.maximum(words, 1)
    row = w.row_of()
    length = (w.end - w.start).astype(float)
    mean = np.bincount(row, length, rows) / some
    five = w.window_starts(5)
    five_row = np.searchsorted(w.first, five, side="right") - 1
    lines = K.Words(column, _LINE)
    n_lines = lines.count.astype(float)
    out[:, at] = np.log1p(size)
    out[:, at + 1] = np.log1p(words)
    out[:, at + 2] = mean
    out[:, at + 3] = np.sqrt(np.maximum(np.bincount(row, length**2, rows) / some - mean**2, 0))
    out[:, at + 4] = np.bincount(row, length <= 3, rows) / some
    out[:, at + 5] = 1 - _distinct(row, w.hash, rows) / some
    out[:, at + 6] = 1 - _distinct(five_row, w.windows(five, 5), rows) / np.maximum(np.bincount(five_row, minlength=rows), 1)
    out[:, at + 7] = 1 - _distinct(lines.row_of(), lines.hash, rows) / np.maximum(n_lines, 1)
    out[:, at + 8] = np.log1p(n_lines)
    for i in (5, 7):
        out[words == 0, at + i] = 0
    out[np.bincount(five_row, minlength=rows) == 0, at + 6] = 0
    out[n_lines == 0, at + 7] = 0
    return out


class Model:
    """Scaling, cosines, ridge weights and the calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int = 17, width: float = 4.0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, 1 / width, (len(mean), features))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.levels = np.zeros(1), np.full(1, 0.5)

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and rates of the pooled blocks, each smoothed by half a case of either label."""
    blocks: list[list[float]] = []
    for v, label in zip(*(a[np.argsort(x, kind="stable")].tolist() for a in (x, y)), strict=True):
        blocks.append([v, label, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    rates = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate(rates)


def fit(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 40_000, features: int = 256, ridge: float = 1e-3) -> Model:
    """A model from labelled documents of the folds 1 to 4: 1 to 3 fit the ridge, 4 calibrates."""
    K.small_batches(docs.sparkSession)
    usable = labels.where(F.col(label).isNotNull() & (fold_of(id_col) != 0)).select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"))
    n = usable.select("id").distinct().count()
    chosen = usable.where(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) <= int(min(1.0, train_rows / max(n, 1)) * (1 << 30)))
    chosen = chosen.groupBy("id").agg(F.min("y").alias("y")).withColumn("fold", F.crc32(F.col("id").cast("string")) % 5)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = source.join(F.broadcast(chosen), "id").groupBy("id", "y", "fold").agg(F.min("text").alias("text")).select("y", "fold", "text")

    def measure(batches):
        for part in K.chunks(batches, "text", 1 << 20):
            s = statistics(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), STATS).cast(pa.list_(pa.float64()))], names=["y", "fold", "s"])

    measured = K.checkpoint(rows.mapInArrow(measure, "y double, fold bigint, s array<double>").repartition(8))
    moments = np.zeros((3, STATS))
    for part in _sums(measured.where("fold < 4"), lambda s, y: np.stack([np.full(STATS, len(y)), s.sum(0), (s**2).sum(0)]), (3, STATS)):
        moments += part
    if not moments[0, 0]:
        return Model(np.zeros(STATS), np.ones(STATS), features)
    mean = moments[1] / moments[0]
    scale = np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), features)
    system = np.zeros((features + 1, features + 2))
    for part in _sums(measured.where("fold < 4"), lambda s, y: (z := model.cosines(s)).T @ np.column_stack([z, y]), system.shape):
        system += part
    model.weights = np.linalg.solve(system[:, :-1] + ridge * moments[0, 0] * np.eye(features + 1) / features, system[:, -1])
    # Bounded by train_rows.
    held = measured.where("fold = 4").select("y", "s").toArrow()
    if not held.num_rows:
        held = measured.select("y", "s").toArrow()
    stats = np.array(held.column("s").to_pylist()).reshape(-1, STATS)
    model.knots, model.levels = isotonic(model.raw(stats), held.column("y").to_numpy())
    return model


def _sums(measured: DataFrame, term, shape: tuple) -> list[np.ndarray]:
    """One sum of ``term`` for each partition; the partitions are few and the sums of fixed size."""

    def add(batches):
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += term(np.array(b.column(2).flatten()).reshape(-1, STATS), b.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return [np.frombuffer(r["total"], np.float64).reshape(shape) for r in measured.mapInArrow(add, "total binary").collect()]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    K.small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in K.chunks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(statistics(part.column(1))))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double")


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    found = score(docs, model)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(fold_of("id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
