"""Connected components of an edge table, on the executors only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.llm import kernel as K

#: Edges (16 bytes each) up to which one task finds the components; a count decides, and larger tables take the joins.
ONE_TASK_EDGES = 1_000_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of the component of each, by passing and jumping labels until they are stable."""
    vertices, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(vertices))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        label, before = new[label], label
        if (label == before).all() and (label[a] == label[b]).all():
            return vertices, vertices[label]


def _in_one_task(links: DataFrame) -> DataFrame:
    def find(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            vertices, labels = smallest_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(vertices, pa.int64()), pa.array(labels, pa.int64())], names=["v", "label"])

    return links.coalesce(1).mapInArrow(find, "v bigint, label bigint")


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Edges of longs -> (v, label): the smallest vertex of the component, for every vertex with an edge.

    Up to ``one_task`` edges (they are counted) one executor task does it; beyond, the joins below, with equal results.
    Large-star and small-star steps (published, Kiveris et al. 2014) alternate until the edge set is stable. Minima are
    partial aggregates, so a hub with a third of all edges is no hot task; links never come to the driver.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = K.checkpoint(links)
    if links.count() <= one_task:
        return _in_one_task(links)
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour of u points at the smallest of u and its neighbours.
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours point at the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = K.checkpoint(small)
        # Equal edge sets have equal sums of (hash, low half) at no cost of a join.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if now == before or now[0] == 0:
            break
        before = now
    return links.select(F.col("u").alias("v"), F.col("v").alias("label")).union(links.select("v", F.col("v").alias("label")).distinct())
