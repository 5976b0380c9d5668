"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Equal sets are one class, so copies cost one vertex. Classes are
branched recursively: a tree's node is split by a minwise token that the path selects, so that classes of similarity s
stay together with probability s at each chosen token; independent trees repeat this. In each node:

* every class is first compared with one hub of the node, and the components of
  the links found that way are taken; a group of near copies collapses here without its pairs being listed;
* nodes that still hold several components are compared exhaustively across components if that is at most ``spread``
  pairs a member; crowds of similar sets, which further tokens would not part, are compared exhaustively in blocks of
  bounded size; other nodes are branched by ``branches`` tokens that a hash of their path chooses among those the path
  has not used. Once at most ``few_left`` entries, or after ``depth`` levels, whatever is left is compared in blocks.
  Nothing is capped.

Pairs must pass two tests before full sets are fetched: set sizes that allow the similarity (exact), and 128 sketch
bits (four bits of each of 32 minwise tokens) of which at most 48 differ; a pair at similarity 0.8 fails that with
probability of 3e-8. A pair at 0.8 is parted by all of the ``trees`` first splits with probability 0.2**trees (2e-8 for
eleven), and by those or a later level, if its nodes branch to the full depth in every tree, with one of 4e-8 (at 0.85:
1e-9), so a direct link is missed with about 7e-8 in all. The figures of the levels are those of a model that
``test_near_duplicates_branching_keeps_links`` holds against the code. Every link is confirmed on the full sets.

Defined cases: null, empty and wordless texts have an empty set, are linked with nothing and are their own component;
texts shorter than the shingle are one shingle of all their words; rows that share an id are one vertex (linked with
whatever any of them is); documents without an id take part, and a component without any id has the component id null
and keeps its rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.llm import kernel as K
from queryvitals.llm.components import components

MINS = 64
#: The first tokens, of which the sketch has four bits each.
SKETCHED = 32
SKETCH_BITS = 48
BITMAP_BITS = 1 << 24
BLOCK_TOKENS = 1 << 19
_SEEDS = np.random.default_rng(7_919).integers(1, 2**63, (MINS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and the row borders."""
    w = K.Words(column, K.NON_SPACE, lower=True)
    starts = w.window_starts(size)
    row = np.searchsorted(w.first, starts, side="right") - 1
    hashes = w.windows(starts, size)
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    whole = np.concatenate([w.windows(w.first[short[w.count[short] == n]], n) for n in range(1, size)]) if len(short) else np.zeros(0, np.uint64)
    short = np.concatenate([short[w.count[short] == n] for n in range(1, size)]) if len(short) else short
    row, hashes = np.concatenate([row, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    return hashes, np.searchsorted(row, np.arange(w.rows + 1))


def _set_hash(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash for each whole set; 0 for empty sets."""
    n = np.diff(at)
    some = np.flatnonzero(n)
    s = np.zeros(len(n), np.uint64)
    if len(some):
        s[some] = K.mix(np.add.reduceat(K.mix(hashes.copy()), at[:-1][some]) + n[some].astype(np.uint64))
    return s


def signatures(docs: DataFrame, size: int, trees: int) -> DataFrame:
    """(id, th, n, s, mins, x1, x2): set size, set hash, minwise tokens and sketch bits of every row."""

    def sign(batches):
        for part in K.chunks(batches, "text"):
            hashes, at = shingles(part.column(2), size)
            n = np.diff(at)
            some = np.flatnonzero(n)
            heads = at[:-1][some]
            s = _set_hash(hashes, at)
            mins = np.zeros((part.num_rows, MINS), np.uint64)
            bits = np.zeros((part.num_rows, 2), np.uint64)
            if len(some):
                for j in range(MINS):
                    # A bijection of the hash, ordered by its high bits.
                    x = hashes ^ (hashes >> np.uint64(29))
                    x = (x * _SEEDS[j, 0]) ^ _SEEDS[j, 1]
                    x ^= x >> np.uint64(32)
                    x *= _SEEDS[(j + 1) % MINS, 0]
                    mins[some, j] = np.minimum.reduceat(x, heads)
                low = K.mix(mins[some, :SKETCHED].ravel()).reshape(-1, SKETCHED) & np.uint64(15)
                for j in range(SKETCHED):
                    bits[some, j // 16] |= low[:, j] << np.uint64(4 * (j % 16))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(s.view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(mins.view(np.int64).ravel()), MINS).cast(pa.list_(pa.int64())), pa.array(bits[:, 0].view(np.int64)), pa.array(bits[:, 1].view(np.int64))],
                names=["id", "th", "n", "s", "mins", "x1", "x2"],
            )

    return docs.mapInArrow(sign, "id bigint, th bigint, n bigint, s bigint, mins array<bigint>, x1 bigint, x2 bigint")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(s, grams) for the classes ``wanted`` (s, id, th): the whole set of each, from one row of the class.

    Only rows that a fixed-size bitmap of the wanted (id, th) lets through leave the scan; what it lets through by
    chance is dropped by the exact join, so the bitmap saves shuffle and decides nothing.
    """
    key = F.pmod(F.xxhash64("id", "th"), F.lit(BITMAP_BITS))
    words = wanted.select(key.alias("k")).select(F.floor(F.col("k") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(k % 64 AS int))").alias("m"))
    words = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, np.uint64)
    bitmap[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def gather(batches):
        for batch in batches:
            k = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((sent.value[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1) != 0))
            for part in K.chunks([batch], "text"):
                hashes, at = shingles(part.column(1), size)
                yield pa.RecordBatch.from_arrays([pa.array(_set_hash(hashes, at).view(np.int64)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))], names=["s", "grams"])

    sets = docs.select(key.alias("k"), "text").mapInArrow(gather, "s bigint, grams array<bigint>")
    return sets.join(wanted.select("s"), "s", "left_semi").dropDuplicates(["s"])


def _possible(percent: int):
    """Set sizes that allow the similarity, and near sketches, of the classes a and b."""
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND bit_count(xa1 ^ xb1) + bit_count(xa2 ^ xb2) <= {SKETCH_BITS}")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity. Sets are fetched by two joins that AQE may split by key."""
    left = pairs.join(sets.select(F.col("s").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("s").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(100 * shared >= percent * (F.size("ga") + F.size("gb") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, trees: int = 11, spread: int = 8, branches: int = 3, depth: int = 5, block: int = 1024, few_left: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, th (xxhash64 of the text), n_shingles, component_id, and keeper: whether its (id, th)
    is the first of its component, identified documents before others; every document with an empty set is one."""
    if depth + branches > _pool(trees):
        raise ValueError(f"depth + branches may not exceed the {_pool(trees)} tokens that {trees} trees leave")
    K.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    signed = K.checkpoint(signatures(source, size, trees))
    # One class for each distinct set; its row with the smallest id stands for it.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    classes = signed.where("n > 0").groupBy("s").agg(first.alias("r"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("x1").alias("x1"), F.first("x2").alias("x2"))
    classes = K.checkpoint(classes.select("s", "r.id", "r.th", "n", "mins", "x1", "x2"))
    distinct = classes.count()
    classes, total = K.packed(classes, distinct), distinct * trees
    roots = classes.select("s", "n", "x1", "x2", F.posexplode(F.slice("mins", 1, trees)).alias("tree", "m")).select("s", "n", "x1", "x2", "tree", F.xxhash64("tree", "m").alias("path"))
    # The hub of a node is its smallest class in every second tree and its largest in the others.
    hubs = K.checkpoint(roots.groupBy("path").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("members")).where("lo <> hi"))
    shared_nodes = K.checkpoint(_with_node(roots, hubs, total).select("path", "s", "n", "x1", "x2", F.when(F.col("tree") % 2 == 0, F.col("lo")).otherwise(F.col("hi")).alias("hub")))
    shared_nodes = K.packed(shared_nodes, total)
    hub = classes.select(F.col("s").alias("hub"), F.col("n").alias("hn"), F.col("x1").alias("h1"), F.col("x2").alias("h2"))
    spokes = shared_nodes.where("s <> hub").select("s", "n", "x1", "x2", "hub").distinct().join(hub, "hub")
    edges = spokes.select(
        F.least("s", "hub").alias("a"), F.greatest("s", "hub").alias("b"), F.col("n").alias("na"), F.col("hn").alias("nb"), F.col("x1").alias("xa1"), F.col("h1").alias("xb1"), F.col("x2").alias("xa2"), F.col("h2").alias("xb2")
    )
    tried = K.checkpoint(edges.where(_possible(percent)).select("a", "b").distinct())
    ids = classes.select("s", "id", "th")

    def sets_of(pairs):
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct().join(ids, "s")
        return full_sets(source, wanted, size)

    found = K.checkpoint(confirmed(tried, sets_of(tried), percent))
    # Rows that share an id are one vertex.
    shared = signed.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("a", "b")
    linked = found.union(_same_id(signed, shared))
    labels = components(linked)
    nodes = shared_nodes.join(labels.select(F.col("v").alias("s"), "label"), "s", "left").select("s", "n", "x1", "x2", "path", F.coalesce("label", "s").alias("label"), F.lit(0).cast("bigint").alias("used"))
    pairs, dense = [], []
    for level in range(depth + 1):
        nodes = K.checkpoint(nodes)
        total = nodes.count()
        nodes = K.packed(nodes, total)
        here = K.packed(K.checkpoint(_with_node(nodes, _unsettled(nodes, total, spread, last=level == depth), total)), total)
        pairs.append(_across(here.where("way = 'pairs'"), percent))
        dense.append(here.where("way = 'blocks'").select("path", "s", "label", "members", "tokens"))
        rest = here.where("way = 'branch'")
        if level == depth or rest.count() <= few_left:
            # So few that comparing them in blocks, which misses nothing, costs less than another level.
            dense.append(rest.select("path", "s", "label", "members", "tokens"))
            break
        nodes = _branched(rest, classes, level, branches, trees)
    rest = K.checkpoint(reduce(DataFrame.union, pairs).distinct().join(tried, ["a", "b"], "left_anti"))
    crowd = K.checkpoint(reduce(DataFrame.union, dense))
    wanted = rest.select(F.explode(F.array("a", "b")).alias("s")).union(crowd.select("s")).distinct().join(ids, "s")
    sets = full_sets(source, K.checkpoint(wanted), size)
    more = K.checkpoint(confirmed(rest, sets, percent).union(_linked_in_blocks(crowd, sets, percent, block)))
    if not more.isEmpty():
        labels = components(linked.union(more))
    by_class = ids.select("s").join(labels.select(F.col("v").alias("s"), "label"), "s", "left").select("s", F.coalesce("label", "s").alias("label"))
    rows = signed.select("id", "th", "n", "s").join(by_class, "s", "left")
    place = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "th")
    lowest = rows.where("n > 0").groupBy("label").agg(F.min("id").alias("component_id"), F.min(place).alias("first"))
    lone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    keeper = (F.col("n") == 0) | (place == F.col("first"))
    return rows.join(lowest, "label", "left").select(F.col("id").alias(id_col), "th", F.col("n").alias("n_shingles"), lone.alias("component_id"), keeper.alias("keeper"))


def _pool(trees: int) -> int:
    """Tokens kept for branching: a prime number, so that every stride visits all of them, and few enough for a bit mask."""
    return max((n for n in range(2, min(MINS - trees, 63) + 1) if all(n % d for d in range(2, n))), default=0)


def _branched(nodes: DataFrame, classes: DataFrame, level: int, branches: int, trees: int) -> DataFrame:
    """The next level of ``nodes``, each split by ``branches`` tokens. A hash of the path, hence of tree, tokens and level,
    chooses them, so that trees and sibling nodes are parted by different ones; a used token would not split the node."""
    pool = _pool(trees)
    drawn = f"transform(sequence(0, {branches + level - 1}), i -> cast((pmod(path, {pool}) + i * (1 + pmod(xxhash64(path), {pool - 1}))) % {pool} AS int))"
    chosen = F.expr(f"slice(filter({drawn}, c -> (shiftright(used, c) & 1) = 0), 1, {branches})")
    split = nodes.select("s", "n", "x1", "x2", "label", "path", "used", F.explode(chosen).alias("c"))
    token = F.element_at("mins", F.col("c") + trees + 1)
    return split.join(classes.select("s", "mins"), "s").select("s", "n", "x1", "x2", "label", F.expr("used | shiftleft(1L, c)").alias("used"), F.xxhash64("path", "c", token).alias("path"))


def _same_id(signed: DataFrame, shared: DataFrame) -> DataFrame:
    """Links among all classes of an id that has several; ``shared`` is empty where ids are unique."""
    several = signed.where("n > 0 AND id IS NOT NULL").groupBy("id", "s").count().select("id", "s")
    return several.join(several.groupBy("id").agg(F.min("s").alias("a"), F.count("*").alias("k")).where("k > 1"), "id").where("s <> a").select("a", F.col("s").alias("b"))


def _with_node(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of their path's row in ``nodes``, which tells its number of members.

    Nodes with more than a quarter of a task's share of the ``total`` rows are at most four for each shuffle partition,
    whatever the input; these are sent to all executors and their members stay where they are. All others meet by path.
    """
    share = max(total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 256)
    heavy = F.broadcast(nodes.where(F.col("members") > share))
    light = rows.join(F.broadcast(nodes.where(F.col("members") > share).select("path")), "path", "left_anti").join(nodes.where(F.col("members") <= share), "path")
    return rows.join(heavy, "path").unionByName(light)


def _unsettled(nodes: DataFrame, total: int, spread: int, last: bool) -> DataFrame:
    """Nodes with several labels, and the way to settle each: (path, members, tokens, main, way). ``main`` is the label
    with the most members.

    ``pairs``: few enough to compare across labels. ``blocks``: most members resemble the node's first one, so further
    tokens would not part them (or the depth is used up). ``branch``: all others. All counts are partial aggregates.
    """
    by_label = nodes.groupBy("path", "label").agg(F.count("*").alias("k"), F.sum("n").alias("t"), F.min(F.struct("s", "x1", "x2")).alias("h"))
    node = by_label.groupBy("path").agg(
        F.sum("k").alias("members"), F.sum("t").alias("tokens"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count("*").alias("labels"), F.min("h").alias("h"), F.max(F.struct("k", "label")).alias("main")
    )
    node = K.checkpoint(node.where("labels > 1").withColumn("main", F.col("main.label")))
    like = F.expr(f"bit_count(x1 ^ h.x1) + bit_count(x2 ^ h.x2) <= {SKETCH_BITS}")
    alike = _with_node(nodes.select("path", "x1", "x2"), node.select("path", "h", "members"), total).groupBy("path").agg(F.avg(like.cast("int")).alias("alike"))
    few = (F.col("members") * F.col("members") - F.col("same")) / 2 <= spread * F.col("members")
    way = F.when(few, "pairs").when(F.lit(last) | (F.col("alike") >= 0.5), "blocks").otherwise("branch")
    return K.checkpoint(node.join(alike, "path").select("path", "members", "tokens", "main", way.alias("way")))


def _linked_in_blocks(crowd: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) across labels inside crowded nodes, compared exhaustively on full sets.

    A node's members are dealt into blocks of about ``block``, or fewer where sets are large; each pair of blocks is one task's work, of bounded size
    whatever the node's. A task returns links that span what it found connected, not every linked pair.
    """
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    dealt = crowd.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64("s", "path"), F.col("_n")).cast("int"))
    dealt = dealt.select("path", "s", "label", "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_j"))
    dealt = dealt.select("path", "s", "label", F.least("_b", "_j").alias("i"), F.greatest("_b", "_j").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        s, label = table.column("s").to_numpy(), table.column("label").to_numpy()
        grams = table.column("grams").combine_chunks()
        flat, n = grams.flatten().to_numpy(), np.diff(grams.offsets.to_numpy())
        a, b = _linked(flat, n, label, percent)
        return pa.table({"a": pa.array(np.minimum(s[a], s[b]), pa.int64()), "b": pa.array(np.maximum(s[a], s[b]), pa.int64())})

    return dealt.join(sets, "s").groupBy("path", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _linked(flat: np.ndarray, n: np.ndarray, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Members linked across labels: a spanning forest of the links. Shared sizes come from a product of the incidence
    matrix, in slices of its columns; tokens of a single member have no column."""
    m = len(n)
    row = np.repeat(np.arange(m), n)
    _, column, uses = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(uses[column] > 1, np.cumsum(uses > 1)[column] - 1, -1)
    width, shared = 4096, np.zeros((m, m), np.float32)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x = np.zeros((m, width), np.float32)
        begin, end = np.searchsorted(column, [lo, lo + width])
        x[row[begin:end], column[begin:end] - lo] = 1
        shared += x @ x.T
    ok = (100 * shared >= percent * (n[:, None] + n[None, :] - shared)) & (label[:, None] != label[None, :])
    a, b = np.nonzero(np.triu(ok, 1))
    parent = {}

    def top(v: int) -> int:
        while parent.get(v, v) != v:
            parent[v] = v = parent.get(parent[v], parent[v])
        return v

    keep = []
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[x] = y
            keep.append(k)
    return a[keep], b[keep]


def _across(nodes: DataFrame, percent: int) -> DataFrame:
    """Possible pairs of one node with different labels: members outside the node's main label meet all others of
    their node, so members of the main label are never compared with one another."""
    a = nodes.where("label <> main").select("path", F.col("s").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("x1").alias("xa1"), F.col("x2").alias("xa2"))
    b = nodes.select("path", F.col("s").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("x1").alias("xb1"), F.col("x2").alias("xb2"))
    met = a.join(b, "path").where(F.expr("la <> lb") & _possible(percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS v, a AS c FROM both_ways UNION SELECT x.b, r.c FROM r JOIN both_ways x ON x.a = r.v),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = d.doc_id
"""
