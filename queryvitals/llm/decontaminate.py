"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns the corpus into index segments, one row for each MB of text: sorted term hashes, their posting
lists (word positions), and the documents of the segment. Segments are independent, so the index grows with the
corpus and is built without a shuffle; ``decontaminate`` writes it to the shared folder and searches the written table.

Executors cut the benchmark items into windows and pack them in blocks of a checked size; the driver only passes each
block on to the broadcast. ``search`` goes through the segments once, whatever the number of blocks. Each window takes
the posting list of its rarest term in the segment, shifted to the window's start, and intersects it with the lists of
its other terms, shifted alike, rarest first; what is left are the exact occurrences.

Defined cases: a null or empty text has no words and is never hit; an item without words has no window; an item
shorter than the window is one window of its own length; repeated rows each get their own result; repeated item
ids count once; an empty corpus or benchmark gives no hits. Other columns of ``docs`` are not looked at. Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryvitals.llm import kernel as K

SEGMENT_BYTES = 1 << 20
#: Segments that meet a block of items each time it is opened, if there are several blocks.
SEGMENTS = 16


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _index(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Word counts, sorted terms, starts of their posting lists, and the lists, of one segment."""
    w = K.Words(column, K.ALNUM, lower=True)
    order = np.argsort(w.hash, kind="stable").astype(np.uint32)
    ordered = w.hash[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.append(np.flatnonzero(new), len(ordered)).astype(np.uint32)
    return w.count.astype(np.uint32), ordered[new], starts, order


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Rows (ids, words, terms, starts, postings): one for each segment. ``words`` are the documents' word counts."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("words", "terms", "starts", "postings"))])

    def build(batches):
        for part in K.chunks(batches, "text", segment_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)), *[pa.array([_pack(x)], pa.binary()) for x in _index(part.column(1))]],
                names=["ids", "words", "terms", "starts", "postings"],
            )

    K.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(build, schema)


class Segment:
    """One index segment opened for search."""

    def __init__(self, words: bytes, terms: bytes, starts: bytes, postings: bytes):
        self.count = np.frombuffer(words, np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.terms = np.frombuffer(terms, np.uint64)
        self.starts = np.frombuffer(starts, np.uint32).astype(np.int64)
        self.postings = np.frombuffer(postings, np.uint32)
        self.size = int(self.first[-1])
        self._keys = None

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and posting-list lengths; unknown terms have length 0."""
        if not len(self.terms):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        return at, np.where(known, self.starts[at + 1] - self.starts[at], 0)

    @property
    def keys(self) -> np.ndarray:
        """All posting lists as one sorted array of (term number, position)."""
        if self._keys is None:
            term = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.starts))
            self._keys = (term << 32) | self.postings
        return self._keys

    def listed(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in the posting list of its term, by binary search in the list."""
        wanted = (term << 32) | position
        at = np.searchsorted(self.keys, wanted)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == wanted

    def phrases(self, words: np.ndarray, starts: np.ndarray, length: int, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Exact occurrences of the sequences of ``length`` term hashes that begin at ``starts`` in ``words``: (sequence number, word position)."""
        term, df = self.lookup(words)
        unknown = np.concatenate([[0], np.cumsum(df == 0)])
        alive = np.flatnonzero(unknown[starts + length] == unknown[starts])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for part in np.array_split(alive, len(alive) // 4096 + 1):
            if not len(part):
                continue
            place = starts[part][:, None] + np.arange(length)
            terms, sizes = term[place], df[place]
            rare_first = np.argsort(sizes, axis=1, kind="stable")
            lists = np.take_along_axis(sizes, rare_first[:, :1], axis=1)[:, 0]
            ends = np.cumsum(lists)
            at = 0
            while at < len(part):
                end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")), at + 1)
                n = lists[at:end]
                who = np.repeat(np.arange(at, end), n)
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                offset = rare_first[who, 0]
                start = self.postings[self.starts[terms[who, offset]] + inner].astype(np.int64) - offset
                ok = (start >= 0) & (start + length <= self.size)
                who, start = who[ok], start[ok]
                for k in range(1, length):
                    shift = rare_first[who, k]
                    ok = self.listed(terms[who, shift], start + shift)
                    who, start = who[ok], start[ok]
                doc = np.searchsorted(self.first, start, side="right") - 1
                ok = start + length <= self.first[doc + 1]
                found.append((part[who[ok]], start[ok]))
                at = end
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def near(self, terms: np.ndarray, within: int) -> np.ndarray:
        """Documents (numbers in the segment) with all ``terms`` inside ``within`` consecutive words, in any order."""
        term, df = self.lookup(np.unique(terms))
        if not len(df) or not df.min():
            return np.zeros(0, np.int64)
        lists = [np.sort(self.postings[self.starts[t] : self.starts[t + 1]]).astype(np.int64) for t in term]
        lists.sort(key=len)
        left = np.unique(np.concatenate(lists))
        ok = np.ones(len(left), bool)
        doc = np.searchsorted(self.first, left, side="right") - 1
        last = np.minimum(left + within, self.first[doc + 1])
        for one in lists:
            at = np.searchsorted(one, left)
            ok &= (at < len(one)) & (one[np.minimum(at, len(one) - 1)] < last)
        return np.unique(doc[ok])


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> DataFrame:
    """The items' windows, packed by the executors: one row (names, words, first, windows) for each block of at most
    ``block_bytes`` of text. ``words`` are term hashes, ``first`` the items' borders in them, and ``windows`` holds, by
    length, the starts of the distinct windows and the items of each."""

    def pack(batches):
        for part in K.chunks(batches, "text", block_bytes):
            w = K.Words(part.column(1), K.ALNUM, lower=True)
            by_length = []
            lengths = np.minimum(w.count, window)
            for m in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == m)
                many = w.count[own] - m + 1
                item = np.repeat(own, many)
                start = np.repeat(w.first[own], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                order = np.lexsort((item, w.windows(start, m)))
                start, item = start[order], item[order]
                new = np.ones(len(start), bool)
                # Neighbours with one hash are one window only if all their terms agree.
                for lo in range(1, len(start), 1 << 16):
                    hi = min(lo + (1 << 16), len(start))
                    before, here = (w.hash[at[:, None] + np.arange(m)] for at in (start[lo - 1 : hi - 1], start[lo:hi]))
                    new[lo:hi] = (before != here).any(axis=1)
                heads = np.flatnonzero(new)
                by_length.append({"length": m, "starts": _pack(start[heads].astype(np.int64)), "heads": _pack(np.append(heads, len(start)).astype(np.int64)), "owners": _pack(item.astype(np.int64))})
            kind = pa.list_(pa.struct([("length", pa.int32()), ("starts", pa.binary()), ("heads", pa.binary()), ("owners", pa.binary())]))
            names = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([names, pa.array([_pack(w.hash)], pa.binary()), pa.array([_pack(w.first.astype(np.int64))], pa.binary()), pa.array([by_length], kind)], names=["names", "words", "first", "windows"])

    source = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    source = source.repartition(K.text_bytes(items, text_col) // block_bytes + 1)
    return source.mapInArrow(pack, "names array<string>, words binary, first binary, windows array<struct<length:int,starts:binary,heads:binary,owners:binary>>")


def _opened_block(row) -> tuple:
    numbers = lambda b: np.frombuffer(b, np.int64)
    windows = [(x["length"], numbers(x["starts"]), numbers(x["heads"]), numbers(x["owners"])) for x in row["windows"]]
    return list(row["names"]), np.frombuffer(row["words"], np.uint64), numbers(row["first"]), windows


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 4 << 20, slop: int | None = None) -> DataFrame:
    """Per document: id, n_words, spans (hit word ranges [from, to)), items (ids with an occurring window, as strings).

    With ``slop``, a further column ``near`` lists the items of which all words lie within (words + slop) words.
    Items are sent to all executors in blocks bounded by ``block_bytes``; every segment is searched for all blocks in one
    pass and gives one row for each of its documents, so rows are never matched by a key. A worker holds ``SEGMENTS`` segments and one open block at a time.
    """

    def opened(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                yield columns["ids"][r].values, Segment(*(columns[n][r].as_py() for n in ("words", "terms", "starts", "postings")))

    return _search(index, index.schema["ids"].dataType.elementType, opened, items, item_id, item_text, window, block_bytes, slop)


def index_and_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 4 << 20, slop: int | None = None) -> DataFrame:
    """``search(build_index(docs), items)`` in one pass: each segment is searched by the worker that has built it."""
    K.small_batches(docs.sparkSession)

    def opened(batches):
        for part in K.chunks(batches, "text", SEGMENT_BYTES):
            yield part.column(0), Segment(*map(_pack, _index(part.column(1))))

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _search(source, docs.schema[id_col].dataType, opened, items, item_id, item_text, window, block_bytes, slop)


def _search(index: DataFrame, id_type: T.DataType, opened, items: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int, slop: int | None) -> DataFrame:
    spans = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("spans", spans), *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("items", "near"))])
    context = index.sparkSession.sparkContext
    # One block at a time passes through the driver; its size is bounded by block_bytes of text.
    blocks = [context.broadcast(_opened_block(row)) for row in item_blocks(items, item_id, item_text, window, block_bytes).toLocalIterator()]

    def run(batches):
        segments = opened(batches)
        while some := list(islice(segments, SEGMENTS if len(blocks) > 1 else 1)):
            hits = [_Hits(segment) for _, segment in some]
            for block in blocks:
                value = block.value
                if len(blocks) > 1:
                    # The worker would keep every block that it has opened; it can be read again.
                    vars(block).pop("_value", None)
                for h in hits:
                    h.find(*value, slop)
                del value
            for (ids, segment), h in zip(some, hits, strict=True):
                yield _answer(segment, ids, h)

    return index.mapInArrow(run, schema).select("id", "n_words", "spans", "items", *(["near"] if slop is not None else []))


class _Hits:
    """What the blocks of items have found in one segment."""

    def __init__(self, segment: Segment):
        self.segment = segment
        self.edge = np.zeros(segment.size + 1, np.int64)
        self.items: dict[int, set] = {}
        self.near: dict[int, set] = {}

    def find(self, names: list, words: np.ndarray, first: np.ndarray, windows: list, slop: int | None) -> None:
        for length, starts, heads, owners in windows:
            which, start = self.segment.phrases(words, starts, length)
            np.add.at(self.edge, start, 1)
            np.add.at(self.edge, start + length, -1)
            doc = np.searchsorted(self.segment.first, start, side="right") - 1
            for pair in np.unique(doc * len(starts) + which).tolist():
                d, x = divmod(pair, len(starts))
                self.items.setdefault(d, set()).update(names[o] for o in owners[heads[x] : heads[x + 1]].tolist())
        if slop is None:
            return
        _, df = self.segment.lookup(words)
        unknown = np.concatenate([[0], np.cumsum(df == 0)])
        for item in np.flatnonzero((unknown[first[1:]] == unknown[first[:-1]]) & (first[1:] > first[:-1])).tolist():
            bag = np.unique(words[first[item] : first[item + 1]])
            for d in self.segment.near(bag, len(bag) + slop).tolist():
                self.near.setdefault(d, set()).add(names[item])


def _answer(segment: Segment, ids: pa.Array, hits: _Hits) -> pa.RecordBatch:
    """One row for each document of the segment."""
    docs = len(segment.count)
    hit = np.cumsum(hits.edge[:-1]) > 0
    # Ranges of hit words, cut at document borders.
    before = np.zeros_like(hit)
    before[1:] = hit[:-1]
    before[segment.first[:-1][segment.first[:-1] < segment.size]] = False
    after = np.zeros_like(hit)
    after[:-1] = hit[1:]
    after[segment.first[1:][segment.first[1:] > 0] - 1] = False
    begin, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    owner = np.searchsorted(segment.first, begin, side="right") - 1
    span_at = np.searchsorted(owner, np.arange(docs + 1)).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - segment.first[owner], pa.int64()), pa.array(end - segment.first[owner], pa.int64())], names=["from", "to"]))

    def named(groups):
        values, at = [], [0]
        for d in range(docs):
            values += sorted(groups.get(d, ()), key=lambda v: (v is None, v or ""))
            at.append(len(values))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.string()))

    return pa.RecordBatch.from_arrays([ids, pa.array(segment.count, pa.int64()), spans, named(hits.items), named(hits.near)], names=["id", "n_words", "spans", "items", "near"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", slop: int | None = None) -> DataFrame:
    """Index the documents, write the index to the shared folder, and search it: see ``search``."""
    return search(K.checkpoint(build_index(docs, id_col)), items, window=window, slop=slop)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["to"] - s["from"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
