"""Exact repeated passages, found with difference-cover anchors.

A window of ``window`` words is a repeat if the same words also start earlier (smaller document id, or earlier in
the same document); every word of a repeat is removed. For a period p, a difference cover D modulo p has, for any two
positions i and j, a shift k < p with (i + k) mod p and (j + k) mod p both in D. So hashing the short anchors of
``window - period + 1`` words at positions in D alone still gives two equal windows one anchor in common at the same
place inside them. Three steps follow:

1. anchors: each chunk of text sends its distinct anchor hashes, packed by hash bucket; a bucket tells which anchors
   occur twice or more in the corpus;
2. extension: only windows around such anchors are hashed whole (96 bits) and sent, packed, to the bucket that
   finds the earliest start of each; all later ones are repeats;
3. the words of repeats are cut from the texts.

A hash that a chunk has many times is resolved in the chunk and leaves it once, so a passage in a third of all
documents makes one entry a chunk and not one a document. Texts are shuffled once, by document, and that exchange
serves both joins.

Places travel and are joined by (id, hash of the text), so rows without an id, or with one id, are no hot key; a join
side that holds very many equal rows can be split, since its other side has one row for them.

Windows count as equal if two hashes of 64 and 32 bits, over independent hashes of their words, agree.

Defined cases: a null or empty text has no words and gives an empty kept text; documents without an id come last in
order and count as one document; rows that share an id are judged each by their own text, and equal windows at equal
(id, position) do not remove one another; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.llm import kernel as K

NO_ID = 2**63 - 1


def _groups(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte over all values: near-constant bytes then compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize)[:, :width].T).tobytes()


def _values(blob: bytes, width: int, kind) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = raw.T
    return out.view(kind).ravel()


#: Bytes kept of each hash. Anchors: 6, where a chance match only adds a candidate; windows: 8 and 4, which decide.
_ANCHOR, _WINDOW = (6,), (8, 4)
_PACK = "bucket int, settled boolean, docs binary, counts binary, pos binary, h1 binary, h2 binary"
_TYPES = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
_NAMES = [f.split()[0] for f in _PACK.split(", ")]
_PLACES = "k bigint, th bigint, at binary"


def _rows(rows: list) -> list:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(_NAMES), _TYPES, strict=True)]


def _bucket_rows(bucket: np.ndarray, keys: np.ndarray, pos: np.ndarray, hashes: list, widths: tuple, flag: bool) -> list:
    """One row for each bucket: documents, entries of each, positions, hashes. Entries come in order of document and position."""
    order = np.argsort(bucket, kind="stable")
    bucket, keys, pos, hashes = bucket[order], keys[order], pos[order].astype(np.uint32), [h[order] for h in hashes]
    first = np.flatnonzero(_groups(bucket))
    rows = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
        own = keys[lo:hi]
        new = np.flatnonzero(_groups(own[:, 0], own[:, 1]))
        counts = np.diff(np.append(new, hi - lo)).astype(np.uint32)
        packed = [_planes(h[lo:hi], w) for h, w in zip(hashes, widths, strict=False)]
        rows.append((int(bucket[lo]), flag, _planes(np.ascontiguousarray(own[new]).ravel(), 8), _planes(counts, 4), _planes(pos[lo:hi], 4), *[*packed, None, None][:2]))
    return rows


def _home(k: np.ndarray, th: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix(K.mix(k.astype(np.uint64)) ^ th.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _chunk_rows(keys: np.ndarray, hashes: list[np.ndarray], doc: np.ndarray, pos: np.ndarray, buckets: int, widths: tuple, settle) -> list:
    """What one chunk sends. ``keys``: (rows, 2) id and text hash; ``settle`` says, from entries sorted by hash and
    place, which are settled already and which leave the chunk."""
    k, th = keys[doc, 0], keys[doc, 1]
    order = np.lexsort((pos, th, k, *hashes[::-1]))
    settled, sent = settle([h[order] for h in hashes], k[order], th[order], pos[order])
    rows = []
    at = np.sort(order[sent])
    if len(at):
        rows += _bucket_rows((hashes[0][at] % np.uint64(buckets)).astype(np.int32), keys[doc[at]], pos[at], [h[at] for h in hashes], widths, False)
    at = order[settled]
    at = at[np.lexsort((pos[at], th[at], k[at]))]
    # Equal rows have equal places: one entry stands for all.
    at = at[_groups(k[at], th[at], pos[at])] if len(at) else at
    if len(at):
        rows += _bucket_rows(_home(k[at], th[at], buckets), keys[doc[at]], pos[at], [], (), True)
    return rows


def _unpack(table: pa.Table, settled: bool, widths: tuple) -> list[np.ndarray]:
    """Entries of a bucket: ids, text hashes, positions and hashes, joined over its rows."""
    out = [[] for _ in range(3 + len(widths))]
    blobs = {n: table.column(n).to_pylist() for n in ("docs", "counts", "pos", "h1", "h2")}
    for i, flag in enumerate(table.column("settled").to_pylist()):
        if flag != settled:
            continue
        keys = np.repeat(_values(blobs["docs"][i], 8, np.int64).reshape(-1, 2), _values(blobs["counts"][i], 4, np.uint32), axis=0)
        out[0].append(keys[:, 0])
        out[1].append(keys[:, 1])
        out[2].append(_values(blobs["pos"][i], 4, np.uint32))
        for n, w in enumerate(widths):
            out[3 + n].append(_values(blobs[f"h{n + 1}"][i], w, np.uint64))
    return [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, [np.int64, np.int64, np.uint32, np.uint64, np.uint64], strict=False)]


def _sent_home(k: np.ndarray, th: np.ndarray, pos: np.ndarray, buckets: int) -> pa.Table:
    """Positions packed by the home bucket of their documents."""
    order = np.lexsort((pos, th, k))
    rows = _bucket_rows(_home(k[order], th[order], buckets), np.stack([k[order], th[order]], axis=1), pos[order], [], (), True) if len(k) else []
    return pa.Table.from_arrays(_rows(rows), names=_NAMES)


def _by_document(table: pa.Table) -> pa.Table:
    """(k, th, at) of a home bucket: the sorted positions of each text of each document."""
    k, th, pos = _unpack(table, True, ())
    order = np.lexsort((pos, th, k))
    if len(k):
        order = order[_groups(k[order], th[order], pos[order])]
    k, th, pos = k[order], th[order], pos[order].astype(np.uint32)
    first = np.flatnonzero(_groups(k, th)) if len(k) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(k)) if len(k) else first
    at = [pos[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    return pa.Table.from_arrays([pa.array(k[first], pa.int64()), pa.array(th[first], pa.int64()), pa.array(at, pa.binary())], names=["k", "th", "at"])


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)


def _positions(column: pa.Array) -> list[np.ndarray]:
    """The positions found for each row."""
    return [np.frombuffer(at or b"", np.uint32).astype(np.int64) for at in column.to_pylist()]


def repeated_places(texts: DataFrame, window: int, period: int, buckets: int) -> DataFrame:
    """``texts`` (k, th, text) -> (k, th, at): starts of repeated windows, by document and text.

    A bucket of hashes answers to the home buckets of the documents, packed again, so that a document's positions are
    one row in the end and not one for each bucket of hashes.
    """
    cover = K.difference_cover(period)
    length = window - period + 1
    at_cover = np.zeros(period, bool)
    at_cover[cover] = True

    def anchors(batches):
        def settle(hashes, k, th, pos):
            new = _groups(*hashes)
            many = np.zeros(len(new), bool)
            many[:-1] = ~new[1:]
            many |= ~new
            # One entry of each hash leaves; positions of a hash that the chunk has several times are known already.
            return many, new

        for part in K.chunks(batches, "text"):
            w = K.Words(part.column(2))
            starts = w.window_starts(length)
            if not len(starts):
                continue
            doc = np.searchsorted(w.first, starts, side="right") - 1
            pos = starts - w.first[doc]
            ok = at_cover[pos % period]
            starts, doc, pos = starts[ok], doc[ok], pos[ok]
            rows = _chunk_rows(_keys(part), [w.windows(starts, length)], doc, pos, buckets, _ANCHOR, settle)
            if rows:
                yield pa.RecordBatch.from_arrays(_rows(rows), names=_NAMES)

    def repeated(table: pa.Table) -> pa.Table:
        k, th, pos, h = _unpack(table, False, _ANCHOR)
        order = np.argsort(h, kind="stable")
        new = _groups(h[order]) if len(h) else np.zeros(0, bool)
        many = ~new
        many[:-1] |= ~new[1:]
        many = order[many]
        sk, sth, spos = _unpack(table, True, ())
        return _sent_home(np.concatenate([k[many], sk]), np.concatenate([th[many], sth]), np.concatenate([pos[many], spos]), buckets)

    def gathered(sent, judge):
        return sent.groupBy("bucket").applyInArrow(judge, _PACK).groupBy("bucket").applyInArrow(_by_document, _PLACES)

    found = gathered(texts.mapInArrow(anchors, _PACK), repeated)
    near = texts.join(found, ["k", "th"], "left").select("k", "th", "text", "at")

    def windows(batches):
        def settle(hashes, k, th, pos):
            same = ~_groups(*hashes, k, th, pos)  # repeated rows: one entry stands for all
            new = _groups(*hashes)
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            later = (k > k[first]) | (pos > pos[first])
            return later & ~same, ~later & ~same

        for part in K.chunks(batches, "text"):
            at = _positions(part.column(3))
            some = np.flatnonzero([len(a) > 0 for a in at])
            if not len(some):
                continue
            picked = part.take(pa.array(some))
            w = K.Words(picked.column(2))
            mark = np.zeros(len(w.hash) + 1, np.int64)
            for r, i in enumerate(some.tolist()):
                # Windows that hold the anchor at a shift below the period.
                np.add.at(mark, w.first[r] + np.maximum(at[i] - (period - 1), 0), 1)
                np.add.at(mark, np.minimum(w.first[r] + at[i] + 1, w.first[r + 1]), -1)
            starts = w.window_starts(window)
            starts = starts[np.cumsum(mark)[starts] > 0]
            if not len(starts):
                continue
            doc = np.searchsorted(w.first, starts, side="right") - 1
            rows = _chunk_rows(_keys(picked), [w.windows(starts, window), w.windows(starts, window, second=True) & np.uint64(0xFFFFFFFF)], doc, starts - w.first[doc], buckets, _WINDOW, settle)
            if rows:
                yield pa.RecordBatch.from_arrays(_rows(rows), names=_NAMES)

    def later(table: pa.Table) -> pa.Table:
        k, th, pos, h1, h2 = _unpack(table, False, _WINDOW)
        order = np.lexsort((pos, k, h2, h1))
        k, th, pos, h1, h2 = (x[order] for x in (k, th, pos, h1, h2))
        if len(k):
            first = np.maximum.accumulate(np.where(_groups(h1, h2), np.arange(len(k)), 0))
            dup = (k > k[first]) | (pos > pos[first])
            k, th, pos = k[dup], th[dup], pos[dup]
        sk, sth, spos = _unpack(table, True, ())
        return _sent_home(np.concatenate([k, sk]), np.concatenate([th, sth]), np.concatenate([pos, spos]), buckets)

    return gathered(near.mapInArrow(windows, _PACK), later)


def remove_repeats(docs: DataFrame, window: int = 20, period: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (kept words, one space between)."""
    if not 1 <= period <= window:
        raise ValueError("period must lie between 1 and window")
    K.small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("k"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    places = repeated_places(texts, window, period, K.bucket_count(texts))

    def cut(batches):
        for part in K.chunks(batches, "text"):
            texts_in = part.column(2).to_pylist()
            dropped = _positions(part.column(3))
            out = ([], [], [])
            for text, starts in zip(texts_in, dropped, strict=True):
                words = (text or "").encode().split()
                removed = 0
                if len(starts):
                    edge = np.zeros(len(words) + window + 1, np.int64)
                    edge[starts] += 1
                    edge[starts + window] -= 1
                    gone = np.cumsum(edge)[: len(words)] > 0
                    removed = int(gone.sum())
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                for o, x in zip(out, (len(words), removed, b" ".join(kept).decode()), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["k", "n_words", "n_removed", "kept_text"])

    done = texts.join(places, ["k", "th"], "left").select("k", "th", "text", "at").mapInArrow(cut, "k bigint, n_words bigint, n_removed bigint, kept_text string")
    return done.select(F.when(F.col("k") != NO_ID, F.col("k")).cast(id_type).alias(id_col), "n_words", "n_removed", "kept_text")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
lst AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lst USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
