"""Vectorised word kernels shared by the text operators of this subpackage.

Everything works on the UTF-8 bytes of an Arrow string column: a 256-entry table says which bytes are word
bytes, word borders come from one comparison of neighbours, and word hashes from one prefix sum, so a batch
costs a few numpy passes and no Python loop over words. Batches are cut by bytes, never by rows, so that long
texts do not multiply memory; a single text is never cut.

Words are compared by 64-bit hashes: sums of a random number for each (place in the word, byte), so that no pair of
words collides by its structure; two given words collide by chance with 2**-64. ``hash2`` is drawn independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Rows (of some 10 to 600 bytes) that one task of a packed table reads at least.
PACKED_ROWS = 8192
#: Spark removes the shuffle files of an execution at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# The byte classes of the three word definitions.
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_SEQ_1 = np.uint64(0xD6E8FEB86659FD93)
_SEQ_2 = np.uint64(0xA0761D6478BD642F)


def _byte_mask(inside) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(inside)] = True
    return mask


#: Words are runs of anything but space and the five ASCII control blanks.
NON_SPACE = _byte_mask(set(range(256)) - set(_SPACE))
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = _byte_mask([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Places of a word with a table of their own; beyond, numbers are multiplied by one of the stretch of 64 places.
_PLACE_BITS = 6
_PLACES = 1 << _PLACE_BITS
_TABLES = _rng.integers(0, 2**64, (2, _PLACES * 256), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64 constants); a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base = int(base) | 1
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POW = {}


def _powers(base: np.uint64) -> _Powers:
    return _POW.setdefault(int(base), _Powers(base))


def _range_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[first:last] for every range, from one prefix sum."""
    up, down = _powers(base).get(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in slices of at most ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        _, offsets = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


class Words:
    """Words of a string column: byte borders, hashes, and the range of words of every row."""

    def __init__(self, column: pa.Array, word_bytes: np.ndarray = NON_SPACE, lower: bool = False):
        data, offsets = column_bytes(column)
        self.data, self.rows = data, len(offsets) - 1
        inside = word_bytes[data]
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        before[heads] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Words of row r are first[r] to first[r + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        # Places within the word, byte by byte; what stands between words belongs to none and is not summed.
        self._cell = np.arange(len(data), dtype=np.int64)
        if len(self.start):
            self._cell[self.start[0] :] -= np.repeat(self.start, np.diff(np.append(self.start, len(data))))
        longest = int((self.end - self.start).max()) if len(self.start) else 0
        self._turn = np.minimum(self._cell >> _PLACE_BITS, longest >> _PLACE_BITS) if longest > _PLACES else None
        self._cell &= _PLACES - 1
        self._cell <<= 8
        self._cell |= _LOWER[data] if lower else data
        self._longest, self._hash2 = longest, None
        self.hash = self._hashes(0)

    def _hashes(self, table: int) -> np.ndarray:
        values = _TABLES[table].take(self._cell)
        if self._turn is not None:
            # Each further stretch of a long word has an odd random multiplier of its own.
            turns = mix(np.arange((self._longest >> _PLACE_BITS) + 1, dtype=np.uint64) * _LENGTH + np.uint64(table)) | np.uint64(1)
            turns[0] = 1
            values *= turns.take(self._turn)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        return mix(sums[self.end] - sums[self.start] + (self.end - self.start).astype(np.uint64) * _LENGTH)

    @property
    def hash2(self) -> np.ndarray:
        """A second, independent hash of every word."""
        if self._hash2 is None:
            self._hash2 = self._hashes(1)
        return self._hash2

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.count)

    def windows(self, at: np.ndarray, length: int, second: bool = False) -> np.ndarray:
        """Hashes of the word sequences that start at the word positions ``at``; the second ones are independent."""
        return _range_hash(self.hash2, at, at + length, _SEQ_2) if second else _range_hash(self.hash, at, at + length, _SEQ_1)

    def window_starts(self, length: int) -> np.ndarray:
        """Positions of all windows of ``length`` words that lie in one row."""
        left = np.repeat(self.first[1:], self.count) - np.arange(len(self.hash))
        return np.flatnonzero(left >= length)


def difference_cover(period: int) -> list[int]:
    """Residues whose differences give every residue modulo ``period``: the smallest such set, first in order."""
    from itertools import combinations

    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    return [0]


def text_bytes(df, text_col: str = "text") -> int:
    """UTF-8 bytes of a text column, summed by one scan of it: an optimizer's estimate may be off by any factor."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(text_col).cast("bigint"))).first()[0] or 0)


def bucket_count(df, bucket_bytes: int = 16 << 20, text_col: str = "text") -> int:
    """Groups for a packed shuffle: never fewer than the session's shuffle partitions, and growing with the input."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(max(parts, text_bytes(df, text_col) // bucket_bytes + 1), 1 << 24))


def small_batches(spark, size: int = 4 << 20) -> None:
    """Hold Arrow batches of whole texts to about ``size`` bytes: by rows alone they are tens of MB on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_folder(spark) -> str:
    """The folder of this session's checkpoints, in that of spark.checkpoint.dir. A local session without one gets a
    folder of its own; on a cluster that is an error, since executors do not share a local folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="queryvitals-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df):
    """A reliable checkpoint in the shared folder. The shuffle files that led to it go as soon as it stands; otherwise those
    of all steps lie on the executors' disks until the driver happens to collect its garbage."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        # A frame of its own, planned under this setting: the caller's may run again and keeps what it shuffled.
        once = df.select("*")
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return once.checkpoint()


def packed(df, rows: int):
    """A written table of at most ``rows`` rows in no more partitions than these need, since each partition of a table
    costs a task, and files of whole disk blocks in every shuffle that it feeds, however few rows it has."""
    return df.coalesce(max(1, -(-rows // PACKED_ROWS)))
