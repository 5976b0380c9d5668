"""Near-equal lines, found with a segment-partition edit join.

Lines are the non-empty runs between line feeds. A line is removed if an equal line starts earlier in the corpus
(smaller document id, then line number), or if a line within ``threshold`` byte edits first appears earlier than it.
Edits count for lines of at least ``min_bytes`` bytes; shorter ones are compared for equality only, unless
``short_bytes`` is given: then a line of at least that many is also removed if one within a single edit comes first.
The law of a pair is that of its shorter line.

A line is cut into threshold + 1 segments; a line within the threshold must contain one of them unchanged, at a place
that the length difference allows. So each distinct line posts its segments under (length, segment number, segment)
and probes, for each length it may match, only the substrings at admissible places (multi-match-aware selection).
Posts and probes meet packed, by hash bucket. Pairs whose byte parities differ in more than 2 * threshold classes
cannot match and go before texts are fetched; the rest are verified with a banded bit-parallel edit distance.

A chunk of text sends each distinct line once, so a line in a third of all documents is one entry a chunk.

A segment that very many distinct lines share (a template with many fillings) makes no pairs. Its lines are dealt into
blocks, each pair of blocks is the work of one task of bounded size, and a task verifies its lines itself and returns
only those that an earlier one is near to, each once. The comparisons of such a segment still grow with the square of
its distinct lines; parities of bytes and of neighbouring bytes drop most of them before the edit distance.

Defined cases: null and empty texts have no lines; rows that share an id
are judged each by their own text; documents without an id come last; empty lines stay; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryvitals.llm import kernel as K
from queryvitals.llm.substring import NO_ID, _groups, _planes, _values

_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_OTHER = np.uint64(0xE7037ED1A0B428DB)
BITMAP_BITS = 1 << 24
_CLASS_BIT = np.uint64(1) << (np.arange(256, dtype=np.uint64) % np.uint64(40))
#: Bytes kept of segment keys, line hashes and parities. Shorter hashes only add pairs for the exact check to reject.
_KEY, _LINE_HASH, _PARITY = 6, 6, 5
_LINE_MASK = np.uint64((1 << 8 * _LINE_HASH) - 1)
PAIR_BLOCK = 1 << 20
#: Pairs of lines that one segment may make in its bucket; beyond, its lines are compared in blocks of BLOCK_LINES.
SEGMENT_PAIRS = 1 << 16
BLOCK_LINES = 1024


def segments(length: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes, (lines, parts), of an even cut: the last ones are a byte longer."""
    small, extra = length // parts, length % parts
    size = small[:, None] + (np.arange(parts)[None, :] >= parts - extra[:, None])
    return np.cumsum(size, axis=1) - size, size


class _Lines:
    """Lines of a batch with two hashes each, and a prefix sum that hashes any piece of any of them."""

    def __init__(self, column: pa.Array):
        self.words = K.Words(column, _LINE)
        w = self.words
        self.start, self.size = w.start, w.end - w.start
        values = K._BYTE_VALUE[w.data]
        self.h1 = w.hash
        up, self.down = K._powers(K._SEQ_1).get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])
        self.h2 = self.piece(w.start, w.end)

    def piece(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return K.mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64))

    def parity(self, which: np.ndarray) -> np.ndarray:
        """One bit for each of 40 byte classes: whether the line has an odd number of them. An edit changes two at most."""
        seen = np.zeros(len(self.words.data) + 1, np.uint64)
        bits = _CLASS_BIT[self.words.data]
        np.bitwise_xor.accumulate(bits, out=seen[1:])
        return seen[self.start[which] + self.size[which]] ^ seen[self.start[which]]


def _key(length: np.ndarray, part: int, piece: np.ndarray) -> np.ndarray:
    salt = np.uint64((part + 1) * 0xC2B2AE3D27D4EB4F % 2**64)
    return K.mix(piece ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ salt)


def posts_and_probes(lines: _Lines, which: np.ndarray, threshold: int) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """(is probe, keys, line numbers) of the lines ``which``. A probe at the place of the line's own segment is its post, and is not sent again."""
    parts = threshold + 1
    start, length = lines.start[which], lines.size[which]
    out = []
    first, size = segments(length, parts)
    for i in range(parts):
        out.append((False, _key(length, i, lines.piece(start + first[:, i], start + first[:, i] + size[:, i])), which))
    for shorter in range(threshold + 1):
        target = length - shorter
        first, size = segments(target, parts)
        for i in range(parts):
            low = max(-i, shorter - (threshold - i))
            high = min(i, shorter + (threshold - i))
            for shift in range(low, high + 1):
                if shorter == shift == 0:
                    continue
                at = first[:, i] + shift
                ok = (at >= 0) & (at + size[:, i] <= length)
                s = start[ok] + at[ok]
                out.append((True, _key(target[ok], i, lines.piece(s, s + size[ok, i])), which[ok]))
    return out


def edit_distances(a: list[bytes], b: list[bytes], threshold: int) -> np.ndarray:
    """Byte edit distance of each pair, exact up to ``threshold`` and above it otherwise.

    Banded bit-parallel recurrence, one machine word a pair and all pairs at once: bit k of a word is row
    column - threshold + k. Row values outside the band only ever read too high, so results within the threshold are
    exact. The distance is followed along the diagonal that ends in the last cell.
    """
    n = len(a)
    out = np.full(n, threshold + 1, np.int64)
    rows = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    long = np.array([len(x) for x, _ in rows], np.int64)
    short = np.array([len(y) for _, y in rows], np.int64)
    todo = np.flatnonzero(long - short <= threshold)
    todo = todo[np.argsort(short[todo], kind="stable")]
    at = 0
    while at < len(todo):
        width = 2 * threshold + 1
        end = at + 1
        while end < len(todo) and (end - at + 1) * int(short[todo[end]] + width) <= 8 << 20 and short[todo[end]] <= 2 * short[todo[at]] + 64:
            end += 1
        some = todo[at:end]
        at = end
        columns = int(short[some].max())
        pattern = np.full((len(some), columns + width + threshold), 256, np.int16)
        text = np.full((len(some), columns), 257, np.int16)
        for r, i in enumerate(some.tolist()):
            pattern[r, threshold : threshold + int(long[i])] = np.frombuffer(rows[i][0], np.uint8)
            text[r, : int(short[i])] = np.frombuffer(rows[i][1], np.uint8)
        vp = np.full(len(some), ~np.uint64(0) << np.uint64(threshold))
        vn = np.zeros(len(some), np.uint64)
        now = long[some] - short[some]
        diagonal = (threshold + now).astype(np.uint64)
        one = np.uint64(1)
        for j in range(columns):
            m = np.zeros(len(some), np.uint64)
            for k in range(width):
                m |= (pattern[:, j + k] == text[:, j]).astype(np.uint64) << np.uint64(k)
            d0 = (((m & vp) + vp) ^ vp) | m | vn
            hp = vn | ~(d0 | vp)
            hn = d0 & vp
            now = now + np.where(j < short[some], (~(d0 >> diagonal) & one).astype(np.int64), 0)
            vp = hn | ~((d0 >> one) | hp)
            vn = (d0 >> one) & hp
            if j % 64 == 63 and (now > threshold).all():
                break
        out[some] = np.minimum(now, threshold + 1)
    return out


_PACK = "bucket int, probe boolean, keys binary, lines binary, parity binary"


def candidate_pairs(texts: DataFrame, threshold: int, min_bytes: int, buckets: int, short_bytes: int | None = None, segment_pairs: int = SEGMENT_PAIRS) -> DataFrame:
    """(a, b, crowd): short hashes of different lines, long enough for edits, that share a segment where it can count,
    and whose parities allow a match. A segment with more than ``segment_pairs`` possible pairs gives a row for each of
    its lines instead: the segment's key as ``a``, the line as ``b``, and ``crowd`` true."""

    def send(batches):
        for part in K.chunks(batches, "text"):
            lines = _Lines(part.column(2))
            _, unique = np.unique(lines.h1, return_index=True)
            size = lines.size[unique]
            tiers = [(unique[size >= min_bytes], threshold)]
            if short_bytes is not None:
                # A line of min_bytes may be one edit from a shorter one.
                tiers.append((unique[(size >= short_bytes) & (size <= min_bytes)], min(1, threshold)))
            if not any(len(which) for which, _ in tiers):
                continue
            parity = lines.parity(np.arange(len(lines.h1)))
            rows = []
            for probe in (False, True):
                chosen = [(k, w) for which, edits in tiers if len(which) for p, k, w in posts_and_probes(lines, which, edits) if p == probe]
                if not chosen:
                    continue
                keys, owner = np.concatenate([k for k, _ in chosen]), np.concatenate([w for _, w in chosen])
                bucket = (keys % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, keys, owner = bucket[order], keys[order], owner[order]
                first = np.flatnonzero(_groups(bucket))
                for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
                    rows.append((int(bucket[lo]), probe, _planes(keys[lo:hi], _KEY), _planes(lines.h1[owner[lo:hi]], _LINE_HASH), _planes(parity[owner[lo:hi]], _PARITY)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.bool_(), *[pa.binary()] * 3], strict=True)], names=["bucket", "probe", "keys", "lines", "parity"])

    def meet(table: pa.Table) -> pa.Table:
        sides = []
        for probe in (False, True):
            own = [i for i, p in enumerate(table.column("probe").to_pylist()) if p == probe]
            column = lambda name, width: np.concatenate([_values(table.column(name)[i].as_py(), width, np.uint64) for i in own]) if own else np.zeros(0, np.uint64)
            keys, line, parity = column("keys", _KEY), column("lines", _LINE_HASH), column("parity", _PARITY)
            if probe:
                keys, line, parity = (np.concatenate(x) for x in zip(sides[0], (keys, line, parity), strict=True))
            order = np.lexsort((line, keys))
            keys, line, parity = keys[order], line[order], parity[order]
            new = _groups(keys, line) if len(keys) else np.zeros(0, bool)
            sides.append((keys[new], line[new], parity[new]))
        (ik, il, ip), (pk, pl, pp) = sides
        lo, hi = np.searchsorted(ik, pk, "left"), np.searchsorted(ik, pk, "right")
        n = hi - lo
        # Probes are sorted by key, so the lines of a segment are neighbours among them.
        heads = np.flatnonzero(_groups(pk)) if len(pk) else np.zeros(0, np.int64)
        probes = np.diff(np.append(heads, len(pk)))
        crowded = np.repeat(n[heads] * probes > segment_pairs, probes) if len(pk) else np.zeros(0, bool)
        bucket = np.uint64(table.column("bucket")[0].as_py())
        crowd_key, crowd_line = K.mix(pk[crowded] * np.uint64(1 << 16) + bucket), pl[crowded]
        n = np.where(crowded, 0, n)
        ends = np.cumsum(n)
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        at = 0
        while at < len(pk):
            end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_BLOCK, side="right")), at + 1)
            who = np.repeat(np.arange(at, end), n[at:end])
            inner = np.arange(len(who)) - np.repeat(np.cumsum(n[at:end]) - n[at:end], n[at:end])
            post = lo[who] + inner
            ok = (il[post] != pl[who]) & (np.bitwise_count(ip[post] ^ pp[who]) <= 2 * threshold)
            x, y = il[post[ok]], pl[who[ok]]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
            at = end
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = _groups(a, b) if len(a) else np.zeros(0, bool)
        a, b = np.concatenate([a[new], crowd_key]), np.concatenate([b[new], crowd_line])
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "crowd": pa.array(np.arange(len(a)) >= int(new.sum()))})

    return texts.mapInArrow(send, _PACK).groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, crowd boolean").distinct()


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the numbers ``k``, each below BITMAP_BITS."""
    words = keys.select(F.floor(F.col("k") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(k % 64 AS int))").alias("m"))
    words = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, np.uint64)
    bitmap[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return bitmap


def _marked(bitmap: np.ndarray, k: np.ndarray) -> np.ndarray:
    return (bitmap[k >> 6] >> (k & 63).astype(np.uint64)) & np.uint64(1) != 0


def line_texts(texts: DataFrame, wanted: DataFrame, firsts: DataFrame) -> DataFrame:
    """(s, h1, h2, line) of the lines whose short hash is in ``wanted`` (column s).

    Texts are looked at only if they hold the first occurrence of such a line. Two bitmaps of fixed size, of these
    texts and of the hashes, spare most work and shuffle; what they let through by chance the exact join drops.
    """
    homes = firsts.where("f IS NOT NULL").select(F.col("h1").bitwiseAND(F.lit(int(_LINE_MASK))).alias("s"), "f.k", "f.th").join(wanted, "s", "left_semi")
    home = F.pmod(F.xxhash64("k", "th"), F.lit(BITMAP_BITS))
    sent = texts.sparkSession.sparkContext.broadcast((_bitmap(homes.select(home.alias("k"))), _bitmap(wanted.select(F.pmod(F.col("s"), F.lit(BITMAP_BITS)).alias("k")))))

    def pick(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_marked(sent.value[0], batch.column(0).to_numpy())))
            for part in K.chunks([batch], "text"):
                lines = _Lines(part.column(1))
                short = (lines.h1 & _LINE_MASK).view(np.int64)
                ok = np.flatnonzero(_marked(sent.value[1], short % BITMAP_BITS))
                _, unique = np.unique(np.stack([lines.h1[ok], lines.h2[ok]]), axis=1, return_index=True)
                ok = ok[unique]
                body = lines.words.data
                out = [body[s : s + n].tobytes() for s, n in zip(lines.start[ok].tolist(), lines.size[ok].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(short[ok]), pa.array(lines.h1[ok].view(np.int64)), pa.array(lines.h2[ok].view(np.int64)), pa.array(out, pa.binary())], names=["s", "h1", "h2", "line"])

    found = texts.select(home.alias("k"), "text").mapInArrow(pick, "s bigint, h1 bigint, h2 bigint, line binary")
    return found.join(wanted, "s", "left_semi").dropDuplicates(["s", "h1", "h2"])


def near_lines(pairs: DataFrame, lines: DataFrame, threshold: int, min_bytes: int = 0) -> DataFrame:
    """(a1, a2, b1, b2): hashes of lines within the threshold, or within one edit if one is shorter than ``min_bytes``."""
    left = pairs.join(lines.select(F.col("s").alias("a"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("x")), "a")
    both = left.join(lines.select(F.col("s").alias("b"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("y")), "b").select("a1", "a2", "b1", "b2", "x", "y")

    def verify(batches):
        for part in K.chunks(batches, "x"):
            x, y = part.column(4).to_pylist(), part.column(5).to_pylist()
            ok = pa.array(_within(x, y, threshold, min_bytes))
            yield pa.RecordBatch.from_arrays([part.column(i).filter(ok) for i in range(4)], names=["a1", "a2", "b1", "b2"])

    return both.mapInArrow(verify, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")


def _within(x: list[bytes], y: list[bytes], threshold: int, min_bytes: int) -> np.ndarray:
    short = np.array([min(len(a), len(b)) < min_bytes for a, b in zip(x, y, strict=True)], bool)
    return edit_distances(x, y, threshold) <= np.where(short, min(1, threshold), threshold)


def _signatures(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the byte classes and of hashed pairs of neighbouring bytes. An edit changes two bits of the first at
    most, and four of the second."""
    data = np.frombuffer(b"".join(lines), np.uint8)
    ends = np.cumsum([len(x) for x in lines])
    starts = np.concatenate([[0], ends[:-1]])
    one = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(_CLASS_BIT[data])])
    code = data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]
    two = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(np.uint64(1) << (K.mix(code) % np.uint64(64)))]) if len(data) > 1 else np.zeros(1, np.uint64)
    last = np.maximum(ends - 1, starts)
    return one[ends] ^ one[starts], two[last] ^ two[starts]


def _late_in_blocks(line: list[bytes], order: np.ndarray, block: np.ndarray, threshold: int, min_bytes: int) -> np.ndarray:
    """Which lines have an earlier one within the law, across the two blocks (or inside one)."""
    one, two = _signatures(line)
    size = np.array([len(x) for x in line])
    late = np.zeros(len(line), bool)
    across = len(np.unique(block)) > 1
    for lo in range(0, len(line), 128):
        own = np.arange(lo, min(lo + 128, len(line)))
        ok = (order[None, :] < order[own, None]) & (np.abs(size[None, :] - size[own, None]) <= threshold)
        if across:
            ok &= block[None, :] != block[own, None]
        ok &= np.bitwise_count(one[None, :] ^ one[own, None]) <= 2 * threshold
        ok &= np.bitwise_count(two[None, :] ^ two[own, None]) <= 4 * threshold
        who, other = np.nonzero(ok)
        who = own[who]
        # A line needs one witness: a few candidates of each line at a time, until it has one or none is left.
        most = 4
        while len(who):
            rank = np.arange(len(who)) - np.repeat(np.flatnonzero(_groups(who)), np.diff(np.append(np.flatnonzero(_groups(who)), len(who))))
            now = rank < most
            x, y = [line[i] for i in who[now].tolist()], [line[i] for i in other[now].tolist()]
            late[who[now][_within(x, y, threshold, min_bytes)]] = True
            left = ~now & ~late[who]
            who, other, most = who[left], other[left], most * 4
    return late


def late_in_crowds(crowds: DataFrame, lines: DataFrame, firsts: DataFrame, threshold: int, min_bytes: int) -> DataFrame:
    """(h1, h2) of lines in a crowd (a: its key, b: the line) that an earlier line of the crowd is near to."""
    sizes = crowds.groupBy("a").agg(F.count("*").alias("m"))
    dealt = crowds.join(sizes, "a").withColumn("n", F.ceil(F.col("m") / BLOCK_LINES).cast("int")).withColumn("me", F.pmod(F.xxhash64("b", "a"), F.col("n")).cast("int"))
    dealt = dealt.select("a", "b", "me", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("you"))
    dealt = dealt.select("a", "b", "me", F.least("me", "you").alias("i"), F.greatest("me", "you").alias("j"))
    known = lines.join(firsts, ["h1", "h2"]).select(F.col("s").alias("b"), "h1", "h2", "line", F.col("f.k").alias("fk"), F.col("f.no").alias("fno"))

    def compare(table: pa.Table) -> pa.Table:
        k, no = table.column("fk").to_numpy(), table.column("fno").to_numpy()
        order = np.empty(len(k), np.int64)
        by_place = np.lexsort((no, k))
        order[by_place] = np.cumsum(_groups(k[by_place], no[by_place]))
        late = pa.array(_late_in_blocks(table.column("line").to_pylist(), order, table.column("me").to_numpy(), threshold, min_bytes))
        return pa.table({"h1": table.column("h1").filter(late), "h2": table.column("h2").filter(late)})

    return dealt.join(known, "b").groupBy("a", "i", "j").applyInArrow(compare, "h1 bigint, h2 bigint")


def remove_lines(docs: DataFrame, threshold: int = 2, min_bytes: int = 48, short_bytes: int | None = None, segment_pairs: int = SEGMENT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines (non-empty), n_removed, kept_text (the other lines, as they were)."""
    if min_bytes < threshold + 1:
        raise ValueError("min_bytes must exceed threshold")
    if short_bytes is not None and not 2 <= short_bytes <= min_bytes:
        raise ValueError("short_bytes must lie between 2 and min_bytes")
    K.small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("k"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def occur(batches):
        for part in K.chunks(batches, "text"):
            lines = _Lines(part.column(2))
            row = lines.words.row_of()
            number = np.arange(len(row)) - lines.words.first[row]
            k = part.column(0).to_numpy()[row]
            # What repeats an earlier line of its own chunk is known to go and needs no join: a hot line stays one row a chunk.
            order = np.lexsort((number, k, lines.h2, lines.h1))
            head = np.maximum.accumulate(np.where(_groups(lines.h1[order], lines.h2[order]), np.arange(len(order)), 0)) if len(order) else order
            again = np.zeros(len(order), bool)
            again[order] = (k[order] > k[order][head]) | (number[order] > number[order][head])
            yield pa.RecordBatch.from_arrays([pa.array(k), part.column(1).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(lines.h1.view(np.int64)), pa.array(lines.h2.view(np.int64)), pa.array(again)], names=["k", "th", "no", "h1", "h2", "again"])

    every = K.checkpoint(texts.mapInArrow(occur, "k bigint, th bigint, no int, h1 bigint, h2 bigint, again boolean"))
    occurrences = every.where("NOT again")
    firsts = K.checkpoint(occurrences.groupBy("h1", "h2").agg(F.min(F.struct("k", "no", "th")).alias("f")))
    found = K.checkpoint(candidate_pairs(texts, threshold, min_bytes, K.bucket_count(texts), short_bytes, segment_pairs))
    pairs, crowds = found.where("NOT crowd").select("a", "b"), found.where("crowd").select("a", "b")
    wanted = found.select(F.explode(F.when(F.col("crowd"), F.array("b")).otherwise(F.array("a", "b"))).alias("s")).distinct()
    known = K.checkpoint(line_texts(texts, wanted, firsts))
    near = near_lines(pairs, known, threshold, min_bytes)
    fa = firsts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("f").alias("fa"))
    fb = firsts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("f").alias("fb"))
    # Different lines at one place (of rows that share an id) are none the later.
    place = lambda c: F.struct(f"{c}.k", f"{c}.no")
    later = near.join(fa, ["a1", "a2"]).join(fb, ["b1", "b2"]).where(place("fa") != place("fb"))
    later = later.select(F.when(place("fa") > place("fb"), F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2"))).otherwise(F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).alias("l")).select("l.*")
    later = later.union(late_in_crowds(crowds, known, firsts, threshold, min_bytes)).distinct()
    judged = firsts.join(later.withColumn("late", F.lit(True)), ["h1", "h2"], "left")
    # Only contents that lose an occurrence: those near an earlier one, or with several occurrences.
    again = occurrences.join(judged, ["h1", "h2"]).where(F.col("late") | (F.struct("k", "no") != place("f")))
    # By document and text, each line number once: rows without an id, and equal rows, are no hot key.
    removed = again.select("k", "th", "no").union(every.where("again").select("k", "th", "no")).groupBy("k", "th").agg(F.collect_set("no").alias("gone"))

    def cut(batches):
        for part in K.chunks(batches, "text"):
            out = ([], [], [])
            for text, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                drop = set(gone or ())
                kept, number = [], 0
                for line in (text or "").split("\n"):
                    if not line:
                        kept.append(line)
                        continue
                    if number not in drop:
                        kept.append(line)
                    number += 1
                for o, x in zip(out, (number, len(drop), "\n".join(kept)), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["k", "n_lines", "n_removed", "kept_text"])

    done = texts.join(removed, ["k", "th"], "left").select("k", "th", "text", "gone").mapInArrow(cut, "k bigint, n_lines bigint, n_removed bigint, kept_text string")
    return done.select(F.when(F.col("k") != NO_ID, F.col("k")).cast(id_type).alias(id_col), "n_lines", "n_removed", "kept_text")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), short_bytes=16)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS r FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
occ AS (SELECT doc_id, r, l FROM raw WHERE l <> ''),
fst AS (SELECT l, min((doc_id, r)) AS f, strlen(l) AS n FROM occ GROUP BY l),
late AS (SELECT DISTINCT b.l FROM (SELECT *, unnest(range(n - 2, n + 3)) AS m FROM fst WHERE n >= 16) a JOIN fst b ON b.n = a.m WHERE a.f < b.f AND b.n >= 16 AND levenshtein(a.l, b.l) <= CASE WHEN least(a.n, b.n) >= 48 THEN 2 ELSE 1 END),
gone AS (SELECT occ.doc_id, occ.r FROM occ JOIN fst ON occ.l = fst.l LEFT JOIN late ON late.l = occ.l WHERE late.l IS NOT NULL OR (occ.doc_id, occ.r) <> fst.f),
kept AS (SELECT raw.doc_id, string_agg(l, chr(10) ORDER BY raw.r) AS t FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.r = raw.r WHERE gone.r IS NULL GROUP BY raw.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM occ GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
