"""Secret scans: candidates from byte patterns, false positives removed by a random forest.

Candidates are the values after a credential word and ``=`` or ``:``, long runs of token characters that hold a digit,
letters of both cases or a known prefix, and private-key blocks. A value that a quote opens runs to the matching quote of
its line (escapes counted), any other one to a blank, quote, comma or semicolon; a run is cut where a value begins in it. A
block runs to its END line, or without one to its last line of key characters. None has a longest length. Each is described by its length, character transitions (how often neighbouring characters change class, and how
likely they are in ordinary words), the share of its letters that dictionary words cover, its path, and its neighbouring words. A forest
trained from labelled findings gives the share of trees that call it a secret.

The dictionary is counted over the whole corpus: its ``most`` frequent words (a documented bound). The forest is
trained on at most ``train_rows`` labelled findings (a documented bound); without a findings table it is trained on the
seeded set of the module ``findings``. Every text is scanned whole; a finding never leaves its row, and only word counts
are shuffled.

Defined cases: null and empty texts have no findings; repeated rows each get their own; a null path counts as an
empty one; positions are bytes of the UTF-8 text; overlapping candidates become the longer one; other columns stay.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryvitals.llm import kernel as K
from queryvitals.llm.findings import ANNOUNCE, example_findings

MASK = "[SECRET]"
MIN_RUN, MIN_VALUE, CONTEXT = 16, 6, 48

# Words that announce something else, path marks, and words that placeholders are made of, which count
# as dictionary words whatever the corpus.
_DENY = ["sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "etag", "revision", "build", "version", "example", "sample", "dummy", "id", "isbn", "url", "see", "integrity"]
_PATH = ["test", "example", "sample", "doc", "fixture", "mock", "lock", "vendor", "env", "config", "settings", "deploy"]
_PLACEHOLDER = ["example", "sample", "test", "dummy", "change", "your", "password", "secret", "token", "here", "user", "name", "admin", "default", "place", "holder", "config", "data", "value", "string", "true", "false", "null", "none", "http", "https", "www", "file", "path", "version", "license", "the", "and", "for", "with", "from", "index", "main", "class", "function", "return", "import", "module", "package", "server", "client", "image", "style", "script", "public", "private", "home", "local", "temp", "build", "dist", "lib", "bin", "src", "chapter", "section", "page", "title", "table", "number", "first", "last", "next", "start", "end", "open", "close", "time", "date", "year", "month", "week", "order", "price", "total"]

_TOKEN = K._byte_mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")
_DIGIT, _UPPER, _LOWER = (K._byte_mask(x) for x in (b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_PREFIXES = (b"AKIA", b"ghp_", b"xoxb", b"xoxp", b"sk_l", b"glpa", b"AIza", b"eyJh")
_PREFIX = re.compile(rb"(?<![A-Za-z0-9])(?:" + b"|".join(_PREFIXES) + rb")")
_CREDENTIAL = re.compile(rb"(?:" + b"|".join(re.escape(w.encode()) for w in ANNOUNCE) + rb")[\"'\]]?[ \t]{0,4}$", re.IGNORECASE)
_OPENS = re.compile(rb"[=:>]?[ \t]{0,4}([\"'`]?)")
_VALUE_END = re.compile(rb"[\s\"'`,;]")
#: From behind an opening quote to the matching one, in one line.
_QUOTED = {q: re.compile(rb"(?:[^\\\n" + q + rb"]|\\[^\n])*+" + q) for q in (b'"', b"'", b"`")}
_KEY_BEGIN = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINES = re.compile(rb"(?:[ \t]*\r?\n(?:[A-Za-z-]+: [^\n]*|[A-Za-z0-9+/=]*)(?=[ \t]*\r?(?:\n|\Z)))*")
_KEY_END = re.compile(rb"-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_KINDS = ["assigned", "run", "block"]
_WORD = re.compile(r"[a-z0-9_-]+")


def key_blocks(text: bytes) -> list[tuple[int, int, int]]:
    """Private-key blocks of any length: each BEGIN line outside the last block, with the next END line, or else with the
    lines of key characters that follow it."""
    out, last = [], False
    for begin in _KEY_BEGIN.finditer(text):
        if out and begin.start() < out[-1][1]:
            continue
        end = None if last else _KEY_END.search(text, begin.end())
        last = end is None  # then no later block has one
        stop = end.end() if end else begin.end() + len(_KEY_LINES.match(text, begin.end()).group().rstrip())
        if stop > begin.end():
            out.append((begin.start(), stop, 2))
    return out


def _likely(run: bytes) -> bool:
    b = np.frombuffer(run, np.uint8)
    return bool(_DIGIT[b].any() or (_UPPER[b].any() and _LOWER[b].any()) or _PREFIX.search(run))


def candidates(text: bytes, runs: list[tuple[int, int]], marks: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of one text: ``runs`` are its long token runs, ``marks`` its ``=`` and ``:``."""
    found, begun = [], {}
    stop = -1
    for at in marks:
        # The longest credential word with its quote and blanks has fewer bytes.
        if _CREDENTIAL.search(text[max(0, at - 28) : at]):
            opens = _OPENS.match(text, at + 1)
            start = opens.end()
            quoted = _QUOTED[opens.group(1)].match(text, start) if opens.group(1) else None
            if quoted:
                end = quoted.end() - 1
            else:
                # A value that starts inside the last one ends where that does: each byte is looked at once.
                if start > stop:
                    m = _VALUE_END.search(text, start)
                    stop = m.start() if m else len(text)
                end = stop
            if end - start >= MIN_VALUE:
                found.append((start, end, 0))
                begun[start] = at
    starts = sorted(begun)
    for a, b in runs:
        i = bisect.bisect_right(starts, a)
        if i < len(starts) and starts[i] < b:
            b = begun[starts[i]]
            if b - a < MIN_RUN or not _likely(text[a:b]):
                continue
        found.append((a, b, 1))
    if b"-----BEGIN " in text:
        found += key_blocks(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, int]] = []
    for one in found:
        if out and one[0] < out[-1][1]:
            last = out[-1]
            if one[1] - one[0] > last[1] - last[0]:
                out[-1] = (one[0], one[1], min(one[2], last[2]) if 2 not in (one[2], last[2]) else 2)
            elif one[2] == 0 and last[2] == 1:
                out[-1] = (last[0], last[1], 0)
            continue
        out.append(one)
    return out


def scan_bytes(column: pa.Array) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """Every text with its candidates."""
    data, offsets = K.column_bytes(column)
    w = K.Words(column, _TOKEN)
    long = np.flatnonzero(w.end - w.start >= MIN_RUN)
    digit, upper, lower = (np.concatenate([[0], np.cumsum(mask[data], dtype=np.int32)]) for mask in (_DIGIT, _UPPER, _LOWER))
    digit, upper, lower = (n[w.end[long]] > n[w.start[long]] for n in (digit, upper, lower))
    likely = digit | (upper & lower)
    for i in np.flatnonzero(~likely).tolist():
        likely[i] = _PREFIX.search(data[w.start[long[i]] : w.end[long[i]]].tobytes()) is not None
    long = long[likely]
    run_row = np.searchsorted(offsets, w.start[long], side="right") - 1
    marks = np.flatnonzero((data == 0x3D) | (data == 0x3A))
    mark_row = np.searchsorted(offsets, marks, side="right") - 1
    block = np.flatnonzero(data == 0x2D)
    has_dash = np.zeros(len(offsets), bool)
    has_dash[np.searchsorted(offsets, block, side="right") - 1] = True
    runs_by, marks_by = {}, {}
    for r, i in zip(run_row.tolist(), long.tolist(), strict=True):
        runs_by.setdefault(r, []).append((int(w.start[i] - offsets[r]), int(w.end[i] - offsets[r])))
    for r, m in zip(mark_row.tolist(), marks.tolist(), strict=True):
        marks_by.setdefault(r, []).append(int(m - offsets[r]))
    out = []
    for r in range(len(offsets) - 1):
        if r in runs_by or r in marks_by or has_dash[r]:
            text = data[offsets[r] : offsets[r + 1]].tobytes()
            out.append((text, candidates(text, runs_by.get(r, []), marks_by.get(r, []))))
        else:
            out.append((b"", []))
    return out


_CLASS = np.full(256, 3, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_HEX = K._byte_mask(b"0123456789abcdefABCDEF-")
SHORTEST, LONGEST = 4, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """A set of words of four to sixteen letters a to z, by length and hash."""

    def __init__(self, words):
        self.hashes: dict[int, np.ndarray] = {}
        for n in range(SHORTEST, LONGEST + 1):
            own = [w.encode() for w in words if len(w) == n]
            if own:
                letters = np.frombuffer(b"".join(own), np.uint8).reshape(-1, n)
                h = np.zeros(len(own), np.uint64)
                for i in range(n):
                    h = h * _BASE + letters[:, i]
                self.hashes[n] = np.unique(h)

    def covered(self, low: np.ndarray) -> np.ndarray:
        """Which bytes of a value in lower case belong to a word: one pass for each length of word."""
        n = len(low)
        letter = (low >= 0x61) & (low <= 0x7A)
        # How many letters follow, from each byte on.
        stops = np.append(np.flatnonzero(~letter), n)
        follow = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
        edge = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(follow >= SHORTEST)
        h = np.zeros(len(at), np.uint64)
        for size in range(1, LONGEST + 1):
            keep = follow[at] >= size
            at, h = at[keep], h[keep]
            if not len(at):
                break
            h = h * _BASE + low[at + size - 1]
            known = self.hashes.get(size)
            if known is not None:
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = at[known[place] == h]
                edge[hit] += 1
                edge[hit + size] -= 1
        return np.cumsum(edge[:-1]) > 0


class Dictionary:
    """Words by which a candidate's letters are judged, those that placeholders are made of among them, and the pairs of
    letters that are usual in them."""

    def __init__(self, words):
        self.words = {w for w in {*words, *_PLACEHOLDER} if SHORTEST <= len(w) <= LONGEST and w.isascii() and w.isalpha() and w.islower()}
        self.every, self.placeholders = Words(self.words), Words(_PLACEHOLDER)
        self.pairs = np.zeros(26 * 26, bool)
        for w in self.words:
            letters = np.frombuffer(w.encode(), np.uint8).astype(np.int64) - 0x61
            self.pairs[letters[:-1] * 26 + letters[1:]] = True


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = 20_000) -> list[str]:
    """The most frequent words of four to sixteen letters a to z, counted over all texts: those at least as frequent as
    the smallest count that no more than ``most`` words reach, and seen twice. Nothing else comes to the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(rf"(?<![a-z0-9])[a-z]{{{SHORTEST},{LONGEST}}}(?![a-z0-9])"), F.lit(0))).alias("w"))
    counted = K.checkpoint(words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"))
    # One row for each count that occurs.
    reached = counted.groupBy("n").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy(F.desc("n"))))
    cut = reached.where(F.col("upto") <= most).agg(F.min("n").alias("n")).first()["n"]
    if cut is None:
        return []
    return [r["w"] for r in sorted(counted.where(F.col("n") >= cut).collect(), key=lambda r: (-r["n"], r["w"]))]


def features(value: bytes, before: bytes, after: bytes, path: str, kind: int, dictionary: Dictionary) -> list[float]:
    """A candidate's numbers; all that looks at its bytes does so in a few passes, whatever its length."""
    b = np.frombuffer(value, np.uint8)
    n = len(b)
    kinds = _CLASS[b]
    share = np.bincount(kinds, minlength=4) / n
    counts = np.bincount(b, minlength=256)
    p = counts[counts > 0] / n
    low = K._LOWER[b]
    letters = kinds < 2
    code = low.astype(np.int64) - 0x61
    both = letters[1:] & letters[:-1]
    pairs = dictionary.pairs[(code[:-1] * 26 + code[1:])[both]]
    covered, placeholder = dictionary.every.covered(low), dictionary.placeholders.covered(low)
    left = _WORD.findall(before.decode("utf-8", "ignore").lower())[-3:]
    right = _WORD.findall(after.decode("utf-8", "ignore").lower())[:2]
    near = [re.sub(r"[_-]", "", w) for w in left]
    lone = path.lower()
    changes = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [n]])
    tail = before.rstrip(b" \t\"'`")[-1:]
    return [
        float(n),
        *share.tolist(),
        float(-(p * np.log2(p)).sum()),
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        float(pairs.mean()) if len(pairs) else 0.5,
        float((covered & letters).sum() / max(letters.sum(), 1)),
        float((placeholder & letters).sum() / max(letters.sum(), 1)),
        float(_HEX[b].all()),
        float(np.diff(changes).max()) / n,
        len(p) / n,
        float(counts[0x2F] + counts[0x2E]) / n,
        float(counts[0x20] + counts[0x09]) / n,
        float(any(a.replace("_", "").replace("-", "") in w for w in near[-2:] for a in ANNOUNCE)),
        float(any(w in _DENY or w.rstrip("0123456789") in _DENY for w in left + right)),
        float(tail in (b"=", b":")),
        float(before[-1:] in (b'"', b"'", b"`")),
        float(any(m in lone for m in _PATH[:8])),
        float(any(m in lone for m in _PATH[8:])),
        float(kind == 0),
        float(kind == 2),
        float(value[:4] in _PREFIXES),
    ]


class Forest:
    """Bootstrap-aggregated Gini trees, as flat arrays, and the dictionary that their features use."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], dictionary: Dictionary | None = None):
        self.trees, self.dictionary = trees, dictionary or Dictionary([])

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                f = np.where(inner, feature[at], 0)
                step = np.where(x[np.arange(len(x)), f] <= cut[at], left[at], right[at])
                at = np.where(inner, step, at)
            out += value[at]
        return out / max(len(self.trees), 1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 9, seed: int = 5) -> Forest:
    rng = np.random.default_rng(seed)
    tries = int(np.ceil(np.sqrt(x.shape[1]))) + 1
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        nodes: list[list] = []

        def build(rows: np.ndarray, level: int, nodes=nodes) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
            if level == depth or len(rows) < 4 or y[rows].min() == y[rows].max():
                return me
            best = (1e-9, -1, 0.0)
            total, ones = len(rows), y[rows].sum()
            base = ones * (total - ones) / total
            for f in rng.choice(x.shape[1], tries, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, label = x[rows[order], f], y[rows[order]]
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                n, k = cut + 1, np.cumsum(label)[cut]
                gain = base - k * (n - k) / n - (ones - k) * (total - n - ones + k) / (total - n)
                g = int(gain.argmax())
                if gain[g] > best[0]:
                    best = (float(gain[g]), int(f), float((v[cut[g]] + v[cut[g] + 1]) / 2))
            if best[1] < 0:
                return me
            go = x[rows, best[1]] <= best[2]
            nodes[me][0], nodes[me][1] = best[1], best[2]
            nodes[me][2] = build(rows[go], level + 1)
            nodes[me][3] = build(rows[~go], level + 1)
            return me

        build(rows, 0)
        f, c, a, b, v = zip(*nodes, strict=True)
        out.append((np.array(f), np.array(c), np.array(a), np.array(b), np.array(v)))
    return Forest(out)


def train(findings: DataFrame | None = None, words: list[str] | None = None, train_rows: int = 20_000) -> Forest:
    """A forest from a table of labelled findings (before, value, after, path, label), at most about ``train_rows`` of
    them, and a dictionary of ``words`` (see ``corpus_words``)."""
    dictionary = Dictionary(words or [])
    if findings is None:
        rows = example_findings(sorted(dictionary.words))
    else:
        usable = findings.where("value IS NOT NULL AND value <> '' AND label IS NOT NULL")
        share = min(1.0, train_rows / max(usable.count(), 1))
        usable = usable.where(F.pmod(F.xxhash64("before", "value", "after", "path"), F.lit(1 << 30)) <= int(share * (1 << 30)))
        rows = [(r["before"] or "", r["value"], r["after"] or "", r["path"] or "", int(r["label"])) for r in usable.select("before", "value", "after", "path", "label").collect()]
    if not rows:
        return Forest([], dictionary)
    x, y = [], []
    for before, value, after, path, label in rows:
        b = before.encode()[-CONTEXT:]
        x.append(features(value.encode(), b, after.encode()[:CONTEXT], path, _kind(b, value.encode()), dictionary))
        y.append(float(label))
    return Forest(grow(np.array(x), np.array(y)).trees, dictionary)


def _kind(before: bytes, value: bytes) -> int:
    if value.startswith(b"-----BEGIN"):
        return 2
    trimmed = before.rstrip(b" \t\"'`")
    return 0 if trimmed[-1:] in (b"=", b":") and _CREDENTIAL.search(trimmed[:-1]) else 1


def find_secrets(docs: DataFrame, forest: Forest, threshold: float = 0.5, text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``docs`` with findings (start, end, kind, score, secret) and redacted (the text with each secret masked)."""
    K.small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("findings", "redacted")]
    path = F.lit("") if path_col is None else F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"), path.alias("__path"))
    finding = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("secret", T.BooleanType())])
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("findings", T.ArrayType(finding)), T.StructField("redacted", T.StringType())])

    def run(batches):
        for part in K.chunks(batches, "__text"):
            column, paths = part.column(part.num_columns - 2), part.column(part.num_columns - 1).to_pylist()
            scanned = scan_bytes(column)
            x = [features(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], paths[r], k, forest.dictionary) for r, (text, found) in enumerate(scanned) for a, b, k in found]
            score = iter(forest.score(np.array(x)).tolist() if x else [])
            findings, redacted = [], []
            plain = column.to_pylist()
            for r, (text, found) in enumerate(scanned):
                rows = [{"start": a, "end": b, "kind": _KINDS[k], "score": s, "secret": s >= threshold} for (a, b, k), s in zip(found, score, strict=False)] if found else []
                findings.append(rows)
                if any(f["secret"] for f in rows):
                    out, at = [], 0
                    for f in rows:
                        if f["secret"]:
                            out += [text[at : f["start"]], MASK.encode()]
                            at = f["end"]
                    redacted.append(b"".join([*out, text[at:]]).decode("utf-8", "replace"))
                else:
                    redacted.append(plain[r])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(findings, kind), pa.array(redacted, pa.string())], names=[*part.schema.names[:-2], "findings", "redacted"])

    return source.mapInArrow(run, schema)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: its candidates, its secrets, the places of the secrets, and a digest of the redacted text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = find_secrets(docs, train(words=corpus_words(docs)), path_col="source")
    secret = F.filter("findings", lambda f: f["secret"])
    places = F.array_join(F.transform(secret, lambda f: F.concat_ws("-", f["start"].cast("string"), f["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("findings").cast("bigint").alias("n_candidates"), F.size(secret).cast("bigint").alias("n_secrets"), places.alias("places"), F.sha2(F.coalesce("redacted", F.lit("")), 256).alias("redacted_sha256"))
