"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is what the merges make of its bytes exactly if each token is reached by the merges of its own bytes
and no merge would cross the border of any two neighbours, which is a question about these two tokens alone. So the
encodings are the paths of a nondeterministic transducer: it walks the trie of the tokens and, where a token ends that
may follow the last one, may write it and start at the root again. ``Transducer`` determinises it while it reads: a state is
the set of walks that are under way, named by the longest, as all others are its suffixes; transitions and the tokens that
end in a state are made when first met. Only one encoding ends at each byte, so one token for each place is all that a
walk's start must remember. What the encodings through all walks' starts have in common is certain and is emitted; as a
walk is at most one token long, that is a bounded number of bytes behind the input, however long the input is. Which
neighbours may stand side by side is found out once for each pair that is met, and kept, up to a limit.

Decoding looks ids up and sends their bytes through an incremental UTF-8 automaton, which holds back the bytes of a
character that has not ended yet: any cut of the ids gives the same text.

The vocabulary (token bytes and rank, one a line) is read by the driver and broadcast, as its size is fixed. Texts are split by the
pattern before the merges; a match that is itself a token is that token. Matches that recur are kept with their ids, up to a
limit, in each worker.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows each get their row; an empty
table gives no rows; very long texts are read match by match and never cut; other columns travel along, columns named
like the output are replaced. Null, unknown or broken ids decode to null; bytes that are no UTF-8 to U+FFFD.
"""

from __future__ import annotations

import base64
import gc
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryvitals.llm import kernel as K

#: Fixed value: the pattern of the vocabulary, as its publisher gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_PAIRS = 1 << 19
MOST_WORDS = 1 << 18
#: Longer matches are not kept.
LONG_WORD = 64
_NEVER = 1 << 60


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _shared(docs: DataFrame, vocabulary: str) -> tuple:
    """The broadcast vocabulary, and a number that tells it from others."""
    ranks = read_vocabulary(vocabulary)
    return docs.sparkSession.sparkContext.broadcast(ranks), zlib.crc32(repr(sorted(ranks.items())).encode())


class Transducer:
    """Bytes to token ids for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], most: int = MOST_PAIRS):
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.ranks, self.most = ranks, most
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The trie of the tokens: (node, byte) -> node, and of each node its parent with the byte, its depth and the token that ends there.
        self._child: dict[int, int] = {}
        self._above, self._depth, self._token = [0], [0], [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                above = node << 8 | b
                node = self._child.setdefault(above, len(self._above))
                if node == len(self._above):
                    self._above.append(above)
                    self._depth.append(self._depth[above >> 8] + 1)
                    self._token.append(-1)
            self._token[node] = rank
        self._inner = {key >> 8 for key in self._child}
        # Made when first needed: the state after a byte, the next shorter walk of a state, and the tokens that end in it.
        self._after: dict[int, int] = {}
        self._shorter: list[int | None] = [0, *[None] * (len(self._above) - 1)]
        self._ends: list[tuple | None] = [(), *[None] * (len(self._above) - 1)]
        self._own: dict[int, tuple | None] = {}
        self._pairs: dict[int, bool] = {}

    def _next(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest walk of ``state`` that goes on with it."""
        known = self._after.get(state << 8 | byte)
        if known is None:
            walk = state
            while (known := self._child.get(walk << 8 | byte)) is None:
                walk = self._shorter_of(walk)
            self._after[state << 8 | byte] = known
        return known

    def _shorter_of(self, state: int) -> int:
        if self._shorter[state] is None:
            above, byte = self._above[state] >> 8, self._above[state] & 255
            self._shorter[state] = self._next(self._shorter_of(above), byte) if above else 0
        return self._shorter[state]

    def _ends_of(self, state: int) -> tuple:
        """(token, length) of the tokens that may end here, the longest first."""
        if self._ends[state] is None:
            token = self._token[state]
            own = ((token, self._depth[state]),) if token >= 0 and self._edges(token) else ()
            self._ends[state] = own + self._ends_of(self._shorter_of(state))
        return self._ends[state]

    def merged(self, data: bytes) -> list[bytes]:
        """What the merges make of some bytes, by their definition: the neighbours of lowest rank first, leftmost of equals."""
        return self._history(data)[-1][1]

    def _history(self, data: bytes) -> list[tuple[int, list[bytes]]]:
        """The parts before each merge with the merge's rank, and what is left in the end."""
        parts, out = [data[i : i + 1] for i in range(len(data))], []
        while True:
            ranks = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks, default=_NEVER)
            out.append((best, parts))
            if best == _NEVER:
                return out
            i = ranks.index(best)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    def _edges(self, token: int) -> tuple | None:
        """Ranks of a token's own merges in their order, and its first and last part before each; None if its bytes do not become it."""
        if token not in self._own:
            history = self._history(self.bytes_of[token])
            reached = len(history[-1][1]) == 1
            self._own[token] = ([r for r, _ in history], [p[0] for _, p in history], [p[-1] for _, p in history]) if reached else None
        return self._own[token]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether the merges leave two tokens side by side: both go through their own merges, lower rank first and the
        left one first of equals, and at no time may the parts at the border be the next to merge."""
        if last < 0:
            return True
        (ranks_a, _, edge_a), (ranks_b, edge_b, _) = self._edges(last), self._edges(token)
        i = j = 0
        while True:
            across, a, b = self.ranks.get(edge_a[i] + edge_b[j], _NEVER), ranks_a[i], ranks_b[j]
            if across < a and across <= b:
                return False
            if a == b == _NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def _read(self, state: int, data: bytes, last: list[int]) -> int:
        """The state after some bytes. ``last`` holds the token that ends at each place so far, and grows by one a byte."""
        after, ends, pairs = self._after, self._ends, self._pairs
        for byte in data:
            state = after.get(state << 8 | byte) or self._next(state, byte)
            for token, length in ends[state] or self._ends_of(state):
                pair = last[-length] << 32 | token
                known = pairs.get(pair)
                if known is None:
                    if len(pairs) >= self.most:
                        pairs.clear()
                    known = pairs[pair] = self._may_follow(last[-length], token)
                if known:
                    last.append(token)
                    break
        return state

    def _path(self, place: int, last: list[int]) -> list[int]:
        """Places from ``place`` back to 0, token by token."""
        path = [place]
        while place > 0:
            place -= len(self.bytes_of[last[place]])
            path.append(place)
        return path

    def stream(self, data: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one match that comes in parts, after each part as far as they are certain."""
        state, last = 0, [-1]
        for part in data:
            state = self._read(state, part, last)
            # Every encoding that is still possible goes through the start of one of the walks, or through this place.
            common = self._path(len(last) - 1, last)
            walk = state
            while walk:
                if walk in self._inner:
                    other = set(self._path(len(last) - 1 - self._depth[walk], last))
                    common = [place for place in common if place in other]
                walk = self._shorter_of(walk)
            yield [last[place] for place in reversed(common[:-1])]
            del last[: common[0]]
        yield [last[place] for place in reversed(self._path(len(last) - 1, last)[:-1])]

    def encode(self, match: bytes, part: int = 256) -> list[int]:
        """Ids of one match of the pattern."""
        known = self.ranks.get(match)
        if known is not None:
            return [known]
        if len(match) > part:
            return [token for ids in self.stream(match[i : i + part] for i in range(0, len(match), part)) for token in ids]
        last = [-1]
        self._read(0, match, last)
        out, place = [], len(match)
        while place:
            out.append(last[place])
            place -= len(self.bytes_of[last[place]])
        return out[::-1]


class Encoder:
    """Whole texts to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.transducer = Transducer(ranks)
        self._matches = regex.compile(pattern)
        #: Matches met lately, and those met before them that may come back.
        self._kept: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def _packed(self, word: str) -> bytes:
        found = self._kept.get(word)
        if found is None:
            found = self._before.get(word)
            if found is None:
                ids = self.transducer.encode(word.encode())
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= LONG_WORD:
                if len(self._kept) >= MOST_WORDS:
                    self._before, self._kept = self._kept, {}
                self._kept[word] = found
        return found

    def encode(self, text: str, most: int = 1 << 20) -> bytes:
        if len(text) <= most:
            return b"".join(map(self._packed, self._matches.findall(text)))
        # A long text is read match by match.
        out = bytearray()
        for m in self._matches.finditer(text):
            out += self._packed(m.group())
        return bytes(out)

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """The tables grow by many small objects that form no cycles, so Python's search for cycles waits meanwhile."""
        searched = gc.isenabled()
        gc.disable()
        try:
            return [self.encode(t) for t in texts]
        finally:
            if searched:
                gc.enable()


#: Fixed values, from the definition of UTF-8: for each lead byte, the following bytes that are wanted and the range of the first one.
_LEADS = [(0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
_LEAD = {b: rule for low, high, *rule in _LEADS for b in range(low, high + 1)}


class Utf8:
    """An incremental UTF-8 automaton: text comes out up to the last character that has ended."""

    def __init__(self):
        self._held = b""

    @staticmethod
    def open_bytes(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could still end."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            wanted, low, high = _LEAD.get(lead, (0, 0, 0))
            begun = wanted >= back and (back == 1 or low <= data[1 - back] <= high)
            return back if begun else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self._held + data
        end = len(data) - self.open_bytes(data)
        self._held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        """The text of bytes that never became a character."""
        held, self._held = self._held, b""
        return held.decode("utf-8", "replace")


def decode_stream(ids: Iterable[np.ndarray], tokens: list[bytes | None]) -> Iterator[str]:
    """Text pieces of an id stream that comes in arrays. Raises KeyError for an unknown id."""
    machine = Utf8()
    for part in ids:
        if len(part) and int(part.max()) >= len(tokens):
            raise KeyError(int(part.max()))
        found = [tokens[i] for i in part.tolist()]
        try:
            yield machine.feed(b"".join(found))
        except TypeError:
            raise KeyError("an unknown id") from None
    yield machine.close()


def token_table(ranks: dict[bytes, int]) -> list[bytes | None]:
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


#: Built once in each worker process, by vocabulary and pattern; a few at most.
_BUILT: dict[tuple, object] = {}


def _built(key: tuple, make):
    if key not in _BUILT:
        if len(_BUILT) > 4:
            _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


def _with_columns(docs: DataFrame, made: list[tuple]) -> DataFrame:
    """``docs`` with columns (kernel, source, name, type), each computed by ``kernel(array) -> array`` from an earlier
    one, in one pass over slices of bounded bytes."""
    names = [c for c in docs.columns if c not in {name for _, _, name, _ in made}]
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(name, kind) for _, _, name, kind in made)])
    first = made[0][1]

    def run(batches):
        for batch in batches:
            for part in K.chunks([batch.rename_columns(names)], first):
                columns = dict(zip(names, part.columns, strict=True))
                for kernel, source, name, _ in made:
                    columns[name] = kernel(columns[source])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    K.small_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def _encoding(docs: DataFrame, vocabulary: str, pattern: str, text_col: str) -> tuple:
    ranks, mark = _shared(docs, vocabulary)

    def kernel(column: pa.Array) -> pa.Array:
        encoder = _built(("encode", mark, pattern), lambda: Encoder(ranks.value, pattern))
        return pa.array(encoder.encode_all(t.as_py() or "" for t in column), pa.binary())

    return kernel, text_col, "ids", T.BinaryType()


def _decoding(docs: DataFrame, vocabulary: str, ids_col: str) -> tuple:
    ranks, mark = _shared(docs, vocabulary)

    def text(packed: bytes | None, tokens: list) -> str | None:
        if packed is None or len(packed) % 4:
            return None
        ids = np.frombuffer(packed, "<u4")
        try:
            return "".join(decode_stream((ids[i : i + 4096] for i in range(0, len(ids), 4096)), tokens))
        except KeyError:
            return None

    def kernel(column: pa.Array) -> pa.Array:
        tokens = _built(("decode", mark), lambda: token_table(ranks.value))
        return pa.array([text(x.as_py(), tokens) for x in column], pa.string())

    return kernel, ids_col, "decoded", T.StringType()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``ids``: binary, little-endian unsigned 32-bit integers."""
    return _with_columns(docs, [_encoding(docs, vocabulary, pattern, text_col)])


def decode(docs: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` with ``decoded``, the text of the ids."""
    return _with_columns(docs, [_decoding(docs, vocabulary, ids_col)])


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass, so that a task has one Python worker and not two with their tables."""
    return _with_columns(docs, [_encoding(docs, vocabulary, pattern, text_col), _decoding(docs, vocabulary, "ids")])


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
