"""Byte-level BPE against the public library, over random and awkward texts; streaming decoding at every cut."""

import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import fixtures as X

from queryvitals.llm import bpe

VOCABULARIES = [bpe.VOCABULARY, bpe.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")]
LONG = ["a" * 5000, " " * 3000, "ab" * 2000, "=" * 999, "é" * 700, "日本語" * 300, "\n" * 600, "x1" * 400, "aaaaaab" * 500]


@pytest.fixture(scope="module", params=VOCABULARIES)
def both(request):
    ranks = bpe.read_vocabulary(request.param)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.token_table(ranks)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_long_and_awkward_texts(both):
    encoder, library, _ = both
    for t in [*LONG, "", " ", "I'll we've 'S 's", "a b　 c", "​﻿", "ẹ́", "\r\n\t x", "<|endoftext|>", "😀👩‍👩‍👧"]:
        assert ids(encoder.encode(t)) == library.encode_ordinary(t)
        assert ids(encoder.encode(t, most=0)) == library.encode_ordinary(t)


def test_random_texts(both):
    encoder, library, _ = both
    rng = random.Random(1)
    tokens = [t.decode("utf-8", "ignore") for t in encoder.transducer.ranks]
    for _ in range(3000):
        kind = rng.random()
        if kind < 0.4:
            t = "".join(rng.choice("abcdeinorst ABE'") for _ in range(rng.randint(1, 60)))
        elif kind < 0.7:
            t = "".join(rng.choice(tokens) for _ in range(rng.randint(1, 20)))
        else:
            t = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FF), rng.randint(0x400, 0xD000), rng.randint(0x1F300, 0x1F650)])) for _ in range(rng.randint(1, 40)))
        assert ids(encoder.encode(t)) == library.encode_ordinary(t), t


def test_random_bytes_and_pairs_that_are_forgotten():
    """Matches of any bytes equal the merges by their definition, with hardly any kept pair as well, and in parts."""
    ranks = bpe.read_vocabulary(VOCABULARIES[0])
    small, large = bpe.Transducer(ranks, most=5), bpe.Transducer(ranks)
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choice([rng.randint(0, 255), *b"theain", 0xC3, 0xA9, 0x20]) for _ in range(rng.randint(1, 80)))
        want = [ranks[x] for x in large.merged(data)] if data not in ranks else [ranks[data]]
        assert large.encode(data) == small.encode(data) == want
        if data not in ranks:
            assert large.encode(data, part=rng.randint(1, 9)) == want


def test_a_small_vocabulary_with_a_token_that_merges_never_reach():
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"ab": 256, b"bc": 257, b"abcd": 258, b"abc": 259, b"cd": 260, b"xy": 261, b"yx": 262, b"xyx": 263, b"aa": 264, b"aaa": 265, b"aaaa": 266}
    rng = random.Random(3)
    machine = bpe.Transducer(ranks)
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(3000):
        t = "".join(rng.choice("abcdxy") for _ in range(rng.randint(1, 14)))
        assert machine.encode(t.encode()) == library.encode_ordinary(t), t


@pytest.mark.parametrize("match", [b"a" * 4000, b" " * 4000, b"ab" * 2000, bytes(range(256)) * 16, "日本".encode() * 700])
def test_tokens_come_after_a_bounded_lookahead(match):
    machine = bpe.Transducer(bpe.read_vocabulary(VOCABULARIES[0]))
    longest = max(map(len, machine.ranks))
    read = written = 0
    parts = [match[i : i + 16] for i in range(0, len(match), 16)]
    for part, ids in zip([*parts, b""], machine.stream(parts), strict=True):
        read += len(part)
        written += sum(len(machine.bytes_of[x]) for x in ids)
        assert read - written <= 2 * longest + 16
    assert written == len(match)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=8))
def test_automaton_gives_one_text_for_every_cut(parts):
    machine = bpe.Utf8()
    pieces = [machine.feed(p) for p in parts]
    assert "".join(pieces) + machine.close() == b"".join(parts).decode("utf-8", "replace")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40), st.integers(1, 5))
def test_pieces_are_whole_characters(text, size):
    machine, data = bpe.Utf8(), text.encode()
    done = ""
    for i in range(0, len(data), size):
        done += machine.feed(data[i : i + size])
        assert text.startswith(done)
    assert done + machine.close() == text


def test_documents(spark, both):
    _, library, _ = both
    rows = [*X.documents(), *[(900 + i, t, "en", "a", 0, 0, 0, None, None, None, None) for i, t in enumerate(LONG)]]
    vocabulary = next(v for v in VOCABULARIES if bpe.read_vocabulary(v) == dict(library._mergeable_ranks))
    made = bpe.decode(bpe.encode(X.frame(spark, rows), vocabulary), vocabulary).collect()
    assert sorted(((r["doc_id"], ids(r["ids"]), r["decoded"], r["k"]) for r in made), key=repr) == sorted(((r[0], library.encode_ordinary(r[1] or ""), r[1] or "", r[7]) for r in rows), key=repr)
    again = bpe.round_trip(X.frame(spark, rows), vocabulary).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, made), key=repr)
    assert bpe.decode(bpe.encode(X.empty(spark))).count() == bpe.round_trip(X.empty(spark)).count() == 0


def test_broken_ids(spark):
    rows = [(1, b"\x01\x00"), (2, np.array([60000], "<u4").tobytes()), (3, None), (4, b""), (5, np.array([50256], "<u4").tobytes()), (6, np.array([0], "<u4").tobytes())]
    got = {r["k"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "k int, ids binary")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "", 5: None, 6: "!"}
