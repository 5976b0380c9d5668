import random
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from queryvitals.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column("t").alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "folded"),
    [("أحمد", "احمد"), ("إلى", "الي"), ("قهوة", "قهوه"), ("حَلِيب", "حليب"), ("حـليب", "حليب"), ("١٢٣ لتر", "123 لتر"), ("۴۵", "45"), ("Milk - 1L!", "milk 1l"), ("  a   b ", "a b"), ("Straße", "strasse"), (None, ""), ("", ""), ("a_b", "a_b")],
)
def test_normalize(spark, raw, folded):
    assert one(spark, raw, T.normalize) == folded
    assert T.fold_string(raw) == folded


def test_normalize_twice_changes_nothing(spark):
    rows = [("ﻼ Ünï 12 ½ x",), ("أإآ ٱ",), ("A.B,C",), ("ß ẞ",)]
    once = spark.createDataFrame(rows, "t string").withColumn("n", T.normalize("t")).withColumn("m", T.normalize("n"))
    assert all(r["n"] == r["m"] for r in once.collect())


def both_folds(spark, texts):
    """(text, fold of the column, fold of one string, fold of the column's fold)."""
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", T.normalize("t")).withColumn("m", T.normalize("n"))
    return [(r["t"], r["n"], T.fold_string(r["t"]), r["m"]) for r in rows.collect()]


ASSIGNED = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]


def test_every_assigned_code_point_folds_as_one_string_does(spark):
    got = both_folds(spark, [f"a{''.join(ASSIGNED[i : i + 7])}b {ASSIGNED[i]} \u0323\u0302" for i in range(0, len(ASSIGNED), 7)])
    assert [x for x in got if not x[1] == x[2] == x[3]] == []


def test_random_strings_of_all_blocks(spark):
    rng = random.Random(4)
    marks = [c for c in ASSIGNED if unicodedata.combining(c)]
    jamo = [chr(c) for c in range(0x1100, 0x1200)]
    draw = lambda: rng.choice([rng.choice(ASSIGNED), rng.choice(marks), rng.choice(jamo), rng.choice("aeiouAΣσς ße"), chr(rng.randint(0x600, 0x6FF))])
    got = both_folds(spark, ["".join(draw() for _ in range(rng.randint(0, 24))) for _ in range(8000)])
    # A dropped mark may have kept a consonant and a vowel apart, which a second fold then joins; nothing else changes.
    assert [x for x in got if x[1] != x[2] or x[3] != unicodedata.normalize("NFKC", x[1])] == []


@pytest.mark.parametrize(
    ("raw", "folded"),
    [("ΟΔΟΣ ΟΔΟΣ.", "οδοσ οδοσ"), ("a\u0302\u0323b", "ậb"), ("a\u0323\u0302b", "ậb"), ("\u1112\u1161\u11ab", "한"), ("ｍｉｌｋ １ｌ", "milk 1l"), ("ﬁne ﻼ", "fine لا"), ("cafe\u0301 cre\u0300me", "café crème"), ("x² ½ ㎏", "x2 1 2 kg"), ("ẞ", "ss"), ("ᏸ", "Ᏸ")],
)
def test_marks_in_any_order_greek_and_hangul(spark, raw, folded):
    assert one(spark, raw, T.normalize) == T.fold_string(raw) == T.fold_string(folded) == folded


def test_folding_is_linear_in_the_text(spark):
    def took(n):
        rows = spark.createDataFrame([("a\u0302\u0323ß한 " * n,)], "t string").select(F.length(T.normalize("t")).alias("n"))
        began = time.perf_counter()
        rows.collect()
        return time.perf_counter() - began

    took(100)
    assert took(80_000) < 16 * max(took(20_000), 0.25)


@pytest.mark.parametrize(("word", "stem"), [("الحليب", "حليب"), ("والحليب", "حليب"), ("بالحليب", "حليب"), ("للحليب", "حليب"), ("الم", "الم")])
def test_light_stem(spark, word, stem):
    assert one(spark, word, T.light_stem) == stem


def test_stem_tries_the_next_prefix(spark):
    # The first prefix leaves too little; a shorter one still fits.
    assert one(spark, "وبالا", T.light_stem) == "وبالا"
    assert one(spark, "البيت", T.light_stem) == "بيت"


@pytest.mark.parametrize(("text", "script"), [("حليب", "arabic"), ("milk", "latin"), ("milk حليب", "mixed"), ("123", "digits"), ("حليب 2", "arabic"), ("", "other"), (None, "other"), ("!!", "other")])
def test_script(spark, text, script):
    assert one(spark, text, T.script_of) == script


def osa(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.text("abcحلي", max_size=7), st.text("abcحلي", max_size=7)), min_size=20, max_size=60))
def test_osa_distance(spark, pairs):
    pairs += [("ab", "ba"), ("ca", "abc"), ("", "abc"), ("abc", ""), ("", ""), ("pas", "pasta"), ("teh", "the")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.osa_distance("a", "b").alias("d"), T.osa_distance("b", "a").alias("e"), T.within_osa("a", "b", 2).alias("w"), T.similarity("a", "b").alias("s")).collect()
    for r in rows:
        d = osa(r["a"], r["b"])
        assert r["d"] == r["e"] == d and r["w"] == (d <= 2)
        assert r["s"] == pytest.approx(1 - d / max(len(r["a"]), len(r["b"])) if r["a"] or r["b"] else 1)


def test_osa_distance_of_long_words(spark):
    """Around the number of characters that fit the bit vectors, and beyond, where rows are folded."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abح") for _ in range(n))
    pairs = [(word(n), word(m)) for n in (1, 2, 30, 61, 62, 63, 64, 70) for m in (1, 33, 61, 62, 63, 65, 90)]
    for n in (62, 63, 80):
        w = word(n)
        pairs += [(w, w), (w, w[1] + w[0] + w[2:]), (w, w[:-2] + w[-1] + w[-2]), (w, w[:30] + w[31:])]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.osa_distance("a", "b").alias("d")).collect()
    assert [(r["a"], r["b"]) for r in rows if r["d"] != osa(r["a"], r["b"])] == []
    assert spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string").select(T.osa_distance("a", "b").alias("d")).collect() == [(None,), (None,)]


def test_deletions_meet_within_the_distance(spark):
    pairs = [("chiken", "chicken"), ("hcicken", "chicken"), ("abcdef", "badcef"), ("حليبن", "حليب")]
    for r in spark.createDataFrame(pairs, "a string, b string").select(F.arrays_overlap(T.deletions("a", 2), T.deletions("b", 2)).alias("m")).collect():
        assert r["m"]


def test_signature_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(["b", "a"], ["x"]), (["a", "b"], []), ([], ["x"]), ([], [])], "en array<string>, ar array<string>")
    got = [r["s"] for r in df.select(T.result_signature("en", "ar").alias("s")).collect()]
    assert got[0] == got[1] and len(set(got)) == 3 and all(len(s) == 16 for s in got)


def test_mentions_by_word_and_by_prefix(spark):
    df = spark.createDataFrame([("pas", "basata spaghetti pasta", True), ("pa", "pasta", False), ("milk", "whole milk", True), ("milk", "", False)], "q string, t string, want boolean")
    assert all(r["m"] == r["want"] for r in df.select(T.mentions(T.raw_tokens("q"), T.raw_tokens("t")).alias("m"), "want").collect())


def test_isolates(spark):
    assert one(spark, "x", T.isolate) == "\u2068x\u2069"
    assert one(spark, "\u2068x\u2069", T.strip_isolates) == "x"


def test_line_breaks(spark):
    assert one(spark, "a\r\n b \n\n\x0bc\u2028d\x1ce", T.split_lines) == ["a", "b", "c", "d", "e"]
