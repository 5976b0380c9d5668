"""Fill-in-the-middle against a direct version, over every awkward case at once."""

import hashlib
import re

import pytest
from tests.llm import fixtures as X

from pyspark.sql import functions as F
from queryvitals.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text, seed=1, plain=10, spm=20):
    text = text or ""
    found = UNIT.findall(text)
    n = len(found)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return doc_id, n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, m, z = "".join(found[:lo]), "".join(found[lo:hi]), "".join(found[hi:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return doc_id, n, "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


def rows_with_markers():
    rows = X.documents()
    odd = ["a<P>b", "<S>", "x <M> y", "<P", "<<S", "S>M>", "a" * 300, "1" * 300, "é" * 129, "\n" * 64, "ab" * 64 + "!", "😀a😀" * 90, "line sep\u0085\r\n", "<", ">" * 70]
    rows += [(500 + i, t, "en", "a", 0, 0, 0, None, None, None, None) for i, t in enumerate(odd)]
    rows += [(i, f"w{i} " * (i % 70), "en", "a", 0, 0, 0, None, None, None, None) for i in range(600, 760)]
    return rows + rows[5:9] * 3


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_transform(spark, piece):
    rows = rows_with_markers()
    made = fim.transform(X.frame(spark, rows), piece=piece).withColumn("again", fim.restore(F.col("output"), F.col("form"))).collect()
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made]
    assert sorted(got, key=repr) == sorted((brute(r[0], r[1]) for r in rows), key=repr)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert all(r["again"] == (r["text"] or "") for r in made)
    # Other columns travel along, under any name.
    assert sorted(((r["doc_id"], r["size"], r["k"], r["findings"]) for r in made), key=repr) == sorted(((r[0], r[5], r[7], r[10]) for r in rows), key=repr)


def test_shares_and_empty(spark):
    rows = [(i, "one two three", "en", "a", 0, 0, 0, None, None, None, None) for i in range(400)]
    every = fim.transform(X.frame(spark, rows), plain=0, spm=100)
    assert {r["form"] for r in every.collect()} == {"spm"}
    assert fim.transform(X.empty(spark)).count() == 0


def test_clashing_and_dotted_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "x", {"k": 1})], "doc_id bigint, text string, n int, `a.b` string, m map<string,int>")
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "text", "a.b", "m", "n", "form", "prefix_chars", "middle_chars", "output"]
    row = made.first()
    assert row["n"] == 5 and row["a.b"] == "x" and row["m"] == {"k": 1}
