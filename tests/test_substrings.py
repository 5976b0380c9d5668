"""Names by substring against a scan, for many needles at once."""

import random

from queryvitals.operators import substrings as S


def test_all_names_that_contain_each_needle(spark):
    rng = random.Random(2)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    names = [(i, rng.choice(["en", "ar"]), word("abcdح ", rng.randint(0, 14))) for i in range(400)] + [(900, "en", "gear gear"), (901, "en", ""), (902, "en", None), (903, "en", "😀gear")]
    needles = ["", "a", "ab", "abc", "gear", "ear g", "😀g", "zzz", "abz", "ح", *{word("abcdح ", rng.randint(1, 6)) for _ in range(80)}]
    rows = spark.createDataFrame(names, "product_id bigint, lang string, norm_name string")
    asked = spark.createDataFrame([(n,) for n in needles + needles[:5]], "needle string")
    index = S.postings(rows, ["product_id", "lang"])
    got = sorted((r["needle"], r["product_id"]) for r in S.containing(asked, index, rows, ["product_id", "lang"]).collect())
    assert got == sorted({(n, i) for n in needles for i, _, t in names if n and t and n in t})
    assert S.containing(asked, index, rows.limit(0), ["product_id", "lang"]).count() == 0


def test_stored_postings_are_pruned_by_gram(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS product_id", "'en' AS lang", "lower(hex(id * 7919)) AS norm_name")
    S.ordered(S.postings(rows, ["product_id", "lang"])).write.parquet(str(tmp_path / "g"))
    found = S.lookup(["abc"], spark.read.parquet(str(tmp_path / "g")), rows, ["product_id", "lang"])
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "EqualTo(gram,abc)" in plan or "In(gram, [abc])" in plan
    assert sorted(r["product_id"] for r in found.collect()) == [i for i in range(3000) if "abc" in f"{i * 7919:x}"]


def test_word_sequences():
    assert S.word_sequences("a bb c") == ["a bb c", "a bb", "bb c", "bb", "a", "c"]
