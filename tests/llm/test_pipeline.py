import re
from collections import Counter

import corpus_pipeline as P
from tests.llm import fixtures as X
from tests.llm.test_exact import brute_hits, brute_near
from tests.llm.test_models import brute_mix

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = []
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        kept.append((name, before, docs.collect()))
        docs = spark.createDataFrame(kept[-1][2], docs.schema)
        if name != "shard":
            assert docs.columns == names
    rows = {name: (before, after) for name, before, after in kept}
    before, after = rows["near_duplicates"]
    want = {c for _, _, c in brute_near([(r["doc_id"], r["text"]) for r in before], size=5)}
    assert {r["doc_id"] for r in after} == want
    before, after = rows["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {r[0] for r in brute_hits([(r["doc_id"], r["text"]) for r in before], items) if r[2]}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - hits
    before, after = rows["mix"]
    copies = brute_mix([(r["doc_id"], r["source"], r["text"]) for r in before])
    assert Counter(r["doc_id"] for r in after) == {r["doc_id"]: n for r, n in zip(before, copies, strict=True) if n}
    before, after = rows["shard"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)


def test_stages_take_every_awkward_row(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = X.frame(spark)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0
    none = X.empty(spark)
    for _, stage in P.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0


CLASHING = {"size": 777, "source_size": -1, "target": "t", "copies": 888, "_copy": 5, "a.b": "dot", "row": "r", "id": "i", "lang_pred": "xx", "score": -2.5, "others": None, "items": [1], "m": {"k": 1}, "key space": 1, "shard": 99}
CLASHING_SCHEMA = "doc_id bigint, text string, lang string, source string, size int, source_size int, target string, copies int, _copy int, `a.b` string, row string, id string, lang_pred string, score double, others string, items array<int>, m map<string,int>, `key space` int, shard int"


def test_every_column_keeps_its_name_type_and_value(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(r[0], r[1], r[2] or "en", r[3]) for r in X.documents() if r[0] is not None]
    docs = spark.createDataFrame([(*t, *CLASHING.values()) for t in texts], CLASHING_SCHEMA)
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        made = stage(spark, docs, str(tmp_path))
        if name != "shard":
            assert [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in docs.schema]
        rows = made.collect()
        assert rows
        for r in rows:
            own = {k: v for k, v in r.asDict().items() if k not in ("shard", "slot")}
            assert own == {k: v for k, v in before[r["doc_id"]].items() if k != "shard"}
            assert name == "shard" or r["shard"] == 99
        docs = spark.createDataFrame(rows, made.schema)


def test_language_stage_rejects_only_what_has_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    gone = docs.select("doc_id", "text").exceptAll(P.language_stage(spark, docs, SF).select("doc_id", "text")).collect()
    assert not [r for r in gone if re.search(r"[a-z]{3}", r["text"])]
