"""Result overlap against every pair, with a product that a third of all queries find."""

import random
import re

import pytest

from queryvitals.operators import synonyms as Y


def brute(sets, min_shared=2, least=0.3):
    out = []
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n >= min_shared and n / len(sets[a] | sets[b]) >= least:
                out.append((a, b, n, n / len(sets[a] | sets[b])))
    return out


def found_sets(seed, queries=220):
    rng = random.Random(seed)
    sets = {}
    for i in range(queries):
        kind = rng.random()
        few = rng.sample(range(60), rng.randint(0, 4)) if kind < 0.5 else rng.sample(range(25), rng.randint(1, 9))
        sets[f"q{i:03d}"] = {p + 10 for p in few} | ({1} if rng.random() < 0.34 else set()) | ({2, 3} if rng.random() < 0.2 else set())
    return {q: s for q, s in sets.items() if s}


@pytest.mark.parametrize(("seed", "block", "least", "shared"), [(1, 4096, 0.3, 2), (2, 7, 0.3, 2), (3, 1, 0.5, 2), (4, 20, 0.3, 3), (5, 20, 0.1, 1), (6, 20, 1.0, 2)])
def test_every_pair_is_found(spark, seed, block, least, shared):
    sets = found_sets(seed)
    rows = spark.createDataFrame([(q, p) for q, s in sets.items() for p in s], "norm_query string, product_id bigint")
    got = Y.result_overlap(rows, shared, least, block).collect()
    want = brute(sets, shared, least)
    assert want
    assert sorted((r["source"], r["target"], r["shared"]) for r in got) == [(a, b, n) for a, b, n, _ in want]
    assert {(r["source"], r["target"]): r["overlap"] for r in got} == pytest.approx({(a, b): j for a, b, _, j in want}, abs=6e-4)


def test_a_product_of_many_queries_is_dealt_in_blocks(spark):
    sets = found_sets(7, 600)
    rows = spark.createDataFrame([(q, p) for q, s in sets.items() for p in s], "norm_query string, product_id bigint")
    made = Y.result_overlap(rows, block=16)
    plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
    assert re.search(r"product_id#\d+L?, _x#\d+L?, _y#\d+L?", plan) and "Cartesian" not in plan
    assert Y.result_overlap(rows.limit(0)).count() == 0
