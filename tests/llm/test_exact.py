"""Operators with a brute-force result, over every awkward case at once."""

import glob
import hashlib
import os
import re
import tempfile
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import fixtures as X

from queryvitals.llm import decontaminate, kernel, lines, minhash, quality_rules, substring
from queryvitals.llm.components import components
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n.,1", max_size=30)), max_size=6))
def test_kernel_words_are_the_regex_words(texts):
    for mask, pattern, low in ((kernel.NON_SPACE, WORD, False), (kernel.ALNUM, ALNUM, True)):
        w = kernel.Words(pa.array(texts, pa.string()), mask, lower=low)
        got = [[w.data[w.start[i] : w.end[i]].tobytes().decode() for i in range(w.first[r], w.first[r + 1])] for r in range(len(texts))]
        folded = [lower(t) if low else t or "" for t in texts]
        assert [[lower(x) if low else x for x in row] for row in got] == [pattern.findall(t) for t in folded]
        known = {}
        for r, t in enumerate(texts):
            for i, word in enumerate(pattern.findall(lower(t) if low else t or "")):
                assert known.setdefault(word, w.hash[w.first[r] + i]) == w.hash[w.first[r] + i]
        assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("period", range(1, 15))
def test_difference_cover(period):
    cover = kernel.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def brute_substring(rows, window=20):
    docs = [(i, (2**63 - 1 if r[0] is None else r[0]), (r[1] or "")) for i, r in enumerate(rows)]
    first = {}
    words = {i: t.encode().split() for i, _, t in docs}
    for i, k, _ in docs:
        for p in range(len(words[i]) - window + 1):
            g = tuple(words[i][p : p + window])
            first[g] = min(first.get(g, (k, p)), (k, p))
    out = []
    for i, k, _ in docs:
        gone = set()
        for p in range(len(words[i]) - window + 1):
            if first[tuple(words[i][p : p + window])] < (k, p):
                gone |= set(range(p, p + window))
        kept = b" ".join(w for n, w in enumerate(words[i]) if n not in gone)
        out.append((rows[i][0], len(words[i]), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("period", [1, 7, 13])
def test_substring(spark, period):
    rows = X.documents()
    got = substring.remove_repeats(X.frame(spark, rows), period=period).collect()
    found = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got]
    assert sorted(found, key=repr) == brute_substring(rows)
    assert substring.remove_repeats(X.empty(spark)).count() == 0


def shingle_set(text, size):
    words = lower(text).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_near(rows, size=4, percent=80):
    sets = [shingle_set(r[1], size) for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            k = len(sets[i] & sets[j])
            if same or (k and 100 * k >= percent * len(sets[i] | sets[j])):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in groups[find(i)] if rows[j][0] is not None]
        out.append((r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0]))
    return sorted(out, key=repr)


def near_rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_near_duplicates(spark):
    rows = X.documents()
    assert near_rows(minhash.near_duplicates(X.frame(spark, rows), size=4)) == brute_near(rows)
    assert minhash.near_duplicates(X.empty(spark)).count() == 0


def shuffle_files(spark):
    local = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
    return {f for d in local.split(",") for f in glob.glob(f"{d}/blockmgr-*/*/shuffle_*")}


def test_checkpoint_leaves_no_shuffle_files(spark):
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("a.b")).count()
    want = sorted(map(tuple, grouped.collect()))
    for setting in ("false", "true"):
        spark.conf.set(kernel.FREE_SHUFFLES, setting)
        try:
            before = shuffle_files(spark)
            made = kernel.checkpoint(spark.range(1000).groupBy((F.col("id") % 7).alias("a.b")).count())
            assert spark.conf.get(kernel.FREE_SHUFFLES) == setting
        finally:
            spark.conf.unset(kernel.FREE_SHUFFLES)
        deadline = time.time() + 20
        while shuffle_files(spark) - before and time.time() < deadline:
            time.sleep(0.2)
        assert not shuffle_files(spark) - before
        assert sorted(map(tuple, made.collect())) == want and made.columns == ["a.b", "count"]
    # The caller's own frame may still run again.
    kernel.checkpoint(grouped)
    assert sorted(map(tuple, grouped.collect())) == want


def test_near_duplicates_levels_have_partitions_by_rows(spark, monkeypatch):
    """A small table in many partitions is read by few tasks at each level of branching."""
    monkeypatch.setattr(kernel, "PACKED_ROWS", 1000)
    assert kernel.packed(spark.range(0, 2500, 1, 40), 2500).rdd.getNumPartitions() == 3
    assert kernel.packed(spark.range(0, 0, 1, 40), 0).rdd.getNumPartitions() == 1
    assert kernel.packed(spark.range(0, 10, 1, 2), 5000).rdd.getNumPartitions() == 2
    seen, inner = [], minhash._unsettled
    monkeypatch.setattr(minhash, "_unsettled", lambda nodes, *a, **b: seen.append((nodes.rdd.getNumPartitions(), nodes.count())) or inner(nodes, *a, **b))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [r for r in X.documents() if r[0] is not None]
        assert near_rows(minhash.near_duplicates(X.frame(spark, rows), size=4)) == brute_near(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen and all(n <= max(1, -(-rows // 1000)) for n, rows in seen)


def test_near_duplicates_one_of_each_group_stays(spark):
    rows = X.documents()
    found = minhash.near_duplicates(X.frame(spark, rows), size=4).where("n_shingles > 0 AND keeper").select("doc_id", "component_id", "th").distinct().collect()
    groups = [r["component_id"] for r in found]
    assert len(groups) == len(set(groups))


def test_near_duplicates_in_a_crowd(spark):
    """A large group of similar texts that are mostly no near-duplicates: it must go through branching and blocks."""
    import random

    rng = random.Random(5)
    base = X.prose(rng, 60).split(" ")
    rows = []
    for i in range(240):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(60)] = f"w{rng.randrange(10_000)}"
        rows.append((i, " ".join(words), None, None, 0, 0, 0, None, None, None, None))
    want = brute_near(rows)
    for spread, block in ((1, 32), (8, 256), (1_000, 256)):
        assert near_rows(minhash.near_duplicates(X.frame(spark, rows), size=4, spread=spread, block=block)) == want


def test_near_duplicates_branched_to_the_full_depth(spark):
    """Nothing goes to blocks before the last level: brute force must still agree."""
    import random

    rng = random.Random(6)
    base = [X.prose(rng, 70).split(" ") for _ in range(4)]
    rows = []
    for i in range(160):
        words = list(base[i % 4]) if i % 2 else X.prose(rng, 70).split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(70)] = f"w{rng.randrange(10_000)}"
        rows.append((i, " ".join(words), None, None, 0, 0, 0, None, None, None, None))
    assert near_rows(minhash.near_duplicates(X.frame(spark, rows), size=4, spread=0, few_left=0)) == brute_near(rows)


def test_near_duplicates_branching_keeps_links(spark):
    """Pairs at 0.8 that branch to the full depth stay together as often as independent tokens would keep them."""
    rng, pairs, trees, depth = np.random.default_rng(3), 1_500, 2, 5
    mins = rng.integers(1, 2**62, (2, pairs, minhash.MINS))
    mins[1] = np.where(rng.random(mins[0].shape) < 0.8, mins[0], mins[1])
    rows = [(side * pairs + i, 1, 0, 0, i, mins[side, i].tolist()) for side in range(2) for i in range(pairs)]
    classes = spark.createDataFrame(rows, "s bigint, n bigint, x1 bigint, x2 bigint, label bigint, mins array<bigint>").cache()
    nodes = classes.select("s", "n", "x1", "x2", "label", F.posexplode(F.slice("mins", 1, trees)).alias("tree", "m")).withColumn("used", F.lit(0).cast("bigint"))
    nodes = nodes.withColumn("path", F.xxhash64("tree", "m")).drop("tree", "m")
    for level in range(depth):
        nodes = minhash._branched(nodes, classes, level, 3, trees)
        nodes = nodes.join(nodes.groupBy("label", "path").agg(F.count_distinct("s").alias("k")).where("k = 2"), ["label", "path"], "left_semi")
        nodes = spark.createDataFrame(nodes.toArrow())
        assert nodes.where(F.bit_count("used") != level + 1).isEmpty()
    lost = 1 - nodes.select("label").distinct().count() / pairs
    # Independent tokens lose 0.2071**2 = 0.0429 of them; a standard deviation of the sample is 0.0052.
    assert 0.027 < lost < 0.059


def test_components_by_one_task_and_by_joins(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    one, many = (sorted(map(tuple, components(df, one_task=n).collect())) for n in (1_000_000, 0))
    assert one == many and dict(one)[1040] == 1000


def test_full_set_links_match_products():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(40)]
    sets += [s[: max(1, int(len(s) * 0.9))] for s in sets[:20]]
    label = np.arange(len(sets))
    a, b = minhash._linked(np.concatenate(sets), np.array([len(s) for s in sets]), label, 80)
    top = list(label)
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                x, y = top[i], top[j]
                top = [y if t == x else t for t in top]
    got = list(label)
    for i, j in zip(a, b, strict=True):
        x, y = got[i], got[j]
        got = [y if t == x else t for t in got]
    groups = lambda t: {frozenset(i for i, v in enumerate(t) if v == u) for u in set(t)}
    assert groups(got) == groups(top)


def brute_hits(rows, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            wins[tuple(w[i : i + m])].add(str(item))
    out = []
    for r in rows:
        w = ALNUM.findall(lower(r[1]))
        hit, found = set(), set()
        for m in {len(k) for k in wins}:
            for i in range(len(w) - m + 1):
                g = tuple(w[i : i + m])
                if g in wins:
                    hit |= set(range(i, i + m))
                    found |= wins[g]
        out.append((r[0], len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [4 << 20, 200])
def test_decontaminate(spark, block_bytes):
    rows = X.documents()
    items = [(1, " ".join((rows[0][1] or "").split(" ")[:15])), (2, rows[20][1]), (2, rows[20][1]), (3, None), (4, ""), (5, "one two"), (7, "Not there at all in any of these documents of ours")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for found in (
        decontaminate.index_and_search(X.frame(spark, rows), bench, block_bytes=block_bytes),
        decontaminate.search(decontaminate.build_index(X.frame(spark, rows)), bench, block_bytes=block_bytes),
    ):
        got = [(r["id"], r["n_words"], sum(s["to"] - s["from"] for s in r["spans"]), sorted(r["items"])) for r in found.collect()]
        assert sorted(got, key=repr) == brute_hits(rows, items)
    assert decontaminate.decontaminate(X.empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(X.frame(spark, rows), bench.limit(0)).where(F.size("items") > 0).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "a x x x x x x b c d"), (3, "d c b a")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "a b c d")], "item_id bigint, text string")
    found = decontaminate.search(decontaminate.build_index(docs), items, slop=1).collect()
    assert {r["id"] for r in found if r["near"] == ["9"]} == {1, 3}


def brute_rules(text):
    words = WORD.findall(text or "")
    ls = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    rep = {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(rep))


def test_quality_rules(spark):
    rows = X.documents()
    docs = X.frame(spark, rows)
    ratios = quality_rules.log_ratios(docs)
    got = quality_rules.judged(docs, ratios).collect()
    want = sorted(((r[0], *brute_rules(r[1])) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=repr) == want
    import zlib

    for r in got:
        codes = [zlib.crc32(w.encode()) for w in WORD.findall(r["text"] or "")]
        grams = [c % quality_rules.BUCKETS for c in codes] + [(a * quality_rules.PAIR + b) % quality_rules.BUCKETS for a, b in zip(codes, codes[1:], strict=False)]
        total = sum(ratios[g] for g in grams)
        assert total == r["llr_sum"]
        assert r["kept"] == (not r["base_failed"] and total >= -150_000 * len(grams))
    none = quality_rules.log_ratios(X.empty(spark))
    assert set(none) == {0} and quality_rules.judged(X.empty(spark), none).count() == 0


def test_quality_ratios_are_those_of_the_two_multinomials(spark):
    import math
    import zlib

    rows = X.documents()
    got = quality_rules.log_ratios(X.frame(spark, rows))
    raw, target = [1] * quality_rules.BUCKETS, [1] * quality_rules.BUCKETS
    for r in rows:
        text = r[1] or ""
        n, chars, symbols, lines_again, _ = brute_rules(text)
        good = n >= 10 and not symbols and not lines_again and 10 * sum("A" <= c <= "Z" for c in text) <= 3 * chars
        codes = [zlib.crc32(w.encode()) for w in WORD.findall(text)]
        for g in [c % quality_rules.BUCKETS for c in codes] + [(a * quality_rules.PAIR + b) % quality_rules.BUCKETS for a, b in zip(codes, codes[1:], strict=False)]:
            raw[g] += 1
            target[g] += good
    n, m = sum(raw), sum(target)
    assert got == [math.floor(math.log(t * n / (r * m)) * 1_000_000 + 0.5) for r, t in zip(raw, target, strict=True)]


def test_quality_windows_are_compared_by_their_words(spark):
    """plumless and buckeroo have one crc32; columns that bear the operator's own names travel or give way."""
    texts = ["a b plumless c d x1 x2 x3 x4 x5 x6 a b buckeroo c d", "a b plumless c d x1 x2 x3 x4 x5 x6 a b plumless c d", "q q q q q q q", None]
    docs = spark.createDataFrame([(i, t, "v", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, __words string, n_words int")
    got = sorted(quality_rules.judged(docs, quality_rules.log_ratios(docs)).collect(), key=lambda r: r["doc_id"])
    assert [r["n_repeat_words"] for r in got] == [0, 10, 7, 0] and [r["n_words"] for r in got] == [16, 16, 7, 0]
    assert {r["__words"] for r in got} == {"v"}


def edit(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=40)), max_size=6), st.integers(0, 3))
def test_edit_distance(pairs, threshold):
    pairs += [(a, a[:5] + b[:1] + a[6:]) for a, b in pairs]
    got = lines.edit_distances([a for a, _ in pairs], [b for _, b in pairs], threshold)
    assert got.tolist() == [min(edit(a, b), threshold + 1) for a, b in pairs]


def test_lines(spark):
    import random

    rng = random.Random(9)
    rows = X.documents()
    long = [X.prose(rng, 12) for _ in range(12)]
    texts = []
    for i in range(40):
        picked = [rng.choice(long) for _ in range(4)]
        picked = [p if rng.random() < 0.5 else p.replace("a", "e", rng.randint(0, 3)) for p in picked]
        texts.append("\n".join([*picked, "", "short line"]))
    rows = rows + [(1000 + i, t, None, None, 0, 0, 0, None, None, None, None) for i, t in enumerate(texts)]
    occ = []
    for n, r in enumerate(rows):
        k = 2**63 - 1 if r[0] is None else r[0]
        number = 0
        for line in (r[1] or "").split("\n"):
            if line:
                occ.append((n, k, number, line.encode()))
                number += 1
    first = {}
    for _, k, no, line in occ:
        first[line] = min(first.get(line, (k, no)), (k, no))
    heads = sorted(first)
    late = {b for a in heads for b in heads if first[a] < first[b] and min(len(a), len(b)) >= 48 and abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2}
    want = defaultdict(lambda: [0, 0])
    for n, k, no, line in occ:
        want[n][0] += 1
        want[n][1] += line in late or (k, no) != first[line]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"]) for r in lines.remove_lines(X.frame(spark, rows)).collect()), key=repr)
    assert got == sorted(((r[0], *want[n]) for n, r in enumerate(rows)), key=repr)
    assert lines.remove_lines(X.empty(spark)).count() == 0


def test_short_lines(spark):
    """One edit counts from ``short_bytes`` on, two from ``min_bytes`` on, also for pairs around either length."""
    import random

    rng = random.Random(12)
    texts = ["Thwhesnd esator whshing and hewh.", "Thwhesnd, esator whshing and hewh."]
    for n in [*range(13, 19), 30, *range(45, 51)]:
        base = "".join(rng.choice("abcdefgh ") for _ in range(n))
        for _ in range(6):
            line = list(base)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(line))
                line[at : at + 1] = rng.choice([[], ["z"], ["z", line[at]]])
            texts.append("".join(line))
    rng.shuffle(texts)
    rows = [(i, t, None, None, 0, 0, 0, None, None, None, None) for i, t in enumerate(texts)]

    def late(i, j):
        n = min(len(texts[i]), len(texts[j]))
        return edit(texts[i], texts[j]) <= (2 if n >= 48 else 1 if n >= 16 else 0)

    want = [(i, any(late(i, j) for j in range(i))) for i in range(len(texts))]
    for segment_pairs in (lines.SEGMENT_PAIRS, 4):
        got = sorted((r["doc_id"], r["n_removed"] == 1) for r in lines.remove_lines(X.frame(spark, rows), short_bytes=16, segment_pairs=segment_pairs).collect())
        assert got == want


def test_lines_of_one_template(spark, monkeypatch):
    """A segment that all lines share makes no pairs; blocks find every line that an earlier one is near to."""
    import random

    rng = random.Random(31)
    fillings = [f"{i:03d}" for i in range(150)] + [f"{rng.randrange(10**9):09d}" for _ in range(150)]
    texts = [f"Licensed to customer {x} under the terms that follow below" for x in dict.fromkeys(fillings)]
    rng.shuffle(texts)
    rows = [(i, t, None, None, 0, 0, 0, None, None, None, None) for i, t in enumerate(texts)]
    want = [any(abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2 for a in texts[:i]) for i, b in enumerate(texts)]
    assert True in want and False in want
    monkeypatch.setattr(lines, "BLOCK_LINES", 64)
    docs = X.frame(spark, rows)
    pairs = lines.candidate_pairs(docs.select(F.col("doc_id").alias("k"), F.lit(0).cast("bigint").alias("th"), "text"), 2, 48, 4, segment_pairs=200)
    assert pairs.count() < 20 * len(texts)
    got = sorted((r["doc_id"], r["n_removed"] == 1) for r in lines.remove_lines(docs, segment_pairs=200).collect())
    assert [g[1] for g in got] == want


def test_many_rows_without_id_cost_what_ids_cost(spark):
    """Places are keyed by (id, text): rows without an id, and equal rows, are judged as brute force judges them."""
    rng = __import__("random").Random(17)
    shared = X.prose(rng, 45)
    texts = [X.prose(rng, 30) + "\n" + (shared if i % 3 else X.prose(rng, 40)) for i in range(60)]
    rows = [(None, t, None, None, 0, 0, 0, None, None, None, None) for t in texts + texts[:20]]
    got = substring.remove_repeats(X.frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got), key=repr) == brute_substring(rows)
    plan = substring.remove_repeats(X.frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and ", th" in plan


def test_decontaminate_in_blocks_of_items_needs_no_row_key(spark):
    """Documents without id, or with the same one, keep their own hits however many blocks the items fill."""
    item = X.documents()[20][1].split(" ")[:12]
    clean = ["other"] * len(item)
    rows = [(i, " ".join(t), None, None, 0, 0, 0, None, None, None, None) for i in (None, 7) for t in (item, clean, item, clean)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "never found " * 20), (3, " ".join(item[1:]))], "item_id bigint, text string")
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), X.SCHEMA)
    for size in (4 << 20, 50):
        found = decontaminate.index_and_search(docs, bench, block_bytes=size).collect()
        got = [(r["id"], r["n_words"], sum(s["to"] - s["from"] for s in r["spans"]), sorted(r["items"])) for r in found]
        assert sorted(got, key=repr) == brute_hits(rows, [(r["item_id"], r["text"]) for r in bench.collect()])
