"""Small documents that hold every awkward case, with columns that clash with the operators' own names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard int, k string, label string, __s string, findings string"

_rng = random.Random(3)
_VOCAB = ["".join(_rng.choice("bcdfglmnprst") + _rng.choice("aeiou") for _ in range(_rng.randint(1, 4))) for _ in range(400)]


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(_VOCAB) for _ in range(words))


def documents(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    texts = list(base)
    texts += [base[3], base[3], base[7]]  # exact copies
    for b in (base[0], base[5], base[9], base[11]):  # near copies
        words = b.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [base[12] + " " + passage, passage + " " + base[13], base[14] + "\n" + passage + "\n" + base[15]]
    texts += [None, "", " \t\n", "x", "#### $$$$ &&&&", "123 456", "é ü ß", "one two three", "Ünï cödé " * 30, passage[:50]]
    texts += ["same line of words that repeats again and again here\nsame line of words that repeats again and again here\nother"]
    texts += ['key token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff done"]
    texts.append(prose(rng, 30_000))  # a very long text
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(t or ""), 7, 3, "x", "y", "z", "w"))
    rows.append(rows[2])  # a repeated row
    rows.append((None, base[1], "en", "a", 1, 0, 0, None, None, None, None))  # no id
    rows.append((None, None, None, None, None, None, None, None, None, None, None))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
