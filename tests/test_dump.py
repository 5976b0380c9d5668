import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from queryvitals.sources import dump, sample


def parsed(text, tables=None):
    return list(dump.rows(iter(text.splitlines(keepends=True)), tables))


@pytest.mark.parametrize(
    ("values", "row"),
    [
        ("(1,NULL,'NULL',null)", ["1", None, "NULL", None]),
        (r"('it\'s','a\nb','t\tx','\\','\%','\q')", ["it's", "a\nb", "t\tx", "\\", "\\%", "q"]),
        ("('a,b','(c)',';')", ["a,b", "(c)", ";"]),
        ("( 7 , 'x' )", ["7", "x"]),
        ("('','')", ["", ""]),
    ],
)
def test_values(values, row):
    assert parsed(f"INSERT INTO `t` VALUES {values};\n") == [("t", row)]


def test_statements_span_lines_and_may_lack_an_end():
    text = "-- x\nINSERT INTO `t` VALUES (1,'a\nINSERT INTO b; c'),\n(2,'d');\nCREATE TABLE z;\nINSERT INTO `u` VALUES (3)"
    assert parsed(text) == [("t", ["1", "a\nINSERT INTO b; c"]), ("t", ["2", "d"]), ("u", ["3"])]
    assert parsed(text, {"u"}) == [("u", ["3"])]


def test_read_dump(spark, tmp_path):
    path = tmp_path / "d.sql"
    path.write_text("INSERT INTO `a` VALUES (1,'é'),(2,NULL);\nINSERT INTO `b` VALUES (9);\n", encoding="utf-8")
    got = sorted((r["table"], r["cols"]) for r in dump.read_dump(spark, str(path), ["a"]).collect())
    assert got == [("a", ["1", "é"]), ("a", ["2", None])]
    assert sorted((r["table"], r["cols"]) for r in dump.read_dump(spark, f"file://{tmp_path}").collect())[-1] == ("b", ["9"])
    with pytest.raises(FileNotFoundError):
        dump.read_dump(spark, str(tmp_path / "missing.sql"))


#: Quotes, escapes, semicolons and statement heads in values that go over lines, blank lines, and a last statement without an end.
NASTY = r"""-- dump; with 'one quote
INSERT INTO `a` VALUES (1,'x;
INSERT INTO `b` VALUES (9);
'),(2,'it\'s
;\\'),
(3,NULL);
CREATE TABLE `c` (x int); -- ' odd
INSERT INTO `b` VALUES (4,'é
ü

''
;'),(5,')(,');

INSERT INTO `a`
VALUES
(6,
'y')
;
INSERT INTO `a` VALUES (7,'\
');INSERT INTO `a` VALUES (8);
insert into `a` VALUES (9);
INSERT INTO `b` VALUES (10,'\\\''),(11,'no end"""


def by_ranges(lines, cuts):
    """The rows of lines cut into ranges, as the tasks find them."""
    parts = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True)]
    found, pieces = [], {}
    for place, state, owner in dump.beginnings([(i, dump.transitions(p)) for i, p in enumerate(parts)]):
        for kind, held in dump.pieces(parts[place], state):
            if kind == "whole":
                found += dump.rows(iter(held), None)
            else:
                pieces.setdefault(owner if kind == "head" else place, []).append("".join(held))
    for held in pieces.values():
        found += dump.rows(iter("".join(held).splitlines(keepends=True)), None)
    return sorted(found, key=repr)


def test_ranges_cut_anywhere_give_the_same_rows():
    lines = NASTY.splitlines(keepends=True)
    want = sorted(parsed(NASTY), key=repr)
    assert len(want) == 9
    for i in range(len(lines) + 1):
        for j in range(i, len(lines) + 1):
            assert by_ranges(lines, [i, j]) == want
    assert by_ranges(lines, list(range(1, len(lines)))) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["INSERT INTO `t` VALUES (1,'", "a", "'", ";", "\\", "\n", "),(2,", "NULL", ");", "''", "\r\n"]), max_size=40), st.data())
def test_any_text_cut_anywhere(parts, data):
    lines = "".join(parts).replace("\r\n", "\n").splitlines(keepends=True)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(lines)), max_size=4)))
    assert by_ranges(lines, cuts) == sorted(dump.rows(iter(lines), None), key=repr)


@pytest.mark.parametrize("size", [16, 37, 90, 250])
def test_one_file_is_read_in_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    text = NASTY + "');\n" + "".join(f"INSERT INTO `c` VALUES ({i},'{rng.choice(['a;', chr(10), 'é', 'it' + chr(92) + chr(39) + 's', ''])}');\n" for i in range(60)) + "\r\nINSERT INTO `c` VALUES ('x\ry');\rINSERT INTO `c` VALUES (61);\r\n"
    (tmp_path / "d.sql").write_text(text, encoding="utf-8", newline="")
    with open(tmp_path / "d.sql", encoding="utf-8", newline="") as lines:
        want = sorted(dump.rows(lines, None), key=repr)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = dump.read_dump(spark, str(tmp_path / "d.sql"))
        assert read.rdd.getNumPartitions() >= len(text.encode()) // size
        assert sorted(((r["table"], r["cols"]) for r in read.collect()), key=repr) == want
        assert {r["table"] for r in dump.read_dump(spark, str(tmp_path / "d.sql"), ["c"]).collect()} == {"c"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_long_line_is_scanned_once():
    import time

    line = "INSERT INTO `t` VALUES " + ",".join(["(1,'a','b')"] * 100_000) + ";\n"
    began = time.perf_counter()
    assert dump.transitions([line])[0] == (0, False)
    assert time.perf_counter() - began < 5


def test_sample_is_seeded_and_parses():
    text = sample.generate(days=2)
    assert text == sample.generate(days=2) != sample.generate(days=2, seed=8)
    rows = parsed(text)
    assert sum(t == "catalog_product" for t, _ in rows) == 240
    with pytest.raises(ValueError):
        sample.generate(days=1)
