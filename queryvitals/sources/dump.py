"""mysqldump files as a table: rows (table, cols), every value text or null.

Statements span lines, and whether a semicolon ends one depends on the quotes before it, back to the file's beginning. Still
every file is read in ranges by as many tasks as Spark's text reader makes. A range is scanned from each of the three
states in which it may begin (outside a statement, inside one, inside one and in quotes), which gives a function from
state to state; composing these in the order of the ranges tells where each one really begins. Then the ranges are
parsed side by side. A statement belongs to the range where it starts: one that ends in a later range is put together from the
pieces, which are shuffled by owner. What the driver broadcasts is one small row for each range that it has planned.

Statements of tables that are not asked for are passed over without being parsed. Parsing follows one published grammar:
bare NULL is null, quoted values are text with backslash escapes, other values are trimmed text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryvitals.schemas import DATABASE, SOURCES

# What a backslash and a letter stand for; of any other letter, the letter itself.
ESCAPES = {"0": "\0", "'": "'", '"': '"', "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "\\": "\\", "%": "\\%", "_": "\\_"}

_HEAD = re.compile(r"INSERT INTO [`\"]?(\w+)[`\"]?[^(]*?VALUES\s*", re.IGNORECASE)
_ESCAPE = re.compile(r"\\(.)|''", re.DOTALL)
_INSIDE = re.compile(r"(?:[^'\\]|\\.)*", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.|'')*')|([(),])|([^'(),]+))", re.DOTALL)


def statements(lines: Iterator[str]) -> Iterator[str]:
    """INSERT statements, joined over lines up to a semicolon outside quotes; a last one without it counts."""
    held: list[str] = []
    open_quote = False
    for line in lines:
        if not held and not line.startswith("INSERT INTO "):
            continue
        held.append(line)
        open_quote, ended = _scan(line, open_quote)
        if ended:
            yield "".join(held)
            held, open_quote = [], False
    if held:
        yield "".join(held)


def _scan(line: str, open_quote: bool) -> tuple[bool, bool]:
    """Whether a quote is open after the line, and whether a statement ends in it."""
    at, stop = 0, -1
    while at < len(line):
        if open_quote:
            m = _INSIDE.match(line, at)
            at = m.end()
            if at >= len(line) or line[at] != "'":
                return True, False
            open_quote = False
            at += 1
        else:
            quote = line.find("'", at)
            if stop < at:  # the one found last lies behind
                stop = line.find(";", at) % (len(line) + 1)
            if stop < len(line) and (quote < 0 or stop < quote):
                return False, True
            if quote < 0:
                return False, False
            open_quote = True
            at = quote + 1
    return open_quote, False


def _unquoted(text: str) -> str:
    return _ESCAPE.sub(lambda m: "'" if m.group(1) is None else ESCAPES.get(m.group(1), m.group(1)), text)


def values(body: str) -> Iterator[list[str | None]]:
    """Rows of a VALUES list."""
    row: list[str | None] = []
    quoted: str | None = None
    bare = ""
    depth = 0
    for m in _TOKEN.finditer(body):
        literal, mark, other = m.groups()
        if literal is not None:
            if depth:
                quoted = (quoted or "") + _unquoted(literal[1:-1])
        elif mark == "(":
            depth += 1
            if depth == 1:
                row, quoted, bare = [], None, ""
            else:
                bare += mark
        elif mark in (")", ","):
            if depth > 1:
                bare += mark
                depth -= mark == ")"
                continue
            if depth == 1:
                plain = bare.strip()
                row.append(quoted if quoted is not None else None if plain.upper() == "NULL" else plain)
                quoted, bare = None, ""
                if mark == ")":
                    depth = 0
                    yield row
        elif depth:
            bare += other


def rows(lines: Iterator[str], tables: set[str] | None) -> Iterator[tuple[str, list[str | None]]]:
    for statement in statements(lines):
        head = _HEAD.match(statement)
        if head and (tables is None or head.group(1) in tables):
            for row in values(statement[head.end() :]):
                yield head.group(1), row


#: States between two lines: outside a statement, inside one, inside one and in quotes.
_OUTSIDE, _INSIDE_STATEMENT, _QUOTED = range(3)


def _after(state: int, line: str) -> int:
    if state == _OUTSIDE and not line.startswith("INSERT INTO "):
        return _OUTSIDE
    open_quote, ended = _scan(line, state == _QUOTED)
    return _OUTSIDE if ended else _QUOTED if open_quote else _INSIDE_STATEMENT


def transitions(lines: Iterable[str]) -> list[tuple[int, bool]]:
    """For each state before the lines: the state after them, and whether the statement that is open then began in them.
    Runs that meet go on as one."""
    runs = [(s, False) for s in range(3)]
    for line in lines:
        step = {s: _after(s, line) for s in {s for s, _ in runs}}
        runs = [(step[s], step[s] != _OUTSIDE and (own or s == _OUTSIDE)) for s, own in runs]
    return runs


def beginnings(ranges: list[tuple[int, list[tuple[int, bool]]]]) -> list[tuple[int, int, int | None]]:
    """(range, state before it, range where the statement that is open then began) of one file's ranges, in order."""
    state, owner, out = _OUTSIDE, None, []
    for place, runs in sorted(ranges):
        out.append((place, state, owner))
        state, own = runs[state]
        owner = None if state == _OUTSIDE else place if own else owner
    return out


def pieces(lines: Iterable[str], state: int) -> Iterator[tuple[str, list[str]]]:
    """("head", lines) of a statement that began before, ("whole", lines) of each that begins and ends here, and
    ("tail", lines) of one that does not end here."""
    held: list[str] = []
    kind = "head" if state != _OUTSIDE else "whole"
    for line in lines:
        before, state = state, _after(state, line)
        if before == state == _OUTSIDE and not line.startswith("INSERT INTO "):
            continue
        held.append(line)
        if state == _OUTSIDE:
            yield kind, held
            held, kind = [], "whole"
    if held:
        yield ("head" if kind == "head" else "tail"), held


_BREAK = re.compile(r"[^\r\n]*(?:\r\n?|\n)|[^\r\n]+")


def _lines(values: Iterable[bytes]) -> Iterator[str]:
    """Text lines with their ends; a carriage return ends one, too."""
    for value in values:
        text = value.decode("utf-8", "replace") + "\n"
        if "\r" in text:
            yield from _BREAK.findall(text)
        else:
            yield text


def _by_range(batches) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """The lines of each range of a task: the other columns' values, and the lines, which must be read before going on."""
    from itertools import groupby

    def each():
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            yield from zip(zip(*columns[:-1], strict=True), columns[-1], strict=True)

    for key, group in groupby(each(), key=lambda x: x[0]):
        yield key, (value for _, value in group)


#: Places of the rows of a range's last statement, if that ends in a later range, start here.
_TAIL = 1 << 40
_SCHEMA = "table string, cols array<string>, path string, start bigint, nth bigint"


def _batches(found: Iterator[tuple], most: int = 1 << 22):
    """Rows (table, cols, path, start, nth) as Arrow batches of about ``most`` characters."""
    import pyarrow as pa

    kinds = [pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64()]
    names = ["table", "cols", "path", "start", "nth"]
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
    for row in found:
        held.append(row)
        size += 64 + sum(len(x or "") for x in row[1])
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_dump(spark: SparkSession, path: str, tables: list[str] | None = None) -> DataFrame:
    """Rows of a dump, with their place in it: a file, a pattern or a folder (of ``*.sql`` files, on the local file system), in any store that
    Spark reads. A missing path is a FileNotFoundError. ``spark.sql.files.maxPartitionBytes`` sets the ranges' size."""
    import pyarrow as pa

    wanted = set(tables) if tables else None
    reader = spark.read.option("lineSep", "\n")
    if os.path.isdir(path.removeprefix("file:")):
        reader = reader.option("pathGlobFilter", "*.sql")
    try:
        text = reader.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    text = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))

    def scan(batches):
        for (file, start), lines in _by_range(batches):
            runs = transitions(_lines(lines))
            yield pa.RecordBatch.from_pydict({"path": [file], "start": [start], "after": [[s for s, _ in runs]], "own": [[o for _, o in runs]]})

    def compose(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = beginnings([(r["start"], list(zip(r["after"], r["own"], strict=True))) for r in rows])
        start, state, owner = zip(*found, strict=True)
        return pa.table({"path": [rows[0]["path"]] * len(rows), "start": pa.array(start, pa.int64()), "state": pa.array(state, pa.int32()), "owner": pa.array(owner, pa.int64())})

    ranges = text.mapInArrow(scan, "path string, start bigint, after array<bigint>, own array<boolean>")
    ranges = ranges.groupBy("path").applyInArrow(compose, "path string, start bigint, state int, owner bigint")
    # One row for each range that the driver has planned; the lines keep their order.
    known = text.join(F.broadcast(ranges), ["path", "start"]).select("path", "start", "state", "owner", "line")

    def whole(batches):
        def found():
            for (file, start, state, _), lines in _by_range(batches):
                nth = 0
                for kind, held in pieces(_lines(lines), state):
                    if kind == "whole":
                        for table, row in rows(iter(held), wanted):
                            yield table, row, file, start, nth
                            nth += 1

        yield from _batches(found())

    def cut(batches, most: int = 1 << 20):
        for (file, start, state, owner), lines in _by_range(batches):
            for kind, held in pieces(_lines(lines), state):
                if kind == "whole":
                    continue
                piece = "".join(held)
                parts = [piece[i : i + most] for i in range(0, len(piece), most)]
                n = len(parts)
                yield pa.RecordBatch.from_pydict({"path": [file] * n, "owner": pa.array([owner if kind == "head" else start] * n, pa.int64()), "start": pa.array([start] * n, pa.int64()), "part": pa.array(range(n), pa.int32()), "piece": parts})

    def together(table: pa.Table) -> pa.Table:
        text = "".join(table.sort_by([("start", "ascending"), ("part", "ascending")]).column("piece").to_pylist())
        file, start = table.column("path")[0].as_py(), table.column("owner")[0].as_py()
        found = [(t, r, file, start, _TAIL + i) for i, (t, r) in enumerate(rows(iter(_BREAK.findall(text)), wanted))]
        kept = list(_batches(iter(found), 1 << 62))
        return pa.Table.from_batches(kept) if kept else pa.table({"table": pa.array([], pa.string()), "cols": pa.array([], pa.list_(pa.string())), "path": pa.array([], pa.string()), "start": pa.array([], pa.int64()), "nth": pa.array([], pa.int64())})

    across = known.mapInArrow(cut, "path string, owner bigint, start bigint, part int, piece string").groupBy("path", "owner").applyInArrow(together, _SCHEMA)
    found = known.mapInArrow(whole, _SCHEMA).unionByName(across)
    return found.select("table", "cols", F.struct("path", "start", "nth").alias("place"))


def read_database(spark: SparkSession, url: str, properties: dict | None = None, tables: list[str] | None = None, partitions: int = 8) -> DataFrame:
    """The rows of a live database, shaped as those of its dump: columns that nobody reads are null, and are not asked for.

    Every table is read in ranges of its key that hold about as many rows each, whatever the gaps in the keys: the keys
    alone are read first, for their quantiles."""
    parts = []
    for table in tables or list(SOURCES):
        columns = DATABASE[table]
        used = {i: columns[i] for i in {0, *SOURCES[table].values()}}
        key = columns[0]
        source = lambda only, predicates=None, table=table: _jdbc(spark, url, table, properties or {}, only, predicates)
        bounds = quantiles(source([key]), key, partitions)
        read = source(list(used.values()), key_ranges(key, bounds))
        # A label of the database may come back in another case.
        named = {c.lower(): c for c in read.columns}
        cols = F.array(*[F.col(f"`{named[used[i].lower()]}`").cast("string") if i in used else F.lit(None).cast("string") for i in range(len(columns))])
        place = F.struct(F.lit("").alias("path"), F.col(f"`{named[key.lower()]}`").cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("nth"))
        parts.append(read.select(F.lit(table).alias("table"), cols.alias("cols"), place.alias("place")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _jdbc(spark: SparkSession, url: str, table: str, properties: dict, columns: list[str], predicates: list[str] | None) -> DataFrame:
    asked = f"(SELECT {', '.join(columns)} FROM {table}) t"
    return spark.read.jdbc(url, asked, predicates=predicates, properties=properties) if predicates else spark.read.jdbc(url, asked, properties=properties)


def quantiles(keys: DataFrame, key: str, parts: int) -> list[int]:
    """The keys that cut a table into ``parts`` ranges of about as many rows."""
    name = next(c for c in keys.columns if c.lower() == key.lower())
    found = keys.select(F.col(f"`{name}`").cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.01 / parts)
    return sorted({int(x) for x in found})


def key_ranges(key: str, bounds: list[int]) -> list[str]:
    """Conditions of which every row meets exactly one; a row without a key meets the first."""
    if not bounds:
        return [f"{key} IS NULL OR {key} IS NOT NULL"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [f"{key} < {bounds[0]} OR {key} IS NULL", *inner, f"{key} >= {bounds[-1]}"]
