"""Text folding and string similarity as native columns.

``normalize`` stays in the JVM: compatibility composition and full case folding, which no built-in function gives, are
methods of the Unicode library that Spark brings along, called through ``java_method``.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that are dropped, letters that fold together, digits that become ASCII.
DROPPED = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0640]"
FOLDED_FROM = "آأإٱىةؤئکی٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
FOLDED_TO = "اااايهويكي01234567890123456789"
# Article and preposition prefixes, in the order they are tried, and the shortest stem left.
PREFIXES = ["وبال", "فبال", "وال", "بال", "كال", "فال", "لل", "ال"]
STEM_LEFT = 3
FIRST_ISOLATE, LAST_ISOLATE = "\u2068", "\u2069"
LINE_BREAK = "\\R|[\\x1c-\\x1e]"
ARABIC = "[\u0600-\u06ff\u0750-\u077f]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Dropped and folded letters all lie in this block, so texts without a letter of it are left alone.
_ARABIC_BLOCK = "[\u0600-\u06ff]"
_DROPPED_LETTERS = "".join(c for c in map(chr, range(0x600, 0x700)) if re.match(DROPPED, c))


def _once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _ranges(inside) -> str:
    """The code points, in ranges of a regular expression's class."""
    out: list[list[int]] = []
    for x in filter(inside, range(0x80, 0x110000)):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


#: What is no letter, digit or underscore, within ASCII and at all. The runtime's classes may be older than the Unicode data at
#: hand, whose ranges are looked at only for what these classes do not know.
_ASCII_GAP = "[\\x00-/:-@\\[-^`{-\\x7f]+"
_GAP = "[[^ 0-9A-Za-z_\\p{L}\\p{N}]&&[^" + _ranges(lambda x: chr(x).isalnum()) + "]]+"


def compose(text: Column | str) -> Column:
    """Compatibility composition (NFKC), by the Unicode library that ships with Spark."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(_col(text), F.lit("")), F.lit(True))


def casefold(text: Column | str) -> Column:
    """Full case folding, which does not look at neighbours (``lower`` knows a final sigma)."""
    return F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.coalesce(_col(text), F.lit("")), F.lit(True))


def fold_letters(text: Column) -> Column:
    """Arabic marks dropped, letter forms and digits unified."""
    return F.when(text.rlike(_ARABIC_BLOCK), F.translate(text, FOLDED_FROM + _DROPPED_LETTERS, FOLDED_TO)).otherwise(text)


def normalize(text: Column | str) -> Column:
    """Folded text: compatibility forms composed, marks dropped, letter forms and digits unified, case folded, punctuation
    to blanks; null is ''. Linear in the text.

    Spark takes calls of Java methods for nondeterministic, so it neither merges two equal ones nor moves filters past
    them: fold once, where a row is loaded, and filter before. One-element arrays hold what is used twice."""
    return _once(casefold(_once(compose(text), fold_letters)), _words_only)


def _words_only(text: Column) -> Column:
    t = F.regexp_replace(text, _ASCII_GAP, " ")
    t = F.when(t.rlike("[^\\x00-\\x7f]"), F.regexp_replace(t, _GAP, " ")).otherwise(t)
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def fold_string(text: str | None) -> str:
    """The same folding for one string on the driver."""
    t = unicodedata.normalize("NFKC", text or "")
    t = re.sub(DROPPED, "", t).translate(str.maketrans(FOLDED_FROM, FOLDED_TO)).casefold()
    return " ".join(re.sub(r"[^\w\s]", " ", t).split())


def raw_tokens(norm: Column | str) -> Column:
    return F.filter(F.split(_col(norm), " "), lambda t: F.length(t) > 0)


def tokenize(norm: Column | str, min_length: int = 2) -> Column:
    """Words of already folded text, the short ones left out."""
    return F.filter(F.split(_col(norm), " "), lambda t: F.length(t) >= min_length)


def light_stem(term: Column | str) -> Column:
    """The term without its first prefix that leaves three characters; backtracking tries the prefixes in order."""
    return F.regexp_replace(_col(term), f"^(?:{'|'.join(PREFIXES)})(?=.{{{STEM_LEFT}}})", "")


def term_variants(term: Column | str) -> Column:
    return F.array_distinct(F.array(_col(term), light_stem(term)))


def script_of(text: Column | str) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    arabic, latin, digits = t.rlike(ARABIC), t.rlike("[A-Za-z]"), t.rlike("[0-9]")
    return F.when(arabic & latin, "mixed").when(arabic, "arabic").when(latin, "latin").when(digits, "digits").otherwise("other")


def isolate(text: Column | str) -> Column:
    return F.concat(F.lit(FIRST_ISOLATE), _col(text), F.lit(LAST_ISOLATE))


def strip_isolates(text: Column | str) -> Column:
    return F.translate(_col(text), FIRST_ISOLATE + LAST_ISOLATE, "")


def split_lines(block: Column | str) -> Column:
    """Trimmed, non-blank lines of a block."""
    parts = F.transform(F.split(F.coalesce(_col(block), F.lit("")), LINE_BREAK), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x) > 0)


def result_signature(en: Column | str, ar: Column | str) -> Column:
    """16 hex digits that do not depend on the order of the titles; Arabic titles where there are no English ones."""
    used = F.when(F.size(_col(en)) > 0, _col(en)).otherwise(_col(ar))
    return F.substring(F.sha1(F.array_join(F.sort_array(F.coalesce(used, F.array().cast("array<string>"))), "\n")), 1, 16)


def is_prefix_of(short: Column | str, long: Column | str) -> Column:
    a, b = _col(short), _col(long)
    return (F.length(a) > 0) & (F.length(a) < F.length(b)) & F.startswith(b, a)


def _characters(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


#: Characters of the shorter string that the bit vectors hold: their sums must stay below the sign bit of a long.
OSA_BITS = 62


def osa_distance(a: Column | str, b: Column | str) -> Column:
    """Restricted Damerau-Levenshtein distance (neighbours may swap once).

    The shorter string's characters are bits of a long, and one step for each character of the other one updates the
    vertical differences of a whole column of the table, transpositions included. Where both strings have more than
    ``OSA_BITS`` characters, the table is folded row by row instead."""
    x, y = _col(a), _col(b)
    swap = F.length(x) > F.length(y)
    short, long_ = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    m = F.length(short)
    return F.when(m == 0, F.length(long_)).when(m <= OSA_BITS, _osa_by_bits(short, long_, m)).when(m > OSA_BITS, _osa_by_rows(short, long_))


def _osa_by_bits(short: Column, long_: Column, m: Column) -> Column:
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    bit = lambda i: F.call_function("shiftleft", one, i)
    # For each character of the longer string, the places where the shorter one has it.
    place = lambda c, s, d: F.struct(F.when(d == c, s["mask"].bitwiseOR(s["bit"])).otherwise(s["mask"]).alias("mask"), F.shiftleft(s["bit"], 1).alias("bit"))
    places = lambda c, t: F.aggregate(t["short"], F.struct(zero.alias("mask"), one.alias("bit")), lambda s, d: place(c, s, d), lambda s: s["mask"])
    masks = _once(F.struct(_characters(short).alias("short"), _characters(long_).alias("long")), lambda t: F.transform(t["long"], lambda c: places(c, t)))
    full = bit(m) - 1
    start = F.struct(full.alias("vp"), zero.alias("vn"), zero.alias("d"), zero.alias("pm"), m.alias("n"), full.alias("full"), bit(m - 1).alias("top"))

    def crossed(s, pm):
        """Which diagonal steps cost nothing, swaps included."""
        swapped = F.shiftleft(F.bitwise_not(s["d"]).bitwiseAND(pm), 1).bitwiseAND(s["pm"])
        d = (pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(pm).bitwiseOR(s["vn"]).bitwiseOR(swapped)
        return F.struct(s.alias("s"), d.bitwiseAND(s["full"]).alias("d"))

    def across(t):
        """Where the table rises and falls along the row."""
        s, d = t["s"], t["d"]
        rises = s["vn"].bitwiseOR(F.bitwise_not(d.bitwiseOR(s["vp"])).bitwiseAND(s["full"]))
        falls = d.bitwiseAND(s["vp"])
        n = s["n"] + F.when(rises.bitwiseAND(s["top"]) != 0, 1).when(falls.bitwiseAND(s["top"]) != 0, -1).otherwise(0)
        return F.struct(s["full"].alias("full"), s["top"].alias("top"), d.alias("d"), n.alias("n"), F.shiftleft(rises, 1).bitwiseOR(one).alias("rises"), F.shiftleft(falls, 1).alias("falls"))

    def down(t, pm):
        """Where it rises and falls along the next column."""
        full = t["full"]
        vp = t["falls"].bitwiseOR(F.bitwise_not(t["d"].bitwiseOR(t["rises"]))).bitwiseAND(full)
        return F.struct(vp.alias("vp"), t["rises"].bitwiseAND(t["d"]).alias("vn"), t["d"].alias("d"), pm.alias("pm"), t["n"].alias("n"), full.alias("full"), t["top"].alias("top"))

    return F.aggregate(masks, start, lambda s, pm: _once(_once(crossed(s, pm), across), lambda t: down(t, pm)), lambda s: s["n"])


def _osa_by_rows(short: Column, long_: Column) -> Column:
    x, y = _characters(short), _characters(long_)
    n = F.size(y)
    row0 = F.sequence(F.lit(0), n)
    start = F.struct(row0.alias("back"), row0.alias("last"), F.lit("").alias("seen"))

    def row(state, c):
        first = F.array(F.element_at(state["last"], 1) + 1)

        def cell(cur, j):
            same = F.element_at(y, j) == c
            best = F.least(F.element_at(cur, -1) + 1, F.element_at(state["last"], j + 1) + 1, F.element_at(state["last"], j) + F.when(same, 0).otherwise(1))
            swap = (j > 1) & (F.length(state["seen"]) > 0) & (F.try_element_at(y, F.greatest(j - 1, F.lit(1))) == c) & (F.element_at(y, j) == state["seen"])
            swapped = F.try_element_at(state["back"], F.greatest(j - 1, F.lit(1))) + 1
            return F.concat(cur, F.array(F.when(swap, F.least(best, swapped)).otherwise(best)))

        filled = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), first, cell)).otherwise(first)
        return F.struct(state["last"].alias("back"), filled.alias("last"), c.alias("seen"))

    return F.aggregate(x, start, row, lambda s: F.element_at(s["last"], -1))


def within_osa(a: Column | str, b: Column | str, most: int) -> Column:
    """Whether the distance is at most ``most``; the built-in bounded distance (never above twice it) filters first."""
    return (F.levenshtein(_col(a), _col(b), 2 * most) >= 0) & (osa_distance(a, b) <= most)


def similarity(a: Column | str, b: Column | str) -> Column:
    longest = F.greatest(F.length(_col(a)), F.length(_col(b)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - osa_distance(a, b) / longest)


def edit_budget(term: Column | str) -> Column:
    n = F.length(_col(term))
    return F.when(n <= 3, 0).when(n <= 6, 1).otherwise(2)


def mentions(terms: Column, title_tokens: Column, min_prefix: int = 3) -> Column:
    """Whether a folded title has any of the terms, or a word that starts with one of three characters or more."""
    return F.exists(terms, lambda t: F.exists(title_tokens, lambda k: (k == t) | ((F.length(t) >= min_prefix) & F.startswith(k, t))))


def needles(terms: Column, min_prefix: int = 3) -> Column:
    """What a folded title, with a blank before and behind it, contains if it mentions one of the terms (see ``mentions``)."""
    return F.transform(terms, lambda t: F.concat(F.lit(" "), t, F.when(F.length(t) < min_prefix, " ").otherwise("")))


def deletions(term: Column | str, most: int) -> Column:
    """The term and everything left of it after up to ``most`` deletions."""

    def one_less(words: Column) -> Column:
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, 1, i - 1), F.substr(w, i + 1)))
        return F.array_distinct(F.flatten(F.transform(words, cut)))

    out = layer = F.array(_col(term))
    for _ in range(most):
        layer = one_less(layer)
        out = F.array_union(out, layer)
    return out


def round_even(x: Column, digits: int) -> Column:
    """Half-even rounding, after what the order of addition leaves beyond nine digits is gone."""
    return F.bround(F.bround(x, 9), digits)
