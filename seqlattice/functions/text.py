"""Scalar text functions as column expressions; NFKC alone runs in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.batches import let_go

#: Unicode white space, the separators that Java's \s leaves out, and zero-width marks.
SPACES = r"[\p{Z}\x{09}-\x{0d}\x{1c}-\x{1f}\x{85}\x{200b}\x{feff}]"
#: What the normal form drops besides.  Braces and single curly quotes stay.
MARKS = "、。，．,.・:：;；!！?？「」『』（）()[]［］【】〔〕〈〉《》“”\"'`´"


@F.pandas_udf(StringType())
def composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    try:
        for s in batches:
            yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))
    finally:  # the worker waits for further tasks
        let_go()


def nfkc(c: Column) -> Column:
    """ASCII stays as it is and isn't sent to Python."""
    return F.coalesce(composed(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def without_marks(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, MARKS, ""), SPACES, "")


def normalized(c: Column, compose: bool = True) -> Column:
    """Compatibility-composed text without white space, zero-width marks and punctuation; null gives ''."""
    c = F.coalesce(c, F.lit(""))
    return without_marks(nfkc(c) if compose else c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def int_or_null(c: Column) -> Column:
    """A whole number or null; unlike int() of Python it takes no underscores and ASCII digits only."""
    return F.trim(c).try_cast("int")


def tags(c: Column) -> Column:
    """Delimited tags in order, duplicates kept; null gives none."""
    parts = F.split(F.translate(F.coalesce(c, F.lit("")), "、，,|/", ";;;;;"), ";")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def tag_set(*columns: Column) -> Column:
    out = F.array_distinct(tags(columns[0]))
    for c in columns[1:]:
        out = F.array_union(out, tags(c))
    return out


def first_by_priority(t: Column, priority: list[str], default: str) -> Column:
    """The first name in priority that t has, else t's first tag, else the default."""
    wanted = F.filter(F.array(*map(F.lit, priority)), lambda x: F.array_contains(t, x))
    return F.coalesce(F.try_element_at(wanted, F.lit(1)), F.try_element_at(t, F.lit(1)), F.lit(default))


def jaccard(a: Column, b: Column) -> Column:
    """0 if both sets are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def input_text(mode: str, original: Column, kana: Column, theme: Column, season: Column, notes: Column) -> Column:
    """The text to embed in one of the modes original, kana, original_kana, original_tags, all: normal forms of original and kana, the others trimmed; empty parts are left out."""
    original, kana = normalized(original), normalized(kana)

    def part(c: Column, prefix: str = "") -> Column:
        c = blank_to_null(c)
        return F.concat(F.lit(prefix), c) if prefix else c

    parts = {
        "original": [part(original)], "kana": [part(kana)], "original_kana": [part(original), part(kana)],
        "original_tags": [part(original), part(theme, "theme: "), part(season, "season: ")],
        "all": [part(original), part(kana), part(theme, "theme: "), part(season, "season: "), part(notes, "notes: ")]}[mode]
    return F.concat_ws("\n", *parts)


def without_links(c: Column) -> Column:
    """Markdown links by their labels, images by their alternative texts."""
    return F.trim(F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1"))


#: Layouts by the names they are shown with.
LAYOUT_NAMES = {
    "row_major": "Row", "row_serpentine": "Row serpentine", "column_major": "Column", "column_serpentine": "Column serpentine",
    "diagonal_nw_se": "Diagonal NW-SE", "diagonal_ne_sw": "Diagonal NE-SW", "spiral": "Spiral"}


def layout_name(c: Column) -> Column:
    """A layout's display name; an unknown one is shown as it is."""
    names = F.create_map(*(F.lit(x) for kv in LAYOUT_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, c), c)


def xml_escaped(c: Column) -> Column:
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#x27")):
        c = F.replace(c, F.lit(mark), F.lit(f"&{name};"))
    return c


_DIGITS = dict(zip("一二三四五六七八九", range(1, 10)))


def kanji_number(c: Column) -> Column:
    """1 to 100 in kanji numerals; anything else is null."""
    digit = F.create_map(*(F.lit(x) for kv in _DIGITS.items() for x in kv))
    tens, ones = F.substring_index(c, "十", 1), F.substring_index(c, "十", -1)
    one = lambda x, empty: F.when(x == "", empty).otherwise(F.try_element_at(digit, x))
    return F.when(c == "百", 100).when(F.instr(c, "十") > 0, one(tens, 1) * 10 + one(ones, 0)).otherwise(F.try_element_at(digit, c)).cast("int")


def plain_wiki(c: Column) -> Column:
    """Line breaks for <br>, links by their labels, no emphasis, tags or hard spaces."""
    for pattern, put in ((r"(?i)<br\s*/?>", "\n"), ("'''", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"<[^>]*>", ""), ("&nbsp;", " ")):
        c = F.regexp_replace(c, pattern, put)
    return F.trim(c)


def cell_payload(c: Column) -> Column:
    """A table cell's content: behind leading | and !, and behind its attributes, if there are any."""
    inner = F.regexp_replace(c, r"^[|!]+", "")
    return F.when(F.instr(inner, "|") > 0, F.regexp_replace(inner, r"^[^|]*\|", "")).otherwise(inner)


def cell_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def verse_cell(c: Column) -> Column:
    """struct(original, kana, upper, lower): a verse before its reading in wide brackets."""
    before, inside = F.substring_index(c, "（", 1), F.when(F.instr(c, "（") > 0, F.regexp_replace(F.regexp_replace(c, r"(?s)^[^（]*（", ""), r"(?s)）[^）]*$", "")).otherwise("")
    lines = cell_lines(before)
    pick = lambda k: F.coalesce(F.try_element_at(lines, F.lit(k)), F.lit(""))
    return F.struct(F.array_join(lines, " ").alias("original"), F.array_join(cell_lines(inside), " ").alias("kana"), pick(1).alias("upper"), pick(2).alias("lower"))


def author_cell(c: Column) -> Column:
    lines = cell_lines(c)
    at = lambda k: F.coalesce(F.try_element_at(lines, F.lit(k)), F.lit(""))
    return F.struct(at(1).alias("name"), F.translate(at(2), "（）", "").alias("kana"))


#: Anthologies that a source may begin with, written as one string to be cut.
ANTHOLOGIES = "古今集 後撰集 拾遺集 後拾遺集 金葉集 詞花集 千載集 新古今集 新勅撰集 続後撰集".split()


def source_cell(c: Column, names: list[str] = ANTHOLOGIES) -> Column:
    """struct(anthology, book, number): a known anthology in front, digits behind."""
    flat = F.regexp_replace(c, r"[\s　]", "")
    prefix = F.when(F.regexp_extract(flat, r"^(.+?)(\d+)$", 2) != "", F.regexp_extract(flat, r"^(.+?)(\d+)$", 1)).otherwise(flat)
    found = F.lit("")
    for name in reversed(names):
        found = F.when(F.startswith(prefix, F.lit(name)), name).otherwise(found)
    return F.struct(found.alias("anthology"), F.substr(prefix, F.length(found) + 1).alias("book"), F.regexp_extract(flat, r"^(.+?)(\d+)$", 2).alias("number"))


def inferred(c: Column, names: list[str]) -> Column:
    """The names that occur in the text, joined by ;."""
    return F.array_join(F.filter(F.array(*map(F.lit, names)), lambda x: F.contains(c, x)), ";")


def squeezed(c: Column) -> Column:
    """White space runs to one space; none before a wide opening bracket."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r" +（", "（"))
