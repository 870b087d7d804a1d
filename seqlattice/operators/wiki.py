"""Records of a wiki table: a marked line and the three lines after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

THEMES = "春 夏 秋 冬 恋 雑 羇旅 離別 哀傷 神祇 釈教".split()
SEASONS = THEMES[:4]


def records(lines: DataFrame) -> DataFrame:
    """Typed records of lines (line_no, line), by equi-joins on line numbers, so that no task needs all lines."""
    heads = lines.where(F.col("line").startswith("!style=") & F.contains("line", F.lit("<span id="))).select("line_no", text.plain_wiki(text.cell_payload(F.col("line"))).alias("number"))
    out = heads
    for k, name in enumerate(("verse", "author", "source"), 1):
        out = out.join(lines.select((F.col("line_no") - k).alias("line_no"), text.plain_wiki(text.cell_payload(F.col("line"))).alias(name)), "line_no")
    verse, author, source = text.verse_cell(F.col("verse")), text.author_cell(F.col("author")), text.source_cell(F.col("source"))
    out = out.select(text.kanji_number(F.col("number")).alias("id"), verse.alias("v"), author.alias("a"), source.alias("s"))
    return out.select(
        "id", F.col("a.name").alias("poet"), F.col("a.kana").alias("poet_kana"), F.col("v.original").alias("original"), F.col("v.kana").alias("kana"), F.col("v.upper").alias("upper"), F.col("v.lower").alias("lower"),
        "s.anthology", "s.book", "s.number", text.inferred(F.col("s.book"), THEMES).alias("theme"), text.inferred(F.col("s.book"), SEASONS).alias("season"))
