"""Quality rules as a short-circuit cascade.

Each rule rejects a document or lets it pass; a document is kept if no rule
rejects it, so the verdict doesn't depend on the order of the rules, only the
work does.  On a bounded sample the cost of each rule and the share that it
rejects are measured, and the rules then run by rejections per second: most
documents that go, go after the cheapest telling rule, and what later rules
need isn't computed for them.  A rule is timed on views in the state in which
the cascade finds them, so that what is measured anyway costs it nothing.

Rules see a lazy view of a document; what several rules need is computed once.
Nulls: a null text has no words and is rejected as too short; a null id passes
through.  Repeated rows give repeated results.  An empty table gives an empty
result.  Texts of any length are measured whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WHITE, byte_texts, lean, pick, small_batches

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))

#: Rows of the sample on which costs are measured; texts above SAMPLE_CHARS aren't drawn for it.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 200_000


class View:
    """A document, measured as far as asked."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, WHITE + CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words, 5)

    @cached_property
    def n_upper(self) -> int:
        return len(self.text.translate(None, NOT_UPPER))

    @cached_property
    def n_ascii_letters(self) -> int:
        return len(self.text.translate(None, NOT_LETTER))

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count(b"!")


def repeated_words(words: list[bytes], width: int) -> int:
    """How many words lie in windows of that width which the text has twice or more."""
    if len(words) < width + 1:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    code, top, n = ids, len(known), len(ids) - width + 1
    for k in range(1, width):
        if top * len(known) >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            top = len(values)
        code = code[:-1] * len(known) + ids[k:]
        top *= len(known)
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    if len(count) == n:
        return 0
    again = count[inverse] > 1
    step = np.zeros(len(ids) + 1, np.int64)
    step[:n] += again
    step[width : width + n] -= again
    return int((np.cumsum(step) > 0).sum())


Rule = Callable[[View], bool]

BASE_RULES: dict[str, Rule] = {
    "too_short": lambda v: v.n_words < 10,
    "repeated_windows": lambda v: 100 * v.n_repeat_words > 20 * v.n_words,
}

#: All in whole numbers, so that SQL gives the same.
RULES: dict[str, Rule] = {
    "symbols": lambda v: 10 * v.n_symbols > v.n_words,
    "shouting": lambda v: 10 * v.n_upper > 3 * v.n_ascii_letters,
    "exclamations": lambda v: 10 * v.n_shouts > 2 * v.n_words,
    "repeated_lines": lambda v: 10 * v.n_dup_lines > 5 * len(v.lines),
    "word_length": lambda v: v.word_chars < 2 * v.n_words or v.word_chars > 20 * v.n_words,
}


def by_yield(sample: list[bytes | None], rules: dict[str, Rule], ready: Callable[[View], object] = lambda view: None) -> list[str]:
    """The rules' names by rejections per second on the sample, the best first; ready measures what is there before any rule runs."""
    worth = {}
    for name, rule in rules.items():
        views = [View(text) for text in sample]
        for view in views:
            ready(view)
        began, gone = time.perf_counter(), 0
        for view in views:
            gone += rule(view)
        worth[name] = gone / (time.perf_counter() - began + 1e-9)
    return sorted(rules, key=lambda name: (-worth[name], name))


def cascade_order(docs: DataFrame, rules: dict[str, Rule], rows: int = SAMPLE_ROWS, ready: Callable[[View], object] = lambda view: None) -> list[str]:
    """Measured on at most `rows` rows, the first that come; a poor sample costs time, never changes a verdict."""
    few = docs.select("text").where(f"length(text) <= {SAMPLE_CHARS}").take(rows)
    return by_yield([r.text.encode() for r in few], rules, ready)


def verdict(view: View, order: list[str], rules: dict[str, Rule]) -> bool:
    return not any(rules[name](view) for name in order)


def measured(docs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """doc_id, what the base measures, base_failed, and kept: no base rule and no further rule rejects."""
    docs = pick(docs, doc_id="long", text="string")
    rules = RULES if rules is None else rules
    base = lambda v: (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words)
    order = cascade_order(docs, rules, ready=base)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in byte_texts(batch.column(1)):
                v = View(text)
                failed = any(rule(v) for rule in BASE_RULES.values())
                rows.append((*base(v), failed, not failed and verdict(v, order, rules)))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def filtered(docs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects; here base rules take part in the cascade."""
    small_batches(docs.sparkSession)
    rules = BASE_RULES | (RULES if rules is None else rules)
    order = cascade_order(pick(docs, text="string"), rules)
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [verdict(View(t), order, rules) for t in byte_texts(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)



ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i+4], ' ')) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
             length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 10 * n_upper > 3 * n_letters
            OR 10 * n_shouts > 2 * n_words OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m
"""
