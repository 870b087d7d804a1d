"""Benchmark decontamination by winnowing.

Texts become word sequences.  From every window of consecutive k-gram hashes
the smallest is kept as a fingerprint; two texts that share a span of
GUARANTEE words or more therefore share a fingerprint inside it.  Document
fingerprints are joined with those of the benchmark, and each hit is extended
to the windows of GUARANTEE words around it, which are compared word by word
with the benchmark's, so that hash collisions can't count.  Equal windows of
the benchmark are one, with all the items that have it, so that a passage that
very many items share costs a document no more than another.

The benchmark is read in blocks of at most BLOCK_CHARS characters (a single
longer item makes a block of its own); the driver and each executor hold one
block at a time, and it is sent out, used and given up before the next is
read.  One block needs no shuffle; with more, the documents are read once a
block and the hit ranges of a document are merged.

Nulls: a null document or item text has no words; a null doc_id passes
through; an item without id marks words as hit and isn't listed.  Repeated
documents give repeated results, repeated item ids count once.  Empty tables:
no documents, no rows; no items, nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, lean, mix64, numbered, pick, small_batches, written

GRAM, WINDOW = 5, 4
GUARANTEE = GRAM + WINDOW - 1
BLOCK_CHARS = 8_000_000

#: A-Z in lower case; bytes outside words become spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def gram_hashes(ids: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash for each k consecutive word numbers."""
    n = len(ids) - k + 1
    out = np.full(max(n, 0), salt, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E6C63D0876A9A35) + ids[i : i + n].astype(np.uint64) + np.uint64(1))
    return out


def fingerprints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that winnowing keeps; 0 stands for a word that can't match, and windows with one are left out."""
    n = len(ids) - GUARANTEE + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n <= 0:
        return none
    start = np.flatnonzero(whole_windows(ids))
    if not len(start):
        return none
    hashes = gram_hashes(ids, GRAM)
    seen = hashes[start[:, None] + np.arange(WINDOW)]
    at = np.unique(start + seen.argmin(axis=1))
    return at, hashes[at]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which are sorted; unlike isin this costs nothing for each known one."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


class Block:
    """Some benchmark items, ready for lookup."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.names: list[str | None] = []
        self.vocab: dict[bytes, int] = {}
        rows: list[np.ndarray] = []
        for name, text in items:
            words = words_of(text.encode()) if text else []
            if words:
                self.names.append(name)
                rows.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64))
        long = [(i, r) for i, r in enumerate(rows) if len(r) >= GUARANTEE]
        gap = np.zeros(1, np.int64)
        self.text = np.concatenate([gap, *(x for _, r in long for x in (r, gap))])
        self.owner = np.concatenate([gap, *(np.full(len(r) + 1, i) for i, r in long)]) if long else gap
        self.hashes = np.unique(fingerprints(self.text)[1])
        self._windows()
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for i, r in enumerate(rows):
            if len(r) < GUARANTEE:
                self.short.setdefault(len(r), {}).setdefault(tuple(r.tolist()), []).append(i)
        self.short_hashes = {n: np.unique(np.concatenate([gram_hashes(np.array(k), n) for k in d])) for n, d in self.short.items()}

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie inside an occurrence of an item's window, and the items."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))
        hit, found = np.zeros(len(ids), bool), set()
        self._long(ids, hit, found)
        for n, known in self.short.items():
            if len(ids) < n:
                continue
            for i in np.flatnonzero(among(gram_hashes(ids, n), self.short_hashes[n])):
                if owners := known.get(tuple(ids[i : i + n].tolist())):
                    hit[i : i + n] = True
                    found.update(owners)
        return hit, found

    def _windows(self) -> None:
        """The distinct windows of the long items: their hashes in order, a place of each in the text, and the number of its set of owners."""
        starts = np.flatnonzero(whole_windows(self.text))
        self.salt = 0
        while True:
            hashes = gram_hashes(self.text, GUARANTEE, self.salt)[starts]
            by = np.argsort(hashes, kind="stable")
            same = np.flatnonzero(hashes[by[1:]] == hashes[by[:-1]])
            inner = np.arange(GUARANTEE)
            if all((self.text[starts[by[k + 1]][:, None] + inner] == self.text[starts[by[k]][:, None] + inner]).all() for k in np.array_split(same, 1 + len(same) // 10_000)):
                break
            self.salt += 1  # two windows with one hash
        self.window, first = np.unique(hashes[by], return_index=True)
        self.place = starts[by][first]
        number, owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by)))), self.owner[starts[by]]
        pairs = np.unique(np.stack([number, owner]), axis=1) if len(number) else np.zeros((2, 0), np.int64)
        edges = np.searchsorted(pairs[0], np.arange(len(first) + 1))
        sets: dict[tuple[int, ...], int] = {}
        self.owners = np.array([sets.setdefault(tuple(pairs[1, a:b].tolist()), len(sets)) for a, b in zip(edges, edges[1:])], np.int64)
        self.sets = list(sets)

    def _long(self, ids: np.ndarray, hit: np.ndarray, found: set[int]) -> None:
        at, hashes = fingerprints(ids)
        at = at[among(hashes, self.hashes)]
        if not len(at):
            return
        near = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
        near = near[(near >= 0) & (near <= len(ids) - GUARANTEE)]
        near = near[whole_windows(ids)[near]]
        hashes = gram_hashes(ids, GUARANTEE, self.salt)[near]
        k = np.minimum(np.searchsorted(self.window, hashes), len(self.window) - 1)
        inner = np.arange(GUARANTEE)
        same = self.window[k] == hashes
        near, k = near[same], k[same]
        same = (ids[near[:, None] + inner] == self.text[self.place[k][:, None] + inner]).all(axis=1)
        hit[near[same][:, None] + inner] = True
        for number in np.unique(self.owners[k[same]]).tolist():
            found.update(self.sets[number])


def whole_windows(ids: np.ndarray) -> np.ndarray:
    """Whether the GUARANTEE words from each place on are all known."""
    blank = np.concatenate([[0], np.cumsum(ids == 0)])
    return blank[GUARANTEE:] == blank[:-GUARANTEE] if len(ids) >= GUARANTEE else np.zeros(0, bool)


Items = list[tuple[str | None, str | None]]


def blocks_of(benchmark: DataFrame) -> Iterator[Items]:
    """The items (item_id, text), block by block as they are asked for."""
    held, size = [], 0
    for r in benchmark.toLocalIterator():
        n = len(r.text or "")
        if held and size + n > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield held


def one_or_more(benchmark: DataFrame) -> tuple[Items | None, Iterable[Items]]:
    """The only block, or None and all of them."""
    blocks = blocks_of(pick(benchmark, item_id="string", text="string"))
    first, second = next(blocks, []), next(blocks, None)
    return (first, ()) if second is None else (None, chain([first, second], blocks))


def ranges_of(hit: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2).tolist()


def summary(n_words: int, n_hit: int, names: list[str]) -> tuple:
    names = sorted(set(names))
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2


OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
OUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
OUT_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def named(block: Block, found: set[int]) -> list[str]:
    return [x for i in found if (x := block.names[i]) is not None]


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What of each document occurs in the benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = pick(docs, doc_id="long", text="string")
    only, blocks = one_or_more(benchmark)
    if only is not None:
        block = docs.sparkSession.sparkContext.broadcast(Block(only))

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for text in byte_texts(batch.column(1)):
                    words = words_of(text)
                    hit, found = block.value.hits(words)
                    rows.append(summary(len(words), int(hit.sum()), named(block.value, found)))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, OUT_TYPES))], OUT_NAMES)

        return docs.mapInArrow(run, OUT)

    # Repeated rows, which look the same, are told apart by a number of their own.
    docs = written(docs.withColumn("row", F.expr("uuid()")))

    @lean
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, names in zip(byte_texts(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3))):
                n = len(words_of(text))
                rows.append(summary(n, int(marked(n, spans).sum()), names or []))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, OUT_TYPES))], OUT_NAMES)

    return docs.join(merged(docs, blocks), "row", "left").select("doc_id", "text", "spans", "names").mapInArrow(fold, OUT)


def marked(n: int, spans: list[list[int]] | None) -> np.ndarray:
    hit = np.zeros(n, bool)
    for a, b in spans or ():
        hit[a:b] = True
    return hit


def merged(docs: DataFrame, blocks: Iterable[Items]) -> DataFrame:
    """row, spans (of words), names for the documents (row, text) that are hit; one block is used after the other."""
    every = None
    for items in blocks:
        block = docs.sparkSession.sparkContext.broadcast(Block(items))

        @lean
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for row, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                    hit, found = block.value.hits(words_of(text))
                    if hit.any():
                        rows.append((row, ranges_of(hit), named(block.value, found)))
                cols = list(zip(*rows)) if rows else [()] * 3
                kinds = [pa.string(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["row", "spans", "names"])

        part = written(docs.select("row", "text").mapInArrow(run, "row string, spans array<array<long>>, names array<string>"))
        block.destroy()
        every = part if every is None else every.unionByName(part)
    return every.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("names")).alias("names"))


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    return rewritten(docs, benchmark, lambda text, hit, names, cut: (len(set(names)) < 2, text, False))


def without(text: bytes, hit: np.ndarray) -> bytes:
    """A text without its hit words and what stands between neighbouring ones."""
    at = [m.span() for m in _WORD.finditer(text.translate(WORD_BYTES))]
    out, free = [], 0
    for a, b in ranges_of(hit):
        out.append(text[free : at[a][0]])
        free = at[b - 1][1]
    return b"".join([*out, text[free:]])


def unleaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs in which nothing is hit, with all their columns.

    Contaminated rows (two items or more) go, as from cleaned().  From the
    others the hit words are cut, again where the cut brings together words
    that are hit, and n_chars, where there is one, is counted anew; a row of
    which no word is left goes.
    """

    def rid(text: bytes, hit: np.ndarray, names: list[str], cut: bool) -> tuple[bool, bytes, bool]:
        if hit.all() or (not cut and len(set(names)) >= 2):
            return False, text, False
        return True, without(text, hit), True

    return rewritten(docs, benchmark, rid)


#: From a text that is hit, its hit words, the items' names and whether it has been cut: whether it stays, its text, whether that was cut just now.
Rule = Callable[[bytes, np.ndarray, list[str], bool], tuple[bool, bytes, bool]]


def rewritten(docs: DataFrame, benchmark: DataFrame, rule: Rule) -> DataFrame:
    """docs after a rule has been applied to each text that is hit, and again to those that it cut."""
    small_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def put(batch: pa.RecordBatch, rows: list[tuple[bool, bytes | None, bool]], width: int) -> list[pa.Array]:
        """The batch's first columns with the rows' texts; a row tells whether it stays, its text, whether that is new."""
        cols = list(batch.columns[:width])
        if any(r[0] and r[2] for r in rows):
            texts = [None if r[1] is None else r[1].decode() for r in rows]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if size is not None:
                counts = zip(batch.column(size).to_pylist(), texts, rows)
                cols[size] = pa.array([len(t) if r[2] else n for n, t, r in counts], batch.schema.field(size).type)
        return cols

    only, blocks = one_or_more(benchmark)
    if only is not None:
        block = docs.sparkSession.sparkContext.broadcast(Block(only))

        def through(text: bytes | None) -> tuple[bool, bytes | None, bool]:
            stays, cut, again = True, False, True
            while stays and again:
                hit, found = block.value.hits(words_of(text))
                if not hit.any():
                    break
                stays, text, again = rule(text, hit, named(block.value, found), cut)
                cut |= again
            return stays, text, cut

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [through(text) for text in byte_texts(batch.column(at))]
                yield pa.RecordBatch.from_arrays(put(batch, rows, len(names)), batch.schema.names).filter(pa.array([r[0] for r in rows], pa.bool_()))

        return docs.mapInArrow(run, schema)

    # With several blocks, rounds over the texts that the round before has cut.
    plain, _ = numbered(docs)
    width = len(names)
    inner = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(schema)) + ", cut boolean, again boolean, row string"
    rows = written(plain.withColumns({"cut": F.lit(False), "again": F.lit(True), "row": F.expr("uuid()")}))
    done = None
    while True:
        hits = merged(rows.select("row", F.col(f"_{at}").cast("string").alias("text")), blocks)
        joined = rows.join(hits, "row", "left").select(*(f"_{i}" for i in range(width)), "cut", "again", "row", "spans", "names")

        @lean
        def one_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                cuts, spans, items = (batch.column(width + k).to_pylist() for k in (0, 3, 4))
                for text, cut, span, name in zip(byte_texts(batch.column(at)), cuts, spans, items):
                    out.append(rule(text, marked(len(words_of(text)), span), name or [], cut) if span else (True, text, False))
                cols = [*put(batch, out, width), pa.array([c or r[2] for c, r in zip(cuts, out)], pa.bool_()), pa.array([r[2] for r in out], pa.bool_()), batch.column(width + 2)]
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names[: width + 3]).filter(pa.array([r[0] for r in out], pa.bool_()))

        after = written(joined.mapInArrow(one_round, inner))
        settled = after.where("not again").select(*(f"_{i}" for i in range(width)))
        done = settled if done is None else done.unionByName(settled)
        rows = after.where("again")
        if not rows.limit(1).count():
            return done.toDF(*names)
        blocks = one_or_more(benchmark)[1]


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(8, len(w)) AS n FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
found AS (SELECT doc_id, spots.n, i, item_id FROM spots JOIN grams ON spots.n = grams.n AND spots.g = grams.g),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, (SELECT unnest(range(0, 8)) AS k) WHERE k < n GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM words w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN named ON w.doc_id = named.doc_id
"""
