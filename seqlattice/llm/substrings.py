"""Removal of repeated byte strings, in whole texts and across all documents.

A byte goes if a SPAN-byte string that covers it also starts earlier: in a
document with a smaller id, or earlier in the same document.

1. Texts are cut into runs of string starts by content-defined anchors
   (anchors.py); equal strings lie in runs that have the same anchor.
2. Blocks of texts, put in the order of their documents, become sequences of
   run symbols, one for each distinct context.  Their suffix array, made by
   linear grouping (suffix_array.py), gives for each run the longest sequence of
   runs from there that also begins earlier in the block: neighbours in the
   array have the longest common starts.  The block is then parsed from left to
   right; a sequence that has begun earlier goes as a whole, as one place, and
   only runs that are new to the block are shuffled, so that a string that very
   many documents share is at most one row a block.
3. Runs meet, sorted by anchor and context; of equal ones again all but the
   first go.  A task goes over an anchor's runs one by one and holds none.
4. What is left may match in part: different contexts around one anchor.
   Their bytes are fetched and the strings in them compared, anchor by anchor;
   an anchor with more than HOT contexts is dealt out by single strings.
5. Ranges are gathered by document and cut out of its bytes.

Equal contexts are told by 31 bits of their anchors' hashes and 64 of their
own, strings of one anchor in step 4 by their bytes, and single strings of hot
anchors by 128 bits of two hashes.

Nulls: a null text is empty; a null id counts as the smallest.  Repeated rows
are one document, returned as often as given; different texts with one id are
ordered by a hash of the text.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .anchors import SPAN
from .common import byte_texts, lean, pick, written
from .suffix_array import suffix_array

BLOCK_RUNS, CHUNK_BYTES, HOT = 50_000, 16_000, 4096
NULL_ID = -(1 << 63)

#: A place is a string start, then the number of starts from there on in the low bits.
_BITS = 24
_COUNT = (1 << _BITS) - 1
#: Hot anchors are sent to all tasks if there are no more of them.
FEW_HOT = 100_000


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, tag, text): tag tells different texts with one id apart and is 0 if there are none."""
    docs = pick(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    clash = docs.groupBy("doc").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"), F.count(F.lit(1)).alias("n"))
    several = clash.where("n > 1 and a <> b").limit(1).count() > 0
    return docs.select("doc", (F.xxhash64("text") if several else F.lit(0).cast("long")).alias("tag"), "text")


def longest_earlier(symbols: np.ndarray) -> list[int]:
    """For each position, the length of the longest sequence from there that also begins at an earlier position (they may overlap)."""
    _, ranks, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    text, n = ranks.tolist(), len(symbols)
    again = (counts[ranks] > 1).tolist()
    out = [0] * n
    # Suffixes whose first symbol is the only one of its kind share nothing; the others stay neighbours.
    order = [i for i in suffix_array(text) if again[i]]
    above, below = [-1] * n, [-1] * n
    for x, y in zip(order, order[1:]):
        below[x], above[y] = y, x
    shared = [0] * n  # with the suffix above
    h = 0
    for i in range(n):
        j = above[i]
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        shared[i] = h
        h -= h > 0
    # From the last position to the first: once the later ones are taken out, neighbours are earlier.
    for i in range(n - 1, -1, -1):
        if again[i]:
            up, down, own = above[i], below[i], shared[i]
            under = shared[down] if down >= 0 else 0
            out[i] = max(own, under)
            if up >= 0:
                below[up] = down
            if down >= 0:
                above[down], shared[down] = up, min(own, under)
    return out


def parsed(symbols: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of sequences of symbols that begin earlier, from left to right; none goes past the end of its text (ends: for each position)."""
    out, i, lengths = [], 0, longest_earlier(symbols)
    stop = ends.tolist()
    while i < len(lengths):
        if k := lengths[i]:
            out.append((i, min(i + k, stop[i], i + _COUNT // SPAN)))  # a run has fewer starts than SPAN
            i = out[-1][1]
        else:
            i += 1
    return out


@lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of texts (doc, tag, text) as (doc, tag, place, anchor, context); sequences of runs that begin earlier in their block become one place with the anchor -1."""
    held: list[tuple[np.ndarray, ...]] = []
    chunk: list[tuple[int, int, bytes]] = []
    n_runs = n_bytes = 0

    def flush_chunk() -> None:
        nonlocal n_runs, n_bytes
        if chunk:
            data = np.frombuffer(b"".join(x[2] for x in chunk), np.uint8)
            text, lo, count, anchor, context = anchors.runs(data, np.array([len(x[2]) for x in chunk]))
            doc, tag = (np.array([x[k] for x in chunk], np.int64)[text] for k in (0, 1))
            held.append((doc, tag, (lo << _BITS) + count, (anchor >> np.uint64(33)).astype(np.int64), context.view(np.int64)))
            n_runs += len(lo)
            chunk.clear()
            n_bytes = 0

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal n_runs
        if n_runs:
            doc, tag, place, anchor, context = (np.concatenate(x) for x in zip(*held))
            by = np.lexsort((place, tag, doc))
            doc, tag, place, anchor, context = (x[by] for x in (doc, tag, place, anchor, context))
            new_text = np.ones(len(by), bool)
            new_text[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
            fresh = new_text.copy()
            fresh[1:] |= place[1:] != place[:-1]
            # Repeated rows are one document.
            doc, tag, place, anchor, context, new_text = (x[fresh] for x in (doc, tag, place, anchor, context, new_text))
            edges = np.append(np.flatnonzero(new_text), len(doc))
            keep = np.ones(len(doc), bool)
            for begin, end in parsed(context, np.repeat(edges[1:], np.diff(edges))):
                keep[begin + 1 : end] = False
                last = int(place[end - 1])
                lo = int(place[begin]) >> _BITS
                place[begin] = (lo << _BITS) + (last >> _BITS) + (last & _COUNT) - lo
                anchor[begin] = -1
                context[begin] ^= place[begin] * 0x2545F491 + doc[begin]  # these meet no one; spread them
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, tag, place, anchor, context)], ["doc", "tag", "place", "anchor", "context"])
        held.clear()
        n_runs = 0

    for batch in batches:
        docs, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, tag, text in zip(docs, tags, byte_texts(batch.column(2))):
            if len(text) >= SPAN:
                chunk.append((doc, tag, text))
                n_bytes += len(text)
                if n_bytes >= CHUNK_BYTES:
                    flush_chunk()
                    if n_runs >= BLOCK_RUNS:
                        yield from block()
    flush_chunk()
    yield from block()


@lean
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that texts (doc, tag, text, open) list."""
    names = ["doc", "tag", "place", "anchor", "hot", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for doc, tag, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2)), batch.column(3).to_pylist()):
            for r in runs:
                lo, count = r["place"] >> _BITS, r["place"] & _COUNT
                for col, x in zip(cols, (doc, tag, r["place"], r["anchor"], r["hot"], text[lo : lo + count - 1 + SPAN])):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _strings(places: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string in the runs: the run's number, and where it begins in the joined bytes, which are the third."""
    count = places & _COUNT
    size = count + SPAN - 1
    begin = np.cumsum(size) - size
    run = np.repeat(np.arange(len(places)), count)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    return run, begin[run] + inner, np.frombuffer(b"".join(data), np.uint8)


def seen_before(at: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Which of the strings that begin at these places are equal to one before them in the list."""
    whole = anchors.hashes(joined)[1][at]
    by = np.argsort(whole, kind="stable")
    same = np.flatnonzero(whole[by[1:]] == whole[by[:-1]]) + 1
    again = np.zeros(len(at), bool)
    strings = np.lib.stride_tricks.sliding_window_view(joined, SPAN) if len(joined) >= SPAN else joined.reshape(0, 1)
    for k in range(0, len(same), 10_000):
        x, y = at[by[same[k : k + 10_000]]], at[by[same[k : k + 10_000] - 1]]
        if not (strings[x] == strings[y]).all():
            break  # different strings with one hash: compare all by their bytes
    else:
        again[by[same]] = True
        return again
    known: set[bytes] = set()
    for k, x in enumerate(at.tolist()):
        string = joined[x : x + SPAN].tobytes()
        again[k] = string in known
        known.add(string)
    return again


@lean
def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by anchor, then (doc, tag, place): the places of strings that an earlier run of the anchor has."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, tag, place, anchor = (rows.column(k).to_numpy() for k in range(4))
        same = np.zeros(len(doc), bool)
        same[1:] = (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (place[1:] == place[:-1]) & (anchor[1:] == anchor[:-1])
        keep = np.flatnonzero(~same)
        data = rows.column(5).to_pylist()
        for at in _cuts(anchor[keep], 2000):
            part = keep[at[0] : at[1]]
            run, at_byte, joined = _strings(place[part], [data[i] for i in part])
            again = seen_before(at_byte, joined)
            # Strings next to each other that go become one place.
            lone = np.flatnonzero(again & np.concatenate([[True], ~again[:-1] | (run[1:] != run[:-1])]))
            last = np.flatnonzero(again & np.concatenate([~again[1:] | (run[1:] != run[:-1]), [True]]))
            if len(lone):
                begin = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
                inner = lone - begin[run[lone]]
                i = part[run[lone]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(tag[i]), pa.array((((place[i] >> _BITS) + inner) << _BITS) + last - lone + 1)], ["doc", "tag", "place"])

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        anchor = rows.column(3).to_numpy()
        edge = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
        if edge:
            yield from settle(rows.slice(0, edge))
        rest = rows.slice(edge)
    if rest is not None and len(rest):
        yield from settle(rest)


def _cuts(keys: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about that size that don't part equal neighbours."""
    edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    at = 0
    while at < len(keys):
        end = int(edges[min(np.searchsorted(edges, at + size), len(edges) - 1)])
        yield at, end
        at = end


@lean
def _single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            doc, tag, place = (batch.column(k).to_numpy() for k in range(3))
            run, at, joined = _strings(place, batch.column(5).to_pylist())
            inner = np.arange(len(run)) - np.searchsorted(run, run)
            one, two = (anchors.hashes(joined, salt)[1][at].view(np.int64) for salt in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[run], tag[run], (((place[run] >> _BITS) + inner) << _BITS) + 1, one, two)], ["doc", "tag", "place", "string", "more"])


@lean
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by anchor, context, doc, tag, place: those that go, and as open, the first of each context of an anchor that has several.

    It holds one row besides a batch, however many runs an anchor has.
    """
    last: tuple[int, ...] | None = None  # the row before: doc, tag, place, anchor, context
    last_first = False
    waiting: tuple[int, ...] | None = None  # the first run of an anchor that has one context so far
    names = ["doc", "tag", "place", "anchor", "open"]
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        cols = [batch.column(k).to_numpy() for k in range(5)]
        before = [np.concatenate([[last[k] if last else 0], c[:-1]]) for k, c in enumerate(cols)]
        differs = [c != b for c, b in zip(cols, before)]
        anchor = cols[3]
        new_anchor, new_context = differs[3] | (anchor < 0), differs[3] | differs[4] | (anchor < 0)
        same_row = ~(new_context | differs[0] | differs[1] | differs[2])
        if last is None:
            new_anchor[0] = new_context[0] = True
            same_row[0] = False
        at = np.maximum.accumulate(np.where(same_row, -1, np.arange(n)))
        first = np.where(at >= 0, new_context[at], last_first)
        gone = ~first | (anchor < 0)
        fresh = np.flatnonzero(new_context & (anchor >= 0))
        is_open = np.zeros(n, bool)
        is_open[fresh] = ~new_anchor[fresh] | np.append(~new_anchor[fresh[1:]], [False])
        extra: list[tuple[int, ...]] = []
        if waiting and len(fresh) and not new_anchor[fresh[0]]:
            extra.append(waiting)
        if len(fresh):
            i = fresh[-1]
            waiting = tuple(int(c[i]) for c in cols) if new_anchor[i] else None
        last, last_first = tuple(int(c[-1]) for c in cols), bool(first[-1])
        for part, flag in ((np.flatnonzero(gone), False), (np.flatnonzero(is_open & ~gone), True)):
            if len(part):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[part]) for c in cols[:4]), pa.array(np.full(len(part), flag))], names)
        if extra:
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in extra], pa.int64()) for k in range(4)), pa.array([True] * len(extra))], names)


def removed_places(docs: DataFrame) -> DataFrame:
    """(doc, tag, place) of keyed docs: starts of strings that occur earlier."""
    runs = docs.where(F.octet_length("text") >= SPAN).mapInArrow(_cut, "doc long, tag long, place long, anchor long, context long")
    spread = F.when(F.col("anchor") < 0, F.col("context")).otherwise(0)
    met = runs.repartition("anchor", spread).sortWithinPartitions("anchor", "context", "doc", "tag", "place")
    met = written(met.mapInArrow(_met, "doc long, tag long, place long, anchor long, open boolean"))

    open_runs = met.where("open")
    hot = written(open_runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(f"n > {HOT}").select("anchor", F.lit(True).alias("hot")))
    if hot.count() <= FEW_HOT:
        hot = F.broadcast(hot)
    open_runs = open_runs.join(hot, "anchor", "left").select("doc", "tag", "place", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))
    open_runs = open_runs.groupBy("doc", "tag").agg(F.collect_list(F.struct("place", "anchor", "hot")).alias("open"))
    parts = written(docs.join(open_runs, ["doc", "tag"]).select("doc", "tag", "text", "open").mapInArrow(_contexts, "doc long, tag long, place long, anchor long, hot boolean, bytes binary"))

    few = written(parts.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "doc", "tag", "place").mapInArrow(_resolved, "doc long, tag long, place long"))
    if parts.where("hot").limit(1).count():
        many = written(parts.where("hot").mapInArrow(_single_strings, "doc long, tag long, place long, string long, more long"))
        least = many.groupBy("string", "more").agg(F.min(F.struct("doc", "tag", "place")).alias("least"))
        many = many.join(least, ["string", "more"]).where(F.struct("doc", "tag", "place") != F.col("least"))
        few = few.unionByName(many.select("doc", "tag", "place"))
    return met.where("not open").select("doc", "tag", "place").unionByName(few)


def cut_out(text: bytes, places: list[int] | None) -> tuple[int, int, bytes]:
    """The number of bytes removed, of maximal runs of them, and what is left."""
    if not places:
        return 0, 0, text
    p = np.array(places, np.int64)
    lo = p >> _BITS
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, lo + (p & _COUNT) - 1 + SPAN, -1)
    gone = np.cumsum(step[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def deduplicated(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept."""
    docs = keyed(docs)
    gone = written(removed_places(docs).groupBy("doc", "tag").agg(F.collect_list("place").alias("places")))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist()):
                n, spans, left = cut_out(text, places)
                rows.append((len(text), n, spans, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            ids = pa.array([None if d == NULL_ID else d for d in batch.column(0).to_pylist()], pa.int64())
            arrays = [ids, *(pa.array(c, k) for c, k in zip(cols, kinds))][: 6 if with_bytes else 5]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(arrays)])

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return docs.join(gone, ["doc", "tag"], "left").select("doc", "text", "places").mapInArrow(run, out)
