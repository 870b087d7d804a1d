"""Near-duplicates with HyperMinHash sketches.

A document is its set of distinct word shingles.  A sketch has BANDS * ROWS
registers; each holds the smallest hash of its bucket in floating form: its
exponent (the count of leading zeros) and MANTISSA further bits.  Sets of at
least SPLIT shingles are dealt over the registers by one hash function; for
smaller sets, whose buckets would be mostly empty, each register has a hash
function of its own.  Sets of SPLIT to SPLIT / threshold shingles get sketches
of both kinds, as a set and its match may lie on either side.

1. Documents with equal sets collapse to the smallest id; one head is left for
   each set, with its sketch.  Heads that share a bucket of any band with
   another are kept by bucket, and the texts of those alone go to a table
   bucketed by id, which later joins on id don't shuffle again.
2. Sketches are banded.  In each bucket of the first bands one member is paired
   with every other member: as many pairs as members, not all pairs.  The pairs
   are confirmed on the full sets, and the links give components.
3. In every bucket of all bands the hub is the component that has the most
   members in all.  Each other component there is compared with the hub, on the
   hashes of the full sets and in place: both come to one task, in parts of
   bounded size, and only links leave it.
4. Components of one bucket other than its hub are compared in place as well:
   first by the collision-corrected Jaccard estimate of their sketches, five
   deviations below the threshold (about one in three million true links lies
   lower), then those with a likely partner on the hashes of their full sets.
   Again only links leave, at most one for each component that they join, so
   that what is put out grows with the members of a bucket, not with pairs.

A pair at a similarity of exactly 0.8 meets in no bucket with a probability of
4e-8.  Nulls: a null text has no shingles and no links; a row with a null id
takes no part and returns a null component.  A repeated row repeats its
result; two texts with one id count as one node.  Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import LOWER, bucketed, byte_texts, forget, if_few, lean, mix64, numbered, pick, written
from .components import connected

BANDS, ROWS, MANTISSA, SPLIT = 56, 6, 10, 1024
FIRST_BANDS = 8
REGISTERS = BANDS * ROWS
SHORT = 128
#: What a comparing task holds of either side: rows, and shingles in all.
BLOCK_ROWS, BLOCK_SHINGLES = 2000, 500_000
EMPTY = 0xFFFF

_rng = np.random.Generator(np.random.PCG64(20240611))
# 32 bits are enough for the minima of fewer than SPLIT / threshold hashes.
_XOR = _rng.integers(0, 1 << 32, REGISTERS, np.uint32)[:, None]
_MUL = _rng.integers(0, 1 << 32, REGISTERS, np.uint32)[:, None] | np.uint32(1)
_EDGES = np.array([(b << 64) // REGISTERS for b in range(REGISTERS)], np.uint64)


def shingles(text: bytes | None, size: int) -> set[tuple[bytes, ...]]:
    words = text.translate(LOWER).split() if text else []
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(size))))


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.full(n, k if k < size else 0, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0xD1342543DE82EF95) + h[i : i + n])
    return np.unique(out)


def floating(x: np.ndarray) -> np.ndarray:
    """Registers of values below 2**56: exponent, then MANTISSA bits."""
    m, e = np.frexp(x.astype(np.float64))
    return np.where(x == 0, 0, e * (1 << MANTISSA) + ((m - 0.5) * (2 << MANTISSA)).astype(np.int64)).astype(np.uint16)


def sketch_each(hashes: np.ndarray) -> np.ndarray:
    low, upper = np.full(REGISTERS, 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(upper), 256):
        part = upper[i : i + 256] ^ _XOR
        part *= _MUL
        np.minimum(low, part.min(axis=1), out=low)
    return floating(low)


def sketch_dealt(hashes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(hashes, _EDGES)
    full = at < np.append(at[1:], len(hashes))
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[full] = floating(hashes[at[full]] - _EDGES[full])
    return out


def band_keys(sketch: np.ndarray, kind: int) -> np.ndarray:
    rows = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(kind)
    for i in range(ROWS):
        key = mix64(key * np.uint64(0xF1357AEA2E62A9C5) + rows[:, i] + np.uint64(1))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, bits: int = MANTISSA) -> np.ndarray:
    """Jaccard estimates for rows of sketches, without registers empty on both sides, corrected for chance collisions.

    Two different minima agree in exponent and mantissa with a probability of
    about 2**-MANTISSA / 3 (minima spread over the exponents geometrically);
    of mantissas alone, with 2**-bits.
    """
    empty = EMPTY if a.dtype == np.uint16 else EMPTY & 0xFF
    used = (a != empty) | (b != empty)
    share = ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    chance = 2.0**-bits / (3 if bits == MANTISSA else 1)
    return np.maximum(0.0, (share - chance) / (1 - chance))


def shortened(sketch: bytes) -> bytes:
    """The low bytes of the first SHORT registers; what isn't empty doesn't become so."""
    full = np.frombuffer(sketch, np.uint16)[:SHORT]
    low = (full & 0xFF).astype(np.uint8)
    low[(low == EMPTY & 0xFF) & (full != EMPTY)] = 0
    return low.tobytes()


def sketched(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """doc_id, n (set size), set (a 128-bit digest of it), each, dealt: sketches of either kind, where they apply."""
    upper = SPLIT / threshold

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, sets, each, dealt = [], [], [], []
            for text in byte_texts(batch.column(1)):
                h = shingle_hashes(text, size)
                n = len(h)
                ns.append(n)
                sets.append(n.to_bytes(4, "big") + int(mix64(h).sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix64(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)).to_bytes(8, "big") if n else None)
                each.append(sketch_each(h).tobytes() if 0 < n <= upper else None)
                dealt.append(sketch_dealt(h).tobytes() if n >= SPLIT else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(sets, pa.binary()), pa.array(each, pa.binary()), pa.array(dealt, pa.binary())],
                ["doc_id", "n", "set", "each", "dealt"])

    return docs.mapInArrow(run, "doc_id long, n long, set binary, each binary, dealt binary")


def banded(heads: DataFrame) -> DataFrame:
    """(key, early, id) for each band; early are those of the first FIRST_BANDS."""
    early = np.arange(BANDS) < FIRST_BANDS

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for i, *both in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for kind, sketch in enumerate(both):
                    if sketch is not None:
                        keys.append(band_keys(np.frombuffer(sketch, np.uint16), kind))
                        ids.append(i)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(early, len(keys))), pa.array(np.repeat(ids, BANDS))], ["key", "early", "id"])

    return heads.select("id", "each", "dealt").mapInArrow(run, "key long, early boolean, id long")


def in_company(rows: DataFrame) -> DataFrame:
    """The banded rows of buckets with two ids or more, each once.  A task holds one row besides a batch."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, bool, bool] | None = None  # key, id, early, whether it was put out
        for batch in batches:
            if not len(batch):
                continue
            key, ids, early = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if last is not None:
                key, ids, early = (np.concatenate([[x], c]) for x, c in zip(last, (key, ids, early)))
            same = key[1:] == key[:-1]
            again = np.concatenate([[False], same & (ids[1:] == ids[:-1])])
            beside = same & (ids[1:] != ids[:-1])
            # A bucket with two ids has, sorted, a place where they meet.
            run_of = np.cumsum(np.concatenate([[0], ~same]))
            met = np.zeros(run_of[-1] + 1, bool)
            met[run_of[1:][beside]] = True
            known = last is not None and last[3]
            if known:
                met[0] = True
            out = met[run_of] & ~again
            if known:
                out[0] = False
            last = (key[-1], ids[-1], early[-1], bool(met[-1]))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, early, ids)], ["key", "early", "id"])

    return rows.repartition("key").sortWithinPartitions("key", "id").select("key", "id", "early").mapInArrow(run, "key long, early boolean, id long")


def beside_hub(rows: DataFrame) -> DataFrame:
    """(key, hub, component) from rows (key, size, component): each bucket's components but the first by size (descending), which is its hub.

    A task holds one row besides a batch, however many a bucket has."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_hub = last_comp = None
        for batch in batches:
            if not len(batch):
                continue
            key, comp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            hub = np.where(at >= 0, comp[at], last_hub or 0)
            again = np.concatenate([[not new[0] and comp[0] == last_comp], ~new[1:] & (comp[1:] == comp[:-1])])
            out = (comp != hub) & ~again
            last_key, last_hub, last_comp = key[-1], int(hub[-1]), comp[-1]
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, hub, comp)], ["key", "hub", "component"])

    order = rows.repartition("key").sortWithinPartitions("key", F.desc("size"), "component")
    return order.select("key", "component").mapInArrow(run, "key long, hub long, component long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    joined = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, set] = (None, set())
        for batch in batches:
            keep = []
            for x, y in zip(byte_texts(batch.column(2)), byte_texts(batch.column(3))):
                if x != last[0]:
                    last = (x, shingles(x, size))
                b = shingles(y, size)
                both = len(last[1] & b)
                keep.append(bool(both) and 100 * both >= percent * (len(last[1]) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long").distinct()


class Sets:
    """Sets of hashes, by size, against which a set is held in one pass."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = np.argsort([len(s) for s in sets], kind="stable")
        self.n = np.array([len(sets[i]) for i in self.order], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)])
        self.known, codes = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True)
        self.codes = codes.astype(np.int32)
        self.mark = np.zeros(len(self.known), np.int8)

    def linked(self, own: np.ndarray, percent: int) -> np.ndarray:
        """The numbers of the sets with 100 * intersection >= percent * union; only sets of a fitting size are looked at."""
        low, high = np.searchsorted(self.n, -(-percent * len(own) // 100)), np.searchsorted(self.n, 100 * len(own) // percent, "right")
        if low >= high:
            return self.order[:0]
        at = np.searchsorted(self.known, own)
        at = at[self.known[np.minimum(at, len(self.known) - 1)] == own] if len(self.known) else at[:0]
        self.mark[at] = 1
        edge = self.begin[low]
        both = np.add.reduceat(self.mark[self.codes[edge : self.begin[high]]], self.begin[low:high] - edge, dtype=np.int64)
        self.mark[at] = 0
        return self.order[low:high][(both > 0) & (100 * both >= percent * (self.n[low:high] + len(own) - both))]


class Forest:
    """Which of a task's components are joined so far."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether that was news."""
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


_LINK = "a long, b long"


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    rows = (r for b in batches for r in zip(*(byte_texts(c) if pa.types.is_string(c.type) else c.to_pylist() for c in b.columns)))
    for _, group in groupby(rows, key=lambda r: r[:key]):
        yield list(group)


def parts_of(rows: str, shingles_in_all: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(shingles_in_all) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def dealt_to(n: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")


def with_hubs(pairs: DataFrame, labelled: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links, as pairs of components, between the members of hubs and of components beside them.

    pairs: (hub, component); labelled: (id, n, component).  Either side of a hub is cut into
    parts, and each part of one side meets each part of the other in a group of its own."""
    joined = labelled.join(pairs.select("hub").distinct().withColumnRenamed("hub", "component"), "component", "left_semi").withColumn("hub", F.col("component"))
    beside = labelled.join(pairs, "component")
    sums = lambda df, k: df.groupBy("hub").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).select("hub", parts_of("rows", "n").alias(k))
    parts = sums(joined, "i_parts").join(sums(beside, "j_parts"), "hub")
    own = joined.join(parts, "hub").select("hub", dealt_to(F.col("i_parts"), "i").alias("i"), F.explode(F.sequence(F.lit(0), F.col("j_parts") - 1)).alias("j"), F.lit(0).alias("side"), "id", "component")
    other = beside.join(parts, "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("i_parts") - 1)).alias("i"), dealt_to(F.col("j_parts"), "j").alias("j"), F.lit(1).alias("side"), "id", "component")
    placed = own.unionByName(other).join(texts, "id").select("hub", "i", "j", "side", "component", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            hub = rows[0][0]
            sets = [shingle_hashes(r[5], size) for r in rows if r[3] == 0]
            if sets and len(sets) < len(rows):
                held, forest = Sets(sets), Forest()
                found = [(hub, r[4]) for r in rows if r[3] == 1 and forest.root(r[4]) != forest.root(hub) and len(held.linked(shingle_hashes(r[5], size), percent)) and forest.join(r[4], hub)]
                if found:
                    yield _links(found)

    return placed.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side").mapInArrow(run, _LINK)


def in_pairs_of_parts(rows: DataFrame) -> DataFrame:
    """rows (key, id, ...) with i <= j and part: a key's rows are cut into parts, and each two of them make a group (key, i, j)."""
    parts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all_n")).select("key", parts_of("rows", "all_n").alias("parts"))
    placed = rows.join(parts, "key").withColumn("part", dealt_to(F.col("parts"), "p"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return placed.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other", "parts")


def likely(members: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """The members (key, id, n, component) that have a likely partner in their bucket, in another component."""
    least = threshold - 5 * (threshold * (1 - threshold) / SHORT) ** 0.5
    placed = in_pairs_of_parts(members).join(heads.select("id", "each", "dealt"), "id").select("key", "i", "j", "part", "id", "n", "component", "each", "dealt")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            part, ns, comps = (np.array([r[k] for r in rows], np.int64) for k in (3, 5, 6))
            hit = np.zeros(len(rows), bool)
            for kind in (7, 8):
                mine = np.array([k for k, r in enumerate(rows) if r[kind] is not None], np.int64)
                if len(mine) < 2:
                    continue
                short = np.frombuffer(b"".join(shortened(rows[k][kind]) for k in mine), np.uint8).reshape(len(mine), SHORT)
                for x in range(len(mine) - 1):
                    y, a = mine[x + 1 :], mine[x]
                    fit = (comps[y] != comps[a]) & (ns[y] >= threshold * ns[a] * 0.999) & (ns[a] >= threshold * ns[y] * 0.999)
                    if rows[0][1] != rows[0][2]:
                        fit &= part[y] != part[a]
                    near = np.flatnonzero(fit)
                    near = near[estimate(short[x + 1 :][near], short[x][None, :], 8) >= least]
                    if len(near):
                        hit[a] = hit[y[near]] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array([rows[k][c] for k in np.flatnonzero(hit)], pa.int64()) for c in (0, 4, 5, 6)], ["key", "id", "n", "component"])

    return placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "key long, id long, n long, component long").distinct()


def among_others(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links, as pairs of components, between members (key, id, n, component) of one bucket."""
    placed = in_pairs_of_parts(members).join(texts, "id").select("key", "i", "j", "part", "component", "text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            sets = [shingle_hashes(r[5], size) for r in rows]
            held, forest, found = Sets(sets), Forest(), []
            for r, own in zip(rows, sets):
                found += [(r[4], rows[k][4]) for k in held.linked(own, percent) if forest.join(r[4], rows[k][4])]
            if found:
                yield _links(found)

    return placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, _LINK).distinct()


def relabelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with their component, itself a node of found (node, component), replaced."""
    found = found.select(F.col("node").alias("component"), F.col("component").alias("_c"))
    return rows.join(found, "component", "left").withColumn("component", F.coalesce("_c", "component")).drop("_c")


def components(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable), kept (it is the component's)."""
    docs = pick(docs, doc_id="long", text="string")
    sketches = written(sketched(docs, size, percent / 100))
    classes = written(sketches.where("n > 0 and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("id")))
    heads = sketches.join(classes.withColumnRenamed("set", "s"), F.col("doc_id") == F.col("id")).where("set = s")
    heads = written(heads.select("id", "n", "each", "dealt"))
    shared = written(in_company(banded(heads)))
    ids = written(shared.select("id").distinct())
    texts = bucketed(docs.select(F.col("doc_id").alias("id"), "text").join(if_few(ids), "id", "left_semi").distinct(), "id")

    single = shared.where("early").select("key", F.lit(1).cast("long").alias("size"), F.col("id").alias("component"))
    pairs = beside_hub(single).select(F.col("hub").alias("a"), F.col("component").alias("b")).distinct()
    found = connected(written(confirmed(pairs, texts, size, percent)))

    # All buckets, by what is joined so far.
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    label = found.join(sizes, "component").select(F.col("node").alias("id"), "component", "size")
    whole = lambda rows: rows.join(label, "id", "left").withColumns({"component": F.coalesce("component", "id"), "size": F.coalesce("size", F.lit(1).cast("long"))})
    labels = written(whole(heads.select("id", "n").join(ids, "id", "left_semi").distinct()))
    beside = written(beside_hub(shared.select("key", "id").join(labels, "id").select("key", "size", "component")))
    joined = connected(written(with_hubs(beside.select("hub", "component").distinct(), labels, texts, size, percent)))

    # What lies beside hubs, bucket by bucket, where it isn't all of one component by now.
    now = relabelled(beside.select("key", "component", F.col("component").alias("was")), joined)
    several = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    members = now.join(several, "key", "left_semi").select("key", "component", "was").join(labels.select("id", "n", F.col("component").alias("was")), "was").select("key", "id", "n", "component")
    members = written(likely(members.distinct(), heads, percent / 100))
    last = connected(written(among_others(members, texts, size, percent)))
    forget(texts)

    first = found.select("node", "component")
    label = relabelled(relabelled(classes.join(first.withColumnRenamed("node", "id"), "id", "left").select("set", F.coalesce("component", "id").alias("component")), joined), last)
    out = sketches.select("doc_id", "n", "set").join(label.withColumnRenamed("component", "component_id"), "set", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the members of a group of near-duplicates that aren't its first.

    Rows without an id stay.  Of rows equal in id and text one stays (which one
    isn't defined); rows that share an id only are different documents."""
    judged = written(components(docs, size, percent))
    gone = if_few(written(judged.where("not kept").select(F.col("doc_id").alias("gone")).distinct()))
    rows, names = numbered(docs)
    key, text = f"_{names.index('doc_id')}", f"_{names.index('text')}"
    rows = rows.join(gone, F.col(key).cast("long") == F.col("gone"), "left_anti")
    if judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = rows.where(f"{key} is not null").dropDuplicates([key, text]).unionByName(rows.where(f"{key} is null"))
    return rows.toDF(*names)


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h, s FROM sets),
heads AS (SELECT min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s, h FROM sized WHERE n > 0 GROUP BY h),
toks AS (SELECT id, n, unnest(s) AS t FROM heads),
rank AS (SELECT t, row_number() OVER (ORDER BY count(*), t) AS r FROM toks GROUP BY t),
pre AS (SELECT id, n, t FROM (SELECT id, n, toks.t, row_number() OVER (PARTITION BY id ORDER BY r) AS k FROM toks JOIN rank ON toks.t = rank.t) WHERE k <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.id AS x, b.id AS y FROM pre a JOIN pre b ON a.t = b.t AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
inter AS (SELECT x, y, len(list_intersect(a.s, b.s)) AS i, a.n AS na, b.n AS nb FROM cand JOIN heads a ON a.id = x JOIN heads b ON b.id = y),
edge AS (SELECT x, y FROM inter WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS (SELECT x, y FROM edge UNION ALL SELECT y, x FROM edge),
reach AS (WITH RECURSIVE r(id, c) AS (SELECT id, id FROM heads UNION SELECT e.y, r.c FROM r JOIN both_ways e ON e.x = r.id WHERE r.c < e.y) SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept
FROM sized s LEFT JOIN heads h ON s.h = h.h AND s.n > 0 LEFT JOIN reach ON reach.id = h.id
"""
