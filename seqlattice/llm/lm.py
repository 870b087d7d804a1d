"""Scoring documents with language models learned from the documents.

Tokens are the words of a text, A-Z in lower case, then an end mark.  Documents
with crc32(doc_id) mod 10 = 0 are held out; the others teach two models:

* a smoothed unigram model over all words (base_score);
* a gated recurrent model with a class-factored output (gru.py).  Its items
  are the most frequent words and classes of the others; a word in such a
  class has the unigram model's share of the class, so that the model is a
  distribution over all known words and one unknown word a class.

Counts of words are combined before they are shuffled and stay distributed.
Sent to the executors are the most frequent words of at most LONGEST bytes (as
many as have one of the counts that KNOWN words have) with their counts, and
the network, all of fixed size; the counts of other words reach the documents
that have them by a join.

Each text is then cut into words once more, and all that later steps need of
it is written: its sums and its items as 16-bit numbers.  The network starts
from a pass over about WARM_DOCS training documents, those with the smallest
hashes.  Then the training documents are dealt by hash into shards of about
SHARD_TOKENS tokens, each shard trains a copy on all its documents in the
order of their hashes, and copies are averaged, weighted by tokens, in a tree
of MERGE copies a task.  The shards and the tree follow from the documents
alone, so that scores don't depend on how a cluster cuts the tables.  Every
token of every training document takes part.

Nulls: a null text is empty (its only token is the end mark); a document
without id is held out.  Repeated rows repeat their result (and teach twice).
Without training documents every word is unknown and all items are equally
likely.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import gru
from .common import LOWER, byte_texts, lean, pick, written

END = b"\n"  # no word has white space
KNOWN, LONGEST, WARM_DOCS, FLUSH = 200_000, 64, 1500, 1_000_000
SHARD_TOKENS, MERGE = 2_000_000, 16
SMOOTH = 0.1
LN10 = float(np.log(10))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def split(docs: DataFrame) -> DataFrame:
    docs = pick(docs, doc_id="long", text="string")
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True)))


def all_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and all words one after the other."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves empty ones
    return np.bincount(owner.filter(real).to_numpy(), minlength=len(texts)), words.filter(real).cast(pa.large_binary())


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        texts = size = 0

        def rows() -> pa.RecordBatch:
            words, counts = pa.concat_arrays([*held, pa.array([END], pa.large_binary())]).value_counts().flatten()
            # The one end mark stands for those of all texts.
            c = counts.to_numpy().astype(np.int64)
            c[-1] += texts - 1
            return pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(c)], ["word", "c"])

        for batch in batches:
            held.append(all_words(batch.column(0))[1])
            texts, size = texts + len(batch), size + len(held[-1])
            if size > FLUSH:
                yield rows()
                held, texts, size = [], 0, 0
        if texts:
            yield rows()

    partial = docs.where("not held_out").select("text").mapInArrow(run, "word binary, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


def other_class(word: bytes) -> int:
    """The class of a word that isn't an item itself, by its ending."""
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % gru.OTHER_CLASSES


class Lexicon:
    """The most frequent words: their counts and items; the end mark comes first."""

    def __init__(self, top: list[tuple[bytes, int]], end: int):
        top = [(END, end), *(x for x in top if x[0] != END)]
        self.number = {w: i for i, (w, _) in enumerate(top)}
        counts = np.array([c for _, c in top], np.float64)
        self.known = counts > 0
        self.log_count = np.log10(counts + SMOOTH)
        self.item = np.array([i if i < gru.WORDS else gru.WORDS + other_class(w) for i, (w, _) in enumerate(top)], np.int64)
        self.item_counts = np.zeros(gru.ITEMS)
        np.add.at(self.item_counts, self.item, counts)
        if counts.sum():
            self.item_counts[gru.WORDS :] += SMOOTH  # for words that are yet unknown

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of all texts, one after the other: where each begins (and the last ends), each token's number (the end mark's is 0; -1 for words not here) and item, and the words."""
        sizes, words = all_words(texts)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        coded = words.dictionary_encode()
        names, get = coded.dictionary.to_pylist(), self.number.get
        numbers = np.array([get(w, -1) for w in names], np.int64)
        items = self.item[numbers] if len(numbers) else numbers
        for k in np.flatnonzero(numbers < 0).tolist():
            items[k] = gru.WORDS + other_class(names[k])
        at = np.ones(begin[-1], bool)
        at[begin[1:] - 1] = False
        all_numbers, all_items = np.zeros(len(at), np.int64), np.full(len(at), self.item[0], np.int64)
        if len(names):
            codes = coded.indices.to_numpy()
            all_numbers[at], all_items[at] = numbers[codes], items[codes]
        return begin, all_numbers, all_items, words


def items_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def warm_weights(coded: DataFrame, documents: int, item_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and squares after a pass over about WARM_DOCS of so many documents, in one task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [x for batch in batches for x in items_of(batch.column(1))]
        flat, squares = gru.start_weights(item_counts), np.full(gru.SIZE, 1e-2, np.float32)
        if texts:
            gru.train(flat, squares, texts)
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()]), pa.array([squares.tobytes()])], ["w", "s"])

    few = coded.where("not held_out")
    if documents > WARM_DOCS:
        few = few.where(F.col("spot") < int(-(1 << 63) + (1 << 64) * WARM_DOCS / documents))
    rows = few.select("spot", "items").repartition(1).sortWithinPartitions("spot", "items").mapInArrow(run, "w binary, s binary").collect()
    if not rows:
        return gru.start_weights(item_counts), np.full(gru.SIZE, 1e-2, np.float32)
    return np.frombuffer(rows[0].w, np.float32).copy(), np.frombuffer(rows[0].s, np.float32).copy()


def trained_weights(coded: DataFrame, tokens: int, warm) -> np.ndarray:
    """The average of copies, each trained on all documents of a shard."""
    shards = max(1, -(-tokens // SHARD_TOKENS))

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), items_of(b.column(1))))
        for shard, group in groupby(rows, key=lambda r: r[0]):
            yield shard, [x for _, x in group]

    @lean
    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, texts in by_shard(batches):
            flat, squares = (x.copy() for x in warm.value)
            gru.train(flat, squares, texts)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([sum(map(len, texts))], pa.int64()), pa.array([flat.tobytes()])], ["shard", "tokens", "w"])

    @lean
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for above, group in groupby(rows, key=lambda r: r[0] // MERGE):
            tokens, total = 0, np.zeros(gru.SIZE)
            for _, n, w in group:
                tokens += n
                total += n * np.frombuffer(w, np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([above], pa.int64()), pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()])], ["shard", "tokens", "w"])

    schema = "shard long, tokens long, w binary"
    dealt = coded.where("not held_out").select(F.pmod("spot", F.lit(shards)).alias("shard"), "spot", "items")
    level = dealt.repartition("shard").sortWithinPartitions("shard", "spot", "items").select("shard", "items").mapInArrow(copies, schema)
    while True:
        level = written(level.repartition(F.floor(F.col("shard") / MERGE)).sortWithinPartitions("shard").mapInArrow(merged, schema))
        shards = -(-shards // MERGE)
        if shards == 1:
            break
    rows = level.collect()
    return np.frombuffer(rows[0].w, np.float32).copy() if rows else warm.value[0]


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The words with the highest counts, as many counts as KNOWN words reach and fewer than KNOWN words in all; the end mark is the first.

    How many words have a count is counted first, so that no task sorts words it will not keep."""
    short = counts.where(f"octet_length(word) <= {LONGEST}")
    ranks = short.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    few = ranks.orderBy(F.desc("c")).limit(KNOWN).collect()
    held, least = 0, 1 << 62
    for r in few:
        if held + r.n > KNOWN:
            break
        held, least = held + r.n, r.c
    rows = short.where((F.col("c") >= least) | (F.col("word") == F.lit(END))).select("word", "c").toArrow() if few else None
    top = sorted(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()), key=lambda x: (x[0] != END, -x[1], x[0])) if rows else []
    return top


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, docs = docs.sparkSession, split(docs)
    sc = spark.sparkContext
    counts = written(word_counts(docs))
    pairs = most_frequent(counts)
    lexicon = sc.broadcast(Lexicon(pairs, dict(pairs[:1]).get(END, 0)))
    del pairs
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, distinct = totals.n or 0, totals.v

    # Smoothed counts of the words in each class of others.
    ending = F.reverse(F.transform(F.sequence(F.greatest(F.octet_length("word") - 1, F.lit(1)), F.octet_length("word")), lambda k: F.conv(F.hex(F.substring(F.col("word"), k, 1)), 16, 10).cast("int")))
    classed = counts.select("word", "c", ending.alias("b")).select("word", "c", ((F.col("b")[0] * 31 + F.when(F.size("b") > 1, F.try_element_at("b", F.lit(2))).otherwise(0)) % gru.OTHER_CLASSES).alias("k"))
    mass = {r.k: (r.c, r.n) for r in classed.groupBy("k").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    items = [w for w, i in lexicon.value.number.items() if i < gru.WORDS]
    share = np.array([mass.get(k, (0, 0))[0] + SMOOTH * mass.get(k, (0, 0))[1] + SMOOTH for k in range(gru.OTHER_CLASSES)], np.float64)
    for w in items:
        i = lexicon.value.number[w]
        if lexicon.value.known[i]:
            share[other_class(w)] -= 10 ** float(lexicon.value.log_count[i])
    log_share = np.log10(np.maximum(share, SMOOTH))

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for batch in batches:
            begin, numbers, items, words = lex.read(batch.column(1))
            edges = begin[:-1]
            here, other = numbers >= 0, items >= gru.WORDS
            logs = np.where(here, lex.log_count[numbers], 0.0)
            more = np.where(other, logs - log_share[np.where(other, items - gru.WORDS, 0)], 0.0)
            cols = [np.add.reduceat(x, edges) for x in ((here & lex.known[numbers]).astype(np.int64), logs, more)] if len(batch) else [np.zeros(0)] * 3
            rare = np.flatnonzero(~here)
            text_of = np.searchsorted(begin, rare, "right") - 1
            per_text = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(batch)))])
            rare_words = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), words.take(pa.array(rare - text_of)).cast(pa.binary()))
            packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((2 * begin).astype(np.int32)), pa.py_buffer(items.astype(np.uint16))])
            tags = pa.array([xxh3_64_intdigest(t or b"") - (1 << 63) for t in byte_texts(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), tags, pa.array(np.diff(begin).astype(np.int64)), pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.float64)), pa.array(cols[2].astype(np.float64)), packed, rare_words],
                ["doc_id", "held_out", "spot", "tag", "n_tokens", "n_known", "logs", "more", "items", "words"])

    # A document's spot, which orders and deals the documents, is a hash of its id and text.
    spotted = docs.select("doc_id", "text", "held_out", F.xxhash64("doc_id", "text").alias("spot"))
    parts = written(spotted.mapInArrow(encode, "doc_id long, held_out boolean, spot long, tag long, n_tokens long, n_known long, logs double, more double, items binary, words array<binary>"))
    n_docs = parts.where("not held_out").count()
    warm = sc.broadcast(warm_weights(parts, n_docs, lexicon.value.item_counts))
    weights = sc.broadcast(trained_weights(parts, n_train, warm))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            network = gru.scores(weights.value, items_of(batch.column(6))) / LN10 + batch.column(7).to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(network, pa.float64())], ["doc_id", "held_out", "tag", "n_tokens", "n_known", "logs", "network"])

    scores = parts.select("doc_id", "held_out", "tag", "n_tokens", "n_known", "logs", "items", "more").mapInArrow(run, "doc_id long, held_out boolean, tag long, n_tokens long, n_known long, logs double, network double")
    away = parts.where("size(words) > 0").dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", F.explode("words").alias("word"))
    away = away.join(counts, "word", "left").groupBy("doc_id", "tag").agg(F.count("c").alias("more_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more_logs"))
    away = away.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "more_known", "more_logs")
    out = scores.join(away, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    whole = float(np.log10(n_train + SMOOTH * (distinct + 1)))
    extra = F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("network") + extra).alias("score"))
