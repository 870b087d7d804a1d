import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlattice.llm import anchors, substrings

SPAN = anchors.SPAN
SCHEMA = "doc_id long, text string"


def brute(rows):
    """doc_id -> what the contract says, for rows with different ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: substrings.NULL_ID if r[0] is None else r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - SPAN + 1):
            part = data[k : k + SPAN]
            if part in seen:
                gone[k : k + SPAN] = b"\1" * SPAN
            seen.add(part)
        left = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), bytes(gone).strip(b"\0") and sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(left).hexdigest(), left)
        out[i] = (out[i][0], out[i][1], out[i][2] or 0, *out[i][3:])
    return out


def text(rng, n):
    return " ".join("".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed, n=40):
    rng = random.Random(seed)
    shared = [text(rng, k) for k in (30, 60, 15, 200, 23)]
    rows = []
    for i in range(n):
        parts = [text(rng, rng.randint(0, 60)) for _ in range(rng.randint(0, 3))] + rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((i * 3 + 1, rng.choice(["", " "]).join(parts)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, ""), (1004, "ab" * 4000), (1005, "x" * 500), (1006, "x" * 99), (1007, shared[3][:137] + shared[1]), (None, shared[0])]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in substrings.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == brute(rows)


def test_small_blocks_and_hot_anchors(spark, monkeypatch):
    rows = corpus(7)
    rng = random.Random(1)
    core = text(rng, 20)
    rows += [(2000 + k, text(rng, 8) + core + text(rng, 8)) for k in range(30)]
    monkeypatch.setattr(substrings, "BLOCK_RUNS", 50)
    monkeypatch.setattr(substrings, "HOT", 3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in substrings.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == brute(rows)


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(5)
    a, b = text(rng, 60), text(rng, 60)
    rows = [(1, a), (1, a), (2, a), (2, b), (2, b)]
    got = sorted((r.doc_id, r.n_removed, r.n_bytes) for r in substrings.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect())
    n, m = len(a.encode()), len(b.encode())
    assert got == sorted([(1, 0, n), (1, 0, n), (2, n, n), (2, 0, m), (2, 0, m)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_longest_earlier_sequences(symbols):
    """A sort of another kind in place of the suffix array fails here: neighbours then don't have the longest common starts."""
    n = len(symbols)
    want = [max((next((h for h in range(n - i) if symbols[j + h] != symbols[i + h]), n - i) for j in range(i)), default=0) for i in range(n)]
    assert substrings.longest_earlier(np.array(symbols, np.int64)) == want


def test_a_repeated_passage_is_one_place():
    """Many runs that begin together earlier leave a block as one place, whatever lies around them."""
    rng = random.Random(2)
    passage = text(rng, 400)
    docs = [(k, 0, f"{text(rng, 30)} {passage} {text(rng, 30)}") for k in range(6)]
    batch = pa.RecordBatch.from_arrays([pa.array([d[k] for d in docs]) for k in range(3)], ["doc", "tag", "text"])
    rows = [r for b in substrings._cut(iter([batch])) for r in b.to_pylist()]
    gone = [r for r in rows if r["anchor"] == -1]
    assert sorted(r["doc"] for r in gone) == [1, 2, 3, 4, 5]
    assert all((r["place"] & substrings._COUNT) > len(passage.encode()) - 2 * SPAN for r in gone)


def test_strings_with_one_hash_are_told_apart(monkeypatch):
    real = anchors.hashes
    monkeypatch.setattr(anchors, "hashes", lambda data, salt=0: tuple(x * np.uint64(0) for x in real(data, salt)))
    joined = np.frombuffer(b"a" * 120 + b"b" * 120 + b"a" * 100, np.uint8)
    assert substrings.seen_before(np.array([0, 120, 240]), joined).tolist() == [False, False, True]


def test_empty_and_clashing_names(spark):
    assert substrings.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "k" * 300, "other", 5)], "doc_id long, text string, TEXT string, place int")
    assert [(r.n_bytes, r.n_removed) for r in substrings.deduplicated(df).collect()] == [(300, 299)]


def test_sf_small(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in substrings.deduplicated(df).collect()}
    assert got == want
