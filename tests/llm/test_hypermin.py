import random

import numpy as np
import pytest

from comparing import SMALL, against_sql
from seqlattice.llm import hypermin
from seqlattice.llm.common import LOWER

SCHEMA = "doc_id long, text string"


def brute(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, n, words, edits):
    base = [rng.choice(VOCAB) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        out.append(" ".join(w))
    return out


VOCAB = [f"w{k}" for k in range(3000)]


@pytest.mark.parametrize("size", [2, 5])
def test_brute_force(spark, size):
    rng = random.Random(size)
    texts = []
    for words in (3, 12, 40, 150, 1300):
        texts += family(rng, 14, words, max(1, words // 12))
    texts += ["", None, "one", "ONE", "one two", "  one   TWO ", "x " * 50, "x " * 40]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hypermin.components(spark.createDataFrame(rows, SCHEMA), size).collect()}
    assert got == brute(rows, size)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(hypermin, "BLOCK_ROWS", 5)
    monkeypatch.setattr(hypermin, "FIRST_BANDS", 1)
    rng = random.Random(3)
    rows = list(enumerate(family(rng, 60, 60, 6)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hypermin.components(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == brute(rows, 2)


def test_sql_and_kept(spark):
    against_sql(hypermin.components(spark.read.parquet(f"{SMALL}/documents.parquet")), hypermin.ORACLE)


def test_rows_without_id_repeated_rows_clashing_names(spark):
    df = spark.createDataFrame([(None, "a b c d", 1, "z"), (5, "a b c d", 2, "z"), (5, "a b c d", 3, "z"), (3, "q r s", 4, "z")], "doc_id long, text string, a int, Text string")
    got = sorted(map(tuple, hypermin.components(df).collect()), key=repr)
    assert got == sorted([(None, 3, None, True), (5, 3, 5, True), (5, 3, 5, True), (3, 2, 3, True)], key=repr)
    assert hypermin.deduplicated(df).columns == df.columns and hypermin.deduplicated(df).count() == 3
    assert hypermin.components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_between_what_lies_beside_a_hub(spark):
    """Copies of copies: most pairs are just below the threshold, so that links lie beside hubs as well."""
    rng = random.Random(8)
    base = [f"v{k}" for k in range(100)]
    texts = []
    for _ in range(120):
        w = list(base)
        for k in rng.sample(range(100), 8):
            w[k] = rng.choice(VOCAB)
        texts.append(" ".join(w))
        w[rng.randrange(100)] = "other"
        texts += [" ".join(w)] * (rng.random() < 0.3)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hypermin.components(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == brute(rows, 2) and 40 < len({c for _, c in got.values()}) < len(texts)


def test_recall_of_the_bands():
    """Pairs at a similarity of just 0.8 share a bucket."""
    rng, met = np.random.Generator(np.random.PCG64(5)), 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 200, np.uint64) * np.uint64(2)
        a, b = (hypermin.band_keys(hypermin.sketch_each(np.unique(x)), 0) for x in (pool[:180], pool[20:]))
        met += bool(np.isin(a, b).any())
    assert met == 300


def test_estimates_are_close():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (50, 400, 5000):
        pool = rng.integers(0, 1 << 63, n * 2, np.uint64)
        a, b = np.unique(pool[: int(n * 1.0)]), np.unique(pool[int(n * 0.1) : int(n * 1.1)])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        make = hypermin.sketch_each if n < hypermin.SPLIT else hypermin.sketch_dealt
        assert abs(hypermin.estimate(make(a)[None], make(b)[None])[0] - truth) < 0.11
