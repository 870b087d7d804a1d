import hashlib
import random

from comparing import SMALL, against_sql
from seqlattice.llm import decontam


def brute(docs, items):
    grams = {}
    for name, text in items:
        w = decontam.words_of((text or "").encode())
        if w:
            n = min(8, len(w))
            for i in range(len(w) - n + 1):
                grams.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for i, text in docs:
        w, hit, names = decontam.words_of((text or "").encode()), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        names = sorted(x for x in names if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2))
    return sorted(out, key=repr)


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(12)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(f"i{k}", " ".join(words(rng.choice([1, 3, 7, 8, 9, 20, 60])))) for k in range(25)] + [("same", None), (None, " ".join(words(10))), ("i3", "zz yy xx"), ("empty", " ,. ")]
    docs = []
    for k in range(60):
        w = words(rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            src = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(src) - 1))
            w += src[a : a + rng.randint(1, 14)]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w).upper() if k % 3 else " ".join(w)))
    return docs + [(60, None), (None, docs[5][1]), (7, docs[7][1]), (8, "other text")], items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


def test_brute_force(spark):
    for seed in range(3):
        docs, items = make(seed)
        got = sorted(map(tuple, decontam.judged(*frames(spark, docs, items)).collect()), key=repr)
        assert got == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = make(9)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 150)
    got = sorted(map(tuple, decontam.judged(*frames(spark, docs, items)).collect()), key=repr)
    assert got == brute(docs, items)
    clean = {r[0] for r in brute(docs, items) if not r[5]}
    assert {r.doc_id for r in decontam.cleaned(*frames(spark, docs, items)).collect()} == clean


def test_sql(spark):
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    against_sql(decontam.judged(read("documents"), read("benchmark")), decontam.ORACLE)


def test_empty_tables_and_clashing_names(spark):
    docs, items = frames(spark, [(1, "a b c")], [("x", "a b")])
    assert decontam.judged(docs.limit(0), items).count() == 0
    assert decontam.judged(docs, items.limit(0)).first().n_hit == 0
    more = spark.createDataFrame([(1, "a b c", "zz", 1)], "doc_id long, text string, TEXT string, n_words int")
    assert decontam.judged(more, items).first().n_hit == 2


def test_pipeline_stage_leaves_no_single_item(spark, tmp_path):
    import corpus_pipeline

    one, other, unnamed = ("which of these nine rivers is the longest one in the country", "p0 p1 p2 p3 p4 p5 p6 p7 p8", " ".join(f"n{k}" for k in range(9)))
    rows = [(1, f"Ünder words. {one.upper()}? More words.", "en", 1), (2, one, "en", 1), (3, "no leak here", "en", 12), (4, None, "en", None), (5, f"see {unnamed}", "en", 1),
            (6, f"a {one} b {other}", "en", 1), (7, f"a {one[:30]} {one} {one[30:]} z", "en", 1), (8, "", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    items = spark.createDataFrame([("x", one), ("y", other), (None, unnamed)], "item_id string, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1] == ("Ünder words. ? More words.", 26)
    assert got[3] == ("no leak here", 12) and got[4] == (None, None) and got[5] == ("see ", 4) and got[8] == ("", 0)
    assert set(got) == {1, 3, 4, 5, 7, 8} and decontam.judged(out, items).where("n_hit > 0").count() == 0


def test_unleaked_over_blocks(spark, monkeypatch):
    docs, items = make(4)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 150)
    before, (df, bench) = brute(docs, items), frames(spark, docs, items)
    out = decontam.unleaked(df, bench)
    assert all(not r[2] for r in brute([(r.doc_id, r.text) for r in out.collect()], items))
    assert {r[0] for r in before if not r[2]} <= {r.doc_id for r in out.collect()} <= {r[0] for r in before if not r[5]}


def test_a_passage_of_many_items_costs_as_much_as_of_one():
    import time

    rng = random.Random(6)
    passage = " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    words = decontam.words_of(" ".join([passage, " ".join(f"v{k}" for k in range(9))] * 200).encode())

    def took(n):
        block = decontam.Block([(f"i{k}", f"start{k} {passage} end{k}") for k in range(n)])
        begin = time.process_time()
        hit, found = block.hits(words)
        assert hit.sum() == 200 * 60 and len(found) == n
        return time.process_time() - begin

    took(10)
    assert took(2000) < 5 * took(50) + 0.1


def test_blocks_are_given_up_one_by_one(spark, monkeypatch):
    docs, items = make(2)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 150)
    alive, most, real = [], [], decontam.Block.__init__

    def counted(self, rows):
        alive.append(sum(len(t or "") for _, t in rows))
        most.append(len(rows))
        real(self, rows)

    monkeypatch.setattr(decontam.Block, "__init__", counted)
    decontam.judged(*frames(spark, docs, items)).count()
    assert len(alive) > 3 and all(n <= 150 or k == 1 for n, k in zip(alive, most))


def test_a_document_costs_no_more_with_many_items():
    import time

    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    docs = [decontam.words_of(text(40).encode()) for _ in range(200)]

    def took(n):
        block = decontam.Block([(f"i{k}", text(200)) for k in range(n)])
        begin = time.process_time()
        for words in docs:
            block.hits(words)
        return time.process_time() - begin

    took(2)
    assert took(500) < 5 * took(5) + 0.1
