from comparing import SMALL, against_sql
from seqlattice.llm import quality


def brute_repeats(words, width):
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(width)})


def test_sql(spark):
    against_sql(quality.measured(spark.read.parquet(f"{SMALL}/documents.parquet")), quality.ORACLE)


def test_repeated_words():
    for text in (b"", b"a b c d e", b"a b c d e a b c d e", b"x " * 30, b"a b c d e f a b c d e g a b c d e"):
        assert quality.repeated_words(text.split(), 5) == brute_repeats(text.split(), 5)


def test_order_follows_rejections_per_cost_and_changes_no_verdict(spark):
    import time

    rules = {"slow": lambda v: time.sleep(0.002) or v.n_words < 3, "quick": lambda v: v.n_words < 3, "never": lambda v: False}
    sample = [b"a b", b"a b c d"] * 20
    assert quality.by_yield(sample, rules)[0] == "quick"
    for order in (["slow", "quick", "never"], ["never", "quick", "slow"]):
        assert [quality.verdict(quality.View(t), order, rules) for t in sample[:2]] == [False, True]


def test_edges(spark):
    clean = " ".join(f"Some{k} plain words stand here" for k in range(9))
    rows = [(1, None, "x"), (2, "", "x"), (None, clean, "x"), (4, clean, "x"), (4, clean, "x"), (5, "spam spam " * 4000, "x"), (6, "　".join("abcdefghijkl"), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Text string")
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.measured(df).collect()}
    assert got == {(1, 0, True, False), (2, 0, True, False), (None, 45, False, True), (4, 45, False, True), (5, 8000, True, False), (6, 1, True, False)}
    only = df.toDF("doc_id", "text", "other").select("doc_id", "text")
    assert sorted(str(r.doc_id) for r in quality.filtered(only).collect()) == ["4", "4", "None"]
    assert quality.measured(only.limit(0)).count() == 0 == quality.filtered(only.limit(0)).count()


def test_rules_are_timed_on_what_is_measured_before():
    import time

    seen = []
    rules = {"reads": lambda v: seen.append("n_words" in v.__dict__) or False, "slow": lambda v: time.sleep(0.001) or True}
    assert quality.by_yield([b"a b"] * 3, rules, ready=lambda v: v.n_words) == ["slow", "reads"] and seen == [True] * 3
