"""Role repair, pages, records, mixing, language models, and the pipeline."""

import itertools
import math
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from comparing import SMALL, against_sql
from pyspark.sql import functions as F

from seqlattice.llm import chat, gru, html_main, lm, mixing, pii, quality, warc


def cost_of(roles):
    """The cheapest repair, by trying all labels and merges."""
    best = chat.FAR
    for labels in itertools.product((0, 1, 2), repeat=len(roles)):
        costs = {chat.START: 0}
        for role, to in zip(roles, labels):
            after = {}
            for s, c in costs.items():
                own = c + chat.label_cost(role, to)
                for extra in ([chat.INSERT * len(chat.FILL[s, to])] if (s, to) in chat.FILL else []) + ([chat.MERGE] if s == to else []):
                    after[to] = min(after.get(to, chat.FAR), own + extra)
            costs = after
        best = min([best, *(c + chat.INSERT * len(chat.CLOSE[s]) for s, c in costs.items())])
    return best


def test_repair_is_cheapest():
    for n in range(1, 5):
        for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
            whole = chat.borders([chat.matrix(list(roles))])
            m = chat.matrix(list(roles))
            got = min(m[4 * chat.STATES.index(chat.START) + j] + chat.INSERT * len(chat.CLOSE[s]) for j, s in enumerate(chat.STATES))
            assert got == cost_of(roles) and whole[0] == chat.START


def test_the_chosen_path_has_the_least_cost():
    """Step by step, through chunks of two turns as well."""
    for n in range(1, 6):
        for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
            for size in (n, 2):
                chunks = [list(roles[k : k + size]) for k in range(0, n, size)]
                states = chat.borders([chat.matrix(c) for c in chunks])
                total, at = chat.INSERT * len(chat.CLOSE[states[-1]]), chat.START
                for c, entry, leave in zip(chunks, states, states[1:]):
                    for role, (state, to, merged) in zip(c, chat.path(c, entry, leave)):
                        assert state == at and (state == to if merged else (state, to) in chat.FILL)
                        total += chat.label_cost(role, to) + (chat.MERGE if merged else chat.INSERT * len(chat.FILL[state, to]))
                        at = to
                assert at == states[-1] and total == cost_of(roles)


def test_rendered_conversations_are_legal_and_chunks_change_nothing(spark, monkeypatch):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "assistant", "x"), (2, 5, "system", "y"), (2, 6, None, None), (None, 0, "user", "<|im_end|>"), (3, None, "user", "n"), (3, 0, "assistant", "m"), (3, 0, "assistant", "m")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def texts():
        out = {}
        for r in sorted(chat.repaired(df).collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.turn is not None, r.turn, r.copy, r.slot)):
            out[r.conv_id] = out.get(r.conv_id, "") + r.rendered
        return out

    whole = texts()
    assert whole[1] == "<|im_start|>user\na\n\nb<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert whole[None].startswith("<|im_start|>user\n< |im_end|>")
    monkeypatch.setattr(chat, "CHUNK", 2)
    assert {k: len(v) for k, v in texts().items()} == {k: len(v) for k, v in whole.items()}
    assert chat.repaired(df.limit(0)).count() == 0


def test_main_text():
    page = "<html><body><nav><a href=x>Menu item</a></nav><div class='ad'>Buy now.</div><article><h1>Title &amp; more</h1><p>First  <b>part</b>.<p>Second.</p></article><footer>Imprint.</footer><div id='comments'><p>I disagree.</p></div></body></html>"
    lines = html_main.lines_of(page)
    assert [t for t, p in lines if p in html_main.own_places([p for _, p in lines])] == ["Title & more", "First part.", "Second."]
    assert [t for t, p in lines if p == html_main.NAMED] == ["Menu item", "Buy now.", "Imprint.", "I disagree."]
    assert html_main.common_lines([1, 2, 3, 4], [2, 9, 4, 1]) == [1, 3]


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def is_subsequence(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


@pytest.mark.parametrize("symbols", [1, 2, 3, 20, 200])
def test_common_lines_against_the_table(symbols):
    rng = random.Random(symbols)
    for _ in range(60):
        a, b = ([rng.randrange(symbols) for _ in range(rng.randrange(40))] for _ in range(2))
        for found in (html_main.common_lines(a, b), html_main.common_by_halves(a, b)):
            assert found == sorted(set(found)) and len(found) == longest(a, b) and is_subsequence([a[i] for i in found], b)


def test_many_equal_lines_are_aligned_in_time():
    begin = time.process_time()
    a, b = [1, 2] * 4000, [2, 1, 3] * 3000
    assert len(html_main.common_lines(a, b)) >= 6000 - 10
    assert time.process_time() - begin < 20


def test_pages_of_a_longer_host(spark):
    """Menus, notices and footers in plain elements, no article: only what a page alone has is left; settled alike however the pages are partitioned."""
    page = lambda k: "<body>" + "".join(f"<div>Menu entry {j}</div>" for j in range(12)) + f"<div>Breaking: notice of the day.</div><div>Story {k} opens here, and it goes on for a while with words of its own.</div><div>Second part of {k}, again of some length, so that it is text.</div><div>All rights reserved by the host.</div></body>"
    rows = [(h * 1000 + k, f"http://h{h}.org/s/{k:03}", page(h * 1000 + k)) for h in range(3) for k in range(40)]
    rows += rows[:5]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Story {i} opens here, and it goes on for a while with words of its own.\n\nSecond part of {i}, again of some length, so that it is text." for i, _, _ in rows}
    for n in (1, 4, 90):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = html_main.extracted(pages).collect()
        assert sorted((r.page_id, r.text, r.n_deleted) for r in got) == sorted((i, want[i], 14) for i, _, _ in rows)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_lines_of_articles_that_neighbours_share(spark):
    """Furniture inside articles goes where pages share it, sentences stay; copies tell nothing; adverts of one page go by structure."""
    page = lambda k: f"<nav>Home</nav><article><p>Share this</p><p>Both quote the same sentence of a poet here.</p><p>Text {k} is long enough to be the most of its page, with more words to follow.</p></article><div class='ad'>Buy {k}</div>"
    rows = [(k, f"http://h.org/{k}", page(k)) for k in range(4)] + [(9, "http://copy.org/1", page(7)), (10, "http://copy.org/2", page(7))]
    got = {r.page_id: r for r in html_main.extracted(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, Text string")).collect()}
    for k in range(4):
        assert got[k].text.split("\n\n") == ["Both quote the same sentence of a poet here.", f"Text {k} is long enough to be the most of its page, with more words to follow."]
        assert (got[k].n_deleted, got[k].n_structural) == (2, 1)
    assert got[9].text.startswith("Share this") and got[9].n_deleted == 2


def test_pages_of_a_host_lose_shared_lines(spark):
    page = lambda k: f"<body><div>Shared line of all pages.</div><div>Own text number {k}, long enough to tell this page from others, and then some more words.</div></body>"
    rows = [(k, f"http://h.org/a/{k}", page(k)) for k in range(5)] + [(9, None, None), (10, "http://other.net/", page(0)), (4, "http://h.org/a/4", page(4))]
    got = {(r.page_id, r.text, r.n_chars) for r in html_main.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Shared" not in t for i, t, _ in got if i < 4) and (9, "", 0) in got and all(n == len(t) for _, t, n in got)
    assert "Shared" in next(t for i, t, _ in got if i == 10)
    assert html_main.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/b\r\nc", "<title>T</title><p>one</p><a href='/x'>two</a>"), (2, None, None), (None, "http://é/", "é")]
    records = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    source = {warc.parse(bytes(r.record))[0]["warc-record-id"]: warc.parse(bytes(r.record)) for r in records.collect()}
    made = warc.derived(records)
    for r in made.collect():
        headers, block = warc.parse(bytes(r.record))
        assert headers["warc-refers-to"] in source and headers["warc-block-digest"] == warc.digest(block)
        assert source[r.refers_to][0]["warc-payload-digest"] == r.source_digest
    assert made.count() == 6
    warc.save(made, f"{tmp_path}/w")
    assert sorted(bytes(r.record) for r in warc.load(spark, f"{tmp_path}/w").collect()) == sorted(bytes(r.record) for r in made.collect())
    assert warc.derivatives(b"junk")[0][0] == "metadata"


def test_records_that_hold_record_heads_or_any_bytes(spark, tmp_path):
    """Files are read by lengths: a page may hold a version line, and payloads needn't be text."""
    inner = warc.response(7, "http://x/", "inside").decode()
    whole = [warc.response(1, "http://a/", f"before\r\n{inner}\r\nWARC/1.1\r\nafter"), warc.build([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:uuid:1>")], bytes(range(256)) * 9), warc.build([("WARC-Type", "warcinfo")], b"")]
    warc.save(spark.createDataFrame([(bytearray(r),) for r in whole], "record binary"), f"{tmp_path}/w")
    assert sorted(bytes(r.record) for r in warc.load(spark, f"{tmp_path}/w").collect()) == sorted(whole)
    (tmp_path / "plain.warc").write_bytes(b"junk line\r\n" + b"".join(whole))
    assert [bytes(r.record) for r in warc.load(spark, f"{tmp_path}/plain.warc").collect()] == [b"junk line\r\n", *whole]
    assert warc.derived(spark.createDataFrame([], "page_id long, record binary, Record string")).count() == 0


def test_repeated_rows_stay_within_the_budget(spark):
    rows = [(1, "a b c d e", "en", "src1")] * 3 + [(2, "v w x y z", "en", "src1"), (2, "v w x y z", "de", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for percent in (20, 60, 90, 150, 300):
        plan, out = mixing.drawn(docs, share_percent=percent).collect(), mixing.mixed(docs, share_percent=percent).collect()
        assert sum(r.take_tokens for r in plan) == sum(r.take_tokens for r in out) == sum(len(r.text.split()) for r in out) <= 25 * percent // 100
        assert Counter((r.doc_id, r.epoch, r.take_tokens, r.lang) for r in plan) == Counter((r.doc_id, r.epoch, r.take_tokens, r.lang) for r in out)


def test_mixing_sql_and_edges(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    against_sql(mixing.drawn(docs), mixing.oracle())
    assert mixing.drawn(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, 1), (1, "a b c d", None, None, 1), (1, "a b c d", "en", "src1", 1), (2, "", "en", "src1", 1)], "doc_id long, text string, lang string, source string, Domain int")
    assert mixing.mixed(odd, share_percent=100).where("text is null or text = ''").count() == 0


def test_base_scores_and_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (7_000_000, "")], "doc_id long, text string"))
    tokens = {r.doc_id: [*lm.words_of((r.text or "").encode()), lm.END] for r in docs.collect()}
    held = {i: i is None or crc32(str(i).encode()) % 10 == 0 for i in tokens}
    count = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(count.values()), len(count)
    gained = []
    for r in lm.scored(docs).collect():
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held[r.doc_id], len(ts), n, sum(t in count for t in ts))
        want = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0
        if r.held_out and r.n_tokens > 50:
            gained.append((r.score - r.base_score) / r.n_tokens)
    assert np.mean(gained) > 0


def test_scores_dont_depend_on_partitions_and_are_finite_without_training(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.lit(1).alias("Score"))
    one, many = ({(r.doc_id, r.held_out): r.score for r in lm.scored(d).collect()} for d in (docs.coalesce(1), docs.repartition(7, "text")))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-6 * abs(one[k]) for k in one)
    odd = spark.createDataFrame([(None, "a b c"), (None, None), (None, "  x\ty  ")], "doc_id long, text string")
    rows = lm.scored(odd).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3, 4] and all(math.isfinite(r.score) and r.score < 0 and r.held_out and r.train_tokens == 0 for r in rows)
    assert lm.scored(odd.limit(0)).count() == 0


def test_words_are_the_contracts():
    import pyarrow as pa

    texts = ["  A\x0bb\x0c\r c\t", "", None, "é\u00a0É\u2003x\x1cY", "plain words"]
    sizes, words = lm.all_words(pa.array(texts))
    want = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and [w.decode() for w in words.to_pylist()] == [x for w in want for x in w]
    assert [lm.words_of((t or "").encode()) for t in texts] == [[x.encode() for x in w] for w in want]


def test_network_against_plain_loops():
    """One text, item by item, with scalars."""
    rng = np.random.Generator(np.random.PCG64(9))
    flat = gru.start_weights(rng.integers(1, 50, gru.ITEMS).astype(float), seed=3)
    w, size = gru.views(flat), gru.HIDDEN
    text = rng.integers(0, gru.ITEMS, gru.STEPS + 9)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    h, total, last = [0.0] * size, 0.0, gru.START
    for item in text.tolist():
        hu = [sum(h[i] * float(w["u"][i, j]) for i in range(size)) for j in range(3 * size)]
        e = [float(x) for x in w["e"][last]]
        z, r = [sigmoid(e[j] + hu[j]) for j in range(size)], [sigmoid(e[size + j] + hu[size + j]) for j in range(size)]
        n = [math.tanh(e[2 * size + j] + r[j] * hu[2 * size + j]) for j in range(size)]
        h = [n[j] + z[j] * (h[j] - n[j]) for j in range(size)]
        logits = [float(w["cb"][c]) + sum(h[i] * float(w["c"][i, c]) for i in range(size)) for c in range(gru.CLASSES)]
        k = int(gru.CLASS_OF[item])
        total += logits[k] - math.log(sum(map(math.exp, logits)))
        if k < gru.WORD_CLASSES:
            logits = [float(w["mb"][k, m]) + sum(h[i] * float(w["m"][k, i, m]) for i in range(size)) for m in range(gru.MEMBERS)]
            total += logits[int(gru.MEMBER_OF[item])] - math.log(sum(map(math.exp, logits)))
        last = item
    assert abs(gru.scores(flat, [text])[0] - total) < 1e-3 * abs(total)


def test_outputs_are_a_distribution():
    counts = np.arange(gru.ITEMS, 0, -1).astype(float)
    run = gru.Run(gru.start_weights(counts))
    h = np.random.Generator(np.random.PCG64(1)).uniform(-1, 1, (1, gru.HIDDEN)).astype(np.float32)
    logp = run.outputs(np.repeat(h, gru.ITEMS, axis=0), np.arange(gru.ITEMS))[0]
    assert abs(np.exp(logp).sum() - 1) < 1e-4


def test_state_is_carried_across_windows():
    rng = np.random.Generator(np.random.PCG64(2))
    flat = gru.start_weights(np.ones(gru.ITEMS))
    text = rng.integers(0, gru.ITEMS, 3 * gru.STEPS + 5)
    x = np.concatenate([[gru.START], text[:-1]])[:, None]
    run = gru.Run(flat)
    whole = run.outputs(run.states(x, np.array([-1]))[:, 0], text)[0].sum()
    assert abs(gru.scores(flat, [text, text[:3]])[0] - whole) < 1e-2


def test_pipeline(spark):
    import corpus_pipeline
    from seqlattice.llm import decontam
    from test_decontam import brute as leaks
    from test_hypermin import brute as near

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    rules = {**quality.BASE_RULES, **quality.RULES}
    kept = {i: t for i, t in rows.items() if quality.verdict(quality.View((t or "").encode()), list(rules), rules)}
    kept = {i: t for i, t in kept.items() if near(kept.items(), 5)[i][1] == i} if len(kept) < 3 else {i: kept[i] for i, (_, c) in near(list(kept.items()), 5).items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {r[0] for r in leaks(list(kept.items()), [(str(a), b) for a, b in items]) if r[5]}
    kept = {i: pii.masked_text(t) for i, t in kept.items() if i not in bad}
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} <= set(kept) and len(corpus_pipeline.STAGES) == 5
    for r in out:
        whole = len(kept[r.doc_id].split())
        assert r.text == kept[r.doc_id] if r.take_tokens == whole else len(r.text.split()) == r.take_tokens < whole
    words = sum(len(t.split()) for t in kept.values())
    assert words * mixing.SHARE_PERCENT // 100 - 200 <= sum(r.take_tokens for r in out) <= words * mixing.SHARE_PERCENT // 100
    assert decontam is not None
