"""Mixing sources to target weights by hierarchical budgeting.

The leaves are the sources of each language of each domain.  A budget of
tokens runs down the tree: at each node the children share it by weight, none
above its capacity (its tokens times MAX_EPOCHS), and what a child can't take
goes to its siblings by weight; a node never gets more than its children can
take, so a shortage moves to the ancestors' siblings only when all siblings are
full.  Shares are whole tokens, rounded down.

A leaf's documents are then read epoch by epoch, each in an order of its own,
drawn by a seeded hash, until the leaf's budget is used; the last document is
taken in part.  For the place where that happens, tokens are summed by leaf
and hash bucket first, so that only one bucket's rows are ever put in order.

Native: DataFrame functions only.  Nulls: a null text has no tokens and is
never drawn; null languages and sources are '' in the result.  Repeated rows
are drawn as often as they are there.  An empty table gives an empty result.
Weights are whole numbers whose sum below a node is at most 10,000.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, pick, written

MAX_EPOCHS, SEED, SHARE_PERCENT = 3, 11, 60
LEVELS = ("domain", "lang", "source")

#: Weights by level and name; names that aren't here weigh 1.
WEIGHTS: Mapping[str, Mapping[str, int]] = {"domain": {"web": 3, "books": 2}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 2}}


def domain_of(source: Column) -> Column:
    """Sources end in a number: below 10 they are the web, from 10 on books; others have a domain of their own."""
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint)")
    return F.when(n < 10, "web").when(n >= 10, "books").otherwise("other")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the leaf, n_tokens, and mark: a digest that tells texts with one id apart."""
    docs = pick(docs, doc_id="long", text="string", lang="string", source="string")
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n_tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("mark"))
    return docs.withColumn("domain", domain_of(F.col("source")))


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def shared_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds `share`: what each child gets of its parent's `budget`, given `weight` and `cap`."""
    node = Window.partitionBy(*parents)
    order = node.orderBy(F.col("cap") / F.col("weight"), name)
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    out = children.withColumns({
        "caps": F.coalesce(F.sum("cap").over(above), F.lit(0)),
        "weights": F.sum("weight").over(node) - F.coalesce(F.sum("weight").over(above), F.lit(0)),
    }).withColumn("full", F.col("cap") * F.col("weights") <= (F.col("budget") - F.col("caps")) * F.col("weight"))
    out = out.withColumns({
        "rest": F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(node),
        "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(node),
    })
    return out.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(rest * weight) div open"))).drop("caps", "weights", "full", "rest", "open")


def budgets(leaves: DataFrame, share_percent: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, share) from leaves with their tokens."""
    leaves = leaves.where("tokens > 0").withColumn("cap", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    whole = domains.agg(F.least(F.expr(f"(sum(tokens) * {share_percent}) div 100"), F.sum("cap")).alias("budget"))
    domains = shared_out(domains.crossJoin(F.broadcast(whole)).withColumns({"weight": weight_of("domain", weights), "root": F.lit(0)}), ["root"], "domain")
    langs = shared_out(langs.join(domains.select("domain", F.col("share").alias("budget")), "domain").withColumn("weight", weight_of("lang", weights)), ["domain"], "lang")
    leaves = leaves.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    return shared_out(leaves.withColumn("weight", weight_of("source", weights)), ["domain", "lang"], "source").select(*LEVELS, "tokens", "share")


def drawn(docs: DataFrame, share_percent: int = SHARE_PERCENT, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, take_tokens (below n_tokens for a leaf's last document only), mark."""
    rows = written(measured(docs).where("n_tokens > 0"))
    shares = budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), share_percent, weights, max_epochs)
    shares = written(shares.select(*LEVELS, F.expr("share div tokens").alias("whole"), F.expr("share % tokens").alias("rest")))
    rows = rows.join(shares, list(LEVELS))
    all_of = rows.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"), F.col("n_tokens").alias("take_tokens"))

    part = rows.where("rest > 0").withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mark")))
    part = part.withColumn("bucket", F.substring("key", 1, 3))
    sums = part.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("inside"))
    below = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("inside").over(below), F.lit(0)))
    part = part.join(sums, [*LEVELS, "bucket"]).where("before < rest")
    clear = part.where("before + inside <= rest").withColumn("take_tokens", F.col("n_tokens"))
    in_bucket = Window.partitionBy(*LEVELS, "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    edge = part.where("before + inside > rest").withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(in_bucket), F.lit(0)))
    edge = edge.where("left > 0").withColumn("take_tokens", F.least("n_tokens", "left"))
    cols = ["doc_id", *LEVELS, "epoch", "n_tokens", "take_tokens", "mark"]
    out = all_of.select(*cols)
    for more in (clear, edge):
        out = out.unionByName(more.withColumn("epoch", F.col("whole")).select(*cols))
    return out


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The drawn documents with their columns, domain, epoch and take_tokens; the text of a part is its first words, joined by spaces.

    Rows repeated with id and text are numbered, and each is drawn at most once an epoch: as many whole as drawn() has, then one in part."""
    parts = drawn(docs, **parameters)
    whole = F.col("take_tokens") == F.col("n_tokens")
    parts = parts.groupBy("doc_id", "mark", "domain", "lang", "source", "epoch", "n_tokens").agg(F.sum(F.when(whole, 1).otherwise(0)).alias("p_whole"), F.max(F.when(~whole, F.col("take_tokens"))).alias("p_part"))
    rows, names = numbered(docs)
    key, text, lang, source = (F.col(f"_{names.index(c)}") if c in names else F.lit(None).cast("string") for c in ("doc_id", "text", "lang", "source"))
    # One key without nulls for numbering and join, so that texts are moved once.
    same = ["r_id", "r_mark", "r_lang", "r_source"]
    rows = rows.withColumns({"r_id": F.coalesce(key.cast("long").cast("string"), F.lit("")), "r_mark": F.md5(F.coalesce(text.cast("string"), F.lit(""))), "r_lang": F.coalesce(lang.cast("string"), F.lit("")), "r_source": F.coalesce(source.cast("string"), F.lit(""))})
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(1))))
    parts = parts.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).toDF("r_id", "r_mark", "domain", "r_lang", "r_source", "epoch", "n_tokens", "p_whole", "p_part")
    out = rows.join(parts, same)
    out = out.withColumn("take_tokens", F.when(F.col("copy") <= F.col("p_whole"), F.col("n_tokens")).when(F.col("copy") == F.col("p_whole") + 1, F.col("p_part"))).where("take_tokens is not null")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)")), F.lit(1), F.col("take_tokens").cast("int")), " ")
    put = F.when(F.col("take_tokens") < F.col("n_tokens"), cut).otherwise(text)
    extra = [c for c in ("domain", "epoch", "take_tokens") if c.lower() not in {n.lower() for n in names}]
    kept = [(put if n == "text" else F.col(f"_{i}")).alias(f"_{i}") for i, n in enumerate(names)]
    return out.select(*kept, *extra).toDF(*names, *extra)


def _level_sql(out: str, source: str, parents: str, name: str, weights: Mapping[str, int]) -> str:
    w = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"
    by = f"PARTITION BY {parents}" if parents else ""
    return f"""
{out}_a AS (SELECT *, {w} AS weight FROM {source}),
{out}_b AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
  sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({by} ORDER BY CAST(cap AS DOUBLE) / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights FROM {out}_a),
{out}_c AS (SELECT *, cap * weights <= (budget - caps) * weight AS is_full FROM {out}_b),
{out}_d AS (SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS rest, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS open_w FROM {out}_c),
{out} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (rest * weight) // open_w END AS share FROM {out}_d)"""


def oracle(docs: str = "documents", share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: Mapping[str, Mapping[str, int]] = WEIGHTS) -> str:
    return rf"""
WITH m AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens, md5(coalesce(text, '')) AS mark,
  TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT) AS num FROM {docs}),
r AS (SELECT doc_id, CASE WHEN num < 10 THEN 'web' WHEN num >= 10 THEN 'books' ELSE 'other' END AS domain, lang, source, n_tokens, mark FROM m WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, {max_epochs} * sum(n_tokens) AS cap FROM r GROUP BY ALL),
dom AS (SELECT domain, sum(cap) AS cap, sum(tokens) AS tokens FROM leaf GROUP BY domain),
dom0 AS (SELECT domain, cap, (SELECT least((sum(tokens) * {share_percent}) // 100, sum(cap)) FROM dom) AS budget FROM dom),{_level_sql("dom1", "dom0", "", "domain", weights["domain"])},
lang0 AS (SELECT l.domain, l.lang, l.cap, d.share AS budget FROM (SELECT domain, lang, sum(cap) AS cap FROM leaf GROUP BY ALL) l JOIN dom1 d ON l.domain = d.domain),{_level_sql("lang1", "lang0", "domain", "lang", weights["lang"])},
leaf0 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.cap, g.share AS budget FROM leaf l JOIN lang1 g ON l.domain = g.domain AND l.lang = g.lang),{_level_sql("leaf1", "leaf0", "domain, lang", "source", weights["source"])},
plan AS (SELECT domain, lang, source, share // tokens AS whole, share % tokens AS left_over FROM leaf1),
x AS (SELECT r.*, whole, left_over, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || mark) AS k FROM r JOIN plan USING (domain, lang, source)),
y AS (SELECT *, left_over - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM x)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_tokens AS BIGINT) AS take_tokens, mark FROM (SELECT *, unnest(range(0, CAST(whole AS BIGINT))) AS epoch FROM x)
UNION ALL SELECT doc_id, domain, lang, source, CAST(whole AS BIGINT), CAST(n_tokens AS BIGINT), CAST(least(n_tokens, room) AS BIGINT), mark FROM y WHERE room > 0
"""
