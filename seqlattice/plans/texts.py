"""Queries over texts and tables: normal forms, composed inputs, digests, caches, validation, export, safety."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import batches
from ..sources import tables
from ..sources.embedding import cache_status
from .registry import registered

#: The normal form in SQL, written out on its own: white space, zero-width marks, and each mark that goes.
_GONE_SQL = r"[\s\p{Z}\x{200b}\x{feff}\x1c-\x1f\x85、。，．,.・:：;；!！?？「」『』（）()\[\]［］【】〔〕〈〉《》“”\x22\x27\x60´]"


def _normal_sql(e: str) -> str:
    return f"regexp_replace(coalesce({e}, ''), '{_GONE_SQL}', '', 'g')"


def documents(spark, sf_dir) -> DataFrame:
    batches.small(spark)
    return tables.table(spark, sf_dir, "documents")


#: Texts with every mark, dropped and kept, and their normal forms.
_SPELLED = (
    (-1, "a、b。c，d．e,f.g・h:i：j;k；l!m！n?o？p「q」r『s』t（u）v(w)x[y]z［1］2【3】4〔5〕6〈7〉8《9》0“A”B\"C'D`E´F", "abcdefghijklmnopqrstuvwxyz1234567890ABCDE\u0301F"),  # the acute accent is composed to a blank and a combining one
    (-2, "a{b}c\u2018d\u2019e-f_g/h~i\u30fcj", "a{b}c\u2018d\u2019e-f_g/h~i\u30fcj"),
    (-3, " a\u3000b\tc\nd\u200be\ufefff\u00a0g ", "abcdefg"),
    (-4, "\uff21\uff11\u2460\uff76\uff9e\u33a1\ufb01", "A11\u30acm2fi"),
)
_SPELLED_SQL = " UNION ALL ".join(f"SELECT {k}, '{want}'" for k, _, want in _SPELLED)


@registered("normalize_documents", f"SELECT doc_id, {_normal_sql('text')} AS normalized FROM documents UNION ALL {_SPELLED_SQL}")
def normalize_documents(spark, sf_dir):
    """All documents, and a few texts that hold every mark; in SQL these have their normal forms written out."""
    spelled = spark.createDataFrame([(k, t) for k, t, _ in _SPELLED], "doc_id long, text string")
    return documents(spark, sf_dir).select("doc_id", "text").unionByName(spelled).select("doc_id", text.normalized(F.col("text")).alias("normalized"))


@registered("normalize_rows", f"SELECT doc_id, source, {_normal_sql('text')} AS normalized_original, {_normal_sql('lang')} AS normalized_kana, sha256(concat_ws(chr(10), nullif({_normal_sql('text')}, ''), nullif('theme: ' || trim(source), 'theme: '))) AS embedding_sha256 FROM documents")
def normalize_rows(spark, sf_dir):
    """A table's rows with the three columns of normal forms added."""
    rows = documents(spark, sf_dir).select("doc_id", "source", F.col("text").alias("waka_original"), F.col("lang").alias("waka_kana"), F.col("source").alias("theme"))
    return normalized_rows(rows, "original_tags").select("doc_id", "source", "normalized_original", "normalized_kana", F.sha2("embedding_text", 256).alias("embedding_sha256"))


def normalized_rows(rows: DataFrame, mode: str) -> DataFrame:
    """rows with normalized_original, normalized_kana and embedding_text; columns that aren't there count as empty."""
    col = lambda name: F.col(name) if name in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({
        "normalized_original": text.normalized(col("waka_original")), "normalized_kana": text.normalized(col("waka_kana")),
        "embedding_text": text.input_text(mode, col("waka_original"), col("waka_kana"), col("theme"), col("season"), col("notes"))})


MODES = ("original", "kana", "original_kana", "original_tags", "all")
_PARTS = {"original": ("text",), "kana": ("lang",), "original_kana": ("text", "lang"), "original_tags": ("text", "'theme: ' || source", "'season: ' || lang"), "all": ("text", "lang", "'theme: ' || source", "'season: ' || lang", "'notes: ' || nullif(trim(CAST(n_chars AS VARCHAR)), '')")}


def _mode_sql(mode: str) -> str:
    blank = {"text": f"nullif({_normal_sql('text')}, '')", "lang": f"nullif({_normal_sql('lang')}, '')"}
    return "concat_ws(chr(10), " + ", ".join(blank.get(p, p) for p in _PARTS[mode]) + ")"


@registered("embedding_text_modes", " UNION ALL ".join(f"SELECT doc_id, '{m}' AS mode, sha256({_mode_sql(m)}) AS text_sha256, length({_mode_sql(m)}) AS n_chars FROM documents" for m in MODES))
def embedding_text_modes(spark, sf_dir):
    docs = documents(spark, sf_dir)
    made = {m: text.input_text(m, F.col("text"), F.col("lang"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string")) for m in MODES}
    each = docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(m).alias("mode"), c.alias("t")) for m, c in made.items()))))
    return each.select("doc_id", "mode", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("n_chars"))


@registered("text_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def text_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@registered("embedding_records", "SELECT format('S{:06d}', doc_id) AS id, source AS poet, 'original' AS input_mode, 'local-64' AS model, sha256(" + _normal_sql('text') + ") AS text_sha256 FROM documents")
def embedding_records(spark, sf_dir):
    return documents(spark, sf_dir).select(F.format_string("S%06d", "doc_id").alias("id"), F.col("source").alias("poet"), F.lit("original").alias("input_mode"), F.lit("local-64").alias("model"), F.sha2(text.normalized(F.col("text")), 256).alias("text_sha256"))


_CACHED = "w AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS sha FROM documents), c AS (SELECT doc_id AS id, sha256(CASE WHEN source = 'src1' THEN text || '!' ELSE coalesce(text, '') END) AS sha FROM documents WHERE lang <> 'fr')"


@registered("cache_stale", f"WITH {_CACHED} SELECT coalesce(w.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'absent' WHEN w.id IS NULL THEN 'surplus' WHEN w.sha <> c.sha THEN 'stale' ELSE 'fresh' END AS status FROM w FULL JOIN c ON w.id = c.id")
def cache_stale(spark, sf_dir):
    """What of a cache of vectors can be used, with texts of one source changed and those of one language not in it yet."""
    docs = documents(spark, sf_dir)
    wanted = docs.select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    held = docs.where("lang <> 'fr'").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.coalesce("text", F.lit(""))), 256).alias("sha"))
    return cache_status(wanted, held)


def violations(df: DataFrame, name: str, key: str, low: int, high: int) -> DataFrame:
    """table_name, rule, key, n: blank, non-numeric, duplicate and out-of-range keys."""
    k = F.col(key).cast("string")
    number = text.int_or_null(k)
    rules = {"blank": text.blank_to_null(k).isNull(), "not a number": text.blank_to_null(k).isNotNull() & number.isNull(), "out of range": ~number.between(low, high)}
    found = df.select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.when(c, F.coalesce(k, F.lit(""))).alias("key")) for r, c in rules.items())))).where("key is not null").groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n"))
    twice = df.where(F.col(key).isNotNull()).groupBy(k.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate").alias("rule"), "key", "n")
    return found.unionByName(twice).select(F.lit(name).alias("table_name"), "rule", "key", "n")


_KEYS = (("documents", "doc_id", 1, 900), ("conversations", "conv_id", 0, 10_000_000), ("orders", "o_orderkey", 0, 10_000_000))


def _violations_sql(t: str, k: str, low: int, high: int) -> str:
    return f"SELECT '{t}' AS table_name, 'blank' AS rule, '' AS key, count(*) AS n FROM {t} WHERE {k} IS NULL HAVING count(*) > 0 UNION ALL SELECT '{t}', 'out of range', CAST({k} AS VARCHAR), count(*) FROM {t} WHERE {k} NOT BETWEEN {low} AND {high} GROUP BY {k} UNION ALL SELECT '{t}', 'duplicate', CAST({k} AS VARCHAR), count(*) FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} HAVING count(*) > 1"


@registered("validate_keys", " UNION ALL ".join(_violations_sql(*x) for x in _KEYS))
def validate_keys(spark, sf_dir):
    out = None
    for name, key, low, high in _KEYS:
        found = violations(tables.table(spark, sf_dir, name), name, key, low, high)
        out = found if out is None else out.unionByName(found)
    return out


_REQUIRED = {"documents": ("doc_id", "text", "lang", "source", "n_chars"), "labels": ("doc_id", "quality", "toxic", "reviewer"), "pages": ("page_id", "url", "html")}


@registered("table_status", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, {'CAST(NULL AS VARCHAR)' if t != 'labels' else chr(39) + 'reviewer' + chr(39)} AS missing_columns, CASE WHEN {str(t == 'labels').lower()} THEN 'ERROR' WHEN count(*) = 0 THEN 'SCHEMA-ONLY' ELSE 'OK' END AS status FROM {t}" for t in _REQUIRED))
def table_status(spark, sf_dir):
    """Required columns and rows of each table; no rows is a status of its own, not an error."""
    out = None
    for name, wanted in _REQUIRED.items():
        df = tables.table(spark, sf_dir, name)
        gone = ", ".join(c for c in wanted if c not in df.columns)
        status = F.lit("ERROR") if gone else F.when(F.col("n_rows") == 0, "SCHEMA-ONLY").otherwise("OK")
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(gone or None).cast("string").alias("missing_columns"), status.alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


@registered("completeness", "SELECT count(*) AS n_rows, count(*) FILTER (trim(coalesce(text, '')) <> '') AS n_filled, count(*) > 0 AND count(*) = count(*) FILTER (trim(coalesce(text, '')) <> '') AS ready FROM documents")
def completeness(spark, sf_dir):
    filled = F.count_if(text.blank_to_null(F.col("text")).isNotNull())
    n = F.count(F.lit(1))
    return documents(spark, sf_dir).agg(n.alias("n_rows"), filled.alias("n_filled"), ((n > 0) & (n == filled)).alias("ready"))


@registered("kanji_numbers", "SELECT k AS n, k AS parsed FROM (SELECT CAST(unnest(range(1, 101)) AS INT) AS k)")
def kanji_numbers(spark, sf_dir):
    ones = F.translate(F.when(F.col("n") % 10 > 0, (F.col("n") % 10).cast("string")).otherwise(""), "123456789", "一二三四五六七八九")
    tens = F.when(F.col("n") >= 20, F.concat(F.translate(F.floor(F.col("n") / 10).cast("string"), "123456789", "一二三四五六七八九"), F.lit("十"))).when(F.col("n") >= 10, "十").otherwise("")
    written = F.when(F.col("n") == 100, "百").otherwise(F.concat(tens, ones))
    return spark.range(1, 101).select(F.col("id").cast("int").alias("n")).select("n", text.kanji_number(written).alias("parsed"))


_EXPORT = """SELECT d.doc_id, nullif(trim(coalesce(d.lang, '')), '') AS lang,
  '{{"name":"' || d.source || '","number":' || TRY_CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS INT) || '}}' AS source,
  '{{"quality":' || l.quality || ',"toxic":' || l.toxic || '}}' AS metadata, {text}
FROM documents d LEFT JOIN (SELECT doc_id, arg_max(quality, (quality, toxic)) AS quality, arg_max(toxic, (quality, toxic)) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id"""


def records(spark, sf_dir, with_text: bool) -> DataFrame:
    """Public records: nested source, metadata where there is any, and the text or a note that it is left out."""
    labels = tables.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.struct("quality", "toxic")).alias("metadata"))
    number = text.int_or_null(F.regexp_extract("source", "([0-9]+)$", 1))
    out = documents(spark, sf_dir).join(labels, "doc_id", "left")
    body = F.col("text") if with_text else F.lit("omitted").alias("text_status")
    return out.select("doc_id", text.blank_to_null(F.col("lang")).alias("lang"), F.to_json(F.struct(F.col("source").alias("name"), number.alias("number"))).alias("source"), F.to_json("metadata").alias("metadata"), body)


@registered("export_records", _EXPORT.format(text="d.text"))
def export_records(spark, sf_dir):
    return records(spark, sf_dir, True)


@registered("export_records_redacted", _EXPORT.format(text="'omitted' AS text_status"))
def export_records_redacted(spark, sf_dir):
    return records(spark, sf_dir, False)


# Shapes of secrets, signs of local paths, and what an ignore file must name.
SECRETS = {
    "openai_key_like": r"sk-(?:proj-)?[A-Za-z0-9_\-]{20,}",
    "github_token_like": r"(?:ghp|github_pat)_[A-Za-z0-9_]{20,}",
    "private_key_block": r"-----BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----",
}
LOCAL_PATHS = ("/Users/", "/private/", "Documents/Codex", "file://")
IGNORED = ("_private/", "data/raw/", "data/embeddings/", "public/data/", ".env", "__pycache__/", "*.pyc", ".DS_Store")

_PLANTED = ("'s' || 'k-' || repeat('a1', 12)", "'gh' || 'p_' || repeat('Z9', 11)", "'-----BEGIN ' || 'RSA PRIVATE KEY-----'", "'see /' || 'Users/x and fi' || 'le://y'", "'clean'")
_SCANNED = "t AS (SELECT CAST(doc_id AS VARCHAR) AS name, coalesce(text, '') AS text FROM documents UNION ALL " + " UNION ALL ".join(f"SELECT 'planted{k}', {e}" for k, e in enumerate(_PLANTED)) + ")"


def scanned(spark, sf_dir) -> DataFrame:
    """name, text: all documents and a few texts that hold what is looked for."""
    planted = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(f"planted{k}").alias("name"), F.expr(e).alias("text")) for k, e in enumerate(_PLANTED)))))
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text")).unionByName(planted)


@registered("secret_scan", f"WITH {_SCANNED}, p(kind, pattern) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SECRETS.items()) + ") SELECT name, kind FROM t, p WHERE regexp_matches(text, pattern)")
def secret_scan(spark, sf_dir):
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), k) for k, p in SECRETS.items())))
    return scanned(spark, sf_dir).select("name", F.explode(hits).alias("kind"))


@registered("path_marker_scan", f"WITH {_SCANNED}, p(marker) AS (VALUES " + ", ".join(f"('{m}')" for m in LOCAL_PATHS) + ") SELECT name, marker FROM t, p WHERE contains(text, marker)")
def path_marker_scan(spark, sf_dir):
    hits = F.array_compact(F.array(*(F.when(F.contains("text", F.lit(m)), m) for m in LOCAL_PATHS)))
    return scanned(spark, sf_dir).select("name", F.explode(hits).alias("marker"))


@registered("required_markers", "WITH w(marker) AS (VALUES " + ", ".join(f"('{m}')" for m in IGNORED) + "), h(marker) AS (VALUES ('_private/'), ('.env'), ('x.pyc')) SELECT 'missing' AS error, marker FROM w WHERE marker NOT IN (SELECT marker FROM h) UNION ALL SELECT 'forbidden', marker FROM h WHERE suffix(marker, '.pyc')")
def required_markers(spark, sf_dir):
    """What an ignore file lacks, and names that must not be published."""
    wanted = spark.createDataFrame([(m,) for m in IGNORED], "marker string")
    held = spark.createDataFrame([("_private/",), (".env",), ("x.pyc",)], "marker string")
    return wanted.join(held, "marker", "left_anti").select(F.lit("missing").alias("error"), "marker").unionByName(held.where("endswith(marker, '.pyc')").select(F.lit("forbidden").alias("error"), "marker"))


#: Wiki text of three records (number, verse, author, source), and the records.
_WIKI = (
    ("二", "春過ぎて<br/>夏来にけらし（はるすぎて<br />なつきにけらし）", "[[持統天皇]]<br>（じとう）", "新古今集 夏 175"),
    ("百", "\'\'\'百敷や\'\'\'<br>古き軒端の", "[[順徳院]]", "無名集 恋 7"),
    ("二十三", "月見れば&nbsp;<br/>千々に（つきみれば<br/>ちぢに）", "大江千里<br>（おおえ）", "古今集 秋上"),
)
WIKI = "{|\n" + "".join(f"!style=\"x\"|<span id=\"a\">{n}</span>\n|{v}\n|{a}\n|{s}\n" for n, v, a, s in _WIKI) + "!style=\"no span\"|x\n|}"
_RECORDS = (
    (2, "持統天皇", "じとう", "春過ぎて 夏来にけらし", "はるすぎて なつきにけらし", "春過ぎて", "夏来にけらし", "新古今集", "夏", "175", "夏", "夏"),
    (100, "順徳院", "", "百敷や 古き軒端の", "", "百敷や", "古き軒端の", "", "無名集恋", "7", "恋", ""),
    (23, "大江千里", "おおえ", "月見れば 千々に", "つきみれば ちぢに", "月見れば", "千々に", "古今集", "秋上", "", "秋", "秋"),
)
_FIELDS = "id poet poet_kana original kana upper lower anthology book number theme season".split()


@registered("wiki_rows", f"SELECT * FROM (VALUES {', '.join(map(repr, _RECORDS))}) r({', '.join(_FIELDS)})")
def wiki_rows(spark, sf_dir):
    """Records of wiki text, which goes through the parser as lines with their numbers."""
    from ..operators.wiki import records as parsed

    lines = spark.createDataFrame(list(enumerate(WIKI.split("\n"))), "line_no long, line string")
    return parsed(lines)
