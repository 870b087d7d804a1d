"""Queries over HTML pages: facts, lint, links, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import html
from ..sources import tables
from .registry import ORACLES, registered

#: Two pages besides those of the table: one with nothing to find fault with, one with a fault of each kind.
PLANTED = (
    (-1, "http://planted.org/planted/one.html", """<html><head><link rel="canonical" href="/planted/one.html"><meta name="description" content="d"><meta name="twitter:card" content="c"><meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:url" content="u"><meta property="og:image" content="i"></head><body><h1 id="top">T</h1><img src="data:a" alt="A" loading="lazy" decoding="async"><a href="#top">up</a><a href="/planted/two.html#here">two</a><a href="#none">none</a></body></html>"""),
    (-2, "http://planted.org/planted/two.html", """<html><body><p id="here">x</p><p id="here">y</p><p id="there">z</p><img src="/b.png" alt="" loading="eager"><img src="data:c" alt="C" loading="lazy"><a name="spot" href="/planted/one.html#nowhere">one</a><a href="/planted/gone.html">gone</a><a href="?q=1">self</a><a href="#spot">spot</a><a href="https://else.org/#x">else</a></body></html>"""),
)
_PAGES = "(SELECT page_id, url, html FROM pages UNION ALL " + " UNION ALL ".join(f"SELECT {i}, '{u}', '{h}'" for i, u, h in PLANTED) + ")"
#: Regular expressions see start tags where the parser does, if neither comments nor scripts hold any; those are taken out first.
_BARE = rf"b AS (SELECT page_id, url, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '(<script[^>]*>).*?</script>', '\1', 'gs') AS html FROM {_PAGES})"
_LINKS = rf"WITH {_BARE}, t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:a|link|img|script)\s[^>]*>')) AS tag FROM b), l AS (SELECT page_id, regexp_extract(tag, '^<([a-z]+)', 1) AS tag, CASE WHEN tag LIKE '<a %' OR tag LIKE '<link %' THEN 'href' ELSE 'src' END AS attr, tag AS raw FROM t), u AS (SELECT page_id, tag, attr, regexp_extract(raw, '\s' || attr || '=\"([^\"]*)\"', 1) AS url FROM l WHERE regexp_matches(raw, '\s' || attr || '='))"


def all_pages(spark, sf_dir) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(list(PLANTED), "page_id long, url string, html string"))


def page_facts(spark, sf_dir) -> DataFrame:
    return html.facts(all_pages(spark, sf_dir))


@registered("page_links", rf"{_LINKS} SELECT page_id, tag, attr, url, regexp_matches(url, '^(http|https|mailto|tel|data|javascript):') OR starts_with(url, '//') AS outside FROM u")
def page_links(spark, sf_dir):
    return html.links(page_facts(spark, sf_dir)).select("page_id", "tag", "attr", "url", "outside")


@registered("page_duplicate_ids", rf"WITH {_BARE}, i AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z][^>]*\sid=\"([^\"]*)\"', 1)) AS id FROM b) SELECT page_id, id, count(*) AS n FROM i GROUP BY page_id, id HAVING count(*) > 1")
def page_duplicate_ids(spark, sf_dir):
    return html.duplicate_ids(page_facts(spark, sf_dir))


@registered("page_canonical", rf"WITH {_BARE} SELECT page_id, CAST(len(regexp_extract_all(html, '<link[^>]*rel=\"canonical\"')) AS BIGINT) AS n_canonical FROM b WHERE len(regexp_extract_all(html, '<link[^>]*rel=\"canonical\"')) <> 1")
def page_canonical(spark, sf_dir):
    return page_facts(spark, sf_dir).where("n_canonical <> 1").select("page_id", "n_canonical")


@registered("page_meta_gaps", rf"WITH {_BARE}, w(kind, name) AS (VALUES ('name', 'description'), ('name', 'twitter:card'), ('property', 'og:title'), ('property', 'og:description'), ('property', 'og:url'), ('property', 'og:image')) SELECT page_id, kind, name FROM b, w WHERE NOT regexp_matches(html, '<meta[^>]*\s' || kind || '=\"' || name || '\"')")
def page_meta_gaps(spark, sf_dir):
    return html.meta_gaps(page_facts(spark, sf_dir))


@registered("page_image_lint", rf"WITH {_BARE}, i AS (SELECT page_id, unnest(regexp_extract_all(html, '<img\s[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '<img\s[^>]*>'), 1) AS image FROM b), c(error, want) AS (VALUES ('no alt text', '\salt=\"[^\"]'), ('not lazy-loaded', '\sloading=\"lazy\"'), ('no async decoding', '\sdecoding=\"async\"')) SELECT page_id, CAST(image AS INT) AS image, error FROM i, c WHERE NOT regexp_matches(tag, want)")
def page_image_lint(spark, sf_dir):
    return html.image_errors(page_facts(spark, sf_dir))


def site_paths(spark, sf_dir) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return all_pages(spark, sf_dir).select("page_id", path.alias("path")).where("path <> ''")


_PATHS = r"p AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, min(page_id) AS to_id FROM b GROUP BY 1)"
_STATUS = rf"""{_LINKS}, {_PATHS},
r AS (SELECT page_id, url, url_decode(regexp_extract(url, '^([^?#]*)', 1)) AS path, regexp_extract(url, '#(.*)$', 1) AS fragment FROM u WHERE NOT (regexp_matches(url, '^(http|https|mailto|tel|data|javascript):') OR starts_with(url, '//'))),
q AS (SELECT page_id, url, fragment, CASE WHEN path LIKE '%/' THEN path || 'index.html' ELSE path END AS path FROM r),
f AS (SELECT q.page_id, q.url, q.fragment, q.path IN ('', '.') AS self, CASE WHEN q.path IN ('', '.') THEN q.page_id ELSE p.to_id END AS to_id FROM q LEFT JOIN p ON p.path = q.path AND p.path <> ''),
i AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z][^>]*\sid="([^"]*)"', 1)) AS fragment FROM b UNION SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*\bname="([^"]*)"', 1)) FROM b)
SELECT page_id, 'target missing' AS error, url FROM f WHERE to_id IS NULL UNION ALL SELECT f.page_id, 'anchor missing', f.url FROM f LEFT JOIN i ON i.page_id = f.to_id AND i.fragment = f.fragment WHERE f.to_id IS NOT NULL AND f.fragment <> '' AND i.page_id IS NULL"""


@registered("page_link_status", _STATUS)
def page_link_status(spark, sf_dir):
    return html.link_errors(page_facts(spark, sf_dir), site_paths(spark, sf_dir))


_CSS = r"WITH s AS (SELECT page_id AS source, regexp_extract(html, '(?s)<style[^>]*>(.*?)</style>', 1) || ' a{background:url(''/x/' || page_id || '.png'')} b{src:url(f.woff)}' AS text FROM pages) SELECT source, unnest(list_transform(regexp_extract_all(text, 'url\([^)]+\)'), lambda x: trim(regexp_replace(x, '^url\([''\"]?|[''\"]?\)$', '', 'g')))) AS url FROM s"


@registered("css_assets", _CSS)
def css_assets(spark, sf_dir):
    style = F.regexp_extract("html", r"(?s)<style[^>]*>(.*?)</style>", 1)
    more = F.format_string(" a{background:url('/x/%d.png')} b{src:url(f.woff)}", "page_id")
    return html.css_urls(tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("source"), F.concat(style, more).alias("text")))


@registered("css_missing", rf"WITH {_BARE}, {_PATHS}, c AS ({_CSS} UNION ALL SELECT -1, '/planted/one.html?v=2' UNION ALL SELECT -1, 'data:x' UNION ALL SELECT -1, '/planted/none.css'), d AS (SELECT source, url, url_decode(regexp_extract(url, '^([^?#]*)', 1)) AS path FROM c WHERE NOT (regexp_matches(url, '^(http|https|mailto|tel|data|javascript):') OR starts_with(url, '//'))) SELECT source, url FROM d WHERE path <> '' AND path NOT IN (SELECT path FROM p WHERE path <> '')")
def css_missing(spark, sf_dir):
    """What style sheets ask for and no page answers to."""
    planted = spark.createDataFrame([(-1, "/planted/one.html?v=2"), (-1, "data:x"), (-1, "/planted/none.css")], "source long, url string")
    return html.css_errors(css_assets(spark, sf_dir).unionByName(planted), site_paths(spark, sf_dir))


_KINDS = {"duplicate id": "page_duplicate_ids", "canonical": "page_canonical", "meta": "page_meta_gaps", "image": "page_image_lint", "link": "page_link_status"}


@registered("lint_summary", " UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS n, count(*) = 0 AS passed FROM ({ORACLES[name]})" for kind, name in _KINDS.items()))
def lint_summary(spark, sf_dir):
    """Errors by kind, and whether the pages pass."""
    facts = page_facts(spark, sf_dir)
    kinds = {"duplicate id": html.duplicate_ids(facts), "canonical": facts.where("n_canonical <> 1"), "meta": html.meta_gaps(facts), "image": html.image_errors(facts), "link": html.link_errors(facts, site_paths(spark, sf_dir))}
    out = None
    for kind, errors in kinds.items():
        row = errors.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n", (F.col("n") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


@registered("html_to_markdown")
def html_to_markdown(spark, sf_dir):
    return html.markdown(tables.table(spark, sf_dir, "pages"))


@registered("asset_names", r"WITH i AS (SELECT lang AS slug, doc_id AS place, '/img/' || source || CASE WHEN n_chars > 1000 THEN '.jpg?v=1' ELSE '' END AS src FROM documents), n AS (SELECT *, regexp_extract(regexp_extract(src, '^([^?#]*)', 1), '([^/]*)$', 1) AS base FROM i), s AS (SELECT slug, place, src, regexp_extract(base, '^([^.]*)', 1) AS stem, CASE WHEN base LIKE '%.%' THEN regexp_extract(base, '(\.[^.]+)$', 1) ELSE '.png' END AS ext FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY slug, stem, ext ORDER BY place) AS k FROM s) SELECT slug, place, src, slug || '_' || stem || CASE WHEN k > 1 THEN '_' || k ELSE '' END || ext AS name FROM k")
def asset_names(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    src = F.concat(F.lit("/img/"), "source", F.when(F.col("n_chars") > 1000, ".jpg?v=1").otherwise(""))
    return html.asset_names(docs.select(F.col("lang").alias("slug"), F.col("doc_id").alias("place"), src.alias("src")))
