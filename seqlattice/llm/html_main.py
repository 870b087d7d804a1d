"""Main text of HTML pages, by differences to the nearest page and by structure.

A page is read into lines, one for each block, all of them but what no browser
shows as text (scripts, styles, form fields, ...).  A line's place is noted:
inside an article or main element, outside any, or inside an element that says
what it is (navigation, forms, adverts, comments, ...) by tag, role or name.
A page's own lines are those of its articles or, where it has none, those
outside of elements that say what they are.

1. Each page is paired, within its host, with the neighbour in URL order that
   shares the longer start of the path, all their lines are aligned by longest
   common subsequence, and shared lines are deleted.  Spared are shared own
   lines inside an article that read like sentences, since an article may quote
   or repeat another, and the own lines of copies: a neighbour that shares half
   of an article's characters, or nine tenths of the own lines of a page
   without one, is a copy and tells nothing about them; then the other
   neighbour is asked.
2. What is left and isn't among the page's own lines goes by structure: an
   advert that only one page has looks like its text otherwise.

The pages are put in a global order once, in partitions.  A page whose
neighbour is in another partition is settled with those of other partitions'
ends, in as many rounds as it takes until one small task has the last ones.
Only hashes and sizes of lines are moved for this; what pages lose is then
sent to the lines if it is small (a count is taken), else joined.

Nulls: a null html gives an empty text; pages without url form a host of their
own; a null page_id passes through.  Repeated rows count as one page and have
the same result.  An empty table gives an empty result.  A page that ends
early is read to its end; nothing is capped, and many equal lines are aligned
in words of bits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import lean, pick, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never a page's own.
OUT_TAGS = frozenset("aside audio button canvas datalist dialog form head iframe label map menu nav noembed noframes noscript object option script select style svg template textarea title video".split())
#: Of these, what isn't text to a reader at all and makes no lines.
NO_TEXT = frozenset("audio canvas datalist head iframe map noembed noframes noscript object option script select style svg template textarea title video".split())
#: Left out unless inside an article, where they hold its title or notes.
FRAME_TAGS = frozenset(("header", "footer"))
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUT_NAMES = frozenset(
    "ad ads adbox advert advertisement adverts advertising banner breadcrumb breadcrumbs captcha comment commentlist comments consent cookie cookies disclaimer discussion disqus gdpr login menu modal nav navbar navigation newsletter "
    "notice notices notification pager paginate pagination paywall popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe "
    "subscription tags toolbar widget widgets".split())
FRAME_NAMES = frozenset("footer header masthead topbar colophon copyright".split())
ARTICLE_TAGS = frozenset(("article", "main"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: An open element that ends when one of these begins.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
P_ENDERS = BLOCK - {"summary", "caption", "legend"}
_NAME_PARTS = re.compile(r"[a-z]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SENTENCE = re.compile(r"[.!?…:;。！？]['\")\]»”’]*$")

ARTICLE, FURNITURE, OUTSIDE, NAMED = 0, 1, 2, 3
FEW_WORDS = 5
#: Rows that the last round of pairing settles in one task.
LAST_ROWS = 2000
#: What pages lose is sent to all executors up to so many numbers (keys and lines).
FEW_NUMBERS = 10_000_000

Line = tuple[str, int]  # text, place


def _named(value: str) -> set[str]:
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
    return set(_NAME_PARTS.findall(spaced.lower()))


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, left out, article, no text
        self.parts: list[str] = []
        self.named: list[str] = []  # what is left out
        self.link_chars = 0
        self.in_link = 0
        self.lines: list[Line] = []

    def _left_out(self, tag: str, attrs: dict[str, str | None], article: bool) -> bool:
        if tag in OUT_TAGS or tag in FRAME_TAGS and not article:
            return True
        if tag in ("html", "body"):
            return False
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN_STYLE.search((attrs.get("style") or "").lower()):
            return True
        if (attrs.get("role") or "").lower() in OUT_ROLES:
            return True
        if tag in ARTICLE_TAGS and not article and not _named(f"{attrs.get('class') or ''} {attrs.get('id') or ''}") & {"comment", "comments", "ad", "ads", "related", "reply"}:
            return False
        names = set().union(*(_named(attrs.get(k) or "") for k in ("class", "id")))
        return bool(names & OUT_NAMES or not article and names & FRAME_NAMES)

    def handle_starttag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        attrs = {k: v for k, v in reversed(pairs)}
        if tag in ("body", "article", "main"):  # what must have ended before, ends
            while self.open and self.open[-1][0] in ("head", "title"):
                self.open.pop()
        if tag in P_ENDERS:
            self._end_inner("p", frozenset(("table", "td", "th", "li", "div", "section", "article", "aside", "blockquote", "form", "button")))
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self.handle_endtag(self.open[-1][0])
        if tag in BLOCK or tag == "br":
            self.flush() if tag in BLOCK else self.space()
        if tag in ("td", "th"):
            self.space()
        if tag in VOID:
            return
        _, out, article, mute = self.open[-1] if self.open else ("", False, False, False)
        out = out or self._left_out(tag, attrs, article)
        self.open.append((tag, out, article or tag in ARTICLE_TAGS and not out, mute or tag in NO_TEXT))
        self.in_link += tag == "a"

    def handle_startendtag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, pairs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag in ("svg", "path", "iframe", "i", "span", "use"):
            self.handle_endtag(tag)

    def _end_inner(self, tag: str, walls: frozenset[str]) -> None:
        """Ends an open element unless a wall is between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._cut(k)
                return
            if self.open[k][0] in walls:
                return

    def _cut(self, k: int) -> None:
        if any(x[0] in BLOCK for x in self.open[k:]):
            self.flush()
        self.in_link -= sum(x[0] == "a" for x in self.open[k:])
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._cut(k)
                return
            if self.open[k][0] in ("article", "main", "table") and tag not in BLOCK:
                return
        if tag in BLOCK:
            self.flush()

    def space(self) -> None:
        (self.named if self.open and self.open[-1][1] else self.parts).append(" ")

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            if not self.open[-1][3]:
                self.named.append(data)
            return
        self.parts.append(data)
        if self.in_link:
            self.link_chars += len(data)

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                place = OUTSIDE
                if self.open and self.open[-1][2]:
                    furniture = 2 * self.link_chars >= len(text) or len(text.split()) < FEW_WORDS and not _SENTENCE.search(text)
                    place = FURNITURE if furniture else ARTICLE
                self.lines.append((text, place))
            self.parts, self.link_chars = [], 0
        if self.named:
            if text := " ".join("".join(self.named).split()):
                self.lines.append((text, NAMED))
            self.named = []


def lines_of(html: str | None) -> list[Line]:
    """All lines of a page."""
    if not html:
        return []
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.lines


def own_places(places: list[int]) -> tuple[int, ...]:
    """Where the page's own lines lie."""
    return (ARTICLE, FURNITURE) if ARTICLE in places or FURNITURE in places else (OUTSIDE,)


def place_of(url: str | None) -> tuple[str, str]:
    """Host and path (with query, without fragment)."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b (by longest ascending runs of matches)."""
    front = 0
    while front < min(len(a), len(b)) and a[front] == b[front]:
        front += 1
    back = 0
    while back < min(len(a), len(b)) - front and a[-1 - back] == b[-1 - back]:
        back += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - back - 1, front - 1, -1):
        where.setdefault(b[j], []).append(j)
    inner = a[front : len(a) - back]
    if sum(len(where.get(x, ())) for x in inner) > 8 * (len(a) + len(b)):
        middle = [front + k for k in common_by_halves(inner, b[front : len(b) - back])]
        return [*range(front), *middle, *range(len(a) - back, len(a))]
    tails: list[int] = []
    links: list[tuple[int, object]] = []  # of each length, the last match and the chain before it
    for i in range(front, len(a) - back):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    middle, chain = [], links[-1] if links else None
    while chain:
        middle.append(chain[0])
        chain = chain[1]
    return [*range(front), *reversed(middle), *range(len(a) - back, len(a))]


def prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of a and each start of b, a word of bits for each line of a."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    whole = (1 << len(b)) - 1
    state = whole
    for x in a:
        hit = state & masks.get(x, 0)
        state = ((state + hit) | (state - hit)) & whole
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_by_halves(a: list[int], b: list[int]) -> list[int]:
    """As common_lines, however often lines repeat: a is halved, and b where both halves then have most in common."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    mid = len(a) // 2
    j = int((prefix_lengths(a[:mid], b) + prefix_lengths(a[mid:][::-1], b[::-1])[::-1]).argmax())
    return common_by_halves(a[:mid], b[:j]) + [mid + k for k in common_by_halves(a[mid:], b[j:])]


Page = tuple  # page_id, url, tag, host, path, hashes and sizes (characters * 4 + place) of all lines, whether it is settled


def alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def to_delete(page: Page, before: Page | None, after: Page | None) -> set[int]:
    """The numbers of the page's lines that differencing deletes."""
    near = [p for p in (before, after) if p is not None and p[3] == page[3]]
    near.sort(key=lambda p: -alike(p[4], page[4]))
    places, sizes = [s & 3 for s in page[6]], [s >> 2 for s in page[6]]
    own = own_places(places)
    total = sum(n for n, p in zip(sizes, places) if p in own)
    gone: set[int] = set()
    for p in near:
        shared = common_lines(page[5], p[5])
        gone |= {i for i in shared if places[i] not in own}
        common = sum(sizes[i] for i in shared if places[i] in own)
        if 10 * common < (9 if own == (OUTSIDE,) else 5) * total:
            return gone | {i for i in shared if places[i] in own and places[i] != ARTICLE}
    return gone


def result(page: Page, gone: set[int]) -> tuple:
    """page_id, url, tag, which of its own lines the page loses by differences, and how many of all."""
    places = [s & 3 for s in page[6]]
    own = own_places(places)
    at = [i for i, p in enumerate(places) if p in own]
    return *page[:3], [k for k, i in enumerate(at) if i in gone], len(gone)


_KEY = ["host", "path", "page_id", "url", "tag"]
_PAGE = "page_id long, url string, tag long, host string, path string, hashes array<long>, sizes array<long>, settled boolean"
_PAGE_NAMES = [x.split()[0] for x in _PAGE.split(", ")]
_PAGE_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
_OUT = "p long, u string, t long, gone array<long>, n_gone long"
_OUT_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_OUT_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def parsed(pages: DataFrame) -> DataFrame:
    """What pairing needs of the pages, their own lines, and how many others there are."""
    schema = _PAGE + ", lines array<string>, n_other long"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = []
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                    lines = lines_of(html)
                    own = own_places([p for _, p in lines])
                    mine = [t for t, p in lines if p in own]
                    rows.append((page_id, url, xxh3_64_intdigest((html or "").encode()) - (1 << 63), *place_of(url), [xxh3_64_intdigest(t.encode()) - (1 << 63) for t, _ in lines],
                                 [len(t) * 4 + p for t, p in lines], False, mine, len(lines) - len(mine)))
                yield _batch(rows, [*_PAGE_NAMES, "lines", "n_other"], [*_PAGE_KINDS, pa.list_(pa.string()), pa.int64()])

    return pages.mapInArrow(run, schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Page]:
    """The pages, of equal ones next to each other one."""
    held: list | None = None
    for row in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
        if held and row[:3] == tuple(held[:3]):
            held[7] = held[7] or row[7]
            continue
        if held:
            yield tuple(held)
        held = list(row)
    if held:
        yield tuple(held)


def _neighbours(rows: Iterator[Page]) -> Iterator[tuple[Page, Page | None, Page | None]]:
    before = here = None
    for after in rows:
        if here is not None:
            yield here, before, after
        before, here = here, after
    if here is not None:
        yield here, before, None


def settled(ordered: DataFrame, last: bool) -> DataFrame:
    """From pages in order: what those lose that have both neighbours here (all, if last), and the pages at the ends of partitions with those next to them.

    A page that is there for another one's sake counts as settled."""
    ends = _OUT + ", " + _PAGE
    none_out, none_page = (None,) * len(_OUT_NAMES), (None,) * len(_PAGE_NAMES)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        previous: Page | None = None
        for k, (page, before, after) in enumerate(_neighbours(_each(batches))):
            outer = not last and (before is None or after is None)
            if not page[7] and not outer and (gone := to_delete(page, before, after)):
                held.append((*result(page, gone), *none_page))
            if outer:
                held.append((*none_out, *page))
                if after is None and k > 2:
                    held.append((*none_out, *previous[:7], True))
            elif not last and k == 1:
                held.append((*none_out, *page[:7], True))
            previous = page
            if len(held) >= 500:
                yield _batch(held, _OUT_NAMES + _PAGE_NAMES, _OUT_KINDS + _PAGE_KINDS)
                held = []
        if held:
            yield _batch(held, _OUT_NAMES + _PAGE_NAMES, _OUT_KINDS + _PAGE_KINDS)

    return ordered.select(*_PAGE_NAMES).mapInArrow(run, ends)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text (lines joined by two line ends), n_chars, n_deleted (lines deleted by differences), n_structural (further lines left out by structure)."""
    pages = pick(pages, page_id="long", url="string", html="string")
    read, done = written(parsed(pages)), None
    rows = read.select(*_PAGE_NAMES)
    ordered = rows.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    while True:
        round_ = written(settled(ordered, last=False))
        lost = round_.where("n_gone is not null").select(*_OUT_NAMES)
        done = lost if done is None else done.unionByName(lost)
        rows = round_.where("n_gone is null").select(*_PAGE_NAMES)
        n = rows.count()
        if n <= LAST_ROWS:
            break
        ordered = rows.repartitionByRange(-(-4 * n // LAST_ROWS), *_KEY).sortWithinPartitions(*_KEY)
    done = written(done.unionByName(settled(rows.repartition(1).sortWithinPartitions(*_KEY), last=True).select(*_OUT_NAMES)))
    weight = done.agg(F.sum(F.size("gone") + 4)).first()[0] or 0
    done = F.broadcast(done) if weight <= FEW_NUMBERS else done
    joined = read.join(done, F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("tag") == F.col("t")), "left")
    kept = F.when(F.size("gone") > 0, F.filter("lines", lambda x, i: ~F.array_contains("gone", i.cast("long")))).otherwise(F.col("lines"))
    out = joined.select("page_id", "url", F.array_join(kept, "\n\n").alias("text"), F.coalesce("n_gone", F.lit(0).cast("long")).alias("n_deleted"), (F.col("n_other") - F.coalesce(F.col("n_gone") - F.size("gone"), F.lit(0))).cast("long").alias("n_structural"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_deleted", "n_structural")
