"""Personal data, found also where it is disguised, with offsets into the source.

Plain identifiers are found by the base patterns.  Then transducers rewrite
the text, and each keeps the ranges that it replaced, so that a place in the
rewritten text leads back to the range of the source that it came from:

* look-alike letters and wide digits become ASCII, zero-width marks vanish;
* runs with three named digits or more ("plus four nine ... dot ...") become
  digits, by a machine over words, digits, blanks and marks;
* bracketed "at" and "dot" become @ and full stops;
* so do spaced ones, also mixed with plain ones, where an address is around
  them.  Where a spaced "at" is the only disguise, a common word before it or
  an unknown ending after it means prose.

The base patterns run over the rewritten text; what they find there and the
source doesn't show as it stands is disguised.

Offsets count code points, ends are exclusive.  Nulls: a null text has no
spans, a null doc_id passes through.  Repeated rows give repeated results; an
empty table an empty one.  Each pattern and machine goes over a text once, so
a very long text is scanned whole; what is kept besides it grows with what is
rewritten, not with the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, pick, small_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that fails at its first digit fails at the others, so only first ones are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # kind's number, start, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, from each @ outwards: every match holds one, and its local part is all that can be before it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(free, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def plain(text: str) -> list[Span]:
    """The base spans, by start, then kind."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


# Letters of other scripts that look like ASCII ones, paired by position.
_LIKE = dict(zip("асеорхуіјѕԁһӏАВСЕНКМОРТХІЈЅοαινρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijsdhlABCEHKMOPTXIJSoaivpukABEZHIKMNOPTYX", strict=True))
_LIKE |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_LIKE |= {chr(base + k): str(k) for base in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
_LIKE |= {chr(0x2460 + k): str(k + 1) for k in range(9)}
_LIKE |= {" ": " ", "‑": "-", "‐": "-", "–": "-", "。": ".", "․": ".", "﹫": "@", "➕": "+"}
_LIKE_TABLE = str.maketrans(_LIKE)
#: Marks without width.
_GONE = "​‌‍⁠﻿­"
_ANY_GONE = re.compile("[" + _GONE + "]+")
_LIKELY = re.compile("[" + re.escape("".join(_LIKE)) + "]")

_NAMED = {w: str(k) for k, names in enumerate(
    ("zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre",
     "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")) for w in names.split()}
_TIMES = {"double": 2, "triple": 3}
_DOT_WORDS = frozenset("dot punkt punto point".split())
#: Three names one after the other, but for words that a run may hold.
_THREE = re.compile(rb"\x01\x02*\x01\x02*\x01")
_KIND_OF = dict.fromkeys((w.encode() for w in _NAMED), 1) | dict.fromkeys((w.encode() for w in (*_TIMES, *_DOT_WORDS, "plus")), 2)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[ \t]+|.", re.S)

_BRACKETED = re.compile(r"(?i)[\[({<][ \t]*+(?:(?P<at>at|arroba|@)|dot|punkt|punto|point|\.)[ \t]*+[\])}>]")
#: Unbracketed, where an address may have its @; what is on both sides decides.
_ANY_AT = re.compile(r"@|[Aa](?<=[ \t][Aa])[Tt](?=[ \t])")
_BLANKS = re.compile(r"[ \t]*+")
_HOST = re.compile(r"(?i)[a-z0-9-]++(?:(?:[ \t]++dot[ \t]++|\.)[a-z0-9-]++)*+")
_SPACED_DOT = re.compile(r"(?i)(?<![ \t])[ \t]++dot[ \t]++")
_SEPARATOR = re.compile(r"(?i)[ \t]++dot[ \t]++|\.")
_LAST = re.compile(r"(?i)[a-z]{2,}+(?!\w)")
_SPACED_IP = re.compile(r"(?i)(?<!\w)[0-9]{1,3}(?:(?:[ \t]++dot[ \t]++|\.)[0-9]{1,3}){3}(?!\w)")
#: With "at" as the only disguise ("jane at mail.com"), prose as "look at mail.com" is told by these words before it, and "at home.then" by its ending.
_BEFORE_AT = frozenset(
    "a about all also am an and any anyone are arrive arrived as aimed aimed available back based be been being both bought but buy call called can check click contact described directly directed documentation documented "
    "download email everyone everything find for found free go had hand has have he held her here him his host hosted i if in info information is it its job join joined just keep landed later learn left link live located "
    "login look looked looking looks made mail me meet meeting meets met more my near no not now of off on online only open or order our out over page pages people post posted price published read register registered "
    "released reached sale see seen sell service services she shop show sign site sites sold someone something staff starting stay stayed still store stored support team text that the their them then there these they "
    "thing things this those to today tickets up us use version visit was watch we website week were what when where which while who will with work worked working works write you your yours yourself".split())
_ENDINGS = frozenset("com org net edu gov mil int info biz io ai co me dev app eu uk us ca au nz ie de at ch fr es it pt nl be lu dk se no fi pl cz sk hu ro gr ru ua tr br mx ar cl pe in cn jp kr za".split())


Edit = tuple[int, int, str]  # start, end, what is put there


class Rewriting:
    """A text in which ranges, which ascend and don't overlap, are replaced; and the way back."""

    def __init__(self, text: str, edits: list[Edit]):
        self.edits, self.at = edits, []
        out, free, size = [], 0, 0
        for a, b, put in edits:
            out += [text[free:a], put]
            size += a - free
            self.at.append(size)
            size += len(put)
            free = b
        self.text = "".join([*out, text[free:]])

    def source(self, k: int) -> tuple[int, int]:
        """Where the character k came from."""
        i = bisect_right(self.at, k) - 1
        if i < 0:
            return k, k + 1
        a, b, put = self.edits[i]
        k -= self.at[i] + len(put)
        return (a, b) if k < 0 else (b + k, b + k + 1)


class Tape:
    """A text and its rewritings, one upon the other."""

    def __init__(self, text: str):
        self.first = self.text = text
        self.layers: list[Rewriting] = []

    def rewrite(self, edits: list[Edit]) -> None:
        if edits:
            self.layers.append(Rewriting(self.text, edits))
            self.text = self.layers[-1].text

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The range of the first text that a range of the last came from."""
        for layer in reversed(self.layers):
            a, b = layer.source(a)[0], layer.source(b - 1)[1]
        return a, b

    def made(self, a: int, b: int) -> bool:
        """Whether the first text has something else there."""
        s, e = self.source(a, b)
        return self.first[s:e] != self.text[a:b]


#: Bytes outside words become spaces.
_BETWEEN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Run:
    """The machine for spelled digits: items (named or plain digits) with gaps between them."""

    def __init__(self, text: str):
        self.text, self.out = text, []
        self.stop()

    def stop(self) -> None:
        """The run ends with its last item; it counts with three names or more."""
        if getattr(self, "names", 0) >= 3:
            self.out += self.edits
        self.edits: list[Edit] = []
        self.names, self.end, self.named, self.plus = 0, -1, False, -1
        self.clear()

    def clear(self) -> None:
        self.mark, self.times, self.times_at = "", 1, -1

    def item(self, a: int, b: int, digits: str, named: bool) -> None:
        begin = self.times_at if self.times > 1 else a
        if self.end < 0 and self.plus >= 0:
            self.edits.append((self.plus, begin, "+"))
        elif self.end >= 0 and begin > self.end:
            put = self.mark or ("" if named or self.named else self.text[self.end : begin])
            if put != self.text[self.end : begin]:
                self.edits.append((self.end, begin, put))
        if named or self.times > 1:
            self.edits.append((begin, b, digits[0] * (self.times - 1) + digits))
        self.names, self.named, self.end = self.names + named, named, b
        self.clear()

    def gap(self, mark: str) -> None:
        """One mark may be in a gap."""
        if self.end < 0 or self.mark or self.times > 1:
            self.stop()
        else:
            self.mark = mark

    def feed(self, a: int, b: int, token: str) -> None:
        c = token[0]
        if c in " \t":
            return
        if "0" <= c <= "9":
            self.item(a, b, token, False)
        elif c in "-.,()":
            self.gap(" " if c == "," else c)
        elif (word := token.lower()) in _NAMED:
            self.item(a, b, _NAMED[word], True)
        elif word in _TIMES and self.times == 1:
            self.times, self.times_at = _TIMES[word], a
        elif word in _DOT_WORDS:
            self.gap(".")
        else:
            self.stop()
            if word == "plus":
                self.plus = a


def look_alikes(text: str) -> str:
    """One character for one."""
    return text.translate(_LIKE_TABLE) if not text.isascii() and _LIKELY.search(text) else text


def widthless(text: str) -> list[Edit]:
    return [] if text.isascii() else [(m.start(), m.end(), "") for m in _ANY_GONE.finditer(text)]


def spelled_digits(text: str) -> list[Edit]:
    kinds = bytes(map(_KIND_OF.get, text.encode().translate(_BETWEEN).split(), repeat(0)))
    if not _THREE.search(kinds):
        return []
    run = Run(text)
    for m in _TOKEN.finditer(text):
        run.feed(m.start(), m.end(), m[0])
    run.stop()
    return run.out


def bracketed(text: str) -> list[Edit]:
    out, free = [], 0
    for m in _BRACKETED.finditer(text):
        a = m.start()
        while a > free and text[a - 1] in " \t":
            a -= 1
        free = _BLANKS.match(text, m.end()).end()
        out.append((a, free, "@" if m["at"] else "."))
    return out


def before(text: str, end: int, least: int) -> int:
    """Where the local part that ends here begins: pieces with spaced dots between them; end itself if there is none."""
    start, stop = end, end
    while True:
        at = stop
        while at > least and text[at - 1] in _LOCAL_CHARS:
            at -= 1
        if at == stop or (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            return start
        start = dot = at
        while dot > least and text[dot - 1] in " \t":
            dot -= 1
        if dot == start or text[max(dot - 3, least) : dot].lower() != "dot":
            return start
        stop = dot - 3
        while stop > least and text[stop - 1] in " \t":
            stop -= 1
        if stop == dot - 3:
            return start


def spaced(text: str, made: Callable[[int, int], bool]) -> list[Edit]:
    """Addresses with "at" or "dot" as words; with @ and full stops, rewritten ones too, among them."""
    out, free = [], 0
    for m in _ANY_AT.finditer(text):
        a, b = m.span()
        if a < free:
            continue
        word = m[0] != "@"
        if word:
            b = _BLANKS.match(text, b).end()
            while a > free and text[a - 1] in " \t":
                a -= 1
        if not (host := _HOST.match(text, b)):
            continue
        dots = list(_SEPARATOR.finditer(text, b, host.end()))
        while dots and not _LAST.match(text, dots[-1].end()):
            dots.pop()
        if not dots:
            continue
        start = before(text, a, free)
        if start == a:
            continue
        edits = [(x.start(), x.end(), ".") for x in _SPACED_DOT.finditer(text, start, a)]
        edits += [(a, b, "@")] * word
        edits += [(x.start(), x.end(), ".") for x in dots if x[0] != "."]
        if edits == [(a, b, "@")] and not any(made(*x.span()) for x in dots):
            if text[start:a].lower() in _BEFORE_AT or text[dots[-1].end() : _LAST.match(text, dots[-1].end()).end()].lower() not in _ENDINGS:
                continue
        out += edits
        free = _LAST.match(text, dots[-1].end()).end()
    taken = {x for a, b, _ in out for x in (a, b)}
    for whole in _SPACED_IP.finditer(text):
        out += [(m.start(), m.end(), ".") for m in _SPACED_DOT.finditer(text, whole.start(), whole.end()) if m.start() not in taken]
    return sorted(out)


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in source offsets; those inside a base span of their kind are left out."""
    tape = Tape(text)
    tape.text = look_alikes(text)
    for transducer in (widthless, spelled_digits, bracketed):
        tape.rewrite(transducer(tape.text))
    tape.rewrite(spaced(tape.text, tape.made))
    if tape.text == text:
        return []
    taken: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in base:
        taken.setdefault(k, []).append((a, b))
    out = []
    for k, a, b in plain(tape.text):
        if tape.made(a, b):
            s, e = tape.source(a, b)
            near = taken.get(k, [])
            i = bisect_right(near, (s, len(text))) - 1  # base spans of a kind don't overlap
            if i < 0 or near[i][1] < e:
                out.append((k, s, e))
    return out


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans, each by start, then kind."""
    base = plain(text) if text else []
    more = disguised(text, base) if text else []
    return base, sorted({*base, *more}, key=lambda s: (s[1], s[0], s[2])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256, spans (all of them), n_spans, n_disguised (those that aren't base)."""
    docs = pick(docs, doc_id="long", text="string")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, every, n_spans, more = [[] for _ in KINDS], [], [], [], []
            for value in batch.column(1):
                base, both = spans_of(value.as_py())
                for k, c in enumerate(counts):
                    c.append(sum(s[0] == k for s in base))
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(both))
                n_spans.append(len(both))
                more.append(len(both) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(every, pa.string()), pa.array(n_spans, pa.int64()), pa.array(more, pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_disguised"])

    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_disguised long")


def masked_text(text: str) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans, what the first leaves is covered as well."""
    spans = spans_of(text)[1]
    out, at = [], 0
    for k, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join(out) + text[at:] if out else text


def masked(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars, where there is one, counted anew."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked_text(t) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if size is not None:
                cols[size] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
