"""Content-defined anchors: positions that depend on nearby bytes only.

For every SPAN-byte string of a text, the anchor is the leftmost GRAM-byte
string inside it with the smallest hash.  Equal SPAN-byte strings have their
anchors at the same offset, so all occurrences of a string meet at the hash of
one anchor.  Consecutive string starts with one anchor form a run; a run's
context is the bytes that its strings cover.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

SPAN, GRAM = 100, 32
CHOICES = SPAN - GRAM + 1

_rng = np.random.Generator(np.random.PCG64(77003))
#: Two of each, for two hashes that have nothing to do with each other.
_BYTE = _rng.integers(0, 1 << 64, (2, 256), np.uint64)
_STEP = _rng.integers(0, 1 << 64, (2, 8), np.uint64) | np.uint64(1)
_LOW = np.uint64(127)


def _joined(a: np.ndarray, b: np.ndarray, step: np.uint64) -> np.ndarray:
    out = a * step
    out += b
    out ^= out >> np.uint64(29)
    return out


def hashes(data: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the hash of the GRAM bytes and of the SPAN bytes from there."""
    level, step, by = _BYTE[salt][data], _STEP[salt], {1: None}
    by[1] = level
    size, k = 1, 0
    while size * 2 <= 64:
        level = _joined(level[:-size], level[size:], step[k])
        size, k = size * 2, k + 1
        by[size] = level
    n = len(data) - SPAN + 1
    whole = _joined(_joined(by[64][:n], by[32][64 : 64 + n], step[6]), by[4][96 : 96 + n], step[7])
    return by[GRAM], whole


def anchor_offsets(gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n string starts, the anchor's hash (its upper 57 bits) and offset."""
    key = gram & ~_LOW
    size = 1
    while size * 2 <= CHOICES:
        key = np.minimum(key[:-size], key[size:] + np.uint64(size))
        size *= 2
    rest = CHOICES - size
    if rest:
        key = np.minimum(key[:-rest], key[rest:] + np.uint64(rest))
    key = key[:n]
    return key & ~_LOW, (key & _LOW).astype(np.int64)


def runs(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts of the given sizes, one after the other in data: text number, first string start (from the text's own start), count of starts, anchor hash, context hash.

    The context hash covers the run's whole context, as its first and last
    strings overlap, and the offset of the anchor in it.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    n = len(data) - SPAN + 1
    if n <= 0:
        return none
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    gram, whole = hashes(data)
    anchor, offset = anchor_offsets(gram, n)
    inside = text[:n] == text[SPAN - 1 :]
    place = np.arange(n) + offset
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (text[1:n] != text[: n - 1])
    lo = np.flatnonzero(fresh)
    if not len(lo):
        return none
    last = inside.copy()
    last[:-1] &= ~inside[1:] | fresh[1:]
    hi = np.flatnonzero(last)
    count = hi - lo + 1
    context = mix64(whole[lo] * np.uint64(0xD6E8FEB86659FD93) + mix64(whole[hi] + (offset[lo] * 128 + count).astype(np.uint64)))
    return text[lo], lo - begin[text[lo]], count, anchor[lo], context
