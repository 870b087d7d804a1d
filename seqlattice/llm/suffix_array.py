"""Suffix arrays by linear grouping, without recursion.

Suffixes start out grouped by their first symbol.  Groups are taken in
descending order.  Each member points to the nearest position before it that
lies in a lower group; those positions are longer prefixes of what follows, so
they move, by how often they were pointed at, into new groups right above
their old ones.  In the end a group holds the suffixes with one longest Lyndon
prefix, and a pointer leads to the previous smaller suffix.  A second pass
runs over the array being filled and puts, for each suffix, the chain of
pointers that starts left of it to the next free places of their groups: every
group comes out in order.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The starts of the suffixes of a sequence of whole numbers >= 0 in ascending order; a shorter suffix comes before those it begins."""
    n = len(symbols) + 1
    text = [s + 1 for s in symbols] + [0]
    # Members of groups lie side by side; group[i] is where the group of i begins.
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n
    size = [0] * n
    start = 0
    for at, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = at
        place[i], group[i] = at, start
        size[start] += 1
    previous = [-1] * n
    top = n
    while top > 1:
        g = group[order[top - 1]]
        if top - g == 1:
            j = order[g] - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[order[g]] = j
            if j >= 0 and size[group[j]] > 1:
                _move((j,), order, place, group, size)
            top = g
            continue
        count: dict[int, int] = {}
        for i in sorted(order[g:top]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        if len(count) == 1:
            (j,) = count
            _move((j,), order, place, group, size)
        elif count:
            by_count: dict[int, list[int]] = {}
            for j, c in count.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                _move(by_count[c], order, place, group, size)
        top = g
    return _emit(order, group, previous, n)


def _move(items: Sequence[int], order: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Put items at the upper ends of their groups, as groups of their own, one for each old group."""
    old: dict[int, int] = {}
    for j in items:
        g = group[j]
        if size[g] == 1:
            continue
        last = g + size[g] - 1 - old.get(g, 0)
        other, at = order[last], place[j]
        order[at], order[last] = other, j
        place[other], place[j] = at, last
        old[g] = old.get(g, 0) + 1
    for g, moved in old.items():
        whole = size[g]
        if moved == whole:
            continue
        new = g + whole - moved
        size[g], size[new] = whole - moved, moved
        for at in range(new, g + whole):
            group[order[at]] = new


def _emit(order: list[int], group: list[int], previous: list[int], n: int) -> list[int]:
    free = list(range(n))
    out = [-1] * n
    out[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = previous[j]
    return out[1:]
