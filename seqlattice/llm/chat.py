"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, the assistant last.  Every source turn is kept: it stays as it
is, is relabelled, or is merged with the turn before it; empty turns may be
put in.  The cheapest repair is found by dynamic programming over the automaton
of legal turns, with the role written last as state.

Costs combine by (min, +), so a long conversation is cut into chunks by turn
number: each chunk becomes a small matrix of costs from entry to exit state,
the matrices of a conversation give the states at its chunks' borders, and the
chunks are then repaired on their own.

Order within a conversation: turn (null first), then role, then text; repeated
rows are turns of their own.  A null or unknown role fits none and has to be
relabelled; a null text is empty; turns without a conversation id form one
conversation.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pick

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = -1, 0, 1, 2
STATES = (START, SYSTEM, USER, ASSISTANT)
RELABEL, UNKNOWN, MERGE, INSERT = 60, 10, 12, 20
FAR = 1 << 60
CHUNK = 1024

#: Roles to put in, empty, between a state and a new turn; None: there is no way.
FILL: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
CLOSE: dict[int, tuple[int, ...]] = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def label_cost(role: str | None, to: int) -> int:
    return 0 if role == ROLES[to] else RELABEL if role in ROLES else UNKNOWN


def moves(role: str | None) -> list[tuple[int, int, int, bool]]:
    """(state, next state, cost, whether the turn is merged), for a source turn."""
    out = []
    for state in STATES:
        for to in (SYSTEM, USER, ASSISTANT):
            cost = label_cost(role, to)
            if (state, to) in FILL:
                out.append((state, to, cost + INSERT * len(FILL[state, to]), False))
            if state == to:
                out.append((state, to, cost + MERGE, True))
    return out


_MOVES = {role: moves(role) for role in (*ROLES, None)}


def moves_of(role: str | None) -> list[tuple[int, int, int, bool]]:
    return _MOVES.get(role) or _MOVES[None]


def matrix(roles: list[str | None]) -> list[int]:
    """The least cost from each entry state (rows) to each exit state over the turns."""
    rows = []
    for entry in STATES:
        cost = {s: 0 if s == entry else FAR for s in STATES}
        for role in roles:
            after = dict.fromkeys(STATES, FAR)
            for s, to, c, _ in moves_of(role):
                after[to] = min(after[to], cost[s] + c)
            cost = after
        rows += [cost[s] for s in STATES]
    return rows


def borders(matrices: list[list[int]]) -> list[int]:
    """The states at the borders of a conversation's chunks on a cheapest way, the start included."""
    costs = [{s: 0 if s == START else FAR for s in STATES}]
    for m in matrices:
        costs.append({to: min(costs[-1][s] + m[4 * i + j] for i, s in enumerate(STATES)) for j, to in enumerate(STATES)})
    end = min(STATES, key=lambda s: (costs[-1][s] + INSERT * len(CLOSE[s]), s))
    out = [end]
    for k in range(len(matrices) - 1, -1, -1):
        j = STATES.index(out[-1])
        out.append(min(STATES, key=lambda s: (costs[k][s] + matrices[k][4 * STATES.index(s) + j], s)))
    return out[::-1]


def path(roles: list[str | None], entry: int, leave: int) -> list[tuple[int, int, bool]]:
    """(state before, role given, merged) for each turn on a cheapest way between two states."""
    costs = [{s: 0 if s == entry else FAR for s in STATES}]
    for role in roles:
        after = dict.fromkeys(STATES, FAR)
        for s, to, c, _ in moves_of(role):
            after[to] = min(after[to], costs[-1][s] + c)
        costs.append(after)
    out, state = [], leave
    for k in range(len(roles) - 1, -1, -1):
        s, to, _, merged = min((m for m in moves_of(roles[k]) if m[1] == state), key=lambda m: (costs[k][m[0]] + m[2], m[3], m[0]))
        out.append((s, to, merged))
        state = s
    return out[::-1]


def opening(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


ENDING = "<|im_end|>\n"


def escaped(text: str | None) -> str:
    """Marks of the format inside a text lose their meaning by a space."""
    return (text or "").replace("<|im_", "< |im_")


def pieces(turns: list[tuple[str | None, str | None]], entry: int, leave: int, last: bool) -> list[tuple[int, int, str, str, str]]:
    """(turn's number, slot, action, role, rendered): in order, the rendered pieces of all chunks make up the conversation."""
    out = []
    for k, ((role, text), (state, to, merged)) in enumerate(zip(turns, path([r for r, _ in turns], entry, leave))):
        close = ENDING if state != START else ""
        if merged:
            out.append((k, 8, "merge" if role == ROLES[to] else "merge_relabel", ROLES[to], "\n\n" + escaped(text)))
            continue
        for slot, filler in enumerate(FILL[state, to]):
            out.append((k, slot, "insert", ROLES[filler], close + opening(filler)))
            close = ENDING
        out.append((k, 8, "keep" if role == ROLES[to] else "relabel", ROLES[to], close + opening(to) + escaped(text)))
    if last:
        for slot, filler in enumerate(CLOSE[leave]):
            out.append((len(turns) - 1, 9 + slot, "insert", ROLES[filler], ENDING + opening(filler)))
        k, slot, action, role, text = out[-1]
        out[-1] = (k, slot, action, role, text + ENDING)
    return out


def _segments(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal values in their first `key` columns, across batches."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for k, part in groupby(rows, key=lambda r: r[:key]):
        yield k, list(part)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, turn, copy (numbers equal turns), slot, action, role, rendered: a row for each source turn and each turn put in."""
    turns = pick(turns, conv_id="long", turn="long", role="string", text="string")
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).cast("long"))

    @lean
    def to_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, chunk), rows in _segments(batches, 2):
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([chunk], pa.int64()), pa.array([matrix([r[3] for r in rows])], pa.list_(pa.int64()))], ["conv_id", "chunk", "costs"])

    @lean
    def to_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in _segments(batches, 1):
            states = borders([r[2] for r in rows])
            n = len(rows)
            cols = [[conv] * n, [r[1] for r in rows], states[:-1], states[1:], [False] * (n - 1) + [True]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "chunk", "entry", "leave", "last"])

    @lean
    def to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), rows in _segments(batches, 2):
            out = pieces([(r[3], r[4]) for r in rows], *rows[0][5:8])
            copies, seen = [], {}
            for r in rows:
                copies.append(seen.setdefault(r[2], 0))
                seen[r[2]] += 1
            cols = [[conv] * len(out), [rows[p[0]][2] for p in out], [copies[p[0]] for p in out], *([p[i] for p in out] for i in (1, 2, 3, 4))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "turn", "copy", "slot", "action", "role", "rendered"])

    order = ["conv_id", "chunk", "turn", "role", "text"]
    placed = turns.select(*order).repartition("conv_id", "chunk").sortWithinPartitions(*order)
    costs = placed.mapInArrow(to_matrices, "conv_id long, chunk long, costs array<long>")
    edges = costs.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(to_borders, "conv_id long, chunk long, entry int, leave int, last boolean")
    edges = edges.withColumnRenamed("conv_id", "c").withColumnRenamed("chunk", "k")
    joined = turns.join(edges, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).select(*order, "entry", "leave", "last")
    joined = joined.repartition("conv_id", "chunk").sortWithinPartitions(*order)
    return joined.mapInArrow(to_pieces, "conv_id long, turn long, copy long, slot long, action string, role string, rendered string")
