"""Chat formatting with role repair of minimum cost.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the last one an
assistant's.  Dynamic programming over that automaton chooses for every turn whether it keeps its role, is relabelled
or joins the turn before it, and where empty turns are inserted, so that the sum of costs is least.

The step from turn to turn is a product of small matrices over (min, +), so a conversation can be cut anywhere:
rows are range-partitioned in conversation order, every partition sums up the piece it holds of a conversation that
goes on elsewhere as one matrix, the matrices of neighbouring pieces meet on the driver (two a partition at
most), and each partition then traces its own piece between the states found there.  No conversation has to fit into
one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, free_name, shared_dir

#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
INF = float("inf")
#: Other names of roles.
SAME = {"human": "user", "prompter": "user", "bot": "assistant", "model": "assistant", "gpt": "assistant", "ai": "assistant", "developer": "system"}


@dataclass(frozen=True)
class Costs:
    """relabel: another role than the turn's own; unknown: any role for a turn whose role is none of the three; merge: joining the turn before; insert: an empty turn."""

    relabel: float = 3.0
    unknown: float = 1.0
    merge: float = 1.0
    insert: float = 2.0


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn's text, and between the texts of merged turns."""

    before: str = "<|{role}|>\n"
    after: str = "<|end|>\n"
    between: str = "\n"


def role_of(name: str | None) -> int:
    name = (name or "").strip().lower()
    name = SAME.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


def steps(prev: int, own: int, costs: Costs) -> list[tuple[float, int, str]]:
    """What may be done with a turn of role ``own`` after state ``prev``: cost, next state, how (insert holds the role of the empty turn)."""
    out = []
    for role in (SYSTEM, USER, ASSISTANT):
        base = 0.0 if role == own else costs.unknown if own == 0 else costs.relabel
        if role == SYSTEM:
            if prev == START:
                out.append((base, role, "keep"))
            elif prev == SYSTEM:
                out.append((base + costs.merge, role, "merge"))
            continue
        other = USER + ASSISTANT - role
        if prev == role:
            out.append((base + costs.merge, role, "merge"))
            out.append((base + costs.insert, role, "insert"))
        elif prev == other or role == USER:
            out.append((base, role, "keep"))
        else:  # an assistant's turn with no user's before it
            out.append((base + costs.insert, role, "insert"))
    return out


def closing(state: int, costs: Costs) -> float:
    """Cost of ending in a state: user turns get an empty answer, a system turn alone an empty question and answer."""
    return {START: 0.0, SYSTEM: 2 * costs.insert, USER: costs.insert, ASSISTANT: 0.0}[state]


def _forward(start: list[float], roles: list[int], table: dict) -> list[list[tuple[float, int, str]]]:
    """For each turn and state: least cost, the state before, how.  Ties go to the earlier state, then keep, merge, insert."""
    rows, cost = [], start
    for own in roles:
        best: list[tuple[float, int, str]] = [(INF, 0, "")] * 4
        for prev in range(4):
            if cost[prev] < INF:
                for c, state, how in table[prev, own]:
                    if cost[prev] + c < best[state][0]:
                        best[state] = (cost[prev] + c, prev, how)
        rows.append(best)
        cost = [b[0] for b in best]
    return rows


def _table(costs: Costs) -> dict:
    return {(p, o): steps(p, o, costs) for p in range(4) for o in range(4)}


def matrix(roles: list[int], costs: Costs) -> list[list[float]]:
    """Least cost from each state before a piece to each state after it."""
    table = _table(costs)
    return [[b[0] for b in _forward([0.0 if i == s else INF for i in range(4)], roles, table)[-1]] for s in range(4)]


def trace(roles: list[int], costs: Costs, begin: int = START, end: int | None = None) -> list[tuple[int, str]]:
    """The cheapest (role, how) of every turn of a piece from state ``begin``; to ``end``, or to the cheapest close."""
    rows = _forward([0.0 if i == begin else INF for i in range(4)], roles, _table(costs))
    if end is None:
        end = min(range(4), key=lambda s: (rows[-1][s][0] + closing(s, costs), s))
    out = []
    for row in reversed(rows):
        _, prev, how = row[end]
        out.append((end, how))
        end = prev
    return out[::-1]


def render(text: str | None, role: int, how: str, prev: int, last: bool, template: Template) -> str:
    """The turn's part of the rendered conversation.  What closes a turn is written by the next one that does not join it."""
    shut = template.after if prev != START else ""
    empty = lambda r: template.before.format(role=ROLES[r]) + template.after
    if how == "merge":
        out = template.between
    else:
        out = shut + (empty(USER + ASSISTANT - role) if how == "insert" else "") + template.before.format(role=ROLES[role])
    out += text or ""
    if last:
        out += template.after + {SYSTEM: empty(USER) + empty(ASSISTANT), USER: empty(ASSISTANT)}.get(role, "")
    return out


def _meet(pieces: list, costs: Costs) -> tuple[dict, dict, dict, set]:
    """For each piece of a conversation that is cut: the state before it, the state after it (absent at the end), turns before it; and which go on.

    ``pieces``: for each partition at most its first and last conversation, so a short list.
    """
    entry, leave, offset, goes_on = {}, {}, {}, set()
    rows = sorted(pieces, key=lambda r: (r.piece, not r.is_first))
    chains: list[list] = []
    for r in rows:
        before = chains[-1][-1] if chains else None
        if before is not None and before.piece != r.piece and before.is_last and r.is_first and (before.null_key, before.key) == (r.null_key, r.key):
            chains[-1].append(r)
        else:
            chains.append([r])
    for chain in (c for c in chains if len(c) > 1):
        marks = [(r.piece, "first" if r.is_first else "last") for r in chain]
        cost, back = [0.0, INF, INF, INF], []
        for r in chain:
            m = [r.m[i * 4 : i * 4 + 4] for i in range(4)]
            step = [min((cost[p] + m[p][s], p) for p in range(4)) for s in range(4)]
            back.append([p for _, p in step])
            cost = [c for c, _ in step]
        state = min(range(4), key=lambda s: (cost[s] + closing(s, costs), s))
        n = 0
        for mark, r in zip(marks, chain):
            offset[mark] = n
            n += r.n
        for mark, prevs in zip(reversed(marks), reversed(back)):
            leave[mark] = state
            state = prevs[state]
            entry[mark] = state
        goes_on.update(marks[:-1])
    return entry, leave, offset, goes_on


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(), template: Template = Template()) -> DataFrame:
    """``turns`` with position (from 0 in its conversation), new_role, action and rendered, a row for each turn.

    The rendered parts of a conversation, joined by position, are the repaired conversation.  Turns stand in the order
    of turn (null first), role, text.

    Defined cases: a null conversation id is a conversation of its own; null or unknown roles get the role that costs
    least; null text renders as empty; repeated rows are turns of their own; an empty table gives an empty result.
    Existing columns of the new names push underscores before the new ones.
    """
    spark = turns.sparkSession
    new = {n: free_name(turns, n) for n in ("position", "new_role", "action", "rendered")}
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col(f"`{c}`").asc_nulls_first() for c in (conv_col, turn_col, role_col, text_col)]
    pid = free_name(turns, "piece")
    shared_dir(spark)
    # a checkpoint keeps the partitions as they are: both passes below see the same pieces
    kept = turns.repartitionByRange(n, *order[:3], F.xxhash64(F.col(f"`{text_col}`"))).sortWithinPartitions(*order).withColumn(pid, F.spark_partition_id().cast("long")).checkpoint()

    def groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
        """(first, last, key, rows) of the conversations of a sorted partition, one at a time."""
        key, rows, first = None, [], True
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if rows and row[0] != key:
                    yield first, False, key, rows
                    rows, first = [], False
                key = row[0]
                rows.append(row)
        if rows:
            yield first, True, key, rows

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last conversation of a partition: turns and matrix."""
        at, found = None, []

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal at
            for b in batches:
                if at is None and b.num_rows:
                    at = b.column(pid)[0].as_py()
                yield b

        for first, last, key, rows in groups(noted(), [conv_col, role_col]):
            if first or last:
                m = matrix([role_of(r) for _, r in rows], costs)
                found.append((at, first, last, key is None, str(key), len(rows), [x for line in m for x in line]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], names=["piece", "is_first", "is_last", "null_key", "key", "n", "m"])

    met = kept.select(f"`{conv_col}`", f"`{role_col}`", f"`{pid}`").mapInArrow(ends, "piece long, is_first boolean, is_last boolean, null_key boolean, key string, n long, m array<double>").collect()
    entry, leave, offset, goes_on = _meet(met, costs)

    schema = T.StructType(list(turns.schema.fields)).add(new["position"], "long").add(new["new_role"], "string").add(new["action"], "string").add(new["rendered"], "string")
    names = [c for c in kept.columns if c != pid]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fields = None, None

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal at, fields
            for b in batches:
                if b.num_rows:
                    at, fields = b.column(pid)[0].as_py(), b.schema
                    yield b

        k, r, t = names.index(conv_col), names.index(role_col), names.index(text_col)
        order_ = [conv_col, *names]
        pending: list[tuple] = []
        size = 0
        for is_first, is_last, _, rows in groups(noted(), order_):
            mark = (at, "first" if is_first else "last" if is_last else "")
            begin, end = entry.get(mark, START), leave.get(mark)
            base = offset.get(mark, 0)
            done = trace([role_of(row[r + 1]) for row in rows], costs, begin, end)
            prev = begin
            for i, (row, (role, how)) in enumerate(zip(rows, done)):
                last = i + 1 == len(done) and mark not in goes_on
                pending.append((*row[1:], base + i, ROLES[role], how if role == role_of(row[r + 1]) else "relabel" if how == "keep" else f"relabel+{how}", render(row[t + 1], role, how, prev, last, template)))
                prev = role
                size += len(pending[-1][-1])
                if len(pending) >= 2000 or size >= SLICE_BYTES:
                    yield batch_of(pending, fields)
                    pending, size = [], 0
        if pending:
            yield batch_of(pending, fields)

    def batch_of(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*rows))
        types = [fields.field(c).type for c in names] + [pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names=[*names, *new.values()])

    return kept.mapInArrow(run, schema)
