"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, user first, assistant last.  Dynamic programming over that
automaton (states: start, system, user, assistant) finds the cheapest repair of
a sequence of turns by

* keeping a turn (free) or relabelling it (``RELABEL``),
* merging it into the turn before (``MERGE``; with a relabelling if the roles differ),
* inserting an empty user or assistant turn (``INSERT``).

Equal costs are settled at the latest turn where two repairs differ, by the order
keep, merge, relabel, insert, then by the state before it (start, system, user,
assistant); if no turn settles it, by the last state, assistant first.  The
repaired sequence is then rendered.

Scale: rows are dealt in order over range partitions, and a conversation that
lies inside one partition is repaired at once; one that may reach over an edge is
gathered first.  One of more than ``BLOCK`` turns or ``BLOCK_BYTES`` of text is
worked in blocks: a block is reduced to its matrix of least costs between entry and exit states, with
the order of the entries that equal costs prefer; matrices compose by (min, +)
products, which gives each block its entry and exit state, and the block is then
repaired on its own.  Where blocks are cut does not change the result.

A conversation is one row.  One of more than ``BLOCK`` turns or ``BLOCK_BYTES`` of
text has a row for each of its ``n_parts`` parts; joined in order, their `actions`
and `rendered` are the conversation's, for any cut.  cost, n_turns and n_repaired
are the conversation's in every row.

Results for odd input: turns are taken in the order (turn, role, text), nulls
first; a role outside system, user and assistant is relabelled at cost; a null
text counts as empty; repeated rows are turns of their own; rows with a null
conv_id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import materialize

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, INSERT = 1, 2, 3
BLOCK, BLOCK_BYTES = 1024, 4 << 20
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"

#: From a state, the roles that may follow at once.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
BIG = 1 << 40


def moves(state: int, role: int) -> list[tuple[int, int, str, tuple[int, ...], int]]:
    """(cost, preference, action, inserted states, new state) for a turn of this role; role 0 is an unknown one."""
    out = []
    for insert in ((), (USER,), (ASSISTANT,)):
        at = state
        for s in insert:
            at = s if s in NEXT[at] else -1
        if at < 0:
            continue
        for to in NEXT[at]:
            same = to == role
            out.append((INSERT * len(insert) + (0 if same else RELABEL), 0 if same and not insert else 2 if not insert else 3, "keep" if same else "relabel", insert, to))
        if not insert and state != START:
            same = state == role
            out.append((MERGE + (0 if same else RELABEL), 1, "merge" if same else "merge relabel", (), state))
    return sorted(out)


MOVES = {(s, r): moves(s, r) for s in range(4) for r in range(4)}


def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and inserted states that make a state a legal end; no turns at all are legal."""
    return {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}[state]


def forward(roles: list[int], entry: int) -> tuple[list[int], list[list[tuple | None]]]:
    """Least cost of each exit state from one entry state, and for each turn and state how it was best reached."""
    cost, back = [BIG] * 4, []
    cost[entry] = 0
    for role in roles:
        best: list[tuple | None] = [None] * 4
        for state in range(4):
            if cost[state] < BIG:
                for c, pref, action, inserted, to in MOVES[state, role]:
                    key = (cost[state] + c, pref, state)
                    if best[to] is None or key < best[to][0]:
                        best[to] = (key, state, action, inserted)
        cost = [b[0][0] if b else BIG for b in best]
        back.append(best)
    return cost, back


def repair(roles: list[int], entry: int, exit_state: int) -> list[tuple[str, tuple[int, ...], int]]:
    """For each turn: action, states inserted before it, state it ends in."""
    _, back = forward(roles, entry)
    out, state = [], exit_state
    for best in reversed(back):
        _, before, action, inserted = best[state]
        out.append((action, inserted, state))
        state = before
    return out[::-1]


def trace(back: list[list[tuple | None]], state: int) -> tuple[list[tuple[int, int]], int]:
    """What the order of equal costs looks at, from the latest turn on: preference and earlier state; and the turns begun."""
    out, begun = [], 0
    for best in reversed(back):
        (_, preference, before), _, action, inserted = best[state]
        out.append((preference, before))
        begun += len(inserted) + (not action.startswith("merge"))
        state = before
    return out, begun


@dataclass
class Summary:
    """Of a block, by entry and exit state: least cost, place of that repair among all where costs are equal, turns it begins."""

    cost: np.ndarray
    rank: np.ndarray
    begun: np.ndarray


def summary(roles: list[int]) -> Summary:
    out = Summary(*(np.zeros((4, 4), np.int64) for _ in range(3)))
    ways = []
    for entry in range(4):
        cost, back = forward(roles, entry)
        out.cost[entry] = cost
        for exit_state in range(4):
            if cost[exit_state] < BIG:
                keys, out.begun[entry, exit_state] = trace(back, exit_state)
                ways.append((keys, -exit_state, entry))
    for place, (_, exit_state, entry) in enumerate(sorted(ways)):
        out.rank[entry, -exit_state] = place
    return out


def path(blocks: list[Summary]) -> tuple[list[int], int, int]:
    """States at the borders of the blocks of the chosen repair from START, its cost and its turns, both with the closing ones."""
    cost, costs = np.full(4, BIG), []
    cost[START] = 0
    for block in blocks:
        costs.append(cost)
        cost = np.minimum((cost[:, None] + block.cost).min(0), BIG)

    def entry_to(k: int, state: int) -> int:
        return min(range(4), key=lambda s: (costs[k][s] + blocks[k].cost[s, state], blocks[k].rank[s, state]))

    state = min(range(4), key=lambda s: (cost[s] + closing(s)[0], blocks[-1].rank[entry_to(-1, s), s]))
    least, begun, states = int(cost[state]) + closing(state)[0], len(closing(state)[1]), [state]
    for k in range(len(blocks) - 1, -1, -1):
        entry = entry_to(k, state)
        begun += int(blocks[k].begun[entry, state])
        state = entry
        states.append(state)
    return states[::-1], least, begun


def _role(name: str | None) -> int:
    return ROLES.index(name) + 1 if name in ROLES else 0


def render_turns(roles: list[int], texts: list[str], entry: int, exit_state: int, last: bool) -> tuple[str, str, int]:
    """Rendered block, its actions and its number of turns; a block begins inside the turn that the block before left open."""
    out, actions, state, n = [], [], entry, 0
    for (action, inserted, to), text in zip(repair(roles, entry, exit_state), texts, strict=True):
        if action.startswith("merge"):
            out.append("\n" + text)
        else:
            for s in (*inserted, to):
                out.append((CLOSE if state != START else "") + OPEN.format(ROLES[s - 1]))
                state, n = s, n + 1
            out.append(text)
        actions.append("+".join([*("insert " + ROLES[s - 1] for s in inserted), action]))
        state = to
    if last:
        for s in closing(state)[1]:
            out.append(CLOSE + OPEN.format(ROLES[s - 1]))
            actions.append("insert " + ROLES[s - 1])
            n += 1
        out.append(CLOSE if roles or state != START else "")
    return "".join(out), ",".join(actions), n


PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_parts", pa.int64()), ("cost", pa.int64()), ("n_turns", pa.int64()), ("n_repaired", pa.int64()), ("actions", pa.string()), ("rendered", pa.string())])
PARTS_DDL = "conv_id long, part long, n_parts long, cost long, n_turns long, n_repaired long, actions string, rendered string"
_OPEN = [("task", pa.int64()), ("nth", pa.int64()), ("roles", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))]
WORKED = pa.schema([*PARTS, *_OPEN])
WORKED_DDL = PARTS_DDL + ", task long, nth long, roles array<long>, texts array<string>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def whole(conv_id: int | None, roles: list[int], texts: list[str]) -> tuple:
    """The row of a conversation that is at hand whole."""
    cost, back = forward(roles, START)
    ends = [c + closing(s)[0] for s, c in enumerate(cost)]
    tied = [s for s in range(4) if ends[s] == min(ends)]
    end = tied[0] if len(tied) == 1 else min(tied, key=lambda s: (trace(back, s)[0], -s))
    text, actions, n = render_turns(roles, texts, START, end, True)
    return conv_id, 0, 1, ends[end], len(roles), n, actions, text


def _work(block: int, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over a range partition in order: rows of whole conversations, and open blocks of those that are long or touch an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, first, held = TaskContext.get().partitionId(), 0, True, 0
        out: list[tuple] = []
        begun, cut, conv, roles, texts = False, False, None, [], []

        def close(edge: bool) -> int:
            nonlocal nth
            if first or edge or cut:
                out.append((conv, *[None] * 7, task, nth, list(roles), list(texts)))
                nth += 1
            else:
                out.append((*whole(conv, roles, texts), *[None] * 4))
            n = sum(map(len, texts))
            roles.clear()
            texts.clear()
            return n

        size = 0
        for b in batches:
            for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if begun and conv_id != conv:
                    held += close(False)
                    first, cut, size = False, False, 0
                elif len(roles) >= block or (roles and size + len(text or "") > block_bytes):
                    cut = True
                    held += close(False)
                    size = 0
                begun, conv = True, conv_id
                roles.append(_role(role))
                texts.append(text or "")
                size += len(text or "")
                if held > block_bytes or len(out) >= 4096:
                    yield _batch(out, WORKED)
                    out.clear()
                    held = 0
        if begun:
            close(True)
        yield _batch(out, WORKED)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations whose blocks are together."""
    for b in batches:
        rows = []
        for conv_id, blocks in zip(*(c.to_pylist() for c in b.columns), strict=True):
            blocks = sorted(blocks, key=lambda x: (x["task"], x["nth"]))
            rows.append(whole(conv_id, [r for x in blocks for r in x["roles"]], [t for x in blocks for t in x["texts"]]))
        yield _batch(rows, PARTS)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv_id, task, nth, roles in zip(*(c.to_pylist() for c in b.columns), strict=True):
            s = summary(roles)
            rows.append((conv_id, task, nth, len(roles), np.stack([s.cost, s.rank, s.begun]).ravel().tolist()))
        yield _batch(rows, pa.schema([("conv_id", pa.int64()), ("task", pa.int64()), ("nth", pa.int64()), ("n", pa.int64()), ("summary", pa.list_(pa.int64()))]))


BORDERS = pa.schema([(n, pa.int64()) for n in ("_task", "_nth", "part", "n_parts", "cost", "n_turns", "n_repaired", "entry", "exit")])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for blocks in b.column("blocks").to_pylist():
            blocks = sorted(blocks, key=lambda x: (x["task"], x["nth"]))
            states, cost, n = path([Summary(*np.array(x["summary"], np.int64).reshape(3, 4, 4)) for x in blocks])
            n_turns = sum(x["n"] for x in blocks)
            rows += [(x["task"], x["nth"], k, len(blocks), cost, n_turns, n, states[k], states[k + 1]) for k, x in enumerate(blocks)]
        yield _batch(rows, BORDERS)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv_id, roles, texts, part, n_parts, cost, n_turns, n, entry, exit_state in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text, actions, _ = render_turns(roles, texts, entry, exit_state, part == n_parts - 1)
            rows.append((conv_id, part, n_parts, cost, n_turns, n, ("," if part and actions else "") + actions, text))
        yield _batch(rows, PARTS)


def repair_conversations(conversations: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, part, n_parts, cost, n_turns, n_repaired, actions, rendered: one row a conversation, or a part of a long one."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    # The last key spreads rows that are equal in all others.
    dealt = turns.withColumn("spread", F.rand(7)).repartitionByRange(*order, "spread").sortWithinPartitions(*order)
    worked = materialize(dealt.select("conv_id", "role", "text").mapInArrow(_work(block, block_bytes), WORKED_DDL))
    bytes_of = F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    opened = worked.filter("roles is not null").select("conv_id", "task", "nth", "roles", "texts", bytes_of.alias("bytes"))
    sizes = opened.groupBy(F.col("conv_id").alias("_conv_id")).agg(F.sum(F.size("roles")).alias("turns"), F.sum("bytes").alias("all_bytes"))
    sized = opened.join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).withColumn("short", (F.col("turns") <= block) & (F.col("all_bytes") <= block_bytes))
    # A group is a short conversation.
    gathered = sized.filter("short").groupBy("conv_id").agg(F.collect_list(F.struct("task", "nth", "roles", "texts")).alias("blocks")).mapInArrow(_gathered, PARTS_DDL)
    blocks = sized.filter("not short")
    # Some 400 bytes for each block of an open conversation.
    summaries = blocks.select("conv_id", "task", "nth", "roles").mapInArrow(_summaries, "conv_id long, task long, nth long, n long, summary array<long>")
    of_conversation = summaries.groupBy("conv_id").agg(F.collect_list(F.struct("task", "nth", "n", "summary")).alias("blocks"))
    borders = of_conversation.select("blocks").mapInArrow(_borders, ", ".join(f"{n} long" for n in BORDERS.names))
    joined = blocks.select("conv_id", "task", "nth", "roles", "texts").join(borders, (F.col("task") == F.col("_task")) & (F.col("nth") == F.col("_nth")))
    long_ones = joined.select("conv_id", "roles", "texts", *BORDERS.names[2:]).mapInArrow(_rendered, PARTS_DDL)
    return worked.filter("roles is null").select(PARTS.names).unionByName(gathered).unionByName(long_ones)
