"""Repair of damaged conversations: a backward cost-to-go programme, then a greedy walk forward.

The turns of a conversation, in order, pass a grammar whose states are *nothing yet*,
*after system*, *after user* and *after assistant*; role initials must read
``(s?(ua)+)?``.  A turn is kept, reroled to user or assistant, or deleted (blank turns
and duplicates always are), and empty user or assistant turns may be inserted
anywhere.  C[i][state] is the least cost of the turns from i on; the walk takes at
each place the transition least in ASCII (Delete, Insert, Keep, Rerole) among those
that lose nothing against C.  As no two transitions with one initial lead from one
state to different ones, that is the least of all cheapest edit strings.

Scale: equal rows are counted before anything is shuffled by conversation, and turns are
dealt by ranges of (conv_id, turn, role, text), so one conversation may lie on many
tasks.  A task cuts its run of a conversation into blocks of at most ``ROWS`` rows and
``TEXT_BYTES`` of text, with a (min, +) matrix from state to state each.  The
matrices (16 numbers for a block) pass backward through a sorted stream for each
conversation and give the costs after each block; all blocks are then walked
independently, from each of the four states; a second stream follows the state
forward.  Streams hold one vector or state, whatever the length of a conversation.
Only the digest's SHA-256, which can't be computed in parts, sees the text of a
conversation in one task, block by block; ``repaired_turns`` needs no such pass.

Results for odd input: a null role or text is one space, and so is a null conv_id or
turn where the damage is drawn; the null conv_id is a conversation of its own.  Null
turns come first; rows with equal turns are ordered by role, then text (after the
damage).  Roles count by their first character; other than s, u and a must be reroled or
deleted.  Whole copies of a row are duplicates of it.  Conversations without rows after
the damage have zeros and empty texts; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import materialize

#: Size of a block.
ROWS, TEXT_BYTES = 1024, 1 << 20
#: Places over which the turns of one repeated text are spread.
SALTS = 8

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
NO_WAY = 1 << 40
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state that an inserted or reroled turn leads to; its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A code is an initial (s, u, a, other) and four times a fault (none, truncated, blank, duplicate).
INITIALS = {"s": 0, "u": 1, "a": 2}
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
SPACE = r"\x20\x09-\x0D"

Vector = tuple[int, int, int, int]


def _kept(state: int, initial: int) -> int | None:
    """The state after a kept turn, None where the grammar forbids it."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial in (1, 2):
        return NEXT[state] if NEXT[state] == initial + 1 else None
    return None


@cache
def _before(after: Vector, code: int) -> Vector:
    """Costs before one turn, insertions in front of it included, from the costs after it."""
    fault, initial = code >> 2, code & 3
    if fault >= BLANK:
        return tuple(DELETE + c for c in after)
    extra, base = CUT_OFF * (fault == TRUNCATED), []
    for s in STATES:
        to = _kept(s, initial)
        base.append(min(DELETE + after[s], REROLE + extra + after[NEXT[s]], NO_WAY if to is None else KEEP + extra + after[to]))
    once = [min(base[s], INSERT + base[NEXT[s]]) for s in STATES]
    return tuple(min(once[s], INSERT + once[NEXT[s]]) for s in STATES)


#: Costs after the last turn: what is left open is closed by insertions.
LAST: Vector = (0, 2 * INSERT, INSERT, 0)


def _leveled(v: Vector) -> tuple[Vector, int]:
    least = min(v)
    return tuple(c - least for c in v), least


@cache
def _step(after: Vector, code: int) -> tuple[Vector, int]:
    """_before() less its least cost, and that; level vectors are few, so that this is a table in practice."""
    return _leveled(_before(after, code))


@cache
def _move(after: Vector, code: int, state: int) -> tuple[str, int]:
    """The walk's edits at one turn, from `state` and the (level) costs after it; and the state they lead to."""
    fault, initial = code >> 2, code & 3
    if fault >= BLANK:
        return "D", state
    here, edits, extra = _before(after, code), "", CUT_OFF * (fault == TRUNCATED)
    while True:
        to = _kept(state, initial)
        if DELETE + after[state] == here[state]:
            return edits + "D", state
        if INSERT + here[NEXT[state]] == here[state]:
            edits, state = edits + "I", NEXT[state]
        elif to is not None and extra + after[to] == here[state]:
            return edits + "K", to
        else:
            return edits + "R", NEXT[state]


def matrix(codes: bytes, counts: list[int]) -> list[int]:
    """Least costs from each state before a block to each after it, row by row."""
    columns = []
    for to in STATES:
        # Only insertions in front of a turn belong to a block; those after its last turn belong to the next.
        after, total = tuple(0 if s == to else NO_WAY for s in STATES), 0
        for code in reversed(codes):
            after, least = _step(after, code)
            total += least
        columns.append([min(c + total, NO_WAY) for c in after])
    shift = DELETE * (sum(counts) - len(counts))
    return [columns[to][s] + shift for s in STATES for to in STATES]


def walks(codes: bytes, counts: list[int], after: Vector) -> tuple[list[str], list[int]]:
    """The walk through a block from each state, given the costs after it: edits and last states."""
    after, ahead = _leveled(after)[0], []
    for code in reversed(codes):
        ahead.append(after)
        after = _step(after, code)[0]
    ahead.reverse()
    audits, ends = [], []
    for state in STATES:
        edits = []
        for code, n, v in zip(codes, counts, ahead, strict=True):
            made, state = _move(v, code, state)
            edits.append(made if n == 1 else made + "D" * (n - 1))
        audits.append("".join(edits))
        ends.append(state)
    return audits, ends


def rendered(codes: bytes, counts: list[int], roles: list[str], texts: list[str], audit: str, state: int) -> Iterator[tuple[str, str, str, bool]]:
    """(edit, role, text, truncated) of the turns that a block's edits leave, from its first state on."""
    at = 0
    for code, n, role, text in zip(codes, counts, roles, texts, strict=True):
        while audit[at] == "I":
            state, at = NEXT[state], at + 1
            yield "I", ROLES[state], "", False
        edit, at = audit[at], at + n
        if edit == "K":
            state = _kept(state, code & 3)
            yield edit, role, text, code >> 2 == TRUNCATED
        elif edit == "R":
            state = NEXT[state]
            yield edit, ROLES[state], text, code >> 2 == TRUNCATED


def closing(state: int) -> list[str]:
    """Roles inserted after the last turn."""
    return {START: [], SYSTEM: ["user", "assistant"], USER: ["assistant"], ASSISTANT: []}[state]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as the stated damage leaves them: conv_id, turn, role, text, copies."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("draw"))
    draw, text = F.col("draw"), F.col("text")
    return rows.filter(draw != 0).select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(draw == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def coded(rows: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, text) with `copies` and their code: what is first of its copies, if not blank, is a duplicate only of an earlier turn."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("blank", blank).withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    seen = rows.filter(~F.col("blank")).groupBy("conv_id", "key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    seen = seen.select(F.col("conv_id").alias("seen_conv"), F.col("key").alias("seen_key"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("turn"), F.lit(SALTS))
    joined = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("seen_conv")) & (F.col("key") == F.col("seen_key")) & (salt == F.col("salt")), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    ended = F.col("text").rlike(rf"[.!?][{SPACE}]*+\z")
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(~ended, TRUNCATED).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return joined.select("conv_id", "turn", "role", "text", "copies", (number + 4 * fault).alias("code"))


BLOCK = "conv_id long, part int, block int, codes binary, counts array<long>, roles array<string>, texts array<string>, first_turn long, last_turn long, turns long, matrix array<long>"


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _blocks(rows: DataFrame) -> DataFrame:
    """Runs of a conversation's turns in order, a row for each block, numbered by part and block."""
    schema = _arrow(rows, BLOCK)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> tuple:
            codes, counts = bytes(r["code"] for r in held), [r["copies"] for r in held]
            turns = [r["turn"] for r in held if r["turn"] is not None]
            return (held[0]["conv_id"], part, number, codes, counts, [r["role"] for r in held], [r["text"] for r in held],
                    turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), matrix(codes, counts))

        out, out_size = [], 0
        for batch in batches:
            for r in (r for k in range(0, batch.num_rows, ROWS) for r in batch.slice(k, ROWS).to_pylist()):
                n = len(r["text"])
                if held and (held[0]["conv_id"] != r["conv_id"] or len(held) == ROWS or size + n > TEXT_BYTES):
                    out.append(row())
                    number, held, out_size, size = number + 1, [], out_size + size, 0
                    if len(out) == ROWS or out_size > TEXT_BYTES:
                        yield _batch(out, schema)
                        out, out_size = [], 0
                held.append(r)
                size += n
        if held:
            out.append(row())
        if out:
            yield _batch(out, schema)

    order = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(emit, BLOCK)


def _streamed(rows: DataFrame, fold, ddl: str, *order: Column) -> DataFrame:
    """Each conversation's rows in order through fold(state, row) -> (state, output row or None); state None begins one."""
    schema = _arrow(rows, ddl)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = (), None
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                out = []
                for r in batch.slice(k, ROWS).to_pylist():
                    if (r["conv_id"],) != conv:
                        conv, state = (r["conv_id"],), None
                    state, made = fold(state, r)
                    if made is not None:
                        out.append(made)
                if out:
                    yield _batch(out, schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(emit, ddl)


PLACE = "conv_id long, part int, block int"


def _costs_after(blocks: DataFrame) -> DataFrame:
    """The costs after each block, by the conversation's matrices from last to first."""

    def fold(after: Vector | None, r: dict) -> tuple[Vector, tuple]:
        after, m = after or LAST, r["matrix"]
        return tuple(min(m[4 * s + to] + after[to] for to in STATES) for s in STATES), (r["conv_id"], r["part"], r["block"], list(after))

    return _streamed(blocks.select("conv_id", "part", "block", "matrix"), fold, f"{PLACE}, after array<long>", F.col("part").desc(), F.col("block").desc())


def _same_place(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    b = b.withColumnsRenamed({c: f"{c}_b" for c in ("conv_id", "part", "block")})
    return a.join(b, F.col("conv_id").eqNullSafe(F.col("conv_id_b")) & (F.col("part") == F.col("part_b")) & (F.col("block") == F.col("block_b")), how).drop("conv_id_b", "part_b", "block_b")


def _walked(blocks: DataFrame) -> DataFrame:
    """Edits and last states of each block, for each state before it."""
    ddl = f"{PLACE}, audits array<string>, ends array<int>"
    schema = _arrow(blocks, ddl)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64).to_pylist()
                yield _batch([(r["conv_id"], r["part"], r["block"], *walks(r["codes"], r["counts"], tuple(r["after"]))) for r in rows], schema)

    return _same_place(blocks.select("conv_id", "part", "block", "codes", "counts"), _costs_after(blocks)).mapInArrow(emit, ddl)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired turns of (conv_id, turn, role, text, copies): conv_id, part, block, place (their order), edit, role, text."""
    blocks = materialize(_blocks(coded(rows)))
    walked = _walked(blocks)

    def fold(state: int | None, r: dict) -> tuple[int, tuple]:
        state = START if state is None else state
        return r["ends"][state], (r["conv_id"], r["part"], r["block"], state, r["audits"][state], r["ends"][state])

    chosen = _streamed(walked, fold, f"{PLACE}, state int, audit string, end int", F.col("part"), F.col("block"))
    final = blocks.groupBy("conv_id").agg(F.max(F.struct("part", "block")).alias("top")).select("conv_id", "top.part", "top.block", F.lit(True).alias("is_last"))
    placed = _same_place(_same_place(blocks, chosen), final, "left")
    ddl = f"{PLACE}, place int, edit string, role string, text string"
    schema = _arrow(blocks, ddl)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                turns = [t[:3] for t in rendered(r["codes"], r["counts"], r["roles"], r["texts"], r["audit"], r["state"])]
                turns += [("I", role, "") for role in (closing(r["end"]) if r["is_last"] else [])]
                if turns:
                    yield _batch([(r["conv_id"], r["part"], r["block"], i, *t) for i, t in enumerate(turns)], schema)

    return placed.mapInArrow(emit, ddl)


class _Digest:
    """What one conversation's stream of blocks adds up to."""

    def __init__(self) -> None:
        self.state, self.parts, self.sha, self.begun = START, [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.initial = self.first_turn = self.last_turn = self.walk = None

    def turn(self, role: str, text: str) -> None:
        self.sha.update((f"\n{role}:{text}" if self.begun else f"{role}:{text}").encode())
        self.begun = True

    def block(self, r: dict) -> None:
        audit, before = self.walk["audits"][self.state], self.initial
        for code, n in zip(r["codes"], r["counts"], strict=True):
            initial, fault = code & 3, code >> 2
            self.illegal += n - 1 + (before is not None and (before, initial) not in LEGAL_PAIRS)
            self.blank += n * (fault == BLANK)
            self.duplicate += n if fault == DUPLICATE else n - 1 if fault != BLANK else 0
            self.truncated += fault == TRUNCATED
            before = initial
        self.initial = before
        if r["turns"]:
            self.turns += r["turns"] - (r["first_turn"] == self.last_turn)
            self.first_turn = r["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = r["last_turn"]
        for _, role, text, cut_off in rendered(r["codes"], r["counts"], r["roles"], r["texts"], audit, self.state):
            self.turn(role, text)
            self.cost += CUT_OFF * cut_off
        self.parts.append(audit)
        self.cost += DELETE * audit.count("D") + INSERT * audit.count("I") + REROLE * audit.count("R")
        self.state = self.walk["ends"][self.state]

    def row(self, conv_id: int | None) -> tuple:
        for role in closing(self.state):
            self.turn(role, "")
            self.parts.append("I")
            self.cost += INSERT
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.parts), self.sha.hexdigest()


def digest(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id: the damaged conversation's faults and the digest of its repair."""
    blocks = materialize(_blocks(coded(damage(conversations))))
    walked = _walked(blocks)
    ids = conversations.select("conv_id").distinct().withColumns({"part": F.lit(-1), "block": F.lit(-1)})
    texts = blocks.drop("matrix")
    stream = texts.withColumn("kind", F.lit(2)).unionByName(walked.withColumn("kind", F.lit(1)), True).unionByName(ids.withColumn("kind", F.lit(0)), True)
    ddl = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = _arrow(blocks, ddl)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, found, out = None, None, []
        for batch in batches:
            for r in (r for k in range(0, batch.num_rows, 16) for r in batch.slice(k, 16).to_pylist()):
                if r["kind"] == 0:
                    if found is not None:
                        out.append(found.row(conv))
                    conv, found = r["conv_id"], _Digest()
                elif r["kind"] == 1:
                    found.walk = r
                else:
                    found.block(r)
                if len(out) == ROWS:
                    yield _batch(out, schema)
                    out = []
        if found is not None:
            out.append(found.row(conv))
        if out:
            yield _batch(out, schema)

    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block", "kind").mapInArrow(emit, ddl)
