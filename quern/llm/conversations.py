"""Conversation structure repair: A* on the edit lattice of a conversation's rows.

A conversation should read `(s?(ua)+)?` by the initials of its roles: at most one system turn,
then user and assistant in turns. Edits of its rows, in order: Keep (free), Rerole to user or
assistant (1), Delete (2; the only edit of blank and duplicate rows), Insert an empty turn (5);
a truncated row that is not deleted costs 5 more. `cheapest` searches the lattice of (rows done,
state of the grammar) with a heap keyed by (cost plus heuristic, audit). The heuristic is the
suffix sum of what no path avoids: 2 for each blank or duplicate row still to come, 2 for each
truncated one (deleting it is the cheaper of its two charges). It never falls by more than an
edit costs, so a node's first pop is final, and of paths of equal cost the one with the smaller
audit is popped first.

Rows of a conversation stream through one task in order, sorted on disk where they don't fit in
memory: the digest of a repaired conversation is one SHA-256 over all of it, which can't be split.
Memory is bounded by a block of rows and four audits: a conversation longer than BLOCK_ROWS is
searched block by block from every state to every state, which composes exactly (a block's edits
depend on what came before through the state alone, and audits of equal cost between the same two
states are never proper prefixes of each other).

Defined results: null role or text: one space (so blank). Null conv_id: a conversation of its own.
Null turn: sorts first, hashed as one space. Rows of equal turn: by role, then text, as they are
after damage. A role without initial can't be kept. Empty table: no rows. A conversation whose
rows are all dropped: zeros, empty audit, hash of the empty string. Repeated rows are duplicates.
Very long texts pass one block at a time. Columns besides conv_id, turn, role and text, whatever
their names, don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.llm.common import configure

OK, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
UNFINISHED = 5

#: States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that an edit to user or assistant gives in each state, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ACCEPTING = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}

#: Rows of a conversation, and characters of text, that are searched together.
BLOCK_ROWS = 512
BLOCK_CHARS = 1 << 24

WHITE = " \t\n\x0b\x0c\r"


def after_keep(state: int, role: str) -> int | None:
    """The state after a row is kept, or None if its role does not fit."""
    initial = role[:1]
    if state == START and initial == "s":
        return SYSTEM
    name, after = NEXT[state]
    return after if initial == name[0] else None


def heuristic(faults: Sequence[int]) -> list[int]:
    """What the rows from each one on cost at least."""
    total = [0] * (len(faults) + 1)
    for i in range(len(faults) - 1, -1, -1):
        total[i] = total[i + 1] + (0 if faults[i] == OK else DELETE if faults[i] != TRUNCATED else min(DELETE, UNFINISHED))
    return total


def cheapest(roles: Sequence[str], faults: Sequence[int], start: int = START, ends: Sequence[int] = ACCEPTING, first: bool = True) -> dict[int, tuple[int, str]]:
    """Least cost and, among the audits of that cost, the ASCII-least, from `start` to the states of `ends`: to the first reached alone, or to all that can be."""
    n, left = len(roles), heuristic(faults)
    heap, done, found = [(left[0], "", 0, start)], set(), {}
    while heap and len(found) < (1 if first else len(ends)):
        key, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = key - left[i]
        if i == n and state in ends:
            found[state] = (cost, audit)
        steps = [(INSERT, "I", i, NEXT[state][1])]
        if i < n:
            steps.append((DELETE, "D", i + 1, state))
            if faults[i] in (OK, TRUNCATED):
                charge = UNFINISHED if faults[i] == TRUNCATED else 0
                kept = after_keep(state, roles[i])
                if kept is not None:
                    steps.append((KEEP + charge, "K", i + 1, kept))
                steps.append((REROLE + charge, "R", i + 1, NEXT[state][1]))
        for price, edit, at, to in steps:
            if (at, to) not in done:
                heapq.heappush(heap, (cost + price + left[at], audit + edit, at, to))
    return found


def applied(audit: str, rows: Sequence[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that remain when an audit's edits are made."""
    at = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit == "K":
            state = after_keep(state, role)
        else:
            role, state = NEXT[state]
        yield edit, role, text


class _Search:
    """One conversation, fed row by row; holds a block of rows, and per live state the cost, the audit and the digest so far."""

    def __init__(self, block_rows: int) -> None:
        self.block_rows, self.rows, self.faults, self.chars = block_rows, [], [], 0
        self.live = {START: (0, "", hashlib.sha256())}

    def add(self, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text))
        self.faults.append(fault)
        self.chars += len(text)
        if len(self.rows) >= self.block_rows or self.chars >= BLOCK_CHARS:
            self._advance(tuple(NEXT), False)

    def _advance(self, ends: Sequence[int], last: bool) -> None:
        best: dict[int, tuple] = {}
        roles = [r for r, _ in self.rows]
        for state, (cost, audit, _) in self.live.items():
            for end, (more, edits) in cheapest(roles, self.faults, state, ends, last and len(self.live) == 1).items():
                found = (cost + more, audit + edits, state, edits)
                if end not in best or found[:2] < best[end][:2]:
                    best[end] = found
        if last:
            end = min(best, key=lambda e: best[e][:2])
            best = {end: best[end]}
        live = {}
        for end, (cost, audit, state, edits) in best.items():
            digest = self.live[state][2].copy()
            sep = "\n" if self.live[state][1].strip("D") else ""
            for _, role, text in applied(edits, self.rows, state):
                digest.update(f"{sep}{role}:{text}".encode())
                sep = "\n"
            live[end] = (cost, audit, digest)
        self.live, self.rows, self.faults, self.chars = live, [], [], 0

    def finish(self) -> tuple[int, str, str]:
        self._advance(ACCEPTING, True)
        ((cost, audit, digest),) = self.live.values()
        return cost, audit, digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows after damage by crc32(`conv_id:turn`) % 20. A dropped row stays with gone = true, so that its conversation is known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        space("role").alias("role"),
        space("text").alias("text"),
        (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("fault") == 0).alias("gone"),
        F.explode(F.when(F.col("fault") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(1)))).alias("copy"),
    ).drop("copy")


def intact(conversations: DataFrame) -> DataFrame:
    """The rows as damaged() gives them, without damage: for tables that are to be repaired as they are."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.lit(False).alias("gone"))


def _fault(seen_before: Column) -> Column:
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    return F.when(end == "", BLANK).when(seen_before, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(OK)


#: Ascending, nulls first.
_ORDER = ["conv_id", "turn", "role", "text"]


def faulted(rows: DataFrame) -> DataFrame:
    """Rows with their first fault, together by conversation and in order within it. The one shuffle deals rows by conversation; the window for repeats needs no other."""
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")) > 1
    return rows.repartition(F.col("conv_id")).withColumn("fault", _fault(again)).sortWithinPartitions(*_ORDER)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Summary:
    def __init__(self, conv_id, block_rows: int) -> None:
        self.conv_id, self.search, self.before = conv_id, _Search(block_rows), None
        self.low = self.high = None
        self.turns, self.counts, self.illegal = 0, [0] * 4, 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.high:  # rows come in order of turns
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.search.add(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts[BLANK:], self.illegal, *self.search.finish())


def _schema(rows: DataFrame, more: str) -> StructType:
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType)] + StructType.fromDDL(more).fields)


def _tables(found: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded number of rows."""
    held = []
    for row in found:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def audits(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of damaged() or intact() rows: counts of faults, the least cost, its audit and the digest of the repaired turns."""
    configure(rows.sparkSession)
    schema = _schema(rows, SUMMARY)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _arrow(schema)

        def conversations() -> Iterator[tuple]:
            now = None
            for batch in batches:
                for conv_id, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns)):
                    if now is None or conv_id != now.conv_id:
                        if now is not None:
                            yield now.row()
                        now = _Summary(conv_id, block_rows)
                    if not gone:
                        now.add(turn, role, text, fault)
            if now is not None:
                yield now.row()

        yield from _tables(conversations(), out)

    return faulted(rows).mapInArrow(work, schema)


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The turns that remain (conv_id, place, edit, role, text), place counting from 0. audited: conv_id and audit of audits(). A conversation's audit comes first in the stream of its rows, which pass one at a time."""
    configure(rows.sparkSession)
    kept = rows.where(~F.col("gone")).select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = audited.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = kept.unionByName(heads).withColumn("head", F.col("audit").isNull())
    schema = _schema(rows, "place long, edit string, role string, text string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _arrow(schema)

        def turns() -> Iterator[tuple]:
            conv_id, audit, at, state, place = None, "", 0, START, 0

            def inserts() -> Iterator[tuple]:
                nonlocal at, state, place
                while at < len(audit) and audit[at] == "I":
                    role, state = NEXT[state]
                    yield conv_id, place, "I", role, ""
                    at, place = at + 1, place + 1

            for batch in batches:
                for own, role, text, head in zip(*(c.to_pylist() for c in batch.columns)):
                    if head is not None:
                        conv_id, audit, at, state, place = own, head, 0, START, 0
                        yield from inserts()
                        continue
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = after_keep(state, role)
                    elif edit == "R":
                        role, state = NEXT[state]
                    if edit != "D":
                        yield conv_id, place, edit, role, text
                        place += 1
                    yield from inserts()

        yield from _tables(turns(), out)

    ordered = both.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "head", *_ORDER[1:])
    return ordered.select("conv_id", "role", "text", "audit").mapInArrow(work, schema)
