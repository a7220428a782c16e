"""Repair of the turn structure of conversations by iterative-deepening A* (operator 11).

A conversation should be a system turn or none and then user and assistant in turn, or be empty. Edits
bring it there: keep a row (K), delete it (D), give it another role (R), insert an empty row (I). The
search goes depth first through the edits in the order of their letters, below a bound on cost plus
what the rows left cost at least; the bound then rises to the least sum that exceeded it. A table
keeps, for each place and state of the pattern that failed, below which rest of cost it always fails.
The first accepting path is therefore the cheapest list of edits, and of those the first by letters.

A conversation is searched ``SEGMENT`` rows at a time, from every state it can have reached to every
state it can go on from, so the work and the memory grow with its rows and not with a power of them.
The text hash is carried along for every state. Insertions go before a row or at the very end, so the
lists of edits of a segment are no beginnings of one another and the first by letters stays the first.

Spark orders the rows: repeats are found by windows over equal rows, then the rows of a conversation
are sorted within a partition and read once as a stream. The hash of a text needs its bytes in order,
so a conversation is read by one task, which holds a segment and its edits' letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import inf
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.batches import show_package

SPACE = "\x20\t\n\x0b\x0c\r"
ENDS = ".!?"
SEGMENT = 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the pattern: nothing yet, after a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDINGS = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
BLANK, DUPLICATE, CUT = 1, 2, 3


class Row(NamedTuple):
    role: str
    text: str
    fault: int


class Found(NamedTuple):
    cost: int
    audit: str


def turn_after(state: int) -> int:
    """The state that a user or assistant turn leads to, whichever may stand there."""
    return ASSISTANT if state == USER else USER


def kept_as(state: int, role: str) -> int | None:
    """The state after keeping a row of that role, None where it may not stand."""
    first = role[:1]
    if first == "s" and state == START:
        return SYSTEM
    return turn_after(state) if first == "ua"[state == USER] else None


def least_cost(row: Row) -> int:
    """What the row costs at least, whatever is done with it."""
    return DELETE if row.fault in (BLANK, DUPLICATE) else TRUNCATED if row.fault == CUT else 0


class Search:
    """Cheapest edits of a few rows that end in one of ``goals``; insertions at the end if ``last``.

    Searches from several states share what is known to fail.
    """

    def __init__(self, rows: list[Row], goals: tuple[int, ...], last: bool):
        self.rows, self.goals, self.last = rows, goals, last
        self.rest = [0] * (len(rows) + 1)
        for i in range(len(rows) - 1, -1, -1):
            self.rest[i] = self.rest[i + 1] + least_cost(rows[i])
        #: For a failed place: any rest of cost below this fails, too.
        self.failed: dict[tuple[int, int, int], float] = {}

    def best(self, state: int) -> Found | None:
        """None where no edits lead from the state to a goal."""
        start = (0, state, 0)
        while (bound := self._least(start)) < inf:
            audit = self._from(start, bound)
            if audit is not None:
                return Found(bound, audit)
        return None

    def _least(self, place: tuple[int, int, int]) -> float:
        return self.failed.get(place, self.rest[place[0]])

    def _edits(self, place: tuple[int, int, int]) -> Iterator[tuple[str, float, tuple[int, int, int]]]:
        """Letter, cost and next place of the edits from a place, by letter.

        The last part of a place counts the insertions just before. More than two in a row would
        come back to a state they have passed.
        """
        i, state, inserted = place
        row = self.rows[i] if i < len(self.rows) else None
        if row is not None:
            yield "D", DELETE, (i + 1, state, 0)
        if inserted < 2 and (row is not None or self.last):
            yield "I", INSERT, (i, turn_after(state), inserted + 1)
        if row is not None and row.fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if row.fault == CUT else 0
            kept = kept_as(state, row.role)
            if kept is not None:
                yield "K", KEEP + more, (i + 1, kept, 0)
            yield "R", REROLE + more, (i + 1, turn_after(state), 0)

    def _from(self, place: tuple[int, int, int], left: float) -> str | None:
        """Letters of the first path from here that costs no more than what is left."""
        if place[0] == len(self.rows) and place[1] in self.goals:
            return ""
        needed = inf
        for letter, cost, after in self._edits(place):
            if cost + self._least(after) <= left:
                path = self._from(after, left - cost)
                if path is not None:
                    return letter + path
            needed = min(needed, cost + self._least(after))
        self.failed[place] = needed
        return None


def repaired(rows: list[Row], state: int, audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that the edits leave, from a state of the pattern on."""
    at = iter(rows)
    for letter in audit:
        if letter == "I":
            state = turn_after(state)
            yield ROLES[state], ""
            continue
        row = next(at)
        if letter == "K":
            state = kept_as(state, row.role)
            yield row.role, row.text
        elif letter == "R":
            state = turn_after(state)
            yield ROLES[state], row.text


@dataclass
class Path:
    """The cheapest way into a state so far: its letters by segment, and the hash of its text."""

    cost: int = 0
    audits: list[str] = field(default_factory=list)
    digest: object = field(default_factory=hashlib.sha256)
    turns: int = 0


class Repair:
    """One conversation, fed row by row."""

    def __init__(self):
        self.paths = {START: Path()}
        self.rows: list[Row] = []
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.before: str | None = None
        self.turns = [None, None, 0]  # least, latest, number of different ones

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        bare = text.rstrip(SPACE)
        fault = BLANK if not bare else DUPLICATE if again else CUT if bare[-1] not in ENDS else 0
        self.faults[fault] += 1
        first = role[:1]
        if self.before is not None and self.before + first not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = first
        least, latest, number = self.turns
        if turn is not None and turn != latest:
            self.turns = [turn if least is None else least, turn, number + 1]
        if len(self.rows) == SEGMENT:
            self._pass(tuple(range(4)), False)
        self.rows.append(Row(role, text, fault))

    def _pass(self, goals: tuple[int, ...], last: bool) -> None:
        """Take the paths over the rows held, into each of the goals (into any of them if last)."""
        out: dict[int, Path] = {}
        for wanted in [goals] if last else [(g,) for g in goals]:
            search = Search(self.rows, wanted, last)
            options = []
            for state, path in self.paths.items():
                found = search.best(state)
                if found is not None:
                    whole = (path.cost + found.cost, [*path.audits, found.audit])
                    options.append((whole, state, path, found))
            if not options:
                continue
            # lists of segments compare like the letters in them: none is the beginning of another
            (cost, audits), state, path, found = min(options, key=lambda o: o[0])
            digest, turns = path.digest.copy(), path.turns
            for role, text in repaired(self.rows, state, found.audit):
                digest.update(f"{chr(10) if turns else ''}{role}:{text}".encode())
                turns += 1
            out[wanted[0]] = Path(cost, audits, digest, turns)
        self.paths = out
        self.rows = []

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, hash."""
        self._pass(ENDINGS, True)
        (path,) = self.paths.values()
        least, latest, number = self.turns
        gaps = latest - least + 1 - number if number else 0
        return (
            gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal,
            path.cost, "".join(path.audits), path.digest.hexdigest(),
        )


OUT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``.

    ``rows`` are ``(conv_id, turn, role, text, present)`` with roles and texts that are not null; rows
    that are not ``present`` only make sure that their conversation is returned. The rows of a
    conversation go by turn, nulls first; of one turn by role and text. A null id is a conversation
    of its own. A conversation without rows has zeros, no edits and the hash of an empty text.
    """
    show_package(rows.sparkSession)
    # equal rows differ in nothing but which is first
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.asc_nulls_first("turn"))
    order = [F.asc_nulls_first("turn"), "role", "text", "again"]
    ordered = (
        rows.select("conv_id", "turn", "role", "text", "present")
        .withColumn("again", F.row_number().over(same) > 1)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", *order)
    )

    def run(batches):
        names = [f.split()[0] for f in OUT.split(", ")]
        current, state, done = None, None, []

        def packed():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(column, pa.int64() if i < 7 else pa.string())
                    for i, column in enumerate(zip(*done))
                ],
                names=names,
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 400):
                for conv, turn, role, text, present, again in zip(
                    *(c.to_pylist() for c in batch.slice(start, 400).columns)
                ):
                    if state is None or conv != current:
                        if state is not None:
                            done.append((current, *state.result()))
                        current, state = conv, Repair()
                    if present:
                        state.add(turn, role, text, again)
                if done:
                    yield packed()
                    done = []
        if state is not None:
            done.append((current, *state.result()))
            yield packed()

    return ordered.mapInArrow(run, OUT)


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, present)`` of ``conversations`` after the damage of the check.

    By the crc32 of ``conv_id:turn`` modulo 20: 0 the row is no longer present, 1 its text is empty,
    2 the text loses its ends of sentences, 3 the row is there twice, 4 its role is user. Nulls count
    as one space, in the hash as in role and text. Equal rows suffer alike.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    chance = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = (
        F.when(F.col("chance") == 1, "")
        .when(F.col("chance") == 2, F.translate(spaced("text"), ENDS, ""))
        .otherwise(spaced("text"))
    )
    return (
        rows.select("conv_id", "turn", "role", "text", chance.alias("chance"))
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.when(F.col("chance") == 4, "user").otherwise(spaced("role")).alias("role"),
            text.alias("text"),
            (F.col("chance") != 0).alias("present"),
            F.explode(F.array_repeat(F.lit(1), F.when(F.col("chance") == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )
