"""Repairs the structure of conversations: the cheapest edits that make roles alternate, by a lazily determinised automaton.

Legal role initials are ``(s?(ua)+)?``.  Edits are a weighted automaton of four states over a conversation's rows.  Its
determinisation is made as rows need it: a vector of the costs of all four states, less the least of them, is one state of the
deterministic automaton, and a transition table keeps, for each such state and kind of row, the next state and the cost.  One
scan of the table gives a conversation's cost; a backward trace of tight arcs (those that keep the least cost) marks what lies on
a cheapest repair, and from these the edits are read, ASCII-least first.

Two shuffles by conversation: the first carries kinds of rows and hashes instead of texts and makes the edits, the second sorts the
edits in front of their conversation's rows, whose repaired texts are then hashed as they stream by.  A worker holds one byte a row
of one conversation, about the length of the audit that the result holds anyway, and never a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\v\f\r"
#: Costs of edits; TRUNCATED is paid for each truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Roles by initial.
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 40
#: States: nothing yet, a system row, a user row, an assistant row; the state behind each by the initial that is put there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: Kinds of rows: initial's place here, and 4 more if truncated; one for rows that must go; one for rows that damage dropped.
INITIALS = "sua?"
MUST_GO, GONE = 8, 9


def damage(rows: DataFrame) -> DataFrame:
    """Rows conv, turn, role, text, copy and ``gone`` (a dropped row, which stays as a mark of its conversation).

    What happens to a row depends on the CRC-32 of ``conv_id:turn`` modulo 20; nulls count as one space in it and as role or text.
    """
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(named) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return c.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))


def kinds(rows: DataFrame) -> DataFrame:
    """Damaged rows as conv, turn, role, hash, gone, blank, twice, open: no texts."""
    bare = F.rtrim("text", F.lit(SPACE))
    return rows.select(
        "conv", "turn", "role", F.unhex(F.md5("text")).alias("hash"), "gone", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open")
    )


def weight(state: int, kind: int, edit: str) -> tuple[int, int] | None:
    """State behind ``edit`` of a row of ``kind`` in ``state`` and its cost, or None if it isn't allowed."""
    if edit == "D":
        return state, DELETE
    if kind == MUST_GO:
        return None
    extra = TRUNCATED if kind >= 4 else 0
    if edit == "K":
        return (to, extra) if (to := NEXT[state].get(INITIALS[kind % 4])) is not None else None
    return next((to, REROLE + extra) for i, to in NEXT[state].items() if i in ROLES)


def inserted(state: int) -> int:
    """The state behind an inserted row."""
    return next(to for i, to in NEXT[state].items() if i in ROLES)


def settled(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """Costs with insertions taken as often as they help, less the least of them, and that.

    From an assistant row all can be done that can be done from a system row, and, a row deleted, all that can be done from
    nothing; what costs more than that way is on no cheapest repair and never counts, which keeps the vectors finitely many.
    """
    for _ in range(3):
        for state, cost in enumerate(costs):
            costs[inserted(state)] = min(costs[inserted(state)], cost + INSERT)
    if costs[1] > costs[3]:
        costs[1] = NEVER
    if costs[0] > costs[3] + DELETE:
        costs[0] = NEVER
    least = min(costs)
    return tuple(min(c - least, NEVER) for c in costs), least


class Repairs:
    """The lazy automaton: ``vectors`` of its states, and for each state the row of the transition table."""

    def __init__(self):
        first, _ = settled([0, NEVER, NEVER, NEVER])
        self.vectors, self.number, self.table = [first], {first: 0}, [[None] * MUST_GO + [None]]

    def step(self, state: int, kind: int) -> tuple[int, int]:
        """Next state and the cost by which its least cost exceeds this one's."""
        if (known := self.table[state][kind]) is not None:
            return known
        costs = [NEVER] * 4
        for p, cost in enumerate(self.vectors[state]):
            for edit in "DKR" if cost < NEVER else "":
                if (arc := weight(p, kind, edit)) is not None:
                    costs[arc[0]] = min(costs[arc[0]], cost + arc[1])
        vector, least = settled(costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * (MUST_GO + 1))
        self.table[state][kind] = self.number[vector], least
        return self.table[state][kind]

    @lru_cache(maxsize=None)
    def live(self, state: int, kind: int, after: frozenset[int]) -> frozenset[int]:
        """NFA states before a row from which a tight arc leads to one of ``after``, insertions before the row included."""
        to, least = self.step(state, kind)
        before, behind = self.vectors[state], self.vectors[to]
        tight = {
            p for p in range(4) for e in "DKR"
            if before[p] < NEVER and (arc := weight(p, kind, e)) is not None and arc[0] in after and before[p] + arc[1] == behind[arc[0]] + least
        }
        return self.widened(state, frozenset(tight))

    @lru_cache(maxsize=None)
    def widened(self, state: int, live: frozenset[int]) -> frozenset[int]:
        """``live`` and what tight insertions lead from to it."""
        costs, out = self.vectors[state], set(live)
        for _ in range(3):
            out |= {p for p in range(4) if costs[p] < NEVER and inserted(p) in out and costs[p] + INSERT == costs[inserted(p)]}
        return frozenset(out)

    @lru_cache(maxsize=None)
    def edits(self, state: int, kind: int, live: frozenset[int], after: frozenset[int], at: int) -> tuple[str, int]:
        """The ASCII-least edits that lead from NFA state ``at`` over a row, and the NFA state behind it."""
        to, least = self.step(state, kind)
        costs, behind, out = self.vectors[state], self.vectors[to], ""
        while True:
            arc = {e: weight(at, kind, e) for e in "DKR"}
            tight = [e for e, a in arc.items() if a is not None and a[0] in after and costs[at] + a[1] == behind[a[0]] + least]
            if "D" not in tight and inserted(at) in live and costs[at] + INSERT == costs[inserted(at)]:
                at, out = inserted(at), out + "I"
                continue
            return out + tight[0], arc[tight[0]][0]

    def repair(self, rows: bytes) -> tuple[int, str]:
        """Cost and audit of a conversation's rows, given by kind."""
        states, cost = [0], 0
        for kind in rows:
            to, more = self.step(states[-1], kind)
            states.append(to)
            cost += more
        last = self.vectors[states[-1]]
        least = min(last[q] for q in ENDS)
        lives = [self.widened(states[-1], frozenset(q for q in ENDS if last[q] == least))]
        for state, kind in zip(reversed(states[:-1]), reversed(rows)):
            lives.append(self.live(state, kind, lives[-1]))
        at, audit = 0, []
        for i, kind in enumerate(rows):
            done, at = self.edits(states[i], kind, lives[len(rows) - i], lives[len(rows) - i - 1], at)
            audit.append(done)
        while last[at] != least or at not in ENDS:
            at = inserted(at)
            audit.append("I")
        return cost + least, "".join(audit)


LEGAL = {"su", "ua", "au"}
FOUND = "conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Conversation:
    """What is counted while a conversation's rows pass by, in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None
        self.rows = bytearray()

    def add(self, turn: int | None, initial: str, blank: bool, twice: bool, open_: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.blank += blank
        self.duplicate += twice and not blank
        self.truncated += open_ and not blank and not twice
        place = INITIALS.find(initial) if initial else 3
        self.rows.append(MUST_GO if blank or twice else (place if place >= 0 else 3) + 4 * open_)

    def result(self, automaton: Repairs) -> tuple:
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *automaton.repair(bytes(self.rows))


def runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple]:
    """Rows as tuples of Python values, a batch at a time."""
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(columns)))


def as_batch(rows: list[tuple], conv: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [conv, *[pa.int64()] * 6, *[pa.string()] * 2]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], type=kinds[i]) for i in range(len(names))], names)


def in_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def audits(damaged: DataFrame) -> DataFrame:
    """A row for each conversation: conv, counts of faults, the cheapest repair's cost and audit."""
    made = FOUND.format(conv=damaged.schema["conv"].dataType.simpleString())
    names = [x.split()[0] for x in made.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, state, out, kind = Repairs(), None, None, [], None

        def flush():
            return as_batch(out, kind, names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, initial, gone, blank, twice, open_ in runs([batch], 7):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, *state.result(automaton)))
                    now, state = conv, Conversation()
                if not gone:
                    state.add(turn, initial, blank, twice, open_)
            if len(out) >= 1024:
                yield flush()
                out.clear()
        if state is not None:
            out.append((now, *state.result(automaton)))
            yield flush()

    rows = kinds(damaged).repartition("conv")
    seen = Window.partitionBy("conv", "gone", "role", "hash").orderBy("turn")
    rows = rows.withColumn("twice", F.row_number().over(seen) > 1).sortWithinPartitions("conv", "turn", "role", "hash")
    return rows.select("conv", "turn", F.substring("role", 1, 1), "gone", "blank", "twice", "open").mapInArrow(scan, made)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that ``audit`` makes of ``rows``."""
    at = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit in "IR":
            role = next(ROLES[i] for i in NEXT[at] if i in ROLES)
        at = NEXT[at][role[0]]
        yield role, text


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id (null is one): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Reads conv_id, turn, role and text of the rows after ``damage``; further columns, whatever their names, don't matter.  Rows go
    by turn, nulls first; of equal turns by role and the text's hash, so that repeated rows stand together.  A role's initial is its first
    character as it is; an empty role has none and is illegal beside any.  No row left: zeros, no audit, the empty text's hash.
    An empty table gives an empty result.
    """
    rows = damage(conversations)
    return hashed(rows, audits(rows)).withColumnRenamed("conv", "conv_id")


def hashed(damaged: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with repaired_sha256: each conversation's audit comes first, then its rows, whose texts pass through the hash."""
    made = FOUND.format(conv=damaged.schema["conv"].dataType.simpleString()) + ", repaired_sha256 string"
    names = [x.split()[0] for x in made.split(", ")]
    counts = F.struct(*names[1:8])
    first = found.select("conv", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), counts.alias("found"))
    none = F.lit(None).cast(first.schema["found"].dataType)
    then = damaged.filter("not gone").select("conv", F.lit(1).alias("part"), "turn", "role", "text", none.alias("found"))
    rows = in_order(first.unionByName(then), "part", "turn", "role", F.unhex(F.md5("text"))).select("conv", "part", "role", "text", "found")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Stream(batches)
        out = []

        def flush():
            return as_batch(out, source.kind, names)

        while (row := source.head()) is not None:
            source.pop()
            digest, some = hashlib.sha256(), False
            for role, text in repaired(row[4]["audit"], source.rows()):
                digest.update((("\n" if some else "") + f"{role}:{text}").encode())
                some = True
            out.append((row[0], *(row[4][n] for n in names[1:8]), digest.hexdigest()))
            if len(out) >= 1024:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return rows.mapInArrow(scan, made)


class Stream:
    """Rows of batches with the next one in view."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.kind, self.next, self.source = None, None, self._each(batches)
        self.pop()

    def _each(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            self.kind = batch.schema.field(0).type
            yield from runs([batch], 5)

    def head(self) -> tuple | None:
        return self.next

    def pop(self) -> None:
        self.next = next(self.source, None)

    def rows(self) -> Iterator[tuple[str, str]]:
        """Role and text of the following rows up to the next audit."""
        while self.next is not None and self.next[1]:
            row = self.next
            self.pop()
            yield row[2], row[3]
