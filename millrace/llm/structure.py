"""Conversation structure repair: the cheapest edits that leave an optional system turn and pairs of user and assistant.

Conversations are brought together by one shuffle and sorted by turn inside each task. A dynamic program runs over that
stream; its state is carried from one Arrow batch to the next, so a conversation may be as long as it likes. Each row
leaves one small number, the way back through the program at this row. Those and the rows of the conversation at hand are
kept in spools that spill, and are read backward (edits) and forward (repaired turns) when the conversation ends.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import col
from millrace.llm.spool import Spool

# Costs of the edits. A kept or rerolled row that breaks off adds TRUNCATED.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
BLANK_MARKS = " \t\n\x0b\x0c\r"
# What is wrong with a row: the first that holds counts.
SOUND, BLANK, REPEATED, CUT = range(4)

# States: nothing yet, after the system turn, after a user turn, after an assistant turn. A conversation may end in ENDS.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
# From any state every other's best continuation can be followed for at most this much more: by deleting a system turn
# (2) or inserting one or both sides of a pair. A state behind the best one by more than that never wins.
SLACK = 2 * INSERT
BATCH_ROWS = 2000
BATCH_TEXT = 4 << 20
# Ways back are held in pieces of this many rows.
WAYS = 1 << 16


def wanted(state: int) -> str:
    """Initial of the only role that may be inserted, or given to a row, in this state."""
    return "a" if state == USER else "u"


ROLES = {"u": "user", "a": "assistant"}
# Inserts before a row and its own edit.
LETTERS = [inserts + edit for inserts in ("", "I", "II") for edit in "DKR"]


@dataclass(frozen=True)
class Front:
    """For each state the least cost above the best state's (None: out of the race) and the order of the edits so far."""

    costs: tuple[int | None, ...]
    ranks: tuple[int, ...]


FIRST = Front((0, None, None, None), (0, 0, 0, 0))


class Program:
    """The dynamic program. What one row does to a front depends on the front and the row's kind alone, so it is worked
    out once and looked up afterwards; there are few fronts, as costs are relative and bounded by SLACK.

    Edits that cost the same are ordered by their initials. The edits up to some row always end with that row's own D, K
    or R, so of two states' edits neither begins with the other: their order is settled whatever follows.
    """

    def __init__(self):
        self.fronts = [FIRST]
        self.numbers = {FIRST: 0}
        self.ways: list[tuple] = []
        self.way_numbers: dict[tuple, int] = {}
        self.known: dict[tuple[int, str, int], tuple[int, int, int]] = {}

    def step(self, front: int, initial: str, fault: int) -> tuple[int, int, int]:
        """(next front, cost added to its base, number of the way back)."""
        key = (front, initial, fault)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._work_out(self.fronts[front], initial, fault)
        return found

    def _work_out(self, front: Front, initial: str, fault: int) -> tuple[int, int, int]:
        best: list[tuple | None] = [None] * 4
        for state, cost in enumerate(front.costs):
            if cost is None:
                continue
            at = state
            for inserts in range(3):
                spent, before = cost + inserts * INSERT, "I" * inserts
                moves = [(at, spent + DELETE, "D")]
                if fault not in (BLANK, REPEATED):
                    extra = TRUNCATED if fault == CUT else 0
                    if (at, initial) in STEP:
                        moves.append((STEP[at, initial], spent + extra, "K"))
                    moves.append((STEP[at, wanted(at)], spent + REROLE + extra, "R"))
                for to, total, letter in moves:
                    tried = (total, front.ranks[state], before + letter, state)
                    if best[to] is None or tried < best[to]:
                        best[to] = tried
                at = STEP[at, wanted(at)]
        base = min(b[0] for b in best if b)
        best = [b if b and b[0] - base <= SLACK else None for b in best]
        order = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
        ranks = [0] * 4
        for rank, (_, _, to) in enumerate(order):
            ranks[to] = rank
        after = Front(tuple(b[0] - base if b else None for b in best), tuple(ranks))
        if after not in self.numbers:
            self.numbers[after] = len(self.fronts)
            self.fronts.append(after)
        way = tuple((b[3], b[2]) if b else None for b in best)
        if way not in self.way_numbers:
            self.way_numbers[way] = len(self.ways)
            self.ways.append(way)
        return self.numbers[after], base, self.way_numbers[way]

    def end(self, front: int) -> tuple[int, int, str]:
        """(cost above the base, state after the last row, inserts after it)."""
        ways = []
        for state, cost in enumerate(self.fronts[front].costs):
            if cost is not None:
                inserts = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
                ways.append((cost + inserts * INSERT, self.fronts[front].ranks[state], state, "I" * inserts))
        cost, _, state, tail = min(ways)
        return cost, state, tail


class Edits:
    """A few letters for each row, written from the last row to the first and read from the first to the last."""

    def __init__(self):
        self.pieces = Spool()

    def __iter__(self) -> Iterator[str]:
        for piece in reversed(self.pieces):
            yield from (LETTERS[code] for code in reversed(piece))


@dataclass
class Conversation:
    """One conversation while its rows come in, and what it amounts to."""

    program: Program
    key: str | None = None
    rows: Spool = field(default_factory=Spool)
    back: Spool = field(default_factory=Spool)

    def begin(self, key: str | None) -> None:
        self.key, self.front, self.cost = key, 0, 0
        self.faults = [0, 0, 0, 0]
        self.illegal, self.last = 0, None
        self.low = self.high = None
        self.turns = 0
        self.rows.clear()
        self.back.clear()
        self.recent = array("H")

    def add(self, turn: str | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        self.faults[fault] += 1
        if turn is not None:
            number = int(turn)
            if number != self.high:  # rows come in the order of their turns
                self.turns += 1
            self.low = number if self.low is None else self.low
            self.high = number
        self.front, cost, way = self.program.step(self.front, initial, fault)
        self.cost += cost
        self.recent.append(way)
        if len(self.recent) >= WAYS:
            self.back.add(self.recent, 2 * WAYS)
            self.recent = array("H")
        self.rows.add((role, text), 200 + 2 * len(role) + 2 * len(text))

    def edits(self) -> tuple[int, Edits, str]:
        """(total cost, for each row the inserts before it and its own edit, inserts at the end)."""
        cost, state, tail = self.program.end(self.front)
        ways, found = self.program.ways, Edits()
        for piece in chain([self.recent], reversed(self.back)):
            taken = bytearray()
            for way in reversed(piece):
                state, letters = ways[way][state]
                taken.append(LETTERS.index(letters))
            found.pieces.add(bytes(taken), len(taken))
        return self.cost + cost, found, tail

    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns

    def turns_after(self, edits: Edits, tail: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of each turn that is left."""
        state = START
        for (role, text), letters in zip(self.rows, edits):
            for letter in letters:
                if letter == "D":
                    continue
                initial = role[:1] if letter == "K" else wanted(state)
                state = STEP[state, initial]
                yield letter, role if letter == "K" else ROLES[initial], "" if letter == "I" else text
        for letter in tail:
            initial = wanted(state)
            state = STEP[state, initial]
            yield letter, ROLES[initial], ""


def _stream(frames: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """Each conversation of a task, when its last row has come."""
    conversation, begun = Conversation(Program()), False
    for frame in frames:
        # None in a column of texts arrives as None; no column is numeric, so nothing is widened to floats
        for key, turn, role, text, fault in zip(*(frame[c].tolist() for c in ("key", "turn", "role", "text", "fault"))):
            if not begun or key != conversation.key:
                if begun:
                    yield conversation
                conversation.begin(key)
                begun = True
            if fault is not None:
                conversation.add(turn, role, text, int(fault))
    if begun:
        yield conversation


def _prepared(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, there: Column) -> DataFrame:
    """(key, turn, role, text, fault) by conversation and turn, one shuffle; ``fault`` is null for rows that are not there.

    The repeats are found by a window whose groups lie inside a conversation, so it uses the same shuffle.
    """
    rows = df.select(
        col(conv_col).cast("string").alias("key"),
        col(turn_col).cast("long").alias("at"),
        F.coalesce(col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(there, F.lit(False)).alias("there"),
    ).repartition("key")
    same = Window.partitionBy("key", "role", "text", "there").orderBy(F.col("at").asc_nulls_first())
    said = F.rtrim(F.col("text"), F.lit(BLANK_MARKS))
    whole = F.endswith(said, F.lit(".")) | F.endswith(said, F.lit("!")) | F.endswith(said, F.lit("?"))
    fault = F.when(said == "", BLANK).when(F.col("nth") > 1, REPEATED).when(~whole, CUT).otherwise(SOUND)
    flagged = rows.withColumn("nth", F.row_number().over(same)).withColumn("fault", F.when(F.col("there"), fault.cast("string")))
    ordered = flagged.sortWithinPartitions("key", F.col("at").asc_nulls_first(), "role", "text")
    return ordered.select("key", F.col("at").cast("string").alias("turn"), "role", "text", "fault")


def _frames(names: list[str], rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[pd.DataFrame]:
    """Frames of many small or few large rows."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= BATCH_ROWS or weight > BATCH_TEXT:
            yield pd.DataFrame(held, columns=names, dtype=object)
            held, weight = [], 0
    if held:
        yield pd.DataFrame(held, columns=names, dtype=object)


def _typed(found: DataFrame, df: DataFrame, conv_col: str) -> DataFrame:
    """The conversation's id in its own type again."""
    kind = df.select(col(conv_col)).schema[0].dataType
    return found.select(F.col("key").cast(kind).alias(conv_col), *[c for c in found.columns if c != "key"])


def repair(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None
) -> DataFrame:
    """(conv_id, position long from 0, edit, role, text): the turns of every conversation after the cheapest edits.

    ``edit`` is K (kept), R (rerolled) or I (inserted, with an empty text); deleted rows are left out, and so are
    conversations of which nothing is left. Rows count by their role's first letter: s, u and a; a row with another one, or
    with an empty role, can be rerolled or deleted only. A null role or text is one space. Rows are taken by turn (nulls
    first), equal turns by role and text. Rows without a conversation id form one conversation. ``there``: rows for which
    it does not hold are left out, but not their conversation. Other columns are not read.
    """

    def run(frames):
        def rows():
            for conversation in _stream(frames):
                _, edits, tail = conversation.edits()
                for position, turn in enumerate(conversation.turns_after(edits, tail)):
                    yield conversation.key, position, *turn

        yield from _frames(["key", "position", "edit", "role", "text"], rows(), lambda r: len(r[4]) + len(r[3]))

    ready = _prepared(df, conv_col, turn_col, role_col, text_col, F.lit(True) if there is None else there)
    return _typed(ready.mapInPandas(run, "key string, position long, edit string, role string, text string"), df, conv_col)


REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", there: Column | None = None
) -> DataFrame:
    """One row for each conversation: what is wrong with it, the cheapest edits and the digest of what ``repair`` gives.

    gaps: turns missing between the first and the last; blank, duplicate, truncated: rows by their first fault; illegal:
    neighbours whose initials are not su, ua or au; cost and audit: the cheapest edits (initials of Delete, Insert, Keep,
    Rerole in order), of equally cheap ones the first in ASCII order; repaired_sha256: of ``role:text``, joined by line
    breaks. Rows and nulls are taken as in ``repair``; a conversation without rows has zeros, an empty audit and the hash
    of nothing.
    """

    def digest(conversation: Conversation, edits: Edits, tail: str) -> str:
        sha, joint = hashlib.sha256(), b""
        for _, role, text in conversation.turns_after(edits, tail):
            sha.update(joint + f"{role}:{text}".encode("utf-8", "replace"))
            joint = b"\n"
        return sha.hexdigest()

    def run(frames):
        def rows():
            for c in _stream(frames):
                cost, edits, tail = c.edits()
                audit = "".join(edits) + tail
                yield c.key, c.gaps(), c.faults[BLANK], c.faults[REPEATED], c.faults[CUT], c.illegal, cost, audit, digest(c, edits, tail)

        names = [part.split()[0] for part in REPORT.split(", ")]
        yield from _frames(names, rows(), lambda r: len(r[7]))

    ready = _prepared(df, conv_col, turn_col, role_col, text_col, F.lit(True) if there is None else there)
    return _typed(ready.mapInPandas(run, REPORT), df, conv_col)


def damage(df: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with known faults, and the condition for rows that are still there.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes the marks ``.!?``, 3 repeats it, 4
    makes it the user's. Nulls are one space.
    """
    space = F.lit(" ")
    spelled = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    hit = F.crc32(spelled.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = df.select(
        "conv_id",
        "turn",
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (hit != 0).alias("_there"),
        F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy"), F.col("_there")


def damage_report(df: DataFrame) -> DataFrame:
    """``report`` over conversations that were damaged on purpose; one row for each conversation of ``df``."""
    rows, there = damage(df)
    return report(rows, there=there)
