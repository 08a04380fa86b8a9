"""Conversation structure repair: the cheapest edits that give every conversation legal turns.

Legal role initials are ``(s?(ua)+)?``. Edits of a conversation's rows, in turn order: Keep (0),
Rerole to user or assistant (2), Delete (3; required for blank and duplicate rows), Insert an
empty user or assistant turn anywhere (2); a truncated row that is not deleted adds 1. Among the
cheapest edit scripts the one whose initials are ASCII-least is taken.

Faults, the first that holds: blank (nothing but white space), duplicate (role and text seen
earlier in the conversation), truncated (last character that is not white space is none of
``.!?``).

Plan. Faults are columns. For duplicates, keys (hashes of role and text) that a conversation
holds more than once are counted with partial sums and give their least turn; rows meet that
list by (conversation, key), so no task holds what a conversation has seen. Then rows are
repartitioned by conversation and sorted by turn, and ``mapInPandas`` streams them: over the four
states of the pattern (nothing yet, after s, after u, after a) it carries the least cost and the
order of the least scripts from row to row and from batch to batch. Costs that count from
the cheapest state take few values, so a step is one entry of a small table, and a row's
backpointers are that entry's number: two bytes. Rows and backpointers of a conversation
over ``SPILL_BYTES`` go to unnamed scratch files of the task (gone with it; a lost task runs
again), are read backwards for the edits and forwards for the result. Memory holds a
batch and ``SPILL_BYTES`` however long the conversation.

Defined cases: null roles and texts count as one space (so null texts are blank); null turns
come first; rows of equal turn stand in order of role and text; null conversation ids make one
conversation; a role without a first character or with another than s, u, a cannot be kept;
repeated rows are duplicates; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm import common as C

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
SPILL_BYTES = 8 << 20
CHUNK_ROWS = 4096

START, SYSTEM, USER, ASSISTANT = range(4)
#: state after a turn of this initial, by state before it; others are illegal
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: the initial that a new or reroled turn must have, by state before it
NEEDS = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}


def after_inserts(state: int, n: int) -> int:
    for _ in range(n):
        state = FOLLOWS[state, NEEDS[state]]
    return state


class Steps:
    """The table of steps: (carried state, kind of row) -> next state, cost added, backpointers.

    A carried state gives for each pattern state None or (cost above the cheapest, place of its
    script among the least scripts). Scripts end with a row's letter here, so none is the
    beginning of another, and appending keeps their order. A kind is (initial, faulty,
    truncated)."""

    def __init__(self):
        self.states = [((0, 0), None, None, None)]
        self.number = {self.states[0]: 0}
        self.table: dict[tuple, tuple[int, int, int]] = {}
        self.back: list[tuple] = []  # by entry: (state before, letters) of each state
        self.back_number: dict[tuple, int] = {}

    def step(self, at: int, kind: tuple[str, bool, bool]) -> tuple[int, int, int]:
        """(next state, cost added, number of the backpointers)."""
        found = self.table.get((at, kind))
        return found if found is not None else self._new(at, kind)

    def _new(self, at: int, kind: tuple[str, bool, bool]) -> tuple[int, int, int]:
        initial, faulty, truncated = kind
        best: list = [None] * 4
        for before, held in enumerate(self.states[at]):
            if held is None:
                continue
            for n in range(3):  # a third insert leads back to the first one's state
                state, cost = after_inserts(before, n), held[0] + n * COST[INSERT]
                ways = [(DELETE, state, COST[DELETE])]
                if not faulty:
                    ways.append((REROLE, FOLLOWS[state, NEEDS[state]], COST[REROLE] + TRUNCATED * truncated))
                    if (state, initial) in FOLLOWS:
                        ways.append((KEEP, FOLLOWS[state, initial], COST[KEEP] + TRUNCATED * truncated))
                for letter, to, more in ways:
                    way = (cost + more, held[1], INSERT * n + letter, before)
                    if best[to] is None or way < best[to]:
                        best[to] = way
        least = min(b[0] for b in best if b)
        order = sorted((b[1], b[2]) for b in best if b)
        state = tuple(b and (b[0] - least, order.index((b[1], b[2]))) for b in best)
        back = tuple(b and (b[3], b[2]) for b in best)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        if back not in self.back_number:
            self.back_number[back] = len(self.back)
            self.back.append(back)
        self.table[at, kind] = out = (self.number[state], least, self.back_number[back])
        return out

    def end(self, at: int) -> tuple[int, int, str]:
        """(cost added, pattern state, letters after the last row) of the cheapest legal end."""
        ways = []
        for state, held in enumerate(self.states[at]):
            for n in range(3):
                if held is not None and after_inserts(state, n) in (START, ASSISTANT):
                    ways.append((held[0] + n * COST[INSERT], held[1], INSERT * n, state))
        cost, _, letters, state = min(ways)
        return cost, state, letters


STEPS = Steps()


class Tape:
    """Rows of a conversation, and two bytes of backpointers for each, in memory up to ``limit``
    bytes and in unnamed files beyond."""

    def __init__(self, limit: int = SPILL_BYTES):
        self.limit, self.rows, self.size, self.n = limit, [], 0, 0
        self.back = array("H")
        self.row_file = self.back_file = None

    def add(self, row: tuple, size: int, back: int) -> None:
        self.rows.append(row)
        self.back.append(back)
        self.size += size + 64
        self.n += 1
        if self.size > self.limit:
            self.row_file = self.row_file or tempfile.TemporaryFile()
            self.back_file = self.back_file or tempfile.TemporaryFile()
            for i in range(0, len(self.rows), CHUNK_ROWS):
                pickle.dump(self.rows[i : i + CHUNK_ROWS], self.row_file)
            self.back.tofile(self.back_file)
            self.rows, self.back, self.size = [], array("H"), 0

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.back)
        if self.back_file is not None:
            self.back_file.flush()
            at = self.back_file.seek(0, 2) // 2
            while at:
                n = min(at, CHUNK_ROWS)
                at -= n
                self.back_file.seek(2 * at)
                part = array("H")
                part.fromfile(self.back_file, n)
                yield from reversed(part)

    def forwards(self) -> Iterator[tuple]:
        if self.row_file is not None:
            end = self.row_file.tell()
            self.row_file.seek(0)
            while self.row_file.tell() < end:
                yield from pickle.load(self.row_file)
        yield from self.rows

    def letters(self, state: int) -> Iterator[str]:
        """Each row's letters (inserts before it, then its own), first row first, for the script
        that ends in ``state``."""
        codes: list[str] = []
        spilt = tempfile.TemporaryFile() if self.back_file is not None else None
        for number in self.backwards():
            state, letters = STEPS.back[number][state]
            codes.append(letters)
            if spilt is not None and len(codes) == CHUNK_ROWS:
                # one byte each: letter and number of inserts before it
                spilt.write(bytes(3 * "KRD".index(x[-1]) + len(x) - 1 for x in codes))
                codes = []
        yield from reversed(codes)
        if spilt is not None:
            names = [INSERT * n + x for x in "KRD" for n in range(3)]
            at = spilt.tell()
            while at:
                n = min(at, CHUNK_ROWS)
                at -= n
                spilt.seek(at)
                yield from (names[c] for c in reversed(spilt.read(n)))
            spilt.close()

    def close(self) -> None:
        for f in (self.row_file, self.back_file):
            if f is not None:
                f.close()


IN_COLUMNS = ["conv_known", "conv", "turn_known", "turn", "role", "text", "blank", "truncated", "late", "k1", "k2", "present"]
OUT_SCHEMA = "conv long, seq long, turn long, edit string, fault string, role_before string, role string, text string, cost int"


def _finish(conv, tape: Tape | None, at: int) -> Iterator[tuple]:
    """Rows of OUT_SCHEMA of one conversation, in order."""
    if tape is None:
        yield conv, 0, None, None, None, None, None, None, 0
        return
    _, state, last = STEPS.end(at)
    seq, where = 0, START
    for (turn, role, text, fault), letters in zip(tape.forwards(), tape.letters(state)):
        for x in letters[:-1]:
            yield conv, seq, None, INSERT, None, None, ROLE[NEEDS[where]], "", COST[INSERT]
            where, seq = FOLLOWS[where, NEEDS[where]], seq + 1
        x, new = letters[-1], role
        if x == DELETE:
            yield conv, seq, turn, x, fault, role, None, None, COST[x]
        else:
            initial = NEEDS[where] if x == REROLE else role[0]
            new = ROLE[initial] if x == REROLE else role
            where = FOLLOWS[where, initial]
            yield conv, seq, turn, x, fault, role, new, text, COST[x] + TRUNCATED * (fault == "truncated")
        seq += 1
    for _ in last:
        yield conv, seq, None, INSERT, None, None, ROLE[NEEDS[where]], "", COST[INSERT]
        where, seq = FOLLOWS[where, NEEDS[where]], seq + 1
    tape.close()


def _edits(frames: Iterator[pd.DataFrame], limit: int) -> Iterator[tuple]:
    """Rows of OUT_SCHEMA from frames of IN_COLUMNS sorted by conversation and turn."""
    now, tape, at, before = None, None, 0, None
    for frame in frames:
        for known, conv, has_turn, turn, role, text, blank, truncated, late, k1, k2, present in zip(
                *(frame[c].tolist() for c in IN_COLUMNS)):
            if now != (known, conv):
                if now is not None:
                    yield from _finish(now[1] if now[0] else None, tape, at)
                now, tape, at, before = (known, conv), None, 0, None
            if not present:
                continue
            tape = tape or Tape(limit)
            same = (has_turn, turn, k1, k2)
            fault = "blank" if blank else "duplicate" if late or same == before else "truncated" if truncated else None
            before = same
            at, _, back = STEPS.step(at, (role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            tape.add((turn if has_turn else None, role, text, fault), len(role) + len(text), back)
    if now is not None:
        yield from _finish(now[1] if now[0] else None, tape, at)


def _frames(rows: Iterator[tuple], names: list[str], kinds: dict[str, str], n: int = 1024) -> Iterator[pd.DataFrame]:
    held = []

    def frame():
        columns = list(zip(*held))
        return pd.DataFrame({c: pd.Series(list(columns[i]), dtype=kinds.get(c, "object")) for i, c in enumerate(names)})

    for r in rows:
        held.append(r)
        if len(held) == n:
            yield frame()
            held = []
    if held:
        yield frame()


def _names(schema: str) -> tuple[list[str], dict[str, str]]:
    pairs = [x.split() for x in schema.split(", ")]
    return [p[0] for p in pairs], {p[0]: {"long": "Int64", "int": "Int32"}[p[1]] for p in pairs if p[1] != "string"}


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def faults(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
           present: Column | None) -> DataFrame:
    """IN_COLUMNS of ``rows``, partitioned by conversation and sorted by turn."""
    one_space = F.lit(" ")
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    r = rows.select(
        F.col(conv_col).isNotNull().alias("conv_known"), F.coalesce(F.col(conv_col).cast("long"), F.lit(0)).alias("conv"),
        F.col(turn_col).isNotNull().alias("turn_known"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
        F.when(here, F.coalesce(F.col(role_col), one_space)).otherwise("").alias("role"),
        F.when(here, F.coalesce(F.col(text_col), one_space)).otherwise("").alias("text"), here.alias("present"))
    bare = trimmed(F.col("text"))
    # two hashes of different seeds stand for (role, text)
    r = r.select("*", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
                 F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "role").alias("k2"))
    key = ["conv_known", "conv", "k1", "k2"]
    place = F.struct("turn_known", "turn")
    often = r.filter("present").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    met = r.join(C.saved(often.drop("n"), "repeated-turns"), key, "left")
    late = F.coalesce(F.col("present") & (place > F.col("first")), F.lit(False))
    out = met.select(*[late.alias(c) if c == "late" else F.col(c) for c in IN_COLUMNS])
    return out.repartition("conv_known", "conv").sortWithinPartitions(
        "conv_known", "conv", "turn_known", "turn", "role", "text")


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", present: Column | None = None, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per edit, ``seq`` from 0 in each conversation: conv, seq, turn, edit (K, R, D, I),
    fault, role_before, role and text of the repaired turn (null for D), cost. The repaired
    conversation is its rows that are not D. Where ``present`` is false a row only names its
    conversation; one without any present row has a single row with a null edit."""
    C.ready(rows.sparkSession)
    names, kinds = _names(OUT_SCHEMA)
    src = faults(rows, conv_col, turn_col, role_col, text_col, present)
    return src.mapInPandas(lambda frames: _frames(_edits(frames, spill_bytes), names, kinds), OUT_SCHEMA)


AUDIT_SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                "audit string, repaired_sha256 string")
LEGAL_PAIRS = {"su", "ua", "au"}


def _audits(edits: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of AUDIT_SCHEMA from the edits of :func:`_edits`."""
    now, started = None, False
    n, cost, turns, audit, sha, role, illegal, first = {}, 0, [], [], hashlib.sha256(), None, 0, True

    def done():
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return (now, gaps, n.get("blank", 0), n.get("duplicate", 0), n.get("truncated", 0), illegal, cost,
                "".join(audit), sha.hexdigest())

    for conv, seq, turn, edit, fault, role_before, new_role, text, more in edits:
        if seq == 0:
            if started:
                yield done()
            now, started = conv, True
            n, cost, turns, audit, sha, role, illegal, first = {}, 0, [], [], hashlib.sha256(), None, 0, True
        if edit is None:
            continue
        cost += more
        audit.append(edit)
        if len(audit) > CHUNK_ROWS:
            audit = ["".join(audit)]
        if fault:
            n[fault] = n.get(fault, 0) + 1
        if edit != INSERT:
            illegal += role is not None and role + role_before[:1] not in LEGAL_PAIRS
            role = role_before[:1]
            if turn is not None:
                turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
        if edit != DELETE:
            sha.update(f"{'' if first else chr(10)}{new_role}:{text}".encode())
            first = False
    if started:
        yield done()


def conversation_audits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                        text_col: str = "text", present: Column | None = None,
                        spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """One row per conversation from its edits (see :func:`repaired_turns`): gaps in its turn
    numbers, rows by fault, adjacent rows whose initials are not su, ua or au, the edits' cost and
    letters, and the digest of the repaired turns. The edits stream; they are not gathered."""
    C.ready(rows.sparkSession)
    names, kinds = _names(AUDIT_SCHEMA)
    src = faults(rows, conv_col, turn_col, role_col, text_col, present)
    return src.mapInPandas(lambda frames: _frames(_audits(_edits(frames, spill_bytes)), names, kinds), AUDIT_SCHEMA)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text, present after the stated damage, chosen by the crc32 of
    ``conv_id:turn`` (nulls: one space) modulo 20: 0 drops a row (present is false), 1 empties
    its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    r = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                             (F.crc32(name.cast("binary")) % 20).alias("how"))
    r = r.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
                 F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(
                     F.col("text")).alias("text"),
                 (F.col("how") != 0).alias("present"), "how")
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("how") == 3, 2).otherwise(1)))).drop("copy", "how")
