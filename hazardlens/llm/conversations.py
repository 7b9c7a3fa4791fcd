"""Conversation structure repair: the cheapest edits that make turns alternate.

A sound conversation is empty, or one or more pairs of user and assistant with at most one system turn before them: in role
initials ``(s?(ua)+)?``. A turn is kept (cost 0), given the role user or assistant (1) or deleted (2); a user or assistant turn
without text is inserted (5). Blank turns and turns whose role and text came before must be deleted; one that is cut off and
stays costs 5 more. Of all cheapest edits the one whose audit, the initials of its edits K, R, D and I in order, is least counts.

Turns are aligned with each target string in turn, that of the nearest length first, in a Wagner-Fischer table over (turn,
place in the target). The cheapest cost so far bounds how many turns can be deleted and inserted: a length that needs more
is not feasible, and of a table only that band of diagonals is filled. Equal costs are decided by the audits read back.

The tables of a conversation of n turns take up to n^3 steps, so those of over ``LONG`` turns are aligned in one table of n rows in
which the places of all targets that have the same role and the same ends behind them are one: exact as well, and linear.

Order is by turn (null first), then role and text. A null role or text is one space. Rows with a null conversation id are one
conversation. Conversations are sorted and stream through their tasks; of one at hand some bytes for each turn are in memory,
and texts beyond ``HELD_BYTES`` are on the task's disk until its edits are known. Only the four named columns and
``gone`` are read, so others and their names do not matter.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = {"u": "user", "a": "assistant"}
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Turns of a conversation up to which each target length has a table of its own.
LONG = 256
#: Bytes of one conversation's texts that stay in memory.
HELD_BYTES = 1 << 24
NEVER = 1 << 60
SOUND, MUST_GO, CUT = 0, 1, 2
_BLANK = frozenset(" \t\n\x0b\x0c\r")
_LEGAL = {"su", "ua", "au"}


class Turns:
    """Initials and states of the turns of a conversation, in order."""

    def __init__(self, initials: str = "", states: bytes = b""):
        self.initials, self.states = list(initials), bytearray(states)

    def key(self) -> tuple[str, bytes]:
        """What the alignment depends on; initials that no target has are alike."""
        return "".join(i if i in ("s", "u", "a") else "?" for i in self.initials), bytes(self.states)


def keep_cost(state: int) -> int:
    return NEVER if state == MUST_GO else CUT_OFF if state == CUT else 0


def row_edits(initial: str, state: int, want: str) -> list[tuple[str, int]]:
    """The edits, least audit first, that turn one turn into a turn of the initial ``want``."""
    stay = keep_cost(state)
    out = [("K", stay)] if initial == want else []
    return out + ([("R", stay + RENAME)] if want in ROLES else [])


def align_to(initials: str, states: bytes, target: str, most: int) -> tuple[int, str] | None:
    """Cost and least audit of the edits to ``target``, if at most ``most``.

    Table cells are the cost of what is left from (turn i, place j). With as many inserts as ``most`` allows, j - i
    lies between the fewest and the most: outside that band a path costs more.
    """
    n, m = len(initials), len(target)
    if INSERT * max(0, m - n) + DELETE * max(0, n - m) > most:
        return None
    inserts = (most + DELETE * (m - n)) // (INSERT + DELETE)
    low, high = (m - n) - inserts, inserts
    if not low <= 0 <= high:
        return None
    width = high - low + 1
    table = [[NEVER] * (width + 2) for _ in range(n + 1)]  # table[i][j - i - low + 1]; a wall on either side
    for i in range(n, -1, -1):
        row, below = table[i], table[i + 1] if i < n else None
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            k = j - i - low + 1
            best = 0 if i == n and j == m else NEVER
            if j < m and target[j] in ROLES:
                best = min(best, INSERT + row[k + 1])
            if i < n:
                best = min(best, DELETE + below[k - 1])
                if j < m:
                    for _, cost in row_edits(initials[i], states[i], target[j]):
                        best = min(best, cost + below[k])
            row[k] = best
    total = table[0][1 - low]
    if total > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        k, left = j - i - low + 1, table[i][j - i - low + 1]
        if i < n and DELETE + table[i + 1][k - 1] == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] in ROLES and INSERT + table[i][k + 1] == left:
            audit.append("I")
            j += 1
        else:
            audit.append(next(e for e, cost in row_edits(initials[i], states[i], target[j]) if cost + table[i + 1][k] == left))
            i, j = i + 1, j + 1
    return total, "".join(audit)


def align_lengths(initials: str, states: bytes) -> tuple[int, str]:
    """The cheapest alignment with any target, nearest lengths first; the cost so far bounds lengths and bands."""
    n = len(initials)
    best = (DELETE * n, "D" * n)  # the empty target
    for off in range(0, 2 * n + 3):
        for m in {n - off, n + off}:
            if m < 2 or (m % 2 and "s" not in initials):
                continue
            found = align_to(initials, states, "s" * (m % 2) + "ua" * (m // 2), best[0])
            if found:
                best = min(best, found)
        if min(INSERT, DELETE) * (off + 1) > best[0]:
            break
    return best


#: Places of all targets by what may follow: at the start, a user turn owed, an assistant turn owed, or a pair behind.
START, OWED, ANSWER, PAIRED = range(4)
_NEXT = {START: "u", OWED: "u", ANSWER: "a", PAIRED: "u"}


def align_folded(initials: str, states: bytes) -> tuple[int, str]:
    """The same result in one pass over the turns, whatever their number."""
    n = len(initials)

    def with_inserts(cells: list[int]) -> list[int]:
        """An insert leads to the answer that is owed or to the pair behind; two of them lead nowhere new."""
        out = list(cells)
        for _ in range(2):
            for p in range(4):
                out[p] = min(out[p], INSERT + out[PAIRED if p == ANSWER else ANSWER])
        return out

    def after(i: int, p: int) -> list[tuple[str, int, int]]:
        """Edits of turn i at place p with their costs and the places behind them, least audit first."""
        want = _NEXT[p]
        out = [("D", DELETE, p)]
        if p == START and initials[i] == "s":
            out.append(("K", keep_cost(states[i]), OWED))
        return out + [(e, cost, PAIRED if p == ANSWER else ANSWER) for e, cost in row_edits(initials[i], states[i], want)]

    cells = with_inserts([0, NEVER, NEVER, 0])
    total, choices = cells, []
    for i in range(n - 1, -1, -1):
        total = with_inserts([min(cost + cells[q] for _, cost, q in after(i, p)) for p in range(4)])
        chosen = bytearray(4)
        for p in range(4):
            chosen[p] = ord(next((e for e, cost, q in after(i, p)[:1] if cost + cells[q] == total[p]), "")
                            or ("I" if INSERT + total[PAIRED if p == ANSWER else ANSWER] == total[p] else "")
                            or next(e for e, cost, q in after(i, p)[1:] if cost + cells[q] == total[p]))
        choices.append(chosen)
        cells = total
    audit, p = bytearray(), START
    for i in range(n):
        while (e := chr(choices[n - 1 - i][p])) == "I":
            audit += b"I"
            p = PAIRED if p == ANSWER else ANSWER
        audit += e.encode()
        if e != "D":
            p = OWED if p == START and e == "K" and initials[i] == "s" else PAIRED if p == ANSWER else ANSWER
    while p in (OWED, ANSWER):
        audit += b"I"
        p = PAIRED if p == ANSWER else ANSWER
    return cells[START], audit.decode()


@lru_cache(maxsize=1 << 16)
def _aligned_short(initials: str, states: bytes) -> tuple[int, str]:
    return align_lengths(initials, states)


def align(initials: str, states: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits. Short conversations repeat, so their results are kept."""
    if len(initials) > LONG:
        return align_folded(initials, states)
    return _aligned_short(initials, states) if len(initials) <= 16 else align_lengths(initials, states)


class Conversation:
    """One conversation while its sorted turns come in."""

    def __init__(self, key):
        self.key, self.turns = key, Turns()
        self.seen: set[bytes] = set()
        self.texts = tempfile.SpooledTemporaryFile(max_size=HELD_BYTES)
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last = None
        self.n_distinct = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:  # sorted by turn
            self.low = turn if self.low is None else self.low
            self.high, self.last, self.n_distinct = turn, turn, self.n_distinct + 1
        said = f"{role}:{text}".encode()
        print_ = hashlib.blake2b(f"{len(role)}:".encode() + said, digest_size=16).digest()
        state = SOUND
        last = next((c for c in reversed(text) if c not in _BLANK), None)
        if last is None:
            self.blank, state = self.blank + 1, MUST_GO
        elif print_ in self.seen:
            self.duplicate, state = self.duplicate + 1, MUST_GO
        elif last not in ".!?":
            self.truncated, state = self.truncated + 1, CUT
        self.seen.add(print_)
        initial = role[:1]
        if self.turns.initials and self.turns.initials[-1] + initial not in _LEGAL:
            self.illegal += 1
        self.turns.initials.append(initial)
        self.turns.states.append(state)
        for part in (role, text):
            raw = part.encode()
            self.texts.write(len(raw).to_bytes(8, "little") + raw)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.n_distinct

    def _next(self) -> str:
        return self.texts.read(int.from_bytes(self.texts.read(8), "little")).decode()

    def repaired(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that the edits leave, in order; an edit decides by what stands before it."""
        self.texts.seek(0)
        place, rows = 0, iter(self.turns.initials)
        owed = 0  # turns behind a system turn count from it
        for edit in audit:
            want = "ua"[(place - owed) % 2]
            if edit == "I":
                yield edit, ROLES[want], ""
                place += 1
                continue
            initial, role, text = next(rows), self._next(), self._next()
            if edit == "D":
                continue
            if edit == "K" and initial == "s":
                owed = 1
            yield edit, role if edit == "K" else ROLES[want], text
            place += 1


def sorted_turns(rows: DataFrame) -> DataFrame:
    """Each conversation in one task, in order. Rows that are ``gone`` come first and only name their conversation."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), gone.alias("gone"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("gone"), "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    at = None
    for batch in batches:
        for key, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
            if at is None or key != at.key:
                if at is not None:
                    yield at
                at = Conversation(key)
            if not gone:
                at.add(turn, role, text)
    if at is not None:
        yield at


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def repair(rows: DataFrame, batch: int = 1000) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated and illegal (adjacent roles) as found, the cost and audit of
    the cheapest edits, and the SHA-256 of the repaired ``role:text`` lines.

    ``rows`` has conv_id, turn, role and text; rows that a boolean column ``gone`` marks only name their conversation.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for c in _conversations(batches):
            cost, audit = align(*c.turns.key())
            sha = hashlib.sha256()
            for k, (_, role, text) in enumerate(c.repaired(audit)):
                sha.update((b"\n" if k else b"") + f"{role}:{text}".encode())
            c.texts.close()
            out.append((c.key, *(getattr(c, x) for x in _COUNTS), cost, audit, sha.hexdigest()))
            if len(out) == batch:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = ["conv_id", *_COUNTS, "cost", "audit", "repaired_sha256"]
    kind = rows.schema["conv_id"].dataType
    types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]
    longs = ", ".join(f"{c} long" for c in (*_COUNTS, "cost"))
    return sorted_turns(rows).mapInArrow(work, f"conv_id {kind.simpleString()}, {longs}, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame, batch: int = 1000) -> DataFrame:
    """The repaired conversations: (conv_id, place from 0, edit, role, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for c in _conversations(batches):
            for place, turn in enumerate(c.repaired(align(*c.turns.key())[1])):
                out.append((c.key, place, *turn))
                if len(out) == batch:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                    out = []
            c.texts.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    names, types = ["conv_id", "place", "edit", "role", "text"], [to_arrow_type(kind), pa.int64(), *[pa.string()] * 3]
    return sorted_turns(rows).mapInArrow(work, f"conv_id {kind.simpleString()}, place long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): turns with known faults, for measuring a repair; which fault a row gets depends
    on a hash of its conversation and turn. 0 drops it, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 says user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(fault == 4, "user").otherwise(space("role"))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), F.explode(F.array_repeat(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("_")
    ).drop("_")
