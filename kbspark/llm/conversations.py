"""Conversation repair: cheapest edits by dynamic programming over rows that stream in turn order."""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Edits by their letters, which is also how ties are broken: the least text of letters.
COST = {"D": 2, "I": 5, "K": 0, "R": 1}
TRUNCATED_COST = 5
# Where a conversation stands: nothing yet, after the system's row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
MOST_INSERTS = 2
# What one conversation holds in memory; beyond it its rows and back pointers go to a file of the task.
HELD_BYTES = 4 << 20
OUT_ROWS, OUT_BYTES = 4096, 4 << 20
BLANKS = " \t\n\x0b\x0c\r"


def _inserted(state: int) -> list[tuple[int, int]]:
    """(inserts, state after them): roles that may follow without a row."""
    out = [(0, state)]
    while len(out) <= MOST_INSERTS:
        out.append((len(out), STEP[out[-1][1]].get("a", USER)))
    return out


def _moves(state: int, initial: str, must_go: bool, truncated: bool) -> Iterator[tuple[int, int, str, int]]:
    """(cost, inserts, letter, next state) of every way to take one row, inserts before it included."""
    for inserts, at in _inserted(state):
        cost = inserts * COST["I"]
        yield cost + COST["D"], inserts, "D", at
        if must_go:
            continue
        cost += TRUNCATED_COST * truncated
        if initial in STEP[at]:
            yield cost + COST["K"], inserts, "K", STEP[at][initial]
        for to in ("u", "a"):
            if to in STEP[at]:
                yield cost + COST["R"], inserts, "R", STEP[at][to]


class Repair:
    """Best edits so far for each state, kept as costs above the least and the order of their texts.

    After a row no state's text of edits is the beginning of another's (each ends with the
    letter of that row), so two texts that go on from different states compare as they did,
    and two from one state by what was added. Only this order is needed, so the states reached
    are few and every step is looked up once it was seen. A back pointer is four bytes a row:
    for each state the state before, the inserts and the letter.
    """

    _seen: dict = {}

    def __init__(self) -> None:
        self.least = 0
        self.at = ((0, 0), None, None, None)  # for each state (cost above the least, order)

    def step(self, initial: str, must_go: bool, truncated: bool) -> bytes:
        key = (self.at, initial if initial in ("s", "u", "a") else "", must_go, truncated)
        if key not in self._seen:
            self._seen[key] = self._step(*key)
        self.at, least, back = self._seen[key]
        self.least += least
        return back

    @staticmethod
    def _step(at, initial, must_go, truncated):
        best: list = [None] * 4
        for state, held in enumerate(at):
            if held is None:
                continue
            for cost, inserts, letter, to in _moves(state, initial, must_go, truncated):
                way = (held[0] + cost, held[1], "I" * inserts + letter, state, inserts, letter)
                if best[to] is None or way[:3] < best[to][:3]:
                    best[to] = way
        least = min(way[0] for way in best if way)
        order = {way[1:3]: i for i, way in enumerate(sorted((w for w in best if w), key=lambda w: w[1:3]))}
        back = bytes(0 if w is None else w[3] | w[4] << 2 | "DKR".index(w[5]) << 4 for w in best)
        return tuple(w and (w[0] - least, order[w[1:3]]) for w in best), least, back

    def end(self) -> tuple[int, int, int]:
        """(cost, state, inserts) of the best way to end here."""
        ways = []
        for state, held in enumerate(self.at):
            if held is not None:
                ways += [(held[0] + COST["I"] * n, held[1], "I" * n, state, n) for n, to in _inserted(state) if to in ENDS]
        cost, _, _, state, inserts = min(ways)
        return self.least + cost, state, inserts


class _Kept:
    """Records of one conversation: in memory, beyond HELD_BYTES in an unnamed file of this task.

    The file is the task's own scratch, as a sort's spill is: a task that is run again writes it anew.
    """

    def __init__(self) -> None:
        self.parts, self.size, self.file = [], 0, None

    def add(self, data: bytes) -> None:
        self.parts.append(data)
        self.size += len(data)
        if self.size > HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(b"".join(self.parts))
            self.parts, self.size = [], 0

    def pieces(self) -> Iterator[bytes]:
        if self.file:
            self.file.seek(0)
            while piece := self.file.read(HELD_BYTES):
                yield piece
        yield b"".join(self.parts)

    def backwards(self) -> Iterator[bytes]:
        """The same from the end, in pieces of whole back pointers."""
        yield b"".join(self.parts)
        if self.file:
            at = self.file.seek(0, 2)
            while at:
                start = max(0, at - HELD_BYTES // 4 * 4)
                self.file.seek(start)
                yield self.file.read(at - start)
                at = start

    def close(self) -> None:
        if self.file:
            self.file.close()


FIELDS = ["conv", "edit", "turn", "role", "text", "old_role", "fault"]
FAULTS = ("", "blank", "duplicate", "truncated")


class _Conversation:
    def __init__(self, conv) -> None:
        self.conv, self.repair, self.rows, self.back = conv, Repair(), _Kept(), _Kept()
        self.n = 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        role_bytes, text_bytes = role.encode(), text.encode()
        head = struct.pack("<?qBIQ", turn is not None, turn or 0, fault, len(role_bytes), len(text_bytes))
        self.rows.add(head + role_bytes + text_bytes)
        self.back.add(self.repair.step(role[:1], fault in (1, 2), fault == 3))
        self.n += 1

    def _edits(self) -> tuple[_Kept, int]:
        """The letter, inserts and state before of every row, one byte each, last row first, and the inserts at the end."""
        _, state, last = self.repair.end()
        chosen = _Kept()
        for piece in self.back.backwards():
            out = bytearray()
            for at in range(len(piece) - 4, -1, -4):
                out.append(piece[at + state])
                state = out[-1] & 3
            chosen.add(bytes(out))
        return chosen, last

    def _records(self) -> Iterator[tuple]:
        head, held = struct.calcsize("<?qBIQ"), b""
        for piece in self.rows.pieces():
            held, at = held + piece, 0
            while len(held) - at >= head:
                known, turn, fault, role, text = struct.unpack_from("<?qBIQ", held, at)
                end = at + head + role + text
                if end > len(held):
                    break
                yield turn if known else None, held[at + head : at + head + role].decode(), held[at + head + role : end].decode(), fault
                at = end
            held = held[at:]

    def edited(self) -> Iterator[tuple]:
        """Rows of FIELDS: every row with its edit, inserted rows where they belong."""
        if not self.n:
            yield self.conv, None, None, None, None, None, None
            return
        chosen, last = self._edits()
        state = START

        def inserts(n: int) -> Iterator[tuple]:
            nonlocal state
            for _ in range(n):
                state = _inserted(state)[1][1]
                yield self.conv, "I", None, ROLE[state], "", None, None

        letters = (b for piece in chosen.backwards() for b in reversed(piece))
        for (turn, role, text, fault), code in zip(self._records(), letters, strict=True):
            yield from inserts(code >> 2 & 3)
            letter, new = "DKR"[code >> 4], role
            if letter == "K":
                state = STEP[state][role[:1]]
            elif letter == "R":
                state = STEP[state].get("a", USER)
                new = ROLE[state]
            yield self.conv, letter, turn, new, text, role, FAULTS[fault]
        yield from inserts(last)
        for kept in (self.rows, self.back, chosen):
            kept.close()


def _repaired(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", kind), ("edit", pa.string()), ("turn", pa.int64()), *[(f, pa.string()) for f in FIELDS[3:]]])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        def edits() -> Iterator[tuple]:
            now = None
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("conv", "gone", "turn", "role", "text", "fault")]
                for conv, gone, *row in zip(*columns):
                    if now is None or conv != now.conv:
                        yield from now.edited() if now else ()
                        now = _Conversation(conv)
                    if not gone:
                        now.add(*row)
            yield from now.edited() if now else ()

        out, size = [], 0
        for edit in edits():
            out.append(edit)
            size += len(edit[4] or "")
            if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    return run


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """Every row with its cheapest edit, in order: conv, edit, turn, role, text, old_role, fault.

    Rows of a conversation go by turn (null first), rows of one turn by role and text in byte
    order. A row's fault is the first of: blank (nothing but blanks), duplicate (role and text
    of an earlier row), truncated (its last character that is no blank is none of . ! ?), or
    none (empty). Edits: K keeps a row, R gives it the role user or assistant, D deletes it,
    I inserts an empty row of role user or assistant; blank and duplicate rows must go, and a
    truncated row that stays costs more (see COST). What stays begins with s, u, a as one
    optional system row and then pairs of user and assistant, or is nothing. Of the cheapest
    ways the one whose letters make the least text is taken. role and text are those after the
    edit (those deleted for D), old_role the one before.

    Nulls in role and text count as one space; a row of an empty role can't be kept as it is; rows without conversation are one conversation.
    Repeated rows are duplicates. Rows where the condition `gone` holds are left out, but their
    conversations are not: one without rows gives one row with null edit. An empty table gives
    no rows; other columns are not read.

    Rows are dealt by conversation once; duplicates are numbered there by an external sort, a
    second one puts turns in order, and the edits stream through Arrow batches. Of one
    conversation a task holds HELD_BYTES of texts and as much of back pointers, the rest in a
    file; its order is sequential, so one conversation is one task's work, whatever its length.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    given = rows.select(F.col(conv_col).alias("conv"), F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    given = given.withColumn("text", F.when(~F.col("gone"), F.col("text"))).withColumn("h", F.xxhash64("gone", "role", "text"))
    same = Window.partitionBy("conv", "h", "gone", "role", "text").orderBy("turn")
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", 1).when(F.col("nth") > 1, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    dealt = given.repartition("conv").withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)
    dealt = dealt.select("conv", "gone", "turn", "role", "text", "fault", "nth").sortWithinPartitions("conv", "gone", F.asc_nulls_first("turn"), "role", "text", "nth")
    kind = given.schema["conv"].dataType
    return dealt.drop("nth").mapInArrow(_repaired(to_arrow_type(kind)), f"conv {kind.simpleString()}, edit string, turn long, role string, text string, old_role string, fault string")


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Report:
    def __init__(self, conv) -> None:
        self.conv, self.counts, self.letters = conv, dict.fromkeys(FAULTS, 0), []
        self.illegal = self.cost = self.turns = 0
        self.first = self.last = self.initial = None
        self.text, self.empty = hashlib.sha256(), True

    def add(self, edit, turn, role, text, old_role, fault) -> None:
        if edit is None:
            return
        self.letters.append(edit)
        self.cost += COST[edit]
        if edit != "I":
            self.counts[fault] += 1
            self.cost += TRUNCATED_COST * (fault == "truncated" and edit != "D")
            initial = old_role[:1]
            self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            if turn is not None:
                self.turns += turn != self.last
                self.first = turn if self.first is None else self.first
                self.last = turn
        if edit != "D":
            self.text.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv, gaps, *(self.counts[f] for f in FAULTS[1:]), self.illegal, self.cost, "".join(self.letters), self.text.hexdigest()


def _reported(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", kind), *[(c, pa.int64()) for c in REPORT], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        now, done = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for conv, *edit in zip(*(batch.column(c).to_pylist() for c in FIELDS)):
                if now is None or conv != now.conv:
                    done += [now.row()] if now else []
                    now = _Report(conv)
                now.add(*edit)
            if done:
                yield batch_of(done)
                done = []
        if now:
            yield batch_of([now.row()])

    return run


def report(edits: DataFrame) -> DataFrame:
    """One row a conversation of repair_conversations(), read as it streams, in the same tasks.

    conv, gaps (turns missing between the least and the greatest), rows by fault, illegal
    (neighbours before the repair whose initials may not meet), cost, audit (the letters), and
    the SHA-256 of the repaired rows as role:text, joined by newlines.
    """
    kind = edits.schema["conv"].dataType
    counts = ", ".join(f"{c} long" for c in REPORT)
    return edits.mapInArrow(_reported(to_arrow_type(kind)), f"conv {kind.simpleString()}, {counts}, audit string, repaired_sha256 string")


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn, for measuring a repair.

    Of twenty remainders of crc32(conv:turn), 0 marks the row as gone (column gone), 1 empties
    its text, 2 takes its . ! ? away, 3 repeats it, 4 gives it the role user. Nulls count as one
    space, but a null turn stays null. Other columns are dropped.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    new_text = F.when(kind == 1, "").when(kind == 2, F.translate(text(text_col), ".!?", "")).otherwise(text(text_col))
    role = F.when(kind == 4, "user").otherwise(text(role_col))
    out = rows.select(F.col(conv_col).alias(conv_col), F.col(turn_col).alias(turn_col), role.alias(role_col), new_text.alias(text_col), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
