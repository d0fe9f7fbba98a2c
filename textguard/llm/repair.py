"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``, with their audit.

A conversation's rows stream past in order. For each of four states (nothing yet, after ``s``, after ``u``, after
``a``) the cheapest edit sequence is kept, of equally cheap ones the one whose audit letters (D, I, K, R) are least.
Edit sequences share their prefixes: each is a node that links to the sequence without its last letter, to its
ancestors 2, 4, 8, ... letters up, and holds a rolling hash. Two sequences are compared by a search along the
ancestors for their longest common prefix; equal hashes of different nodes are verified letter by letter. Letters
that all states share are written off in passing, and every state carries the running SHA-256 of its repaired turns,
so a task holds a few nodes, never a conversation's texts.

A state's letters decide its turns: R and I can only give the one role that may come next, so equal letters are
equal repairs, and of two equally cheap sequences none begins with the other.

Defined results: null roles, texts and turns count as one space (null turns come first); rows are ordered by turn,
role, text; repeated rows stay as rows (and are duplicates); rows without a conversation id form one conversation; an
empty role cannot be kept; a conversation is listed also if ``gone`` marks all its rows; an empty table gives no
rows; other input columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
MODULUS, FACTOR = (1 << 61) - 1, 0x1F3A5C7E9B2D4
#: Letters a conversation's live edit sequences may have beyond the part that is written off.
LIVE_LETTERS = 4096


class Edits:
    """A linked edit sequence: its last letter, ancestors at powers of two, length and rolling hash."""

    __slots__ = ("letter", "up", "length", "hash")

    def __init__(self, parent: Edits | None = None, letter: str = ""):
        self.letter = letter
        if parent is None:
            self.up, self.length, self.hash = (), 0, 0
            return
        up = [parent]
        while len(up[-1].up) >= len(up):
            up.append(up[-1].up[len(up) - 1])
        self.up, self.length = tuple(up), parent.length + 1
        self.hash = (parent.hash * FACTOR + ord(letter)) % MODULUS

    def ancestor(self, length: int) -> Edits:
        node, rest = self, self.length - length
        while rest:
            power = rest.bit_length() - 1
            node, rest = node.up[power], rest - (1 << power)
        return node

    def letters(self, above: Edits) -> str:
        """Letters after ``above``, which is one of the ancestors."""
        out, node = [], self
        while node is not above:
            out.append(node.letter)
            node = node.up[0]
        return "".join(reversed(out))


def _equal(a: Edits, b: Edits) -> bool:
    """Same letters? Hashes are compared first; equal ones are verified up to the shared node."""
    if a is b:
        return True
    if a.hash != b.hash:
        return False
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def precedes(a: Edits, b: Edits) -> bool:
    """Are the letters of ``a`` less than those of ``b``?"""
    length = min(a.length, b.length)
    x, y = a.ancestor(length), b.ancestor(length)
    if _equal(x, y):
        return a.length < b.length
    for power in range(len(x.up) - 1, -1, -1):  # as far up as the prefixes still differ
        if power < len(x.up) and not _equal(x.up[power], y.up[power]):
            x, y = x.up[power], y.up[power]
    return x.letter < y.letter


class Repair:
    """The states of one conversation: cost, edits and hash of the repaired turns."""

    def __init__(self) -> None:
        self.states: list[tuple[int, Edits, object] | None] = [(0, Edits(), hashlib.sha256()), None, None, None]
        self.settled: list[str] = []
        self.limit = LIVE_LETTERS
        self._insert()

    def _better(self, found: dict, to: int, cost: int, edits: Edits, *rest) -> None:
        other = found.get(to)
        if other is None or cost < other[0] or (cost == other[0] and precedes(edits, other[1])):
            found[to] = (cost, edits, *rest)

    @staticmethod
    def _hashed(origin: int, sha, turn: str):
        own = sha.copy()
        own.update((turn if origin == START else "\n" + turn).encode("utf-8", "surrogatepass"))
        return own

    def add(self, role: str, text: str, delete: bool, truncated: bool) -> None:
        found: dict[int, tuple] = {}
        for q, state in enumerate(self.states):
            if state is None:
                continue
            cost, edits, sha = state
            self._better(found, q, cost + DELETE, Edits(edits, "D"), q, sha, None)
            if delete:
                continue
            cost += TRUNCATED * truncated
            kept = MOVES.get((q, role[:1]))
            if kept is not None:
                self._better(found, kept, cost + KEEP, Edits(edits, "K"), q, sha, role)
            to = ASSISTANT if q == USER else USER
            self._better(found, to, cost + REROLE, Edits(edits, "R"), q, sha, "assistant" if q == USER else "user")
        self.states = [None] * 4
        for q, (cost, edits, origin, sha, own) in found.items():
            self.states[q] = (cost, edits, sha if own is None else self._hashed(origin, sha, f"{own}:{text}"))
        self._insert()
        start, system, _, assistant = self.states
        if assistant:  # whatever follows these costs at most so much less than after an assistant
            if start and start[0] > assistant[0] + DELETE:
                self.states[START] = None
            if system and system[0] > assistant[0]:
                self.states[SYSTEM] = None
        if max(s[1].length for s in self.states if s) > self.limit:
            self._settle()

    def _insert(self) -> None:
        """One inserted turn from each state; two in a row reach the assistant's state by way of the user's."""
        for to, origins, role in ((USER, (START, SYSTEM, ASSISTANT), "user"), (ASSISTANT, (USER,), "assistant")):
            found: dict[int, tuple] = {}
            if self.states[to]:
                found[to] = (*self.states[to][:2], None, self.states[to][2])
            for q in origins:
                if self.states[q]:
                    cost, edits, sha = self.states[q]
                    if to not in found or cost + INSERT <= found[to][0]:
                        self._better(found, to, cost + INSERT, Edits(edits, "I"), q, sha)
            if to in found:
                cost, edits, origin, sha = found[to]
                self.states[to] = (cost, edits, sha if origin is None else self._hashed(origin, sha, f"{role}:"))

    def _settle(self) -> None:
        """Write off the letters that all states share and rebuild what lies after them."""
        live = [s[1] for s in self.states if s]
        shared = live[0]
        for other in live[1:]:
            x, y = (n.ancestor(min(shared.length, other.length)) for n in (shared, other))
            if x is not y:
                for power in range(len(x.up) - 1, -1, -1):
                    if power < len(x.up) and x.up[power] is not y.up[power]:
                        x, y = x.up[power], y.up[power]
                x = x.up[0]
            shared = x
        root = shared.ancestor(0)
        self.settled.append(shared.letters(root))
        new = {id(shared): Edits()}
        for node in live:
            chain = []
            while id(node) not in new:
                chain.append(node)
                node = node.up[0]
            at = new[id(node)]
            for old in reversed(chain):
                at = new[id(old)] = Edits(at, old.letter)
        self.states = [s and (s[0], new[id(s[1])], s[2]) for s in self.states]
        self.limit = max(LIVE_LETTERS, 2 * max(n.length for n in live) - 2 * shared.length)

    def result(self) -> tuple[int, str, str]:
        """Cost, audit, SHA-256 of the repaired turns."""
        start, _, _, best = self.states
        if best is None or (start and (start[0] < best[0] or (start[0] == best[0] and precedes(start[1], best[1])))):
            best = start
        cost, edits, sha = best
        return cost, "".join(self.settled) + edits.letters(edits.ancestor(0)), sha.hexdigest()


OUT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _faults(text: Column, number: Column) -> Column:
    """First fault of a row: blank, duplicate, truncated, else empty; ``number`` counts equal rows of the conversation."""
    body = F.rtrim(text, F.lit(BLANKS))
    last = F.substring(body, -1, 1)
    return F.when(body == "", "blank").when(number > 1, "duplicate").when(F.instr(F.lit(ENDS), last) == 0, "truncated").otherwise("")


def _ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone: Column | None) -> DataFrame:
    """conv, gone, turn, role, text, fault: a conversation's rows in order within one partition, those gone first."""
    space = F.lit(" ")
    rows = rows.select(
        F.col(conv_col).alias("conv"), F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"))
    rows = rows.select("conv", "gone", *[F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("turn", "role", "text")])
    number = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.withColumn("number", number).withColumn("fault", F.when(~F.col("gone"), _faults(F.col("text"), F.col("number"))))
    return rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("gone").desc(), F.col("turn").asc_nulls_first(), "role", "text", "number")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """One row per conversation: conv id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation is read as a stream by one task (its SHA-256 is one chain); the task's memory does not grow with it
    but for the audit. Rows for which ``gone`` holds only name their conversation.
    """
    bounded_batches(rows.sparkSession)
    kind = rows.schema[conv_col].dataType.simpleString()

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        conv, state, counts, turns, before = object(), None, None, None, None
        out: list[list] = []

        def close() -> None:
            if state is not None:
                first, last, different = turns
                gaps = 0 if first is None else last - first + 1 - different
                out.append([conv, gaps, *(counts[k] for k in ("blank", "duplicate", "truncated", "illegal")), *state.result()])

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 9
            types = [schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", *OUT])
            out.clear()
            return batch

        for batch in batches:
            schema = batch.schema
            for own, gone_row, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if state is None or own != conv:
                    close()
                    conv, state, before, turns = own, Repair(), None, (None, None, 0)
                    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", ""), 0)
                if gone_row:
                    continue
                counts[fault] += 1
                if turn is not None and turn != turns[1]:
                    turns = (turn if turns[0] is None else turns[0], turn, turns[2] + 1)
                if before is not None and before + role[:1] not in LEGAL:
                    counts["illegal"] += 1
                before = role[:1]
                state.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")
            if len(out) >= 256:
                yield emit()
        close()
        if schema is not None:
            yield emit()

    ordered = _ordered(rows, conv_col, turn_col, role_col, text_col, gone).select("conv", "gone", "turn", "role", "text", "fault")
    types = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in OUT)
    return ordered.mapInArrow(repair, f"conv {kind}, {types}").withColumnRenamed("conv", conv_col)


def repaired_turns(rows: DataFrame, repaired: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """conv id, position (from 1), role, text of the repaired conversations, from the same rows and their audits."""
    space = F.lit(" ")
    inside = Window.partitionBy("conv")
    if gone is not None:
        rows = rows.where(~F.coalesce(gone, F.lit(False)))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("own"), F.coalesce(F.col(text_col), space).alias("body"))
    rows = rows.select(F.col("conv").alias("of"), "own", "body", F.row_number().over(inside.orderBy(F.col("turn").asc_nulls_first(), "own", "body")).alias("at"))
    letters = repaired.select(F.col(conv_col).alias("conv"), F.posexplode(F.split("audit", ""))).where("col <> ''")
    running = inside.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    letters = letters.select(
        "conv", "pos", F.col("col").alias("letter"), F.sum((F.col("col") != "I").cast("long")).over(running).alias("row"),
        F.sum((F.col("col") != "D").cast("long")).over(running).alias("position")).where("letter <> 'D'")
    same = letters["conv"].eqNullSafe(rows["of"]) & (letters["row"] == rows["at"]) & (letters["letter"] != "I")
    turns = letters.join(rows, same, "left")
    system = F.max(((F.col("position") == 1) & (F.col("letter") == "K") & F.col("own").startswith("s")).cast("int")).over(inside)
    turns = turns.withColumn("system", system)
    forced = F.when((F.col("position") - F.col("system")) % 2 == 1, "user").otherwise("assistant")
    return turns.select(F.col("conv").alias(conv_col), "position", F.when(F.col("letter") == "K", F.col("own")).otherwise(forced).alias("role"), F.coalesce("body", F.lit("")).alias("text"))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, gone: repeatable damage by crc32 of ``conv:turn`` modulo 20; nulls count as one space.

    0 drops the row (``gone``), 1 empties the text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))) % 20
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(
        F.col(conv_col).alias(conv_col), F.col(turn_col).alias(turn_col), F.when(kind == 4, "user").otherwise(role).alias(role_col), text.alias(text_col), (kind == 0).alias("gone"), copies.alias("copy")).drop("copy")
