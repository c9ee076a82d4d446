"""Conversation structure repair: cheapest edits by Four-Russians block tables.

A repaired conversation is empty, or an optional system message and then one or
more pairs of user and assistant.  Messages may be kept (free), given the role
user or assistant (2) or deleted (3), and empty messages of user or assistant may
be inserted (2); a truncated message that stays costs 1 more, a blank or repeated
one must go.  Of the cheapest edits those come first whose initials (D, I, K, R)
are least as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import stored
from panelmill.runtime import attach

# The white space that makes no content, marks that end a message, costs, and role initials.
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
INITIALS = "sua"
KEY = ("conv_id", "turn", "role", "digest")
# A symbol is a letter for class (role initial, or other) and fault (none, truncated, blank, duplicate).
FAULTS = ("none", "truncated", "blank", "duplicate")
SEGMENT = 65_536
BLOCK = 4
# From start, system, user and assistant: where an initial leads; nothing else is allowed.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
WAY = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLE = {"u": "user", "a": "assistant"}
LETTERS_SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class BlockTables:
    """Normalised costs to go through every block of ``width`` symbols.

    A cost vector holds, for each state, the least cost from there to an
    accepted end.  Less its minimum it is one of few vectors, since inserts lead
    from each state to each other one at a bounded cost.  ``step`` and ``extra``
    give the vector before a block, and what was taken off it, for the vector
    behind the block.  Symbol 0 must be deleted; the others are 1 + 2 * class,
    and one more if truncated.
    """

    SYMBOLS = 1 + 2 * (len(INITIALS) + 1)

    def __init__(self, width: int = BLOCK) -> None:
        self.width = width
        end = self._inserts([0, np.inf, np.inf, 0])
        self.vectors, known, moves = [end], {end: 0}, []
        for vector in self.vectors:
            for symbol in range(self.SYMBOLS):
                before = self._before(vector, symbol)
                least = min(before)
                normal = tuple(x - least for x in before)
                if normal not in known:
                    known[normal] = len(self.vectors)
                    self.vectors.append(normal)
                moves.append((known[normal], int(least)))
        single = np.array(moves).reshape(-1, self.SYMBOLS, 2)
        self.step, self.extra = single[..., 0], single[..., 1]
        self.single = single.tolist()
        for _ in range(width - 1):
            # The block's first symbol comes last, as costs run from the end.
            behind, more = self.step, self.extra
            self.step = single[behind, :, 0].transpose(0, 2, 1).reshape(len(single), -1)
            self.extra = (more[..., None] + single[behind, :, 1]).transpose(0, 2, 1).reshape(len(single), -1)
        self.step, self.extra = self.step.tolist(), self.extra.tolist()
        self.weights = self.SYMBOLS ** np.arange(width - 1, -1, -1)
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.edits: dict[tuple[int, int, int], tuple[str, int]] = {}

    @staticmethod
    def _inserts(vector: list[float]) -> tuple[float, ...]:
        for _ in vector:
            vector = [min(v, INSERT + vector[NEXT[s, WAY[s]]]) for s, v in enumerate(vector)]
        return tuple(vector)

    @staticmethod
    def _options(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
        """Edits of a message in the order of their initials: letter, cost, next state."""
        yield "D", DELETE, state
        if symbol:
            kind, truncated = divmod(symbol - 1, 2)
            initial = INITIALS[kind : kind + 1]
            if (state, initial) in NEXT:
                yield "K", TRUNCATED * truncated, NEXT[state, initial]
            yield "R", REROLE + TRUNCATED * truncated, NEXT[state, WAY[state]]

    def _before(self, vector: tuple[float, ...], symbol: int) -> tuple[float, ...]:
        return self._inserts(
            [min(cost + vector[to] for _, cost, to in self._options(s, symbol)) for s in range(len(vector))]
        )

    def _edit(self, behind: int, symbol: int, state: int) -> tuple[str, int]:
        """Letters up to and with the edit of one message, and the state behind it."""
        key = behind, symbol, state
        if key not in self.edits:
            after = self.vectors[behind]
            before = self._before(after, symbol)
            letters, found = "", None
            while found is None:
                options = {o: to for o, cost, to in self._options(state, symbol) if cost + after[to] == before[state]}
                inserted = NEXT[state, WAY[state]]
                if "D" not in options and INSERT + before[inserted] == before[state]:
                    letters, state = letters + "I", inserted
                else:
                    found = min(options)
            self.edits[key] = letters + found, options[found]
        return self.edits[key]

    def _trace(self, behind: int, block: int, state: int) -> tuple[str, int]:
        """Expand a block from its end, then follow the least letters from its start."""
        key = behind, block, state
        if key not in self.traced:
            symbols = [block // int(w) % self.SYMBOLS for w in self.weights]
            vectors = [behind]
            for symbol in symbols[:0:-1]:
                vectors.append(self.single[vectors[-1]][symbol][0])
            letters = ""
            for symbol, vector in zip(symbols, vectors[::-1], strict=True):
                more, state = self._edit(vector, symbol, state)
                letters += more
            if len(self.traced) >= 200_000:
                self.traced.clear()
            self.traced[key] = letters, state
        return self.traced[key]

    def solve(self, symbols: np.ndarray) -> tuple[int, str]:
        """Least cost, and initials of the first of the cheapest edits."""
        head = len(symbols) % self.width
        blocks = (symbols[head:].reshape(-1, self.width) @ self.weights).tolist()
        vector, cost = 0, 0
        behind = [0] * len(blocks)
        for at in range(len(blocks) - 1, -1, -1):
            behind[at] = vector
            block = blocks[at]
            cost += self.extra[vector][block]
            vector = self.step[vector][block]
        rest = symbols[:head].tolist()
        ahead = [0] * head
        for at in range(head - 1, -1, -1):
            ahead[at] = vector
            vector, least = self.single[vector][rest[at]]
            cost += least
        cost += int(self.vectors[vector][0])
        parts, state = [], 0
        for symbol, after in zip(rest, ahead, strict=True):
            letters, state = self._edit(after, symbol, state)
            parts.append(letters)
        for block, after in zip(blocks, behind, strict=True):
            letters, state = self._trace(after, block, state)
            parts.append(letters)
        while state not in (0, 3):
            state = NEXT[state, WAY[state]]
            parts.append("I")
        return cost, "".join(parts)


@cache
def tables() -> BlockTables:
    return BlockTables()


def _messages(rows: DataFrame, present: Column | None) -> DataFrame:
    """Rows with their role and text filled, the digest that orders ties, and the symbol before duplicates are known."""
    held = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], held.alias("held"))
    content = F.rtrim("text", F.lit(SPACES))
    fault = F.when(content == "", FAULTS.index("blank")).when(F.right(content, F.lit(1)).isin(*ENDS), 0).otherwise(1)
    place = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    kind = F.when((F.col("role") == "") | (place == 0), len(INITIALS)).otherwise(place - 1)
    return rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "fault": fault, "kind": kind})


def _symbols(messages: DataFrame) -> DataFrame:
    """One row per distinct message of a turn: ``symbol``, ``n`` copies, and whether its text was ``seen`` before.

    Equal rows are counted before the shuffle, texts stay behind.  Messages
    whose text comes at several turns are told from a counted side.
    """
    here = F.col("held")
    slim = messages.select(
        "conv_id",
        F.when(here, F.col("turn")).alias("turn"),
        F.when(here, F.col("role")).otherwise("").alias("role"),
        F.when(here, F.col("digest")).alias("digest"),
        F.when(here, F.col("fault")).alias("fault"),
        F.when(here, F.col("kind")).alias("kind"),
    )
    slim = stored(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n")), "turns")
    blank = FAULTS.index("blank")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeated = slim.where(F.col("fault") != blank).groupBy("conv_id", "role", "digest")
    repeated = repeated.agg(F.min(at).alias("first_at"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    repeated = repeated.select("conv_id", "role", "digest", "first_at")
    marked = attach(slim, repeated, ["conv_id", "role", "digest"], "left")
    seen = F.col("first_at").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_at.turn"))
    return marked.select(*KEY, "fault", "kind", "n", F.when(F.col("fault") == blank, False).otherwise(seen).alias("seen"))


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in KEY]


def _segments(marked: DataFrame, segment: int) -> DataFrame:
    """Symbols of each conversation in order, in pieces of at most ``segment`` messages.

    Sorting by range lets a long conversation span tasks; a task cuts its share
    into pieces, which carry one letter per message and the turns they span.
    """
    kind = marked.schema["conv_id"].dataType.simpleString()
    slim = marked.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    names = ["conv_id", "part", "seq", "symbols", "first_turn", "last_turn", "turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        conv, letters, size, first, last, turns, begun = None, [], 0, None, None, 0, False
        out: list[tuple] = []

        def cut() -> None:
            nonlocal letters, size, first, last, turns, seq
            out.append((conv, part, seq, "".join(letters), first, last, turns))
            letters, size, first, last, turns, seq = [], 0, None, None, 0, seq + 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "fault", "kind", "n", "seen")]
            for name, turn, fault, role, n, seen in zip(*columns, strict=True):
                if not begun or name != conv:
                    if begun:
                        cut()
                    conv, begun = name, True
                if fault is None:
                    continue
                if turn is not None and turn != last:
                    first = turn if first is None else first
                    last, turns = turn, turns + 1
                again = chr(65 + 4 * role + (fault if fault == 2 else 3))
                head = again if seen else chr(65 + 4 * role + fault)
                while n:
                    taken = min(n, segment - size)
                    letters.append(head + again * (taken - 1))
                    head, size, n = again, size + taken, n - taken
                    if size == segment:
                        cut()
                        if n and turn is not None:
                            first, last, turns = turn, turn, 1
            if out:
                yield _batch(out, names, batch.schema.field("conv_id").type)
                out = []
        if begun:
            cut()
            yield _batch(out, names, batch.schema.field("conv_id").type)

    schema = f"conv_id {kind}, part int, seq int, symbols string, first_turn long, last_turn long, turns long"
    return slim.select(*KEY, "fault", "kind", "n", "seen").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def judge(symbols: str) -> tuple[int, int, int, int, int, str]:
    """``blank, duplicate, truncated, illegal, cost, audit`` of a conversation's symbols."""
    codes = np.frombuffer(symbols.encode("ascii"), np.uint8).astype(np.int64) - 65
    kind, fault = codes // 4, codes % 4
    truncated, blank, duplicate = (int(np.count_nonzero(fault == f)) for f in (1, 2, 3))
    pairs = 4 * kind[:-1] + kind[1:]
    legal = np.isin(pairs, [4 * INITIALS.index(p[0]) + INITIALS.index(p[1]) for p in ("su", "ua", "au")])
    cost, audit = tables().solve(np.where(fault >= 2, 0, 1 + 2 * kind + (fault == 1)))
    return blank, duplicate, truncated, int(np.count_nonzero(~legal)), cost, audit


def plan_repairs(rows: DataFrame, present: Column | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per ``conv_id``: ``gaps, blank, duplicate, truncated, illegal, cost, audit``.

    ``rows`` holds ``conv_id, turn, role, text``; messages are taken by turn,
    nulls first, those of one turn by role and the SHA-256 of the text.  A row
    whose ``present`` is not true only names its conversation.  A null role or
    text is one space, a null ``conv_id`` a conversation of its own; a role
    without an allowed initial cannot be kept; repeated rows are duplicates; an
    empty table gives no rows; other columns are not read.

    What is gathered for a conversation is one letter per message, as its audit
    has.
    """
    segments = _segments(_symbols(_messages(rows, present)), segment)
    piece = F.struct("part", "seq", "symbols", "first_turn", "last_turn", "turns")
    whole = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for pieces in batch.column("pieces"):
                pieces = pieces.as_py()
                turned = [p for p in pieces if p["turns"]]
                gaps = 0
                if turned:
                    joints = sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
                    distinct = sum(p["turns"] for p in turned) - joints
                    gaps = min(turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - distinct, 2**63 - 1)
                found.append((gaps, *judge("".join(p["symbols"] for p in pieces))))
            columns = [pa.array(c, pa.int64()) for c in list(zip(*found, strict=True))[:6]] if found else []
            if found:
                audits = pa.array([f[6] for f in found], pa.string())
                names = [c.split()[0] for c in LETTERS_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns, audits], ["conv_id", *names])

    return whole.mapInArrow(run, f"conv_id {kind}, {LETTERS_SCHEMA}")


def _replayed(rows: DataFrame, plans: DataFrame, present: Column | None) -> DataFrame:
    """Each plan and behind it the messages of its conversation, in order."""
    messages = _messages(rows, present).where("held")
    absent = [F.lit(None).cast(messages.schema[c].dataType).alias(c) for c in (*KEY[1:], "text")]
    plan = plans.select("conv_id", F.lit(0).alias("kind"), *absent, F.struct(*plans.columns[1:]).alias("plan"))
    none = F.lit(None).cast(plan.schema["plan"].dataType).alias("plan")
    both = plan.unionByName(messages.select("conv_id", F.lit(1).alias("kind"), *KEY[1:], "text", none))
    return both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *_order()[1:])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict | None, str | None, str | None]]:
    """``conv_id, plan, role, text``: a plan where a conversation begins, then its repaired messages."""
    audit, at, state, conv = "", 0, 0, None

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield conv, None, ROLE[WAY[state]], ""
            state, at = NEXT[state, WAY[state]], at + 1

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "plan", "role", "text")]
        for name, plan, role, text in zip(*columns, strict=True):
            if plan is not None:
                yield from inserted()
                conv, audit, at, state = name, plan["audit"], 0, 0
                yield conv, plan, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role = ROLE[WAY[state]]
            state = NEXT[state, role[0]]
            yield conv, None, role, text
    yield from inserted()


def repaired_messages(rows: DataFrame, plans: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id, position, role, text``: the messages that the plans leave or insert, numbered from 0."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        position, size, conv_type = 0, 0, None

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv_id").type
                yield batch

        def out() -> pa.RecordBatch:
            kinds = (conv_type, pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "position", "role", "text"])

        for conv, plan, role, text in _edited(typed(batches)):
            if plan is not None:
                position = 0
                continue
            held.append((conv, position, role, text))
            position, size = position + 1, size + len(text)
            if size > 4_000_000 or len(held) >= 10_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return _replayed(rows, plans, present).mapInArrow(run, f"conv_id {kind}, position long, role string, text string")


def repaired_digests(rows: DataFrame, plans: DataFrame, present: Column | None = None) -> DataFrame:
    """The plans, and the SHA-256 of each repaired conversation (``role:text``, joined by line ends).

    A digest has to see its conversation's messages one after the other: they
    stream through one task, which holds no more than a batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current, digest, joint, conv_type, fields = None, None, b"", None, None

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal conv_type, fields
            for batch in batches:
                conv_type, fields = batch.schema.field("conv_id").type, list(batch.schema.field("plan").type)
                yield batch

        def out() -> pa.RecordBatch:
            kinds = [conv_type, *[f.type for f in fields], pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *[f.name for f in fields], "repaired_sha256"])

        for conv, plan, role, text in _edited(typed(batches)):
            if plan is not None:
                if current is not None:
                    done.append((*current, digest.hexdigest()))
                    if len(done) >= 10_000:
                        yield out()
                        done = []
                current, digest, joint = (conv, *plan.values()), hashlib.sha256(), b""
                continue
            digest.update(joint + f"{role}:{text}".encode())
            joint = b"\n"
        if current is not None:
            done.append((*current, digest.hexdigest()))
        if done:
            yield out()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plans.schema.fields)
    return _replayed(rows, plans, present).mapInArrow(run, f"{schema}, repaired_sha256 string")
