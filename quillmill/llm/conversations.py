"""Conversation structure repair: the cheapest edits that make a conversation's roles read (s?(ua)+)?, by a Viterbi
search that gives out edits as soon as they are certain.

States: nothing emitted yet, after system, after user, after assistant. Survivors, one a state at most, are leaves
of a tree of backpointers; a node counts its references (children and survivors). A survivor that loses is released,
and with it every ancestor that nothing else refers to. Once the root has one child and no survivor of its own, all
survivors share that child: its edit is given out, and it becomes the root. So memory holds only what is still open,
and text is hashed or handed on as it is decided. Equal costs are settled by the letters of both open paths back to
their common ancestor, whole; what lies before is equal. A survivor that another one beats by more than any ending
could win back is released too (nothing emitted and after-system would otherwise stay for ever).

Spark deals rows by conversation, sorts them and numbers repeated messages in one shuffle; a task reads its rows in
order, a batch at a time, and never holds a conversation. All rows of a conversation pass one task, since the
contract hashes their text as one chain; sorting and numbering spill.

Rows: null role, text, turn or conv_id reads as one space in text, role and the damage key. Rows of equal turn are
taken by role, then text; null turns first; a null conv_id is a conversation. A role that is empty or starts with
other letters than s, u, a fits no place: such rows are reroled or deleted. Empty table: no rows. Very long texts
are kept whole. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
#: States by the initial of the role emitted last; "" is the start. Which initials may follow, and where to.
FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}
#: The most that a path gains by being in the first state and not after an assistant's turn: one system message kept
#: that would be deleted there; after a system message nothing is possible that is not possible after an assistant's.
EDGE = {"": DELETE, "s": 0}
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}


class Node:
    """One edit of a path; refs: children and survivors that hang on it."""

    __slots__ = ("children", "depth", "edit", "parent", "refs", "row")

    def __init__(self, parent: Node | None, edit: str, row: tuple[str, str] | None) -> None:
        self.parent, self.edit, self.row, self.refs, self.children = parent, edit, row, 0, set()
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1
            parent.children.add(self)

    def release(self) -> None:
        node = self
        node.refs -= 1
        while node.refs == 0 and node.parent:
            up = node.parent
            up.children.discard(node)
            up.refs -= 1
            node.parent, node = None, up


def precedes(one: Node, edit: str, other: Node, other_edit: str) -> bool:
    """Whether one's path and then edit come before other's and other_edit, as letters from their common ancestor."""
    left, right = [edit], [other_edit]
    while one is not other:
        if one.depth >= other.depth:
            left.append(one.edit)
            one = one.parent
        else:
            right.append(other.edit)
            other = other.parent
    return left[::-1] < right[::-1]


class Repair:
    """The search over one conversation. give(edit, role, text) gets each edit once it is certain; role and text
    are those of the repaired row, or of the deleted one."""

    def __init__(self, give: Callable[[str, str, str], None]) -> None:
        self.give, self.last = give, ""
        self.root = Node(None, "", None)
        self.root.refs = 1
        self.paths: dict[str, tuple[int, Node]] = {"": (0, self.root)}

    def offer(self, found: dict, state: str, cost: int, node: Node, edit: str, row: tuple[str, str] | None) -> None:
        held = found.get(state)
        if held is None or cost < held[0] or cost == held[0] and precedes(node, edit, *held[1:3]):
            found[state] = (cost, node, edit, row)

    def insertions(self) -> None:
        """An inserted turn where that makes a state cheaper; two in a row suffice, as more come back to a state."""
        for state, befores in (("u", ("", "s", "a")), ("a", ("u",))):
            found = {}
            for before in befores:
                if before in self.paths:
                    cost, node = self.paths[before]
                    self.offer(found, state, cost + INSERT, node, "I", ("", ""))
            if state in found:
                cost, parent, edit, row = found[state]
                held = self.paths.get(state)
                if held is None or cost < held[0] or cost == held[0] and precedes(parent, edit, held[1].parent, held[1].edit):
                    node = Node(parent, edit, row)
                    node.refs += 1
                    self.paths[state] = (cost, node)
                    if held:
                        held[1].release()

    def read(self, role: str, text: str, fault: int) -> None:
        self.insertions()
        found: dict[str, tuple] = {}
        row, extra = (role, text), CUT if fault == TRUNCATED else 0
        for state, (cost, node) in self.paths.items():
            self.offer(found, state, cost + DELETE, node, "D", row)
            if fault in (BLANK, DUPLICATE):
                continue
            for initial in FOLLOW[state]:
                if role[:1] == initial:
                    self.offer(found, initial, cost + extra, node, "K", row)
                elif initial != "s":
                    self.offer(found, initial, cost + extra + REROLE, node, "R", row)
        if "a" in found:
            for state, most in EDGE.items():
                if state in found and found[state][0] > found["a"][0] + most:
                    del found[state]
        before, self.paths = self.paths, {}
        for state, (cost, parent, edit, kept) in found.items():
            node = Node(parent, edit, kept)
            node.refs += 1
            self.paths[state] = (cost, node)
        for _, node in before.values():
            node.release()
        self.settle()

    def settle(self) -> None:
        while self.root.refs == 1 and self.root.children:
            (child,) = self.root.children
            child.parent, self.root = None, child
            self.tell(child)

    def tell(self, node: Node) -> None:
        role, text = node.row
        if node.edit != "D":
            self.last = "s" if node.edit == "K" and role[:1] == "s" else "a" if self.last == "u" else "u"
            if node.edit != "K":
                role = NAMES[self.last]
        self.give(node.edit, role, text)

    def end(self) -> int:
        self.insertions()
        best = None
        for state in ("", "a"):
            if state in self.paths:
                cost, node = self.paths[state]
                if best is None or cost < best[0] or cost == best[0] and precedes(node, "", best[1], ""):
                    best = (cost, node)
        rest, node = [], best[1]
        while node is not self.root:
            rest.append(node)
            node = node.parent
        for node in reversed(rest):
            self.tell(node)
        return best[0]


class Conversation:
    """Counts and edits of one conversation, read row by row."""

    def __init__(self, key: object, give: Callable[[str, str, str], None]) -> None:
        self.key, self.repair, self.rows = key, Repair(give), 0
        self.faults, self.illegal = [0, 0, 0, 0], 0
        self.first = self.turn = self.initial = None
        self.turns = 0

    def read(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.turns == 0 else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.rows and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial, self.rows = role[:1], self.rows + 1
        self.faults[fault] += 1
        self.repair.read(role, text, fault)

    def gaps(self) -> int:
        return self.turn - self.first + 1 - self.turns if self.turns else 0


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn; columns conv_id, turn, role, text, gone.
    A dropped row stays as a mark that its conversation exists (gone)."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(word(conv_id), F.lit(":"), word(turn))) % 20
    was = F.when(draw == 1, F.lit("")).when(draw == 2, F.translate(word(text), ".!?", "")).otherwise(word(text))
    return conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(draw == 4, F.lit("user")).otherwise(word(role)).alias("role"),
        was.alias("text"),
        (draw == 0).alias("gone"),
        F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy_"),
    ).drop("copy_")


def fault_of(text: Column, seen: Column) -> Column:
    words = F.rtrim(text, F.lit(common.ASCII_SPACE))
    return (
        F.when(words == "", BLANK)
        .when(seen > 1, DUPLICATE)
        .when(~F.substring(words, -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(NONE)
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation, with their faults, each task's rows in reading order."""
    dealt = rows.repartition("conv_id")
    seen = "row_number() over (partition by conv_id, gone, digest_ order by turn nulls first)"
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    numbered = dealt.withColumn("digest_", digest).withColumn("seen_", F.expr(seen))
    out = numbered.select("conv_id", "turn", "role", "text", "gone", fault_of(F.col("text"), F.col("seen_")).alias("fault"))
    return out.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE)


def read(batches: Iterator[pa.RecordBatch], start: Callable[[object], Conversation], end: Callable[[Conversation], None]) -> Iterator[None]:
    """Reads a task's rows, conversation by conversation; yields after each batch."""
    now = None
    for batch in batches:
        for key, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    end(now)
                now = start(key)
            if not gone:
                now.read(turn, role, text, fault)
        yield
    if now is not None:
        end(now)
    yield


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (as damaged() gives them): its faults, the cost and letters of the
    cheapest repair, and a digest of the repaired rows as role:text, one a line."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {SUMMARY}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key_type = [], None

        def start(key: object) -> Conversation:
            digest, letters, lines = hashlib.sha256(), [], [0]

            def give(edit: str, role: str, text: str) -> None:
                letters.append(edit)
                if edit != "D":
                    digest.update(f"{chr(10) * (lines[0] > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    lines[0] += 1

            out = Conversation(key, give)
            out.letters, out.digest = letters, digest
            return out

        def end(c: Conversation) -> None:
            cost = c.repair.end()
            done.append((c.key, c.gaps(), *c.faults[1:], c.illegal, cost, "".join(c.letters), c.digest.hexdigest()))

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.column(0).type
                yield batch

        for _ in read(watched(), start, end):
            if done:
                types = [key_type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done.clear()

    names = ["conv_id", *(x.split()[0] for x in SUMMARY.split(", "))]
    return in_order(rows).mapInArrow(work, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The edits themselves: conv_id, place (0, 1, ... in the edited order), edit (K, R, D or I), role and text."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key_type = [], None

        def start(key: object) -> Conversation:
            place = [0]

            def give(edit: str, role: str, text: str) -> None:
                done.append((key, place[0], edit, role, text))
                place[0] += 1

            return Conversation(key, give)

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.column(0).type
                yield batch

        for _ in read(watched(), start, lambda c: c.repair.end()):
            if done:
                types = [key_type, pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = zip(zip(*done, strict=True), types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["conv_id", "place", "edit", "role", "text"])
                done.clear()

    return in_order(rows).mapInArrow(work, f"conv_id {kind}, place long, edit string, role string, text string")
