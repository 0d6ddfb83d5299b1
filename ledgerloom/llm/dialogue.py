"""Repair of a conversation's role structure: the cheapest edits that make its role initials match ``(s?(ua)+)?``.

The rows of a conversation are parsed in order of turn by a generalised LR parser for the grammar

    D -> (nothing) | T | s T        T -> T P | P        P -> u a

whose tables are made from these rules. Beside shifting a row as it is, an alternative may rerole it to user or
assistant, delete it, or insert an empty turn before it. The alternatives form a graph-structured stack: each node is a
parser state on the node below, and stacks with equal tops are merged to the one of the smallest (cost, audit). That is
exact, as under an equal top only states are left out that allow the same continuations, and as two audits that have
consumed equally many rows are never prefixes of each other, so that their order does not change by what follows.

Five tops at most are alive, with costs that differ by a few edits, so the steps form a small automaton that is kept
once made. Each top carries the SHA-256 state of its repaired text, and audits are folded into strings as they grow: a
conversation is streamed in sorted order and never held, however long it is. Only its SHA-256 is sequential by nature.

Input columns: conv_id, turn, role, text; others are not read. A null conv_id is a conversation of its own. Null turns
come first; rows of one turn are ordered by role and text. A null role or text counts as one space. A row whose role has
another initial than s, u or a (none, if the role is empty) can be reroled or deleted, not kept. A conversation without
rows has an empty audit, cost 0 and the hash of the empty string. Repeated rows are duplicates, which must be deleted.
Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

RULES = (("D", ""), ("D", "T"), ("D", "sT"), ("T", "TP"), ("T", "P"), ("P", "ua"))
ROLES = {"u": "user", "a": "assistant"}
#: Costs of edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows after which an audit is folded into strings.
FOLD = 1024
#: Faults of a row, first match counts.
SOUND, BLANK, DUPLICATE, CUT = range(4)

_SPACES = " \t\n\x0b\f\r"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# --- the grammar's LR tables


def _closure(items: frozenset) -> frozenset:
    found = set(items)
    while True:
        wanted = {RULES[r][1][at] for r, at in found if at < len(RULES[r][1])}
        more = {(k, 0) for k, (left, _) in enumerate(RULES) if left in wanted} - found
        if not more:
            return frozenset(found)
        found |= more


@cache
def _goto(state: frozenset, symbol: str) -> frozenset:
    return _closure(frozenset((r, at + 1) for r, at in state if RULES[r][1][at : at + 1] == symbol))


_START = _closure(frozenset((k, 0) for k, (left, _) in enumerate(RULES) if left == "D"))


def _shift(stack: tuple, symbol: str) -> tuple | None:
    """The stack after ``symbol``, reduced while its top has nothing but one finished rule; None if it cannot follow."""
    top = _goto(stack[-1], symbol)
    if not top:
        return None
    stack = (*stack, top)
    while len(stack[-1]) == 1 and (rule := next(iter(stack[-1])))[1] == len(RULES[rule[0]][1]) and RULES[rule[0]][0] != "D":
        left, right = RULES[rule[0]]
        below = stack[: -len(right)]
        stack = (*below, _goto(below[-1], left))
    return stack


def _accepts(stack: tuple) -> bool:
    return any(RULES[r][0] == "D" and at == len(RULES[r][1]) for r, at in stack[-1])


@cache
def _inserts(stack: tuple) -> list[tuple[tuple, str]]:
    """(stack, inserted initials) of the stack itself and after inserted turns, until a top comes again."""
    found, tops, ends = [(stack, "")], {stack[-1]}, [(stack, "")]
    while ends:
        ends = [
            (new, made + initial) for old, made in ends for initial in ROLES
            if (new := _shift(old, initial)) is not None and new[-1] not in tops
        ]
        tops |= {new[-1] for new, _ in ends}
        found += ends
    return found


@cache
def _moves(stack: tuple, initial: str, fault: int) -> list[tuple[tuple, int, str, str]]:
    """(new stack, cost, edits, initials of what is put out, the row's own last) that consume one row."""
    found = []
    for at, made in _inserts(stack):
        paid, edits = INSERT * len(made), "I" * len(made)
        found.append((at, paid + DELETE, edits + "D", made))
        if fault in (SOUND, CUT):
            extra = TRUNCATED if fault == CUT else 0
            if initial in "sua" and initial and (kept := _shift(at, initial)) is not None:
                found.append((kept, paid + extra, edits + "K", made + initial))
            for other in ROLES:
                if (new := _shift(at, other)) is not None:
                    found.append((new, paid + extra + REROLE, edits + "R", made + other))
    return found


# --- the graph-structured stack, one row at a time


@cache
def step(tops: tuple, initial: str, fault: int) -> tuple[tuple, int, tuple]:
    """Next tops after a row.

    ``tops``: (stack, cost above the cheapest) in the order of their audits. Returns the new ones, by how much the
    cheapest rose, and for each its parent's place, the edits and the initials it puts out.
    """
    best: dict = {}
    for place, (stack, cost) in enumerate(tops):
        for new, paid, edits, out in _moves(stack, initial, fault):
            key = (cost + paid, place, edits)
            if new[-1] not in best or key < best[new[-1]][0]:
                best[new[-1]] = (key, new, out)
    chosen = sorted(best.values(), key=lambda b: b[0][1:])
    least = min(key[0] for key, _, _ in chosen)
    return (
        tuple((new, key[0] - least) for key, new, _ in chosen), least,
        tuple((key[1], key[2], out) for key, _, out in chosen),
    )


@cache
def finish(tops: tuple) -> tuple[int, int, str, str]:
    """(place of the top, cost, edits, initials put out) of the cheapest way to end."""
    ends = [
        ((cost + INSERT * len(made), place, "I" * len(made)), made)
        for place, (stack, cost) in enumerate(tops) for end, made in _inserts(stack) if _accepts(end)
    ]
    (cost, place, edits), made = min(ends)
    return place, cost, edits, made


class Conversation:
    """One conversation's rows, taken in order; keeps no row."""

    def __init__(self):
        self.tops = (((_START,), 0),)
        self.cost = self.rows = self.illegal = 0
        self.faults = [0, 0, 0, 0]
        self.folded = [(None, "")]  # nodes (node before, edits) at the last fold
        self.audits = self.folded
        self.hashes = [(hashlib.sha256(), False)]  # state, and whether a row is in it
        self.last_initial = None
        self.least_turn = self.most_turn = None
        self.turns = 0

    @staticmethod
    def _put(state: tuple, out: str, edit: str, role: bytes, text: bytes) -> tuple:
        """State after the turns ``out``; the last is the row itself if the last ``edit`` keeps or reroles it."""
        if not out:
            return state
        digest, begun = state[0].copy(), state[1]
        for k, initial in enumerate(out):
            if begun:
                digest.update(b"\n")
            begun = True
            own = edit in "KR" and k == len(out) - 1
            digest.update(role if own and edit == "K" else ROLES[initial].encode())
            digest.update(b":")
            if own:
                digest.update(text)
        return digest, begun

    def add(self, turn: int | None, role: str, text: bytes, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.most_turn
            self.least_turn = turn if self.least_turn is None else self.least_turn
            self.most_turn = turn
        initial = role[:1]
        if self.rows and (self.last_initial or "") + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        self.rows += 1
        self.faults[fault] += 1
        self.tops, risen, made = step(self.tops, initial if initial in "sua" else "", fault)
        self.cost += risen
        name = role.encode()
        self.hashes = [self._put(self.hashes[at], out, edits[-1], name, text) for at, edits, out in made]
        self.audits = [(self.audits[at], edits) for at, edits, _ in made]
        if self.rows % FOLD == 0:
            self._fold()

    def _unwound(self, node: tuple, until: set) -> tuple:
        """The node at which ``node``'s edits since then begin, and these edits."""
        parts = []
        while id(node) not in until:
            parts.append(node[1])
            node = node[0]
        return node, "".join(reversed(parts))

    def _fold(self) -> None:
        until = {id(node) for node in self.folded}
        self.audits = self.folded = [self._unwound(node, until) for node in self.audits]

    def result(self) -> tuple:
        place, cost, edits, out = finish(self.tops)
        audit = [edits]
        node = self.audits[place]
        while node is not None:
            audit.append(node[1])
            node = node[0]
        digest, _ = self._put(self.hashes[place], out, "I", b"", b"")
        gaps = 0 if self.least_turn is None else self.most_turn - self.least_turn + 1 - self.turns
        return (
            gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, self.cost + cost,
            "".join(reversed(audit)), digest.hexdigest(),
        )


# --- the same on tables


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present, fault) of rows that may be marked as not ``present``.

    Rows are dealt by conversation once. Both sorts inside a partition spill; equal texts of one role and conversation
    are numbered without being held.
    """
    spaces = F.lit(_SPACES)
    inner = F.rtrim(F.col("text"), spaces)
    earlier = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    dealt = rows.repartition("conv_id").withColumn("number", F.row_number().over(earlier)).withColumn("end", F.right(inner, F.lit(1)))
    fault = (
        F.when(F.col("end") == "", BLANK).when(F.col("number") > 1, DUPLICATE)
        .when(~F.col("end").isin(".", "!", "?"), CUT).otherwise(SOUND)
    )
    return dealt.select("conv_id", "turn", "role", "text", "present", fault.cast("int").alias("fault")).sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "present", F.col("turn").asc_nulls_first(), "role", "text"
    )


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation: gaps, faults, illegal neighbours, cost, audit and the repaired text's SHA-256.

    ``rows``: conv_id, turn, role, text, and optionally ``present``: a conversation of rows that are not is empty.
    """
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    read = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        _spaced("role").alias("role"), _spaced("text").alias("text"), present.alias("present"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, conversation, done = None, None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            for conv_id, turn, role, text, there, fault in zip(*columns, texts, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if conversation is None or conv_id != own:
                    if conversation is not None:
                        done.append((own, *conversation.result()))
                    own, conversation = conv_id, Conversation()
                if there:
                    conversation.add(turn, role, text, fault)
            yield _rows(done)
            done = []
        if conversation is not None:
            yield _rows([(own, *conversation.result())])

    return with_faults(read).mapInArrow(run, _RESULT)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    fields = [field.split() for field in _RESULT.split(", ")]
    columns = list(zip(*done)) if done else [[] for _ in fields]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def repaired(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of the repaired conversations: kept, reroled and inserted turns in order.

    A conversation's edits come from ``repairs``; its n-th row meets its n-th consuming edit.
    """
    edits = F.regexp_extract_all("audit", F.lit("I*[KRD]|I+$"), F.lit(0))
    units = repairs.select("conv_id", "audit", F.posexplode(edits).alias("row", "unit")).select(
        F.col("conv_id").alias("of"), "row", F.posexplode(F.split("unit", "")).alias("inside", "edit")
    ).where("edit <> ''")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text")).withColumn(
        "n", F.row_number().over(order) - 1
    )
    met = units.join(numbered, F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("row") == F.col("n")), "left").where("edit <> 'D'")
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy("row", "inside")) - 1)
    first = F.first(F.when(F.col("edit") == "K", F.substring("role", 1, 1)).otherwise("")).over(
        Window.partitionBy("of").orderBy("row", "inside").rowsBetween(Window.unboundedPreceding, 0)
    )
    turned = F.when((F.col("place") + (first == "s").cast("int")) % 2 == 0, "user").otherwise("assistant")
    return placed.select(
        F.col("of").alias("conv_id"), "place", F.when(F.col("edit") == "K", F.col("role")).otherwise(turned).alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit",
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The rows as a fixed damage leaves them; a dropped row is only marked, without its text."""
    key = F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))
    rows = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), (F.crc32(key) % 20).alias("d"))
    text = F.when(F.col("d").isin(0, 1), "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("d") != 0).alias("present"), F.when(F.col("d") == 3, 2).otherwise(1).alias("times"),
    )
    return changed.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


def op11_dialogue(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, tuple[Callable, str | None]] = {"op11_dialogue": (op11_dialogue, None)}
