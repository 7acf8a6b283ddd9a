"""Repair of conversations by weighted finite-state composition.

The rows of a conversation are the input acceptor, the permitted edits a
transducer, the permitted sequences of roles the acceptor of a grammar. The
three are composed lazily: for each kind of row that occurs, the arcs from
grammar state to grammar state with their least weight. The cheapest path is
found in one pass in topological order (by row), over weights (cost, labels)
that compare by cost and then by the edits' initials.

Labels are held as ranks. A row's label is the insertions before it and its
edit, ``I*[DKR]``: no such label is the beginning of another, so sequences of
as many labels compare by their first difference, and the order of the paths to
one layer follows from the order of the layer before and the last label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, ship

NOT_BLANK = r"[^\x20\x09-\x0D]"
#: A text's last character that is not white space is no end of a sentence.
TRUNCATED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
#: Pairs of neighbouring initials that are in order.
LEGAL = ("su", "ua", "au")


@dataclass(frozen=True)
class Grammar:
    """A deterministic acceptor of role initials: arcs (state, initial) to state, state 0 first, and the edits' costs."""

    arcs: tuple[tuple[tuple[int, str], int], ...] = (((0, "s"), 1), ((0, "u"), 2), ((1, "u"), 2), ((2, "a"), 3), ((3, "u"), 2))
    final: tuple[int, ...] = (0, 3)
    roles: tuple[tuple[str, str], ...] = (("u", "user"), ("a", "assistant"))
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    @property
    def states(self) -> int:
        return 1 + max(state for (start, _), end in self.arcs for state in (start, end))

    def steps(self, state: int) -> list[tuple[str, int]]:
        return [(initial, end) for (start, initial), end in self.arcs if start == state]


#: An arc: state it comes from, state it leads to, cost, label, initials of the rows it gives.
Arc = tuple[int, int, int, str, str]


@cache
def _inserted(grammar: Grammar) -> tuple[Arc, ...]:
    """Insertions alone, none included. A path that meets a state twice costs more than without the loop, so such are left out."""
    names = dict(grammar.roles)
    found = []

    def go(start: int, state: int, seen: tuple[int, ...], made: str) -> None:
        found.append((start, state, grammar.insert * len(made), "I" * len(made), made))
        for initial, end in grammar.steps(state):
            if initial in names and end not in seen:
                go(start, end, (*seen, end), made + initial)

    for state in range(grammar.states):
        go(state, state, (state,), "")
    return tuple(found)


@cache
def composed(grammar: Grammar, initial: str, must_go: bool, cut: bool) -> tuple[Arc, ...]:
    """The arcs of one kind of row: insertions before it, then its edit; the least of each pair of states."""
    names = dict(grammar.roles)
    best: dict[tuple[int, int], tuple[int, str, str]] = {}
    for start, state, cost, label, made in _inserted(grammar):
        edits = [(state, grammar.delete, "D", "")]
        if not must_go:
            stays = grammar.truncated * cut
            for symbol, end in grammar.steps(state):
                if symbol == initial:
                    edits.append((end, stays, "K", symbol))
                if symbol in names:
                    edits.append((end, stays + grammar.rerole, "R", symbol))
        for end, more, edit, given in edits:
            weight = cost + more, label + edit, made + given
            if (start, end) not in best or weight < best[start, end]:
                best[start, end] = weight
    return tuple((start, end, *weight) for (start, end), weight in sorted(best.items()))


@dataclass
class Path:
    """The cheapest path through the rows seen so far, for every grammar state; rows are added one by one.

    Memory is a few bytes a row: for each state the number of the arc that led to it.
    """

    grammar: Grammar
    weights: list[tuple[int, int] | None] = field(default_factory=list)
    back: list[bytearray] = field(default_factory=list)
    kinds: bytearray = field(default_factory=bytearray)
    known: dict[tuple[str, bool, bool], int] = field(default_factory=dict)
    arcs: list[tuple[Arc, ...]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.grammar.states > 15:
            raise ValueError("a grammar of at most 15 states")
        self.weights = [(0, 0)] + [None] * (self.grammar.states - 1)  # (cost, rank of the labels)
        self.back = [bytearray() for _ in self.weights]

    def add(self, initial: str, must_go: bool, cut: bool) -> None:
        kind = initial if any(initial == symbol for (_, symbol), _ in self.grammar.arcs) else "", must_go, cut
        if kind not in self.known:
            self.known[kind] = len(self.arcs)
            self.arcs.append(composed(self.grammar, *kind))
        arcs = self.arcs[self.known[kind]]
        best: list[tuple[int, int, str, int] | None] = [None] * len(self.weights)
        for number, (start, end, cost, label, _) in enumerate(arcs):
            if self.weights[start] is not None:
                before, rank = self.weights[start]
                weight = before + cost, rank, label, number
                if best[end] is None or weight < best[end]:
                    best[end] = weight
        order = {key: rank for rank, key in enumerate(sorted({w[1:3] for w in best if w}))}
        self.weights = [w and (w[0], order[w[1:3]]) for w in best]
        for held, w in zip(self.back, best, strict=True):
            held.append(w[3] if w else 255)
        self.kinds.append(self.known[kind])

    def end(self) -> tuple[int, str, str]:
        """Cost, labels, and the initials of the rows that come out."""
        last = []
        for start, state, cost, label, made in _inserted(self.grammar):
            if state in self.grammar.final and self.weights[start] is not None:
                before, rank = self.weights[start]
                last.append((before + cost, rank, label, made, start))
        cost, _, label, made, state = min(last)
        labels, given = [label], [made]
        for place in range(len(self.kinds) - 1, -1, -1):
            state, _, _, label, made = self.arcs[self.kinds[place]][self.back[state][place]]
            labels.append(label)
            given.append(made)
        return cost, "".join(reversed(labels)), "".join(reversed(given))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows spoilt by the CRC-32 of ``conv_id:turn`` (nulls: one space) modulo 20, as text and role that are not null.

    0 drops the row (``dropped``; it stays to tell of its conversation), 1
    empties its text, 2 takes its ``.!?``, 3 gives it twice, 4 makes its role
    user. An empty table gives an empty one; repeated rows are spoilt alike.
    """
    one = F.lit(" ")
    spoil = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), one), F.coalesce(F.col("turn").cast("string"), one)).cast("binary")) % 20
    text, role = F.coalesce("text", one), F.coalesce("role", one)
    text = F.when(spoil == 1, "").when(spoil == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    found = rows.select("conv_id", "turn", F.when(spoil == 4, "user").otherwise(role).alias("role"), text.alias("text"), (spoil == 0).alias("dropped"), spoil.alias("spoil"))
    twice = F.explode(F.when(F.col("spoil") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return found.select("conv_id", "turn", "role", "text", "dropped", twice.alias("copy")).drop("copy")


def _given(rows: DataFrame, dropped: str | None) -> DataFrame:
    one = F.lit(" ")
    return rows.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"), (F.col(dropped) if dropped else F.lit(False)).alias("dropped"))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ORDER = ("turn", "role", "mark")


def audits(rows: DataFrame, grammar: Grammar | None = None, *, dropped: str | None = None) -> DataFrame:
    """Each conversation's faults and cheapest repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, made.

    Rows of a conversation stand by turn, nulls first; rows of one turn by role
    and then by a hash of their text, so repeated rows are neighbours. Nulls of
    role and text are one space, a null conv_id is a conversation of its own.
    Of a row's faults the first counts: blank, duplicate (role and text seen
    earlier), truncated. ``audit`` has the edits' initials in order, ``made``
    the initials of the rows that come out. A row that is true in the column
    ``dropped`` only tells that its conversation exists; one without other rows
    has zeros and an empty audit. An empty table gives an empty one; very long
    texts are read whole; other columns are not looked at.

    What is shuffled has no texts but their hashes, so the order of rows and
    the search for earlier equal rows, which Spark sorts and may spill, is all
    that a task holds of a conversation beside some bytes a row for its path.
    """
    grammar = grammar or Grammar()
    ship(rows.sparkSession)
    text = F.col("text")
    narrow = _given(rows, dropped).select(
        "conv_id", "turn", "role", "dropped",
        F.unhex(F.sha2(text, 256)).alias("mark"),
        (~text.rlike(NOT_BLANK)).alias("blank"),
        text.rlike(TRUNCATED).alias("cut"),
    )
    # Dealt by conversation once; both sorts are within.
    dealt = narrow.repartition(F.col("conv_id"))
    same = Window.partitionBy("conv_id", "role", "mark", "dropped").orderBy("turn")
    again = (F.row_number().over(same) > 1).alias("again")
    ordered = dealt.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "dropped", "blank", "cut", again, "role", "mark")
    ordered = ordered.sortWithinPartitions("conv_id", *ORDER, "again").select("conv_id", "turn", "initial", "dropped", "blank", "cut", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_batches(_judged(_tuples(batches), grammar), 2_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part, strict=True), kinds, strict=True)], names)

    id_type = rows.schema["conv_id"].dataType
    schema = StructType().add("conv_id", id_type)
    for one in StructType.fromDDL(f"{SUMMARY}, made string").fields:
        schema = schema.add(one)
    kinds = [_arrow(rows), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = schema.names
    return ordered.mapInArrow(run, schema)


def _arrow(rows: DataFrame) -> pa.DataType:
    """The Arrow type of the conversations' ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            yield from zip(*[c.to_pylist() for c in whole.slice(at, 1024).columns], strict=True)


def _in_batches(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _judged(rows: Iterable[tuple], grammar: Grammar) -> Iterator[tuple]:
    """One tuple for each conversation of rows that stand in order."""
    for conv_id, members in groupby(rows, key=lambda r: r[0]):
        path, faults = Path(grammar), dict.fromkeys(("blank", "again", "cut"), 0)
        first = last = None
        turns = illegal = 0
        before = None
        for _, turn, initial, dropped, blank, cut, again in members:
            if dropped:
                continue
            fault = "blank" if blank else "again" if again else "cut" if cut else None
            if fault:
                faults[fault] += 1
            path.add(initial, fault in ("blank", "again"), fault == "cut")
            if turn is not None:
                first = turn if first is None else first
                turns += turn != last
                last = turn
            illegal += before is not None and before + initial not in LEGAL
            before = initial
        cost, audit, made = path.end()
        gaps = 0 if first is None else last - first + 1 - turns
        yield conv_id, gaps, faults["blank"], faults["again"], faults["cut"], illegal, cost, audit, made


def _applied(rows: Iterable[tuple], roles: dict[str, str]) -> Iterator[tuple]:
    """(conv_id, header, its repaired rows) of rows that stand in order, each conversation's header first."""
    for conv_id, members in groupby(rows, key=lambda r: r[0]):
        header = next(members)

        def turns(header=header, members=members) -> Iterator[tuple[str, str | None, str]]:
            given = iter(header[4])
            for edit in header[3]:
                _, _, _, _, _, role, text = (None,) * 7 if edit == "I" else next(members)
                if edit == "D":
                    continue
                symbol = next(given)
                yield edit, role if edit == "K" else roles[symbol], "" if edit == "I" else text

        yield conv_id, header, turns()


def _with_headers(rows: DataFrame, found: DataFrame, dropped: str | None) -> DataFrame:
    """The rows in order by conversation, before them a header with the edits; texts are shuffled here, once."""
    extra = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("audit", "made")]
    given = _given(rows, dropped).where(~F.col("dropped"))
    mark = F.unhex(F.sha2(F.col("text"), 256)).alias("mark")
    body = given.select("conv_id", F.lit(1).alias("kind"), "turn", *extra, "role", "text", mark)
    none = F.lit(None)
    head = found.select("conv_id", F.lit(0).alias("kind"), none.cast(rows.schema["turn"].dataType).alias("turn"), "audit", "made", none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("binary").alias("mark"))
    dealt = head.unionAll(body).repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "kind", *ORDER)
    return dealt.select("conv_id", "kind", "turn", "audit", "made", "role", "text")


def repaired(rows: DataFrame, grammar: Grammar | None = None, *, dropped: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text.

    Rows are those of :func:`audits`, edited as its ``audit`` says; a row that
    is inserted has an empty text. Nulls, ties, repeats, long texts and empty
    tables as there.
    """
    grammar = grammar or Grammar()
    scratch = scratch or Scratch(rows.sparkSession, "repair")
    found = scratch.table(audits(rows, grammar, dropped=dropped), "audits")
    roles = dict(grammar.roles)
    names, kinds = ["conv_id", "place", "edit", "role", "text"], [_arrow(rows), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = ((conv_id, place, *turn) for conv_id, _, turns in _applied(_tuples(batches), roles) for place, turn in enumerate(turns))
        for part in _in_batches(turns, 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part, strict=True), kinds, strict=True)], names)

    schema = StructType().add("conv_id", rows.schema["conv_id"].dataType).add("place", "long").add("edit", "string").add("role", "string").add("text", "string")
    return _with_headers(rows, found, dropped).mapInArrow(run, schema)


def summaries(rows: DataFrame, grammar: Grammar | None = None, *, dropped: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """:func:`audits` with ``repaired_sha256``: of each conversation's repaired ``role:text``, joined by line ends.

    The digest is taken as the repaired rows go by, so no conversation is held;
    nulls, ties, repeats, long texts and empty tables as in :func:`audits`.
    """
    grammar = grammar or Grammar()
    scratch = scratch or Scratch(rows.sparkSession, "repair")
    found = scratch.table(audits(rows, grammar, dropped=dropped), "audits")
    roles, kind = dict(grammar.roles), _arrow(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for conv_id, _, turns in _applied(_tuples(batches), roles):
                digest, joint = hashlib.sha256(), b""
                for _, role, text in turns:
                    digest.update(joint + f"{role}:{text}".encode())
                    joint = b"\n"
                yield conv_id, digest.hexdigest()

        for part in _in_batches(digests(), 2_000):
            ids, hashes = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes, pa.string())], ["hashed_id", "repaired_sha256"])

    schema = StructType().add("hashed_id", rows.schema["conv_id"].dataType).add("repaired_sha256", "string")
    hashed = _with_headers(rows, found, dropped).mapInArrow(run, schema)
    return found.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id"))).drop("hashed_id")
