"""Operator 13: repair of conversations at least cost, by lazy weighted determinisation.

The wanted order of role initials, ``(s?(ua)+)?``, is a small automaton; keeping, rerolling,
deleting and inserting rows are its weighted moves. For a conversation read from its last row to
its first, the vector of the least costs from each automaton state to the end, less its minimum, is
a state of the determinised automaton. Such vectors are few (no two costs of one vector are far
apart), are made when first met and are kept in a table with what each kind of row adds, so a row
costs one look-up. The trace goes against the scan, so from the first row on: it follows the tight
arcs, those on which the costs agree, and of all cheapest audits takes the ASCII-least.

Two passes over the rows, each partitioned by conversation and sorted: the first has no texts, only
a digest and 32 characters of each (for ties), and holds two bytes a row of one conversation,
beside the audit that it returns; the second streams the texts along the audit. A conversation's
digest hashes its rows one after the other, so a conversation of any size is one stream, held in
bounded memory, and no other task waits for it.

Odd input: a null role or text is one space, and so are a null id or turn where they are hashed;
null ids are one conversation; rows without turn come first. Rows of one turn stand by role, text
(32 characters of each, then a digest) and copy. Equal rows repeat each other, so all but the first
are duplicates. Roles count by their first character. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES

#: Automaton states: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Moves by the initial that they add; the ends at which a conversation may stop.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (START, ASSISTANT)
#: Inserted and rerolled rows are of the user or the assistant: from each state one of them.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Kinds of rows: to be deleted, or by initial (other: ``o``); capitals are truncated. Dropped rows only name their conversation.
BAD, DROPPED = "x", "-"

SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Repairs:
    """The determinised automaton, grown as rows ask for it."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.traced: dict[tuple[int, frozenset[int], str, int], tuple[str, frozenset[int]]] = {}
        self.last, _ = self.state([0 if q in ENDS else INSERT * (1 + (q == SYSTEM)) for q in range(4)])

    def state(self, costs: list[int]) -> tuple[int, int]:
        """Number of the state for these costs, and the minimum taken off."""
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    @staticmethod
    def arcs(q: int, kind: str) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, next state) of the edits that use up a row."""
        yield "D", DELETE, q
        if kind != BAD:
            more = TRUNCATED if kind.isupper() else 0
            if (kept := MOVES.get(kind.lower(), {}).get(q)) is not None:
                yield "K", more, kept
            yield "R", more + REROLE, NEXT[q]

    def before(self, state: int, kind: str) -> tuple[int, int]:
        """(state before a row of this kind, cost added), by the table."""
        found = self.table.get((state, kind))
        if found is None:
            after = self.vectors[state]
            costs = [min(cost + after[to] for _, cost, to in self.arcs(q, kind)) for q in range(4)]
            for _ in range(2):  # an inserted pair leads back, so two rounds close the costs
                costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(4)]
            found = self.table[state, kind] = self.state(costs)
        return found

    def letters(self, state: int, at: frozenset[int], kind: str, after: int) -> tuple[str, frozenset[int]]:
        """The least letters of tight arcs up to and over a row, and the automaton states that they lead to."""
        key = (state, at, kind, after)
        if key not in self.traced:
            costs, (_, added), out = self.vectors[state], self.before(after, kind), ""
            later = [c - added for c in self.vectors[after]]
            while True:
                tight = [(letter, to) for q in at for letter, cost, to in self.arcs(q, kind) if costs[q] == cost + later[to]]
                least = min([letter for letter, _ in tight] + ["I" for q in at if costs[q] == INSERT + costs[NEXT[q]]])
                out += least
                if least != "I":
                    self.traced[key] = out, frozenset(to for letter, to in tight if letter == least)
                    break
                at = frozenset(NEXT[q] for q in at if costs[q] == INSERT + costs[NEXT[q]])
        return self.traced[key]

    def audit(self, kinds: str) -> tuple[int, str]:
        """(least cost, ASCII-least audit of that cost) of a conversation, given the kinds of its rows."""
        state, total, states = self.last, 0, [self.last]
        for kind in reversed(kinds):
            state, added = self.before(state, kind)
            total += added
            states.append(state)
        states.reverse()
        total += self.vectors[state][START]
        at, out = frozenset([START]), []
        for i, kind in enumerate(kinds):
            letters, at = self.letters(states[i], at, kind, states[i + 1])
            out.append(letters)
        costs = self.vectors[self.last]
        while not any(costs[q] == 0 for q in at):
            at = frozenset(NEXT[q] for q in at if costs[q] == INSERT + costs[NEXT[q]])
            out.append("I")
        return total, "".join(out)


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every row with its damage done, as (conv_id, turn, role, text, copy, dropped); repeated rows have copy 1."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat_ws(":", said(conv), said(turn)).cast("binary")) % 20
    hurt = F.when(lot == 1, "").when(lot == 2, F.translate(said(text), ".!?", "")).otherwise(said(text))
    return df.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(lot == 4, "user").otherwise(said(role)).alias("role"),
        hurt.alias("text"),
        F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (lot == 0).alias("dropped"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Rows with what puts them in order: of one turn by role, text and copy."""
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.select("*", F.left("role", F.lit(32)).alias("by_role"), F.left("text", F.lit(32)).alias("by_text"), digest.alias("digest"))


def order() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("by_role"), F.col("by_text"), F.col("digest"), F.col("copy")]


def summary(conv, rows: Iterable[tuple], repairs: Repairs) -> tuple:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) from (conv_id, turn, initial, fault, dropped) in order."""
    faults, kinds, illegal, before = {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}, bytearray(), 0, None
    low = high = None
    turns = 0
    for _, turn, initial, fault, dropped in rows:
        if dropped:
            continue
        faults[fault] += 1
        kind = BAD if fault in ("blank", "duplicate") else initial if initial in ("s", "u", "a") else "o"
        kinds += (kind.upper() if fault == "truncated" else kind).encode()
        illegal += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
        if turn is not None:
            turns += turn != high
            low, high = turn if low is None else low, turn
    cost, audit = repairs.audit(kinds.decode())
    return conv, high - low + 1 - turns if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded length and of about ``size`` characters."""
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(out) == most or chars > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def with_id(df: DataFrame, rest: str) -> tuple[T.StructType, pa.Schema]:
    """Schema of the conversation's id, of whatever type, and further columns; for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {rest}")
    return schema, to_arrow_schema(schema)


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``damaged`` rows. No texts move."""
    solid = F.btrim("text", F.lit(SPACES))
    flaw = F.when(solid == "", "blank").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    narrow = in_order(rows).select("conv_id", "turn", "by_role", "by_text", "digest", "copy", "dropped", F.left("role", F.lit(1)).alias("initial"), flaw.alias("flaw"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "digest").orderBy(*order()))
    fault = F.when((F.col("flaw") != "blank") & (seen > 1), "duplicate").otherwise(F.col("flaw"))
    known = narrow.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions("conv_id", *order()).select("conv_id", "turn", "initial", "fault", "dropped")
    spark_schema, schema = with_id(rows, SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs = Repairs()
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        yield from batches_of((summary(conv, own, repairs) for conv, own in groupby(stream, lambda r: r[0])), schema)

    return known.mapInArrow(run, spark_schema)


def repaired(head: tuple, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the rows of a repaired conversation, given its audit and its rows after damage."""
    audit = head[-1]
    place = -((len(audit) - audit.count("D")) % 2)  # an odd length begins with the system row, which is always kept
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter != "D":
            yield role if letter == "K" else ("user", "assistant")[place % 2], text, letter
            place += 1


def along(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows after damage behind their conversation's audit, partitioned by conversation and in order: (conv_id, head, role, text)."""
    columns = in_order(rows.filter(~F.col("dropped"))).withColumn("head", F.lit(None).cast(found.select(F.struct(*found.columns[1:])).schema[0].dataType))
    heads = found.select("conv_id", F.struct(*found.columns[1:]).alias("head"))
    both = heads.unionByName(columns, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), *order()).select("conv_id", "head", "role", "text")


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, head as a tuple, iterator over its rows' (role, text))."""
    stream = ((c, h, r, t) for batch in batches for c, h, r, t in zip(*(x.to_pylist() for x in batch.columns)))
    for conv, own in groupby(stream, lambda r: r[0]):
        head = tuple(next(own)[1].values())
        yield conv, head, ((r, t) for _, _, r, t in own)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): all rows of the repaired conversations; edit is K, R or I."""
    spark_schema, schema = with_id(rows, "place long, role string, text string, edit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(((conv, place, *row) for conv, head, own in conversations(batches) for place, row in enumerate(repaired(head, own))), schema)

    return along(rows, audits(rows)).mapInArrow(run, spark_schema)


def repaired_digests(rows: DataFrame) -> DataFrame:
    """The columns of ``audits`` and repaired_sha256: of ``role:text`` of the repaired rows, joined by newlines."""
    spark_schema, schema = with_id(rows, SUMMARY + ", repaired_sha256 string")

    def digest(turns: Iterator[tuple[str, str, str]]) -> str:
        sha = hashlib.sha256()
        for k, (role, text, _) in enumerate(turns):
            sha.update(f"{chr(10) * (k > 0)}{role}:{text}".encode())
        return sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(((conv, *head, digest(repaired(head, own))) for conv, head, own in conversations(batches)), schema)

    return along(rows, audits(rows)).mapInArrow(run, spark_schema)
