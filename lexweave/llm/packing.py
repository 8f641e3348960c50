"""Operator 4: token-id output, packed best-fit-decreasing.

Documents are cut into pieces of at most one row's length, losing nothing; whole rows go out as they
are, and the rest are packed by best-fit-decreasing: the largest first, each into the fullest open
row that still takes it, which a segment tree over capacities finds in log2(length) steps. Packing
runs window by window within each partition (a window is a bounded number of tokens), so there is no
shuffle, a task holds one window, and a lost task is redone from its own input.

A packed row carries its ids as one line of a matrix, cumulative segment lengths, and positions that
start again with each segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import slices

SCHEMA = "pack_id string, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{id}>, doc_offsets array<bigint>"


class Capacities:
    """Open rows by free capacity: counts in a segment tree over 0 to ``length``."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = free + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least capacity of ``need`` or more, and that capacity; it leaves the tree."""
        i = need + self.size
        if not self.count[i]:
            # Up to the first ancestor whose right neighbour holds something, then down its left edge.
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.rows[free].pop(), free


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Items (by number) of each row; sizes are 1 to ``length``; equal sizes keep their order."""
    rows: list[list[int]] = []
    open_ = Capacities(length)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        got = open_.take(sizes[k])
        if got is None:
            rows.append([k])
            row, free = len(rows) - 1, length
        else:
            row, free = got
            rows[row].append(k)
        if free > sizes[k]:
            open_.add(free - sizes[k], row)
    return rows


def pieces(ids: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, ids) of consecutive pieces that together are the document."""
    for at in range(0, len(ids), length):
        yield at, ids[at : at + length]


def packed(items: list[tuple[int, int, np.ndarray]], length: int) -> Iterator[tuple]:
    """Rows from (document, offset, ids) pieces, padded to ``length`` with zeros after the last segment."""
    for row in best_fit_decreasing([len(x[2]) for x in items], length):
        own = [items[k] for k in row]
        ends = np.cumsum([0, *(len(x[2]) for x in own)])
        ids, at = np.zeros(length, "<u4"), np.zeros(length, "<u4")
        for (_, _, part), a in zip(own, ends, strict=False):
            ids[a : a + len(part)] = part
            at[a : a + len(part)] = np.arange(len(part))
        yield int(ends[-1]), ids.tobytes(), ends.tolist(), at.tobytes(), [x[0] for x in own], [x[1] for x in own]


def pack_tokens(df: DataFrame, vocabulary: str, length: int = 2048, window_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text (operator 3's encoder) and pack all ids into rows of ``length``.

    Returns a row for each packed row: pack_id (input partition and window), row (number in the
    window), n_tokens, ids and position_ids (little-endian uint32, ``length`` of each, zeros behind
    n_tokens), cu_seqlens (0 first), doc_ids and doc_offsets of its segments. Null and empty texts
    have no ids and so no segment; ids are numbers or texts, and null ids stay null in doc_ids;
    repeated rows are packed each. An empty table gives no rows. Other columns are not read. A window is closed at ``window_tokens``,
    so only its last rows are part empty.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    whole = df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kind, arrow = ("bigint", pa.int64()) if whole else ("string", pa.string())
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(arrow), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = codec(source.value)
        part, window = TaskContext.get().partitionId(), 0
        items: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            out = [(f"{part}-{window}", k, *x) for k, x in enumerate(packed(items, length))]
            for a in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out[a : a + 256], strict=True), kinds, strict=True)], names)

        for b in slices(batches, 256):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for at, ids in pieces(np.frombuffer(c.encode(text), "<u4"), length):
                    items.append((doc, at, ids))
                    held += len(ids)
                    if held >= window_tokens:
                        yield from close()
                        items, held, window = [], 0, window + 1
        if items:
            yield from close()

    return df.select(F.col(id_col).cast(kind), F.col(text_col).alias("_text")).mapInArrow(run, SCHEMA.format(id=kind))


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet files: ids and position_ids are the matrices' lines, cu_seqlens their segments."""
    rows.write.mode("error").parquet(path)


def unpack(rows: DataFrame) -> DataFrame:
    """doc_id, ids of every document that has any, put together again from all rows. Ids must be distinct."""
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out = []
            for ids, cu, docs, offsets in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                out += [(d, o, ids[4 * x : 4 * y]) for d, o, x, y in zip(docs, offsets, cu[:-1], cu[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (arrow, pa.int64(), pa.binary()), strict=True)], ["doc_id", "at", "ids"])

    parts = rows.select("ids", "cu_seqlens", "doc_ids", "doc_offsets").mapInArrow(run, f"doc_id {kind}, at long, ids binary")
    return parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("p")).select("doc_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
