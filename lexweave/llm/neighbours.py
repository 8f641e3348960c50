"""Operator 11: nearest neighbours of a query set by a block matrix join. Results are exact.

The product of queries and candidates is cut into cells: queries are dealt into groups of bounded
size by hash, candidates into lanes by turns, and a cell is one group with one lane. Each task
holds a group, streams its lane in blocks and multiplies int8 codes (a vector is step * code plus a
rest of known length), so a distance between codes lies within the two rests of the true distance.
Pairs whose lower bound passes the best distances so far are recomputed from the original vectors
in double precision, component after component. Each query keeps its k + 1 best in a cell, and the
cells' lists are merged by heaps.

Equal vectors of a block or group are one vector with its smallest ids, so a vector that a third
of all rows share costs no more than another. No pair is written but the k + 1 best of a query and
cell; the number of lanes follows the cluster, not the input.

Odd input: vectors null, empty, zero or holding null or non-finite components take no part, nor do
null ids. Vectors of different lengths are not compared. Rows that agree in id and vector count
once, as do rows of one id at one distance; a query is an id with a vector, and its candidates are
all rows but those. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components that a group of queries may hold, and those of a block of candidates.
GROUP_VALUES = 1 << 22
BLOCK_VALUES = 1 << 19
#: Pairs of one tile, and pairs recomputed at once.
TILE_PAIRS = 1 << 21
PAIRS_AT_ONCE = 1 << 17
#: Pairs of one task at most, in the mean.
TASK_PAIRS = 1 << 36
NO_ID = np.iinfo(np.int64).max


def usable(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x, dims) of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))  # NaN is above infinity
    took = df.filter(F.col(id_col).isNotNull() & x.isNotNull() & finite & F.exists(x, lambda c: c != 0))
    return took.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.size(x).alias("dims"))


class Vectors:
    """Distinct vectors with their ids (at most ``most`` of the smallest), codes, steps and rests."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: int | None = None) -> None:
        x = np.ascontiguousarray(x + 0.0)  # no negative zeros, so that equal vectors have equal bytes
        _, first, place = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, place))
        ids, place = ids[order], place[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])]
        ids, place = ids[new], place[new]
        starts = np.searchsorted(place, np.arange(len(first)))
        if most is not None:
            near = np.arange(len(ids)) - starts[place] < most
            ids, place = ids[near], place[near]
            starts = np.searchsorted(place, np.arange(len(first)))
        self.ids, self.place, self.starts = ids, place, starts
        self.counts = np.diff(np.r_[starts, len(ids)])
        self.x = x[first]
        wide = self.x.astype(np.float64)
        self.step = np.abs(wide).max(axis=1) / 127
        with np.errstate(divide="ignore", invalid="ignore"):
            codes = np.where(self.step[:, None] > 0, np.rint(wide / self.step[:, None]), 0).clip(-127, 127)
        self.codes = codes.astype(np.int8)
        held = codes * self.step[:, None]
        self.norm2 = (held * held).sum(axis=1)
        self.slack = np.sqrt(((wide - held) ** 2).sum(axis=1)) + 1e-7 * np.sqrt(self.norm2)  # and what rounding adds
        # products of codes are whole numbers, which this type holds exactly
        self.exact = np.float32 if self.x.shape[1] * 127 * 127 < 1 << 24 else np.float64

    def __len__(self) -> int:
        return len(self.x)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to rows, summed component after component."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j].astype(np.float64) - b[:, j].astype(np.float64)
        total += d * d
    return np.sqrt(total)


class Best:
    """The ``most`` nearest (distance, id) of each query vector."""

    def __init__(self, queries: Vectors, most: int) -> None:
        self.queries, self.most = queries, most
        self.d = np.full((len(queries), most), np.inf)
        self.id = np.full((len(queries), most), NO_ID, np.int64)

    def add(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        near = d <= self.d[q, -1]
        q, d, ids = q[near], d[near], ids[near]
        if not len(q):
            return
        old = np.unique(q)
        q = np.r_[q, np.repeat(old, self.most)]
        d, ids = np.r_[d, self.d[old].ravel()], np.r_[ids, self.id[old].ravel()]
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        again = np.r_[False, (q[1:] == q[:-1]) & (ids[1:] == ids[:-1]) & (d[1:] == d[:-1]) & (d[1:] < np.inf)]
        q, d, ids = q[~again], d[~again], ids[~again]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.most
        self.d[q[kept], rank[kept]], self.id[q[kept], rank[kept]] = d[kept], ids[kept]

    def meet(self, block: Vectors) -> None:
        """All pairs of the queries with a block, by bounds first."""
        height = max(1, TILE_PAIRS // len(block))
        right = block.codes.astype(block.exact).T
        for top in range(0, len(self.queries), height):
            rows = slice(top, top + height)
            dots = (self.queries.codes[rows].astype(block.exact) @ right).astype(np.float64)
            steps = self.queries.step[rows, None] * block.step[None, :]
            near2 = self.queries.norm2[rows, None] + block.norm2[None, :] - 2 * steps * dots
            slack = self.queries.slack[rows, None] + block.slack[None, :]
            bound = self.d[rows, -1]
            if len(block) >= self.most and np.isinf(bound).any():  # so many distinct vectors are no farther than this
                above = np.sqrt(np.maximum(near2, 0)) + slack
                bound = np.minimum(bound, np.partition(above, self.most - 1, axis=1)[:, self.most - 1])
            q, c = np.nonzero(near2 <= (bound[:, None] + slack) ** 2)
            for at in range(0, len(q), PAIRS_AT_ONCE):
                a, b = q[at : at + PAIRS_AT_ONCE] + top, c[at : at + PAIRS_AT_ONCE]
                d = distances(self.queries.x[a], block.x[b])
                times = block.counts[b]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                self.add(np.repeat(a, times), np.repeat(d, times), block.ids[np.repeat(block.starts[b], times) + nth])

    def lists(self) -> Iterator[tuple[int, int, list[int], list[float]]]:
        """(query id, number of its vector, ids, distances) without the query itself."""
        for at, v in zip(self.queries.ids, self.queries.place):
            kept = (self.d[v] < np.inf) & ~((self.id[v] == at) & (self.d[v] == 0))
            yield int(at), int(v), self.id[v][kept][: self.most - 1].tolist(), self.d[v][kept][: self.most - 1].tolist()


LISTS = pa.schema([("query_id", pa.int64()), ("mark", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """((dims, side), ids, matrix) of runs of rows, of BLOCK_VALUES components at most."""
    for batch in batches:
        dims, side = np.asarray(batch["dims"]), np.asarray(batch["side"])
        ids, x = np.asarray(batch["vec_id"]), batch["x"]
        cuts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (side[1:] != side[:-1])]).tolist() + [batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            rows = max(1, BLOCK_VALUES // int(dims[a]))
            for at in range(a, b, rows):
                n = min(rows, b - at)
                yield (int(dims[a]), int(side[a])), ids[at : at + n], np.asarray(x.slice(at, n).flatten()).reshape(n, -1)


def search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a cell, of each length the queries (side 0) first: the lists of its queries."""

    def lists(best: Best) -> Iterator[pa.RecordBatch]:
        found = best.lists()
        while rows := list(islice(found, 4096)):
            marks = [hashlib.blake2b(best.queries.x[v].tobytes(), digest_size=16).digest() for _, v, _, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(marks, pa.binary()), pa.array([r[2] for r in rows], LISTS.field("ids").type), pa.array([r[3] for r in rows], LISTS.field("scores").type)], schema=LISTS)

    for _, parts in groupby(blocks(batches), lambda part: part[0][0]):
        best, waiting = None, []
        for (_, side), ids, x in parts:
            if side == 0:
                waiting.append((ids, x))
            elif waiting or best:
                if best is None:
                    best, waiting = Best(Vectors(np.concatenate([i for i, _ in waiting]), np.concatenate([m for _, m in waiting])), k + 1), []
                best.meet(Vectors(ids, x, k + 1))
        if best is not None:
            yield from lists(best)


def merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Lists sorted by query: the k best of each query's lists, by a heap over them."""
    rows = ((q, m, list(zip(d, i))) for batch in batches for q, m, i, d in zip(*(batch[name].to_pylist() for name in ("query_id", "mark", "ids", "scores"))))
    out: list[tuple[int, int, int, float]] = []
    for (query_id, _), lists in groupby(rows, lambda r: r[:2]):
        distinct = (pair for pair, _ in groupby(heapq.merge(*(r[2] for r in lists))))
        out += [(query_id, rank, vec_id, score) for rank, (score, vec_id) in enumerate(islice(distinct, k), 1)]
        if len(out) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which ``is_query`` (over vec_id) holds.

    Candidates are shuffled once for each group of queries (65,536 of 64 components), and queries
    once for each lane; both are counted first.
    """
    rows = usable(df, id_col, vector)
    n, queries, values = rows.agg(F.count("*"), F.count_if(is_query), F.sum(F.when(is_query, F.col("dims")))).first()
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(n * queries / TASK_PAIRS))
    groups = max(1, math.ceil((values or 0) / GROUP_VALUES))
    lanes = max(1, math.ceil(tasks / groups))
    lane = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(lanes))
    whole = rows.select("vec_id", "x", "dims", F.lit(1).alias("side"), lane.alias("lane")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = rows.filter(is_query).select("vec_id", "x", "dims", F.lit(0).alias("side"), F.pmod(F.xxhash64("vec_id", "x"), F.lit(groups)).cast("int").alias("part"))
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    cells = whole.unionByName(asked).withColumn("cell", (F.col("part") * lanes + F.col("lane")).cast("int"))
    dealt = cells.repartitionById(groups * lanes, F.col("cell")).sortWithinPartitions("dims", "side").select("vec_id", "x", "dims", "side")
    lists = dealt.mapInArrow(lambda batches: search(batches, k), "query_id long, mark binary, ids array<long>, scores array<double>")
    return lists.repartition("query_id").sortWithinPartitions("query_id", "mark").mapInArrow(lambda batches: merged(batches, k), "query_id long, rank int, vec_id long, score double")
