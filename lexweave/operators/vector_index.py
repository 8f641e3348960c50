"""An inverted file over embeddings: cells around sampled centroids, rows of a cell together on disk.

The centroids come from a bounded sample (SAMPLE_ROWS), every row is put into the cell of its
nearest one and keeps its rest (what the centroid does not explain) as int8 codes. A search looks at
the nearest cells of each query only, ranks their rows by codes and then the best of them by the
exact cosine distance. The index may be partial: only rows for which a condition holds are in it.

A cell of more than SLOT_ROWS rows is dealt into slots, and one that more than PART_QUERIES queries
look at into parts of the queries, so a task never holds more than one slot and one part. Number of
cells: about the root of the rows, CELLS at most, so centroids and counts by cell are small tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = 4096
SAMPLE_ROWS = 65_536
SLOT_ROWS = 1 << 15
PART_QUERIES = 1 << 14
#: Rows of a slot that are ranked exactly for each row asked for.
RERANKED = 4


@dataclass
class Index:
    path: str
    centroids: np.ndarray
    id_col: str
    embedding: str

    @property
    def dims(self) -> int:
        return self.centroids.shape[1]


def usable(rows: DataFrame, id_col: str, embedding: str, dims: int) -> DataFrame:
    """(_id, _v) of rows with an id and a finite vector of ``dims`` components that is not zero."""
    v = F.col(embedding)
    fits = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    return rows.filter(F.col(id_col).isNotNull() & (F.size(v) == dims) & fits).select(F.col(id_col).cast("long").alias("_id"), v.cast("array<float>").alias("_v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over a sample, started from its first rows; a centroid without rows stays."""
    x = unit(x)
    c = x[:cells].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[at : at + 8192] @ c.T).argmax(axis=1) for at in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        own, starts = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c[own] = np.where(size > 0, sums / np.maximum(size, 1e-300), c[own])
    return c


def build(rows: DataFrame, path: str, dims: int, id_col: str = "vec_id", embedding: str = "embedding", where: Column | None = None, cells: int | None = None) -> Index:
    """Fit, write and return the index of the rows for which ``where`` holds."""
    spark, kept = rows.sparkSession, usable(rows if where is None else rows.filter(where), id_col, embedding, dims)
    n = kept.count()
    cells = max(1, min(CELLS, n, cells or math.isqrt(n)))
    share = math.ceil((1 << 20) * min(1.0, 1.1 * SAMPLE_ROWS / max(n, 1)))
    sample = kept.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share).limit(SAMPLE_ROWS).select("_v").toArrow()
    drawn = matrix(sample["_v"].combine_chunks(), dims) if n else np.zeros((0, dims), np.float32)
    centroids = fit_centroids(drawn, min(cells, len(drawn))) if len(drawn) else np.zeros((0, dims))
    index = Index(path, centroids, id_col, embedding)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    append(index, kept.withColumnsRenamed({"_id": id_col, "_v": embedding}))
    return index


def load(spark: SparkSession, path: str, id_col: str = "vec_id", embedding: str = "embedding") -> Index:
    """An index that was written before; its centroids are CELLS rows at most."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return Index(path, np.array([r["centroid"] for r in rows]), id_col, embedding)


def append(index: Index, rows: DataFrame) -> None:
    """Put further rows into the index; the centroids stay."""
    if not len(index.centroids):
        return
    shared = rows.sparkSession.sparkContext.broadcast(index.centroids)
    dims = index.dims

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x = unit(matrix(b["_v"], dims))
                cell = (x @ c.T).argmax(axis=1)
                rest = x - c[cell]
                step = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
                codes = np.rint(rest / step[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b["_id"], pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(step), b["_v"]], ["cell", "id", "codes", "step", "v"])

    placed = usable(rows, index.id_col, index.embedding, dims).mapInArrow(put, "cell int, id long, codes binary, step double, v array<float>")
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"))  # a row a cell
    slots = F.broadcast(counts.select("cell", F.ceil(F.col("n") / SLOT_ROWS).cast("int").alias("slots")))
    dealt = placed.join(slots, "cell").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int")).drop("slots")
    dealt.repartition("cell", "slot").sortWithinPartitions("cell").write.partitionBy("cell").mode("append").parquet(f"{index.path}/rows")


def indexed(index: Index, spark: SparkSession) -> DataFrame:
    """The rows of the index: cell, slot, id, codes, step, v."""
    return spark.read.schema("id long, codes binary, step double, v array<float>, slot int, cell int").parquet(f"{index.path}/rows")


def probes(index: Index, queries: DataFrame, look_at: int) -> DataFrame:
    """(query_id, q, cell): each query with its ``look_at`` nearest cells."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    dims = index.dims

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                most = min(look_at, len(c))
                best = np.argpartition(-(unit(matrix(b["_v"], dims)) @ c.T), most - 1, axis=1)[:, :most]
                rows = np.repeat(np.arange(b.num_rows), most)
                yield pa.RecordBatch.from_arrays([b["_id"].take(pa.array(rows)), b["_v"].take(pa.array(rows)), pa.array(best.ravel(), pa.int32())], ["query_id", "q", "cell"])

    return usable(queries, index.id_col, index.embedding, dims).mapInArrow(near, "query_id long, q array<float>, cell int")


def needed(index: Index, spark: SparkSession, k: int = 10, recall: float = 0.95, sample: int = 200) -> int:
    """Cells that a search has to look at, so that this share of the true neighbours lies in them.

    Measured, not assumed: ``sample`` rows of the index (those with the smallest id hashes) are
    searched for exactly, in one pass over all rows, and the cells of their k neighbours are looked
    up in each row's order of cells. Where the vectors have no clusters, that is a large part of them.
    """
    if not len(index.centroids):
        return 1
    rows, dims = indexed(index, spark), index.dims
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    shared = spark.sparkContext.broadcast(unit(matrix(drawn["v"].combine_chunks(), dims)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        sims, cells = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                sims = np.hstack([sims, q @ unit(matrix(b["v"], dims)).T])
                cells = np.hstack([cells, np.broadcast_to(np.asarray(b["cell"]), (len(q), b.num_rows))])
                if sims.shape[1] > k:
                    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    sims, cells = np.take_along_axis(sims, best, 1), np.take_along_axis(cells, best, 1)
        n = np.repeat(np.arange(len(q)), sims.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(sims.ravel()), pa.array(cells.ravel())], ["q", "sim", "cell"])

    found = rows.select("v", "cell").mapInArrow(near, "q long, sim double, cell long")
    w = Window.partitionBy("q").orderBy(F.desc("sim"))
    true = found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).select("q", "cell").toArrow()  # sample * k rows
    place = np.argsort(np.argsort(-(shared.value @ index.centroids.T), axis=1), axis=1)
    ranks = place[true["q"].to_numpy(), true["cell"].to_numpy()]
    return int(np.quantile(ranks, recall, method="higher")) + 1


def looked_at(index: Index, queries: DataFrame, look_at: int) -> DataFrame:
    """One row: queries, rows (of the index), compared (pairs that a search ranks) and share of all pairs."""
    counts = indexed(index, queries.sparkSession).groupBy("cell").agg(F.count("*").alias("n"))
    own = probes(index, queries, look_at).groupBy("cell").agg(F.count("*").alias("asked"))
    total = counts.join(own, "cell", "left").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.col("n") * F.col("asked")), F.lit(0)).alias("compared"))
    n = usable(queries, index.id_col, index.embedding, index.dims).agg(F.count("*").alias("queries"))
    return n.join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("compared") / (F.col("rows") * F.col("queries")))  # one row each


def search(index: Index, queries: DataFrame, k: int, look_at: int) -> DataFrame:
    """query_id, ``id_col``, distance: k rows of the index near each query, by cosine distance (nine digits), ties by id."""
    spark, id_col, dims = queries.sparkSession, index.id_col, index.dims
    schema = f"query_id long, `{id_col}` long, distance double"
    if not len(index.centroids):
        return spark.createDataFrame([], schema)
    asked, rows = probes(index, queries, look_at), indexed(index, spark)
    # both are small: a row a cell, CELLS at most
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("parts"))
    slots = rows.groupBy("cell").agg((F.max("slot") + 1).alias("slots"))
    dealt = parts.join(slots, "cell")
    left = asked.join(F.broadcast(dealt), "cell").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    left = left.select("cell", "slot", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "q")
    right = rows.join(F.broadcast(dealt.select("cell", "parts")), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    shared = spark.sparkContext.broadcast(index.centroids)
    empty = pa.table({"query_id": pa.array([], pa.int64()), id_col: pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

    def rank(key: tuple, own: pa.Table, slot: pa.Table) -> pa.Table:
        if not own.num_rows or not slot.num_rows:
            return empty
        x, ids = matrix(slot["v"].combine_chunks(), dims), slot["id"].to_numpy()
        codes = np.frombuffer(b"".join(slot["codes"].to_pylist()), np.int8).reshape(-1, dims).astype(np.float32)
        step, c = slot["step"].to_numpy(), shared.value[key[0].as_py()]
        few, found = min(RERANKED * k, len(ids)), []
        for at in range(0, own.num_rows, 256):
            part = own.slice(at, 256)
            q = unit(matrix(part["q"].combine_chunks(), dims))
            near = q @ c[:, None] + (q.astype(np.float32) @ codes.T) * step
            best = np.argpartition(-near, few - 1, axis=1)[:, :few]
            d = np.round(1 - np.einsum("qd,qnd->qn", q, unit(x[best.ravel()]).reshape(len(q), few, dims)), 9)
            order = np.lexsort((ids[best], d), axis=1)[:, :k]
            found.append((np.repeat(part["query_id"].to_numpy(), order.shape[1]), np.take_along_axis(ids[best], order, 1).ravel(), np.take_along_axis(d, order, 1).ravel()))
        return pa.table([pa.array(np.concatenate(column)) for column in zip(*found)], names=empty.column_names)

    met = left.groupBy("cell", "slot", "part").cogroup(right.groupBy("cell", "slot", "part")).applyInArrow(rank, schema)
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return met.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
