"""Operator 12: centroid clustering by plain Lloyd rounds on integers.

Vectors are kept if they have exactly ``dims`` components, none null or non-finite; a component x
becomes floor(scale * x). The centroids (k * dims integers, whatever the input) are broadcast; each
task computes integer squared differences to every centroid in NumPy and sums its vectors by
cluster, and one row a partition, cluster and component goes through a groupBy. Nothing is rounded,
so the order of rows never matters and reruns agree.

Odd input: null vectors and those of another length take no part, nor do vectors with a component
whose integer a long cannot hold (beyond 2^62). A null id counts as empty text in the hash that
draws the first centroids; repeated ids and rows are rows of their own, in order of their
components. Fewer than k vectors give as many centroids; an empty table gives no rows. A distance
or inertia that a long cannot hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers up to this size have sums of 64 squared differences within a long; NumPy takes Python's integers beyond.
NARROW = 1 << 27
LONGEST = (1 << 63) - 1
#: Places of a cluster's totals beside its components.
COUNT, DISTANCE = -1, -2


def scaled_vectors(df: DataFrame, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): kept vectors as arrays of longs."""
    x = F.col(vector)
    fits = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float(2**62) / scale))  # NaN is above all numbers
    kept = df.filter(x.isNotNull() & (F.size(x) == dims) & fits)
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("v"))


def first_centroids(vectors: DataFrame, k: int = 16, seed: int = 1) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


def matrix(column: pd.Series | list, dims: int) -> np.ndarray:
    """Rows as integers that can be subtracted, squared and summed without overflow."""
    x = np.array([np.asarray(v, np.int64) for v in column], np.int64).reshape(-1, dims)
    return x if not x.size or max(int(x.max()), -int(x.min())) < NARROW else x.astype(object)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller on ties) and the squared distance."""
    if centroids.dtype == object:
        x = x.astype(object)
    squared = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = squared.argmin(axis=1)
    return best, squared[np.arange(len(x)), best]


def totals(vectors: DataFrame, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """{(cluster, place): sum} over all vectors: components, COUNT and DISTANCE."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = matrix(shared.value, len(shared.value[0]))
        found = np.zeros((len(c), c.shape[1] + 2), object)  # the two last places are COUNT and DISTANCE, counted from the end
        for frame in frames:
            x = matrix(frame["v"], c.shape[1])
            cluster, squared = nearest(x, c)
            for k in np.unique(cluster):
                own = cluster == k
                found[k, :-2] += x[own].astype(object).sum(axis=0) if x.dtype == object else x[own].sum(axis=0).astype(object)
                found[k, COUNT] += int(own.sum())
                found[k, DISTANCE] += sum(map(int, squared[own]))
        k, place = np.nonzero(found)
        yield pd.DataFrame({"cluster": k, "place": np.where(place < c.shape[1], place, place - c.shape[1] - 2), "total": [Decimal(int(v)) for v in found[k, place]]})

    parts = vectors.select("v").mapInPandas(sums, "cluster int, place int, total decimal(38, 0)")
    return {(r["cluster"], r["place"]): int(r["total"]) for r in parts.groupBy("cluster", "place").agg(F.sum("total").cast("decimal(38, 0)").alias("total")).collect()}


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> list[list[int]]:
    """Centroids after the given number of rounds; a cluster without vectors keeps its centroid."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        found = totals(vectors, centroids)
        centroids = [[found.get((j, i), 0) // found[j, COUNT] for i in range(len(c))] if (j, COUNT) in found else c for j, c in enumerate(centroids)]
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of every vector."""
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    found = totals(vectors, centroids)
    inertia = [found.get((j, DISTANCE), 0) for j in range(len(centroids))]
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, inertia))

    def longs(values) -> pd.Series:
        return pd.Series([v if v <= LONGEST else None for v in map(int, values)], dtype="Int64")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, inertia = shared.value
        c = matrix(centroids, len(centroids[0]))
        for frame in frames:
            cluster, squared = nearest(matrix(frame["v"], c.shape[1]), c)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": cluster, "distance": longs(squared), "cluster_inertia": longs(inertia[j] for j in cluster), "inertia": longs([sum(inertia)] * len(cluster))})

    return vectors.mapInPandas(rows, schema)


def centroid_rows(df: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(cluster, centroid): one row a centroid, k at most."""
    return df.sparkSession.createDataFrame(list(enumerate(centroids)), "cluster int, centroid array<long>")


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Every kept vector with its cluster, squared distance, inertias and its cluster's centroid."""
    vectors = scaled_vectors(df, dims, scale)
    centroids = lloyd(vectors, k, rounds, seed)
    return assign(vectors, centroids).join(F.broadcast(centroid_rows(df, centroids)), "cluster")
