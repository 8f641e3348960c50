"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only below this number of (narrow) rows, counted first.
BROADCAST_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a folder of this machine is used if the master is local (as in
    tests); on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; empty for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def learns(doc_id: Column) -> Column:
    """True on rows that a model may learn from: crc32 of the id as text, mod 4, is not 2 (null ids: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to few rows and to about ``size`` bytes (one row at least), so that a worker holds little beside one of them."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type)]
        lengths = sum(np.asarray(pc.fill_null(pc.binary_length(c), 0)).astype(np.int64) for c in texts) if texts else np.zeros(batch.num_rows, np.int64)
        upto = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = int(upto[start - 1]) if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(upto, before + size, "right"))), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def hot_keys(df: DataFrame, key: str, per: int = 2000) -> DataFrame:
    """Keys that hold over 1/per of the rows (and over 100): per of them at most, whatever the input."""
    counts = df.groupBy(key).count()
    total = df.count()
    return counts.filter(F.col("count") > max(100, total // per)).select(key)


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join to a side that has one row a key, where a key may hold a third of the left rows.

    Hot keys of the left side (``hot_keys``: 2000 at most) meet their rows of the right side in a
    broadcast of that size; all others meet in a shuffle. ``left`` is read three times, so give a
    checkpointed frame. Null keys match nothing (and stay with ``how="left"``).
    """
    hot = [r[0] for r in hot_keys(left.filter(F.col(key).isNotNull()), key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.filter(~is_hot).join(right, key, how)
    return left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how).unionByName(cold)


def join_small(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join to a narrow side with one row a key: broadcast if it was counted as small, else ``join_unique``."""
    right = checkpoint(right)
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    return join_unique(left, right, key, how)
