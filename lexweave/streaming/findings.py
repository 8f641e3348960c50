"""Structured Streaming: findings that arrive in parts, windows over events, and the state of cases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import CASE_STATES


def read_table(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int = 100) -> DataFrame:
    """A table's Parquet files as a stream; the path is a pattern, as the source takes no single file."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format("parquet")
    return stream.load(f"{path}*")


def usage_windows(events: DataFrame, late: str | None = "1 day", width: str = "1 day") -> DataFrame:
    """Events and their values by type and tumbling window; rows later than the watermark are not counted.

    Without one (``late`` None) all rows count, in whatever order they come; the state is a row a window and type.
    """
    w = F.window("ts", width)
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (timed if late is None else timed.withWatermark("ts", late)).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), cents.alias("cents")).select(F.col("window.start").alias("since"), "event_type", "n", "cents")


def running_tally(findings: DataFrame, key: str, severity: str) -> DataFrame:
    """Findings so far by run and severity: the state is a count a pair and not the rows."""
    return findings.groupBy(key, severity).agg(F.count(F.lit(1)).alias("n"))


STEPS = {"opinion": 1, "annotation": 2, "publication": 3}


def case_states(steps: DataFrame) -> DataFrame:
    """case_id, state of each case that got news, from a stream (case_id long, step string).

    A step only counts when the one before it was reached; steps that come too early are kept in
    the state as bits until then.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for b in batches:
            for s in b["step"]:
                seen |= 1 << STEPS[s] if s in STEPS else 0
        state.update((seen,))
        reached = 0
        while seen >> (reached + 1) & 1:
            reached += 1
        yield pd.DataFrame({"case_id": [key[0]], "state": [CASE_STATES[reached]]})

    return steps.groupBy("case_id").applyInPandasWithState(follow, "case_id long, state string", "seen int", "update", GroupStateTimeout.NoTimeout)


def append_parts(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All of a stream's rows as Parquet files, each once, whatever fails meanwhile."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def latest_into(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Each batch of a stream's updates as a folder ``batch=<number>``; ``read_latest`` takes the last row of each key."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key over all batches."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r"))
    return last.select(*keys, "_r.*")
