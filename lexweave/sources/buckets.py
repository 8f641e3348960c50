"""A table in buckets by key, merged bucket by bucket: an upsert rewrites only what it touches.

Each version of a bucket is a folder of Parquet files that never changes. A manifest names the
folder of every bucket and the last batch that was applied; it is written last and by one rename, so
readers see the table before or after a batch and never between. A batch that was applied before
(a retry) changes nothing. ``compact`` deletes folders that no kept manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Buckets:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        """Numbers of the manifests, oldest first."""
        fs, target = self._fs(f"{self.path}/manifests")
        if not fs.exists(target):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(target) if f.getPath().getName().endswith(".json") and not f.getPath().getName().startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """{version, batch, schema, folders: {bucket: folder}} of a version, the last if none is given."""
        known = self.versions()
        if not known:
            return {"version": 0, "batch": None, "schema": None, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version or known[-1]}.json", wholetext=True).first()[0])

    def _swap(self, manifest: dict) -> None:
        """Write a manifest under another name and rename it; a version that exists already is an error."""
        fs, draft = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, target = self._fs(f"{self.path}/manifests/{manifest['version']}.json")
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} was written by someone else: merge again")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None before the first batch."""
        now = self.manifest(version)
        if now["schema"] is None:
            return None
        folders = [f for b, f in now["folders"].items() if only is None or int(b) in only]
        if not folders:
            return self.spark.createDataFrame([], now["schema"])
        return self.spark.read.schema(now["schema"]).parquet(*[f"{self.path}/{f}" for f in folders])

    def upsert(self, rows: DataFrame, batch: int, order: list[str] | None = None) -> list[int]:
        """Merge rows by key and return the buckets touched; of several rows with one key the last in ``order`` counts.

        ``batch`` numbers rise; one that is not above the last applied changes nothing. Null keys
        are keys. Rows of a hot key are cut to one before anything else is done with them.
        """
        now = self.manifest()
        if now["batch"] is not None and batch <= now["batch"]:
            return []
        others = [c for c in rows.columns if c not in self.keys]
        rank = F.struct(*[F.col(c) for c in (order or others)]) if order or others else F.lit(0)
        news = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rows.columns), rank).alias("_row")).select("_row.*")
        placed = news.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())  # as many as there are buckets, at most
        old = self.read(only=touched)
        merged = placed
        if old is not None:
            was = old.select(*rows.columns).withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
            both = placed.withColumn("_new", F.lit(1)).unionByName(was.withColumn("_new", F.lit(0)))
            first = Window.partitionBy("_bucket", *self.keys).orderBy(F.desc("_new"))
            merged = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_new")
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        folders = now["folders"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
        self._swap({"version": now["version"] + 1, "batch": batch, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "folders": folders})
        return touched

    def compact(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` manifests and the folders that none of these names; returns how many bucket folders went."""
        known = self.versions()
        used = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in known[:-keep]:
            fs, target = self._fs(f"{self.path}/manifests/{v}.json")
            fs.delete(target, False)
        fs, data = self._fs(f"{self.path}/data")
        gone = 0
        for write in fs.listStatus(data) if fs.exists(data) else []:
            for bucket in fs.listStatus(write.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("_bucket=") and f"data/{write.getPath().getName()}/{name}" not in used:
                    fs.delete(bucket.getPath(), True)
                    gone += 1
        return gone


def merge_stream(stream: DataFrame, into: Buckets, checkpoint: str, order: list[str] | None = None, mode: str = "update") -> None:
    """Every batch of a stream merged into a table in buckets, each once, whatever fails meanwhile."""
    q = stream.writeStream.foreachBatch(lambda batch, number: into.upsert(batch, number, order)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
