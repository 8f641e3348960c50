"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import Buckets, merge_stream
from ..sources.folders import shared_folder
from ..streaming import findings, partials
from .registry import query


@query("SELECT DATE_TRUNC('day', ts) AS since, event_type, COUNT(*) AS n, SUM(ROUND(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def inc_usage_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows over the whole event table as a stream, whatever the order of its files."""
    path = shared_folder(spark, "usage")
    findings.latest_into(findings.usage_windows(findings.read_table(spark, d, "events"), late=None), f"{path}/rows", f"{path}/log")
    return findings.read_latest(spark, f"{path}/rows", ["since", "event_type"])


@query("SELECT l_orderkey, l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def inc_running_tally(spark: SparkSession, d: str) -> DataFrame:
    """Findings by run and severity, kept up to date as they arrive."""
    path = shared_folder(spark, "tally")
    findings.latest_into(findings.running_tally(findings.read_table(spark, d, "lineitem"), "l_orderkey", "l_returnflag"), f"{path}/rows", f"{path}/log")
    return findings.read_latest(spark, f"{path}/rows", ["l_orderkey", "l_returnflag"])


@query("""
WITH s AS (SELECT user_id % 50 AS case_id, MAX((event_type = 'view')::INT) AS a, MAX((event_type = 'click' AND value > 480)::INT) AS b, MAX((event_type = 'purchase' AND value > 470)::INT) AS c FROM events GROUP BY 1)
SELECT case_id, CASE WHEN a = 0 THEN 'pending' WHEN b = 0 THEN 'fetched' WHEN c = 0 THEN 'annotated' ELSE 'published' END AS state FROM s
""")
def inc_case_stream(spark: SparkSession, d: str) -> DataFrame:
    """States of cases out of a stream of steps."""
    kind, value = F.col("event_type"), F.col("value")
    step = F.when(kind == "view", "opinion").when((kind == "click") & (value > 480), "annotation").when((kind == "purchase") & (value > 470), "publication").otherwise("none")
    steps = findings.read_table(spark, d, "events").select((F.col("user_id") % 50).alias("case_id"), step.alias("step"))
    path = shared_folder(spark, "cases")
    findings.latest_into(findings.case_states(steps), f"{path}/rows", f"{path}/log")
    return findings.read_latest(spark, f"{path}/rows", ["case_id"])


@query("""
WITH parts AS (SELECT DISTINCT l_suppkey AS review, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS part, l_partkey AS one, l_quantity > 49 AND l_suppkey % 2 = 0 AS ends FROM lineitem),
finals AS (SELECT review, MAX(part) AS part, MAX_BY(one, part) AS one FROM parts WHERE ends GROUP BY 1)
SELECT review, 'final' AS state, ['final ' || one] AS findings FROM finals
UNION ALL SELECT review, 'preview', LIST('part ' || one ORDER BY part) FROM parts WHERE review NOT IN (SELECT review FROM finals) GROUP BY 1
""")
def inc_partial_lists(spark: SparkSession, d: str) -> DataFrame:
    """Previews of each review as one list, until its final list takes their place."""
    lines = findings.read_table(spark, d, "lineitem").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    part = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")
    kind = F.when((F.col("l_quantity") > 49) & (F.col("l_suppkey") % 2 == 0), "final").otherwise("preview")
    texts = F.array(F.concat(F.when(kind == "final", "final ").otherwise("part "), F.col("l_partkey").cast("string")))
    rows = lines.select(F.col("l_suppkey").alias("review"), part.alias("part"), kind.alias("kind"), texts.alias("findings"), "at")
    path = shared_folder(spark, "lists")
    findings.latest_into(partials.shown_lists(rows, "1 hour", 7 * 86_400_000), f"{path}/rows", f"{path}/log")
    return findings.read_latest(spark, f"{path}/rows", ["review"])


@query("""
WITH changes AS (SELECT o_custkey AS c_custkey, 'REVISED' AS c_mktsegment, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 450000),
latest AS (SELECT c_custkey, c_mktsegment, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS rn FROM changes) WHERE rn = 1)
SELECT c_custkey, c_mktsegment, NULL::BIGINT AS o_orderkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM latest) UNION ALL SELECT * FROM latest
""")
def inc_bucket_merge(spark: SparkSession, d: str) -> DataFrame:
    """The upsert as a stream into a table in buckets: each batch rewrites the buckets that it touches."""
    into = Buckets(spark, shared_folder(spark, "buckets"), ["c_custkey"], 16)
    into.upsert(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment", F.lit(None).cast("long").alias("o_orderkey")), -1)
    changes = findings.read_table(spark, d, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"), F.lit("REVISED").alias("c_mktsegment"), "o_orderkey")
    merge_stream(changes, into, shared_folder(spark, "log"), ["o_orderkey"], "append")
    into.compact()
    return into.read()
