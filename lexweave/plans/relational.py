"""Relational queries: customers stand for users, orders for cases and runs, line items for findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import listing, merge, relations
from ..sources.tables import csv_lines, table
from .registry import query

#: Severities from mild to severe, as order priorities stand for them.
PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
AS_OF = "2001-08-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


def as_of(ts: str = AS_OF):
    return F.lit(ts).cast("timestamp")


def cents(x) -> F.Column:
    """Money as a whole number of cents, so that sums do not depend on their order."""
    return F.round(F.col(x) * 100).cast("long")


@query("""
SELECT o_orderkey, c_name, n_name, r_name, o_orderstatus, o_orderpriority, o_orderdate,
  CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS severity_rank,
  CASE WHEN a.l_orderkey IS NOT NULL THEN a.findings ELSE 0 END AS published_findings
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_orderkey, COUNT(*) AS findings FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) a ON a.l_orderkey = o_orderkey
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000
  AND CONTAINS(LOWER(CONCAT_WS(' ', c_name, n_name, r_name)), 'asia')
""")
def rel_tracker_cases(spark: SparkSession, d: str) -> DataFrame:
    """Case tracker: cases with their party and court, published findings counted in the join's own side, filtered by facets."""
    published = table(spark, d, "lineitem").filter("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("findings"))
    cases = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    found = listing.where(cases, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_totalprice") > 100000, listing.blob_contains(["c_name", "n_name", "r_name"], "ASIA"))
    out = found.join(published, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "c_name", "n_name", "r_name", "o_orderstatus", "o_orderpriority", "o_orderdate", listing.rank("o_orderpriority", PRIORITIES, 0).alias("severity_rank"), F.coalesce("findings", F.lit(0)).alias("published_findings"))


@query("""
SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS decided FROM orders WHERE o_orderstatus = 'F'
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50
""")
def rel_severity_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 50 by severity, then date, newest first."""
    rows = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    order = [listing.rank("o_orderpriority", PRIORITIES, 0).desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return listing.page(rows, order, 50, 50).select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("decided"))


@query("""
SELECT o_orderkey, (SELECT COUNT(*) FROM orders WHERE o_totalprice >= 400000) AS total FROM orders WHERE o_totalprice >= 400000
ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
""")
def rel_page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """A page and the number of all rows that match."""
    rows = table(spark, d, "orders").filter("o_totalprice >= 400000")
    return listing.page_with_total(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25).select("o_orderkey", "total")


@query("SELECT n_name AS facet_value, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IS NOT NULL AND n_name <> '' GROUP BY 1")
def agg_court_facet(spark: SparkSession, d: str) -> DataFrame:
    """Facet counts of courts."""
    return listing.facet(table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), "n_name")


@query("""
SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000
  AND (c_nationkey < 5 OR (c_nationkey >= 20 AND c_acctbal > 1000)) AND c_mktsegment <> 'HOUSEHOLD'
""")
def rel_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Lists, ranges and a disjunction with a conjunction in it."""
    nation = F.col("c_nationkey")
    return listing.where(
        table(spark, d, "customer"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_acctbal").between(0, 5000), (nation < 5) | ((nation >= 20) & (F.col("c_acctbal") > 1000)), F.col("c_mktsegment") != "HOUSEHOLD", None
    ).select("c_custkey", "c_mktsegment")


@query("""
SELECT p_partkey, p_name FROM part WHERE CONTAINS(LOWER(p_name), 'ring') AND NOT p_name ILIKE '%.docx' AND (p_name ILIKE '%small%ring%' OR p_name ILIKE 'red%')
""")
def rel_substring_filters(spark: SparkSession, d: str) -> DataFrame:
    """Substring search with wildcards taken out of the needle, patterns with wildcards, and their negation."""
    name = F.col("p_name")
    return listing.where(table(spark, d, "part"), listing.contains(name, "%RING_", strip_wildcards=True), ~name.ilike("%.docx"), name.ilike("%small%ring%") | name.ilike("red%")).select("p_partkey", "p_name")


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_acctbal IS NOT NULL AND NULLIF(c_nationkey, 3) IS NOT DISTINCT FROM NULL
""")
def rel_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """Null-safe comparison and tests for null."""
    return table(spark, d, "customer").filter(F.col("c_acctbal").isNotNull() & F.nullif(F.col("c_nationkey"), F.lit(3)).eqNullSafe(F.lit(None))).select("c_custkey", "c_name")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN
  (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))
""")
def rel_visible_through_parents(spark: SparkSession, d: str) -> DataFrame:
    """Findings that a viewer may see: through their run, and that through its owner."""
    mine = listing.owned(table(spark, d, "customer"), F.lit(7), "c_nationkey")
    runs = listing.visible_through(table(spark, d, "orders"), mine, "o_custkey", "c_custkey")
    return listing.visible_through(table(spark, d, "lineitem"), runs, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 11 OR (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def rel_own_or_published(spark: SparkSession, d: str) -> DataFrame:
    """Own rows, and everybody's published ones."""
    return table(spark, d, "orders").filter((F.col("o_custkey") == 11) | ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))).select("o_orderkey", "o_custkey")


@query("""
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')
""")
def rel_semi_then_anti(spark: SparkSession, d: str) -> DataFrame:
    """Cases that have an opinion and no annotation."""
    lines = table(spark, d, "lineitem")
    on = F.col("o_orderkey") == F.col("l_orderkey")
    return table(spark, d, "orders").join(lines.filter("l_returnflag = 'R'"), on, "left_semi").join(lines.filter("l_returnflag = 'A'"), on, "left_anti").select("o_orderkey")


@query("""
SELECT c_custkey, COALESCE(o.n, 0) AS n_orders, COALESCE(u.n, 0) AS n_urgent FROM customer
LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) u ON u.o_custkey = c_custkey
""")
def agg_zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    """Children of several kinds counted for each parent, none as zero."""
    orders = table(spark, d, "orders")
    return relations.zero_filled_counts(table(spark, d, "customer").select("c_custkey"), "c_custkey", {"n_orders": (orders, "o_custkey"), "n_urgent": (orders.filter("o_orderpriority = '1-URGENT'"), "o_custkey")})


@query("""
SELECT o_custkey, COUNT(*) AS n, LIST(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:3] AS first_three FROM orders GROUP BY 1
""")
def agg_count_and_first_three(spark: SparkSession, d: str) -> DataFrame:
    """Count of each key and its first three children; only those three are gathered."""
    orders = table(spark, d, "orders")
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    firsts = relations.first_n(orders, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 3)
    nested = firsts.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("first_three"))
    return counts.join(nested, "o_custkey")


@query("""
SELECT r_regionkey, r_name, LIST({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def rel_embed_many(spark: SparkSession, d: str) -> DataFrame:
    """Parents with their children nested."""
    return relations.embed_many(table(spark, d, "region"), "r_regionkey", table(spark, d, "nation"), "n_regionkey", ["n_nationkey", "n_name"], "nations")


@query("""
WITH lists AS (SELECT c_custkey, [(c_custkey * 7 + 3) % 25, (c_custkey * 3) % 25, (c_custkey + 900) % 40] AS ids FROM customer),
each AS (SELECT c_custkey, UNNEST(ids) AS id, GENERATE_SUBSCRIPTS(ids, 1) AS pos FROM lists)
SELECT c_custkey, LIST(n_name ORDER BY pos) AS found_values FROM each JOIN nation ON n_nationkey = id GROUP BY 1
""")
def rel_lookup_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a list looked up, in the list's order."""
    k = F.col("c_custkey")
    lists = table(spark, d, "customer").select("c_custkey", F.array((k * 7 + 3) % 25, (k * 3) % 25, (k + 900) % 40).alias("ids"))
    return relations.lookup_in_order(lists, "c_custkey", "ids", table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("long")), "n_nationkey", "n_name")


@query("""
SELECT p_partkey, COALESCE(a.v, b.v, c.v) AS found, CASE WHEN a.v IS NOT NULL THEN 'index' WHEN b.v IS NOT NULL THEN 'mirror' WHEN c.v IS NOT NULL THEN 'archive' END AS origin FROM part
LEFT JOIN (SELECT l_partkey, CAST(MAX(l_orderkey) AS VARCHAR) AS v FROM lineitem WHERE l_quantity = 50 GROUP BY 1) a ON a.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, CAST(MAX(l_orderkey) AS VARCHAR) AS v FROM lineitem WHERE l_quantity = 49 GROUP BY 1) b ON b.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, CAST(MAX(l_orderkey) AS VARCHAR) AS v FROM lineitem WHERE l_quantity >= 45 GROUP BY 1) c ON c.l_partkey = p_partkey
""")
def rel_first_source_wins(spark: SparkSession, d: str) -> DataFrame:
    """Existence check along a chain of sources: the first that has a hit wins."""
    lines = table(spark, d, "lineitem")
    best = lambda c: lines.filter(c).groupBy("l_partkey").agg(F.max("l_orderkey").alias("v"))
    sources = [(n, best(c), "l_partkey", "v") for n, c in (("index", "l_quantity = 50"), ("mirror", "l_quantity = 49"), ("archive", "l_quantity >= 45"))]
    return relations.first_source(table(spark, d, "part").select("p_partkey"), "p_partkey", sources)


@query("""
WITH links AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'part' WHEN 1 THEN 'supplier' ELSE 'nation' END AS kind, c_custkey % 120 AS ref_id FROM customer)
SELECT kind, ref_id, p_name AS label FROM links JOIN part ON kind = 'part' AND p_partkey = ref_id
UNION ALL SELECT kind, ref_id, s_name FROM links JOIN supplier ON kind = 'supplier' AND s_suppkey = ref_id
UNION ALL SELECT kind, ref_id, n_name FROM links JOIN nation ON kind = 'nation' AND n_nationkey = ref_id
""")
def rel_polymorphic_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of several kinds resolved by one join a kind."""
    k = F.col("c_custkey")
    links = table(spark, d, "customer").select(F.when(k % 3 == 0, "part").when(k % 3 == 1, "supplier").otherwise("nation").alias("kind"), (k % 120).alias("ref_id"))
    return relations.resolve_links(links, {"part": (table(spark, d, "part"), "p_partkey", "p_name"), "supplier": (table(spark, d, "supplier"), "s_suppkey", "s_name"), "nation": (table(spark, d, "nation"), "n_nationkey", "n_name")})


@query("""
SELECT o.o_orderkey, COUNT(e.l_orderkey) AS near_shipments FROM orders o JOIN lineitem e ON e.l_orderkey = o.o_orderkey
  AND e.l_shipdate BETWEEN o.o_orderdate - INTERVAL 180 DAYS AND o.o_orderdate + INTERVAL 180 DAYS GROUP BY 1
""")
def rel_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Matches within 180 days of a decision, on an equal key."""
    window = F.expr("INTERVAL 180 DAYS")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_shipdate").between(F.col("o_orderdate") - window, F.col("o_orderdate") + window)
    return table(spark, d, "orders").join(lines, on).groupBy("o_orderkey").agg(F.count("l_orderkey").alias("near_shipments"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def win_latest_version(spark: SparkSession, d: str) -> DataFrame:
    """Latest version of each key."""
    return relations.latest(table(spark, d, "orders"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3")
def win_top_n_per_provider(spark: SparkSession, d: str) -> DataFrame:
    """Three best of each provider."""
    return relations.first_n(table(spark, d, "part"), "p_brand", [F.col("p_retailprice").desc(), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "p_retailprice")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CAST(COALESCE(SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_start
FROM lineitem
""")
def win_prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    """Where each page starts: the sum of the lengths of the pages before it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.coalesce(F.sum("l_quantity").over(w), F.lit(0)).cast("long").alias("page_start"))


@query("""
WITH s AS (SELECT p_partkey, REPLACE(LOWER(p_name), ' ', '-') || '-' || CAST(p_size AS VARCHAR) AS base FROM part)
SELECT p_partkey, CASE WHEN rn = 1 THEN base ELSE base || '-' || rn END AS slug FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY base ORDER BY p_partkey) AS rn FROM s)
""")
def win_slug_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Slugs made unique by -2, -3 and so on in order of the key."""
    base = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", base.alias("base"))
    rn = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return rows.withColumn("rn", rn).select("p_partkey", F.when(F.col("rn") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("rn").cast("string"))).alias("slug"))


@query("""
SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'purchase') AS reviews, COUNT(*) FILTER (WHERE event_type = 'signup') AS attempts, COUNT(*) AS total
FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS GROUP BY 1
""")
def agg_rolling_window_usage(spark: SparkSession, d: str) -> DataFrame:
    """Use of each user over the last 30 days, by kind and in all."""
    recent = table(spark, d, "events").filter(F.col("ts") >= as_of(EVENTS_AS_OF) - F.expr("INTERVAL 30 DAYS"))
    return recent.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("reviews"), F.count_if(F.col("event_type") == "signup").alias("attempts"), F.count(F.lit(1)).alias("total"))


@query("""
WITH tiers AS (SELECT * FROM (VALUES ('BUILDING', 5), ('MACHINERY', 10), ('HOUSEHOLD', 3)) t(tier, cap)),
used AS (SELECT user_id, COUNT(*) AS used FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS GROUP BY 1)
SELECT c_custkey, c_mktsegment, COALESCE(CASE WHEN c_custkey % 10 = 0 THEN 50 END, cap, 1) AS quota, COALESCE(used, 0) AS used,
  COALESCE(used, 0) < COALESCE(CASE WHEN c_custkey % 10 = 0 THEN 50 END, cap, 1) AS allowed
FROM customer LEFT JOIN tiers ON tier = c_mktsegment LEFT JOIN used ON user_id = c_custkey
""")
def agg_quota(spark: SparkSession, d: str) -> DataFrame:
    """Rolling quota: a user's override, else the tier's cap, else one, against attempts counted."""
    tiers = spark.createDataFrame([("BUILDING", 5), ("MACHINERY", 10), ("HOUSEHOLD", 3)], "tier string, cap int")
    recent = table(spark, d, "events").filter((F.col("event_type") == "click") & (F.col("ts") >= as_of(EVENTS_AS_OF) - F.expr("INTERVAL 30 DAYS")))
    used = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    quota = F.coalesce(F.when(F.col("c_custkey") % 10 == 0, 50), F.col("cap"), F.lit(1))
    rows = table(spark, d, "customer").join(F.broadcast(tiers), F.col("tier") == F.col("c_mktsegment"), "left").join(used, F.col("user_id") == F.col("c_custkey"), "left")
    count = F.coalesce("n", F.lit(0))
    return rows.select("c_custkey", "c_mktsegment", quota.alias("quota"), count.alias("used"), (count < quota).alias("allowed"))


@query("""
SELECT user_id, COUNT(*) AS runs, SORTED[LEN(SORTED) // 2 + 1] AS upper_median FROM
  (SELECT user_id, LIST_SORT(LIST(CAST(ROUND(value * 100) AS BIGINT))) AS SORTED FROM events WHERE value > 0 AND value < 72 GROUP BY 1), LATERAL (SELECT UNNEST(SORTED)) GROUP BY ALL
""")
def agg_upper_median(spark: SparkSession, d: str) -> DataFrame:
    """Upper median of durations between bounds: element floor(n / 2) of the sorted values, by rank and not by gathering."""
    v = F.round(F.col("value") * 100).cast("long")
    rows = table(spark, d, "events").filter("value > 0 AND value < 72").groupBy("user_id", v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id")
    ranked = rows.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("runs", F.sum("n").over(w))
    return ranked.filter(F.col("upto") > F.floor(F.col("runs") / 2)).groupBy("user_id").agg(F.first("runs").alias("runs"), F.min("v").alias("upper_median"))


@query("""
SELECT l_orderkey, COUNT(*) AS findings, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS severe, COUNT(*) FILTER (WHERE l_returnflag = 'A') AS moderate, COUNT(*) FILTER (WHERE l_returnflag = 'X') AS low
FROM lineitem GROUP BY 1
""")
def agg_severity_tally(spark: SparkSession, d: str) -> DataFrame:
    """Findings of each run by fixed severities; unknown ones count only in the total."""
    tally = {"severe": "r", "moderate": "a", "low": "x"}
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.lower("l_returnflag") == v).alias(k) for k, v in tally.items()])


@query("""
SELECT o_orderkey, COUNT(l_orderkey) AS flags, CASE COALESCE(MAX(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END), 0) WHEN 2 THEN 'non_conforming' WHEN 1 THEN 'review' ELSE 'conforming' END AS tier
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY 1
""")
def agg_tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Worst flag decides; what has none conforms."""
    flags = table(spark, d, "lineitem").filter("l_quantity > 45").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("worst"))
    rows = table(spark, d, "orders").select("o_orderkey").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    worst = F.coalesce("worst", F.lit(0))
    return rows.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("flags"), F.when(worst == 2, "non_conforming").when(worst == 1, "review").otherwise("conforming").alias("tier"))


@query("""
WITH kinds(kind, pos) AS (VALUES ('ECONOMY', 1), ('STANDARD', 2), ('PROMO', 3), ('NONE', 4)), total AS (SELECT COUNT(*) AS n FROM part)
SELECT kind, pos, COUNT(p_partkey) AS n, CASE WHEN ANY_VALUE(total.n) = 0 THEN '0%' ELSE CAST(FLOOR(COUNT(p_partkey) * 100.0 / ANY_VALUE(total.n) + 0.5) AS BIGINT) || '%' END AS share
FROM kinds CROSS JOIN total LEFT JOIN part ON p_type = kind GROUP BY 1, 2
""")
def agg_fixed_categories(spark: SparkSession, d: str) -> DataFrame:
    """A fixed list of categories with counts and whole percentages; empty ones are shown."""
    kinds = spark.createDataFrame([("ECONOMY", 1), ("STANDARD", 2), ("PROMO", 3), ("NONE", 4)], "kind string, pos int")
    parts = table(spark, d, "part")
    counts = parts.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    total = parts.agg(F.count(F.lit(1)).alias("total"))
    rows = kinds.join(counts, F.col("kind") == F.col("p_type"), "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return rows.select("kind", "pos", n.alias("n"), F.when(F.col("total") == 0, "0%").otherwise(F.concat(F.floor(n * 100 / F.col("total") + 0.5).cast("string"), F.lit("%"))).alias("share"))


@query("SELECT o_custkey, MAX_BY(o_orderkey, (o_totalprice, -o_orderkey)) AS longest, COALESCE(MAX(CAST(RIGHT(o_orderpriority, 1) = 'W' AS INT)), 0) + 1 AS next_version FROM orders GROUP BY 1")
def agg_max_by(spark: SparkSession, d: str) -> DataFrame:
    """The key with the largest measure (first on ties), and the next version number."""
    rows = table(spark, d, "orders")
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("longest"), (F.coalesce(F.max(F.col("o_orderpriority").endswith("W").cast("int")), F.lit(0)) + 1).alias("next_version"))


@query("""
SELECT o_custkey, SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) * 3 AS cost_in, SUM(CAST(ROUND(l_extendedprice * l_discount * 100) AS BIGINT)) * 15 AS cost_out, COALESCE(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(ROUND(l_extendedprice * 100) AS BIGINT) END), 0) AS penalties
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def agg_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost from sums at several rates; a missing penalty counts as nothing."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    discount = F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")
    return rows.groupBy("o_custkey").agg((F.sum(cents("l_extendedprice")) * 3).alias("cost_in"), (F.sum(discount) * 15).alias("cost_out"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", cents("l_extendedprice"))), F.lit(0)).alias("penalties"))


@query("""
SELECT l_orderkey, CASE WHEN f = 0 THEN 'complete' WHEN c > 0 THEN 'partial' ELSE 'failed' END AS status FROM
  (SELECT l_orderkey, COUNT(*) FILTER (WHERE l_linestatus = 'O') AS c, COUNT(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY 1)
""")
def agg_final_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of a run from its finished and failed cells."""
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("c"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    return counts.select("l_orderkey", F.when(F.col("f") == 0, "complete").when(F.col("c") > 0, "partial").otherwise("failed").alias("status"))


@query("""
SELECT c_custkey, COUNT(o_orderkey) AS open_cases, COUNT(DISTINCT o_orderpriority) + COALESCE(MAX(CAST(o_orderpriority IS NULL AS INT)), 0) AS kinds,
  COUNT(*) FILTER (WHERE o_orderdate IS NOT NULL AND o_orderdate <= TIMESTAMP '2001-07-01' + INTERVAL 7 DAYS) AS due
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1
""")
def agg_matter_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Open matters, distinct values with null as one of them, and what is due within a week."""
    rows = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").filter("o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey"), "left")
    kinds = F.count_distinct("o_orderpriority") + F.coalesce(F.max(F.col("o_orderpriority").isNull().cast("int")), F.lit(0))
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("open_cases"), kinds.alias("kinds"), F.count_if(listing.due_within("o_orderdate", as_of("2001-07-01"), 7)).alias("due"))


@query("""
WITH changes AS (SELECT o_custkey AS c_custkey, 'REVISED' AS c_mktsegment, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 450000),
latest AS (SELECT c_custkey, c_mktsegment, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS rn FROM changes) WHERE rn = 1)
SELECT c_custkey, c_mktsegment, NULL::BIGINT AS o_orderkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM latest) UNION ALL SELECT * FROM latest
""")
def rel_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Upsert on a conflict key; of several changes the last stands."""
    changes = table(spark, d, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"), F.lit("REVISED").alias("c_mktsegment"), "o_orderkey")
    base = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit(None).cast("long").alias("o_orderkey"))
    return merge.upsert(base, changes, ["c_custkey"], [F.col("o_orderkey").desc()])


@query("""
SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL
SELECT k, MIN(name) FROM (SELECT s_suppkey * 40 AS k, s_name AS name FROM supplier) WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY 1
""")
def rel_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Insert rows whose key is new."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return merge.insert_ignore(base, table(spark, d, "supplier").select((F.col("s_suppkey") * 40).alias("k"), F.col("s_name").alias("name")), ["k"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 30 DAYS AND o_orderstatus = 'P' THEN 'archived' ELSE o_orderstatus END AS status FROM orders
WHERE NOT (o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 1000 DAYS AND o_orderstatus = 'F')
""")
def rel_update_and_purge(spark: SparkSession, d: str) -> DataFrame:
    """Guarded update, and deletion of what is past its time."""
    old = lambda days: F.col("o_orderdate") < as_of() - F.make_interval(days=F.lit(days))
    rows = merge.delete_where(table(spark, d, "orders"), old(1000) & (F.col("o_orderstatus") == "F"))
    rows = merge.update_where(rows, old(30) & (F.col("o_orderstatus") == "P"), {"o_orderstatus": F.lit("archived")})
    return rows.select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("""
WITH chosen AS (SELECT p_brand, MAX(p_partkey) AS k FROM part WHERE p_size = 11 GROUP BY 1)
SELECT p_partkey, CASE WHEN k IS NOT NULL THEN p_partkey = k ELSE p_type = 'ECONOMY' END AS is_default FROM part LEFT JOIN chosen USING (p_brand)
""")
def rel_single_default(spark: SparkSession, d: str) -> DataFrame:
    """A flag that one row of an owner has: setting it takes it from the others."""
    parts = table(spark, d, "part").withColumn("is_default", F.col("p_type") == "ECONOMY")
    chosen = parts.filter("p_size = 11").groupBy("p_brand").agg(F.max("p_partkey").alias("k"))
    rows = parts.join(chosen.select(F.col("p_brand").alias("_b"), "k"), (F.col("p_brand") == F.col("_b")) & (F.col("p_partkey") == F.col("k")), "left")
    return merge.set_single(rows, "p_brand", F.col("k").isNotNull(), "is_default").select("p_partkey", "is_default")


@query("""
SELECT o_orderkey, CASE WHEN NOT COALESCE(op, FALSE) THEN 'pending' WHEN NOT COALESCE(an, FALSE) THEN 'fetched' WHEN NOT COALESCE(pu, FALSE) THEN 'annotated' ELSE 'published' END AS state
FROM orders LEFT JOIN (SELECT l_orderkey, BOOL_OR(l_linenumber = 1) AS op, BOOL_OR(l_returnflag = 'A') AS an, BOOL_OR(l_returnflag = 'A' AND l_linestatus = 'F') AS pu FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def inc_case_states(spark: SparkSession, d: str) -> DataFrame:
    """State of each case, every step only after the one before it."""
    any_ = lambda c: F.bool_or(F.expr(c))
    seen = table(spark, d, "lineitem").groupBy("l_orderkey").agg(any_("l_linenumber = 1").alias("op"), any_("l_returnflag = 'A'").alias("an"), any_("l_returnflag = 'A' AND l_linestatus = 'F'").alias("pu"))
    rows = table(spark, d, "orders").join(seen, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    has = [F.coalesce(c, F.lit(False)) for c in ("op", "an", "pu")]
    return rows.select("o_orderkey", merge.case_state(*has).alias("state"))


@query("""
SELECT o_orderkey, CASE WHEN TIMESTAMP '2001-08-01' - o_orderdate < INTERVAL 1 DAY THEN 'active' WHEN DATE_DIFF('second', o_orderdate, TIMESTAMP '2001-08-01') > 14 * 86400 THEN 'dormant' ELSE 'idle' END AS age,
  CASE WHEN DATE_DIFF('day', o_orderdate, TIMESTAMP '2001-08-01') = 0 THEN 'Today' WHEN DATE_DIFF('day', o_orderdate, TIMESTAMP '2001-08-01') = 1 THEN 'Yesterday'
    WHEN DATE_DIFF('second', o_orderdate, TIMESTAMP '2001-08-01') < 7 * 86400 THEN 'Last week' ELSE 'Older' END AS bucket
FROM orders
""")
def rel_age_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Projects by age, chats by calendar group."""
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", listing.age_bucket(t, as_of()).alias("age"), listing.calendar_bucket(t, as_of()).alias("bucket"))


@query("""
SELECT o_custkey AS who, o_orderdate AS ts, 'order' AS kind FROM orders
UNION ALL SELECT user_id, ts, event_type FROM events
""")
def rel_timeline_all(spark: SparkSession, d: str) -> DataFrame:
    """Events of several kinds as one timeline, of all customers and users."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("ts"), F.lit("order").alias("kind"))
    events = table(spark, d, "events").select(F.col("user_id").alias("who"), "ts", F.col("event_type").alias("kind"))
    return orders.unionByName(events)


@query("""
SELECT p_partkey, p_name, CASE WHEN LOWER(p_name) LIKE 'red%' THEN 100 WHEN CONTAINS(LOWER(p_name), 'red') THEN 60 WHEN CONTAINS(LOWER(p_type), 'red') THEN 30 ELSE 0 END - p_size AS score
FROM part WHERE CONTAINS(LOWER(p_name), 'red') OR CONTAINS(LOWER(p_type), 'red') ORDER BY score DESC, p_partkey LIMIT 10
""")
def rel_command_palette(spark: SparkSession, d: str) -> DataFrame:
    """Ten best matches: prefix before substring before other fields, newer first."""
    name, other = F.lower("p_name"), F.lower("p_type")
    rows = table(spark, d, "part").filter(name.contains("red") | other.contains("red"))
    score = F.when(name.startswith("red"), 100).when(name.contains("red"), 60).when(other.contains("red"), 30).otherwise(0) - F.col("p_size")
    return rows.select("p_partkey", "p_name", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(10)


@query("""
SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)
""")
def rel_set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Regression: keys that were caught before and no longer are."""
    orders = table(spark, d, "orders")
    return orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).subtract(orders.filter("o_orderstatus = 'F' AND o_totalprice > 300000").select("o_custkey"))


@query("""
WITH a AS (SELECT o_orderkey AS k, 0 AS list_rank, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders QUALIFY pos <= 100),
b AS (SELECT o_orderkey AS k, 1 AS list_rank, ROW_NUMBER() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders QUALIFY pos <= 100)
SELECT k, list_rank, pos FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY list_rank, pos) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE rn = 1
""")
def rel_ordered_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists of 100, the first one's hits before the second's, each key once."""
    orders = table(spark, d, "orders")

    def top(rank: int, *order) -> DataFrame:
        best = orders.orderBy(*order).limit(100)
        return best.select(F.col("o_orderkey").alias("k"), F.lit(rank).alias("list_rank"), F.row_number().over(Window.orderBy(*order)).alias("pos"))  # 100 rows

    both = top(0, F.desc("o_totalprice"), F.col("o_orderkey")).unionByName(top(1, F.desc("o_orderdate"), F.col("o_orderkey")))
    return relations.latest(both, "k", [F.col("list_rank"), F.col("pos")])


@query("""
SELECT '"' || n_nationkey || '","' || n_name || '"' AS value FROM nation
""")
def src_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows as quoted CSV lines."""
    return csv_lines(table(spark, d, "nation").select("n_nationkey", "n_name"))


@query("""
SELECT s_suppkey, CASE WHEN s_acctbal IS NULL OR s_acctbal = 0 THEN '' WHEN s_acctbal >= 1000 THEN '$' || CAST(FLOOR(s_acctbal / 1000 + 0.5) AS BIGINT) || 'K' ELSE '$' || CAST(FLOOR(s_acctbal + 0.5) AS BIGINT) END AS penalty FROM supplier WHERE s_acctbal >= 0
""")
def txt_compact_money(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in short form."""
    return table(spark, d, "supplier").filter("s_acctbal >= 0").select("s_suppkey", listing.compact_money(F.col("s_acctbal")).alias("penalty"))
