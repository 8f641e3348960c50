"""Queries of lists, drafts, reviews and findings. Where the test tables lack a kind of text, it is composed from their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import drafts, text
from ..operators import cases, desk, listing, relations, retrieval, rules, spans
from ..sources.folders import shared_folder
from ..sources.tables import csv_lines, envelopes, insert_pages, read_envelopes, table
from .registry import query


def pick(k: Column, values: list) -> Column:
    """The value of a list by a number from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def told(key: str, source: str, answers: list, name: str) -> str:
    """SQL for answers that go round by the key."""
    return f"SELECT {key}, {quoted(answers)}[({key} % {len(answers)})::INT + 1] AS {name} FROM {source}"


# Filters and defaults


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END IS NOT TRUE")
def rel_null_or_false(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose flag is null or false."""
    hidden = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3 == 1)
    return table(spark, d, "orders").filter(desk.not_true(hidden)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE LIST_CONTAINS(STRING_SPLIT(p_name, ' '), 'red')")
def rel_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have a tag."""
    return table(spark, d, "part").filter(F.array_contains(F.split("p_name", " "), "red")).select("p_partkey")


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN 'state' ELSE 'federal' END AS j, c_mktsegment AS s, CASE WHEN c_nationkey % 2 = 0 THEN n_name ELSE '' END AS court, 'label ' || n_name AS label FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, 'state' AS found_by FROM r WHERE j = 'state' AND s = 'BUILDING'
UNION ALL SELECT c_custkey, 'court' FROM r WHERE j = 'federal' AND COALESCE(NULLIF(court, ''), label, '') = (SELECT MIN(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'label ' || n_name END) FROM nation WHERE n_nationkey >= 12)
UNION ALL SELECT c_custkey, 'juris' FROM r WHERE j = 'federal' UNION ALL SELECT c_custkey, 'all' FROM r
""")
def rel_coded_filters(spark: SparkSession, d: str) -> DataFrame:
    """A list filtered by codes of a menu: a state, a court, a jurisdiction, all."""
    nations = table(spark, d, "nation")
    rows = table(spark, d, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey")).withColumns({"j": F.when(F.col("c_nationkey") < 12, "state").otherwise("federal"), "court": F.when(F.col("c_nationkey") % 2 == 0, F.col("n_name")).otherwise(""), "label": F.concat(F.lit("label "), F.col("n_name"))})
    first = nations.filter("n_nationkey >= 12").agg(F.min(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("label "), F.col("n_name"))))).first()[0]
    codes = {"state": "state:BUILDING", "court": f"court:{first}", "juris": "juris:federal", "all": "all"}
    found = [listing.where(rows, desk.coded(code, F.col("j"), F.col("c_mktsegment"), F.col("court"), F.col("label"))).select("c_custkey", F.lit(name).alias("found_by")) for name, code in codes.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 11 OR (o_orderkey % 4 = 0 AND o_orderpriority = '1-URGENT')")
def rel_system_templates(spark: SparkSession, d: str) -> DataFrame:
    """Own templates, and those of the system: without owner and of its kind."""
    owner = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey"))
    mine = (F.col("o_custkey") == 11) | (owner.isNull() & (F.col("o_orderpriority") == "1-URGENT"))
    return table(spark, d, "orders").filter(mine).select("o_orderkey", "o_custkey")


@query("SELECT s_suppkey, s_name FROM supplier")
def rel_granted_columns(spark: SparkSession, d: str) -> DataFrame:
    """Only the columns that a role may read, whatever it asks for."""
    granted, asked = ["s_suppkey", "s_name", "s_nationkey"], ["s_suppkey", "s_acctbal", "s_name"]
    return table(spark, d, "supplier").select(*[c for c in asked if c in granted])


@query("""
SELECT o_orderkey, contains(lower(c_name), '1') AS pro_se, o_totalprice > 0 AS penalty, o_orderstatus = 'F' AS bar_referral FROM orders JOIN customer ON c_custkey = o_custkey
WHERE contains(lower(c_name), '1') AND o_totalprice > 0 AND o_orderstatus = 'F'
""")
def rel_tracker_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facets of the case tracker: a party by substring, a penalty at all, a flag."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    facets = {"pro_se": listing.contains("c_name", "1"), "penalty": F.coalesce(F.col("o_totalprice"), F.lit(0)) > 0, "bar_referral": F.col("o_orderstatus") == "F"}
    return listing.where(rows, *facets.values()).select("o_orderkey", *[c.alias(n) for n, c in facets.items()])


@query("""
SELECT l_orderkey, l_linenumber, ['addition', 'deletion', 'modification', 'modification', 'equivalent'][(l_partkey % 5)::INT + 1] AS change_type, ['high', 'medium', 'medium', 'info'][(l_suppkey % 4)::INT + 1] AS severity,
  CASE WHEN l_linenumber = 1 THEN 'accept' ELSE 'negotiate' END AS recommendation, LEFT(REPEAT(l_returnflag, 300), 200) AS section, LIST_TRANSFORM(['aaaa', 'bb'], lambda x: LEFT(x, 3)) AS tags FROM lineitem
""")
def rel_clamped(spark: SparkSession, d: str) -> DataFrame:
    """What a model returned, held to the values that are known and to lengths."""
    k = lambda c, values: pick(F.col(c), values)
    tags = F.array(F.lit("aaaa"), F.lit("bb"), F.lit("c"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", desk.clamp(k("l_partkey", ["addition", "deletion", "modification", "odd", "equivalent"]), desk.CHANGES).alias("change_type"), desk.clamp(k("l_suppkey", ["high", None, "HIGH", "info"]), desk.SEVERITIES).alias("severity"),
        desk.clamp(F.when(F.col("l_linenumber") == 1, "accept").otherwise("maybe"), desk.RECOMMENDATIONS).alias("recommendation"), F.left(F.repeat(F.col("l_returnflag"), F.lit(300)), F.lit(200)).alias("section"), desk.cut_items(tags, 2, 3).alias("tags"),
    )


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS a, l_suppkey % 5 AS b, l_linenumber % 3 AS c, l_quantity::INT % 2 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a = 0 THEN 'materiality_rationale' WHEN b = 0 THEN 'position' WHEN (c = 0 OR e = 1) AND b = 1 THEN 'fallback' WHEN e = 1 AND b = 2 THEN 'walkaway' WHEN a = 1 AND b <> 3 THEN 'playbook_fit' END AS problem FROM f
""")
def rel_finding_problems(spark: SparkSession, d: str) -> DataFrame:
    """Findings checked against their schema: the first thing that is missing."""
    a, b, c, e = F.col("l_partkey") % 4, F.col("l_suppkey") % 5, F.col("l_linenumber") % 3, F.col("l_quantity").cast("int") % 2
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(a == 0, "  short  ").otherwise("a rationale that is long enough").alias("materiality_rationale"), F.when(b == 0, " x ").otherwise("held").alias("position"),
        F.when(c == 0, "Blocker").otherwise("minor").alias("severity"), F.when(e == 1, True).alias("existential"), F.when(b != 1, "a fallback").alias("fallback"), F.when(b != 2, "leave").alias("walkaway"),
        F.when(a == 1, F.array(F.lit("p1"))).alias("profile_refs"), F.when(b == 3, "applies").otherwise("never").alias("playbook_fit"),
    )
    return rows.select("l_orderkey", "l_linenumber", desk.finding_problem().alias("problem"))


# Joins and merges


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN {'c_name': c_name, 'c_mktsegment': c_mktsegment} END AS version FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 10")
def rel_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their current version as a struct, null where there is none."""
    versions = table(spark, d, "customer").filter("c_nationkey < 10")
    return desk.to_one(table(spark, d, "orders"), "o_custkey", versions, "c_custkey", ["c_name", "c_mktsegment"], "version").select("o_orderkey", "version")


@query("SELECT n_nationkey, i - 1 AS column_index, ['Party', 'Term', 'Law'][i] AS column_name FROM nation, RANGE(1, 4) t(i)")
def rel_grid(spark: SparkSession, d: str) -> DataFrame:
    """A cell for every document and column."""
    return relations.grid(table(spark, d, "nation").select("n_nationkey"), ["Party", "Term", "Law"])


@query("""
WITH p AS (SELECT l_orderkey, COALESCE(SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lineitem)
SELECT o_orderkey, o_orderkey % 120 AS at, COUNT(s)::INT AS page FROM orders LEFT JOIN p ON l_orderkey = o_orderkey AND s <= o_orderkey % 120 WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1, 2
""")
def win_page_at(spark: SparkSession, d: str) -> DataFrame:
    """The page on which an offset lies."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)).alias("s"))
    return desk.page_at(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 120).alias("at")), "o_orderkey", "at", pages, "s").filter("page >= 0").select("o_orderkey", "at", "page")


@query("""
WITH v AS (SELECT o_custkey AS doc, o_orderkey AS version, o_orderstatus AS state, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, version, state, COALESCE(state = 'F', FALSE) AS extracted FROM customer LEFT JOIN v ON doc = c_custkey AND rn = 1
""")
def rel_document_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their latest version's state."""
    latest = relations.latest(table(spark, d, "orders"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    out = table(spark, d, "customer").join(latest, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("c_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state"), F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)).alias("extracted"))


@query("""
WITH f AS (SELECT l_orderkey AS k, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, 'f' || (l_partkey % 3) AS id FROM lineitem),
r AS (SELECT o_orderkey AS k, UNNEST([{'p': 0, 'ref': '1'}, {'p': 1, 'ref': 'f' || (o_orderkey % 3)}, {'p': 2, 'ref': '99'}]) AS x FROM orders)
SELECT r.k, x.p AS position, MIN(f.i)::INT AS found FROM r JOIN f ON f.k = r.k AND (f.id = x.ref OR f.i::VARCHAR = x.ref) GROUP BY 1, 2
""")
def rel_priority_three(spark: SparkSession, d: str) -> DataFrame:
    """The three findings that come first, by place or by id."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.row_number().over(w) - 1).alias("i"), F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string")).alias("id"))
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.array(F.lit("1"), F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")), F.lit("99"), F.lit("0")).alias("refs"))
    return desk.named_or_numbered(refs, "k", "refs", found, "i", "id")


@query("SELECT DISTINCT l_orderkey || '#' || l_linenumber AS chunk FROM lineitem")
def rel_distinct_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once each, by item and index."""
    return table(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select(F.concat_ws("#", "l_orderkey", "l_linenumber").alias("chunk"))


@query("SELECT o_custkey, MIN(o_orderkey) AS first_seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def rel_seen_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Cases found by several searches, each cluster only where it is first seen."""
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_seen"))


@query("SELECT user_id, event_id, hits FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn, COUNT(*) OVER (PARTITION BY user_id) AS hits FROM events) WHERE rn = 1")
def rel_search_results(spark: SparkSession, d: str) -> DataFrame:
    """Search results, the best of each item."""
    w = Window.partitionBy("user_id")
    rows = table(spark, d, "events").withColumn("rn", F.row_number().over(w.orderBy(F.desc("value"), "event_id"))).withColumn("hits", F.count(F.lit(1)).over(w))
    return rows.filter("rn = 1").select("user_id", "event_id", "hits")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 1) AND l_returnflag = 'N' THEN 'accepted' ELSE l_returnflag END AS status, l_partkey FROM lineitem
""")
def rel_guarded_update(spark: SparkSession, d: str) -> DataFrame:
    """Pending edits of the runs that a user owns are accepted; all else stays."""
    edits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("status"), "l_partkey")
    runs = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return desk.decide(edits, runs, "l_orderkey", F.col("o_custkey") % 10 == 1, F.col("status") == "N", "status", "accepted")


@query("""
SELECT l_orderkey, l_linenumber, COALESCE(CASE WHEN l_linenumber % 2 = 1 THEN l_shipmode END, CASE WHEN l_linenumber = 2 THEN 'case' ELSE 'unknown' END) AS citation_type FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)
""")
def rel_by_place(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers joined by place; where it gave none, by what the pattern said."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 2, "case").otherwise("unknown").alias("provisional"), F.col("l_returnflag").alias("t"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("row"))
    output = lines.filter("l_linenumber % 2 = 1").select("l_orderkey", "row", F.col("t").alias("citation_type"))
    return desk.by_place(lines, "l_orderkey", "row", output, {"citation_type": F.col("provisional")}).select("l_orderkey", "l_linenumber", "citation_type")


@query("SELECT l_orderkey, LIST(l_linenumber ORDER BY l_linenumber) AS accepted FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def rel_accepted_edits(spark: SparkSession, d: str) -> DataFrame:
    """Accepted edits of each document in order."""
    return table(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("accepted"))


@query("SELECT page_id, url FROM pages WHERE page_id % 10 < 7 AND html <> ''")
def rel_fresh_cache(spark: SparkSession, d: str) -> DataFrame:
    """Cached pages that still hold: fetched within seven days, and not empty."""
    now = F.lit("2024-01-31").cast("timestamp")
    cache = table(spark, d, "pages").withColumn("until", now + F.make_dt_interval(days=F.lit(6) - (F.col("page_id") % 10).cast("int")))
    return desk.fresh(cache, "until", now, "html").select("page_id", "url")


# Counts and labels


@query("""
WITH t AS (SELECT l_orderkey, COUNT(*) FILTER (l_returnflag = 'R') AS r, COUNT(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN r > 0 THEN 'Draft NOT cleared for filing — open ✗ items remain' WHEN a > 0 THEN 'Corrections pending drafting review' ELSE 'Cleared for drafting sign-off upon completion of attestation packet' END AS label FROM t
""")
def agg_status_labels(spark: SparkSession, d: str) -> DataFrame:
    """A document's label from its totals."""
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"))
    return sums.select("l_orderkey", desk.status_label(F.col("r"), F.col("a")).alias("label"))


@query("SELECT COALESCE(MAX(o_orderdate) FILTER (o_orderstatus = 'X'), TIMESTAMP '2020-01-01') AS since, MAX(o_orderdate) AS newest FROM orders")
def agg_latest_run(spark: SparkSession, d: str) -> DataFrame:
    """When a search last ran, or a default."""
    return table(spark, d, "orders").agg(F.coalesce(F.max(F.when(F.col("o_orderstatus") == "X", F.col("o_orderdate"))), F.lit("2020-01-01").cast("timestamp")).alias("since"), F.max("o_orderdate").alias("newest"))


@query("SELECT l_orderkey, COUNT(*) AS citations, COUNT(*) FILTER (l_returnflag = 'A') AS found, COUNT(*) FILTER (l_returnflag = 'R') AS missing, BOOL_OR(l_linestatus = 'F' AND l_quantity > 45) AS any_mismatch, COUNT(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1")
def agg_existence(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each run by whether they were found."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("citations"), F.count_if(F.col("l_returnflag") == "A").alias("found"), F.count_if(F.col("l_returnflag") == "R").alias("missing"), F.bool_or((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)).alias("any_mismatch"), F.count_distinct("l_returnflag").alias("kinds")
    )


@query("""
SELECT l_orderkey, LIST_SORT(LIST_FILTER(['A', 'N', 'R'], lambda x: NOT LIST_CONTAINS(s, x))) AS uncovered FROM (SELECT l_orderkey, LIST(DISTINCT l_returnflag) AS s FROM lineitem GROUP BY 1)
""")
def agg_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which of the expected specialists gave nothing."""
    seen = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    return seen.select("l_orderkey", F.array_except(F.array(*map(F.lit, "ANR")), "s").alias("uncovered"))


@query("SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def agg_status_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each message by status."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT COUNT(*) AS total, COUNT(*) FILTER (b = 'active') AS active, COUNT(*) FILTER (b = 'idle') AS idle, COUNT(*) FILTER (b = 'dormant') AS dormant, SUM(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_custkey END)::BIGINT AS documents FROM
  (SELECT *, CASE WHEN TIMESTAMP '2001-08-01' - o_orderdate < INTERVAL 1 DAY THEN 'active' WHEN DATE_DIFF('second', o_orderdate, TIMESTAMP '2001-08-01') > 14 * 86400 THEN 'dormant' ELSE 'idle' END AS b FROM orders)
""")
def agg_project_strip(spark: SparkSession, d: str) -> DataFrame:
    """Projects by age, and the sum of what they hold."""
    b = listing.age_bucket(F.col("o_orderdate"), F.lit("2001-08-01").cast("timestamp"))
    counts = [F.count_if(b == x).alias(x) for x in ("active", "idle", "dormant")]
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"), *counts, F.sum(F.coalesce(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")), F.lit(0))).alias("documents"))


@query("""
SELECT COUNT(*) AS total, COUNT(*) FILTER (p_type = 'PROMO') AS pdfs, COUNT(*) FILTER (p_type IN ('ECONOMY', 'STANDARD')) AS docs, COUNT(*) FILTER (p_size < 5) AS processing, COUNT(*) FILTER (p_size >= 40) AS verified, SUM(p_size)::BIGINT AS bytes, SUM(LENGTH(p_name))::BIGINT AS chars, COUNT(*) FILTER (p_size % 2 = 0) AS pinned, MAX(p_partkey) AS newest FROM part
""")
def agg_library_strip(spark: SparkSession, d: str) -> DataFrame:
    """A library's documents by format and state, their bytes and characters, the pinned ones and the newest."""
    c = F.col
    counts = {"pdfs": c("p_type") == "PROMO", "docs": c("p_type").isin("ECONOMY", "STANDARD"), "processing": c("p_size") < 5, "verified": c("p_size") >= 40, "pinned": c("p_size") % 2 == 0}
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(x).alias(n) for n, x in counts.items()], F.sum(F.coalesce("p_size", F.lit(0)).cast("long")).alias("bytes"), F.sum(F.coalesce(F.length("p_name"), F.lit(0)).cast("long")).alias("chars"), F.max("p_partkey").alias("newest"))


@query("SELECT DISTINCT p_brand AS facet_value FROM part WHERE p_brand <> '' ORDER BY 1")
def agg_facet_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of a facet, sorted."""
    return table(spark, d, "part").filter(F.coalesce("p_brand", F.lit("")) != "").select(F.col("p_brand").alias("facet_value")).distinct().orderBy("facet_value")


# Sorts: the first 200 of each menu's order, numbered, so that the order itself is compared

def sorted_query(name: str, doc: str, source: str, key: str, sql_order: str, order) -> None:
    """Register a list in an order: its first 200 rows with their numbers."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return desk.numbered(table(spark, d, source), [*order(), F.col(key)], 200).select(key, "n")

    run.__name__, run.__doc__ = name, doc
    query(f"SELECT {key}, n FROM (SELECT {key}, ROW_NUMBER() OVER (ORDER BY {sql_order}, {key}) AS n FROM {source}) WHERE n <= 200")(run)


sorted_query("sort_by_penalty", "Largest penalty first, none as zero.", "orders", "o_orderkey", "COALESCE(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0) DESC", lambda: [F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), F.lit(0.0)).desc()])
sorted_query("sort_by_date", "Oldest first, no date as the empty text, which comes first.", "orders", "o_orderkey", "COALESCE(CASE WHEN o_orderstatus = 'F' THEN STRFTIME(o_orderdate, '%Y-%m-%d') END, '')", lambda: [F.coalesce(F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(""))])
sorted_query("sort_by_rules", "Most rules first: by the length of an array.", "part", "p_partkey", "LEN(STRING_SPLIT(p_name, ' ')) DESC", lambda: [F.size(F.split("p_name", " ")).desc()])
sorted_query("sort_by_provider", "Models by provider, newest first, then generation.", "part", "p_partkey", "CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 9 END, p_size DESC, p_retailprice DESC", lambda: [desk.in_order("p_type", ["PROMO", "ECONOMY"], 9), F.desc("p_size"), F.desc("p_retailprice")])
sorted_query("sort_by_due", "Earliest due first, none last; then client.", "orders", "o_orderkey", "COALESCE(CASE WHEN o_orderstatus = 'O' THEN STRFTIME(o_orderdate, '%Y-%m-%d') END, '9999'), o_custkey", lambda: [F.coalesce(F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("9999")), F.col("o_custkey")])
sorted_query("sort_by_stage", "In the order of stages, unknown ones first.", "orders", "o_orderkey", "CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 ELSE -1 END", lambda: [desk.in_order("o_orderpriority", ["5-LOW", "3-MEDIUM"], -1)])
sorted_query("sort_findings", "Findings that rest on the profile first, then by severity, unknown last.", "orders", "o_orderkey", "(o_custkey % 2 = 0) DESC, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 99 END", lambda: [(F.col("o_custkey") % 2 == 0).desc(), desk.in_order("o_orderpriority", ["1-URGENT", "2-HIGH"], 99)])
sorted_query("sort_parties", "Provider, recipient, unknown, then the rest.", "customer", "c_custkey", "CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 3 END", lambda: [desk.in_order("c_mktsegment", ["BUILDING", "MACHINERY"], 3)])
sorted_query("sort_diffs", "High and medium differences by severity, then place.", "orders", "o_orderkey", "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 2 ELSE 1 END, o_custkey", lambda: [desk.in_order("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], 1), F.col("o_custkey")])
sorted_query("sort_library", "A library's menu: name, then size, nulls as nothing.", "part", "p_partkey", "LOWER(COALESCE(p_name, '')), COALESCE(p_size, 0) DESC", lambda: [F.lower(F.coalesce("p_name", F.lit(""))), F.coalesce("p_size", F.lit(0)).desc()])


# State along a document


@query("""
WITH c AS (SELECT event_id, user_id, ts, value::INT % 4 = 0 AS own FROM events)
SELECT event_id, own OR COALESCE(LEAD(own) OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS string_cite FROM c
""")
def win_string_cites(spark: SparkSession, d: str) -> DataFrame:
    """Members of string cites: behind a semicolon, or before one that is."""
    before = F.when(F.rint("value").cast("int") % 4 == 0, "(1999);  ").otherwise("; and so. ")
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", before.alias("before"))
    return desk.string_cites(rows, "user_id", [F.col("ts"), F.col("event_id")], "before").select("event_id", "string_cite")


@query("SELECT doc_id, (LEN(REGEXP_EXTRACT_ALL(REPLACE(text, CHR(10), CHR(10) || CHR(10)), '\\n\\s*\\n')))::INT AS paragraphs FROM documents")
def win_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph of each text's end: blank lines before it; the texts' lines are set apart by such."""
    spaced = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    parts = F.split(spaced, r"\n\s*\n")
    bounds = F.slice(F.aggregate(F.transform(parts, F.length), F.array(F.lit(-1)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n + 1))), 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return table(spark, d, "documents").select("doc_id", spans.paragraph_of(F.length(spaced) + 1, bounds).alias("paragraphs"))


@query("""
WITH p AS (SELECT l_orderkey AS k, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_returnflag || l_linestatus AS t FROM lineitem)
SELECT k, i, (SELECT MIN(j.i) FROM p j WHERE j.k = p.k AND j.i >= p.i AND j.i < p.i + 4 AND CONTAINS((SELECT STRING_AGG(x.t, ' ' ORDER BY x.i) FROM p x WHERE x.k = p.k AND x.i BETWEEN p.i AND j.i), 'F NO'))::INT AS last FROM p
""")
def win_passage_runs(spark: SparkSession, d: str) -> DataFrame:
    """Where a passage over several paragraphs ends, from each paragraph on."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("i"), F.concat("l_returnflag", "l_linestatus").alias("t"))
    return desk.runs_to(rows, "k", "i", "t", F.lit("F NO"), 4).select("k", "i", F.col("last").cast("int").alias("last"))


# Drafts

RAW = ["Smith vs. Jones, 556 US 662", "Roe v Wade, 42 USC 1983", "29 CFR 1910; §12", "45 So.3d 67 (Calif. 1999)", "Restatement 2d Torts", "under FRCP 12", "x (D. Mass., 2020)", "plain text"]
FIXED = ["Smith v. Jones, 556 U.S. 662", "Roe v. Wade, 42 U.S.C. § 1983", "29 C.F.R. § 1910; § 12", "45 So. 3d 67 (Cal. 1999)", "Restatement (Second) of Torts", "under Fed. R. Civ. P. 12", "x (D. Mass. 2020)", "plain text"]


@query(told("o_orderkey", "orders", FIXED, "fixed"))
def txt_static_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Citations rewritten where no context is needed."""
    return table(spark, d, "orders").select("o_orderkey", drafts.static_fixes(pick(F.col("o_orderkey"), RAW)).alias("fixed"))


OFFERED = [("Roe v. Wade, 410 US 113 (1973)", "case", "Roe v Wade, 410 US 113"), ("410 U.S. 113 (1973)", "case", "Roe v. Wade, 410 U.S. 113"), ("short", "case", ""), ("Tenn.. Code Ann. 1-1", "statute", ""), ("Restatement (Second) of Torts § 90", "book", "Restatement 2d Torts"), ("Restatement of Torts (1965)", "book", "Restatement Torts"), ("42 USC 1983 and more", "statute", "")]
TAKEN = ["Roe v. Wade, 410 U.S. 113 (1973)", None, None, None, "Restatement (Second) of Torts § 90", None, "42 U.S.C. § 1983 and more"]


@query(told("o_orderkey", "orders", TAKEN, "fix"))
def txt_checked_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Suggested fixes that are whole and clean; others go."""
    part = lambda n: pick(F.col("o_orderkey"), [x[n] for x in OFFERED])
    return table(spark, d, "orders").select("o_orderkey", drafts.checked_fix(part(0), part(1), part(2)).alias("fix"))


SAID = ["This case does not exist. Go on", "It appears to be fake", "The page is wrong", "An incorrect year", "It is fine"]
HEARD = [drafts.UNLOCATED + ". Go on", "It " + drafts.UNLOCATED, "The page is non-conforming", "An non-conforming year", "It is fine"]
LEAKED = ["Stoneridge at citation_index 7, lacks", "candidate #10 should follow", "fine (see citation_index 4)", "no index here"]
SEALED = ["Stoneridge at lacks", "should follow", "fine", "no index here"]


@query(f"SELECT o_orderkey, {quoted(HEARD)}[(o_orderkey % 5)::INT + 1] AS softened, {quoted(SEALED)}[(o_orderkey % 4)::INT + 1] AS sealed FROM orders")
def txt_sanitized(spark: SparkSession, d: str) -> DataFrame:
    """Messages without banned words and without numbers of candidates."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", drafts.softened(pick(k, SAID)).alias("softened"), drafts.without_indexes(pick(k, LEAKED)).alias("sealed"))


@query("""
WITH t AS (SELECT doc_id, TRIM(REGEXP_REPLACE(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN LENGTH(t) <= 40 THEN t WHEN CONTAINS(LEFT(t, 70), ' ') AND LENGTH(REGEXP_REPLACE(LEFT(t, 70), ' [^ ]*$', '')) > 30 THEN REGEXP_REPLACE(LEFT(t, 70), ' [^ ]*$', '') ELSE LEFT(t, 70) END AS needle FROM t
""")
def txt_anchor_needles(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of each text, to find it by."""
    return table(spark, d, "documents").select("doc_id", drafts.anchor_needle(F.col("text")).alias("needle"))


TEMPLATES = ["Dear {{name}}, [CLIENT NAME] of <<city>> ____", "INSERT here. SIGNATURE", "EXECUTED VERSION, FINAL", "prose only", "one {{x}} FINAL"]


@query("""
SELECT o_orderkey, [4, 0, 0, 0, 1][k] AS hits, [0, 2, 0, 0, 0][k] AS structural, [0, 0, 2, 0, 1][k] AS anti, [true, true, false, false, true][k] AS proceed, [0.85, 0.4, 0.05, 0.1, 0.4][k]::DOUBLE AS confidence FROM (SELECT o_orderkey, (o_orderkey % 5)::INT + 1 AS k FROM orders)
""")
def txt_template_scan(spark: SparkSession, d: str) -> DataFrame:
    """Whether texts look like templates."""
    s = drafts.template_scan(pick(F.col("o_orderkey"), TEMPLATES))
    return table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.*")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN [{'key': 'city', 'label': 'City'}, {'key': 'day', 'label': 'day'}] WHEN 1 THEN [{'key': 'day', 'label': 'day'}] ELSE [] END AS missing FROM customer")
def txt_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a template that have no value."""
    fields = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("label")) for k, v in (("city", "City"), ("day", None), ("name", "Name"))])
    k = F.col("c_custkey") % 3
    values = F.create_map(F.lit("name"), F.lit("x"), F.lit("city"), F.when(k == 0, "  ").otherwise("Rome"), F.lit("day"), F.when(k == 2, "1"))
    return table(spark, d, "customer").select("c_custkey", drafts.missing_fields(fields, values).alias("missing"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN (o_orderkey % 90)::VARCHAR END AS doc, CASE WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 7)::VARCHAR ELSE '0' END AS attachment FROM orders
""")
def txt_docket_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of documents and attachments from docket addresses."""
    k = F.col("o_orderkey")
    n, a = (k % 90).cast("string"), (k % 7).cast("string")
    url = F.when(k % 3 == 0, F.concat(F.lit("/docket/63/"), n, F.lit("/x-v-y/"))).when(k % 3 == 1, F.concat(F.lit("/docket/63/"), n, F.lit("/"), a, F.lit("/x-v-y/"))).otherwise("/opinion/1/x/")
    return table(spark, d, "orders").select("o_orderkey", drafts.docket_number(url).alias("doc"), drafts.attachment_number(url).alias("attachment"))


@query("SELECT doc_id, LEFT(SHA256('official|' || text), 16) AS id FROM documents")
def txt_salted_ids(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic ids by salt and text."""
    return table(spark, d, "documents").select("doc_id", drafts.salted_id(F.lit("official"), F.col("text")).alias("id"))


PAIRS = [("Conley v. Gibson", "Conley v. Gibson, et al."), ("In re Acme Corporation", "Acme Corp. v. Roe"), ("Smith v. Jones", "Brown v. Green"), ("Fed. Security Co. v. State", "Federal Securities Company v. State Board"), (None, "x")]


@query("SELECT o_orderkey, [1.0, 1.0, 0.0, 1.0, 0.0][(o_orderkey % 5)::INT + 1]::DOUBLE AS overlap, [true, true, false, true, false][(o_orderkey % 5)::INT + 1] AS same_case FROM orders")
def txt_case_names(spark: SparkSession, d: str) -> DataFrame:
    """Cited names against those found, with words of firms folded; half of the words in common is the same case."""
    k = F.col("o_orderkey")
    overlap = drafts.case_overlap(pick(k, [a for a, _ in PAIRS]), pick(k, [b for _, b in PAIRS]))
    return table(spark, d, "orders").select("o_orderkey", overlap.alias("overlap")).withColumn("same_case", F.col("overlap") >= drafts.SAME_CASE)


@query("""
SELECT doc_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS verdict FROM (SELECT doc_id, ((LENGTH(t) - LENGTH(REPLACE(t, 'er the st', ''))) / 9)::BIGINT AS n FROM (SELECT doc_id, TRIM(REGEXP_REPLACE(text, '\\s+', ' ', 'g')) AS t FROM documents))
""")
def txt_ambiguous_needles(spark: SparkSession, d: str) -> DataFrame:
    """Whether a short needle finds one place in each text."""
    needle = F.lit("er the st")
    return table(spark, d, "documents").select("doc_id", drafts.occurrence_verdict(F.col("text"), needle, text.occurrences(F.col("text"), needle)).alias("verdict"))


EVEN_SQL = "TRIM(REGEXP_REPLACE(TRANSLATE({}, '“”‘’' || CHR(160), '\"\"' || CHR(39) || CHR(39) || ' '), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


@query(f"""
WITH t AS (SELECT doc_id, text, LEFT(text, 20) AS source, 'A new passage ' || doc_id AS proposed FROM documents),
r AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN REPLACE(text, source, proposed) WHEN 1 THEN text ELSE text || ' ' || proposed END AS revised FROM t),
e AS (SELECT doc_id, {EVEN_SQL.format("revised")} AS t, {EVEN_SQL.format("source")} AS s, {EVEN_SQL.format("proposed")} AS p FROM r)
SELECT doc_id, CASE WHEN LENGTH(s) >= 12 AND LENGTH(p) >= 12 THEN NOT CONTAINS(t, s) AND CONTAINS(t, p) END AS applied FROM e
""")
def txt_applied_edits(spark: SparkSession, d: str) -> DataFrame:
    """Whether proposed edits are in the revised text and what they replace is gone; null where a passage is too short to tell."""
    t, k = F.col("text"), F.col("doc_id")
    source, proposed = F.left(t, F.lit(20)), F.concat(F.lit("A new passage "), k.cast("string"))
    revised = F.when(k % 3 == 0, F.replace(t, source, proposed)).when(k % 3 == 1, t).otherwise(F.concat(t, F.lit(" "), proposed))
    return table(spark, d, "documents").select("doc_id", text.edit_applied(revised, source, proposed).alias("applied"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def src_insert_pages(spark: SparkSession, d: str) -> DataFrame:
    """Rows inserted in pages of 500, read again."""
    path = shared_folder(spark, "pages")
    insert_pages(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, 500)
    return spark.read.parquet(path)


@query("SELECT doc_id, n_chars < 50 * (doc_id % 40) AS ocr FROM documents")
def txt_needs_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Scans: too few characters a page."""
    return table(spark, d, "documents").select("doc_id", drafts.needs_ocr(F.length("text"), F.col("doc_id") % 40).alias("ocr"))


@query("SELECT doc_id, SUBSTR(text, GREATEST(100 - 30, 0) + 1, 100 - GREATEST(100 - 30, 0)) AS before, SUBSTR(text, 121, 20) AS after FROM documents")
def txt_snippets(spark: SparkSession, d: str) -> DataFrame:
    """What stands around a span."""
    before, after = text.snippet(F.col("text"), F.lit(100), F.lit(120), 30, 20)
    return table(spark, d, "documents").select("doc_id", before.alias("before"), after.alias("after"))


# Nested values


@query("SELECT l_orderkey, LIST(l_partkey ORDER BY l_partkey) AS findings FROM lineitem GROUP BY 1")
def json_appended(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of partial results appended one to the other, null as none."""
    parts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") < 4, F.col("l_partkey"))).alias("a"), F.collect_list(F.when(F.col("l_linenumber") >= 4, F.col("l_partkey"))).alias("b"))
    none = F.array().cast("array<bigint>")
    return parts.select("l_orderkey", F.array_sort(F.concat(F.coalesce(F.when(F.size("a") > 0, F.col("a")), none), F.coalesce("b", none))).alias("findings"))


@query("SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' END AS suggested_text FROM lineitem")
def json_alias_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field that has had two names."""
    k = F.col("l_partkey") % 3
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(k == 0, "new").otherwise("").alias("suggested"), F.when(k < 2, "old").alias("proposed"))
    return rows.select("l_orderkey", "l_linenumber", desk.first_given("suggested", "proposed").alias("suggested_text"))


@query("SELECT n_nationkey, ['Party', 'Term', n_name] AS columns FROM nation")
def json_column_append(spark: SparkSession, d: str) -> DataFrame:
    """A review's columns with one more."""
    return table(spark, d, "nation").select("n_nationkey", F.array_append(F.array(F.lit("Party"), F.lit("Term")), F.col("n_name")).alias("columns"))


@query("SELECT event_id, COALESCE((props->>'k')::BIGINT, 0) + 0 AS total FROM events")
def json_map_sums(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a map, zero where it has none, and their sum."""
    m = F.from_json("props", "map<string, bigint>")
    field = lambda k: F.coalesce(F.element_at(m, F.lit(k)), F.lit(0))
    return table(spark, d, "events").select("event_id", (field("k") + field("absent")).alias("total"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['core', 'privacy'] WHEN 1 THEN ['core', 'technology_saas'] ELSE ['core', 'technology_saas', 'privacy'] END AS modules FROM customer")
def json_enabled_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules by default, those a profile asks for, and one that its industry means, each once."""
    k = F.col("c_custkey") % 3
    industry = F.when(k > 0, "B2B Software").otherwise("retail")
    inferred = F.when(F.lower(industry).rlike(r"\b(saas|software[\s-]?as[\s-]?a[\s-]?service|cloud|b2b software|enterprise software|subscription software|hosted (service|software))\b"), F.array(F.lit("technology_saas"))).otherwise(F.array().cast("array<string>"))
    asked = F.when(k == 2, F.array(F.lit("technology_saas"), F.lit("privacy"))).when(k == 0, F.array(F.lit("privacy"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select("c_custkey", F.array_union(F.array_union(F.array(F.lit("core")), asked), inferred).alias("modules"))


@query("SELECT l_orderkey, l_linenumber AS ordinal, l_partkey AS part FROM lineitem")
def json_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Findings into JSON envelopes, a document each, and out of them again."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("part"))
    back = read_envelopes(envelopes(lines, "l_orderkey"), "envelope", "struct<ordinal: int, part: bigint>")
    return back.select("l_orderkey", "finding.ordinal", "finding.part")


@query("""
SELECT '"' || b || '","' || n || '"' AS value FROM (SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS b, COUNT(*) AS n FROM part GROUP BY 1)
""")
def src_csv_report(spark: SparkSession, d: str) -> DataFrame:
    """A report by buckets as CSV lines."""
    b = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return csv_lines(table(spark, d, "part").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n")))


@query("""
SELECT o_orderkey, '<item><title>Order ' || o_orderkey || ' &amp; co</title><description>' || o_orderpriority || ' b</description><pubDate>' || STRFTIME(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' GMT</pubDate></item>' AS item, n FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 50
""")
def src_feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed of the 50 newest entries, newest first, without tags."""
    rows = desk.numbered(table(spark, d, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 50)
    safe = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plain = lambda t: F.regexp_replace(t, "<[^>]*>", "")
    title, body = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" & co")), F.concat(F.lit("<p>"), F.col("o_orderpriority"), F.lit(" <b>b</b></p>"))
    item = F.concat(F.lit("<item><title>"), safe(title), F.lit("</title><description>"), safe(plain(body)), F.lit("</description><pubDate>"), F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    return rows.select("o_orderkey", item.alias("item"), "n")


@query("SELECT vec_id, '[' || ARRAY_TO_STRING(LIST_TRANSFORM(LIST_TRANSFORM(embedding, lambda x: {'neg': x < 0, 'n': FLOOR(ABS(x::DOUBLE) * 1e7 + 0.5)::BIGINT}), lambda y: CASE WHEN y.neg THEN '-' ELSE '' END || (y.n // 10000000) || '.' || LPAD((y.n % 10000000)::VARCHAR, 7, '0')), ',') || ']' AS literal FROM embeddings")
def vec_literals(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as text with seven decimals."""
    return table(spark, d, "embeddings").select("vec_id", drafts.vector_text(F.col("embedding")).alias("literal"))


@query("SELECT vec_id FROM embeddings WHERE label % 3 <> 0")
def vec_to_embed_again(spark: SparkSession, d: str) -> DataFrame:
    """Items that have no vector of the wanted provider yet."""
    provider = F.when(F.col("label") % 3 == 0, "wanted").when(F.col("label") % 3 == 1, "other")
    return table(spark, d, "embeddings").filter(~provider.eqNullSafe(F.lit("wanted"))).select("vec_id")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'anchored' ELSE 'image' END AS reason FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def vec_image_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that show an image or are anchored, each once, anchored ones first."""
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit(" ![scan](vault-image:1)"))).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", content.alias("content"))
    anchored = docs.filter(F.col("doc_id") % 7 == 0).select("doc_id", F.lit("anchored").alias("reason"), F.lit(0).alias("rank"))
    shown = docs.filter(F.col("content").rlike(r"!\[[^\]]*\]\(vault-image:\d+\)")).select("doc_id", F.lit("image").alias("reason"), F.lit(1).alias("rank"))
    return relations.latest(anchored.union(shown), "doc_id", [F.col("rank")]).select("doc_id", "reason")


# Cases

BRIEF = ["As held in Acme Corp. v. Roe, 12 N.E.2d 34 (Ill. 1938). ", "See In re Estate of Doe, 45 So. 3d 67, 70 n.5 (Fla. 2009); ", "but cf. United States v. Smith Bros. of Ohio, 556 US 662 (2009). ", "The court relied on Brown vs. Green, 123 F. 3d 456. ", "Accord Jones v Lee, 1 S.Ct. 2 (1850). "]
CASES = [
    (0, "Acme Corp. v. Roe", 12, "N.E.2d", 34, "Ill.", 1938), (1, "In re Estate of Doe", 45, "So. 3d", 67, "Fla.", 2009), (2, "United States v. Smith Bros. of Ohio", 556, "US", 662, None, 2009), (3, "Brown vs. Green", 123, "F. 3d", 456, None, None), (4, "Jones v Lee", 1, "S.Ct.", 2, None, 1850),
]


def case_rows(pick_: list[tuple]) -> str:
    value = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(value, r)) + ")" for r in pick_)


def argued(spark: SparkSession, d: str) -> DataFrame:
    """A brief for each customer: five cases, from another one on for each."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.concat(*[pick(k + n, BRIEF) for n in range(5)]).alias("text"))


@query(f"SELECT c_custkey, name, volume, reporter, page, court, year FROM customer, (VALUES {case_rows(CASES)}) t(n, name, volume, reporter, page, court, year)")
def cite_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases of briefs with name, reporter, court and year."""
    return cases.extract_cases(argued(spark, d), "c_custkey", "text").select("c_custkey", "name", "volume", "reporter", "page", "court", "year")


@query("SELECT c_custkey, name, rule_id FROM customer, (VALUES ('Brown vs. Green', 'versus'), ('Jones v Lee', 'v-period'), ('United States v. Smith Bros. of Ohio', 'us-periods'), ('Brown vs. Green', 'reporter-space')) t(name, rule_id)")
def rule_case_names(spark: SparkSession, d: str) -> DataFrame:
    """Rules on names, reporters and courts of cases."""
    return cases.name_flags(cases.extract_cases(argued(spark, d), "c_custkey", "text")).select("c_custkey", "name", "rule_id")


#: Reporters that citations are looked for by; the table of years knows one more.
CITED_YEARS = [x for x in cases.YEARS if x[0] != "Fed. Cl."]


@query(f"""
WITH r(i, reporter, since, until) AS (VALUES {case_rows([(i, *x) for i, x in enumerate(CITED_YEARS)])}),
t AS (SELECT o_orderkey, reporter, since, until, 1840 + o_orderkey // {len(CITED_YEARS)} % 190 AS year FROM orders JOIN r ON i = o_orderkey % {len(CITED_YEARS)})
SELECT o_orderkey, 'Old Bank v. Lee' AS name, reporter, year::INT AS year, since FROM t WHERE year < since OR year > COALESCE(until, 9999)
""")
def rule_reporter_years(spark: SparkSession, d: str) -> DataFrame:
    """Every reporter of the table with years before, within and after its own."""
    n, k = len(CITED_YEARS), F.col("o_orderkey")
    reporter = F.get(F.array(*[F.lit(r) for r, _, _ in CITED_YEARS]), (k % n).cast("int"))
    text = F.concat(F.lit("He lost. Old Bank v. Lee, 12 "), reporter, F.lit(" 34 (Vt. "), (1840 + F.floor(k / n) % 190).cast("string"), F.lit(")."))
    return cases.out_of_years(cases.extract_cases(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")).select("o_orderkey", "name", "reporter", "year", "since")


@query("""
WITH t AS (SELECT o_orderkey, o_orderkey % 700 + 1 AS v, o_orderkey % 999 + 1 AS p, 1950 + o_orderkey % 70 AS y, o_orderkey % 4 AS lead, ['F.3d', 'U.S.', 'F. Supp. 2d', 'A.2d'][o_orderkey % 4 + 1] AS reporter,
  UPPER(LEFT(p_name, 1)) || SUBSTR(p_name, 2, STRPOS(p_name, ' ') - 2) AS party, UPPER(LEFT(p_type, 1)) || LOWER(SUBSTR(p_type, 2)) AS firm, n_name AS place
  FROM orders JOIN part ON p_partkey = o_custkey JOIN nation ON n_nationkey = o_custkey % 25)
SELECT o_orderkey, CASE WHEN lead = 2 THEN 'In re ' || party || ' Acquis. Corp.' WHEN lead = 3 THEN 'State ex rel. ' || party || ' v. City of ' || firm ELSE party || ' Petrol. Co. v. ' || firm || ' & Sons' END AS name,
  v::INT AS volume, reporter, p::INT AS page, CASE WHEN lead <> 1 THEN 'D. ' || REPLACE(place, '_', ' ') END AS court, y::INT AS year FROM t
""")
def cite_made_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose names, places and years come from the tables, behind sentences, signals and other cases."""
    k = F.col("o_orderkey")
    lead, number = k % 4, lambda n, plus=1: (k % n + plus).cast("string")
    title = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 100)))
    party, firm = title(F.substring_index("p_name", " ", 1)), title(F.col("p_type"))
    name = F.when(lead == 2, F.concat(F.lit("In re "), party, F.lit(" Acquis. Corp."))).when(lead == 3, F.concat(F.lit("State ex rel. "), party, F.lit(" v. City of "), firm)).otherwise(F.concat(party, F.lit(" Petrol. Co. v. "), firm, F.lit(" & Sons")))
    before = F.when(lead == 0, "The court so held. ").when(lead == 1, "But see ").when(lead == 2, "They won (1990); ").otherwise("It is settled.\n")
    reporter = pick(k, ["F.3d", "U.S.", "F. Supp. 2d", "A.2d"])
    court = F.when(lead != 1, F.concat(F.lit("D. "), F.replace("n_name", F.lit("_"), F.lit(" ")), F.lit(" "))).otherwise("")
    text = F.concat(before, name, F.lit(", "), number(700), F.lit(" "), reporter, F.lit(" "), number(999), F.lit(" ("), court, number(70, 1950), F.lit("). So it stands."))
    rows = table(spark, d, "orders").join(table(spark, d, "part"), F.col("p_partkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("o_custkey") % 25)
    return cases.extract_cases(rows.select("o_orderkey", text.alias("text")), "o_orderkey", "text").select("o_orderkey", "name", "volume", "reporter", "page", "court", "year")


@query("""
SELECT l_orderkey, l_linenumber, l_returnflag AS rule_cite FROM lineitem l WHERE l_returnflag <> 'N' AND l_linenumber > 1
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey AND o_orderkey % 5 = l.l_linenumber AND CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'R' END = l.l_returnflag)
""")
def rule_post_filter(spark: SparkSession, d: str) -> DataFrame:
    """Judged flags without blocked rules, without those that lack a target, and without what was flagged before."""
    judged = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("rule_cite"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("target"))
    rule = F.when(F.col("o_orderstatus") == "F", "A").otherwise("R")
    before = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 5).alias("target"), rule.alias("rule_cite"))
    return rules.post_filter(judged, before, ["N"], ["l_orderkey", "target"]).select("l_orderkey", "l_linenumber", "rule_cite")


@query("""
WITH m AS (SELECT p_partkey, p_size, p_name, ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS rn FROM (SELECT * FROM part WHERE CONTAINS(LOWER(p_name), 'red') ORDER BY p_size, p_partkey LIMIT 40))
SELECT p_partkey, 1.0::DOUBLE AS score FROM m WHERE rn = 1 ORDER BY p_size, p_partkey LIMIT 10
""")
def vec_keyword_limited(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search as a vault does it: at most min(500, 4 k) chunks by index, the first of each item, k of these."""
    return retrieval.keyword_limited(table(spark, d, "part"), "p_name", "p_size", "p_partkey", F.lower("p_name").contains("red"), 10).select("p_partkey", "score")


@query("SELECT c_custkey, 'Party' || s_suppkey || ' Holding' || (s_suppkey % 10) AS existing FROM customer JOIN supplier ON s_suppkey = c_custkey % 30 WHERE c_custkey % 30 % 10 = c_custkey % 7")
def rel_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """New cases that a known one's name tells already: both words of the shorter name in common."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    new = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Party"), (k % 30).cast("string"), F.lit(" v. Extra, Holding"), (k % 7).cast("string")).alias("name"))
    known = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Party"), s.cast("string"), F.lit(" Holding"), (s % 10).cast("string")).alias("name"))
    return cases.duplicate_names(new, known, "c_custkey", "name", "s_suppkey")
