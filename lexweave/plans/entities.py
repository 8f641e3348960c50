"""Existence of cited cases: orders cite parts, which stand for known cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import existence
from ..sources.tables import table
from .registry import query


def known_cases(spark: SparkSession, d: str) -> DataFrame:
    """Parts as cases: a citation each, written in one of three ways."""
    k = F.col("p_partkey")
    volume, page = F.floor(k / 1000) + 1, k % 1000 + 1
    cite = F.when(k % 3 == 0, F.format_string("%d F.3d %d", volume, page)).when(k % 3 == 1, F.format_string("%d  F. 3d %d", volume, page)).otherwise(F.format_string("%dF.3d%d", volume, page))
    return table(spark, d, "part").select(k.alias("case_id"), F.concat("p_name", F.lit(" v. "), "p_type", F.lit(" Corporation")).alias("case_name"), F.array(cite).alias("citations"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Orders as citations of the part with their customer's number, with faults by turns."""
    o, k = F.col("o_orderkey") % 11, F.col("o_custkey")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("o_custkey"), F.concat(F.upper("p_name"), F.lit(" vs. "), "p_type", F.lit(" Corp.")).alias("right_name"))
    rows = table(spark, d, "orders").join(names.hint("merge"), "o_custkey")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.when(o.isin(3, 7), None).when(o.isin(4, 6), "Doe v. Poe").otherwise(F.col("right_name")).alias("case_name"),
        F.when(o != 1, (F.floor(k / 1000) + 1).cast("string")).alias("volume"),
        F.when(o == 2, "WL").otherwise("F.3d").alias("reporter"),
        (k % 1000 + 1 + F.when(o.isin(5, 6, 7), 5000).otherwise(0)).cast("string").alias("page"),
        F.when(o == 0, "statute").otherwise("case").alias("citation_type"),
        (F.col("o_orderkey") % 2 == 0).alias("has_format_error"),
    )


CITED_SQL = r"""
WITH known AS (
  SELECT p_partkey AS case_id, p_name || ' v. ' || p_type || ' Corporation' AS case_name,
    CASE p_partkey % 3 WHEN 0 THEN (p_partkey // 1000 + 1) || ' F.3d ' || (p_partkey % 1000 + 1) WHEN 1 THEN (p_partkey // 1000 + 1) || ' F. 3d ' || (p_partkey % 1000 + 1)
      ELSE (p_partkey // 1000 + 1) || 'F.3d' || (p_partkey % 1000 + 1) END AS cite FROM part),
cited AS (
  SELECT o_orderkey AS id, o_orderkey % 11 AS o,
    CASE WHEN o IN (3, 7) THEN NULL WHEN o IN (4, 6) THEN 'Doe v. Poe' ELSE UPPER(p_name) || ' vs. ' || p_type || ' Corp.' END AS case_name,
    CASE WHEN o <> 1 THEN (o_custkey // 1000 + 1)::VARCHAR END AS volume, CASE WHEN o = 2 THEN 'WL' ELSE 'F.3d' END AS reporter,
    (o_custkey % 1000 + 1 + CASE WHEN o IN (5, 6, 7) THEN 5000 ELSE 0 END)::VARCHAR AS page,
    CASE WHEN o = 0 THEN 'statute' ELSE 'case' END AS citation_type, o_orderkey % 2 = 0 AS has_format_error
  FROM orders JOIN part ON p_partkey = o_custkey),
places AS (SELECT DISTINCT volume, reporter, page FROM cited WHERE citation_type = 'case' AND volume IS NOT NULL AND reporter <> 'WL'),
near AS (
  SELECT volume, reporter, page, case_id, case_name AS known_name, cite FROM places JOIN known ON CONTAINS(REPLACE(cite, ' ', ''), volume || reporter || page)),
hits AS (
  SELECT volume, reporter, page, MIN(CASE WHEN cite = volume || ' ' || reporter || ' ' || page THEN case_id END) AS exact,
    MIN(CASE WHEN REGEXP_MATCHES(cite, '(^|[^0-9])' || volume || ' ') AND REGEXP_MATCHES(cite, ' ' || page || '([^0-9A-Za-z]|$)') THEN case_id END) AS parts,
    MIN(CASE WHEN REGEXP_MATCHES(REPLACE(cite, ' ', ''), '(^|[^0-9])' || volume || 'F[.]3d' || page || '([^0-9]|$)') THEN case_id END) AS run
  FROM near GROUP BY ALL),
words AS (
  SELECT case_id, case_name, LIST_SORT(LIST_DISTINCT(STRING_SPLIT(REPLACE(REPLACE(LOWER(case_name), '.', ''), 'corporation', 'corp'), ' '))) AS w FROM known),
names AS (SELECT w, MIN(case_id) AS case_id FROM words GROUP BY w),
met AS (
  SELECT c.*, CASE WHEN c.citation_type <> 'case' THEN 'type' WHEN c.volume IS NULL THEN 'incomplete' WHEN c.reporter = 'WL' THEN 'reporter' WHEN exact IS NOT NULL THEN 'exact' WHEN parts IS NOT NULL THEN 'parts'
      WHEN run IS NOT NULL AND c.case_name IS NULL THEN 'run' WHEN n.case_id IS NOT NULL THEN 'name' ELSE 'none' END AS stage, exact, parts, run, n.case_id AS elsewhere
  FROM cited c LEFT JOIN hits h USING (volume, reporter, page)
  LEFT JOIN names n ON n.w = LIST_SORT(LIST_DISTINCT(STRING_SPLIT(REPLACE(REPLACE(REPLACE(LOWER(c.case_name), '.', ''), 'corporation', 'corp'), ' vs ', ' v '), ' ')))),
found AS (SELECT met.*, CASE stage WHEN 'exact' THEN exact WHEN 'parts' THEN parts WHEN 'run' THEN run WHEN 'name' THEN elsewhere END AS found_id FROM met),
judged AS (
  SELECT f.id, stage, found_id AS case_id, has_format_error, CASE WHEN stage IN ('type', 'reporter') THEN 'not_applicable' WHEN stage IN ('incomplete', 'none') THEN 'existence_not_found' WHEN stage = 'name' THEN 'existence_location_mismatch'
    WHEN f.case_name IS NULL THEN 'existence_verified'
    WHEN LEN(LIST_INTERSECT(LIST_FILTER(w.w, lambda x: LENGTH(x) > 1), LIST_FILTER(STRING_SPLIT(REPLACE(LOWER(f.case_name), '.', ''), ' '), lambda x: LENGTH(x) > 1 AND x <> 'vs'))) * 2
      >= LEAST(LEN(LIST_FILTER(w.w, lambda x: LENGTH(x) > 1)), LEN(LIST_DISTINCT(LIST_FILTER(STRING_SPLIT(REPLACE(LOWER(f.case_name), '.', ''), ' '), lambda x: LENGTH(x) > 1 AND x <> 'vs')))) THEN 'existence_verified'
    ELSE 'existence_name_mismatch' END AS status
  FROM found f LEFT JOIN words w ON w.case_id = found_id)
"""


@query(
    CITED_SQL
    + """SELECT id, stage, status, case_id, CASE WHEN status LIKE '%mismatch' THEN 'existence_uncertain' ELSE status END AS stored,
  CASE WHEN status = 'existence_name_mismatch' THEN 'name' WHEN status = 'existence_location_mismatch' THEN 'location' WHEN status = 'existence_not_found' AND NOT has_format_error THEN 'unresolved' END AS flag FROM judged"""
)
def cite_existence(spark: SparkSession, d: str) -> DataFrame:
    """Every citation with the stage that decided it, its status, as stored, and the flag that it gets."""
    found = existence.resolve(citations(spark, d), known_cases(spark, d), by_name=True)
    flag = existence.flag_kind(F.col("status"), F.col("has_format_error"))
    return found.select("id", "stage", "status", "case_id", existence.stored_status(F.col("status")).alias("stored"), flag.alias("flag"))


KINDS = ["book", "article", "thesis", "bill", "hearing", "icj_case", "case"]
FAMILY = ["secondary", "secondary", "secondary", "official", "official", "foreign", "primary"]


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['book', 'article', 'thesis', 'bill', 'hearing', 'icj_case', 'case'][l_partkey % 7 + 1] AS kind,
  CASE WHEN l_partkey % 7 = 6 THEN 'case' WHEN l_partkey % 7 = 0 THEN 'book' ELSE 'unknown' END AS stored_type,
  ['BB R. 15', 'BB R. 16', 'BB R. 18', 'BB R. 13.2', 'BB R. 11', 'BB R. 21', NULL][l_partkey % 7 + 1] AS governing_rule, CASE WHEN l_partkey % 7 = 1 THEN 'T13' END AS governing_table
FROM lineitem
""")
def cite_governing(spark: SparkSession, d: str) -> DataFrame:
    """Citations with the type that is stored, the rule and the table that govern them."""
    i = (F.col("l_partkey") % len(KINDS)).cast("int")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.get(F.array(*map(F.lit, KINDS)), i).alias("kind"), F.get(F.array(*map(F.lit, FAMILY)), i).alias("family"))
    return existence.governed(rows, "kind").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind", existence.stored_type(F.col("kind")).alias("stored_type"), "governing_rule", "governing_table")
