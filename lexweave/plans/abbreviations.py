"""Queries of the rules that look up tables. Their texts go round by the customer's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import abbreviations, cases, rules
from ..sources.tables import table
from .desk import case_rows, pick
from .registry import query

TEXTS = [
    "See Smith Industries Company v. Department of Homeland Security, 12 F.3d 34 (2nd Cir. 1999).",
    "In re Bell Atl, 5 U.S. 137 (1803); Bell Atl Corp v. Twombly, 550 U.S. 544 (2007).",
    "In re International Services, 5 F.2d 3 (DC Cir. 1950). Roe v. Acme Tenn, 44 U.S. 2 (Calif. 1846).",
    "Doe v. Nat'l Mkt. of Ohio, 99 F. Supp. 2d 1 (SDNY 2001). International Bros. v. Roe, 1 F.4th 2 (9th Cir. 2021).",
]
RESTATEMENTS = [
    "Restatement 2d Contracts § 351", "Restatement (Second) of Contracts § 351", "Restatement (Second) of Torts § 1 (Am. L. Inst. 1965)", "Restatement of Trusts § 2 (Am. L. Inst. 2003).", "the Restatement of Trusts", None,
]


def flagged(size: int, rows: list[tuple]) -> str:
    """SQL for flags that go round by the customer: (number, rule_id, found, suggested_fix)."""
    return f"SELECT c_custkey, rule_id, found, suggested_fix FROM customer JOIN (VALUES {case_rows(rows)}) t(n, rule_id, found, suggested_fix) ON c_custkey % {size} = n"


def cited(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "customer").select("c_custkey", pick(F.col("c_custkey"), TEXTS).alias("text"))
    return cases.extract_cases(texts, "c_custkey", "text")


def told(flags: DataFrame) -> DataFrame:
    return flags.select("c_custkey", "rule_id", "found", "suggested_fix")


WORDS = list(abbreviations.CASE_WORDS.items())


def numbered(rows: list[tuple]) -> str:
    return case_rows([(i, *r) for i, r in enumerate(rows)])


@query(f"""
WITH w(i, word, short) AS (VALUES {numbered(WORDS)}),
t AS (SELECT c_custkey, word || CASE WHEN c_custkey // {len(WORDS)} % 2 = 1 THEN 's' ELSE '' END AS found, word, short, c_custkey % 900 + 1 AS v FROM customer JOIN w ON i = c_custkey % {len(WORDS)}),
s AS (SELECT t.c_custkey, t.found, t.v, CASE WHEN t.found = t.word THEN t.short WHEN p.short IS NOT NULL THEN p.short WHEN t.word NOT LIKE '%s' THEN REGEXP_REPLACE(t.short, '\\.$', 's.') END AS short
  FROM t LEFT JOIN w p ON p.word = t.found AND t.found <> t.word)
SELECT c_custkey, 'case-word' AS rule_id, found, 'Roe v. Old ' || short || ', ' || v || ' F.3d 34 (2d Cir. 1999)' AS suggested_fix FROM s WHERE short IS NOT NULL
""")
def rule_case_words(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the table and its plural, in the names of cases; the first of a party passes."""
    n = len(WORDS)
    k = F.col("c_custkey")
    word = F.get(F.array(*[F.lit(w) for w, _ in WORDS]), (k % n).cast("int"))
    text = F.concat(F.lit("See Roe v. Old "), word, F.when(F.floor(k / n) % 2 == 1, "s").otherwise(""), F.lit(", "), (k % 900 + 1).cast("string"), F.lit(" F.3d 34 (2d Cir. 1999)."))
    return told(abbreviations.long_words(cases.extract_cases(table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")))


@query(flagged(4, [(1, "case-word-period", "Atl", "In re Bell Atl., 5 U.S. 137 (1803)"), (1, "case-word-period", "Corp", "Bell Atl Corp. v. Twombly, 550 U.S. 544 (2007)")]))
def rule_case_word_periods(spark: SparkSession, d: str) -> DataFrame:
    """Short forms in cited cases without their period."""
    return told(abbreviations.missing_periods(cited(spark, d)))


@query(flagged(4, [(0, "court-form", "2nd Cir.", "2d Cir."), (2, "court-form", "DC Cir.", "D.C. Cir.")]))
def rule_court_forms(spark: SparkSession, d: str) -> DataFrame:
    """Courts of appeals in a wrong form; district reporters are not asked."""
    return told(abbreviations.wrong_courts(cited(spark, d)))


@query("SELECT c_custkey, rule_id, suggested_fix FROM customer JOIN (VALUES ('place-Calif.', 'Roe v. Acme Tenn, 44 U.S. 2 (Cal. 1846)'), ('place-Tenn', 'Roe v. Acme Tenn., 44 U.S. 2 (Calif. 1846)')) t(rule_id, suggested_fix) ON c_custkey % 4 = 2")
def rule_places(spark: SparkSession, d: str) -> DataFrame:
    """Places in a form that is not the table's."""
    return rules.flags(cited(spark, d).withColumn("kind", F.lit("reporter")), abbreviations.PLACE_RULES).select("c_custkey", "rule_id", "suggested_fix")


JOURNALS = list(abbreviations.PERIODICALS.items())


@query(f"""
WITH j(i, long, short) AS (VALUES {numbered(JOURNALS)}), t AS (SELECT c_custkey, c_custkey // {len(JOURNALS)} % 3 AS form, long, short FROM customer JOIN j ON i = c_custkey % {len(JOURNALS)})
SELECT c_custkey, 'periodical-form' AS rule_id, long AS found, short AS suggested_fix FROM t WHERE form = 0 AND long <> short
UNION ALL SELECT c_custkey, 'periodical-unknown', long || ' (Old)', NULL FROM t WHERE form = 2
""")
def rule_periodicals(spark: SparkSession, d: str) -> DataFrame:
    """Every periodical of the table: written out, in its short form, and with something behind it that makes it unknown."""
    n, k = len(JOURNALS), F.col("c_custkey")
    pick_of = lambda names: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
    form, long = F.floor(k / n) % 3, pick_of([x for x, _ in JOURNALS])
    name = F.when(form == 0, long).when(form == 1, pick_of([x for _, x in JOURNALS])).otherwise(F.concat(long, F.lit(" (Old)")))
    return told(abbreviations.periodical_flags(table(spark, d, "customer").select("c_custkey", name.alias("periodical"))))


@query("""
WITH v AS (SELECT c_custkey, c_custkey % 60 + 1 AS v, c_custkey % 7 = 0 AS named FROM customer),
n AS (SELECT c_custkey, v, CASE WHEN v <= 4 THEN v || ' Dall.' WHEN v <= 13 THEN (v - 4) || ' Cranch' WHEN v <= 25 THEN (v - 13) || ' Wheat.' WHEN v <= 41 THEN (v - 25) || ' Pet.' ELSE (v - 41) || ' How.' END AS found FROM v WHERE v <= 44 AND NOT named)
SELECT c_custkey, 'nominative' AS rule_id, found, 'Roe v. Doe, ' || v || ' U.S. (' || found || ') 10 (1830)' AS suggested_fix FROM n
""")
def rule_early_reports(spark: SparkSession, d: str) -> DataFrame:
    """Early volumes without their reporter's name: every volume up to 60, some with a name behind."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("Roe v. Doe, "), (k % 60 + 1).cast("string"), F.lit(" U.S. "), F.when(k % 7 == 0, "(1 Dall.) 10 (1830)").otherwise("10 (1830)"))
    cites = table(spark, d, "customer").select("c_custkey", F.lit("U.S.").alias("reporter"), (k % 60 + 1).alias("volume"), text.alias("text"))
    return told(abbreviations.early_reports(cites))


@query(
    flagged(
        6,
        [
            (0, "restatement-series", "2d", "Restatement (Second) of Contracts § 351"), (0, "restatement-publisher", None, "Restatement 2d Contracts § 351 (Am. L. Inst. <year>)"),
            (1, "restatement-publisher", "1981", "Restatement (Second) of Contracts § 351 (Am. L. Inst. 1981)"), (3, "restatement-no-series", None, None),
        ],
    )
)
def rule_restatements(spark: SparkSession, d: str) -> DataFrame:
    """Restatements without series, publisher or year; prose and nulls tell nothing."""
    return told(abbreviations.restatement_flags(table(spark, d, "customer").select("c_custkey", pick(F.col("c_custkey"), RESTATEMENTS).alias("text"))))


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 7 AS a, c_custkey % 5 AS b, c_custkey % 3 AS n, c_custkey % 900 + 1 AS v, c_custkey % 1200 + 1 AS p FROM customer),
t AS (SELECT *, CASE n WHEN 0 THEN 'Roe v. Apex Logistics Inc.' WHEN 1 THEN 'Roe v. Apex Logistics, Inc.' ELSE 'Roe v. Apex' END || ', ' || v || CASE WHEN a < 3 THEN ' So.3d ' ELSE ' So. 3d ' END || p ||
  CASE b WHEN 0 THEN ' (Fla. 4th DCA, 2001)' WHEN 1 THEN ' (Fla. 4th DCA 2001)' WHEN 2 THEN ' (Fla. DCA May 4, 2001)' ELSE ' (2001)' END AS text FROM c)
SELECT c_custkey, 'so-space' AS rule_id, REPLACE(text, 'So.3d', 'So. 3d') AS suggested_fix FROM t WHERE a < 3
UNION ALL SELECT c_custkey, 'court-comma', REPLACE(text, 'DCA, 2001', 'DCA 2001') FROM t WHERE b = 0
UNION ALL SELECT c_custkey, 'corporate-comma', NULL FROM t WHERE n = 0
""")
def rule_case_forms(spark: SparkSession, d: str) -> DataFrame:
    """Form of whole cases: the series of So., a comma before the year, a comma before Inc. The texts are made of columns."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "Roe v. Apex Logistics Inc.").when(k % 3 == 1, "Roe v. Apex Logistics, Inc.").otherwise("Roe v. Apex")
    court = F.when(k % 5 == 0, " (Fla. 4th DCA, 2001)").when(k % 5 == 1, " (Fla. 4th DCA 2001)").when(k % 5 == 2, " (Fla. DCA May 4, 2001)").otherwise(" (2001)")
    text = F.concat(F.lit("He cited. "), name, F.lit(", "), (k % 900 + 1).cast("string"), F.when(k % 7 < 3, " So.3d ").otherwise(" So. 3d "), (k % 1200 + 1).cast("string"), court, F.lit("."))
    cites = cases.extract_cases(table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text").withColumn("kind", F.lit("case"))
    own = [r for r in rules.RULES if "case" in r.kinds] + rules.FORM_RULES
    return rules.flags(cites, own).select("c_custkey", "rule_id", "suggested_fix")


@query("""
WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS k, (o_orderkey % 80 + 1)::VARCHAR AS n FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'federal-FRCP' WHEN 1 THEN 'federal-periods' WHEN 3 THEN 'paragraph-dash' ELSE 'cert-period' END AS rule_id,
  CASE k WHEN 0 THEN 'Fed. R. Civ. P. ' || n WHEN 1 THEN 'Fed. R. Civ. P. ' || n WHEN 3 THEN 'Compl. ¶¶ ' || n || '–99, cert. denied' ELSE 'Roe, 1 F.3d ' || n || ', cert. Granted' END AS suggested_fix FROM t WHERE k IN (0, 1, 3, 4)
""")
def rule_other_forms(spark: SparkSession, d: str) -> DataFrame:
    """Federal Rules, ranges of paragraphs and later history, in texts of their own."""
    k, n = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 80 + 1).cast("string")
    text = F.when(k == 0, F.concat(F.lit("FRCP "), n)).when(k == 1, F.concat(F.lit("Fed R Civ P "), n)).when(k == 2, F.concat(F.lit("Fed. R. Civ. P. "), n)).when(k == 3, F.concat(F.lit("Compl. ¶¶ "), n, F.lit("-99, cert. denied"))).when(k == 4, F.concat(F.lit("Roe, 1 F.3d "), n, F.lit(", cert Granted")))
    kind = F.when(k < 3, "rules").when(k < 5, "other")
    return rules.flags(table(spark, d, "orders").select("o_orderkey", text.alias("text"), kind.alias("kind")), rules.FORM_RULES).select("o_orderkey", "rule_id", "suggested_fix")
