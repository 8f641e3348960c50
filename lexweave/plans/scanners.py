"""Queries of the scanners of whole documents. Drafts go round by the customer's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scanners
from ..sources.tables import table
from .desk import pick
from .registry import query

DRAFTS = [
    "He said the...rule is … and well…known. See Compl. ¶¶ 31-38 and ¶ 4—6.",
    "Under the constitution, congress passed it. The Court of Appeals, not the United States Court of Appeals, cited the bill of rights.",
    "¶ 1-2, ¶ 3-4, ¶ 5-6, ¶ 7-8, ¶ 9-10, ¶ 11—12.",
    "The court said:\n\n    a quotation that is too short for this\n\nSmith, 550 U.S. at 555.\n\n\tA. Topic\n\n    I. Argument that is long enough here",
    "The Investment Advisers Act of 1940 applies. The Investors Act says so; The Exchange Act [hereinafter Exchange Act] too. The Private Securities Litigation Reform Act stands.",
    "The Investors Act is cited, but nothing in full.",
    None,
]
#: n, rule_id, text, count, suggested_fix
ISSUES = [
    (0, "ellipsis", "the...rule", 1, "the . . . rule"), (0, "ellipsis-sign", "…", 1, " . . . "), (0, "ellipsis-sign", "well…known", 1, "well . . . known"), (0, "paragraph-range", "¶¶ 31-38", 1, "¶¶ 31–38"), (0, "paragraph-range", "¶ 4—6", 1, "¶ 4–6"),
    (1, "capital-constitution", "the constitution", 1, "the Constitution"), (1, "capital-congress", "congress", 1, "Congress"), (1, "capital-court-of-appeals", "The Court of Appeals", 1, "The court of appeals"), (1, "capital-bill-of-rights", "the bill of rights", 1, "the Bill of Rights"),
    (2, "paragraph-range", "¶ 1-2", 5, None), (2, "paragraph-range", "¶ 11—12", 1, "¶ 11–12"), (3, "block-quote", "a quotation that is too short for this", 1, None), (4, "undeclared-name", "The Investors Act", 1, None),
]


def case_of(issue: tuple) -> tuple:
    """With start and end, by the first place of the text in its draft ("…" alone: the one with spaces)."""
    n, rule, text, count, fix = issue
    draft = DRAFTS[n]
    start = draft.index(" … ") + 1 if text == "…" else draft.index(text)
    return n, rule, start, start + len(text), text, count, fix


def values() -> str:
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, case_of(x))) + ")" for x in ISSUES)


@query(f'SELECT c_custkey, rule_id, a AS "start", b AS "end", text, n AS "count", suggested_fix FROM customer JOIN (VALUES {values()}) t(k, rule_id, a, b, text, n, suggested_fix) ON c_custkey % {len(DRAFTS)} = k')
def rule_document_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of whole drafts with their places."""
    return scanners.issues(table(spark, d, "customer").select("c_custkey", pick(F.col("c_custkey"), DRAFTS).alias("text")), "c_custkey", "text")


@query("""
WITH t AS (SELECT o_orderkey, o_orderkey % 8 AS n, o_orderkey % 3 AS c, o_orderkey % 9 + 1 AS plus, o_orderkey % 5 AS q, o_orderkey::VARCHAR AS k FROM orders),
r AS (SELECT o_orderkey, n, i, '¶ ' || i || CASE WHEN i = 3 THEN '—' ELSE '-' END || (i + plus) AS text FROM t JOIN RANGE(1, 9) g(i) ON i <= n),
h AS (SELECT *, COUNT(*) FILTER (i <> 3) OVER (PARTITION BY o_orderkey) AS hyphens FROM r)
SELECT o_orderkey, 'paragraph-range' AS rule_id, text, CASE WHEN i <> 3 AND hyphens >= 5 THEN hyphens ELSE 1 END AS "count", CASE WHEN i = 3 OR hyphens < 5 THEN REPLACE(REPLACE(text, '-', '–'), '—', '–') END AS suggested_fix
FROM h WHERE i = 3 OR hyphens < 5 OR i = 1
UNION ALL SELECT o_orderkey, 'ellipsis', 'so...w' || k, 1, 'so . . . w' || k FROM t
UNION ALL SELECT o_orderkey, 'capital-congress', 'congress', 1, 'Congress' FROM t WHERE c = 0
UNION ALL SELECT o_orderkey, 'capital-constitution', 'the constitution', 1, 'the Constitution' FROM t WHERE c = 1
UNION ALL SELECT o_orderkey, 'block-quote', RTRIM(REPEAT('word' || k || ' ', (q * 12 + 3)::BIGINT)), 1, NULL FROM t WHERE q BETWEEN 1 AND 3
UNION ALL SELECT o_orderkey, 'undeclared-name', 'The Market Act', 1, NULL FROM t WHERE c = 2
""")
def rule_made_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of drafts made of the orders' numbers: none to seven ranges, quotations of 3 to 51 words, acts with and without a declaration."""
    k = F.col("o_orderkey")
    n, c, q, number = (k % 8).cast("int"), k % 3, (k % 5).cast("int"), k.cast("string")
    ranges = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("¶ "), i.cast("string"), F.when(i == 3, "—").otherwise("-"), (i + k % 9 + 1).cast("string")))
    said = F.when(c == 0, "Then congress sat, Congress too. ").when(c == 1, "Under the constitution and the Constitution. ").otherwise("The Investors Act of 1940 and The Market Act stand. ")
    quotation = F.rtrim(F.repeat(F.concat(F.lit("word"), number, F.lit(" ")), q * 12 + 3))
    text = F.concat(F.lit("He said so...w"), number, F.lit(" of it. "), said, F.lit("See "), F.array_join(ranges, ", "), F.lit(" it held:\n\n    "), quotation, F.lit("\n\nAnd so on."))
    found = scanners.issues(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")
    return found.select("o_orderkey", "rule_id", "text", "count", "suggested_fix")
