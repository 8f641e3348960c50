"""Queries of the rules on short forms and treatises. Texts go round by the customer's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import short_forms
from ..sources.tables import table
from .desk import case_rows, pick
from .registry import query

DRAFTS = [
    "Roe v. Wade, 410 U.S. 113 (1973). Id. at 120.",
    "See Roe v. Wade, 410 U.S. 113 (1973); Doe v. Bolton, 410 U.S. 179 (1973). Id. at 120.",
    "In Jones v. Lee the court erred. Roe v. Wade, 410 U.S. 113 (1973). Id. at 5.",
    "Bell v. Twombly, 550 U.S. 544 (2007). Twombly, supra, at 557. See supra Part II. 5B Wright & Miller, supra, at 3.",
    "Stephen Burbank, The Costs of Complexity, 85 Mich. 1463 (1987). Burbank, supra, at 115. Guide [hereinafter ABA Guide]. ABA Guide, supra.",
    None,
]
BOOKS = ["Nimmer on Copyright § 3 (2020)", "4 Nimmer on Copyright § 3 (2020)", "5 Corbin on Contracts § 1 (3d ed. 2019)", "Roe, A Title, 12 Yale L.J. 34 (2001)", "Some Novel (1999)", None]


@query(f"""
SELECT c_custkey, kind, text FROM customer JOIN (VALUES {case_rows([(1, "id-after-string", "Id. at 120"), (1, "id-antecedent", "Id. at 120"), (2, "id-antecedent", "Id. at 5"), (3, "supra-case", "Twombly, supra, at 557")])}) t(n, kind, text)
ON c_custkey % {len(DRAFTS)} = n
""")
def rule_short_forms(spark: SparkSession, d: str) -> DataFrame:
    """Id. and supra where they may not stand."""
    drafts = table(spark, d, "customer").select("c_custkey", pick(F.col("c_custkey"), DRAFTS).alias("text"))
    return short_forms.short_form_issues(drafts, "c_custkey", "text").select("c_custkey", "kind", "text")


@query(f"""
SELECT c_custkey, rule_id FROM customer JOIN (VALUES {case_rows([(0, "treatise-volume"), (1, "treatise-edition")])}) t(n, rule_id) ON c_custkey % {len(BOOKS)} = n
""")
def rule_treatises(spark: SparkSession, d: str) -> DataFrame:
    """Treatises without a volume or an edition."""
    books = table(spark, d, "customer").select("c_custkey", pick(F.col("c_custkey"), BOOKS).alias("text"))
    return short_forms.treatise_flags(books).select("c_custkey", "rule_id")


@query("""
WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k, (o_orderkey % 300 + 1)::VARCHAR AS n, UPPER(LEFT(p_name, 1)) || SUBSTR(p_name, 2, STRPOS(p_name, ' ') - 2) AS party FROM orders JOIN part ON p_partkey = o_custkey)
SELECT o_orderkey, 'id-after-string' AS kind, 'Id. at ' || n AS text FROM t WHERE k = 1
UNION ALL SELECT o_orderkey, 'id-antecedent', 'Id. at ' || n FROM t WHERE k IN (1, 2)
UNION ALL SELECT o_orderkey, 'supra-case', party || ', supra, at ' || n FROM t WHERE k = 3
""")
def rule_made_short_forms(spark: SparkSession, d: str) -> DataFrame:
    """Id. and supra with the parts' names as parties and authors: plain, in a string, behind another case, of a case, of an article's author."""
    k, n = F.col("o_orderkey") % 5, (F.col("o_orderkey") % 300 + 1).cast("string")
    party = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring(F.substring_index("p_name", " ", 1), 2, 100))
    case = F.concat(party, F.lit(" v. Wade, "), n, F.lit(" U.S. 113 (1973)"))
    text = (
        F.when(k == 0, F.concat(case, F.lit(". Id. at "), n, F.lit(".")))
        .when(k == 1, F.concat(F.lit("See "), case, F.lit("; Doe v. Bolton, 410 U.S. 179 (1973). Id. at "), n, F.lit(".")))
        .when(k == 2, F.concat(F.lit("In Jones v. Lee it erred. "), case, F.lit(". Id. at "), n, F.lit(".")))
        .when(k == 3, F.concat(case, F.lit(". "), party, F.lit(", supra, at "), n, F.lit(". See supra Part II.")))
        .otherwise(F.concat(F.lit("Anna "), party, F.lit(", The Costs of It, 85 Mich. 1463 (1987). "), party, F.lit(", supra, at "), n, F.lit(".")))
    )
    rows = table(spark, d, "orders").join(table(spark, d, "part"), F.col("p_partkey") == F.col("o_custkey"))
    return short_forms.short_form_issues(rows.select("o_orderkey", text.alias("text")), "o_orderkey", "text").select("o_orderkey", "kind", "text")
