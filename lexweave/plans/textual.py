"""Text, span and rule queries. Where the test tables lack a kind of text, it is composed from their numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import legal, text
from ..operators import citations, grading, layout, listing, markup, merge, messages, relations, rules, spans
from ..sources.batches import spread
from ..sources.tables import table
from .registry import query


@query(r"SELECT doc_id, SHA256(REGEXP_REPLACE(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS digest FROM documents")
def txt_strip_controls(spark: SparkSession, d: str) -> DataFrame:
    """Texts without control characters, as digests."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.encode(text.strip_controls(F.col("text")), "utf-8"), 256).alias("digest"))


@query(r"""
SELECT doc_id, LENGTH(text) >= 80 AND LENGTH(REGEXP_REPLACE(text, '[ \t\n\r]', '', 'g')) >= 60
  AND LEN(REGEXP_EXTRACT_ALL(text, '[A-Za-zÀ-ÖØ-öø-ſ]')) * 100 < LENGTH(REGEXP_REPLACE(text, '[ \t\n\r]', '', 'g')) * 45 AS garbled FROM documents
""")
def txt_garbled(spark: SparkSession, d: str) -> DataFrame:
    """Which texts have too few letters to be prose."""
    return table(spark, d, "documents").select("doc_id", text.looks_garbled(F.col("text")).alias("garbled"))


def html_sql(source: str) -> str:
    """The steps of ``html_to_text`` as nested calls."""
    out = source
    for pattern, to, flags in (
        (r"<script\b[^>]*>.*?</script\s*>", "' '", "gis"),
        (r"<style\b[^>]*>.*?</style\s*>", "' '", "gis"),
        (r"<noscript\b[^>]*>.*?</noscript\s*>", "' '", "gis"),
        (r"</(p|div|section|article|li|h[1-6]|tr|br)\s*>", "CHR(10)", "gi"),
        (r"<br\s*/?>", "CHR(10)", "gi"),
        ("<[^>]+>", "' '", "g"),
    ):
        out = f"REGEXP_REPLACE({out}, '{pattern}', {to}, '{flags}')"
    for name, letter in text.ENTITIES.items():
        out = "REPLACE({}, '{}', '{}')".format(out, name, letter.replace("'", "''"))
    for pattern, to in ((r"\r\n?", "CHR(10)"), (r"[ \t]+", "' '"), (r"\n[ \t]+", "CHR(10)"), (r"\n{3,}", "CHR(10) || CHR(10)")):
        out = f"REGEXP_REPLACE({out}, '{pattern}', {to}, 'g')"
    return f"TRIM({out}, ' ' || CHR(9) || CHR(10))"


@query(f"SELECT page_id, {html_sql('html')} AS text FROM pages")
def txt_html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts of all pages."""
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


MAIN_SQL = "COALESCE(NULLIF(REGEXP_EXTRACT(html, '<main\\b[^>]*>(.*?)</main>', 1, 'is'), ''), NULLIF(REGEXP_EXTRACT(html, '<article\\b[^>]*>(.*?)</article>', 1, 'is'), ''), html)"


@query(f"SELECT page_id, LENGTH(text) AS n_chars, LENGTH(text) < 200 AS thin FROM (SELECT page_id, {html_sql(MAIN_SQL)} AS text FROM pages)")
def txt_main_part(spark: SparkSession, d: str) -> DataFrame:
    """Length of each page's main part, and whether it is too thin to use."""
    body = text.html_to_text(text.main_part(F.col("html")))
    return table(spark, d, "pages").select("page_id", F.length(body).alias("n_chars"), (F.length(body) < 200).alias("thin"))


@query(r"""
WITH a AS (SELECT doc_id, TRIM(REGEXP_REPLACE(LOWER(text), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents),
b AS (SELECT doc_id, CASE WHEN LENGTH(s) <= 60 THEN s WHEN CONTAINS(LEFT(s, 60), '-') THEN TRIM(REGEXP_REPLACE(LEFT(s, 60), '-[^-]*$', ''), '-') ELSE TRIM(LEFT(s, 60), '-') END AS s FROM a)
SELECT doc_id, COALESCE(NULLIF(s, ''), 'case') AS slug FROM b
""")
def txt_slugs(spark: SparkSession, d: str) -> DataFrame:
    """A slug of each text."""
    return table(spark, d, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("""
SELECT p_partkey, 'NDA with ' || UPPER(LEFT(w[1], 1)) || LOWER(w[1][2:]) AS title FROM (SELECT p_partkey, STRING_SPLIT(p_name, ' ') AS w FROM part)
""")
def txt_humanize(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers spelled out."""
    word = F.element_at(F.split("p_name", " "), 1)
    return table(spark, d, "part").select("p_partkey", text.humanize(F.concat(F.lit("nda_with-"), word)).alias("title"))


TOKENS_SQL = "SELECT p_name, LIST_DISTINCT(LIST_FILTER(STRING_SPLIT(REGEXP_REPLACE(LOWER(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: LENGTH(w) >= 3)) AS t FROM (SELECT DISTINCT p_name FROM part)"


@query(r"""
WITH n AS (SELECT name, LIST_SORT(LIST_DISTINCT(LIST_FILTER(STRING_SPLIT(REGEXP_REPLACE(LOWER(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: LENGTH(w) >= 3))) AS t
  FROM (SELECT p_name || ' v. ' || p_brand || ' ' || p_type AS name FROM part UNION SELECT 'In re ' || p_type FROM part)),
s AS (SELECT t, MIN(name) AS member FROM n WHERE LEN(t) > 0 GROUP BY t),
w AS (SELECT t, member, UNNEST(t) AS word FROM s),
k AS (SELECT a.word || ' ' || b.word AS words, 'both' AS part, a.member FROM w a JOIN w b ON a.t = b.t AND a.word < b.word
  UNION ALL SELECT word, CASE WHEN LEN(t) = 1 THEN 'from' ELSE 'to' END, member FROM w WHERE word IN (SELECT t[1] FROM s WHERE LEN(t) = 1)),
g AS (SELECT *, COUNT(*) OVER (PARTITION BY words) AS c, MIN(member) OVER (PARTITION BY words) AS representative FROM k)
SELECT words, part, member, representative FROM g WHERE c > 1
UNION ALL SELECT ARRAY_TO_STRING(t, ' '), 'same', name, member FROM n JOIN s USING (t)
""")
def txt_fuzzy_join(spark: SparkSession, d: str) -> DataFrame:
    """Names that match in two words or their only one, as groups of all that have the words; each name with the one of the same words that stands for it in them (part ``same``)."""
    parts = table(spark, d, "part")
    names = parts.select(F.concat("p_name", F.lit(" v. "), "p_brand", F.lit(" "), "p_type").alias("name")).union(parts.select(F.concat(F.lit("In re "), "p_type")))
    members, groups = relations.fuzzy_groups(names.distinct(), "name")
    same = members.select(F.array_join("words", " ").alias("words"), F.lit("same").alias("part"), F.col("name").alias("member"), F.col("member").alias("representative"))
    return groups.unionByName(same)


@query(r"""
WITH n AS (SELECT name, LIST_DISTINCT(LIST_FILTER(STRING_SPLIT(REGEXP_REPLACE(LOWER(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: LENGTH(w) >= 3)) AS t
  FROM (SELECT DISTINCT p_name || ' v. ' || p_type AS name FROM part UNION SELECT DISTINCT 'In re ' || p_type FROM part))
SELECT a.name, b.name AS other FROM n a JOIN n b ON LEN(LIST_INTERSECT(a.t, b.t)) >= LEAST(2, LEN(a.t)) AND LEN(a.t) > 0 WHERE a.name <> b.name
""")
def txt_fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """The same over names of cases that do match."""
    parts = table(spark, d, "part")
    names = parts.select(F.concat("p_name", F.lit(" v. "), "p_type").alias("name")).union(parts.select(F.concat(F.lit("In re "), "p_type"))).distinct()
    return relations.fuzzy_names(names, "name")


@query(f"""
WITH n AS ({TOKENS_SQL}) SELECT p_partkey, LEN(LIST_INTERSECT(n.t, ['small', 'red', 'ring'])) / LEAST(LEN(n.t), 3) AS overlap FROM part JOIN n USING (p_name)
""")
def txt_name_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of words in common with a given name."""
    return table(spark, d, "part").select("p_partkey", text.name_overlap(F.col("p_name"), F.lit("The Small Red Ring Co.")).alias("overlap"))


@query("SELECT doc_id, ((LENGTH(t) - LENGTH(REPLACE(t, 'the', ''))) / 3)::BIGINT AS n FROM (SELECT doc_id, TRIM(REGEXP_REPLACE(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def txt_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """How often a needle stands in each text."""
    return table(spark, d, "documents").select("doc_id", text.occurrences(F.col("text"), F.lit("the")).alias("n"))


@query("SELECT o_orderkey, o_orderdate::DATE AS decided FROM orders")
def txt_parse_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in five formats."""
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 5
    written = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "MM/dd/yyyy")).when(k == 2, F.date_format(day, "yyyy/MM/dd")).when(k == 3, F.date_format(day, "d MMMM yyyy")).otherwise(F.date_format(day, "MMMM d, yyyy"))
    return table(spark, d, "orders").select("o_orderkey", text.parse_date(written).alias("decided"))


def clause(n: Column, k: Column) -> Column:
    """A clause about a number."""
    n = n.cast("int").cast("string")
    return (
        F.when(k == 1, F.concat(F.lit("Payment is due Net "), n, F.lit(" from invoice")))
        .when(k == 2, F.concat(F.lit("liability shall not exceed $"), n, F.lit(" million in total")))
        .when(k == 3, F.concat(F.lit("coverage of $"), n, F.lit(",000 per claim")))
        .when(k == 4, F.concat(F.lit("an uptime of "), n, F.lit(".5% monthly")))
        .when(k == 5, F.concat(F.lit("cure within thirty ("), n, F.lit(") business days")))
        .when(k == 6, F.concat(F.lit("for "), n, F.lit(" years after")))
        .otherwise("no number here")
    )


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN q WHEN 2 THEN q * 1000000 WHEN 3 THEN q * 1000 WHEN 4 THEN q + 0.5 WHEN 5 THEN q WHEN 6 THEN q END::DOUBLE AS value,
  CASE l_linenumber WHEN 1 THEN 'days' WHEN 2 THEN 'dollars' WHEN 3 THEN 'dollars' WHEN 4 THEN 'percent' WHEN 5 THEN 'days' WHEN 6 THEN 'years' END AS kind
FROM (SELECT *, l_quantity::INT AS q FROM lineitem)
""")
def txt_quantities(spark: SparkSession, d: str) -> DataFrame:
    """The first quantity of clauses."""
    q = legal.quantity(clause(F.col("l_quantity"), F.col("l_linenumber")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q["value"].alias("value"), q["kind"].alias("kind"))


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_linenumber AS k, l_partkey % 3 AS who, l_quantity::INT AS a, (l_suppkey % 50)::INT + 1 AS b FROM lineitem),
v AS (SELECT *, CASE who WHEN 0 THEN b > a WHEN 1 THEN b < a END AS harms FROM f)
SELECT l_orderkey, l_linenumber,
  CASE WHEN who = 2 OR k NOT IN (1, 2, 3, 4) THEN 'ambiguous' WHEN harms THEN 'fail' WHEN k = 1 THEN 'pass' ELSE 'ambiguous' END AS verdict,
  CASE WHEN who = 2 OR k NOT IN (1, 2, 3, 4) THEN NULL WHEN k = 1 THEN 'commercial-net-term-direction' WHEN NOT harms THEN NULL
    WHEN k = 2 THEN 'risk-liability-cap-direction' WHEN k = 3 THEN 'insurance-limit-direction' ELSE 'performance-sla-threshold-direction' END AS rule
FROM v
""")
def rule_directions(spark: SparkSession, d: str) -> DataFrame:
    """Edits judged by direction, role and category."""
    k = F.col("l_linenumber")
    category = F.element_at(F.array(*map(F.lit, ["Payment terms", "liability_cap", "Insurance", "SLA / uptime", "termination", "confidentiality", "other"])), k)
    role = F.element_at(F.array(*map(F.lit, ["Service Provider", "Licensee", "Observer"])), (F.col("l_partkey") % 3 + 1).cast("int"))
    edits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", category.alias("category"), role.alias("role"), clause(F.col("l_quantity"), k).alias("source_text"), clause(F.col("l_suppkey") % 50 + 1, k).alias("proposed_text"))
    return legal.with_direction(edits).select("l_orderkey", "l_linenumber", "verdict", "rule")


#: Composed texts, in the order of the answers that the SQL below gives for them.
COURTS = ["S.D. Tex.", "9th Cir.", "Superior Court", "Tex. App.", "Somewhere", "Bankr. D. Del."]
ACTIONS = ["Signed by Governor", "Died in committee", "Referred to committee", "Chaptered by Secretary", "VETOED", "Effective date 2024"]
ENTRIES = ["ORDER to show cause re sanctions", "NOTICE OF APPEARANCE by counsel", "MOTION to dismiss complaint", "Memorandum and Order", "Summons issued", "Status conference held"]


@query("""
SELECT o_orderkey, ['federal', 'unknown', 'state', 'state', 'unknown', 'federal'][k] AS court_kind, ['enacted', 'failed', 'pending', 'enacted', 'failed', 'enacted'][k] AS bill_status,
  [17, -10, -7, 7, -8, -4][k] AS docket_score FROM (SELECT o_orderkey, (o_orderkey % 6)::INT + 1 AS k FROM orders)
""")
def txt_classifiers(spark: SparkSession, d: str) -> DataFrame:
    """Courts, bill actions and docket entries classified by pattern."""
    k = (F.col("o_orderkey") % 6 + 1).cast("int")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), k)
    return table(spark, d, "orders").select("o_orderkey", legal.court_kind(of(COURTS)).alias("court_kind"), legal.bill_status(of(ACTIONS)).alias("bill_status"), legal.docket_score(of(ENTRIES), F.lit(None)).alias("docket_score"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """JSON out of fenced text."""
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nthanks"))
    return table(spark, d, "events").select("event_id", F.from_json(text.tolerant_json(fenced), "k long")["k"].alias("k"))


SPAN_SQL = "SELECT l_orderkey, l_linenumber, ROW_NUMBER() OVER () AS r, l_partkey % 60 AS a, l_partkey % 60 + l_quantity::INT AS b FROM lineitem"


def places(spark: SparkSession, d: str) -> DataFrame:
    """Line items as spans of their order."""
    a = F.col("l_partkey") % 60
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", a.alias("start"), (a + F.col("l_quantity").cast("int")).alias("end"))


@query(f"""
WITH s AS ({SPAN_SQL}) SELECT l_orderkey, l_linenumber, a AS "start", b AS "end" FROM s x
WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.l_orderkey = x.l_orderkey AND y.a <= x.a AND y.b >= x.b AND (y.a < x.a OR y.b > x.b))
""")
def span_drop_contained(spark: SparkSession, d: str) -> DataFrame:
    """Spans within no larger one, by one window and no join of spans with spans."""
    return spans.drop_contained(places(spark, d), "l_orderkey").select("l_orderkey", "l_linenumber", "start", "end")


@query(f"""
WITH s AS (SELECT DISTINCT l_orderkey, a, b FROM ({SPAN_SQL})) SELECT l_orderkey, a AS "start", b AS "end" FROM s x
WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.l_orderkey = x.l_orderkey AND y.a <= x.a AND y.b >= x.b AND (y.a < x.a OR y.b > x.b))
""")
def span_one_of_each(spark: SparkSession, d: str) -> DataFrame:
    """The same, and one of identical spans."""
    return spans.one_of_each(places(spark, d), "l_orderkey", [F.col("l_linenumber"), F.col("l_suppkey")]).select("l_orderkey", "start", "end")


@query(f"""
WITH s AS ({SPAN_SQL}), g0 AS (SELECT * FROM s WHERE l_linenumber <= 2),
g1 AS (SELECT * FROM s x WHERE l_linenumber BETWEEN 3 AND 4 AND NOT EXISTS (SELECT 1 FROM g0 y WHERE y.l_orderkey = x.l_orderkey AND y.a <= x.a AND y.b >= x.b)),
g2 AS (SELECT * FROM s x WHERE l_linenumber > 4 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM g0 UNION ALL SELECT * FROM g1) y WHERE y.l_orderkey = x.l_orderkey AND y.a <= x.a AND y.b >= x.b))
SELECT l_orderkey, l_linenumber, a AS "start", b AS "end", 0 AS priority FROM g0 UNION ALL SELECT l_orderkey, l_linenumber, a, b, 1 FROM g1 UNION ALL SELECT l_orderkey, l_linenumber, a, b, 2 FROM g2
""")
def span_by_priority(spark: SparkSession, d: str) -> DataFrame:
    """Extractors in order of priority: what lies within a kept higher span goes."""
    s, n = places(spark, d), F.col("l_linenumber")
    return spans.by_priority([s.filter(n <= 2), s.filter(n.between(3, 4)), s.filter(n > 4)], "l_orderkey").select("l_orderkey", "l_linenumber", "start", "end", "priority")


@query(f"""
WITH s AS ({SPAN_SQL}) SELECT x.l_orderkey, y.l_linenumber AS high_l_linenumber, x.l_linenumber AS low_l_linenumber FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey
WHERE x.l_linenumber > 2 AND y.l_linenumber <= 2 AND y.a < x.b AND x.a < y.b AND NOT (y.a <= x.a AND y.b >= x.b)
""")
def span_partial_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Spans that overlap in part."""
    s = places(spark, d)
    return spans.partial_overlaps(s.filter("l_linenumber <= 2"), s.filter("l_linenumber > 2"), "l_orderkey", "l_linenumber")


STATE_SQL = """
WITH e AS (SELECT event_id, user_id, ts, event_type AS kind, (value::INT % 3)::INT AS name, event_type = 'view' AS is_full, event_type IN ('click', 'error') AS is_short FROM events),
i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, LAG(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_kind FROM e),
f AS (SELECT *, MAX(CASE WHEN is_full THEN idx END) OVER (PARTITION BY user_id, name ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_full FROM i),
b AS (SELECT *, CASE WHEN last_full IS NOT NULL THEN (SELECT COUNT(*) FROM i WHERE i.user_id = f.user_id AND i.name <> f.name AND i.idx > f.last_full AND i.idx < f.idx) END AS between_ FROM f)
"""


def state(spark: SparkSession, d: str) -> DataFrame:
    """Events as cites of three names in each user's document."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), (F.rint("value").cast("int") % 3).alias("name"))
    return spans.with_state(e, "user_id", [F.col("ts"), F.col("event_id")], "name", F.col("kind") == "view")


@query(STATE_SQL + "SELECT event_id, idx, prev_kind, last_full, between_ AS \"between\" FROM b")
def win_citation_state(spark: SparkSession, d: str) -> DataFrame:
    """Order, previous cite, last full cite of the name and cites of others since, by windows."""
    return state(spark, d).select("event_id", "idx", "prev_kind", "last_full", "between")


@query(STATE_SQL + "SELECT event_id, idx, between_ AS \"between\" FROM b WHERE is_short AND between_ >= 6 QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, name, last_full ORDER BY idx) = 1")
def rule_short_form_gap(spark: SparkSession, d: str) -> DataFrame:
    """Short forms too far from their full cite, once for each gap."""
    return spans.far_short_forms(state(spark, d), "user_id", "name", F.col("kind").isin("click", "error")).select("event_id", "idx", "between")


@query(r"""
WITH l AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line FROM documents)
SELECT doc_id, LEN(REGEXP_EXTRACT_ALL(text, '\n'))::INT AS paragraphs FROM documents
""")
def win_paragraph_index(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph of each text's last character: boundaries before its offset."""
    ends = F.transform(F.split("text", "\n"), lambda x, i: i)
    bounds = F.slice(F.aggregate(F.transform(F.split("text", "\n"), lambda x: F.length(x)), F.array(F.lit(-1)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n + 1))), 2, F.greatest(F.size(ends) - 1, F.lit(0)))
    return table(spark, d, "documents").select("doc_id", spans.paragraph_of(F.length("text"), bounds).alias("paragraphs"))


def briefs(spark: SparkSession, d: str) -> DataFrame:
    """A line of argument with citations for each order."""
    n = lambda k: (F.col("o_orderkey") % k + 1).cast("string")
    cite = F.concat(F.lit("Smith v. Jones, "), n(500), F.lit(" U.S. "), n(900), F.lit(" (1999). Id. at "), n(40), F.lit("-"), n(70), F.lit("; see 42 U.S.C. § "), n(2000), F.lit(" and 29 CFR "), n(1600), F.lit(". U.S. Const. amend. XIV; Smith, supra note "), n(9), F.lit("."))
    return table(spark, d, "orders").select("o_orderkey", cite.alias("text"))


@query(r"""
WITH t AS (SELECT o_orderkey, (o_orderkey % 500 + 1)::VARCHAR || ' U.S. ' || (o_orderkey % 900 + 1) AS rep, 'Id. at ' || (o_orderkey % 40 + 1) || '-' || (o_orderkey % 70 + 1) AS idc,
  '42 U.S.C. § ' || (o_orderkey % 2000 + 1) AS usc, '29 CFR ' || (o_orderkey % 1600 + 1) || '.' AS cfr, 'supra note ' || (o_orderkey % 9 + 1) AS sup FROM orders),
p AS (SELECT *, 16 AS a, 16 + LENGTH(rep) + 9 AS b FROM t),
q AS (SELECT *, b + LENGTH(idc) + 6 AS c FROM p), r AS (SELECT *, c + LENGTH(usc) + 5 AS e FROM q), s AS (SELECT *, e + LENGTH(cfr) + 1 AS f FROM r)
SELECT o_orderkey, k.ordinal, k."start", k."start" + LENGTH(k.text) AS "end", k.kind, k.text FROM (SELECT o_orderkey, UNNEST([
  {'ordinal': 0, 'start': a, 'kind': 'reporter', 'text': rep}, {'ordinal': 1, 'start': b, 'kind': 'id', 'text': idc}, {'ordinal': 2, 'start': c, 'kind': 'usc', 'text': usc},
  {'ordinal': 3, 'start': e, 'kind': 'cfr', 'text': cfr}, {'ordinal': 4, 'start': f, 'kind': 'constitutional', 'text': 'U.S. Const. amend. XIV'}, {'ordinal': 5, 'start': f + 31, 'kind': 'supra', 'text': sup}]) AS k FROM s)
""")
def cite_extract(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each brief with their places."""
    return spans.extract(briefs(spark, d), "o_orderkey", "text")


@query(r"""
WITH c AS (SELECT o_orderkey, UNNEST([{'ordinal': 1, 'x': o_orderkey % 40 + 1, 'y': o_orderkey % 70 + 1}, {'ordinal': 3, 'x': 0, 'y': 0}]) AS k FROM orders)
SELECT o_orderkey, k.ordinal, 'dash-range' AS rule_id, 'non_conforming' AS severity, 'form_components' AS category FROM c WHERE k.ordinal = 1
UNION ALL SELECT o_orderkey, 3, 'cfr-periods', 'non_conforming', 'abbreviations' FROM c WHERE k.ordinal = 3
UNION ALL SELECT o_orderkey, 3, 'section-mark', 'non_conforming', 'form_components' FROM c WHERE k.ordinal = 3
""")
def rule_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of the rules in ``rules.RULES`` on all citations; the README names those not built."""
    return rules.flags(spans.extract(briefs(spark, d), "o_orderkey", "text")).select("o_orderkey", "ordinal", "rule_id", "severity", "category")


def reviews(spark: SparkSession, d: str):
    """Comments and an answer key."""
    comments = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("anchor "), F.lpad(F.col("c_nationkey").cast("string"), 3, "0")).alias("anchor"), F.col("c_mktsegment").alias("body"))
    key = table(spark, d, "nation").select(F.col("n_nationkey").alias("error_id"), F.array(F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("anchors"), F.lit("10.9").alias("rule"), F.array(F.when(F.col("n_nationkey") % 2 == 0, "Building").otherwise("Machinery")).alias("keywords"))
    return comments, key


@query("""
WITH c AS (SELECT c_custkey, c_nationkey AS k, c_mktsegment AS body FROM customer),
e AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'building' ELSE 'machinery' END AS word FROM nation),
h AS (SELECT c.c_custkey, e.k FROM c JOIN e USING (k) WHERE CONTAINS(LOWER(body), word))
SELECT (SELECT COUNT(*) FROM c) AS comments, COUNT(DISTINCT k) AS real_catches, COUNT(*) - COUNT(DISTINCT k) AS duplicates, (SELECT COUNT(*) FROM c) - COUNT(*) AS false_positives, 0 AS on_control,
  (SELECT COUNT(*) FROM e) - COUNT(DISTINCT k) AS misses, (SELECT COUNT(*) FROM e) AS planted, ROUND(COUNT(DISTINCT k) / (SELECT COUNT(*) FROM c), 3) AS "precision", ROUND(COUNT(DISTINCT k) / (SELECT COUNT(*) FROM e), 3) AS recall
FROM h
""")
def agg_grade_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """As the reference's grader: each error takes one comment, others that match are duplicates."""
    comments, key = reviews(spark, d)
    return grading.grade_one_to_one(comments, "c_custkey", key)


def filings(spark: SparkSession, d: str) -> DataFrame:
    """A line of official sources for each order."""
    k = lambda n: (F.col("o_orderkey") % n + 1).cast("string")
    parts = ["See H.R. Rep. No. ", k(110), "-", k(900), ", at ", k(30), " (1999). S. ", k(5000), ", 110th Cong. (2008). ", k(150), " Cong. Rec. ", k(7000), ". ", k(90), " Fed. Reg. ", k(90000), " (2001)."]
    return table(spark, d, "orders").select("o_orderkey", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


FILINGS_SQL = """
WITH k AS (SELECT o_orderkey AS o, 'H.R. Rep. No. ' || (o % 110 + 1) || '-' || (o % 900 + 1) || ', at ' || (o % 30 + 1) || ' (1999)' AS a, 'S. ' || (o % 5000 + 1) || ', 110th Cong. (2008)' AS b,
  (o % 150 + 1) || ' Cong. Rec. ' || (o % 7000 + 1) AS c, (o % 90 + 1) || ' Fed. Reg. ' || (o % 90000 + 1) || ' (2001)' AS e FROM orders),
s AS (SELECT o, UNNEST([{'n': 0, 'kind': 'legislative_report', 'text': a, 'at': 4}, {'n': 1, 'kind': 'bill', 'text': b, 'at': 6 + LENGTH(a)}, {'n': 2, 'kind': 'cong_rec', 'text': c, 'at': 8 + LENGTH(a) + LENGTH(b)},
  {'n': 3, 'kind': 'fed_reg', 'text': e, 'at': 10 + LENGTH(a) + LENGTH(b) + LENGTH(c)}]) AS x FROM k)
"""


@query(FILINGS_SQL + 'SELECT o AS o_orderkey, x.n AS ordinal, x.at AS "start", x.at + LENGTH(x.text) AS "end", x.kind, x.text FROM s')
def cite_official(spark: SparkSession, d: str) -> DataFrame:
    """Official sources of each filing."""
    return citations.extract(filings(spark, d), "o_orderkey", "text", "official")


@query(r"""
WITH k AS (SELECT o_orderkey, o_orderkey % 7000 + 1 AS c, o_orderkey % 90000 + 1 AS e, (o_orderkey % 150 + 1) || ' Cong. Rec. ' AS cl, (o_orderkey % 90 + 1) || ' Fed. Reg. ' AS el FROM orders)
SELECT o_orderkey, 2 AS ordinal, 'record-comma' AS rule_id, cl || FORMAT('{:,}', c) AS suggested_fix FROM k WHERE c >= 1000
UNION ALL SELECT o_orderkey, 3, 'register-comma', el || FORMAT('{:,}', e) || ' (2001)' FROM k WHERE e >= 1000
""")
def rule_official_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of official sources with the text as it should be."""
    return rules.flags(citations.extract(filings(spark, d), "o_orderkey", "text", "official")).select("o_orderkey", "ordinal", "rule_id", "suggested_fix")


def reports_from_abroad(spark: SparkSession, d: str) -> DataFrame:
    """A line of foreign sources for each order; every other one tells the jurisdiction."""
    k = lambda n: (F.col("o_orderkey") % n + 1).cast("string")
    tag = F.when(F.col("o_orderkey") % 2 == 0, " (Eng.)").otherwise("")
    parts = ["Smith v. Jones [1990] 2 AC ", k(900), " (HL)", tag, ". Corfu Channel (U.K. v. Alb.), 1949 I.C.J. ", k(300), " (Apr. 9). Soering v. Italy, App. No. ", k(40), "/88, 161 Eur. Ct. H.R. ", k(500), "."]
    return table(spark, d, "orders").select("o_orderkey", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


@query("""
WITH k AS (SELECT o_orderkey, 'Smith v. Jones [1990] 2 AC ' || (o_orderkey % 900 + 1) || ' (HL)' || CASE WHEN o_orderkey % 2 = 0 THEN ' (Eng.)' ELSE '' END AS a, 'Corfu Channel (U.K. v. Alb.), 1949 I.C.J. ' || (o_orderkey % 300 + 1) || ' (Apr. 9)' AS b,
  'Soering v. Italy, App. No. ' || (o_orderkey % 40 + 1) || '/88, 161 Eur. Ct. H.R. ' || (o_orderkey % 500 + 1) AS c FROM orders)
SELECT o_orderkey, x.kind, x.text, x.at AS "start", x.flag AS rule_id FROM (SELECT o_orderkey, UNNEST([{'kind': 'foreign_case_uk', 'text': a, 'at': 0, 'flag': CASE WHEN o_orderkey % 2 = 1 THEN 'uk-jurisdiction' END},
  {'kind': 'icj_case', 'text': b, 'at': LENGTH(a) + 2, 'flag': NULL}, {'kind': 'echr_case', 'text': c, 'at': LENGTH(a) + LENGTH(b) + 4, 'flag': NULL}]) AS x FROM k)
""")
def cite_foreign(spark: SparkSession, d: str) -> DataFrame:
    """Foreign sources with the rule that each breaks."""
    found = citations.extract(reports_from_abroad(spark, d), "o_orderkey", "text", "foreign")
    return rules.marked(found).select("o_orderkey", "kind", "text", "start", "rule_id")


def notes(spark: SparkSession, d: str) -> DataFrame:
    """A line of secondary sources for each order; every other article lacks its volume."""
    k = lambda n: (F.col("o_orderkey") % n + 1).cast("string")
    volume = F.when(F.col("o_orderkey") % 2 == 0, F.concat(k(130), F.lit(" "))).otherwise("")
    parts = ["Jane Roe, Fair Use, ", volume, "Harv. L. Rev. ", k(900), " (1999). Acme Terms, http://acme.com (last visited May ", k(28), ", 2020). John Doe, Draft ", k(50), " (unpublished manuscript) (on file with author)."]
    return table(spark, d, "orders").select("o_orderkey", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


@query("""
WITH k AS (SELECT o_orderkey, 'Jane Roe, Fair Use, ' || CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 130 + 1) || ' ' ELSE '' END || 'Harv. L. Rev. ' || (o_orderkey % 900 + 1) || ' (1999)' AS a,
  'Acme Terms, http://acme.com (last visited May ' || (o_orderkey % 28 + 1) || ', 2020)' AS b, 'John Doe, Draft ' || (o_orderkey % 50 + 1) || ' (unpublished manuscript) (on file with author)' AS c FROM orders)
SELECT o_orderkey, x.kind, x.text, x.at AS "start", x.flag AS rule_id FROM (SELECT o_orderkey, UNNEST([{'kind': 'article', 'text': a, 'at': 0, 'flag': CASE WHEN o_orderkey % 2 = 1 THEN 'article-volume' END},
  {'kind': 'internet', 'text': b, 'at': LENGTH(a) + 2, 'flag': 'internet-https'}, {'kind': 'manuscript', 'text': c, 'at': LENGTH(a) + LENGTH(b) + 4, 'flag': NULL}]) AS x FROM k)
""")
def cite_secondary(spark: SparkSession, d: str) -> DataFrame:
    """Secondary sources with the rule that each breaks."""
    found = citations.extract(notes(spark, d), "o_orderkey", "text", "secondary")
    return rules.marked(found).select("o_orderkey", "kind", "text", "start", "rule_id")


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS c, l_partkey % 3 AS t, l_suppkey % 2 = 0 AS p, l_suppkey % 3 = 0 AS b, l_suppkey % 5 = 0 AS u FROM lineitem),
o AS (SELECT *, CASE WHEN c = 3 AND u THEN 'custom' WHEN b THEN 'base' END AS own FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN c < 2 THEN NULL WHEN t = 0 THEN CASE WHEN p AND own IS NOT NULL THEN 'replace' END WHEN t = 1 THEN CASE WHEN NOT p THEN NULL WHEN c = 2 THEN 'delete' WHEN u THEN 'replace' END WHEN own IS NOT NULL THEN 'insert' END AS action,
  CASE WHEN c < 2 THEN NULL WHEN t = 0 THEN CASE WHEN p THEN own END WHEN t = 1 THEN CASE WHEN NOT p THEN NULL WHEN c = 2 THEN '' WHEN u THEN 'custom' END ELSE own END AS suggested_text,
  CASE WHEN c < 2 THEN NULL WHEN t = 1 AND NOT p THEN 'addition_without_source' WHEN t = 2 AND NOT b AND c = 2 THEN 'deletion_without_base' END AS skipped FROM o
""")
def rel_compare_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What a reviewer's choices about compared passages come to."""
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    has = lambda k, word: F.when(F.col("l_suppkey") % k == 0, f"  {word}\n").otherwise(" ")
    diffs = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", pick(F.col("l_linenumber") % 4, [None, "accept_proposed", "keep_base", "custom"]).alias("user_choice"), pick(F.col("l_partkey") % 3, ["modification", "addition", "deletion"]).alias("change_type"),
        has(2, "proposed").alias("proposed_text"), has(3, "base").alias("base_text"), has(5, "custom").alias("user_custom_text"),
    )
    return merge.decisions(diffs).select("l_orderkey", "l_linenumber", "action", "suggested_text", "skipped")


@query("SELECT event_id, 3 AS n, 2 * (props->>'k')::BIGINT + 7 AS total FROM events")
def json_repaired(spark: SparkSession, d: str) -> DataFrame:
    """JSON that was cut off within its third element, of which the whole fields stay."""
    cut = F.concat(F.lit("Here it is:\n```json\n["), F.col("props"), F.lit(", "), F.col("props"), F.lit(', {"k": 7, "note": "a ] b'))
    found = F.from_json(text.repaired_json(cut), "array<struct<k: long>>")
    return table(spark, d, "events").select("event_id", F.size(found).alias("n"), F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["k"]).alias("total"))


@query("""
SELECT o_orderkey, '# Order ' || o_orderkey || CHR(10) || CHR(10) || 'By **' || o_custkey || '** & co' || CHR(10) || CHR(10) || '1. first' || CHR(10) || '2. ' || o_orderstatus || CHR(10) || CHR(10) || '| a | b |' || CHR(10) || '| --- | --- |' || CHR(10) || '| ' || o_orderpriority || ' | ' || o_orderstatus || ' |' || CHR(10) || CHR(10) || '- [image]' AS text FROM orders
""")
def txt_html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Markdown of a page composed of headings, emphasis, lists and a table."""
    c = lambda name: F.col(name).cast("string")
    parts = ["<h1 id='x'>Order <i></i>", c("o_orderkey"), "</h1><p>By <b>", c("o_custkey"), "</b> &amp; co</p><ol><li> first</li><LI>", c("o_orderstatus"), "</LI></ol><table><tr><th>a</th><th>b</th></tr><tr><td>", c("o_orderpriority"), "</td><td>", c("o_orderstatus"), "</td></tr></table><ul><li><img src='y'></li></ul>"]
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return spread(rows, "o_orderkey").select("o_orderkey", text.html_to_markdown(html).alias("text"))


#: Line numbers repeat in an order; with these columns they do not.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""
WITH o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
g AS (SELECT l_orderkey, n, l_returnflag || l_linenumber AS t, LAG(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY n) - l_quantity AS gap FROM o),
m AS (SELECT l_orderkey, LIST_SORT(LIST(gap))[COUNT(*) // 2 + 1] AS m FROM g WHERE gap > 0 GROUP BY 1),
b AS (SELECT g.*, gap > GREATEST(COALESCE(m, 14.0::DOUBLE) * 1.3::DOUBLE, COALESCE(m, 14.0::DOUBLE) + 4) OR gap < -COALESCE(m, 14.0::DOUBLE) * 0.5::DOUBLE AS brk FROM g LEFT JOIN m USING (l_orderkey)),
p AS (SELECT *, SUM(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n)::BIGINT AS paragraph FROM b)
SELECT l_orderkey, paragraph, STRING_AGG(t, ' ' ORDER BY n) AS content FROM p GROUP BY 1, 2
""")
def win_gap_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of pages by the gaps between their lines."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("t"))
    return layout.paragraphs(lines, "l_orderkey", LINE_ORDER, "l_quantity", "t")


@query("""
WITH o AS (SELECT l_orderkey, l_returnflag || l_linenumber AS t, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS n FROM lineitem)
SELECT l_orderkey, (n // 2)::INT AS line, (700 - 20 * (n // 2))::DOUBLE AS y, STRING_AGG(t, ' ' ORDER BY n) AS content FROM o GROUP BY l_orderkey, n // 2
""")
def win_stacked_lines(spark: SparkSession, d: str) -> DataFrame:
    """Items of pages stacked into lines by their heights: two a line, the second a little lower."""
    items = table(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1)
    items = items.select("l_orderkey", "n", (700 - 20 * F.floor(F.col("n") / 2) - 3 * (F.col("n") % 2)).alias("y"), F.lit(12.0).alias("height"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("t"), F.lit(False).alias("eol"))
    return layout.stacked(items, "l_orderkey", ["n"], "y", "height", "t", "eol")


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS n, COALESCE(SUM(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y, l_orderkey % 20 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, GREATEST(x, y) - y AS "from", LEAST(x + 40, y + n) - y AS "to" FROM a WHERE LEAST(x + 40, y + n) > GREATEST(x, y)
""")
def win_node_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A range of each document's text over the nodes that hold it."""
    x = F.col("l_orderkey") % 20
    return layout.node_ranges(table(spark, d, "lineitem"), "l_orderkey", LINE_ORDER, F.col("l_quantity").cast("long"), x, x + 40).select("l_orderkey", "l_linenumber", "from", "to")


@query("""
SELECT day_group, COUNT(*) AS n FROM (SELECT CASE WHEN ts::DATE = DATE '2024-01-31' THEN 'Today' WHEN ts::DATE = DATE '2024-01-30' THEN 'Yesterday' WHEN ts > TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 7 DAY THEN 'Last week' ELSE 'Older' END AS day_group FROM events) GROUP BY 1
""")
def agg_day_groups(spark: SparkSession, d: str) -> DataFrame:
    """Entries by day, as a list shows them."""
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    return table(spark, d, "events").groupBy(listing.day_group(F.col("ts"), now).alias("day_group")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, COUNT(*) FILTER (k IN (0, 1)) AS added, COUNT(*) FILTER (k IN (0, 2)) AS removed FROM (SELECT l_orderkey, l_partkey % 3 AS k FROM lineitem) GROUP BY 1
""")
def agg_diff_stats(spark: SparkSession, d: str) -> DataFrame:
    """What a comparison added and removed: a modification counts as both."""
    change = F.element_at(F.array(*map(F.lit, ["modification", "addition", "deletion"])), (F.col("l_partkey") % 3 + 1).cast("int"))
    both = table(spark, d, "lineitem").select("l_orderkey", change.alias("change_type"))
    return both.groupBy("l_orderkey").agg(F.count_if(F.col("change_type").isin("addition", "modification")).alias("added"), F.count_if(F.col("change_type").isin("deletion", "modification")).alias("removed"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber - 1 AS i, l_returnflag AS content, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE '"' || l_linestatus || '"' || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE ' (p. ' || (l_suppkey % 3) || ')' END END AS s FROM lineitem)
SELECT l_orderkey, COALESCE(MAX(content) FILTER (i = 0), '') AS c0, COALESCE(MAX(content) FILTER (i = 1), '') AS c1, COALESCE(MAX(s) FILTER (i = 0), '') AS c0_source, COALESCE(MAX(s) FILTER (i = 1), '') AS c1_source FROM c GROUP BY 1
""")
def agg_review_table(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a review, a row a document and two columns a question."""
    cite = F.struct(F.col("l_linestatus").alias("quote"), (F.col("l_suppkey") % 3).alias("page"))
    cells = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("i"), F.col("l_returnflag").alias("content"), F.when(F.col("l_partkey") % 2 == 1, F.array(cite)).otherwise(F.array().cast("array<struct<quote:string,page:bigint>>")).alias("citations"))
    return relations.review_table(cells, "l_orderkey", "i", [0, 1])


@query("""
WITH b AS (SELECT o_custkey AS k, o_orderkey, o_orderdate, (o_orderkey % 3)::INT AS s FROM orders),
j AS (SELECT k, b.o_orderkey, s, s = 0 AND (c_nationkey = 0 OR o_orderdate > TIMESTAMP '1996-01-01') AS e, s = 2 AS p FROM b JOIN customer ON c_custkey = k),
a AS (SELECT k, COUNT(*) FILTER (e) AS e, COUNT(*) FILTER (p) AS p, MIN(o_orderkey) FILTER (e) AS et, MIN(o_orderkey) FILTER (p) AS pt FROM j GROUP BY 1)
SELECT c_custkey, CASE WHEN e > 0 THEN 'enacted' WHEN p > 0 THEN 'pending' ELSE 'clean' END AS classification, CASE WHEN e > 0 THEN e WHEN p > 0 THEN p ELSE 0 END AS bills, CASE WHEN e > 0 THEN et WHEN p > 0 THEN pt END AS top_bill
FROM customer LEFT JOIN a ON k = c_custkey
""")
def agg_amendment_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether bills have changed a text since it was fetched."""
    action = F.element_at(F.array(*map(F.lit, ["Signed by Governor", "Died in committee", "Referred to committee"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    bills = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", legal.bill_status(action).alias("state"))
    statutes = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") != 0, F.lit("1996-01-01").cast("timestamp")).alias("fetched_at"))
    return relations.amendment_status(statutes, "c_custkey", "fetched_at", bills, ["o_orderkey"], "o_orderkey", "o_orderdate", "state").drop("fetched_at")


@query("SELECT o_orderkey, [true, false, true, false, false][(o_orderkey % 5)::INT + 1] AS authority FROM orders")
def txt_authorities(spark: SparkSession, d: str) -> DataFrame:
    """Addresses on hosts of authority."""
    urls = ["https://www.Law.Cornell.edu/x?y=1", "https://notoyez.org/a", "http://leg.ca.gov", "nothing", "https://a.gov.example.com/"]
    url = F.element_at(F.array(*map(F.lit, urls)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", legal.authoritative(url).alias("authority"))


@query("SELECT o_orderkey, [o_orderkey, o_custkey] AS ids FROM orders")
def json_numbered_values(spark: SparkSession, d: str) -> DataFrame:
    """An object with numbers for keys as an array in their order."""
    found = F.concat(F.lit('{"10": {"id": '), F.col("o_custkey").cast("string"), F.lit('}, "summary": {"id": 0}, "9": {"id": '), F.col("o_orderkey").cast("string"), F.lit('}, "11": null}'))
    values = text.numbered_values(F.from_json(found, "map<string, struct<id: bigint>>"))
    return table(spark, d, "orders").select("o_orderkey", F.transform(values, lambda x: x["id"]).alias("ids"))


@query("""
SELECT o_orderkey, [NULL, 'see', 'Accord', 'With', NULL, 'but see'][k] AS signal, [NULL, 'See', 'accord', 'with', NULL, 'But see'][k] AS expected FROM (SELECT o_orderkey, (o_orderkey % 6)::INT + 1 AS k FROM orders) WHERE k IN (2, 3, 4, 6)
""")
def rule_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals in the wrong case."""
    before = F.element_at(F.array(*map(F.lit, ["It held so. See also ", "It held so. see ", "Roe; Accord ", "Compare Roe, With ", "as they see ", " but see  "])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return rules.signal_flags(table(spark, d, "orders").select("o_orderkey", before.alias("pre")), "pre").drop("pre")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Customer shall pay all fees ' || o_orderkey WHEN 1 THEN 'Supplier ' || o_orderkey || ' may engage others' END AS quoted FROM orders
""")
def txt_quoted_sections(spark: SparkSession, d: str) -> DataFrame:
    """The contract's words out of findings that name a section first."""
    k = F.col("o_orderkey")
    n = k.cast("string")
    said = F.when(k % 4 == 0, F.concat(F.lit(' Section 4.2 FEES: "Customer shall pay all fees '), n, F.lit('" (as amended)')))
    said = said.when(k % 4 == 1, F.concat(F.lit("Section 9.1(b): Supplier "), n, F.lit(" may engage others; AND Section 8.6: more"))).when(k % 4 == 2, F.lit("Section 1: short"))
    return table(spark, d, "orders").select("o_orderkey", messages.quoted_section(said.otherwise(n)).alias("quoted"))


@query("""
WITH t AS (SELECT o_orderkey AS k, 'Fla. Stat. § 768.' || (o_orderkey % 90 + 10) AS a, (o_orderkey % 40 + 1) || ' U.S.C. § ' || (o_orderkey % 900 + 1) AS b,
  'Roe v. Wade, ' || (o_orderkey % 500 + 1) || ' U.S. ' || (o_orderkey % 900 + 1) || ' (1973)' AS c, 'https://law.example.gov/a/' || o_orderkey AS u FROM orders),
p AS (SELECT k, UNNEST([{'kind': 'statute', 'start': 4, 'text': a}, {'kind': 'statute', 'start': 4 + LENGTH(a) + 5, 'text': b}, {'kind': 'case', 'start': 4 + LENGTH(a) + 5 + LENGTH(b) + 2, 'text': c},
  {'kind': 'url', 'start': 4 + LENGTH(a) + 5 + LENGTH(b) + 2 + LENGTH(c) + 2, 'text': u}]) AS x FROM t)
SELECT k AS o_orderkey, x.kind AS kind, x."start" AS "start", x."start" + LENGTH(x.text) AS "end", x.text AS text FROM p
""")
def cite_messages(spark: SparkSession, d: str) -> DataFrame:
    """Citations and links of chat messages."""
    n = lambda k, plus=1: (F.col("o_orderkey") % k + plus).cast("string")
    said = F.concat(F.lit("see Fla. Stat. § 768."), n(90, 10), F.lit(" and "), n(40), F.lit(" U.S.C. § "), n(900), F.lit("; Roe v. Wade, "), n(500), F.lit(" U.S. "), n(900), F.lit(" (1973): https://law.example.gov/a/"), F.col("o_orderkey").cast("string"), F.lit(")."))
    return messages.message_citations(table(spark, d, "orders").select("o_orderkey", said.alias("text")), "o_orderkey", "text").drop("ordinal")


NESTED_SQL = "REGEXP_EXTRACT(html, '(?is)<article[^>]*>(.*?)</article>', 1)"


@query(rf"""
SELECT page_id, LENGTH(text) AS n_chars, MD5(REGEXP_REPLACE(text, '\s+', ' ', 'g')) AS words FROM (SELECT page_id, {html_sql("CASE WHEN CONTAINS(html, '<article') THEN " + NESTED_SQL + " ELSE html END")} AS text FROM pages)
""")
def txt_source_pages(spark: SparkSession, d: str) -> DataFrame:
    """Texts of pages by their source: the part is wrapped in elements of its own kind, and a footer follows."""
    inner = F.regexp_replace("html", r"(?is)<article[^>]*>(.*?)</article>", r'<div class="x"><div id="codes-content"><div>$1</div></div> Disclaimer: Justia is not liable.<div></div></div>')
    k = F.col("page_id") % 3
    page = F.when(k == 0, inner).when(k == 1, F.regexp_replace("html", "(?i)<(/?)article[^>]*>", "<$1main>")).otherwise(F.col("html"))
    source = F.when(k == 0, "justia").when(k == 1, "cornell").otherwise("state")
    text_ = markup.source_texts(page, source)
    return table(spark, d, "pages").select("page_id", text_.alias("text")).select("page_id", F.length("text").alias("n_chars"), F.md5(F.regexp_replace("text", r"\s+", " ").cast("binary")).alias("words"))
