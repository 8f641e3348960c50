"""Quantities in clauses, directional rules, and classifiers by pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns and weights that tell a ruling from other docket entries.
DOCKET_WEIGHTS = [
    (r"\b(rule\s*11|rule\s*37|sanction(?:s|ed|ing)?)\b", 8),
    (r"\bshow\s+cause\b", 7),
    (r"\b(memorandum|opinion\s+and\s+order|memorandum\s+opinion)\b", 5),
    (r"\b(order|ruling|judgment|decision|findings|opinion)\b", 2),
    (r"\b(report\s+and\s+recommendation|r\s*&\s*r)\b", 3),
    (r"\b(grievance|disciplin|bar\s+referral|attorney(?:\s+is)?\s+referred)\b", 5),
    (r"\b(strike|stricken|frivolous|fabricated|hallucinat)\b", 4),
    (r"\bnotice\s+of\s+appearance\b", -10),
    (r"\bcase\s+assigned\b", -10),
    (r"\bclerk('s)?\s+(notice|judgment|certificate)\b", -8),
    (r"\bsummons\b", -8),
    (r"\bcorporate\s+disclosure\b", -8),
    (r"\bcivil\s+cover\s+sheet\b", -8),
    (r"\baffidavit\b", -3),
    (r"\bin\s+forma\s+pauperis\b", -3),
    (r"\bmotion\s+(to|for)\b", -3),
    (r"\bcomplaint\b", -4),
    (r"\b(stipulation|consent)\b", -4),
    (r"\b(scheduling\s+order|status\s+conference)\b", -4),
    (r"\bmandate\b", -2),
]
#: Patterns of courts, bills and roles.
FEDERAL = r"^(D\.|S\.D\.|N\.D\.|E\.D\.|W\.D\.|M\.D\.|C\.D\.|D\.D\.|U\.S\.|USDC)\s|\b(Cir\.|Circuit|BAP|JPML|ASBCA|GAO|Tax Court|Bankr|Bankruptcy|U\.S\.D\.C|J\.P\.M\.L)\b"
STATE = r"\b(state|county|tex\.\s*app|ca\s+\w+|ac\s+\w+|sc\s+\w+|sct|ct\.?\s*app|app\.\s*ct|cmwlth|commonwealth|superior|family|probate|traffic)\b"
ENACTED = r"\b(signed by (?:the )?(?:governor|president)|approved by (?:the )?(?:governor|president)|became (?:public )?law|public law|public act|act no\.?|chaptered|enacted into law|effective\s+(?:date\s+)?\d)"
FAILED = r"\b(veto(?:ed)?|failed|defeated|died(?:\s+in)?|withdrawn|recalled|indefinitely postponed|adjourned sine die)\b"
PROVIDER = "provider|vendor|licensor|supplier|consultant|contractor|subcontractor|processor"
CUSTOMER = "customer|buyer|licensee|client|controller"
#: Rule, words of its categories, kinds of quantity it compares, whether a favourable edit passes.
DIRECTIONS = [
    ("commercial-net-term-direction", ["commercial", "payment", "net_payment_terms", "invoicing"], ["days"], True),
    ("risk-liability-cap-direction", ["risk_allocation", "liability_cap", "limitation_of_liability"], ["dollars", "months", "years"], False),
    ("insurance-limit-direction", ["insurance", "coverage"], ["dollars"], False),
    ("performance-sla-threshold-direction", ["performance", "sla", "uptime"], ["percent"], False),
]


#: Hosts whose texts count as authority.
AUTHORITIES = r"(?i)(?:\.gov|(?:^|\.)(?:courtlistener\.com|law\.justia\.com|law\.cornell\.edu|supremecourt\.gov|congress\.gov|legiscan\.com|oyez\.org))$"


def authoritative(url: Column) -> Column:
    """Whether an address is on a host of authority; false where it has no host."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).rlike(AUTHORITIES), F.lit(False))


def docket_score(description: Column, snippet: Column) -> Column:
    """Sum of the weights of all patterns that occur."""
    blob = F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(snippet, F.lit("")))
    return reduce(lambda a, x: a + F.when(blob.rlike(f"(?i){x[0]}"), x[1]).otherwise(0), DOCKET_WEIGHTS, F.lit(0))


def court_kind(court: Column) -> Column:
    return F.when(court.rlike(f"(?i){FEDERAL}"), "federal").when(court.rlike(f"(?i){STATE}"), "state").otherwise("unknown")


def bill_status(action: Column) -> Column:
    return F.when(action.rlike(f"(?i){ENACTED}"), "enacted").when(action.rlike(f"(?i){FAILED}"), "failed").otherwise("pending")


def side(role: Column) -> Column:
    return F.when(F.lower(role).rlike(PROVIDER), "provider_side").when(F.lower(role).rlike(CUSTOMER), "customer_side").otherwise("unknown")


#: How clauses write quantities, in falling priority of their kinds. White space includes the no-break space.
GAP = r"[\s\x{A0}\x{202F}]"
COUNT = rf"(?:\d+|\w+{GAP}*\(\d+\))"
QUANTITIES = [
    ("dollars", rf"\${GAP}*\d[\d,]*(?:\.\d+)?{GAP}*(?:million|m|billion|b)?"),
    ("net", rf"\bnet(?:{GAP}|-)+\d+\b"),
    ("days", rf"\b{COUNT}{GAP}+(?:(?:calendar|business){GAP}+)?days?\b"),
    ("months", rf"\b{COUNT}{GAP}+months?\b"),
    ("years", rf"\b{COUNT}{GAP}+(?:calendar{GAP}+)?years?\b"),
    ("percent", rf"\d+(?:\.\d+)?{GAP}*%"),
]
SCALES = {"million": 1e6, "m": 1e6, "billion": 1e9, "b": 1e9}


def quantity(text: Column) -> Column:
    """struct(value, kind) of the first kind found: dollars, days, months, years, percent; null if there is none.

    A text with a digit is searched once, for all kinds; what follows reads the short matches only.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit("|".join(f"({p})" for _, p in QUANTITIES)), F.lit(0))

    def told(m: Column) -> Column:
        number = F.regexp_extract(m, r"\d[\d,]*(?:\.\d+)?", 0)
        unit = F.regexp_extract(m, r"[a-z]*$", 0)
        scale = F.when(m.startswith("$"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), unit), F.lit(1.0))).otherwise(1.0)
        rank = F.when(m.startswith("$"), 0).when(m.startswith("net"), 1).when(m.endswith("%"), 5).when(unit.startswith("day"), 2).when(unit.startswith("month"), 3).otherwise(4)
        return F.struct(rank.alias("rank"), F.replace(number, F.lit(","), F.lit("")).try_cast("double").alias("n"), scale.alias("scale"))

    kinds = F.array(*map(F.lit, ["dollars", "days", "days", "months", "years", "percent"]))
    # The first match of the best rank: a lambda over one element names it once.
    best = F.transform(F.slice(F.array_sort(F.transform(found, lambda m, i: F.struct(told(m)["rank"].alias("rank"), i.alias("i"), m.alias("m")))), 1, 1), lambda x: F.struct((told(x["m"])["n"] * told(x["m"])["scale"]).alias("value"), F.get(kinds, x["rank"]).alias("kind")))
    return F.when(text.rlike("[0-9]"), F.get(best, F.lit(0)))


def with_direction(edits: DataFrame, category: str = "category", role: str = "role", source: str = "source_text", proposed: str = "proposed_text") -> DataFrame:
    """Add verdict and rule: whether an edit moves a number against the client's side.

    A larger number harms the provider, a smaller one the customer. The first rule with a verdict
    counts; without one (or with a null anywhere) the edit is ambiguous. Quantities are columns of
    their own, so that each text is searched once.
    """
    out = edits.withColumn("_who", side(F.col(role))).withColumn("_a", quantity(F.col(source))).withColumn("_b", quantity(F.col(proposed)))
    a, b, who = F.col("_a"), F.col("_b"), F.col("_who")
    out = out.withColumn("_harms", F.when(who == "provider_side", b["value"] > a["value"]).when(who == "customer_side", b["value"] < a["value"]))
    told = lambda verdict, rule: F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).cast("string").alias("rule"))
    verdicts = []
    for rule, words, kinds, passes in DIRECTIONS:
        applies = F.lower(category).rlike("|".join(words)) & (a["kind"] == b["kind"]) & a["kind"].isin(kinds)
        verdicts.append(F.when(applies & F.col("_harms"), told("fail", rule)).when(applies & ~F.col("_harms"), told("pass", rule) if passes else F.lit(None)))
    return out.withColumn("_v", F.coalesce(*verdicts, told("ambiguous", None))).select(*edits.columns, "_v.verdict", "_v.rule")
