"""Issues of whole documents outside their citations: ellipses, capitals, ranges of paragraphs, short block quotes, short names that nothing declares."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .sentences import compiled

#: Ranges with a hyphen in one document from which on the first stands for all.
MANY_RANGES = 5
#: Patterns of issues. Words have at most 81 characters, so that no text takes quadratic time.
WORD = r"[A-Za-z][A-Za-z0-9_'\-]{0,80}"
ISSUES = {
    "ellipsis": rf"\b{WORD}\.\.\.{WORD}\b",
    "ellipsis-sign": rf"{WORD}…{WORD}|…",
    "capital-constitution": r"\bthe\s+constitution\b",
    "capital-congress": r"\bcongress\b",
    "capital-bill-of-rights": r"\bthe\s+bill\s+of\s+rights\b",
    "capital-court-of-appeals": r"(?<!United\s)(?<!States\s)\b[Tt]he\s+Court\s+of\s+Appeals\b",
}
RANGE = compiled(r"¶{1,2}\s*\d{1,5}[-—]\d{1,5}\b")
NAMES = {
    "declared": r"(?i)\[\s*hereinafter\s+[^\]]{1,80}\s*\]",
    "full": r"\b[A-Z][a-z]{1,80}\s+(?:[A-Z][a-z]{1,80}\s+){0,4}Act\s+of\s+\d{4}\b",
    "short": r"\bThe\s+[A-Z][a-z]{1,80}(?:\s+[A-Z][a-z]{1,80}){0,3}\s+Act\b(?!\s+of\s+\d{4})",
}
PARAGRAPH = compiled(r"[^\n]+(?:\n[^\n]+)*")
#: What an indented paragraph is instead of a quotation, whatever its length or below eight words, and a citation behind one.
NO_QUOTE = compiled(r"""[IVX]+\.\s|[A-Z][A-Z][A-Z\s,&'.-]+\Z|/s/|(?i:Respectfully\b|By:|Hon\.|Case\s+No\.)|\d+[.)]\s|["“]""")
LETTERED = compiled(r"[A-Za-z]\.\s")
CITED = compiled(r"[A-Z][A-Za-z'.\-]+,?\s+\d+\s+[A-Z][A-Za-z.\d\s]+?\s(?:at\s+)?\d")


def quoted(own: str) -> bool:
    """An indented paragraph of 5 to 49 words that is no heading, list, signature or quotation in marks."""
    bare, words = own.strip(), len(own.split(None, 50))
    other = NO_QUOTE.match(bare) or (words < 8 and LETTERED.match(bare))
    return bool(re.match(r"[\t ]{4,}\S", own)) and 5 <= words < 50 and not other


def find_block_quotes(text: str) -> list[tuple]:
    """Quotations set off behind a colon or before a citation: start, end, kind, text."""
    whole = [m for m in PARAGRAPH.finditer(text) if m[0].strip()]
    colon = [False, *(m[0].rstrip().endswith(":") for m in whole)]
    cite = [*(bool(CITED.match(m[0].strip())) for m in whole[1:]), False]
    set_off = [m for m, led, cited in zip(whole, colon, cite) if (led or cited) and quoted(m[0])]
    return [(m.end() - len(m[0].lstrip()), m.end(), "block-quote", m[0].strip()) for m in set_off]


def block_quotes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spans.extract_by(df, id_col, text_col, find_block_quotes)


def find_ranges(text: str) -> list[tuple]:
    """Ranges of paragraphs: start, end, how many ranges the row stands for, text.

    Of ``MANY_RANGES`` or more with a hyphen only the first is given, for all of them.
    """
    found = list(RANGE.finditer(text)) if "¶" in text else []
    hyphens = [m for m in found if "-" in m[0]]
    many = len(hyphens) >= MANY_RANGES
    left = [m for m in found if not many or m is hyphens[0] or "-" not in m[0]]
    return [(m.start(), m.end(), str(len(hyphens) if many and m is hyphens[0] else 1), m[0]) for m in left]


def dealt(found: DataFrame, id_col: str) -> DataFrame:
    """Spans by document, in as many tasks as a shuffle has partitions, or the extraction had if that is more.

    Left to itself, Spark joins partitions up to so many packed bytes, which short spans that repeat
    far exceed once they are sorted in memory.
    """
    least = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(max(least, found.rdd.getNumPartitions()), id_col)


def undeclared_names(found: DataFrame, doc: str) -> DataFrame:
    """Of spans of the kinds in ``NAMES``, short names of one or two words that no [hereinafter …] of their document declares, where an act is cited in full."""
    name = F.trim(F.regexp_extract("text", r"(?i)hereinafter\s+([^\]]{1,80})", 1))
    acts = found.withColumn("_name", F.when(F.col("kind") == "declared", name).otherwise(F.regexp_extract("text", r"^The\s+(.*)\s+Act$", 1)))
    acts = acts.withColumn("_first", F.split(F.trim(F.regexp_replace("_name", r"\s+Act\b.*$", "")), r"\s+")[0])
    whole = Window.partitionBy(doc)
    is_declared = F.col("kind") == "declared"
    acts = acts.withColumn("_firsts", F.collect_set(F.when(is_declared, F.col("_first"))).over(whole)).withColumn("_names", F.collect_set(F.when(is_declared, F.col("_name"))).over(whole))
    acts = acts.withColumn("_full", F.max((F.col("kind") == "full").cast("int")).over(whole))
    known = F.array_contains("_firsts", F.col("_first")) | F.array_contains("_names", F.regexp_replace("text", r"\s+", " "))
    short = (F.col("kind") == "short") & (F.size(F.split("_name", r"\s+")) < 3) & (F.col("_full") == 1) & ~known
    return acts.filter(short).drop("_name", "_first", "_firsts", "_names", "_full")


def issues(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, rule_id, start, end, text, count and suggested_fix of each issue; null and empty texts have none.

    A document with ``MANY_RANGES`` or more ranges of paragraphs that have a hyphen gets one row for
    them, at the first, with their number as count and no fix; count is 1 elsewhere. Only spans are
    shuffled, never texts, and of these only ranges and names, as the others need no other row. Rows
    with the same id are one document.
    """
    ranges = spans.extract_by(df, id_col, text_col, find_ranges).withColumn("_hyphen", F.contains("text", F.lit("-")))
    own = Window.partitionBy(id_col, "_hyphen").orderBy("start", "ordinal", "text")  # one sort for both
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = dealt(ranges, id_col).withColumn("_all", F.sum(F.col("kind").cast("long")).over(whole)).withColumn("_nth", F.row_number().over(own))
    many = F.col("_hyphen") & (F.col("_all") >= MANY_RANGES)
    ranges = ranges.filter(~many | (F.col("_nth") == 1)).withColumn("count", F.when(many, F.col("_all")).otherwise(F.lit(1).cast("long")))
    fixed = F.when(F.col("count") == 1, F.regexp_replace("text", "[-—]", "–"))
    ranges = ranges.withColumn("kind", F.lit("paragraph-range")).withColumn("suggested_fix", fixed)
    patterns = spans.finder(ISSUES)
    found = spans.extract_by(df, id_col, text_col, lambda text: patterns(text) + find_block_quotes(text)).withColumn("count", F.lit(1).cast("long"))
    kind, text = F.col("kind"), F.col("text")
    fix = (
        F.when(kind == "ellipsis", F.regexp_replace(text, r"(?s)\A(.*?\w)\.\.\.(?=\w)", "$1 . . . "))
        .when(kind == "ellipsis-sign", F.regexp_replace(text, "…", " . . . "))
        .when(kind == "capital-constitution", F.regexp_replace(text, "constitution", "Constitution"))
        .when(kind == "capital-congress", F.lit("Congress"))
        .when(kind == "capital-bill-of-rights", F.lit("the Bill of Rights"))
        .when(kind == "capital-court-of-appeals", F.regexp_replace(text, r"Court\s+of\s+Appeals", "court of appeals"))
    )
    plain = found.withColumn("suggested_fix", fix)
    names = undeclared_names(dealt(spans.extract(df, id_col, text_col, NAMES), id_col), id_col).withColumn("kind", F.lit("undeclared-name"))
    names = names.withColumn("count", F.lit(1).cast("long")).withColumn("suggested_fix", F.lit(None).cast("string"))
    columns = [F.col(id_col), F.col("kind").alias("rule_id"), "start", "end", "text", "count", "suggested_fix"]
    return plain.select(*columns).unionByName(ranges.select(*columns)).unionByName(names.select(*columns))
