"""Text functions as Column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Named entities that page texts use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&sect;": "§", "&mdash;": "—", "&ndash;": "–", "&amp;": "&"}
#: Words that tell nothing about a party.
JUNK = ["v", "vs", "in", "re", "the", "of", "et", "al", "a", "an", "and", "co", "inc", "llc", "lp", "ltd", "corp", "company"]
#: How identifiers are spelled out.
ACRONYMS = ["nda", "msa", "sow", "sla", "ip", "dpa", "us", "uk", "eu"]
JOINERS = ["of", "and", "or", "the", "in", "on", "for", "to", "with", "by", "a", "an"]


def strip_controls(text: Column) -> Column:
    """Without C0 controls (tab and line ends stay), DEL and replacement characters."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FFFD}]", "")


def looks_garbled(text: Column) -> Column:
    """Under 45 % Latin letters among what is no white space; false for texts too short to tell."""
    text = F.coalesce(text, F.lit(""))
    total = F.length(F.regexp_replace(text, r"[ \t\n\r]", ""))
    letters = F.regexp_count(text, F.lit("[A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{17F}]"))
    return (F.length(text) >= 80) & (total >= 60) & (letters * 100 < total * 45)


def code_point(n: Column) -> Column:
    """The character of a code point; U+FFFD for surrogates, zero and what is out of range."""
    valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(F.coalesce(valid, F.lit(False)), n).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Decimal and hexadecimal character references and the named ones of ENTITIES. Surrogate pairs written as two references are one character."""
    number = lambda x: F.coalesce(F.when(x.startswith("x") | x.startswith("X"), F.conv(F.substring(x, 2, 20), 16, 10)).otherwise(x).try_cast("long"), F.lit(0))
    reference = r"&#([0-9]{1,9}|[xX][0-9a-fA-F]{1,8});"
    high, low = r"(?:5529[6-9]|55[3-9]\d\d|56[0-2]\d\d|563[01]\d|[xX][dD][89abAB][0-9a-fA-F]{2})", r"(?:5632\d|563[3-9]\d|56[4-9]\d\d|57[0-2]\d\d|573[0-3]\d|5734[0-3]|[xX][dD][c-fC-F][0-9a-fA-F]{2})"
    pairs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"&#{high};&#{low};"), F.lit(0)))
    both = lambda p: F.transform(F.regexp_extract_all(p, F.lit(reference), F.lit(1)), number)
    joined = lambda p: F.aggregate(both(p), F.lit(0).cast("long"), lambda a, x: a * 1024 + F.when(x < 0xDC00, x - 0xD800).otherwise(x - 0xDC00)) + 0x10000
    out = F.aggregate(pairs, text, lambda a, p: F.replace(a, p, code_point(joined(p))))
    single = F.array_distinct(F.regexp_extract_all(out, F.lit(reference), F.lit(1)))
    out = F.aggregate(single, out, lambda a, x: F.replace(a, F.concat(F.lit("&#"), x, F.lit(";")), code_point(number(x))))
    out = F.when(text.contains("&#"), out).otherwise(text)
    return F.when(text.contains("&"), reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), out)).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Scripts, styles and tags go, block ends become line ends, entities are decoded, white space is evened out."""
    # The steps.
    steps = [
        (r"(?is)<script\b[^>]*>.*?</script\s*>", " "),
        (r"(?is)<style\b[^>]*>.*?</style\s*>", " "),
        (r"(?is)<noscript\b[^>]*>.*?</noscript\s*>", " "),
        (r"(?i)</(p|div|section|article|li|h[1-6]|tr|br)\s*>", "\n"),
        (r"(?i)<br\s*/?>", "\n"),
        (r"<[^>]+>", " "),
    ]
    tidy = [(r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")]
    apply = lambda t, pairs: reduce(lambda a, x: F.regexp_replace(a, *x), pairs, t)
    return F.btrim(apply(decode_entities(apply(html, steps)), tidy), F.lit(" \t\n"))


def main_part(html: Column) -> Column:
    """What stands in <main>, else in <article>, else all of it."""
    inside = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    return F.coalesce(inside("main"), inside("article"), html)


def slugify(text: Column, most: int = 60) -> Column:
    """Lower-case letters and digits with hyphens between, cut at a word's end; ``case`` if nothing is left."""
    whole = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.left(whole, F.lit(most))
    short = F.btrim(F.when(F.contains(cut, F.lit("-")), F.regexp_replace(cut, "-[^-]*$", "")).otherwise(cut), F.lit("-"))
    return F.coalesce(F.nullif(F.when(F.length(whole) > most, short).otherwise(whole), F.lit("")), F.lit("case"))


def humanize(identifier: Column) -> Column:
    """snake_case or kebab-case as a title: acronyms in capitals, joining words small, mixed case as it is."""
    parts = F.filter(F.transform(F.split(F.trim(identifier), "[_-]+"), lambda p: F.trim(p)), lambda p: p != "")
    word = lambda p, i: (
        F.when(F.lower(p).isin(ACRONYMS), F.upper(p)).when((i > 0) & F.lower(p).isin(JOINERS), F.lower(p)).when(F.substring(p, 2, 10_000).rlike("[A-Z]"), p).otherwise(F.concat(F.upper(F.left(p, F.lit(1))), F.substring(F.lower(p), 2, 10_000)))
    )
    return F.coalesce(F.array_join(F.transform(parts, word), " "), F.lit(""))


def name_tokens(name: Column) -> Column:
    """Distinct words of three letters or more that tell a party."""
    words = F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(JUNK)))


def names_match(a: Column, b: Column) -> Column:
    """Two words of ``a`` in common with ``b``, or its only one: not symmetric."""
    x, y = name_tokens(a), name_tokens(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) >= F.least(F.lit(2), F.size(x)))


def name_overlap(a: Column, b: Column) -> Column:
    """Common words over the smaller number of words; 0 if either has none."""
    x, y = name_tokens(a), name_tokens(b)
    small = F.least(F.size(x), F.size(y))
    return F.when(small > 0, F.size(F.array_intersect(x, y)) / small).otherwise(0.0)


def for_comparison(text: Column) -> Column:
    """Straight quotes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(text, "“”‘’ ", "\"\"'' "), r"\s+", " "))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences after ``for_comparison``; 0 for an empty needle."""
    t, n = for_comparison(text), for_comparison(needle)
    return F.when(F.length(n) > 0, ((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("long")).otherwise(0)


def edit_applied(text: Column, source: Column, proposed: Column, least: int = 12) -> Column:
    """The source is gone and the proposal is there; null where either is too short to tell."""
    t, s, p = for_comparison(text), for_comparison(source), for_comparison(proposed)
    return F.when((F.length(s) >= least) & (F.length(p) >= least), ~F.contains(t, s) & F.contains(t, p))


def snippet(text: Column, start: Column, end: Column, before: int = 300, after: int = 300) -> tuple[Column, Column]:
    """Characters before and after a span (0-based, end exclusive)."""
    low = F.greatest(start - before, F.lit(0))
    return F.substring(text, low + 1, start - low), F.substring(text, end + 1, F.lit(after))


def parse_date(text: Column) -> Column:
    """The first of five formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(p)).cast("date") for p in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "d MMMM yyyy", "MMMM d, yyyy")])


def tolerant_json(text: Column) -> Column:
    """What stands from the first to the last brace of a text, code fences left out; null without braces."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, "```[a-z]*", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def numbered_values(entries: Column) -> Column:
    """Values of a map's keys that are numbers, in order of the numbers, however long; other keys and null values go."""
    own = F.filter(F.map_entries(entries), lambda e: e["key"].rlike(r"\A\d+\z") & e["value"].isNotNull())
    plain = lambda k: F.regexp_replace(k, r"\A0+(?=\d)", "")
    return F.transform(F.array_sort(F.transform(own, lambda e: F.struct(F.length(plain(e["key"])).alias("l"), plain(e["key"]).alias("k"), e["value"].alias("v")))), lambda e: e["v"])


JSON_PARTS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|[][{},]', re.S)
CLOSES = {"[": "]", "{": "}"}


def close_json(cut: str) -> str:
    """JSON that was cut off, up to its last whole element, with what is open closed."""
    closing, end, then = "", len(cut), ""
    whole = False
    for m in JSON_PARTS.finditer(cut):
        c = m[0]
        if c in CLOSES:
            closing = CLOSES[c] + closing
        elif c in ("]", "}"):
            closing = closing[1:]
            end, then, whole = m.end(), closing, True
        elif c == ",":
            end, then, whole = m.start(), closing, True
    return cut[:end].rstrip() + (then if whole else closing)


def json_in(text: str | None) -> str | None:
    """The first JSON array or object of a text, in a fence or bare, cut off or whole; null if there is none to be read."""
    fence = re.search(r"```(?:json)?\s*(.*?)\s*```", text or "", re.S)
    start = re.search(r"[\[{]", text or "")
    tries = [fence[1]] if fence else []
    if start:
        end = text.rfind(CLOSES[start[0]])
        tries.append(text[start.start() : end + 1] if end > start.start() else text[start.start() :])
        tries.append(close_json(tries[-1]))
    for t in tries:
        try:
            json.loads(t)
            return t
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    """``json_in`` of each text: brackets have to be counted, which no SQL function does."""
    return text.map(json_in)


#: Entities that Markdown decodes.
MARKDOWN_ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&rsquo;": "’", "&lsquo;": "‘", "&rdquo;": "”", "&ldquo;": "“"}


def html_to_markdown(html: Column) -> Column:
    """Headings, emphasis, lists, tables and paragraphs as Markdown; images as [image]; no other tags.

    Ordered lists are numbered and a table's first row is ruled off. Headings, items and cells keep
    no tags within. Elements without an end lose their tag. Null gives an empty text.
    """
    inner = lambda tag: rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})>"
    plain = lambda t: F.regexp_replace(t, "<[^>]+>", "")
    of = lambda part, tag: F.regexp_extract_all(part, F.lit(inner(tag)), F.lit(1))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def each(t: Column, tags: list[str], render: Callable[[Column], Column]) -> Column:
        """Replace every element of the tags: the text is split around them and joined again."""
        parts = F.split(t, rf"(?i)(?=<(?:{'|'.join(tags)})\b)|(?<={'|'.join(f'</{x}>' for x in tags)})")
        whole = rf"(?is)\A<(?:{'|'.join(tags)})\b.*</(?:{'|'.join(tags)})>\z"
        return F.array_join(F.transform(parts, lambda part: F.when(part.rlike(whole), render(part)).otherwise(part)), "")

    def numbered(part: Column) -> Column:
        items = F.transform(of(part, "li"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.trim(plain(x)), F.lit("\n")))
        return F.concat(F.lit("\n"), F.array_join(items, ""))

    def table(part: Column) -> Column:
        rows = F.filter(F.transform(of(part, "tr"), lambda row: F.transform(of(row, "th|td"), lambda c: F.trim(plain(c)))), lambda c: F.size(c) > 0)
        lines = F.flatten(F.transform(rows, lambda c, i: F.when(i == 0, F.array(line(c), line(F.transform(c, lambda _: F.lit("---"))))).otherwise(F.array(line(c)))))
        return F.when(F.size(lines) > 0, F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")

    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<img\b[^>]*>", "[image]")
    t = each(t, [f"h{n}" for n in range(1, 7)], lambda part: F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.regexp_extract(part, "(?i)<h([1-6])", 1).cast("int")), F.lit(" "), plain(part), F.lit("\n")))
    for tags, mark in ((["strong", "b"], "**"), (["em", "i"], "*"), (["u"], "_")):
        t = each(t, tags, lambda part, m=mark: F.concat(F.lit(m), plain(part), F.lit(m)))
    t = each(t, ["ol"], numbered)
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<ul\b[^>]*>|</ul>", "\n"), r"(?is)<li\b[^>]*>\s*(.*?)\s*</li>", "- $1\n")
    t = each(t, ["table"], table)
    t = plain(F.regexp_replace(F.regexp_replace(t, inner("p"), "\n$1\n"), r"(?i)<br\s*/?>", "\n"))
    t = reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), F.lit(kv[1])), MARKDOWN_ENTITIES.items(), t)
    return F.btrim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))
