"""Citations of chat messages, and the quotation out of a finding's section reference."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .citations import Cover

#: Patterns of statutes, cases and links in messages. A word has at most 81 characters and a gap 200, so that no text takes quadratic time.
WORD = r"[A-Z][\w'.\-]{1,80}"
JOIN = r"(?:&\s+|of\s+|the\s+|in\s+|on\s+|for\s+|de\s+|la\s+|St\.\s+|Mc[A-Z][a-z]{1,80}\s+)?"
PARTY = rf"{WORD}(?:\s+{JOIN}{WORD}){{0,5}}"
STATUTES = [
    re.compile(r"\b(?:[A-Z][a-z]{0,80}\.?\s+){1,4}(?:Stat\.|Code|Laws|Rev\.?\s*Stat\.?|Ann\.|Comp\.?\s*Laws|Cons\.?\s*Stat\.|Gen\.?\s*Laws)[^§]{0,200}?§\s*[\d.\-:A-Z()]+(?:\([\w]+\))?", re.ASCII),
    re.compile(r"\b\d+\s+U\.S\.C\.\s*(?:§|sec\.?)\s*\d+(?:[\w.\-()]*)?", re.ASCII),
]
CASE = re.compile(rf"\b{PARTY}\s+v\.?\s+{PARTY}\s*,\s*\d+\s+(?:[A-Z]\.?\s*){{1,8}}(?:\d+\s*d|d|st|nd|rd|th)?\s*\d+(?:\s*\(\s*\d{{4}}\s*\))?", re.ASCII)
LINK = re.compile(r"https?://[^\s)<>\"'`,]+")
LINK_END = re.compile(r"[.,;:!?)\]]+$")


def find_citations(text: str) -> list[tuple]:
    """(start, end, kind, text) in order: statutes, cases that meet no statute, links without the marks behind them."""
    statutes = Cover()
    found = {(m.start(), m.end(), "statute", m[0].strip()) for p in STATUTES for m in p.finditer(text)}
    for a, b, *_ in found:
        statutes.add(a, b)
    found |= {(m.start(), m.end(), "case", m[0].strip()) for m in CASE.finditer(text) if not statutes.meets(m.start(), m.end())}
    for m in LINK.finditer(text):
        raw = LINK_END.sub("", m[0])
        found.add((m.start(), m.start() + len(raw), "url", raw))
    return sorted(found)


def message_citations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ordinal, start, end, kind and text of the citations of each message; null texts have none."""
    return spans.extract_by(df, id_col, text_col, find_citations)


#: A section's reference before a quotation or before plain words, what joins a second section, and the least length of what is left.
QUOTED = r"Section\s+[\d.()a-zA-Z]+(?:\s+[^:'\"]{1,80}?)?\s*:\s*(['\"‘’“”])"
PLAIN = r"Section\s+[\d.()a-zA-Z]+(?:\s+[^:'\"+]{1,80}?)?\s*:\s+"
SECOND = r"(?i)\s+(?:\+|AND|OR|COMBINED\s+WITH|IN\s+COMBINATION\s+WITH)\s+Section\s+[\d.()a-zA-Z]+"
LEAST_QUOTED, LEAST_PLAIN = 8, 12


def quoted_section(text: Column) -> Column:
    """The contract's words out of ``Section 4.2: "…"`` or ``Section 4.2: … AND Section 4.3``; null where there is no such form.

    A quotation reaches from the mark behind the first reference to the last mark that closes it.
    """
    bare = F.trim(text)
    mark = F.regexp_extract(bare, QUOTED, 1)
    rest = F.regexp_extract(bare, rf"(?s)\A.*?{QUOTED}(.*)\z", 2)
    to_last = lambda closing: F.trim(F.regexp_extract(rest, rf"(?s)\A(.+){closing}", 1))
    quotation = F.when(mark.isin("‘", "’"), to_last("’")).when(mark.isin("“", "”"), to_last("”")).when(mark == "'", to_last("'")).otherwise(to_last('"'))
    words = F.regexp_extract(bare, rf"(?s)\A.*?{PLAIN}(.*)\z", 1)
    first = F.trim(F.regexp_replace(F.trim(F.get(F.split(words, SECOND, 2), F.lit(0))), r"[,;.]+$", ""))
    return F.when((mark != "") & (F.length(quotation) >= LEAST_QUOTED), quotation).when(F.length(first) >= LEAST_PLAIN, first)
