"""Citations of official, foreign and secondary sources: a pattern anchors each, its sentence and parentheses bound it."""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from . import sentences, spans
from .sentences import compiled

#: Words whose period ends no sentence, beside single letters.
SHORTENED = [
    "v", "vs", "Co", "Inc", "Corp", "Ltd", "Bros", "Cir", "Mfg", "Univ", "Ed", "Rev", "Bull", "Mag", "Mr", "Mrs", "Ms", "Dr", "Hon", "Prof", "Pa", "Va", "Tex", "Cal", "Fla", "Mass", "Mich", "Wash", "St", "Jr", "Sr", "No", "Nos",
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Sep", "Oct", "Nov", "Dec", "ed", "rev", "eds",
]
#: Further ones in official sources, and those in foreign ones.
SHORTENED_OFFICIAL = ["art", "amend", "cl", "pt"]
SHORTENED_ABROAD = ["Cass", "civ", "crim", "com", "soc", "Fr", "Ger", "Eng", "Austl", "Scot", "BGH", "BGHZ", "BVerfG", "BVerfGE", "HL", "CA", "UKSC", "PC", "UKHL", "AC", "WLR", "QB", "Ch", "CLR", "II", "III", "IV", "VI", "VII", "VIII", "IX"]
#: Signals before a citation, how far back its sentence may begin, and how long a trailing parenthesis is.
SIGNAL = re.compile(r"(?:see also|see, e\.g\.|see|but see|but cf|cf|contra|compare|accord|e\.g\.)\.?,?\s+", re.I)
LOOK_BACK = {"official": 400, "foreign": 600, "secondary": 600}
TRAILERS = re.compile(r"(?:[,\s]*\([^)]{0,300}\))*")
BREAK = re.compile(r"[.;!?]\s+|\n\s*\n")
LINK = re.compile(r",?\s*https?://[^\s)]+")

#: Pieces of the patterns below. A name's word is bounded, so that no text takes quadratic time.
NAME = r"[A-Z][\w'.\-]{0,80}"
NAME_2 = r"[A-Z][\w'.\-]{1,80}"
CHAMBER = r"(?<![A-Za-z.])(?:H\.\s*R\.|S\.|H\.R\.)\s*"
JOURNAL = rf"(?:{NAME}(?:\s+(?:{NAME}|of|the|and|&)){{0,12}}\s+(?:L\.\s*Rev\.|L\.\s*J\.|J\.\s*Reg\.|J\.\s*Int'l\s*L\.|J\.\s*Const\.\s*L\.|J\.|Rev\.|Bull\.|Q\.|Mag\.|L\.\s*Q\.|Law\s+Review|Law\s+Journal|Journal|Review|Tribune))"
OUTLET = "(?:Times|Reporter|Post|Journal|Tribune|Globe|News|Today|Chronicle|Herald|Bloomberg|Reuters|Variety|Politico|Axios|Atlantic|Newyorker|TechCrunch|Forbes|Fortune)"
AUTHORS = rf"(?:\s*\d{{1,4}}[A-Z]?\s+)?{NAME}(?:\s+{NAME}){{0,4}}(?:\s*[,&]\s*{NAME}(?:\s+{NAME}){{0,4}}){{0,3}}\s*,\s*[A-Z]"


@dataclass(frozen=True)
class Source:
    """A kind of source. ``apart``: it must not touch what was found before it. ``needs`` and ``bars`` are patterns of the whole citation."""

    kind: str
    pattern: str
    apart: bool = True
    needs: str = ""
    bars: str = r"(?!)"
    link: bool = False

    @cached_property
    def compiled(self) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
        return compiled(self.pattern), compiled(self.needs), compiled(self.bars)


#: Kinds of sources, in the order in which they claim their places.
OFFICIAL = [
    Source("constitutional", r"(?:U\.S\.|[A-Z][a-z]{1,40}\.)\s+[Cc]onst\.\s+(?:art\.?|amend\.?)\s+[IVXLCDM\d]+(?:,\s*§\s*\d+(?:\(\w+\))?)?(?:,\s*cl\.\s*\d+)?"),
    Source("legislative_report", CHAMBER + r"Rep\.\s*No\.\s*\d+(?:-\d+)?(?:,\s*at\s+\d+)?(?:\s*\(\d{4}\))?"),
    Source("legislative_hearing", r"[A-Z][^.]{5,200}?:\s+Hearing\s+Before\s+[^.]{0,300}?\d+(?:st|nd|rd|th)\s+Cong\.\s+\d+\s*\(\d{4}\)(?:\s*\([^)]{0,100}\))?"),
    Source("cong_rec", r"\d{1,4}\s+Cong\.\s*Rec\.\s+[\d,]+"),
    Source("bill", CHAMBER + r"\d{1,5}(?:,\s*\d+(?:st|nd|rd|th)\s*Cong\.[^.]{0,300}?(?:\s*§\s*\d+(?:\(\w+\))*)?(?:\s+\(\d{4}\))?|\s+\(\d{4}\))", needs=r"\b(?:H\.?R\.?|S\.)\s*\d"),
    Source("exec_order", r"Exec\.\s+Order\s+No\.\s*\d+(?:,\d{3})*(?:,\s*\d{1,4}\s+Fed\.\s*Reg\.\s+[\d,]+)?(?:\s*\([^)]{0,100}\))?"),
    Source("fed_reg", r"(?:\d{1,4}\s+)?Fed\.\s*Reg\.\s+[\d,]+(?:\s*\([^)]{0,200}\))?"),
]
FOREIGN = [
    Source("foreign_case_german", r"\bBundesgerichtshof\s+\[BGH\][\s\S]{0,300}?\(Ger\.\)"),
    Source("foreign_case_french", r"\bCass\.\s+(?:civ\.|crim\.|com\.|soc\.)\s+[\dre]+,\s+[A-Z][a-z]+\.?\s+\d{1,2},\s+\d{4},\s+Bull\.\s+civ\.\s+[IVX]+,?\s+No\.\s+\d+(?:\s*\(Fr\.\))?"),
    Source("echr_case", rf"\b{NAME_2}(?:\s+{NAME_2}){{0,3}}\s+v\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}}(?:,\s+App\.\s+No\.\s+[\d/]+)?,?\s+\d{{1,3}}\s+(?:Eur\.\s+Ct\.\s+H\.R\.(?:\s*\(ser\.\s+[AB]\))?|Eur\.\s+H\.R\.\s+Rep\.)\s+\d{{1,5}}(?:\s*\(\d{{4}}\))?"),
    Source("icj_case", r"\b\d{4}\s+I\.C\.J\.\s+\d{1,5}"),
    Source("tribunal_case", rf"\bProsecutor\s+v\.\s+{NAME_2},\s+Case\s+No\.\s+[A-Z\-\d]+,[^)]{{0,300}}\)"),
    Source("foreign_case_uk", rf"\b{NAME}(?:\s+(?:{NAME}|plc|ltd)){{0,6}}\s+v\.\s+{NAME}(?:\s+(?:{NAME}|of|the|and|&|plc|ltd)){{0,8}}\s+\[\d{{4}}\]\s+(?:\d{{1,3}}\s+)?(?:AC|WLR|QB|Ch|All ER|UKSC|UKHL)\s+\d{{1,5}}(?:\s*\((?:HL|CA|UKSC|PC|Ch|QB|Crim)[^)]{{0,30}}\))?(?:\s*\([A-Za-z.\s]+\))?"),
    Source("foreign_case_aus", rf"\b{NAME}(?:\s+{NAME}){{0,6}}\s+v\.\s+{NAME}(?:\s+{NAME}){{0,4}}\s+\(\d{{4}}\)\s+\d{{1,3}}\s+CLR\s+\d{{1,5}}(?:\s*\(Austl\.\))?"),
    Source("bilateral_treaty", rf",\s+U\.S\.-{NAME}(?:[\s.]+{NAME_2}){{0,2}}(?:,\s+[A-Z][a-z]+\.?\s+\d{{1,2}},\s+\d{{4}})?(?:,\s+\d+\s+(?:Stat\.|T\.I\.A\.S\.|U\.S\.T\.)\s+[\d,]+)?"),
    Source("multilateral_treaty", r"\b\d{1,5}\s+(?:U\.N\.T\.S\.|U\.S\.T\.|T\.I\.A\.S\.)\s+[\d,]+"),
    Source("tcm_case", rf"\b{NAME_2}(?:\s+{NAME}){{0,12}}\s+v\.\s+(?:Comm'r|Commissioner|United States),?\s+T\.C\.M\.\s+\d{{4}}-\d{{1,4}}(?:\s*\((?:CCH|RIA)\))?"),
]
SECONDARY = [
    Source("internet", r"https?://[^\s)\]]+", apart=False),
    Source("manuscript", r"(?i)\(unpublished\s+manuscript\)|\(on\s+file\s+with[^)]{0,200}\)", apart=False),
    Source("forthcoming", r"\(forthcoming\s+\d{4}\)", apart=False),
    Source("news_article", rf"\b{OUTLET}\s+\([A-Z][a-z]{{2,5}}\.?\s+\d{{1,2}},\s+\d{{4}}\)", link=True),
    Source("article", rf"(?:\d{{1,4}}\s+)?{JOURNAL}\s+(?:\d{{1,5}}(?:,\s*\d{{1,5}})?\s*\((?:[A-Z][a-z]+\.?\s+\d{{1,2}}(?:,\s+|\s+))?\d{{4}}\)|\(forthcoming\s+\d{{4}}\))", apart=False),
    Source("book", r"(?:§{1,2}\s*[\w.:\[\]]+|\b\d{1,5})\s+\([^)]{0,100}\b\d{4}\)", needs=rf"\A{AUTHORS}", bars=r"(?s)\s(?:v|vs)\.?\s|\A.{0,60}\b(?:Inc|Corp|Co|LLC|L\.L\.C|Ltd|LLP|L\.L\.P|N\.A|P\.C|P\.A)\.?(?:,|\s|\Z)"),
]
#: Fixed value: words that lead from a sentence into a secondary source.
INTRO = re.compile(rf"[A-Z][^,]{{0,150}}?\s[a-z]+\s[^,]{{0,80}},\s+(?={NAME_2}(?:\s+{NAME_2}){{0,4}}\s*,\s*[A-Z])")
GROUPS: dict[str, list[Source]] = {"foreign": FOREIGN, "official": OFFICIAL, "secondary": SECONDARY}


class Cover:
    """Union of intervals as disjoint ones in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, a: int, b: int) -> bool:
        n = bisect_left(self.starts, b)
        return n > 0 and self.ends[n - 1] > a

    def add(self, a: int, b: int) -> None:
        i, j = bisect_left(self.ends, a), bisect_right(self.starts, b)
        self.starts[i:j], self.ends[i:j] = [min(a, *self.starts[i:j][:1])] if i < j else [a], [max(b, *self.ends[i:j][-1:])] if i < j else [b]


def find(text: str, sources: list[Source], shortened: set[str], intro: bool, look_back: int) -> list[tuple]:
    """(start, end, kind, text) of the sources cited, none within another."""
    found: list[tuple] = []
    cover = Cover()
    starts: list[int] | None = None
    for s in sources:
        pattern, needs, bars = s.compiled
        for m in pattern.finditer(text):
            if starts is None:
                starts = sentences.starts(text, BREAK, shortened)
            n = bisect_right(starts, m.start())
            a = max(starts[n - 1] if n else 0, m.start() - look_back)
            if lead := SIGNAL.match(text, a, m.start()):
                a = lead.end()
            if intro and (lead := INTRO.match(text, a, m.start())):
                a = lead.end()
            b = m.end()
            if s.link and (more := LINK.match(text, b)):
                b = more.end()
            b = TRAILERS.match(text, b).end()
            whole = text[a:b]
            if needs.search(whole) and not bars.search(whole) and not (s.apart and cover.meets(a, b)):
                cover.add(a, b)
                found.append((a, b, s.kind, whole))
    reach, out = -1, []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[1] > reach:
            reach = x[1]
            out.append(x)
    return out


def extract(df: DataFrame, id_col: str, text_col: str, group: str) -> DataFrame:
    """``id_col``, ordinal, start, end, kind, text of every source of a group (official, foreign, secondary). Null texts have none."""
    sources = GROUPS[group]
    shortened = {*string.ascii_uppercase, *SHORTENED, *([] if group == "secondary" else SHORTENED_OFFICIAL), *(SHORTENED_ABROAD if group == "foreign" else [])}
    return spans.extract_by(df, id_col, text_col, lambda text: find(text, sources, shortened, group == "secondary", LOOK_BACK[group]))
