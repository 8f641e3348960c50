"""Citation rules as rows: what a rule applies to, when it is broken, and what it then says."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``broken`` is a pattern of the citation's text; ``unless`` one that clears it. No kinds mean all. ``fix`` gives the text as it should be."""

    id: str
    kinds: tuple[str, ...]
    broken: str
    severity: str
    category: str
    cite: str
    message: str
    unless: str | None = None
    fix: Callable[[Column], Column] | None = None

    def hit(self, kind: Column, text: Column) -> Column:
        bad = text.rlike(self.broken)
        bad = kind.isin(*self.kinds) & bad if self.kinds else bad
        return bad & ~text.rlike(self.unless) if self.unless else bad


def first(pattern: str, to: str) -> Callable[[Column], Column]:
    """Replace a pattern's first match; its groups count from $2."""
    return lambda text: F.regexp_replace(text, rf"(?s)\A(.*?){pattern}", f"$1{to}")


def numeral(n: int) -> str:
    """A number up to 50 in Roman digits."""
    tens, ones = divmod(n, 10)
    return ["", "X", "XX", "XXX", "XL", "L"][tens] + ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"][ones]


def amendment(text: Column) -> Column:
    """Amendments up to the 50th in Roman numerals."""
    number = F.regexp_extract(text, r"\bamend\.?\s+(\d+)", 1)
    roman = F.coalesce(F.get(F.array(*[F.lit(numeral(n) or "0") for n in range(51)]), number.try_cast("int")), number)
    before, after = (F.regexp_extract(text, r"(?s)\A(.*?\bamend\.?)\s+\d+(.*)\z", g) for g in (1, 2))
    return F.concat(before, F.lit(" "), roman, after)


def thousands(lead: str) -> Callable[[Column], Column]:
    """Commas in the first number after a lead."""

    def fix(text: Column) -> Column:
        before, page, after = (F.regexp_extract(text, rf"(?s)\A(.*?{lead}\s+)(\d+)(.*)\z", g) for g in (1, 2, 3))
        return F.concat(before, F.regexp_replace(page, r"\B(?=(\d{3})+$)", ","), after)

    return fix


#: Journals and news outlets whose form is checked.
JOURNALS = ["Harv. L. Rev.", "Yale L.J.", "Stan. L. Rev.", "Colum. L. Rev.", "U. Pa. L. Rev.", "U. Chi. L. Rev.", "Mich. L. Rev.", "Va. L. Rev.", "Cornell L. Rev.", "Tex. L. Rev.", "Geo. L.J.", "Cal. L. Rev.", "Duke L.J.", "N.Y.U. L. Rev.", "UCLA L. Rev.", "Vand. L. Rev.", "Wash. L. Rev.", "Tul. L. Rev.", "Notre Dame L. Rev."]
OUTLETS = [
    "N.Y. Times", "New York Times", "Wall St. J.", "Wall Street Journal", "Wash. Post", "Washington Post", "L.A. Times", "Los Angeles Times", "USA Today", "Bloomberg", "Reuters", "Associated Press", "Hollywood Reporter", "Variety", "TechCrunch", "Politico", "Axios", "The Atlantic", "New Yorker", "Vox", "Slate", "BuzzFeed",
    "Time", "Newsweek", "Forbes", "Fortune", "CNN", "NBC", "CBS", "ABC", "Fox News", "NPR", "BBC", "Boston Globe", "Chicago Tribune", "San Francisco Chronicle", "Miami Herald", "Atlanta Journal",
]
#: Pieces of the patterns below.
NO_VOLUME = "(?=[" + "".join(sorted({j[0] for j in JOURNALS})) + r"])(?<!\d\s{0,7})(?:" + "|".join(re.escape(j) for j in JOURNALS) + ")"
DATABASE = r"\b\d{4}\s+(?:WL|LEXIS)\s+\d+"
DATED = r"\([^)]*(?:Jan\.|Feb\.|Mar\.|Apr\.|May|June|July|Aug\.|Sept\.|Oct\.|Nov\.|Dec\.)\s+\d+,?\s+\d{4}\)"
UK_TAG = r"\((?:[^)]*\b(?:Eng\.|UK|Scot\.|N\.\s*Ir\.|Wales|England|Scotland|Northern Ireland)[^)]*)\)"
CORPORATE = r"\b[A-Z][A-Za-z]+(?:-[A-Z][A-Za-z]+|\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)?)\s+(?:Inc\.|Ltd\.|LLC|L\.L\.C\.|LLP|L\.L\.P\.|P\.C\.)(?=\s|,|\.|$)"
SIGNALS = r"(?i)(?:^|([.!?;,]))\s+(see also|see, e\.g\.|but see|but cf\.|but cf|see|cf\.|cf|contra|compare|accord|e\.g\.|with|and)\s*$"
#: Form rules of citations.
RULES = [
    Rule("versus", ("reporter", "case"), r"\bvs\.? ", "non_conforming", "abbreviations", "10.2.1", "Parties are joined by v."),
    Rule("v-period", ("reporter", "case"), r" v ", "non_conforming", "abbreviations", "10.2.1", "v takes a period."),
    Rule("us-periods", ("reporter",), r"\bUS\b", "non_conforming", "abbreviations", "6.1", "U.S. takes periods."),
    Rule("usc-periods", ("usc",), r"\bUSC\b", "non_conforming", "abbreviations", "12.9.3", "U.S.C. takes periods."),
    Rule("cfr-periods", ("cfr",), r"\bCFR\b", "non_conforming", "abbreviations", "6.1", "C.F.R. takes periods."),
    Rule("section-mark", ("usc", "cfr", "state_statute"), r"^", "non_conforming", "form_components", "6.2", "A section is marked by §.", unless="§"),
    Rule("section-space", ("usc", "cfr", "state_statute"), r"§[0-9]", "non_conforming", "form_components", "6.2", "A space follows §."),
    Rule("reporter-space", ("reporter",), r"\bF\. ?(2d|3d|4th)\b", "non_conforming", "reporter", "10.3", "No space before the series.", unless=r"F\.(2d|3d|4th)"),
    Rule("dash-range", ("reporter", "id", "supra"), r"\d-\d", "non_conforming", "form_components", "3.2(a)", "A range takes an en dash."),
    Rule("em-dash-range", ("reporter", "id", "supra"), r"\d—\d", "non_conforming", "form_components", "3.2(a)", "A range takes an en dash."),
    Rule("constitution-part", ("constitutional",), r"^", "non_conforming", "form_components", "11", "Name the article or amendment.", unless=r"art\.|amend\."),
    Rule("constitution-roman", ("constitutional",), r"\bamend\.?\s+\d+\b", "non_conforming", "form_components", "11", "Amendments have Roman numerals.", fix=amendment),
    Rule("double-space", ("reporter", "usc", "cfr", "id", "supra"), r"  ", "non_conforming", "form_components", "6.1", "Single spaces."),
    Rule("constitution-article", ("constitutional",), r"\bart(?!\.)\s+[IVXLCDM]+\b", "non_conforming", "form_components", "11", "art. takes a period.", fix=first(r"\bart\s+([IVXLCDM]+)", "art. $2")),
    Rule("constitution-capital", ("constitutional",), r"\b[A-Z][a-z]+\.\s+const\.", "non_conforming", "capitalization", "11", "Const. takes a capital.", fix=first(r"\b([A-Z][a-z]+)\.\s+const\.", "$2. Const.")),
    Rule("bill-congress", ("bill",), "^", "non_conforming", "form_components", "13.2", "A bill names its Congress.", unless=r"\b\d+(?:st|nd|rd|th)\s+Cong\."),
    Rule("report-congress", ("legislative_report",), r"\b(?:H\.\s*R\.|S\.)\s*Rep\.\s*No\.\s*\d++(?!-\d)", "non_conforming", "form_components", "13.4", "A report's number begins with its Congress."),
    Rule("record-comma", ("cong_rec",), r"Cong\.\s*Rec\.\s+\d{4,}\b", "non_conforming", "form_components", "6.2", "Page numbers of four digits take a comma.", fix=thousands(r"Cong\.\s*Rec\.")),
    Rule("register-volume", ("fed_reg",), r"Fed\.\s*Reg\.\s+[\d,]+", "non_conforming", "form_components", "14.2", "The register's volume is missing.", unless=r"\d\s*Fed\.\s*Reg\."),
    Rule("register-comma", ("fed_reg",), r"Fed\.\s*Reg\.\s+\d{4,}+(?!,)", "non_conforming", "form_components", "6.2", "Page numbers of four digits take a comma.", fix=thousands(r"Fed\.\s*Reg\.")),
    Rule("uk-court", ("foreign_case_uk",), "^", "non_conforming", "form_components", "20", "The court is missing.", unless=r"\((?:HL|CA|UKSC|PC|UKHL|Ch|QB|Crim)[^)]{0,30}\)"),
    Rule("uk-jurisdiction", ("foreign_case_uk",), "^", "non_conforming", "form_components", "20", "The jurisdiction is missing.", unless=UK_TAG),
    Rule("french-jurisdiction", ("foreign_case_french",), "^", "non_conforming", "form_components", "20", "The jurisdiction is missing.", unless=r"\(Fr\.\)"),
    Rule("australian-jurisdiction", ("foreign_case_aus",), "^", "non_conforming", "form_components", "20", "The jurisdiction is missing.", unless=r"\(Austl\.\)"),
    Rule("german-jurisdiction", ("foreign_case_german",), "^", "non_conforming", "form_components", "20", "The jurisdiction is missing.", unless=r"\(Ger\.\)"),
    Rule("treaty-date", ("multilateral_treaty",), "^", "non_conforming", "form_components", "21.4", "The date of signing is missing.", unless=r"\b[A-Z][a-z]+\.?\s+(?:\d{1,2},\s+)?\d{4}\b"),
    Rule("treaty-series", ("bilateral_treaty",), "^", "non_conforming", "form_components", "21.4", "The treaty series is missing.", unless=r"\b\d+\s+(?:Stat\.|T\.I\.A\.S\.|U\.S\.T\.)\s+[\d,]+"),
    Rule("icj-date", ("icj_case",), "^", "non_conforming", "form_components", "21", "The day of the decision is missing.", unless=r"\(\s*[A-Z][a-z]+\.?\s+\d{1,2}\s*\)"),
    Rule("echr-application", ("echr_case",), "^", "non_conforming", "form_components", "21", "The application's number is missing.", unless=r"\bApp\.\s+No\.\s+[\d/]+"),
    Rule("tcm-publisher", ("tcm_case",), "^", "non_conforming", "form_components", "10", "The publisher is missing.", unless=r"\((?:CCH|RIA)\)"),
    Rule("unreported-pin", ("unreported", "case"), DATABASE, "non_conforming", "form_components", "10.8.1", "A page is given by at *.", unless=r"at\s+\*\d"),
    Rule("unreported-date", ("unreported", "case"), DATABASE, "non_conforming", "form_components", "10.8.1", "The parenthesis has the day of the decision.", unless=DATED),
    Rule("corporate-comma", ("case",), CORPORATE, "review", "form_components", "10.2.1(c)", "See whether the registered name has a comma."),
    Rule("manuscript-tag", ("manuscript",), "^", "non_conforming", "form_components", "17.1", "A manuscript is marked as unpublished.", unless=r"(?i)\(unpublished\s+manuscript\)"),
    Rule("article-volume", ("article",), NO_VOLUME, "non_conforming", "form_components", "16.4", "The journal's volume is missing."),
    Rule("forthcoming-volume", ("forthcoming",), NO_VOLUME, "non_conforming", "form_components", "17.2", "The journal's volume is missing."),
    Rule("internet-https", ("internet",), r"\bhttp://[^\s)]+", "review", "form_components", "18.2.1", "Prefer https.", fix=first("http://", "https://")),
    Rule("internet-visited", ("internet",), r"https?://[^/\s)]+(?:/+[^/\s)]*)?/*(?:[\s)]|$)", "non_conforming", "form_components", "18.2.3", "A page that changes needs the day of the visit.", unless=r"(?i)\(last\s+visited[^)]*\)|https?://[^/\s)]+/(?:[^\s)]*/)?\d{4}\b|https?://[^/\s)]+/[^\s)]*\.(?:html?|pdf|aspx?|jsp)\b"),
    Rule("news-link", (), r"(?s)\A(?=.*\([A-Z][a-z]{2,5}\.?\s+(?:\d{1,2},\s+)?\d{4}\))(?=.*(?:" + "|".join(re.escape(o) for o in OUTLETS) + "))", "non_conforming", "form_components", "18.2", "A news article needs its address.", unless="https?://"),
]
#: Short forms of the Federal Rules, courts as a parenthesis names them, and months.
FEDERAL_RULES = {"FRCP": "Fed. R. Civ. P.", "FRCrP": "Fed. R. Crim. P.", "FRAP": "Fed. R. App. P.", "FRE": "Fed. R. Evid.", "F.R.C.P.": "Fed. R. Civ. P.", "F.R.Cr.P.": "Fed. R. Crim. P."}
COURT = r"(?:Cir\.|Ct\.|App\.|DCA|App'x|Tex\.|N\.D\.|S\.D\.|E\.D\.|W\.D\.|D\.|Bankr\.|Fla\.|Cal\.|N\.Y\.|Mass\.|Mich\.|Ill\.|Pa\.|Va\.|Ohio|Ga\.|N\.C\.|N\.J\.|Conn\.|Md\.|Wash\.|Or\.|Colo\.|Ariz\.|Ind\.|Tenn\.|Mo\.|Wis\.|Minn\.|U\.S\.)"
MONTH = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)\.?\s+\d{1,2}"
IN_COURT = r"\((?=[A-Z][A-Za-z.\s\d]+,\s*\d{4}\))(?=[A-Za-z.\s\d]*\b" + COURT + r"\b)(?![A-Za-z.\s\d]*" + MONTH + ",)"
SPACED_RULE = r"\bFed\.?\s*R\.?\s*(Civ|Crim|App|Evid)\.?\s*P\.?"
#: Rules of form beside those above: Federal Rules, series of So., commas before a year, history, ranges of paragraphs.
FORM_RULES = [
    *(Rule(f"federal-{short}", ("rules",), rf"\b{re.escape(short)}\b", "non_conforming", "form_components", "12.9.3", f"{short} is written {long}", fix=first(rf"\b{re.escape(short)}\b", long)) for short, long in FEDERAL_RULES.items()),
    Rule("federal-periods", ("rules",), r"\bFed\s+R\s+(?:Civ|Crim|App|Evid)\s+P\b|" + SPACED_RULE + r"\s*\d", "non_conforming", "form_components", "12.9.3", "The Federal Rules take periods and spaces.", unless=r"\bFed\. R\. (?:Civ|Crim|App|Evid)\. P\.", fix=first(SPACED_RULE + r"(?=\s)", "Fed. R. $2. P.")),
    Rule("so-space", ("reporter", "case"), r"\bSo\.\dd\b", "non_conforming", "reporter", "6.1", "A space stands before the series of So.", fix=lambda text: F.regexp_replace(text, r"\bSo\.(\d)d\b", "So. $1d")),
    Rule("court-comma", (), IN_COURT, "non_conforming", "form_components", "10.5", "No comma stands between court and year.", fix=first(r"\(([A-Z][A-Za-z.\s\d]+),\s*(\d{4})\)", "($2 $3)")),
    Rule("cert-period", (), r"(?i)\bcert(?!\.)\s+(?:denied|granted|dismissed)\b", "non_conforming", "history", "10.7", "cert. takes a period.", fix=lambda text: F.regexp_replace(text, r"(?i)\bcert(?!\.)\s+(denied|granted|dismissed)\b", "cert. $1")),
    Rule("paragraph-dash", (), r"¶{1,2}\s*\d{1,5}[-—]\d{1,5}\b", "non_conforming", "form_components", "3.2(a)", "A range takes an en dash.", fix=first(r"(¶{1,2}\s*)(\d{1,5})[-—](\d{1,5})\b", "$2$3–$4")),
]


TOLD = ("rule_id", "severity", "category", "rule_cite", "message")


def broken_rules(rules: list[Rule], kind: str, text: str) -> Column:
    """Numbers of the rules that a citation breaks; it is tried only against the rules of its kind."""
    k, t = F.col(kind), F.col(text)
    numbered = list(enumerate(rules))
    hits = lambda own: F.array_compact(F.array(*[F.when(r.hit(k, t), F.lit(n)) for n, r in own])) if own else F.array().cast("array<int>")
    general = [(n, r) for n, r in numbered if not r.kinds]
    by_kind = F.lit(None).cast("array<int>")
    for name in sorted({x for r in rules for x in r.kinds}):
        by_kind = F.when(k == name, hits([(n, r) for n, r in numbered if name in r.kinds])).otherwise(by_kind)
    return F.concat(F.coalesce(by_kind, F.array().cast("array<int>")), hits(general))


def marked(cites: DataFrame, rules: list[Rule] = RULES, kind: str = "kind", text: str = "text") -> DataFrame:
    """Every citation with rule_id, a row for each rule that it breaks; null, once, if it breaks none. The citations are made once."""
    ids = F.array(*[F.lit(r.id) for r in rules])
    return cites.select("*", F.explode_outer(broken_rules(rules, kind, text)).alias("_n")).withColumn("rule_id", F.get(ids, F.col("_n"))).drop("_n")


def flags(cites: DataFrame, rules: list[Rule] = RULES, kind: str = "kind", text: str = "text") -> DataFrame:
    """A row for each rule that a citation breaks, with all of the citation's columns.

    Rules are met as numbers; what a rule says is joined from a table of the rules, and its fix is
    made for what it broke.
    """
    t, numbered = F.col(text), list(enumerate(rules))
    broken = cites.withColumn("_n", F.explode(broken_rules(rules, kind, text)))
    fix = F.lit(None).cast("string")
    for n, r in numbered:
        if r.fix:
            fix = F.when(F.col("_n") == n, r.fix(t)).otherwise(fix)
    told = cites.sparkSession.createDataFrame([(n, r.id, r.severity, r.category, r.cite, r.message) for n, r in numbered], "_n int, " + ", ".join(f"{c} string" for c in TOLD))
    return broken.withColumn("suggested_fix", fix).join(F.broadcast(told), "_n").select(*cites.columns, *TOLD, "suggested_fix")  # a row a rule


def post_filter(flags_: DataFrame, existing: DataFrame, blocked: list[str], key: list[str]) -> DataFrame:
    """Judged flags without those of blocked rules, without target, or of a rule that the citation already broke."""
    own = flags_.filter(~F.col("rule_cite").isin(blocked)).dropna(subset=key)
    return own.join(existing.select(*key, "rule_cite").distinct(), [*key, "rule_cite"], "left_anti")


def signal_flags(cites: DataFrame, before: str) -> DataFrame:
    """Cites whose signal, the end of the text ``before`` them, has the wrong case: signal, expected.

    A signal is capitalised after a sentence's end or at the text's beginning, small after a comma
    or semicolon; with and and are always small. Other places tell nothing.
    """
    text = F.regexp_replace(F.col(before), r"\s+$", "")
    out = cites.withColumn("signal", F.regexp_extract(text, SIGNALS, 2)).withColumn("_mark", F.regexp_extract(text, SIGNALS, 1))
    small = F.lower("signal")
    expected = F.when(small.isin("with", "and") | F.col("_mark").isin(";", ","), small).otherwise(F.concat(F.upper(F.left("signal", F.lit(1))), F.substring(small, 2, 20)))
    return out.withColumn("expected", expected).filter((F.col("signal") != "") & (F.col("signal") != F.col("expected"))).drop("_mark")
