"""Cases as cited: the reporter's place, the name before it, the parenthesis behind it, and rules on these parts."""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_tokens
from ..sources.batches import small, spread
from . import sentences
from .abbreviations import CASE_WORDS
from .sentences import compiled
from .spans import NAMES

#: How far a name is looked for, what ends a sentence before it, leads into it, joins its words, and names a matter without parties.
LOOK_BACK, LOOK_AHEAD = 250, 100
REPORTER = compiled(rf"\b(\d{{1,4}})\s+({NAMES})\s+(\d{{1,5}})(?!d\b|th\b)(?:[-–—,]\s*\d{{1,5}})*")
BREAKS = re.compile(r"[.;]\s+|\n+")
DOTTED = re.compile(r"[A-Za-z]\.[A-Za-z]\.[A-Za-z]\Z")
CLOSED = re.compile(r"[.!?][\")”’»]")
LEAD = re.compile(r"(?:see also|see, e\.g\.|see|but see|but cf|cf|contra|compare|accord|e\.g\.|with|and)\.?,?\s+", re.I)
#: The last party's words as ``kind_of`` tells them: capitals, a joining word behind one, and marks of other names.
PARTY = re.compile(r"(?:cj?|w)*\Z")
MATTER = compiled(r"\b(?:In re|Ex parte|In the Matter of|Matter of|Petition of|Application of|Estate of)\b\s+[A-Z]")
CONNECTORS = {"of", "the", "and", "&", "in", "for", "to", "on", "by", "de", "la", "el", "du", "des"}
WITHIN_PARTY = {"d/b/a", "d.b.a.", "d.b.a", "dba", "f/k/a", "f.k.a.", "f.k.a", "fka", "n/k/a", "n.k.a.", "n.k.a", "nka", "a/k/a", "a.k.a.", "a.k.a", "aka", "ex", "rel.", "rel", "parte"}
LEAD_WORDS = {"see", "cf.", "cf", "contra", "compare", "accord", "e.g.", "with", "and", "but"}
PARENTHESIS = compiled(r"(?:\s+n\.\s*\d+[a-z]?)?\s*\(([^)]{0,80}?)(\d{4})[^)]{0,40}\)")
#: Words whose period ends no sentence before a case, beside single letters and the short forms of case words.
OTHERS = [
    "v", "vs", "rel", "ex", "Cir", "Jr", "Sr", "Mr", "Mrs", "Ms", "Dr", "Servs", "Cal", "Fla", "Tex", "Mass", "Ill", "Wash", "Va", "Pa", "Md", "Conn",
    "Mich", "Wisc", "Wis", "Minn", "Mo", "Ky", "Tenn", "Ga", "Ala", "Miss", "La", "Ark", "Okla", "Kan", "Neb", "Iowa", "Idaho", "Mont", "Wyo", "Colo",
    "Ariz", "Nev", "Or", "Vt", "Me", "Del", "Haw", "Const", "Const'l", "Crim", "Civ", "App", "Evid", "Stat", "Ann", "Rev", "Reg", "Nos", "Supp", "Ct",
    "Ed", "Wheat", "Cranch", "Pet", "Dall", "How", "Black", "Wall", "Cl", "Cls",
]
ABBREVIATED = {*string.ascii_uppercase, *OTHERS, *(short.rstrip(".") for short in CASE_WORDS.values())}
#: Years of reporters, from and to (none: still appearing).
YEARS = [
    ("U.S.", 1790, None), ("S. Ct.", 1882, None), ("L. Ed.", 1790, 1956), ("L. Ed. 2d", 1956, None), ("F.", 1880, 1924), ("F.2d", 1924, 1993),
    ("F.3d", 1993, 2021), ("F.4th", 2021, None), ("F. Supp.", 1932, 1998), ("F. Supp. 2d", 1998, 2014), ("F. Supp. 3d", 2014, None),
    ("F.R.D.", 1938, None), ("B.R.", 1979, None), ("T.C.", 1942, None), ("Fed. Cl.", 1992, None), ("A.", 1885, 1938), ("A.2d", 1938, 2010),
    ("A.3d", 2010, None), ("P.", 1883, 1931), ("P.2d", 1931, 2000), ("P.3d", 2000, None), ("N.E.", 1885, 1936), ("N.E.2d", 1936, 2014),
    ("N.E.3d", 2014, None), ("N.W.", 1879, 1942), ("N.W.2d", 1942, 2024), ("N.W.3d", 2024, None), ("S.E.", 1887, 1939), ("S.E.2d", 1939, None),
    ("S.W.", 1886, 1928), ("S.W.2d", 1928, 2000), ("S.W.3d", 2000, None), ("So.", 1887, 1941), ("So. 2d", 1941, 2008), ("So. 3d", 2008, None),
    ("Cal.", 1850, 1934), ("Cal. 2d", 1934, 1969), ("Cal. 3d", 1969, 1991), ("Cal. 4th", 1991, 2016), ("Cal. 5th", 2016, None),
    ("Cal. App.", 1905, 1934), ("Cal. App. 2d", 1934, 1969), ("Cal. App. 3d", 1969, 1991), ("Cal. App. 4th", 1991, 2016),
    ("Cal. App. 5th", 2016, None), ("N.Y.", 1847, 1956), ("N.Y.2d", 1956, 2004), ("N.Y.3d", 2004, None), ("A.D.", 1896, 1956), ("A.D.2d", 1956, 2004),
    ("A.D.3d", 2004, None),
]
SCHEMA = "ordinal int, start int, end int, name string, volume int, reporter string, page int, court string, year int, text string"


@lru_cache(maxsize=1 << 16)
def kind_of(raw: str) -> str:
    """A word's part in a case name: c begins with a capital, j joins, w stands within a party's name, v is versus, e ends what is before, x is none of these."""
    word = raw.rstrip(",;:")
    small = word.lower()
    if raw in ("v.", "v", "vs.", "vs"):
        return "v"
    if small in LEAD_WORDS or CLOSED.search(raw):
        return "e"
    if "A" <= word[:1] <= "Z":
        return "c"
    return "j" if small in CONNECTORS else "w" if small in WITHIN_PARTY else "x"


class Draft:
    """A text read once: where its words begin and a letter for each (``kind_of``), and where its sentences begin."""

    def __init__(self, text: str) -> None:
        self.text = text
        words = [(m.start(), kind_of(m[0])) for m in re.finditer(r"\S+", text)]
        self.words = [at for at, _ in words]
        self.kinds = "".join(kind for _, kind in words)
        self.sentences = sentences.starts(text, BREAKS, ABBREVIATED, DOTTED)

    def name_before(self, at: int) -> int:
        """Where the case name before a reporter's place begins; ``at`` itself if there is none."""
        n = bisect_right(self.sentences, at)
        low = max(0, at - LOOK_BACK, self.sentences[n - 1] if n else 0)
        if lead := LEAD.match(self.text, low, at):
            low = lead.end()
        first, end = bisect_left(self.words, low), bisect_left(self.words, at)
        versus = self.kinds.find("v", first + 1, end)
        if versus < 0:
            matters = list(MATTER.finditer(self.text, low, at))
            return matters[-1].start() if matters else at
        party = self.kinds.find("c", PARTY.search(self.kinds, first, versus).start(), versus)
        return at if party < 0 else self.words[party]


def find_cases(text: str) -> Iterator[tuple]:
    draft = None
    for n, m in enumerate(REPORTER.finditer(text)):
        draft = draft or Draft(text)
        a = draft.name_before(m.start())
        b, court, year = m.end(), None, None
        if p := PARENTHESIS.match(text, b, b + LOOK_AHEAD):
            b, court, year = p.end(), p[1].strip().rstrip(",") or None, int(p[2])
        yield n, a, b, text[a : m.start()].strip().rstrip(",") or None, int(m[1]), m[2], int(m[3]), court, year, text[a:b]


def extract_cases(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each reported case: its whole span, name, volume, reporter, page, and court and year of the parenthesis. Null texts have none."""
    kind = df.schema[id_col].dataType.simpleString()
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    names = [id_col, *(x.split(" ")[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = [(i, *x) for i, text in enumerate(b.column(1).to_pylist()) for x in find_cases(text or "")]
            if out:
                at, *columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return spread(df.select(id_col, text_col), id_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def reporter_years(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(YEARS, "reporter string, since int, until int")


def even_reporter() -> F.Column:
    """A reporter with the spaces that its full form has: S.Ct. as S. Ct."""
    return F.regexp_replace("reporter", r"^(S\.(?=Ct)|L\.(?=Ed)|F\.(?=Supp)|So\.|Cal\.|Misc\.|Ill\.|Mass\.)(?=[A-Z0-9])|(?<=Ed\.|Supp\.|Rptr\.|App\.)(?=\d)", "$1 ")


def out_of_years(cites: DataFrame) -> DataFrame:
    """Cases whose year is before their reporter began or after it ended; reporters that are not known tell nothing."""
    known = cites.withColumn("_reporter", even_reporter()).join(F.broadcast(reporter_years(cites.sparkSession).withColumnRenamed("reporter", "_reporter")), "_reporter")  # 51 rows
    return known.filter((F.col("year") < F.col("since")) | (F.col("year") > F.coalesce("until", F.lit(9999)))).select(*cites.columns, "since", "until")


def name_flags(cites: DataFrame) -> DataFrame:
    """Rules on names and courts: v. without its period, vs., periods left out of the reporter, a court that is missing or goes without saying."""
    supreme = F.col("reporter").rlike(r"^(U\.S\.?|US|S\. ?Ct\.|L\. ?Ed\.)")
    regional = F.col("reporter").rlike(r"^(F\.|F\. ?Supp|B\.R\.|A\.|P\.|N\.E\.|N\.W\.|S\.E\.|S\.W\.|So\.)")
    rules = [
        ("versus", F.col("name").rlike(r"\svs\.?\s")),
        ("v-period", F.col("name").rlike(r"\sv\s")),
        ("us-periods", F.col("reporter").isin("US", "U.S")),
        ("reporter-space", F.col("reporter").rlike(r"^F\.? (2d|3d|4th)$|^F(2d|3d|4th)$")),
        ("court-missing", regional & F.col("year").isNotNull() & F.col("court").isNull()),
        ("court-redundant", supreme & F.col("court").rlike(r"^U\.?S\.?$|(?i)supreme court")),
    ]
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return cites.withColumn("rule_id", F.explode(hits))


def duplicate_names(new: DataFrame, known: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """``key`` and existing: for each new case the first known one, by ``order``, with three words of the name in common or 80 % of the smaller set.

    So as many words as the smaller set has are shared, three at most. Both sides meet by their
    rarest words for each such number, known names with the same words once, so that no frequent
    word brings all its names together. Names without words match nothing; nulls neither.
    """
    first = known.select(F.array_sort(name_tokens(F.col(name))).alias("_words"), F.struct(F.col(order).alias("_at"), F.col(name).alias("_name")).alias("_known")).filter(F.size("_words") > 0).groupBy("_words").agg(F.min("_known").alias("_known"))
    mine = new.select(F.col(key), F.array_sort(name_tokens(F.col(name))).alias("_words")).filter(F.size("_words") > 0)
    often = first.select(F.explode("_words").alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))

    def keyed(df: DataFrame, own: list[str]) -> DataFrame:
        ranked = df.withColumn("_word", F.explode("_words")).join(often, "_word")  # a word that no known name has brings none together
        rarest = ranked.groupBy(*own, "_words").agg(F.array_sort(F.collect_list(F.struct("_n", "_word"))).alias("_rare"))
        sizes = rarest.withColumn("_need", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.size("_words")))))
        # Of |words| - need + 1 rarest ones, those that no known name has (and so are rarest) are already gone.
        left = F.size("_words") - F.col("_need") + 1 - (F.size("_words") - F.size("_rare"))
        return sizes.filter(left > 0).withColumn("_word", F.explode(F.slice("_rare", F.lit(1), left)["_word"]))

    theirs = keyed(first, ["_known"]).select("_need", "_word", "_known", F.col("_words").alias("_their"))
    met = keyed(mine, [key]).join(theirs, ["_need", "_word"])
    enough = F.col("_need") == F.least(F.lit(3), F.size("_words"), F.size("_their"))
    same = met.filter(enough & (F.size(F.array_intersect("_words", "_their")) >= F.col("_need")))
    return same.groupBy(key).agg(F.min("_known")["_name"].alias("existing"))
