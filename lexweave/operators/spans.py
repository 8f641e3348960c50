"""Typed spans of a text: extraction, containment and overlap, and state along the order of a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.batches import small, spread
from .sentences import compiled

#: Reporters as patterns, with the forms that lack periods or spaces, and patterns of citations.
REPORTERS = [
    r"U\.S\.", r"S\. ?Ct\.", r"L\. ?Ed\. ?2d", r"L\. ?Ed\.", r"F\.4th", r"F\.3d", r"F\.2d", r"F\.", r"Fed\. ?App'?x\.", r"F\. ?Supp\. ?3d", r"F\. ?Supp\. ?2d", r"F\. ?Supp\.", r"F\.R\.D\.", r"B\.R\.", r"Bankr\.", r"T\.C\.",
    r"A\.3d", r"A\.2d", r"A\.", r"P\.3d", r"P\.2d", r"P\.", r"N\.E\.3d", r"N\.E\.2d", r"N\.E\.", r"N\.W\.3d", r"N\.W\.2d", r"N\.W\.", r"S\.E\.2d", r"S\.E\.", r"S\.W\.3d", r"S\.W\.2d", r"S\.W\.", r"So\. ?3d", r"So\. ?2d", r"So\.",
    r"Cal\. ?Rptr\. ?3d", r"Cal\. ?Rptr\. ?2d", r"Cal\. ?Rptr\.", r"Cal\. ?App\. ?5th", r"Cal\. ?App\. ?4th", r"Cal\. ?App\. ?3d", r"Cal\. ?App\. ?2d", r"Cal\. ?App\.", r"Cal\. ?5th", r"Cal\. ?4th", r"Cal\. ?3d", r"Cal\. ?2d", r"Cal\.",
    r"N\.Y\.3d", r"N\.Y\.2d", r"N\.Y\.", r"A\.D\.3d", r"A\.D\.2d", r"A\.D\.", r"N\.Y\.S\.3d", r"N\.Y\.S\.2d", r"N\.Y\.S\.", r"Misc\. ?3d", r"Misc\. ?2d", r"Misc\.", r"Tex\.", r"Ill\. ?2d", r"Ill\. ?App\. ?3d", r"Ill\.", r"Mass\. ?App\. ?Ct\.", r"Mass\.",
    r"Eng\. ?Rep\.", r"Ex\.", r"U\.S(?!\.)", "US", r"F\.?\s?2d", r"F\.?\s?3d", r"F\.?\s?4th",
]
NAMES = "(?:" + "|".join(sorted(REPORTERS, key=len, reverse=True)) + ")"
STATES = r"(?:Cal\.|N\.Y\.|Tex\.|Fla\.|Mass\.|Ill\.|Ohio|Pa\.|Va\.|Mich\.|Ga\.|N\.C\.|N\.J\.|Conn\.|Md\.|Wash\.|Or\.|Colo\.|Ariz\.|Ind\.|Tenn\.|Mo\.|Wis\.|Minn\.)"
PATTERNS = {
    "reporter": rf"\b\d{{1,4}}\s+(?=[A-Z]){NAMES}\s+\d{{1,5}}(?!d\b|th\b)(?:[-–—,]\s*\d{{1,5}})*",
    "unreported": r"\b\d{4}\s+(?:WL|U\.S\. App\. LEXIS|LEXIS)\s+\d+(?:,\s+at\s+\*\d+)?(?:\s*\([^)]{0,100}\))?",
    "short_case": rf"\b[A-Z][A-Za-z\-']{{1,80}}(?:,?\s+[A-Z][A-Za-z\-']{{1,80}}){{0,3}},\s+\d{{1,4}}\s+{NAMES}\s+at\s+\d{{1,5}}(?:[\-,]\s*\d{{1,5}})?",
    "usc": r"\b\d{1,3}\s+(?:U\.S\.C\.|USC)\s+(?:§{1,2}\s?)?[\d\-().a-zA-Z]+",
    "state_statute": STATES + r" +[A-Z][a-zA-Z.]+(?: +[A-Z][a-zA-Z.]+)? +(?:Code|Stat\.|Laws|Law|Ann\.)(?: +Ann\.)? +§{1,2} ?[\d\-().a-zA-Z]+",
    "cfr": r"\b\d{1,3}\s+(?:C\.F\.R\.|CFR)\s+(?:§{1,2}\s?)?[\d\-().a-zA-Z]+",
    "constitutional": r"\b(?:U\.S\.|[A-Z][a-z]+\.) +Const\.(?: +(?:art\.|amend\.) +[IVXLCDM\d]+)?(?:,? +§ ?\d+)?(?:,? +cl\. ?\d+)?",
    "rules": r"\b(?:Fed\.?\s*R\.?\s*(?:Civ|Crim|App|Evid)\.?\s*P\.?|F\.R\.(?:Civ|Crim|App|Evid)\.P\.|FRCP|FRCrP|FRAP|FRE)\s*\d+(?:\([a-z0-9]+\))*",
    "restatement": r"\bRestatement\s+(?:\((?:First|Second|Third|Fourth)\)|(?:2d|3d|4th)\b|(?=of\s))(?:\s*(?:of\s+)?[A-Z][\w&\-]{0,80}(?:[:,]?\s+[\w&.\-]+){0,12}?)?(?:\s*§{1,2}\s?\d+(?:[a-z]|\.\d+)?)(?:\s+(?:cmt\.?|illus\.?|n\.|note)\s+[a-z\d]+)?(?:\s+\([^)]{0,80}\))?",
    "id": r"\bId\.(?: +at +\d{1,5}(?:[-–—,]\s*\d{1,5})?)?",
    "supra": r"\bsupra(?:\s+note\s+\d{1,4})?(?:[,\s]+at\s+\d{1,5}(?:[-–,]\s*\d{1,5})*)?",
    "url": r"https?://[^\s)>\]]+",
}
#: What a text must hold for a pattern to have a chance; looking for it is much faster than the pattern.
NEEDS = {
    "unreported": ("WL", "LEXIS"),
    "short_case": ("at",),
    "usc": ("U.S.C.", "USC"),
    "state_statute": ("§",),
    "cfr": ("C.F.R.", "CFR"),
    "constitutional": ("Const.",),
    "rules": ("Fed", "FR", "F.R."),
    "restatement": ("Restatement",),
    "id": ("Id.",),
    "supra": ("supra",),
    "url": ("http",),
}
SCHEMA = "start int, end int, kind string, text string"


def extract_by(df: DataFrame, id_col: str, text_col: str, find: Callable[[str], list[tuple]]) -> DataFrame:
    """``id_col``, ordinal, start, end (characters), kind and text of the spans that ``find`` gives for each text.

    Spark's functions give a match's text but not its place, so this runs over Arrow batches. Null
    texts have no spans.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = [(i, n, *x) for i, text in enumerate(b.column(1).to_pylist()) for n, x in enumerate(find(text or ""))]
            if out:
                at, ordinal, start, end, name, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(ordinal, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(name), pa.array(text)], [id_col, "ordinal", "start", "end", "kind", "text"])

    return spread(df.select(id_col, text_col), id_col).mapInArrow(run, f"`{id_col}` {kind}, ordinal int, {SCHEMA}")


def finder(patterns: dict[str, str]) -> Callable[[str], list[tuple]]:
    """What finds every match of the patterns in a text, in order of start, longest first."""
    patterns_ = [(k, compiled(p), NEEDS.get(k) if PATTERNS.get(k) == p else None) for k, p in patterns.items()]

    def find(text: str) -> list[tuple]:
        tried = [(k, p) for k, p, needs in patterns_ if needs is None or any(x in text for x in needs)]
        return sorted(((m.start(), m.end(), k, m[0]) for k, p in tried for m in p.finditer(text)), key=lambda x: (x[0], -x[1]))

    return find


def extract(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """Every match of the patterns, in order of start, longest first."""
    return extract_by(df, id_col, text_col, finder(patterns))


def drop_contained(spans: DataFrame, doc: str) -> DataFrame:
    """Spans that lie within no other, larger one of their document; identical spans stay together."""
    places = spans.select(doc, "start", "end").distinct()
    before = Window.partitionBy(doc).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = places.withColumn("_reach", F.max("end").over(before)).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col("end")))
    return spans.join(outer.drop("_reach"), [doc, "start", "end"], "left_semi")


def one_of_each(spans: DataFrame, doc: str, order: list[Column]) -> DataFrame:
    """As ``drop_contained``, and of identical spans the first."""
    w = Window.partitionBy(doc, "start", "end").orderBy(*order)
    return drop_contained(spans, doc).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def by_priority(groups: list[DataFrame], doc: str) -> DataFrame:
    """Spans of groups in falling priority; one within a kept span of a higher group is dropped.

    What lies within a dropped span lies within the kept one above it, so all higher spans may be
    asked: a span is within one if the farthest end of those that begin no later reaches its own.
    One sort of each document, no join of spans with spans.
    """
    both = reduce(DataFrame.unionByName, [g.withColumn("priority", F.lit(n)) for n, g in enumerate(groups)])
    before = Window.partitionBy(doc).orderBy("start", "priority").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for n in range(len(groups) - 1):
        both = both.withColumn(f"_reach{n}", F.max(F.when(F.col("priority") == n, F.col("end"))).over(before))
    within = reduce(lambda a, n: a | ((F.col("priority") > n) & F.coalesce(F.col(f"_reach{n}") >= F.col("end"), F.lit(False))), range(len(groups) - 1), F.lit(False))
    return both.filter(~within).drop(*[f"_reach{n}" for n in range(len(groups) - 1)])


def partial_overlaps(high: DataFrame, low: DataFrame, doc: str, key: str, width: int = 64) -> DataFrame:
    """Pairs of spans that overlap without the lower one lying within the higher.

    Spans meet in the bins of ``width`` places that both touch, and count in the first of these, so
    only near spans of a document are compared.
    """

    def binned(df: DataFrame) -> DataFrame:
        last = F.greatest(F.col("end") - 1, F.col("start"))
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))

    h = binned(high).select(F.col(doc).alias("_doc"), F.col("_bin").alias("_their"), F.col(key).alias(f"high_{key}"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    meets = (F.col("_a") < F.col("end")) & (F.col("start") < F.col("_b"))
    within = (F.col("_a") <= F.col("start")) & (F.col("_b") >= F.col("end"))
    once = F.col("_bin") == F.floor(F.greatest("start", "_a") / width)
    return binned(low).join(h, (F.col(doc) == F.col("_doc")) & (F.col("_bin") == F.col("_their")) & once & meets & ~within).select(doc, f"high_{key}", F.col(key).alias(f"low_{key}"))


def with_state(spans: DataFrame, doc: str, order: list[Column], name: str, is_full: Column) -> DataFrame:
    """Add idx, prev_kind, last_full (idx of the last full cite of the name before) and between (cites of other names since)."""
    w = Window.partitionBy(doc).orderBy(*order)
    out = spans.withColumn("idx", F.row_number().over(w) - 1).withColumn("prev_kind", F.lag("kind").over(w))
    own = Window.partitionBy(doc, name).orderBy("idx")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_nth", F.row_number().over(own) - 1).withColumn("_full", F.struct("idx", "_nth"))
    out = out.withColumn("_last", F.last(F.when(is_full, F.col("_full")), ignorenulls=True).over(earlier))
    between = F.col("idx") - F.col("_last.idx") - 1 - (F.col("_nth") - F.col("_last._nth") - 1)
    return out.withColumn("last_full", F.col("_last.idx")).withColumn("between", between).drop("_nth", "_full", "_last")


def far_short_forms(state: DataFrame, doc: str, name: str, is_short: Column, least: int = 6) -> DataFrame:
    """Short forms with ``least`` or more other cites since the full one, once for each gap."""
    late = state.filter(is_short & (F.col("between") >= least))
    w = Window.partitionBy(doc, name, "last_full").orderBy("idx")
    return late.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def paragraph_of(offset: Column, boundaries: Column) -> Column:
    """Number of paragraph boundaries before an offset."""
    return F.size(F.filter(boundaries, lambda b: offset > b))
