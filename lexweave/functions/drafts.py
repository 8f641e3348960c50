"""Rewrites and checks of drafted citations, findings and templates, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewrites that need no context, in the order in which they apply.
FIXES = [
    (r"\bvs\.?(\s+[A-Z])", "v.$1"),
    (r"\b([A-Z][\w']*)\s+v(?!\.)(\s+[A-Z])", "$1 v.$2"),
    (r"\b(\d{1,4}\s+)US(\s+\d)", "$1U.S.$2"),
    (r"\b(\d{1,3}\s+)USC\s+(\d)", "$1U.S.C. § $2"),
    (r"\b(\d{1,3}\s+)CFR\s+(\d)", "$1C.F.R. § $2"),
    (r"\b(\d{1,3}\s+)USC\b", "$1U.S.C."),
    (r"\b(\d{1,3}\s+)CFR\b", "$1C.F.R."),
    (r"(\bU\.S\.C\.)\s+(\d)", "$1 § $2"),
    (r"(\bC\.F\.R\.)\s+(\d)", "$1 § $2"),
    (r"§(\d)", "§ $1"),
    (r"\bSo\.(\d)d\b", "So. $1d"),
    (r"\(([A-Z][A-Za-z.\s\d]+),\s*(\d{4})\)", "($1 $2)"),
    (r"\bCalif\.(?![A-Za-z])", "Cal."),
    (r"\bPenn\.(?![A-Za-z])", "Pa."),
    (r"\bPenna\.(?![A-Za-z])", "Pa."),
    (r"\bFl\.(?![A-Za-z])", "Fla."),
    (r"\bWisc\.(?![A-Za-z])", "Wis."),
    (r"\bFRCP\b", "Fed. R. Civ. P."),
    (r"\bFRCrP\b", "Fed. R. Crim. P."),
    (r"\bFRAP\b", "Fed. R. App. P."),
    (r"\bFRE\b", "Fed. R. Evid."),
    (r"\bF\.R\.Civ\.P\.\b", "Fed. R. Civ. P."),
    (r"\bF\.R\.Cr\.P\.\b", "Fed. R. Crim. P."),
    (r"\bRestatement\s+2d\s+(?!of\b)([A-Z][A-Za-z\s]+)", "Restatement (Second) of $1"),
    (r"\bRestatement\s+3d\s+(?!of\b)([A-Z][A-Za-z\s]+)", "Restatement (Third) of $1"),
    (r"\bRestatement\s+4th\s+(?!of\b)([A-Z][A-Za-z\s]+)", "Restatement (Fourth) of $1"),
]
#: What a mended citation must not show any more, and what a whole one shows.
LEFTOVERS = r"\bvs\.?\s+[A-Z]|\b[A-Z][\w']+\s+v(?!\.)\s+[A-Z]|\b\d{1,4}\s+US\s+\d|\b\d{1,4}\s+U\.S\s+\d(?!\d*\.)|\b\d{1,3}\s+USC\b|\b\d{1,3}\s+CFR\b|§\d|\bFRCP\b|\bFRCrP\b|\bFRAP\b|\bFRE\b|\bFl\.(?![A-Za-z])|(?<!\.)\.\.(?!\.)"
PARTIES = r"\b[A-Z][A-Za-z\-'.]+\s+v\.\s+[A-Z]"
LOOSE_PARTIES = r"\b[A-Z][A-Za-z\-'.]+\s+v\.?\s+[A-Z]"
REPORTED = r"\b\d+\s+[A-Z][A-Za-z.\d\s]*\s+\d"
RESTATEMENT = (r"\bRestatement\s+\((First|Second|Third|Fourth)\)", r"\bof\s+[A-Z]", r"§\s*\d")
#: Words that no message may have, and what stands for them.
UNLOCATED = "could not be located in CourtListener — please verify before filing"
SOFTER = [
    (r"(?i)\b(?:this|the)\s+(?:case|citation|opinion|authority)\s+does\s+not\s+exist[^.]*", UNLOCATED),
    (r"(?i)\bdoes\s+not\s+exist\b[^.]*", UNLOCATED),
    (r"(?i)(?:appears? to be |looks )?hallucinat(?:ed|ion)\b", UNLOCATED),
    (r"(?i)(?:appears? to be |is )?fictitious\b", UNLOCATED),
    (r"(?i)(?:appears? to be |is )?fake\b", UNLOCATED),
    (r"(?i)\bincorrect\b", "non-conforming"),
    (r"(?i)\bwrong\b", "non-conforming"),
]
#: How numbers of candidates leak into messages.
LEAKS = [
    (r"(?i)\s*\(?\s*(?:see\s+)?(?:citation|candidate)[_\s#]*(?:index)?[\s#]*\d+\s*\)?\s*[,:]?", " "),
    (r"(?i)\s*\(?\s*index\s+\d+\s*\)?\s*[,:]?", " "),
    (r"\s{2,}", " "),
]
#: What templates have and finished documents have.
PLACEHOLDERS = [r"\{\{\s*[\w.\-]+\s*\}\}", r"\[\s*[A-Z][A-Z _\-/]{2,40}\s*\]", r"<<\s*[\w.\-\s]+\s*>>", r"_{4,}", r"\bN/A\b"]
STRUCTURE = [r"(?i)\bINSERT\b", r"(?i)\bSIGNATURE\b", r"(?m)\bDATED:\s*$", r"(?m)\bBY:\s*$", r"(?i)\bATTORNEYS? FOR\b", r"(?i)\bSTATE OF\b\s*[_]+", r"(?i)\bCOUNTY OF\b\s*[_]+", r"(?i)__________\s*\n\s*Print(ed)? Name"]
FINISHED = [r"(?i)\bEXECUTED VERSION\b", r"(?i)\bFINAL\b", r"(?i)\bv\d+\.\d+\b"]
#: Words of firms and offices that mean the same, and words that tell nothing.
FOLDS = [
    (r"\b(co|company)\b", "co"), (r"\b(corp|corporation)\b", "corp"), (r"\b(inc|incorporated)\b", "inc"), (r"\b(ltd|limited)\b", "ltd"), (r"\b(bros|brothers)\b", "bros"), (r"\b(assn|association)\b", "assn"), (r"\b(commn|commission)\b", "commn"),
    (r"\b(dept|department)\b", "dept"), (r"\b(intl|international)\b", "intl"), (r"\b(indus|industries|industry)\b", "indus"), (r"\b(bd|board)\b", "bd"), (r"\b(educ|education)\b", "educ"), (r"\b(univ|university)\b", "univ"), (r"\b(servs|services|service)\b", "servs"),
    (r"\b(mfg|manufacturing)\b", "mfg"), (r"\b(mach|machinery)\b", "mach"), (r"\b(natl|national)\b", "natl"), (r"\b(sec|securities|security)\b", "sec"), (r"\b(fed|federal)\b", "fed"), (r"\b(gov|government)\b", "gov"),
]
EMPTY_WORDS = ["the", "of", "a", "an", "and", "&", "in", "for", "on", "to", "et", "al"]
SAME_CASE = 0.5


def rewritten(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, x: F.regexp_replace(t, *x), steps, text)


def static_fixes(text: Column) -> Column:
    """Rewrites that hold without looking at the citation's parts."""
    return rewritten(text, FIXES)


def checked_fix(fix: Column, kind: Column, original: Column) -> Column:
    """A suggested fix after ``static_fixes``, or null: too short, still broken, or less than the citation was."""
    out = static_fixes(F.trim(fix))
    has = lambda p: F.coalesce(out.rlike(p), F.lit(False))
    broken = has(LEFTOVERS)
    case = (kind == "case") & ((F.coalesce(original.rlike(LOOSE_PARTIES), F.lit(False)) & ~has(PARTIES)) | ~has(REPORTED))
    restated = (kind == "book") & F.coalesce(original.rlike(r"\bRestatement\b"), F.lit(False)) & ~(has(RESTATEMENT[0]) & has(RESTATEMENT[1]) & has(RESTATEMENT[2]))
    return F.when((F.length(F.trim(fix)) >= 10) & ~broken & ~F.coalesce(case, F.lit(False)) & ~F.coalesce(restated, F.lit(False)), out)


def softened(message: Column) -> Column:
    """A message without the words that are not to be said."""
    return rewritten(message, SOFTER)


def without_indexes(message: Column) -> Column:
    """A message without numbers of candidates."""
    return F.regexp_replace(F.trim(rewritten(message, LEAKS)), r"\s+at\s*[,.]", ".")


def anchor_needle(text: Column, least: int = 40, most: int = 70, floor: int = 30) -> Column:
    """The beginning of a paragraph to find it by: up to 70 characters, cut at a word's end if that is beyond the 31st."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.left(t, F.lit(most))
    whole_words = F.regexp_replace(cut, r" [^ ]*$", "")
    return F.when(F.length(t) <= least, t).otherwise(F.when(cut.contains(" ") & (F.length(whole_words) > floor), whole_words).otherwise(cut))


def template_scan(text: Column, most: int = 20_000) -> Column:
    """struct(hits, structural, anti, proceed, confidence) of a text's first 20,000 characters, which is where a template shows itself."""
    t = F.left(F.coalesce(text, F.lit("")), F.lit(most))
    hits = reduce(lambda a, p: a + F.regexp_count(t, F.lit(p)), PLACEHOLDERS, F.lit(0))
    some = lambda patterns: reduce(lambda a, p: a + t.rlike(p).cast("int"), patterns, F.lit(0))
    structural, anti = some(STRUCTURE), some(FINISHED)
    verdict = lambda proceed, confidence: F.struct(F.lit(proceed).alias("proceed"), F.lit(confidence).alias("confidence"))
    told = F.when((anti >= 2) & (hits == 0), verdict(False, 0.05)).when(hits >= 3, verdict(True, 0.85)).when((hits >= 1) | (structural >= 2), verdict(True, 0.4)).otherwise(verdict(False, 0.1))
    return F.struct(hits.alias("hits"), structural.alias("structural"), anti.alias("anti"), told["proceed"].alias("proceed"), told["confidence"].alias("confidence"))


def missing_fields(fields: Column, values: Column) -> Column:
    """Of an array of structs (key, label) those without a value in a map: null, blank or not there."""
    named = F.filter(fields, lambda v: v["key"].isNotNull() & (v["key"] != "") & (F.trim(F.coalesce(F.element_at(values, v["key"]), F.lit(""))) == ""))
    return F.transform(named, lambda v: F.struct(v["key"].alias("key"), F.coalesce(F.nullif(v["label"], F.lit("")), v["key"]).alias("label")))


def docket_number(url: Column) -> Column:
    """Document number of /docket/<id>/<number>/…; null elsewhere."""
    return F.nullif(F.regexp_extract(url, r"^/docket/\d+/(\d+)/", 1), F.lit(""))


def attachment_number(url: Column) -> Column:
    """Attachment of /docket/<id>/<number>/<attachment>/<name>; 0 where the address has none."""
    part = F.get(F.split(F.btrim(F.coalesce(url, F.lit("")), F.lit("/")), "/"), F.lit(3))
    long = F.size(F.split(F.btrim(F.coalesce(url, F.lit("")), F.lit("/")), "/")) >= 5
    return F.when(long & part.rlike(r"^\d+$"), part).otherwise("0")


def salted_id(salt: Column, text: Column, digits: int = 16) -> Column:
    """A synthetic id: the first hex digits of the SHA-256 of salt and text."""
    return F.left(F.sha2(F.encode(F.concat_ws("|", salt, text), "utf-8"), 256), F.lit(digits))


def folded_name(name: Column) -> Column:
    """A case name in lower case, its v. even, its lead and marks gone, words of firms folded."""
    steps = [(r"\b(vs?\.?|versus)\b", "v"), (r"(\w)'(\w)", "$1$2"), (r"^\s*in\s+re\s+", ""), (r"^\s*ex\s+(?:parte|rel\.?)\s+", ""), (r"[.,;:'\"`]", " "), (r"\s+", " ")]
    return rewritten(F.trim(rewritten(F.lower(F.coalesce(name, F.lit(""))), steps)), FOLDS)


def case_overlap(a: Column, b: Column) -> Column:
    """Common words of two folded case names over the smaller number of words; 0 if either has none."""
    words = lambda n: F.array_distinct(F.filter(F.split(folded_name(n), " "), lambda w: (F.length(w) > 1) & ~w.isin(EMPTY_WORDS)))
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def occurrence_verdict(text: Column, needle: Column, count: Column, least: int = 8, short: int = 30) -> Column:
    """Whether a passage can be found by a needle: too_short, missing, ambiguous (short and more than once), found."""
    n = F.length(F.coalesce(needle, F.lit("")))
    return F.when(n < least, "too_short").when(count == 0, "missing").when((count > 1) & (n < short), "ambiguous").otherwise("found")


def needs_ocr(chars: Column, pages: Column, least: int = 50) -> Column:
    """Under 50 characters a page; false where pages are not known."""
    return F.coalesce((pages > 0) & (chars < least * pages), F.lit(False))


def vector_text(v: Column) -> Column:
    """[0.1234567,…]: seven decimals each, rounded half up; null for vectors that are null or hold null, NaN or infinity.

    Up to 10^8 a float times 10^7 is exact as a double; larger numbers have all their digits before the point.
    """

    def written(x: Column) -> Column:
        wide = F.abs(x.cast("double"))
        n = F.floor(F.least(wide, F.lit(1e8)) * 1e7 + 0.5).cast("long")
        small = F.concat(F.floor(n / 10_000_000).cast("string"), F.lit("."), F.lpad((n % 10_000_000).cast("string"), 7, "0"))
        return F.concat(F.when(x < 0, "-").otherwise(""), F.when(wide < 1e8, small).otherwise(F.format_string("%.7f", wide)))

    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(finite, F.concat(F.lit("["), F.array_join(F.transform(v, written), ","), F.lit("]")))
