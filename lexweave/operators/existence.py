"""Do cited cases exist? Staged matching of citations against a table of known cases.

Each distinct location (volume, reporter, page) is looked up once, by the first stage that has an
answer: an exact equal citation, then a citation with the same volume and page that contains the
reporter, then, for citations without a name, one that contains all three run together. Locations
found are checked by name; of those not found, the name alone may be known elsewhere. Every stage is
an equi-join on a key, so no citation meets all cases. Verdicts go back to all citations of a
location. Joins are by shuffle and sorting (``merge``): known cases may be many, and their citations
and pairs of numbers are more than the table's size in files lets Spark expect.

citations: id, case_name, volume, reporter, page (strings), citation_type; known: case_id,
case_name, citations (array of strings). The known cases stand for the web service that the
reference asks; its statuses for failed calls have no counterpart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import drafts

# Reporters that the service does not cover.
NOT_COVERED = ["Ex.", "Eng. Rep.", "Ch.", "K.B.", "Q.B.", "A.C.", "WLR", "WL", "LEXIS", "U.S. App. LEXIS"]
# Statuses.
VERIFIED, NOT_FOUND, UNCERTAIN, NOT_APPLICABLE = "existence_verified", "existence_not_found", "existence_uncertain", "not_applicable"
NAME_MISMATCH, LOCATION_MISMATCH = "existence_name_mismatch", "existence_location_mismatch"
# Types that are stored.
TYPES = ["case", "statute", "regulation", "constitutional", "book", "periodical", "internet", "court_document", "short_form_id", "short_form_supra", "short_form_case", "unknown"]
# The rule and the table that govern each kind of source.
GOVERNING = {
    "book": ("BB R. 15", None),
    "article": ("BB R. 16", "T13"),
    "manuscript": ("BB R. 17.1", None),
    "forthcoming": ("BB R. 17.2", None),
    "news_article": ("BB R. 18.2", None),
    "internet": ("BB R. 18", None),
    "constitutional": ("BB R. 11", None),
    "legislative_report": ("BB R. 13.4", None),
    "legislative_hearing": ("BB R. 13.3", None),
    "cong_rec": ("BB R. 13.5", None),
    "bill": ("BB R. 13.2", None),
    "fed_reg": ("BB R. 14.2", None),
    "exec_order": ("BB R. 14.7", None),
    "foreign_case": ("BB R. 20", None),
    "multilateral_treaty": ("BB R. 21.4", None),
    "bilateral_treaty": ("BB R. 21.4", None),
    "icj_case": ("BB R. 21", None),
    "echr_case": ("BB R. 21", None),
    "tribunal_case": ("BB R. 21", None),
    "tcm_case": ("BB R. 10", None),
}
#: Types that have a rule by family where their own is not listed.
FAMILIES = {"secondary": "BB R. 18", "official": "BB R. 11", "foreign": "BB R. 20"}

LOCATION = ["volume", "reporter", "page"]


def spaced(text: Column) -> Column:
    """Single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squashed(text: Column) -> Column:
    """No spaces, lower case."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def present(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def cites_of(known: DataFrame) -> DataFrame:
    """(case_id, known_name, cite): a row a citation of each known case."""
    return known.select("case_id", F.col("case_name").alias("known_name"), F.explode("citations").alias("cite")).filter(present(F.col("cite"))).withColumn("cite", spaced(F.col("cite")))


def first_case(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's hits the case with the smallest id."""
    return hits.groupBy(*keys).agg(F.min(F.struct("case_id", "known_name", "cite")).alias("hit"))


def by_equal_cite(locations: DataFrame, cites: DataFrame) -> DataFrame:
    return first_case(locations.withColumn("cite", F.concat_ws(" ", *map(spaced, map(F.col, LOCATION)))).join(cites.hint("merge"), "cite"), LOCATION)


def numbered(cites: DataFrame) -> DataFrame:
    """Citations once for each ordered pair of the numbers in them, as (low, high): a location's volume and page."""
    numbers = F.regexp_extract_all("cite", F.lit(r"\d+"), F.lit(0))
    pairs = cites.select("*", F.posexplode(numbers).alias("_i", "low")).select("*", F.posexplode(numbers).alias("_j", "high"))
    return pairs.filter("_i <> _j").drop("_i", "_j")


def by_parts(locations: DataFrame, pairs: DataFrame) -> DataFrame:
    """The volume stands before a space, the page behind one, and the reporter somewhere, spaces aside."""
    met = locations.join(pairs.hint("merge"), (F.col("low") == F.trim("volume")) & (F.col("high") == F.trim("page")))
    whole = lambda before, c, after: F.rlike("cite", F.concat(F.lit(before), F.trim(F.col(c)), F.lit(after)))
    return first_case(met.filter(whole("(^|[^0-9])", "volume", " ") & whole(" ", "page", "([^0-9A-Za-z]|$)") & F.contains(squashed(F.col("cite")), squashed(F.col("reporter")))), LOCATION)


def by_run(locations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Volume, reporter and page stand together, spaces aside."""
    met = locations.join(pairs.hint("merge"), (F.col("low") == F.trim("volume")) & (F.col("high") == F.trim("page")))
    return first_case(met.filter(F.contains(squashed(F.col("cite")), squashed(F.concat(*LOCATION)))), LOCATION)


def name_key(name: Column) -> Column:
    """The folded words of a name in order of the alphabet."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(drafts.folded_name(name), " "))), " ")


def resolve(citations: DataFrame, known: DataFrame, by_name: bool = False) -> DataFrame:
    """Every citation with status, stage, case_id and known_name.

    Stages: ``type`` and ``reporter`` (nothing to look up), ``incomplete``, ``exact``, ``parts``,
    ``run``, ``name`` and ``none``. With ``by_name`` a case that is known by its whole folded name
    at another place is a location mismatch; the reference names that status but never gives it.
    """
    complete = present(F.col("volume")) & present(F.col("reporter")) & present(F.col("page"))
    kind = F.when(F.col("citation_type") != "case", "type").when(~complete, "incomplete").when(F.trim("reporter").isin(NOT_COVERED), "reporter")
    typed = citations.withColumn("_kind", kind)
    asked = typed.filter(F.col("_kind").isNull())
    locations = asked.groupBy(*LOCATION).agg(F.bool_or(~present(F.col("case_name"))).alias("nameless"))
    cites = cites_of(known)
    pairs = numbered(cites)
    exact = by_equal_cite(locations, cites).withColumn("stage", F.lit("exact"))
    left = locations.join(exact.hint("merge"), LOCATION, "left_anti")
    parts = by_parts(left, pairs).withColumn("stage", F.lit("parts"))
    left = left.join(parts.hint("merge"), LOCATION, "left_anti").filter("nameless")
    run = by_run(left, pairs).withColumn("stage", F.lit("run"))
    found = exact.unionByName(parts).unionByName(run)
    met = typed.join(found.hint("merge"), LOCATION, "left")
    hit = F.col("_kind").isNull() & F.col("hit").isNotNull() & ((F.col("stage") != "run") | ~present(F.col("case_name")))
    out = met.withColumn("hit", F.when(hit, F.col("hit"))).withColumn("stage", F.when(hit, F.col("stage")))
    if by_name:
        names = known.filter(present(F.col("case_name"))).groupBy(name_key(F.col("case_name")).alias("_name")).agg(F.min(F.struct("case_id", F.col("case_name").alias("known_name"), F.get("citations", F.lit(0)).alias("cite"))).alias("_elsewhere"))
        key = F.when(F.col("_kind").isNull() & F.col("hit").isNull() & present(F.col("case_name")), name_key(F.col("case_name")))
        apart = F.concat(F.lit("\0"), F.xxhash64(*citations.columns).cast("string"))  # rows without a name to look up are dealt to all tasks
        out = out.withColumn("_name", F.coalesce(key, apart)).join(names.hint("merge"), "_name", "left").drop("_name")
    else:
        out = out.withColumn("_elsewhere", F.lit(None).cast(met.schema["hit"].dataType))
    same = ~present(F.col("case_name")) | ~present(F.col("hit.known_name")) | (drafts.case_overlap(F.col("case_name"), F.col("hit.known_name")) >= drafts.SAME_CASE)
    status = F.when(F.col("_kind") == "incomplete", NOT_FOUND).when(F.col("_kind").isNotNull(), NOT_APPLICABLE).when(F.col("hit").isNotNull(), F.when(same, VERIFIED).otherwise(NAME_MISMATCH)).when(F.col("_elsewhere").isNotNull(), LOCATION_MISMATCH).otherwise(NOT_FOUND)
    stage = F.coalesce("_kind", "stage", F.when(F.col("_elsewhere").isNotNull(), "name").otherwise("none"))
    case = F.coalesce("hit", "_elsewhere")
    return out.select(*citations.columns, status.alias("status"), stage.alias("stage"), case["case_id"].alias("case_id"), case["known_name"].alias("known_name"), case["cite"].alias("known_cite"))


def stored_status(status: Column) -> Column:
    """What is stored: both mismatches are uncertain, an absent status is not applicable."""
    return F.when(status.isin(NAME_MISMATCH, LOCATION_MISMATCH), UNCERTAIN).otherwise(F.coalesce(F.nullif(status, F.lit("")), F.lit(NOT_APPLICABLE)))


def stored_type(kind: Column) -> Column:
    return F.when(kind.isin(TYPES), kind).otherwise("unknown")


def flag_kind(status: Column, has_format_error: Column) -> Column:
    """name, location or unresolved; null where nothing is said: an unresolved citation that has a format error is left alone."""
    unresolved = status.isin(NOT_FOUND, UNCERTAIN) & ~F.coalesce(has_format_error, F.lit(False))
    return F.when(status == NAME_MISMATCH, "name").when(status == LOCATION_MISMATCH, "location").when(unresolved, "unresolved")


def governed(citations: DataFrame, kind: str = "citation_type", family: str = "family") -> DataFrame:
    """Citations with governing_rule and governing_table of their type, else the rule of their family; null for cases."""
    rows = [(k, rule, table) for k, (rule, table) in GOVERNING.items()]
    rules = citations.sparkSession.createDataFrame(rows, "_type string, _rule string, governing_table string")
    families = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    joined = citations.join(F.broadcast(rules), F.col(kind) == F.col("_type"), "left")  # a fixed table
    return joined.withColumn("governing_rule", F.coalesce("_rule", F.try_element_at(families, F.col(family)))).drop("_type", "_rule")
