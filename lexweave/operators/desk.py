"""What lists, reviews and findings need: filters, defaults, sorts, joins to one, and merges by place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bands

#: Severities and choices that comparisons know, and their defaults.
CHANGES = (["addition", "deletion", "modification", "equivalent"], "modification")
SEVERITIES = (["high", "medium", "low", "info"], "medium")
RECOMMENDATIONS = (["accept", "reject", "negotiate"], "negotiate")
#: Labels of a document from its worst citation.
LABELS = ("Draft NOT cleared for filing — open ✗ items remain", "Corrections pending drafting review", "Cleared for drafting sign-off upon completion of attestation packet")


def not_true(flag: Column) -> Column:
    """Null or false."""
    return ~F.coalesce(flag, F.lit(False))


def clamp(value: Column, known: tuple[list[str], str]) -> Column:
    """A value of a list, else the default."""
    return F.when(value.isin(known[0]), value).otherwise(known[1])


def cut_items(items: Column, most: int, length: int) -> Column:
    """The first ``most`` items, each cut to ``length`` characters."""
    return F.transform(F.slice(items, 1, most), lambda x: F.left(x, F.lit(length)))


def coded(code: str, jurisdiction: Column, state: Column, court: Column, label: Column) -> Column | None:
    """The filter that a code stands for: state:…, court:… (federal, by court or label), juris:…; None for all."""
    kind, _, value = code.partition(":")
    if kind == "state":
        return (jurisdiction == "state") & (state == value)
    if kind == "court":
        return (jurisdiction == "federal") & (F.coalesce(F.nullif(court, F.lit("")), label, F.lit("")) == value)
    return jurisdiction == value if kind == "juris" else None


def finding_problem(least: int = 10) -> Column:
    """Why a finding is not complete, or null: rationale, position, fallback, walkaway, playbook fit."""
    short = lambda c, n: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) < n
    grave = F.lower("severity").isin("blocker", "major")
    existential = F.coalesce(F.col("existential"), F.lit(False))
    fits = F.coalesce(F.col("playbook_fit").isin("applies", "applies_with_modification"), F.lit(False))
    return (
        F.when(short("materiality_rationale", least), "materiality_rationale")
        .when(short("position", 3), "position")
        .when((F.coalesce(grave, F.lit(False)) | existential) & (F.coalesce("fallback", F.lit("")) == ""), "fallback")
        .when(existential & (F.coalesce("walkaway", F.lit("")) == ""), "walkaway")
        .when((F.coalesce(F.size("profile_refs"), F.lit(0)) > 0) & ~fits, "playbook_fit")
    )


def first_given(*columns: str) -> Column:
    """The first of several names of a field that holds something."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def to_one(rows: DataFrame, key: str, others: DataFrame, other_key: str, fields: list[str], name: str) -> DataFrame:
    """Rows with the one other row that they point to as a struct, null if there is none."""
    one = others.select(F.col(other_key).alias("_k"), F.struct(*fields).alias(name))
    return rows.join(one, F.col(key) == F.col("_k"), "left").drop("_k")


def page_at(offsets: DataFrame, doc: str, offset: str, pages: DataFrame, start: str) -> DataFrame:
    """Offsets with the number (from 1) of the page they lie on: the last start that is not behind them; 0 before the first.

    Offsets and starts of a document stand in one order, so no offset meets all starts. Pages that
    start at one place count each. Null without pages, for a null offset 0.
    """
    nth = F.row_number().over(Window.partitionBy(doc).orderBy(start))
    known = pages.filter(F.col(start).isNotNull()).select(F.col(doc), F.col(start), nth.alias("page"))
    paged = pages.select(F.col(doc)).distinct().withColumn("_paged", F.lit(True))
    found = bands.last_at(offsets, doc, offset, known, start, ["page"]).join(paged, doc, "left")
    return found.withColumn("page", F.when(F.col("_paged"), F.coalesce("page", F.lit(0)))).drop("_paged")


def status_label(broken: Column, review: Column) -> Column:
    return F.when(broken > 0, LABELS[0]).when(review > 0, LABELS[1]).otherwise(LABELS[2])


def string_cites(cites: DataFrame, doc: str, order: list[Column], before: str) -> DataFrame:
    """Add string_cite: the text before a cite ends in a semicolon, or that before the next one does."""
    own = F.coalesce(F.col(before).rlike(r";\s*\z"), F.lit(False))
    return cites.withColumn("string_cite", own | F.coalesce(F.lead(own).over(Window.partitionBy(doc).orderBy(*order)), F.lit(False)))


def runs_to(paragraphs: DataFrame, doc: str, order: str, text: str, needle: Column, most: int = 6) -> DataFrame:
    """Paragraphs with last: the place of the nearest paragraph, up to ``most`` on, where a needle is within the texts from here on; null if there is none."""
    w = Window.partitionBy(doc).orderBy(order)
    out = paragraphs.withColumn("_run", F.collect_list(text).over(w.rowsBetween(0, most - 1)))
    sums = F.transform(F.sequence(F.lit(1), F.size("_run")), lambda n: F.array_join(F.slice("_run", F.lit(1), n), " "))
    return out.withColumn("last", F.col(order) + F.get(F.filter(F.transform(sums, lambda t, i: F.when(t.contains(needle), i)), lambda i: i.isNotNull()), F.lit(0))).drop("_run")


def named_or_numbered(refs: DataFrame, key: str, ref: str, findings: DataFrame, ordinal: str, name: str, most: int = 3) -> DataFrame:
    """The findings that the first three references of each row mean: a number is a place, all else an id (its first)."""
    each = refs.select(key, F.posexplode(F.slice(ref, 1, most)).alias("position", "_ref"))
    firsts = findings.withColumn("_nth", F.row_number().over(Window.partitionBy(key, name).orderBy(ordinal)))
    by_place = findings.select(F.col(key).alias("_k"), F.col(ordinal).cast("string").alias("_r"), F.col(ordinal).alias("found"))
    by_name = firsts.filter("_nth = 1").select(F.col(key).alias("_k"), F.concat(F.lit("id:"), F.col(name)).alias("_r"), F.col(ordinal).alias("found"))
    wanted = each.withColumn("_ref", F.when(F.col("_ref").rlike(r"^\d+$"), F.col("_ref")).otherwise(F.concat(F.lit("id:"), F.col("_ref"))))
    return wanted.join(by_place.unionByName(by_name), (F.col(key) == F.col("_k")) & (F.col("_ref") == F.col("_r"))).select(key, "position", "found")


def in_order(column: str, ordered: list[str], unknown: int) -> Column:
    """Place in a list for sorting, as ``listing.rank``; the list is short."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ordered)), F.col(column)), F.lit(0)) - 1, F.lit(unknown)).cast("int")


def numbered(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of a list in its order, numbered from 1."""
    return rows.orderBy(*order).limit(most).withColumn("n", F.row_number().over(Window.orderBy(*order)))  # ``most`` rows


def decide(edits: DataFrame, runs: DataFrame, run: str, owner: Column, wanted: Column, status: str, to: str) -> DataFrame:
    """Edits with the new status where they are wanted and their run has the owner; all others as they were."""
    mine = runs.filter(owner).select(F.col(run).alias("_run")).distinct()
    told = edits.join(mine.withColumn("_mine", F.lit(True)), F.col(run) == F.col("_run"), "left")
    return told.withColumn(status, F.when(F.coalesce(F.col("_mine"), F.lit(False)) & wanted, to).otherwise(F.col(status))).drop("_run", "_mine")


def by_place(rows: DataFrame, doc: str, ordinal: str, output: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Rows with a model's output for their place; where it gave none, defaults."""
    told = output.select(F.col(doc).alias("_d"), F.col(ordinal).alias("_o"), *[F.col(c).alias(f"_{c}") for c in defaults])
    out = rows.join(told, (F.col(doc) == F.col("_d")) & (F.col(ordinal) == F.col("_o")), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_{c}"), d).alias(c) for c, d in defaults.items()])


def fresh(cache: DataFrame, until: str, as_of: Column, needs: str) -> DataFrame:
    """Entries of a cache that hold at a time and are not empty."""
    return cache.filter((F.col(until) >= as_of) & (F.coalesce(F.col(needs), F.lit("")) != ""))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
