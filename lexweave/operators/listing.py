"""Filters, sorts, facets and pages of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 200


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Filter by every condition that is given; None stands for a parameter left out."""
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def contains(column: Column | str, needle: str, strip_wildcards: bool = False) -> Column:
    """Case-insensitive substring test. % and _ are plain characters, or are taken out of the needle."""
    if strip_wildcards:
        needle = needle.replace("%", "").replace("_", "")
    return F.contains(F.lower(column), F.lit(needle.lower()))


def blob_contains(columns: list[str], needle: str) -> Column:
    """Substring test over several columns joined by spaces, nulls as empty text."""
    return F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), F.lit(needle.lower()))


def rank(column: Column | str, ordered: list[str], unknown: int) -> Column:
    """Place of a value in a list (from 0), ``unknown`` for others and null: how enumerated values sort."""
    values = F.create_map(*[F.lit(x) for k, v in enumerate(ordered) for x in (v, k)])
    return F.coalesce(F.element_at(values, F.col(column) if isinstance(column, str) else column), F.lit(unknown))


def due_within(column: Column | str, as_of: Column, days: int) -> Column:
    """Not null and no later than ``days`` after ``as_of``; what is overdue counts."""
    return F.col(column).isNotNull() & (F.col(column) <= as_of + F.make_interval(days=F.lit(days)))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of at most 200 rows in a total order."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(max(1, min(limit, MAX_PAGE)))


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page, each row with the number of all rows that matched."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, limit, offset).join(F.broadcast(total), F.lit(True))  # one row


def facet(df: DataFrame, column: str) -> DataFrame:
    """Values of a column with their counts; null and empty ones are left out."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("facet_value")).agg(F.count(F.lit(1)).alias("n"))


def owned(df: DataFrame, viewer: Column, owner: str) -> DataFrame:
    return df.filter(F.col(owner) == viewer)


def visible_through(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is among the visible parents."""
    return child.join(parent.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_semi")


def age_bucket(ts: Column, as_of: Column) -> Column:
    """active within a day, dormant after 14 days or without a time, else idle."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    return F.when(ts.isNull(), "dormant").when(seconds < 86400, "active").when(seconds > 14 * 86400, "dormant").otherwise("idle")


def calendar_bucket(ts: Column, as_of: Column) -> Column:
    """Today and Yesterday by calendar day, then Last week by seven times 24 hours, else Older."""
    days = F.datediff(F.to_date(as_of), F.to_date(ts))
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(seconds < 7 * 86400, "Last week").otherwise("Older")


def compact_money(x: Column) -> Column:
    """$1.2M, $3K, $12: millions with one digit, thousands and less whole; empty for null and zero."""
    return (
        F.when(x.isNull() | (x == 0), "")
        .when(x >= 1_000_000, F.concat(F.lit("$"), F.regexp_replace(F.format_string("%.1f", x / 1_000_000), r"\.0$", ""), F.lit("M")))
        .when(x >= 1_000, F.concat(F.lit("$"), F.round(x / 1_000).cast("long").cast("string"), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.round(x).cast("long").cast("string")))
    )


#: Groups of a list by day, in the order in which they are shown.
DAYS = ["Today", "Yesterday", "Last week", "Older"]


def day_group(ts: Column, now: Column) -> Column:
    """Calendar days come first, then seven times 24 hours; null is old."""
    days = F.datediff(now, ts)
    week = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")) < 7 * 86_400_000_000
    return F.when(days == 0, DAYS[0]).when(days == 1, DAYS[1]).when(week, DAYS[2]).otherwise(DAYS[3])
