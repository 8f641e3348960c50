"""Operator 7: URL filters by a temporal list join. DataFrame functions only.

A list is a log of dated entries: a host or domain is added to or removed from a block or allow list.
Entries become validity intervals, and a capture is judged by those that hold at its fetch time.
Among them the most specific name decides, and allow before block for one name.

Names and times meet per month: an interval is a row in each month that it touches and in which its
name was asked, the distinct (host, month) pairs of the captures collect their names' intervals of
that month, and captures look theirs up. So a host with a third of all captures is one small row on the looked-up side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, join_small, join_unique

FOREVER = "2999-12-31 00:00:00"
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[\]]+)"
#: Hosts that are addresses: four numbers, or one in brackets.
ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\])$"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dot; null if there is none. IPv6 addresses keep their brackets."""
    host = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), r"\.$", "")
    return F.when(host != "", host)


def names_of(host: Column) -> Column:
    """The host and the domains above it, down to two labels; a host of one label, and an address, only itself."""
    parts = F.split(host, r"\.")
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """list, name, since, until (exclusive) from dated entries (list, name, action, at).

    An entry holds until the next one of its list and name. At one time a removal comes after an
    addition. Entries with a null in any of the four are void.
    """
    own = entries.select("list", "name", "action", "at").dropna().distinct()
    w = Window.partitionBy("list", "name").orderBy("at", "action")
    spans = own.withColumn("until", F.coalesce(F.lead("at").over(w), F.lit(FOREVER).cast("timestamp"))).filter(F.col("action") == "add")
    return spans.filter(F.col("at") < F.col("until")).select("list", "name", F.col("at").alias("since"), "until")


def month(t: Column) -> Column:
    return F.year(t) * 12 + F.month(t) - 1


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Judge every capture by the entries that hold at its fetch time.

    Returns ``id_col``, url, fetched, host, matched (the deciding name), listed_since, blocked. A
    null or relative URL has no host; without host, time or entry the capture is not blocked. Rows
    stay as they are, repeated ones too; other columns are not read; empty tables give no rows (or
    no blocks).
    """
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.col(time_col).cast("timestamp").alias("fetched"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("_m", month(F.col("fetched"))).withColumn("_key", F.concat_ws("|", F.when(F.col("_m").isNotNull(), F.col("host")), F.col("_m").cast("string")))
    rows = checkpoint(rows.withColumn("_key", F.when(F.col("host").isNotNull() & F.col("_m").isNotNull(), F.col("_key"))))
    asked = rows.filter(F.col("_key").isNotNull()).select("_key", "host", "_m").distinct()
    seen = checkpoint(asked)
    pair = F.concat_ws("|", "name", F.col("_m").cast("string")).alias("_pair")
    named = checkpoint(seen.withColumn("name", F.explode(names_of(F.col("host")))).select("_key", "name", "_m", pair))
    # A name's intervals go only to the months in which it was asked, so that an open end costs nothing.
    wanted = named.select("name", "_m", "_pair").distinct()
    spans = intervals(entries).join(wanted, "name").filter((month(F.col("since")) <= F.col("_m")) & (F.col("_m") <= month(F.col("until"))))
    rule = F.struct(F.size(F.split("name", r"\.")).alias("labels"), (F.col("list") == "allow").alias("allow"), "since", "until", "name")
    told = checkpoint(spans.groupBy("_pair").agg(F.collect_list(rule).alias("_told")))
    # A name may stand above a third of all hosts: one row a pair on the right, hot pairs apart.
    rules = join_unique(named, told, "_pair").groupBy("_key").agg(F.flatten(F.collect_list("_told")).alias("_rules"))
    out = join_small(rows, rules, "_key", "left")
    held = F.filter("_rules", lambda r: (r["since"] <= F.col("fetched")) & (F.col("fetched") < r["until"]))
    out = out.withColumn("_best", F.array_max(held))
    return out.select(F.col("_id").alias(id_col), "url", "fetched", "host", F.col("_best.name").alias("matched"), F.col("_best.since").alias("listed_since"), F.coalesce(~F.col("_best.allow"), F.lit(False)).alias("blocked"))


def digits(x: Column, most: int) -> Column:
    """A number from 0 to most - 1 that follows from a text: seven hex digits of its MD5."""
    return F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % most


def dated_captures(pages: DataFrame) -> DataFrame:
    """The test pages with a fetch time: a second of 2024 that follows from the page id, as the table has none."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + digits(F.col("page_id"), 366 * 86400)).alias("fetched"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the test pages, as no table has one.

    A quarter of the sites is blocked from a day of January to April for 60 days and again from day
    250 on; every second host of a blog is allowed from day 100 on.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct().filter("host is not null")
    site = F.regexp_replace("host", r"^(www|blog|m)\.", "")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    sites = hosts.select(site.alias("name")).distinct().filter(digits(F.col("name"), 4) == 0).withColumn("d", digits(F.concat(F.lit("d"), F.col("name")), 120))
    turn = lambda action, n: F.struct(F.lit(action).alias("action"), day(n).alias("at"))
    turns = F.array(turn("add", F.col("d")), turn("remove", F.col("d") + 60), turn("add", F.lit(250)))
    block = sites.select(F.lit("block").alias("list"), "name", F.explode(turns).alias("t")).select("list", "name", "t.action", "t.at")
    allow = hosts.filter(F.col("host").startswith("blog.") & (digits(F.col("host"), 2) == 0)).select(F.lit("allow").alias("list"), F.col("host").alias("name"), F.lit("add").alias("action"), day(F.lit(100)).alias("at"))
    return block.unionByName(allow)
