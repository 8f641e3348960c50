"""Joins and nested results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def zero_filled_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Parents with a count column for each kind of child; children are counted before they are joined."""
    out = parents
    for name, (child, child_key) in children.items():
        counts = child.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def first_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in a total order; Spark cuts each task's part before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return first_n(df, key, order, 1)


def embed_many(parents: DataFrame, key: str, children: DataFrame, child_key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children nested as an array of structs in order of their fields, empty if there are none."""
    nested = children.groupBy(F.col(child_key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = parents.join(nested, F.col(key) == F.col("_k"), "left").drop("_k")
    return out.withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))


def lookup_in_order(lists: DataFrame, key: str, ids: str, rows: DataFrame, id_col: str, value: str) -> DataFrame:
    """For each list of ids the values found, in the list's order; ids that are not found are left out."""
    each = lists.select(key, F.posexplode(ids).alias("_pos", "_id"))
    found = each.join(rows.select(F.col(id_col).alias("_id"), F.col(value).alias("_value")), "_id")
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_value"))), lambda x: x["_value"]).alias("found_values"))


def first_source(keys: DataFrame, key: str, sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """For each key the value of the first source that has one: sources are (name, rows, key, value), one row a key."""
    out = keys
    for i, (_, rows, own_key, value) in enumerate(sources):
        out = out.join(rows.select(F.col(own_key).alias(key), F.col(value).cast("string").alias(f"_v{i}")), key, "left")
    hits = [F.col(f"_v{i}") for i in range(len(sources))]
    origin = reduce(lambda acc, i: F.when(hits[i].isNotNull(), sources[i][0]).otherwise(acc), reversed(range(len(sources))), F.lit(None).cast("string"))
    return out.select(key, F.coalesce(*hits).alias("found"), origin.alias("origin"))


def resolve_links(links: DataFrame, kinds: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Names behind (kind, ref_id) links, one join for each kind; links to nothing are left out."""
    parts = []
    for kind, (rows, key, label) in kinds.items():
        own = links.filter(F.col("kind") == kind)
        parts.append(own.join(rows.select(F.col(key).alias("ref_id"), F.col(label).alias("label")), "ref_id").select("kind", "ref_id", "label"))
    return reduce(DataFrame.unionByName, parts)


def fuzzy_names(names: DataFrame, name: str) -> DataFrame:
    """(name, other): names whose words are matched by another in two, or in their only one; not symmetric.

    Words are ranked by how many names have them. Two names with two words in common share one that
    is not the most frequent of either, so only the others of each are met; a name of one word meets
    all that have it. Candidates are then counted in full.
    """
    words = names.select(name, text.name_tokens(F.col(name)).alias("_t")).filter(F.size("_t") > 0)
    each = words.select(name, "_t", F.explode("_t").alias("_word"))
    counts = each.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    ranked = each.join(counts, "_word").withColumn("_from_last", F.row_number().over(Window.partitionBy(name).orderBy(F.desc("_n"), F.desc("_word"))))
    other = ranked.select(F.col(name).alias("other"), F.col("_t").alias("_u"), "_word", F.col("_from_last").alias("_their"))
    several = ranked.filter((F.size("_t") > 1) & (F.col("_from_last") > 1)).join(other.filter("_their > 1"), "_word")
    single = ranked.filter(F.size("_t") == 1).join(other, "_word")
    met = several.select(name, "_t", "other", "_u").union(single.select(name, "_t", "other", "_u")).filter(F.col(name) != F.col("other"))
    return met.filter(F.size(F.array_intersect("_t", "_u")) >= F.least(F.lit(2), F.size("_t"))).select(name, "other").distinct()


def fuzzy_groups(names: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """All links of ``fuzzy_names`` as groups instead of pairs: (members, groups).

    members: (``name``, member, words): each name with the smallest name of the same words, which
    stands for it. groups: (words, part, member, representative): two words with all that have both, which
    match each other (part ``both``); or one word, with the member that has no other (``from``),
    which matches all others that have it (``to``). Groups of one member are left out. A name of n
    words has n (n - 1) / 2 pairs, so the output follows the names and not their square, however
    frequent a word is. Names without words match nothing.
    """
    words = names.select(F.col(name), F.array_sort(text.name_tokens(F.col(name))).alias("_words")).filter(F.size("_words") > 0)
    sets = words.groupBy("_words").agg(F.min(name).alias("member"))
    members = words.join(sets, "_words").select(name, "member", F.col("_words").alias("words"))
    pairs = F.flatten(F.transform("_words", lambda a, i: F.transform(F.slice(F.col("_words"), i + 2, F.size("_words")), lambda b: F.concat(a, F.lit(" "), b))))
    both = sets.select(F.explode(pairs).alias("words"), F.lit("both").alias("part"), "member")
    single = sets.filter(F.size("_words") == 1).select(F.col("_words")[0].alias("words"))
    ones = sets.select(F.explode("_words").alias("words"), F.when(F.size("_words") == 1, "from").otherwise("to").alias("part"), "member").join(single, "words")
    parts = both.unionByName(ones)
    known = parts.groupBy("words").agg(F.count(F.lit(1)).alias("_n"), F.min("member").alias("representative")).filter("_n > 1")
    return members, parts.join(known, "words").select("words", "part", "member", "representative")


def grid(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row once for every review column (a short list), with the column's index."""
    return rows.select("*", F.posexplode(F.array(*map(F.lit, columns))).alias("column_index", "column_name"))


def review_table(cells: DataFrame, doc: str, index: str, columns: list[int], content: str = "content", citations: str = "citations") -> DataFrame:
    """A row a document with content and first citation of each column: c0, c0_source, …; empty where there is no cell.

    The columns are given, so that no job has to look for them.
    """
    cite = F.get(citations, F.lit(0))
    source = F.when(cite.isNull(), "").otherwise(F.concat(F.lit('"'), F.coalesce(cite["quote"], F.lit("")), F.lit('"'), F.when(F.coalesce(cite["page"], F.lit(0)) != 0, F.concat(F.lit(" (p. "), cite["page"].cast("string"), F.lit(")"))).otherwise("")))
    shown = cells.select(doc, index, F.coalesce(F.col(content), F.lit("")).alias("_content"), source.alias("_source"))
    wide = shown.groupBy(doc).pivot(index, columns).agg(F.max("_content").alias("content"), F.max("_source").alias("source"))
    return wide.select(doc, *[F.coalesce(f"{c}_content", F.lit("")).alias(f"c{c}") for c in columns], *[F.coalesce(f"{c}_source", F.lit("")).alias(f"c{c}_source") for c in columns])


def amendment_status(statutes: DataFrame, key: str, fetched: str, bills: DataFrame, order: list[str], bill: str, acted: str, state: str) -> DataFrame:
    """classification, bills and top bill of every statute: enacted since it was fetched, else pending, else clean.

    bills have ``key``; of those that count, the first in ``order`` is the top one. Bills enacted
    before count as none, and so do failed ones. A statute that was never fetched has been changed by any enacted bill.
    """
    both = bills.join(statutes.select(key, fetched), key)
    newer = (F.col(state) == "enacted") & (F.col(fetched).isNull() | (F.coalesce(F.col(acted) > F.col(fetched), F.lit(False))))
    first = lambda hit: F.min_by(F.when(hit, F.col(bill)), F.when(hit, F.struct(*order)))
    counts = both.groupBy(key).agg(F.count_if(newer).alias("_e"), F.count_if(F.col(state) == "pending").alias("_p"), first(newer).alias("_et"), first(F.col(state) == "pending").alias("_pt"))
    pick = lambda e, p, none: F.when(F.col("_e") > 0, e).when(F.col("_p") > 0, p).otherwise(none)
    out = statutes.join(counts, key, "left")
    return out.select(*statutes.columns, pick("enacted", "pending", "clean").alias("classification"), pick(F.col("_e"), F.col("_p"), 0).alias("bills"), pick(F.col("_et"), F.col("_pt"), None).alias("top_bill"))
