"""Predictions graded against an answer key."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


#: Errors of a key whose patterns one pass looks for; a longer key takes several passes.
KEY_BLOCK = 5_000


def finder(patterns: dict[str, list[int]]):
    """A function from a text to the numbers whose patterns it holds, by one automaton over all of them; an empty pattern is in every text."""
    automaton = ahocorasick.Automaton()
    for pattern, numbers in patterns.items():
        if pattern:
            automaton.add_word(pattern, numbers)
    automaton.make_automaton()
    always = set(patterns.get("", []))

    def find(text: str | None) -> set[int]:
        if text is None:
            return set()
        return always.union(*(numbers for _, numbers in automaton.iter(text))) if len(automaton) else set(always)

    return find


def by_pattern(rows: list, field: str) -> dict[str, list[int]]:
    """{pattern: numbers of the errors that have it}"""
    out: dict[str, list[int]] = {}
    for n, r in enumerate(rows):
        for pattern in set(r[field] or []):
            if pattern is not None:
                out.setdefault(pattern, []).append(n)
    return out


def scorer(shared: Broadcast):
    """A column function of (anchor, body): the errors that they catch, with scores."""

    @F.pandas_udf("array<struct<n:int,score:int>>")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        anchors, rules, words = (finder(patterns) for patterns in shared.value)  # once a task

        def hits(anchor: str | None, body: str | None) -> list[dict]:
            near = anchors(anchor)
            if not near or body is None:
                return []
            named = near & rules(body.replace(" ", ""))
            return [{"n": n, "score": 2 if n in named else 1} for n in sorted(named | (near & words(body)))]

        for anchor, body in batches:
            yield pd.Series([hits(a, b) for a, b in zip(anchor, body)], dtype=object)

    return scored


def matches(comments: DataFrame, comment_id: str, key: DataFrame) -> DataFrame:
    """``catches`` with their score: 2 if the rule is named, else 1.

    All anchors, rules and words of the key are looked for at once, in one pass over each comment:
    three automata, of KEY_BLOCK errors at most, go to the tasks; no comment is joined with all errors.
    """
    spark, kind = comments.sparkSession, key.schema["error_id"].dataType.simpleString()
    rule = F.coalesce(F.replace(F.lower("rule"), F.lit(" "), F.lit("")), F.lit(""))
    rules = F.when(rule == "", F.array().cast("array<string>")).otherwise(F.array(rule))
    known = key.select("error_id", F.transform("anchors", plain).alias("anchors"), rules.alias("rules"), F.transform("keywords", lambda w: F.lower(w)).alias("words"))
    texts = comments.select(comment_id, plain(F.col("anchor")).alias("anchor"), plain(F.col("body")).alias("body"))
    rows, found = known.toLocalIterator(), spark.createDataFrame([], comments.select(comment_id).schema.add("error_id", key.schema["error_id"].dataType).add("score", IntegerType()))
    while block := list(islice(rows, KEY_BLOCK)):
        shared = spark.sparkContext.broadcast([by_pattern(block, field) for field in ("anchors", "rules", "words")])
        own = F.broadcast(spark.createDataFrame([(n, r["error_id"]) for n, r in enumerate(block)], f"n int, error_id {kind}"))  # KEY_BLOCK rows at most
        hit = texts.select(comment_id, F.explode(scorer(shared)("anchor", "body")).alias("hit"))
        found = found.unionByName(hit.select(comment_id, "hit.n", "hit.score").join(own, "n").select(comment_id, "error_id", "score"))
    return found


def catches(comments: DataFrame, comment_id: str, key: DataFrame) -> DataFrame:
    """(``comment_id``, error_id) where an anchor of the error stands in the comment's anchor, and its rule or a word of it in the body.

    comments: anchor, body; key: error_id, anchors, rule, keywords.
    """
    return matches(comments, comment_id, key).select(comment_id, "error_id")


def one_to_one(pairs: DataFrame, comment_id: str, errors: int) -> DataFrame:
    """(``comment_id``, error_id): each error in order of its id takes its best comment that is still free, ties by comment id.

    Errors take one comment each, so of each error's matches the best ``errors`` are enough; one
    task gets these, the square of a page written by hand.
    """
    best = Window.partitionBy("error_id").orderBy(F.desc("score"), comment_id)
    few = pairs.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= errors)

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        taken: dict = {}
        for error, own in rows.sort_values(["error_id", "_n"]).groupby("error_id", sort=True):
            free = next((c for c in own[comment_id] if c not in taken), None)
            if free is not None:
                taken[free] = error
        return pd.DataFrame({comment_id: list(taken), "error_id": list(taken.values())})

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (comment_id, "error_id")}
    return few.groupBy().applyInPandas(take, ", ".join(f"`{c}` {t}" for c, t in kinds.items()))


def verdicts(comments: DataFrame, comment_id: str, key: DataFrame, controls: list[str] | None = None) -> DataFrame:
    """Each comment's ``comment_id``, verdict (catch, duplicate, false positive), error_id and on_control.

    A duplicate matches an error, but none was left for it. ``controls`` are anchors without an
    error; on_control tells false positives on one of them.
    """
    pairs = matches(comments, comment_id, key)
    # ``caught`` has a row an error of the key at most
    first = pairs.groupBy(comment_id).agg(F.min("error_id").alias("_first"))
    caught = one_to_one(pairs, comment_id, key.count()).withColumnRenamed("error_id", "_caught")
    rows = comments.join(first, comment_id, "left").join(F.broadcast(caught), comment_id, "left")
    verdict = F.when(F.col("_caught").isNotNull(), "catch").when(F.col("_first").isNotNull(), "duplicate").otherwise("false positive")
    near = F.lit(False)
    for c in controls or []:
        near |= F.coalesce(F.contains(plain(F.col("anchor")), plain(F.lit(c))), F.lit(False))
    return rows.select(comment_id, verdict.alias("verdict"), F.coalesce("_caught", "_first").alias("error_id"), (near & (verdict == "false positive")).alias("on_control"))


def misses(judged: DataFrame, key: DataFrame) -> DataFrame:
    """Errors of the key that no comment caught."""
    return key.join(F.broadcast(judged.filter("verdict = 'catch'").select("error_id")), "error_id", "left_anti")


def grade_one_to_one(comments: DataFrame, comment_id: str, key: DataFrame, controls: list[str] | None = None) -> DataFrame:
    """One row: comments, real_catches (distinct errors), duplicates, false_positives, on_control, misses, planted, precision, recall."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    sums = verdicts(comments, comment_id, key, controls).agg(F.count(F.lit(1)).alias("comments"), n("catch").alias("real_catches"), n("duplicate").alias("duplicates"), n("false positive").alias("false_positives"), F.count(F.when(F.col("on_control"), 1)).alias("on_control"))
    planted = key.agg(F.count(F.lit(1)).alias("planted"))
    one = sums.join(F.broadcast(planted), F.lit(True))  # one row each
    caught = F.col("real_catches")
    return one.select(*sums.columns, (F.col("planted") - caught).alias("misses"), "planted", ratio(caught, F.col("comments")).alias("precision"), ratio(caught, F.col("planted")).alias("recall"))


def ratio(part: Column, whole: Column) -> Column:
    """Three digits; 1 if there was nothing to find."""
    return F.when(whole == 0, 1.0).otherwise(F.round(part / whole, 3))
