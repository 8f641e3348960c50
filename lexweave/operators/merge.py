"""Writes as new DataFrames: upserts, guarded updates, deletions and status transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Base rows with the changes merged in: a change replaces the row of its key; of several the last in ``order`` stands."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        changes = changes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows and the new ones whose key is not there yet."""
    return base.unionByName(new.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def set_single(df: DataFrame, owner: str, chosen: Column, flag: str) -> DataFrame:
    """Set a flag on the chosen row of an owner and take it from the owner's others; owners without a choice keep theirs."""
    changed = df.filter(chosen).select(owner).distinct().withColumn("_changed", F.lit(True))
    out = df.withColumn("_chosen", F.coalesce(chosen, F.lit(False))).join(changed, owner, "left")
    return out.withColumn(flag, F.when(F.col("_changed"), F.col("_chosen")).otherwise(F.col(flag))).drop("_chosen", "_changed")


#: Order of a case's states.
CASE_STATES = ["pending", "fetched", "annotated", "published"]


def case_state(has_opinion: Column, has_annotation: Column, has_published: Column) -> Column:
    """The furthest state whose predecessors were all reached: each step only follows the one before it."""
    return F.when(~has_opinion, CASE_STATES[0]).when(~has_annotation, CASE_STATES[1]).when(~has_published, CASE_STATES[2]).otherwise(CASE_STATES[3])


def decisions(diffs: DataFrame) -> DataFrame:
    """Add action, source_text, suggested_text and skipped to compared passages.

    diffs have user_choice, change_type, proposed_text, base_text and user_custom_text; null is a
    pending choice, a modification, an empty text. An action replaces, deletes or inserts; without
    one nothing is to be done: the choice is pending or accepts the proposal, or a text is missing.
    skipped tells additions without a proposal and deletions without a base from the others.
    """
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\A\s+|\s+\z", "")
    proposed, base, custom = text("proposed_text"), text("base_text"), text("user_custom_text")
    choice = F.coalesce(F.nullif("user_choice", F.lit("")), F.lit("pending"))
    change = F.coalesce(F.nullif("change_type", F.lit("")), F.lit("modification"))
    own = F.when((choice == "custom") & (custom != ""), custom).otherwise(base)
    told = lambda action, source, suggested: F.struct(F.lit(action).alias("action"), source.alias("source_text"), suggested.alias("suggested_text"), F.lit(None).cast("string").alias("skipped"))
    skip = lambda why: F.struct(*[F.lit(None).cast("string").alias(c) for c in ("action", "source_text", "suggested_text")], F.lit(why).alias("skipped"))
    none = F.lit("")
    what = (
        F.when(choice.isin("pending", "accept_proposed"), None)
        .when(change == "modification", F.when((proposed != "") & (own != ""), told("replace", proposed, own)))
        .when(change == "addition", F.when(proposed == "", skip("addition_without_source")).when(choice == "keep_base", told("delete", proposed, none)).when(custom != "", told("replace", proposed, custom)))
        .when(change == "deletion", F.when((base == "") & (choice != "custom"), skip("deletion_without_base")).when(own != "", told("insert", none, own)))
    )
    kept = [c for c in diffs.columns if c not in ("action", "source_text", "suggested_text", "skipped")]
    return diffs.withColumn("_what", what).select(*kept, "_what.*")
