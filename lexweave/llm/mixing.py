"""Operator 5: mix sources to target weights by nested hash thresholds. DataFrame functions only.

Every source gets a target number of words. Whole copies are taken of all its documents as often as
they fit; for the rest, the documents whose hash lies below a threshold are taken once more. The
threshold is found without sorting: words are summed by source and hash bucket (the first 12 of 60
hash bits), the bucket in which the running sum passes the rest is split by the next 12 bits, and so
on until it holds one hash value. Thresholds nest: a larger budget keeps what a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, join_small

STEP_BITS = 12
HASH_BITS = 60
WEIGHTS = (3, 1, 2)


def place(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text, as a long; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets of sources, from (key, source, size): weights by rank of the name (null last), each at most ``cap`` sizes.

    With sources in order of cap * size / weight, the capped ones come first, and the level that
    the others share per unit of weight is the largest of (what is left) / (weight that is left).
    Windows here run over one row a source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("size") * F.lit(float(cap)))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    total = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.sum("size").over(total) * F.lit(float(share)) - before) / left)
    return level.withColumn("target", F.least("most", F.col("weight") * F.max("level").over(total))).select("key", F.col("size").alias("source_size"), "target")


def thresholds(sized: DataFrame, rest: DataFrame) -> DataFrame:
    """key, threshold: hashes below it hold about ``rest`` words of the source, to the nearest document.

    ``sized``: key, size, place; ``rest``: key, rest. Documents with equal ids have equal hashes
    and go together. Sources whose words never exceed the rest have no row.
    """
    at, shift = sized, HASH_BITS
    open_ = rest.withColumn("before", F.lit(0).cast("long"))
    while True:
        shift -= STEP_BITS
        sums = at.groupBy("key", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("place").alias("low"), F.max("place").alias("high"))
        w = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = join_small(sums, open_, "key").withColumn("upto", F.col("before") + F.sum("words").over(w))
        passed = run.filter(F.col("upto") > F.col("rest")).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("bucket"))).filter("nth = 1")
        edge = checkpoint(passed.select("key", "rest", "bucket", "words", "low", "high", (F.col("upto") - F.col("words")).alias("before")))
        if shift == 0 or edge.filter("low <> high").isEmpty():
            break
        inside = join_small(at, edge.select("key", F.col("bucket").alias("_edge")), "key").filter(F.shiftright("place", shift) == F.col("_edge"))
        at = checkpoint(inside.select("key", "size", "place"))
        open_ = edge.select("key", "rest", "before")
    nearer = F.col("before") + F.col("words") - F.col("rest") < F.col("rest") - F.col("before")
    return edge.select("key", F.when(nearer, F.col("high") + 1).otherwise(F.col("low")).alias("threshold"))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """key, source, size, place of every row, checkpointed: texts are read once."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return checkpoint(df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), source_key(F.col(source_col)).alias("key"), size.alias("size"), place(F.col(id_col)).alias("place")))


def mix_rules(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """A row for each source: key, source_size, target, whole (copies of every row), threshold (one more below it)."""
    targets = source_targets(sized.groupBy("key", "source").agg(F.sum("size").alias("size")), share, cap, weights)
    whole = F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    plan = checkpoint(targets.withColumn("whole", whole.cast("long")).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))))
    limits = thresholds(sized.filter("size > 0"), plan.select("key", "rest"))
    return plan.join(limits, "key", "left").select("key", "source_size", "target", "whole", "threshold")


def copies(place_: Column) -> Column:
    return F.col("whole") + F.when(F.coalesce(place_ < F.col("threshold"), F.lit(False)), 1).otherwise(0)


def mix(df: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes every row.

    Returns ``id_col``, size (words), source_size, target, copies (0 to ``cap``), taken = copies *
    size. Null texts have no words; a null source is a source of its own, last in order; a null id
    hashes as empty text. Rows with one id share their fate. A source without words keeps its rows
    once. An empty table gives no rows. Other columns are not read. Texts are read once; after
    that only (id, source, size) is.
    """
    sized = sizes(df, id_col, text_col, source_col)
    out = join_small(sized, mix_rules(sized, share, cap, weights), "key").withColumn("copies", copies(F.col("place")))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_rows(df: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as often as ``mix`` takes it, all columns as they were.

    A row's copies follow from its source's numbers and its id's hash alone, so no row moves for
    it: the rules, one row a source, go to the rows.
    """
    rules = mix_rules(sizes(df, id_col, text_col, source_col), share, cap, weights)
    more = F.coalesce(place(F.col("_row")[id_col]) < F.col("threshold"), F.lit(False)).cast("int")
    # The row goes along as one value, so that none of its names can clash.
    keyed = join_small(df.select(F.struct("*").alias("_row"), source_key(F.col(source_col)).alias("key")), rules, "key").withColumn("_times", F.col("whole").cast("int") + more)
    return keyed.filter("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select("_row.*")
