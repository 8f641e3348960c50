"""Operator 10: quality rules with thresholds that follow each language and source. DataFrame functions only.

Every measure of a document is a whole number (a rate in thousandths, a length in hundredths). Its
quantile sketch is a count by bucket: values below 128 are buckets of their own, larger ones keep
their 7 leading bits, so a quantile is within 1/64 of the true value. Sketches merge by adding counts:
those of (language, source) give those of a language and of all documents.

A measure's threshold is a quantile of the group's own sketch: the level (``LEVELS``) says which share
of a group a rule may cost, and the sketch where that lies. No cutoff is fixed. Thresholds of small
groups lean on those of their language, and these on those of all documents, by weight: n documents
of the group count against ``PRIOR`` documents of the one above, at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, join_small, words

#: Measure: the quantile, in thousandths, that is its threshold. Symbols tell junk, of which a source may be full; the others cost a group one document in 200.
LEVELS = {"sym": 900, "dup": 995, "rep": 995, "len": 995}
#: Documents of the level above that a group's own ones are weighed against.
PRIOR = 100
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3


def repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in an array of words.

    Windows are hashed and sorted with their places, equal neighbours are repeats, and each repeat
    covers up to 3 words that the next one does not.
    """
    n = F.size(w)
    grams = F.slice(F.transform(w, lambda x, i: F.struct(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, WINDOW)]).alias("h"), i.alias("p"))), F.lit(1), n - (WINDOW - 1))
    return F.when(n < WINDOW + 1, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(F.sort_array(grams))


def covered(grams: Column) -> Column:
    same = lambda x, i: F.coalesce(F.get(grams, i)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(grams, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words; the text goes.

    A null text counts as empty. Lines count if they have a word.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_w", words(F.col(text_col)))
    df = df.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))).withColumn("_g", repeat_words(F.col("_w")))
    df = df.withColumn("_p", covered(F.col("_g")))
    spans = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))))
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.aggregate(spans, F.lit(0), lambda a, x: a + x),
    }
    return df.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_w", "_l", "_g", "_p", text_col)


def bucket(v: Column) -> Column:
    """Lower end of a value's bucket: its 7 leading bits."""
    bits = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, bits), bits)


def upper_end(b: Column) -> Column:
    """Largest value of the bucket that begins at b."""
    return b + F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(b)) - 7, F.lit(0))) - 1


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Counts by group, measure and bucket, merged upwards: lang and source, lang only (level 1), all (level 3)."""
    long = rows.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), bucket(F.col(m)).alias("b")) for m in LEVELS])).alias("x")).select(*groups, "x.m", "x.b")
    own = long.groupBy(*groups, "m", "b").agg(F.count(F.lit(1)).alias("n"))
    a, b = groups
    merged = own.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("level"))
    merged = merged.withColumn(a, F.when(F.col("level") < 3, F.col(a))).withColumn(b, F.when(F.col("level") < 1, F.col(b)))
    return merged.groupBy(a, b, "level", "m", "b").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """A row for each group and level: its documents and a limit for each measure, the upper end of the quantile's bucket."""
    w = Window.partitionBy(*groups, "level", "m")
    run = sketch.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("b")))
    share = F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("m"))
    q = run.filter(F.col("upto") * 1000 >= F.col("total") * share).groupBy(*groups, "level", "m").agg(F.min("b").alias("b"), F.max("total").alias("total"))
    return q.groupBy(*groups, "level").agg(F.max("total").alias("docs"), *[F.max(F.when(F.col("m") == m, upper_end(F.col("b")))).alias(f"max_{m}") for m in LEVELS])


def weighed(own: Column, n: Column, above: Column) -> Column:
    """A group's limit against that of the level above it, in whole numbers."""
    return F.floor((own * n + above * PRIOR) / (n + PRIOR)).cast("long")


def group_limits(found: DataFrame, groups: list[str]) -> DataFrame:
    """A row for each (language, source): docs, own_<measure> (its own sketch's limit) and max_<measure> (weighed with the levels above)."""
    a, b = groups
    own = found.filter("level = 0").drop("level")
    for level, on in ((1, [a]), (3, [])):
        up = found.filter(F.col("level") == level).select(*on, F.struct("docs", *[f"max_{m}" for m in LEVELS]).alias(f"up{level}"))
        own = own.join(up, on) if on else own.join(F.broadcast(up), F.lit(True))  # one row
    cols = []
    for m in LEVELS:
        lang = weighed(F.col(f"up1.max_{m}"), F.col("up1.docs"), F.col(f"up3.max_{m}"))
        cols += [F.col(f"max_{m}").alias(f"own_{m}"), weighed(F.col(f"max_{m}"), F.col("docs"), lang).alias(f"max_{m}")]
    return own.select(a, b, "docs", *cols)


def judge_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Base counts and verdict of every row.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed (fewer than 50 words, or over half of the words in repeated windows), the limits
    that held, and kept: no base failure and no measure above its limit. Thresholds come from all
    rows without base failure. Null languages and sources are groups of their own. Null texts have
    no words and fail. Rows stay as they are, repeated ones too; an empty table gives no rows. Other
    columns are not read. Texts are read once.
    """
    a, b = "_a", "_b"
    picked = df.select(F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("s"), F.col(groups[0]).cast("string")), F.lit("n")).alias(a), F.coalesce(F.concat(F.lit("s"), F.col(groups[1]).cast("string")), F.lit("n")).alias(b), F.col(text_col).alias("_text"))
    rows = measures(picked, "_id", "_text")
    per = lambda k, x, y: F.when(F.col(y) > 0, F.floor(F.lit(k) * F.col(x) / F.col(y))).otherwise(0).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = checkpoint(rows.withColumn("base_failed", failed).withColumns({"sym": per(1000, "n_symbols", "n_words"), "dup": per(1000, "n_dup_lines", "n_lines"), "rep": per(1000, "n_repeat_words", "n_words"), "len": per(100, "word_chars", "n_words")}))
    found = checkpoint(limits(sketches(rows.filter("not base_failed"), [a, b]), [a, b]))
    rules = group_limits(found, [a, b]).select(F.to_json(F.struct(a, b)).alias("key"), *[f"max_{m}" for m in LEVELS])
    keyed = rows.withColumn("key", F.to_json(F.struct(a, b)))
    out = join_small(keyed, rules, "key", "left")
    over = [F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False)) for m in LEVELS]
    kept = ~F.col("base_failed")
    for x in over:
        kept = kept & ~x
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *[f"max_{m}" for m in LEVELS])
