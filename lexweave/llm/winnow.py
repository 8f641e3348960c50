"""Operator 8: winnowing fingerprints. DataFrame functions only.

Tokens are the text's words; in scripts that put no spaces between words every letter is one, and so
is every letter of a run of over 16 up to its last 16 (counted from its end, so an edit in a long run
moves no other token). Every run of k tokens is hashed. Of the hashes in each window of w positions
the least is chosen, the rightmost on ties, so two texts that share k + w - 1 tokens in a row share a
fingerprint.

A text of fewer than 2 (k + w - 1) tokens has few windows or one, so it is cut into characters as
well, whose fingerprints stand beside those of its tokens.

A hash and its position are one long: 40 bits of hash above 24 bits of position counted down, so
that the least long is the least hash with the rightmost position. Window minima come from log2(w)
steps of "the lesser of an element and its neighbour 1, 2, 4, ... places on". SQL functions keep no
state from one element to the next, so a k-gram is hashed from its tokens and not rolled.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Thai, Lao, Tibetan, Burmese, Khmer; kana, bopomofo, Yi and Han.
UNSPACED = r"\x{E00}-\x{109F}\x{1780}-\x{17FF}\x{19E0}-\x{19FF}\x{3040}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{A4CF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
SPACE = r"\x20\x09-\x0D"
TOKEN = rf"[^{SPACE}{UNSPACED}]{{1,16}}+(?=[{SPACE}{UNSPACED}]|\z)|[^{SPACE}]"
POS_BITS = 24
POS_MASK = (1 << POS_BITS) - 1


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def characters(text: Column, n_tokens: Column, k: int, w: int) -> Column:
    """A text's code points if it has fewer than 2 (k + w - 1) tokens, else none."""
    return F.when(n_tokens < 2 * (k + w - 1), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).otherwise(F.array().cast("array<string>"))


def lesser(a: Column, step: int) -> Column:
    """Of each element and the one ``step`` places on (if there is one) the lesser."""
    return F.transform(a, lambda x, i: F.least(x, F.get(a, i + step)))


def gram_hashes(t: Column, k: int, hashed) -> Column:
    """Hash and position of the k tokens from each token on."""
    position = lambda i: F.lit(POS_MASK).bitwiseXOR(i.cast("long").bitwiseAND(F.lit(POS_MASK)))
    return F.transform(t, lambda x, i: hashed(F.xxhash64(x, *[F.get(t, i + j) for j in range(1, k)])).bitwiseOR(position(i)))


def with_marks(df: DataFrame, text: str, out: str, k: int = 5, w: int = 8) -> DataFrame:
    """Add ``out``: the chosen (hash, position) longs of column ``text`` (no nulls): characters, then tokens, each in order of position.

    The lowest bit of a hash tells tokens from characters. Texts of fewer than k tokens have one
    hash of all tokens, texts without tokens none. Positions count modulo 2**24. ``w`` is a power of two.
    """
    if w & (w - 1):
        raise ValueError("w must be a power of two")
    used = []
    for level in (1, 0):
        name = f"_{out}_{level}"
        t, n = F.col(f"{name}_t"), F.size(F.col(f"{name}_t"))
        hashed = lambda h, level=level: h.bitwiseAND(F.lit(~(POS_MASK | 1 << POS_BITS))).bitwiseOR(F.lit(level << POS_BITS))

        whole = F.array(hashed(F.xxhash64(t)).bitwiseOR(F.lit(POS_MASK)))
        grams = F.slice(gram_hashes(t, k, hashed), F.lit(1), n - (k - 1))
        df = df.withColumn(f"{name}_t", tokens(F.col(text)) if level else characters(F.col(text), F.size(f"_{out}_1_t"), k, w))
        df = df.withColumn(f"{name}_0", F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, whole).otherwise(grams))
        used += [f"{name}_t", f"{name}_0"]
        step = 1
        while step < w:
            df = df.withColumn(f"{name}_{2 * step}", lesser(F.col(used[-1]), step))
            used.append(f"{name}_{2 * step}")
            step *= 2
        # The last w - 1 windows run over the end; a text with fewer grams has one window.
        last = F.col(used[-1])
        df = df.withColumn(name, F.array_distinct(F.slice(last, F.lit(1), F.greatest(F.size(last) - (w - 1), F.least(F.size(last), F.lit(1))))))
        used.append(name)
    return df.withColumn(out, F.concat(f"_{out}_0", f"_{out}_1")).drop(*used)


def as_text(marks: Column) -> Column:
    """Fingerprint as a string: position and hash of each mark."""
    return F.array_join(F.transform(marks, lambda x: F.concat(F.lit(POS_MASK).bitwiseXOR(x.bitwiseAND(F.lit(POS_MASK))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftrightunsigned(x, POS_BITS))))), " ")


def hashes(marks: Column, level: int) -> Column:
    own = F.filter(marks, lambda x: F.shiftright(x, POS_BITS).bitwiseAND(F.lit(1)) == level)
    return F.array_distinct(F.transform(own, lambda x: F.shiftrightunsigned(x, POS_BITS)))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``: Jaccard likeness of two arrays of marks, at the level that both have (the higher likeness, if both); two empty ones are alike (1)."""
    both = []
    for level in (0, 1):
        x, y = f"_{a}_{level}h", f"_{b}_{level}h"
        df = df.withColumns({x: hashes(F.col(a), level), y: hashes(F.col(b), level)})
        common = F.size(F.array_intersect(x, y))
        both.append(F.when((F.size(x) > 0) & (F.size(y) > 0), common / (F.size(x) + F.size(y) - common)).otherwise(0.0))
    df = df.withColumn(out, F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.greatest(*both)))
    return df.drop(*[f"_{c}_{level}h" for c in (a, b) for level in (0, 1)])


#: Types of ids that ``order_key`` keeps apart.
EXACT = ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz")


def order_key(i: Column, kind: str, skipped: int = 0) -> Column:
    """A long in the order of the ids (equal only for near ones): texts by 7 bytes behind the first ``skipped`` ones that all share."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return i.cast("long")
    if kind.startswith("timestamp"):
        return F.unix_micros(i.cast("timestamp"))
    if kind == "date":
        return F.unix_date(i).cast("long")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(i, "utf-8"), skipped + 1, 7)), 14, "0"), 16, 10).cast("long")
    return F.floor(i.cast("double")).cast("long")


def common_bytes(low: str | None, high: str | None) -> int:
    a, b = (low or "").encode(), (high or "").encode()
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def with_next(df: DataFrame, id_col: str, text: str, prepared=lambda df: df, carried: tuple[str, ...] = (), range_bytes: int = 128 << 20, most: int = 10_000) -> DataFrame:
    """Add next_<column> for ``carried``: the values of the row that follows in descending order of id; the first follows the last.

    Rows are dealt into ranges of the id of about ``range_bytes`` of text (3 a shuffle partition at
    least, ``most`` at most), each range is one window, and the first row of each range goes to the
    range before it as well, so no window covers more than its range. Ties of the id follow the hash
    of the text; null ids come last; an id with many rows, and the null ids, are split into ranges
    by that hash. ``prepared`` adds columns behind the shuffle, so that they need not move.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    tie = F.xxhash64(text)
    narrow = checkpoint(df.select(F.col(id_col).alias("_i"), tie.alias("_tie"), F.octet_length(text).cast("long").alias("_n")))
    skipped = common_bytes(*narrow.agg(F.min("_i"), F.max("_i")).first()) if kind == "string" else 0
    key = order_key(F.col("_i"), kind, skipped)
    rows, nulls, size = narrow.agg(F.count(F.lit(1)), F.count_if(F.col("_i").isNull()), F.sum("_n")).first()
    ranges = max(1, min(most, max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // range_bytes)))
    cuts = narrow.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 100_000).alias("c")).first()[0] if ranges > 1 else []
    cuts = sorted(cuts or [], reverse=True)
    split = -(-nulls * ranges // rows) if rows else 1
    place = F.when(F.col("_i").isNull(), len(cuts) + 1 + part(F.col("_tie"), F.lit(split))).otherwise(range_of(key, F.col("_tie") if kind in EXACT else None, cuts))
    heads = narrow.select("_i", "_tie", place.alias("_r")).groupBy("_r").agg(F.max(F.struct("_i", F.bitwise_not("_tie").alias("t"))).alias("_head"))
    upwards = Window.orderBy(F.col("_r"))  # one row a range
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = checkpoint(heads.select("_r", "_head", F.coalesce(F.lag("_r").over(upwards), F.max("_r").over(whole)).alias("_to")))
    out = df.select("*", F.col(id_col).alias("_i"), tie.alias("_tie")).withColumn("_r", place)
    out = out.join(F.broadcast(heads), "_r")  # ``most`` rows and a few
    first = F.col("_i").eqNullSafe(F.col("_head._i")) & (F.bitwise_not("_tie") == F.col("_head.t"))
    own = F.struct(F.col("_r").alias("r"), F.lit(False).alias("copy"))
    both = F.when(first, F.array(own, F.struct(F.col("_to").alias("r"), F.lit(True).alias("copy")))).otherwise(F.array(own))
    spread = out.withColumn("_at", F.explode(both)).select(*df.columns, "_i", "_tie", F.col("_at.r").alias("_range"), F.col("_at.copy").alias("_copy"))
    ready = prepared(spread.repartition(ranges, "_range"))
    w = Window.partitionBy("_range").orderBy(F.col("_copy"), F.col("_i").desc_nulls_last(), F.col("_tie"))
    led = ready.select(*[c for c in ready.columns if c not in ("_i", "_tie", "_range", "_copy")], "_copy", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return led.filter(~F.col("_copy")).drop("_copy")


def part(tie: Column, parts: Column) -> Column:
    """Which of so many equal parts of its range a hash is in, from 0."""
    return F.least(F.floor((tie / F.lit(float(1 << 64)) + 0.5) * parts).cast("int"), parts.cast("int") - 1)


def range_of(key: Column, tie: Column | None, cuts: list[int]) -> Column:
    """Number of the falling ``cuts`` above the key; a key that is several cuts has as many ranges more, by the hash (if keys are ids).

    Of every m-th cut first, then among m, so that no row is compared with all.
    """
    if not cuts:
        return F.lit(0)
    m = math.isqrt(len(cuts)) + 1
    array = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    count = lambda among, test: F.size(F.filter(among, test))
    skipped = count(array(cuts[m - 1 :: m]), lambda c: c > key) * m if len(cuts) >= m else F.lit(0)
    above = skipped + count(F.slice(array(cuts), skipped + 1, F.lit(m)), lambda c: c > key)
    hot = {c: n for c, n in Counter(cuts).items() if n > 1}
    if not hot or tie is None:
        return above
    times = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast(t) for c, n in hot.items() for x, t in ((c, "bigint"), (n, "int"))]), key), F.lit(0))
    return above + F.when(times > 0, part(tie, times + 1)).otherwise(0)


def edited_text(text: Column, other: Column) -> Column:
    """The text with its last floor(n / 3) code points replaced by the first as many (or all) of another."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))


def winnow_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, w: int = 8) -> DataFrame:
    """Fingerprint every text, and the text with its last third replaced from the next document.

    Returns ``id_col``, text, edited, marks, edited_marks (chosen hashes with positions), near_edited
    and near_next: Jaccard likeness of the text's hashes to the edited text's and to the next
    document's (``with_next``). Null texts count as empty; two empty fingerprints are alike (1.0).
    Ids are numbers, texts or times. Repeated rows stay, each next to its twin; the only row of a
    table is next to itself. An empty table gives no rows. Other columns are not read. Texts move
    once; fingerprints are made where they arrive.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(docs, "_id", "text", lambda moved: with_marks(moved, "text", "marks", k, w), ("text", "marks"))
    rows = with_marks(rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).drop("next_text"), "edited", "edited_marks", k, w)
    rows = with_likeness(with_likeness(rows, "marks", "edited_marks", "near_edited"), "marks", "next_marks", "near_next")
    return rows.select(F.col("_id").alias(id_col), "text", "edited", "marks", "edited_marks", "near_edited", "near_next")
