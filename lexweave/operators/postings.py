"""Keyword search by postings of letters: a table that tells which chunks hold one, two or three letters in a row, packed 64 chunks a row.

Postings are rows (gram, block, mask): bit i of the mask stands for chunk 64 * block + i. A gram is
the whole number of its letters, 21 bits each. A needle of up to three letters is a gram, so its
masks are the answer. A longer one is looked up by its rarest trigrams; their masks are met within
each block by a bitwise and, and the chunks left are read and searched in full, so the result is
that of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batches import small

#: Trigrams by which a needle is looked up, the rarest first.
RAREST = 4
#: Letters of the longest gram, and bits of a letter in a gram.
LONGEST, LETTER = 3, 21
#: Needles up to which their grams are broadcast to the postings.
BROADCAST_ROWS = 50_000


def letters(text: bytes) -> np.ndarray:
    """Code points of a text in UTF-8, from 1 on, as 0 stands for no letter."""
    return np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1


def needle_grams(needle: bytes | None) -> list[int]:
    """Distinct trigrams of a needle, or the whole of a shorter one."""
    own = letters(needle or b"")
    n = min(len(own), LONGEST)
    runs = sum(own[j : len(own) - n + 1 + j] << LETTER * j for j in range(n))
    return np.unique(runs).tolist() if n else []


def masks(texts: list[bytes], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts of one block, and for each the bits of those that hold it."""
    each = [letters(x) for x in texts]
    there = np.zeros(max((int(x.max()) for x in each if len(x)), default=0) + 1, bool)
    there[0] = True
    for own in each:
        there[own] = True
    alphabet = np.flatnonzero(there)
    size = len(alphabet)
    if size**LONGEST >= 1 << 57 and len(texts) > 1:  # more letters than a number holds beside a bit
        half = len(texts) // 2
        (a, x), (b, y) = masks(texts[:half], bits[:half]), masks(texts[half:], bits[half:])
        grams, held = np.concatenate([a, b]), np.concatenate([x, y])
        order = np.argsort(grams, kind="stable")
        return met(grams[order], held[order])
    number = np.cumsum(there) - 1
    alone = len(texts) == 1  # needs no bit in the key
    keys = []
    for own, bit in zip(each, bits.tolist()):
        run = np.zeros(len(own) + LONGEST - 1, np.int64)
        run[: len(own)] = number[own]
        run = sum(run[j : len(own) + j] * size ** (LONGEST - 1 - j) for j in range(LONGEST))
        run.sort()
        run = run[starts_of(run)]
        keys.append(run if alone else run << 6 | bit)
    key = np.concatenate(keys)
    key.sort()
    runs, bit = (key, np.full(len(key), bits[0])) if alone else (key >> 6, key & 63)
    grams, held = met(runs, np.left_shift(np.uint64(1), bit.astype(np.uint64)).view(np.int64))
    found = []
    for j in range(LONGEST):  # in order of the letters, so all that begin with a shorter gram stand together
        whole = grams % size > 0  # others end behind their text
        left, out = grams[whole], np.zeros(int(whole.sum()), np.int64)
        for k in reversed(range(LONGEST - j)):
            left, own = np.divmod(left, size)
            out |= alphabet[own] << LETTER * k
        found.append((out, held[whole]))
        grams, held = met(grams // size, held)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where each value of an ordered array begins."""
    return np.flatnonzero(np.concatenate([np.ones(len(ordered[:1]), bool), ordered[1:] != ordered[:-1]]))


def met(ordered: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value of an ordered array once, with the masks of its places joined by or."""
    starts = starts_of(ordered)
    return ordered[starts], np.bitwise_or.reduceat(held, starts) if len(starts) else held


def postings(chunks: DataFrame, id_col: str, text: str) -> DataFrame:
    """(gram, block, mask) of chunks with whole-number ids; a gram and block may have several rows, whose masks are to be joined by or."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids >> 6, kind="stable")
            blocks, starts = np.unique((ids >> 6)[order], return_index=True)
            texts = batch.column(1).to_pylist()
            for block, own in zip(blocks.tolist(), np.split(order, starts[1:])):
                grams, held = masks([texts[i] for i in own], ids[own] & 63)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.full(len(grams), block, np.int64)), pa.array(held)], ["gram", "block", "mask"])

    each = chunks.filter(F.col(id_col).isNotNull() & (F.length(text) > 0)).select(F.col(id_col).cast("long").alias("id"), F.lower(text).cast("binary").alias("text"))
    return each.mapInArrow(run, "gram long, block long, mask long")


def write_postings(chunks: DataFrame, id_col: str, text: str, path: str, buckets: int = 64) -> None:
    """Postings in folders by bucket of the gram, sorted by it, and their counts by gram.

    A bucket's blocks are dealt to lanes, so that there are about as many tasks as a shuffle has
    partitions, and each writes one file.
    """
    lanes = -(-int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    rows = postings(chunks, id_col, text).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    dealt = rows.withColumn("_lane", (F.col("bucket") * lanes + F.pmod("block", F.lit(lanes))).cast("int")).repartitionById(buckets * lanes, "_lane")
    whole = dealt.groupBy("_lane", "bucket", "gram", "block").agg(F.bit_or("mask").alias("mask")).drop("_lane")
    whole.sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    written = chunks.sparkSession.read.parquet(f"{path}/postings")
    written.groupBy("gram").agg(F.sum(F.bit_count("mask")).alias("n")).write.parquet(f"{path}/counts")


def candidates(needles: DataFrame, needle_id: str, needle: str, rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(needle_id, _chunk): chunks that hold the rarest trigrams of each needle, or the whole of a needle of three letters or fewer."""
    grams = F.udf(lambda own: needle_grams(own), "array<long>")
    asked = needles.select(F.col(needle_id).alias("_needle"), F.explode(grams(F.lower(needle).cast("binary"))).alias("gram"))
    rare = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, RAREST)
    ranked = asked.join(counts, "gram", "left").groupBy("_needle").agg(rare.alias("rare"))
    looked = ranked.select("_needle", F.size("rare").alias("of"), F.explode(F.transform("rare", lambda r: r["gram"])).alias("gram"))
    if needles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        looked = F.broadcast(looked)  # RAREST rows a needle
    met = rows.select("gram", "block", "mask").join(looked, "gram").groupBy("_needle", "of", "block").agg(F.count("*").alias("met"), F.bit_and("mask").alias("mask"))
    left = met.filter("met = of AND mask <> 0").select("_needle", "block", "mask", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).filter(F.getbit("mask", F.col("bit")) == 1)
    return left.select(F.col("_needle").alias(needle_id), (F.col("block") * 64 + F.col("bit")).alias("_chunk"))


def search(needles: DataFrame, needle_id: str, needle: str, chunks: DataFrame, id_col: str, text: str, rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(needle_id, id_col) of all chunks that hold a needle, in any case; an empty or null needle is in none.

    Equal needles are looked up once. Chunks without an id are not in the postings and are scanned.
    """
    asked = needles.select(F.col(needle_id).alias("_needle"), F.lower(needle).alias("_low")).filter(F.length("_low") > 0)
    texts = chunks.select(F.col(id_col).alias("_chunk"), F.lower(text).alias("_text"))
    found = candidates(asked.select("_low", F.col("_low").alias("_word")).distinct(), "_low", "_word", rows, counts)
    is_gram = F.length("_low") <= LONGEST
    read = found.filter(~is_gram).join(texts, "_chunk").filter(F.contains(F.col("_text"), F.col("_low"))).select("_low", "_chunk").distinct()
    pairs = found.filter(is_gram).unionByName(read).join(asked, "_low").select("_needle", "_chunk")
    lost = texts.filter(F.col("_chunk").isNull()).join(asked, F.contains(F.col("_text"), F.col("_low"))).select("_needle", "_chunk")
    return pairs.unionByName(lost).select(F.col("_needle").alias(needle_id), F.col("_chunk").alias(id_col))
