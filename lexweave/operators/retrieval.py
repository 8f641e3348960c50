"""Exact vector search, keyword search, and their merging."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE_FACTOR = 0.92
MATTER_FACTOR = 1.3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null or zero or the lengths differ."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((norm > 0) & (F.size(a) == F.size(b)), 1 - dot(a, b) / norm)


def nearest(items: DataFrame, vector: list[float], k: int, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector, with ``distance``; ties by id. Each task keeps k rows, so nothing else moves."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = items.withColumn("distance", cosine_distance(F.col(embedding), q)).filter(F.col("distance").isNotNull())
    return scored.orderBy("distance", id_col).limit(k)


def cut_to_k(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query's candidates the k nearest, ties by id."""
    order = np.lexsort((ids, d, q))
    q, d, ids = q[order], d[order], ids[order]
    first = np.searchsorted(q, q)  # where each query's candidates start
    near = np.arange(len(q)) - first < k
    return q[near], d[near], ids[near]


def nearest_of_each(items: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", embedding: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, ``id_col``, distance: the k rows of ``items`` nearest to each row of ``queries``.

    Both have a whole-number ``id_col``, unique among the queries, and ``embedding``. The distance has
    nine digits, and ties go by id; null and zero vectors have none, nor have those of unlike length.
    Queries are broadcast in blocks of ``block``, each task keeps k rows a query, and only these move.
    """
    fits = lambda df: df.select(F.col(id_col).cast("long").alias("_id"), F.col(embedding).cast("array<double>").alias("_v")).filter(cosine_distance(F.col("_v"), F.col("_v")).isNotNull())
    rows, found = fits(items), None
    asked = fits(queries).toLocalIterator()
    while own := list(islice(asked, block)):
        by_size: dict[int, list] = {}
        for r in own:
            by_size.setdefault(len(r["_v"]), []).append(r)
        unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
        shared = items.sparkSession.sparkContext.broadcast({n: (np.array([r["_id"] for r in x], np.int64), unit(np.array([r["_v"] for r in x]))) for n, x in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {n: (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for n in shared.value}
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    ids, flat = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False)
                    sizes = b.column(1).value_lengths().to_numpy()
                    starts = np.cumsum(sizes) - sizes
                    for n, (_, vectors) in shared.value.items():
                        if not (here := sizes == n).any():
                            continue
                        x = flat[starts[here][:, None] + np.arange(n)]
                        d = np.round(1 - vectors @ (x / np.sqrt((x * x).sum(1, keepdims=True))).T, 9)
                        last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                        q, c = np.nonzero(d <= last[:, None])
                        best[n] = cut_to_k(*(np.concatenate(z) for z in zip(best[n], (q, d[q, c], ids[here][c]), strict=True)), k)
            for n, (q, d, i) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[n][0][q]), pa.array(i), pa.array(d)], ["query_id", id_col, "distance"])

        part = rows.mapInArrow(run, f"query_id long, `{id_col}` long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.limit(0).select(F.col("_id").alias("query_id"), F.col("_id").alias(id_col), F.lit(0.0).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def score(distance: Column, image: bool = False) -> Column:
    return (1 - distance / 2) * (IMAGE_FACTOR if image else 1.0)


def merge_best(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """Of several scored lists each key's higher score, the best k first."""
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)


def first_match(chunks: DataFrame, needle: str, k: int, item: str, index: str, text: str) -> DataFrame:
    """Keyword search: of each item the first chunk that holds the needle (any case), k items by id, score 1."""
    hits = chunks.filter(F.contains(F.lower(F.col(text)), F.lit(needle.lower())))
    first = hits.groupBy(item).agg(F.min(index).alias(index))
    return first.withColumn("score", F.lit(1.0)).orderBy(item).limit(k)


def fill(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """Hybrid merge of short ranked lists: all of the first in order, then what the next ones add, k rows."""
    w = Window.partitionBy(key).orderBy("_list", "rank")
    rows = None
    for n, x in enumerate(lists):
        own = x.select(key, "rank", F.lit(n).alias("_list"))
        rows = own if rows is None else rows.unionByName(own)
    once = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return once.orderBy("_list", "rank", key).limit(k).select(key, F.col("_list").alias("list"), "rank")


def boost(hits: DataFrame, member: Column, k: int, key: str) -> DataFrame:
    """Scores of members times 1.3, then sorted again."""
    return hits.withColumn("score", F.when(member, F.col("score") * MATTER_FACTOR).otherwise(F.col("score"))).orderBy(F.desc("score"), key).limit(k)


def keyword_limited(chunks: DataFrame, item: str, index: str, id_col: str, hit: Column, k: int) -> DataFrame:
    """Chunks that a keyword is in, with ``score`` 1: the first min(500, 4 k) by index, of these the first of each item, of these k."""
    order = [F.col(index), F.col(id_col)]
    few = chunks.filter(hit).orderBy(*order).limit(min(500, 4 * k))
    firsts = few.withColumn("_n", F.row_number().over(Window.partitionBy(item).orderBy(*order))).filter("_n = 1").drop("_n")
    return firsts.orderBy(*order).limit(k).withColumn("score", F.lit(1.0))


#: The vector column of each provider; images have none of the second. The score of an image whose description holds a keyword.
PROVIDERS = {"voyage": "embedding_voyage", "openai": "embedding_openai", "gemini": "embedding_gemini"}
IMAGE_PROVIDERS = ("voyage", "gemini")
IMAGE_KEYWORD_SCORE = 0.95
PIN = " 📌"
ITEM_FIELDS = ["title", "summary", "source_kind", "source_doc_id", "created_at", "pinned"]


def visible_items(items: DataFrame, kinds: list[str] | None = None, archived: bool = False) -> DataFrame:
    """(item_id, item_…) of items of the kinds (all, if None) that are not archived, or also those."""
    own = items if kinds is None else items.filter(F.col("source_kind").isin(kinds))
    own = own if archived else own.filter(F.col("archived_at").isNull())
    return own.select(F.col("id").alias("item_id"), *[F.col(c).alias(f"item_{c}") for c in ITEM_FIELDS])


def vault_search(chunks: DataFrame, items: DataFrame, owner: int | str, vector: list[float], k: int, kinds: list[str] | None = None, provider: str = "gemini", archived: bool = False) -> DataFrame:
    """The k chunks of an owner nearest to a vector of a provider, with their items and the distance, ties by id.

    Only chunks with a vector of that provider count, of items of the kinds and, but for
    ``archived``, not archived. An unknown provider is an error. Owner, provider and column choice
    reach the scan; each task keeps k rows.
    """
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}")
    own = chunks.filter((F.col("user_id") == owner) & F.col(PROVIDERS[provider]).isNotNull()).select("id", "item_id", "chunk_index", "content", F.col(PROVIDERS[provider]).alias("_v"))
    return nearest(own.join(visible_items(items, kinds, archived), "item_id"), vector, k, "id", "_v").withColumnsRenamed({"id": "chunk_id"}).drop("_v")


def vault_images(images: DataFrame, items: DataFrame, owner: int | str, vector: list[float], k: int, provider: str = "voyage", archived: bool = False) -> DataFrame:
    """The same over images; a provider without image vectors gives no rows."""
    column = PROVIDERS[provider] if provider in IMAGE_PROVIDERS else PROVIDERS["voyage"]
    own = images.filter((F.col("user_id") == owner) & F.col(column).isNotNull() & F.lit(provider in IMAGE_PROVIDERS)).select("id", "item_id", "description", F.col(column).alias("_v"))
    return nearest(own.join(visible_items(items, archived=archived), "item_id"), vector, k, "id", "_v").withColumnsRenamed({"id": "image_id"}).drop("_v")


def with_anchors(hits: DataFrame, chunks: DataFrame, items: DataFrame, anchored: list) -> DataFrame:
    """Hits of ``vault_search`` and, at distance 0 with a pin, the first chunks of the anchored items that are not among them.

    Three chunks an item are taken in all, in order of item and chunk; chunks of items that are gone are none.
    """
    first = chunks.filter(F.col("item_id").isin(anchored)).orderBy("item_id", "chunk_index").limit(3 * len(anchored))
    named = visible_items(items, archived=True).withColumn("item_title", F.concat("item_title", F.lit(PIN)))
    more = first.select(F.lit(None).cast(hits.schema["chunk_id"].dataType).alias("chunk_id"), "item_id", "chunk_index", "content", F.lit(0.0).alias("distance")).join(named, "item_id")
    new = more.dropDuplicates(["item_id", "chunk_index"]).join(hits.select("item_id", "chunk_index"), ["item_id", "chunk_index"], "left_anti")
    return hits.withColumn("anchored", F.lit(False)).unionByName(new.withColumn("anchored", F.lit(True)))


def vault_keyword(chunks: DataFrame, images: DataFrame, items: DataFrame, owner: int | str, needle: str, k: int, kinds: list[str] | None = None, archived: bool = False) -> DataFrame:
    """(item_id, chunk_id, chunk_index, score, match): k items whose texts hold a needle, then such whose images' descriptions do.

    Marks of patterns (%, _ and \\) are taken out of the needle; nothing is left, nothing is found.
    Of the first min(500, 4 k) chunks by index the first of each item counts; of images min(100, 2 k) by id.
    """
    safe = needle.strip().translate({ord(c): None for c in "%_\\"}).lower()
    own = visible_items(items.filter(F.col("user_id") == owner), kinds, archived).select("item_id")
    holds = lambda c: F.contains(F.lower(c), F.lit(safe)) & F.lit(bool(safe))
    texts = keyword_limited(chunks.join(own, "item_id"), "item_id", "chunk_index", "id", holds("content"), k)
    texts = texts.select("item_id", F.col("id").alias("chunk_id"), "chunk_index", F.lit(1.0).alias("score"), F.lit("keyword").alias("match"))
    shown = images.join(own, "item_id").filter(holds("description")).orderBy("id").limit(min(100, 2 * k))
    first = shown.groupBy("item_id").agg(F.min("id").alias("chunk_id")).join(texts.select("item_id"), "item_id", "left_anti")
    more = first.select("item_id", "chunk_id", F.lit(-1).alias("chunk_index"), F.lit(IMAGE_KEYWORD_SCORE).alias("score"), F.lit("image_keyword").alias("match"))
    return texts.unionByName(more).orderBy(F.desc("score"), "chunk_index", "chunk_id").limit(k)
