"""Retrieval queries: embeddings stand for chunks and images, documents for vault items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking, relations, retrieval
from ..sources.tables import table
from .registry import query

#: A fixed query vector: 64 values that follow from a rule.
VECTOR = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
VECTOR_SQL = "[((i * 37) % 64 - 31.5::DOUBLE) / 32 FOR i IN RANGE(64)]"
DISTANCE_SQL = f"(1 - LIST_COSINE_SIMILARITY(embedding::DOUBLE[], {VECTOR_SQL}::DOUBLE[]))"


@query(f"SELECT vec_id, ROUND({DISTANCE_SQL}, 6) AS distance FROM embeddings ORDER BY {DISTANCE_SQL}, vec_id LIMIT 10")
def vec_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Exact k nearest vectors by cosine distance."""
    return retrieval.nearest(table(spark, d, "embeddings"), VECTOR, 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, ROUND(1 - LIST_COSINE_SIMILARITY(embedding::DOUBLE[], v::DOUBLE[]), 9) AS d FROM embeddings, q)
SELECT query_id, vec_id, ROUND(d, 6) AS distance FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 10
""")
def vec_nearest_of_each(spark: SparkSession, d: str) -> DataFrame:
    """Exact k nearest vectors, among all rows, of every row whose id is divisible by 50."""
    rows = table(spark, d, "embeddings")
    return retrieval.nearest_of_each(rows, rows.filter("vec_id % 50 = 0"), 10).withColumn("distance", F.round("distance", 6))


@query(f"""
SELECT vec_id, doc_id, source, ROUND({DISTANCE_SQL}, 6) AS distance FROM embeddings JOIN documents ON doc_id = vec_id
WHERE label IN (1, 2, 3) AND lang = 'en' ORDER BY {DISTANCE_SQL}, vec_id LIMIT 30
""")
def vec_nearest_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Nearest chunks of items of some kinds: both sides are filtered before they are joined."""
    items = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "source")
    chunks = table(spark, d, "embeddings").filter(F.col("label").isin(1, 2, 3))
    hits = retrieval.nearest(chunks.join(items, F.col("doc_id") == F.col("vec_id")), VECTOR, 30)
    return hits.select("vec_id", "doc_id", "source", F.round("distance", 6).alias("distance"))


def semantic(spark: SparkSession, d: str, k: int) -> DataFrame:
    hits = retrieval.nearest(table(spark, d, "embeddings").filter("label < 8"), VECTOR, k)
    return hits.select((F.col("vec_id") % 100).alias("item_id"), retrieval.score(F.col("distance")).alias("score"))


def images(spark: SparkSession, d: str, k: int) -> DataFrame:
    hits = retrieval.nearest(table(spark, d, "embeddings").filter("label >= 8"), VECTOR, k)
    return hits.select((F.col("vec_id") % 100).alias("item_id"), retrieval.score(F.col("distance"), image=True).alias("score"))


MERGED_SQL = f"""
WITH s AS (SELECT vec_id, label, {DISTANCE_SQL} AS d FROM embeddings),
t AS (SELECT vec_id % 100 AS item_id, 1 - d / 2 AS score FROM (SELECT * FROM s WHERE label < 8 ORDER BY d, vec_id LIMIT 30)),
i AS (SELECT vec_id % 100 AS item_id, (1 - d / 2) * 0.92::DOUBLE AS score FROM (SELECT * FROM s WHERE label >= 8 ORDER BY d, vec_id LIMIT 30)),
m AS (SELECT item_id, MAX(score) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM i) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
"""


@query(MERGED_SQL + "SELECT item_id, ROUND(score, 6) AS score FROM m")
def vec_text_and_images(spark: SparkSession, d: str) -> DataFrame:
    """Text and image hits merged by item, the higher score each."""
    return retrieval.merge_best([semantic(spark, d, 30), images(spark, d, 30)], "item_id", 20).select("item_id", F.round("score", 6).alias("score"))


@query(MERGED_SQL + "SELECT item_id, ROUND(CASE WHEN item_id % 3 = 0 THEN score * 1.3::DOUBLE ELSE score END, 6) AS score FROM m ORDER BY CASE WHEN item_id % 3 = 0 THEN score * 1.3::DOUBLE ELSE score END DESC, item_id LIMIT 10")
def vec_matter_boost(spark: SparkSession, d: str) -> DataFrame:
    """Hits within the matter come up by a factor."""
    merged = retrieval.merge_best([semantic(spark, d, 30), images(spark, d, 30)], "item_id", 20)
    return retrieval.boost(merged, F.col("item_id") % 3 == 0, 10, "item_id").select("item_id", F.round("score", 6).alias("score"))


KEYWORD_SQL = """
WITH lines AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, CHR(10)), 1) - 1 AS chunk_index FROM documents),
k AS (SELECT doc_id, MIN(chunk_index) AS chunk_index, 1.0::DOUBLE AS score FROM lines WHERE CONTAINS(LOWER(line), 'license') GROUP BY 1 ORDER BY 1 LIMIT 50)
"""


def keyword(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    return retrieval.first_match(lines, "LICENSE", 50, "doc_id", "chunk_index", "line")


@query(KEYWORD_SQL + "SELECT doc_id, chunk_index, score FROM k")
def vec_keyword_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search, the first chunk of each item."""
    return keyword(spark, d)


@query(
    KEYWORD_SQL
    + f""", s AS (SELECT vec_id AS doc_id, ROW_NUMBER() OVER (ORDER BY {DISTANCE_SQL}, vec_id) AS rank FROM embeddings ORDER BY {DISTANCE_SQL}, vec_id LIMIT 15),
a AS (SELECT doc_id, 0 AS list, rank FROM s UNION ALL SELECT doc_id, 1, ROW_NUMBER() OVER (ORDER BY doc_id) FROM k WHERE doc_id NOT IN (SELECT doc_id FROM s))
SELECT doc_id, list, rank FROM (SELECT doc_id, list, CASE WHEN list = 0 THEN rank ELSE (SELECT r FROM (SELECT doc_id AS i, ROW_NUMBER() OVER (ORDER BY doc_id) AS r FROM k) WHERE i = doc_id) END AS rank FROM a) ORDER BY list, rank, doc_id LIMIT 30
"""
)
def vec_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Semantic hits first, keyword hits fill up to k; both lists are short."""
    ranked = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  k rows
    near = ranked(retrieval.nearest(table(spark, d, "embeddings"), VECTOR, 15).select(F.col("vec_id").alias("doc_id"), "distance"), "distance", "doc_id")
    return retrieval.fill([near, ranked(keyword(spark, d), "doc_id")], "doc_id", 30)


@query(f"""
WITH s AS (SELECT vec_id, label, {DISTANCE_SQL} AS d FROM embeddings)
SELECT vec_id, label, ROUND(d, 6) AS distance FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY d, vec_id) <= 3
""")
def vec_three_of_each_anchor(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest chunks of each anchored item."""
    q = F.array(*[F.lit(x) for x in VECTOR])
    scored = table(spark, d, "embeddings").withColumn("d", retrieval.cosine_distance(F.col("embedding"), q))
    return relations.first_n(scored, "label", [F.col("d"), F.col("vec_id")], 3).select("vec_id", "label", F.round("d", 6).alias("distance"))


@query()
def txt_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents; tests hold them against their bounds and the texts."""
    return chunking.chunks(table(spark, d, "documents"), "doc_id", "text")


def vault(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, images and items: three vectors an item, a third of the vectors of each provider, documents as items of four owners."""
    n, item = F.col("vec_id"), F.floor(F.col("vec_id") / 3)
    of = lambda k: F.when(n % 3 == k, F.col("embedding"))
    rows = table(spark, d, "embeddings").select(n.alias("id"), (item % 4).alias("user_id"), item.alias("item_id"), (n % 3).cast("int").alias("chunk_index"), F.concat(F.lit("Label "), F.col("label").cast("string")).alias("content"), of(0).alias("embedding_gemini"), of(1).alias("embedding_voyage"), of(2).alias("embedding_openai"))
    k = F.col("doc_id")
    items = table(spark, d, "documents").select(k.alias("id"), (k % 4).alias("user_id"), F.concat(F.lit("Item "), k.cast("string")).alias("title"), F.lit("").alias("summary"), F.col("lang").alias("source_kind"), k.alias("source_doc_id"), F.lit(None).cast("timestamp").alias("created_at"), (k % 11 == 0).alias("pinned"), F.when(k % 7 == 0, F.lit("2024-01-01").cast("timestamp")).alias("archived_at"))
    return rows, rows.withColumnRenamed("content", "description"), items


VAULT_SQL = f"""
WITH c AS (SELECT vec_id AS chunk_id, vec_id // 3 AS item_id, (vec_id % 3)::INT AS chunk_index, 'Label ' || label AS content, {DISTANCE_SQL} AS d FROM embeddings),
i AS (SELECT doc_id AS item_id, 'Item ' || doc_id AS title, lang AS kind, doc_id % 7 = 0 AS archived FROM documents)
"""


@query(VAULT_SQL + "SELECT chunk_id, item_id, chunk_index, title AS item_title, kind AS item_source_kind, ROUND(d, 6) AS distance FROM c JOIN i USING (item_id) WHERE item_id % 4 = 1 AND chunk_id % 3 = 0 AND kind IN ('en', 'de') AND NOT archived ORDER BY d, chunk_id LIMIT 20")
def vec_vault_search(spark: SparkSession, d: str) -> DataFrame:
    """Search with owner, provider, kinds and archive."""
    chunks, _, items = vault(spark, d)
    hits = retrieval.vault_search(chunks, items, 1, VECTOR, 20, ["en", "de"], "gemini")
    return hits.select("chunk_id", "item_id", "chunk_index", "item_title", "item_source_kind", F.round("distance", 6).alias("distance"))


@query(VAULT_SQL + "SELECT chunk_id AS image_id, item_id, ROUND(d, 6) AS distance FROM c JOIN i USING (item_id) WHERE item_id % 4 = 2 AND chunk_id % 3 = 1 ORDER BY d, chunk_id LIMIT 15")
def vec_vault_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of an owner, archived ones too; the provider without image vectors adds none."""
    _, images, items = vault(spark, d)
    hits = retrieval.vault_images(images, items, 2, VECTOR, 15, "voyage", archived=True).unionByName(retrieval.vault_images(images, items, 2, VECTOR, 15, "openai", archived=True))
    return hits.select("image_id", "item_id", F.round("distance", 6).alias("distance"))


@query(
    VAULT_SQL
    + """, h AS (SELECT chunk_id, item_id, chunk_index, d, title FROM c JOIN i USING (item_id) WHERE item_id % 4 = 1 AND chunk_id % 3 = 0 AND NOT archived ORDER BY d, chunk_id LIMIT 20),
a AS (SELECT item_id, chunk_index FROM c WHERE item_id IN (1, 5, 7, 123456789) ORDER BY item_id, chunk_index LIMIT 12)
SELECT item_id, chunk_index, title AS item_title, ROUND(d, 6) AS distance, FALSE AS anchored FROM h
UNION ALL SELECT item_id, chunk_index, title || ' 📌', 0.0, TRUE FROM a JOIN i USING (item_id) WHERE (item_id, chunk_index) NOT IN (SELECT (item_id, chunk_index) FROM h)"""
)
def vec_anchored_context(spark: SparkSession, d: str) -> DataFrame:
    """Hits and the chunks of anchored items, these at distance 0."""
    chunks, _, items = vault(spark, d)
    both = retrieval.with_anchors(retrieval.vault_search(chunks, items, 1, VECTOR, 20), chunks, items, [1, 5, 7, 123456789])
    return both.select("item_id", "chunk_index", "item_title", F.round("distance", 6).alias("distance"), "anchored")


@query(
    VAULT_SQL
    + """, o AS (SELECT c.* FROM c JOIN i USING (item_id) WHERE item_id % 4 = 1 AND NOT archived),
t AS (SELECT item_id, MIN(chunk_id) AS chunk_id, chunk_index FROM (SELECT * FROM o WHERE CONTAINS(content, 'Label 4') ORDER BY chunk_index, chunk_id LIMIT 120) GROUP BY item_id, chunk_index QUALIFY ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY chunk_index) = 1),
k AS (SELECT item_id, chunk_id, chunk_index, 1.0::DOUBLE AS score, 'keyword' AS match FROM t ORDER BY chunk_index, chunk_id LIMIT 30),
g AS (SELECT item_id, MIN(chunk_id) AS chunk_id FROM (SELECT * FROM o WHERE CONTAINS(content, 'Label 4') ORDER BY chunk_id LIMIT 60) WHERE item_id NOT IN (SELECT item_id FROM k) GROUP BY 1)
SELECT * FROM (SELECT * FROM k UNION ALL SELECT item_id, chunk_id, -1, 0.95::DOUBLE, 'image_keyword' FROM g) ORDER BY score DESC, chunk_index, chunk_id LIMIT 30"""
)
def vec_vault_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Items by keyword, images behind texts."""
    chunks, images, items = vault(spark, d)
    return retrieval.vault_keyword(chunks, images, items, 1, " label% 4_", 30)
