"""The queries of this subpackage and their SQL, for the registry at the repository's top."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dialogue, langid, lloyd, lmscore, mixing, neighbours, packing, quality, simhash, toxicity, urlfilter, winnow
from .common import held_out, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict_language(docs, langid.fit_langid(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids and decoded texts of all documents, as digests."""
    return bpe.digests(bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed into rows of 2048."""
    return packing.pack_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes, by source targets."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return simhash.simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, judged by the dated list that holds at their fetch time."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.filter_urls(urlfilter.dated_captures(pages), urlfilter.dated_entries(pages))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of all documents and of their edited texts."""
    rows = winnow.winnow_edits(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        winnow.as_text(F.col("marks")).alias("fingerprint"),
        winnow.as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of all documents."""
    return lmscore.lm_scores(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of all documents."""
    return quality.judge_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth embedding, among all rows."""
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings after three rounds."""
    found = lloyd.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of all conversations after damage."""
    return dialogue.repaired_digests(dialogue.damaged(table(spark, sf_dir, "conversations")))


WORD_SQL = r"[^\x20\x09-\x0D]+"

SQL_op5_mixing = rf"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '{WORD_SQL}')), 0)::BIGINT AS size,
    ('0x' || SUBSTR(MD5(COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents),
sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size, 2.0 * SUM(size)::DOUBLE AS most,
    [3.0, 1.0, 2.0][1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (SUM(source_size) OVER () * 1.5::DOUBLE
      - COALESCE(SUM(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size, LEAST(most, weight * MAX(level) OVER ()) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE FLOOR(target / source_size) END::BIGINT AS whole FROM targets),
places AS (
  SELECT s.source, s.place, SUM(s.size) AS words, p.target - p.whole * p.source_size AS rest
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source WHERE s.size > 0
  GROUP BY s.source, s.place, p.target, p.whole, p.source_size),
running AS (
  SELECT *, SUM(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM places),
edges AS (
  SELECT source, MIN_BY(CASE WHEN upto - rest < rest - (upto - words) THEN place + 1 ELSE place END, place) AS threshold
  FROM running WHERE upto > rest GROUP BY source)
SELECT s.doc_id, s.size, p.source_size, p.target,
  (s.size * (p.whole + CASE WHEN s.place < e.threshold THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN edges e ON s.source IS NOT DISTINCT FROM e.source
"""

SQL_op7_urlfilter = r"""
WITH captures AS (
  SELECT page_id, url, MAKE_TIMESTAMP((1704067200 + ('0x' || SUBSTR(MD5(page_id::VARCHAR), 1, 7))::BIGINT % (366 * 86400)) * 1000000) AS fetched,
    NULLIF(REGEXP_REPLACE(REGEXP_EXTRACT(LOWER(TRIM(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '\.$', ''), '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL),
sites AS (
  SELECT name, ('0x' || SUBSTR(MD5('d' || name), 1, 7))::BIGINT % 120 AS d
  FROM (SELECT DISTINCT REGEXP_REPLACE(host, '^(www|blog|m)\.', '') AS name FROM hosts)
  WHERE ('0x' || SUBSTR(MD5(name), 1, 7))::BIGINT % 4 = 0),
spans AS (
  SELECT name, FALSE AS allow, d AS a, LEAST(d + 60, 1000000) AS b FROM sites
  UNION ALL SELECT name, FALSE, 250, 1000000 FROM sites
  UNION ALL SELECT host, TRUE, 100, 1000000 FROM hosts
  WHERE host LIKE 'blog.%' AND ('0x' || SUBSTR(MD5(host), 1, 7))::BIGINT % 2 = 0),
timed AS (
  SELECT name, allow, MAKE_TIMESTAMP((1704067200 + a * 86400) * 1000000) AS since,
    CASE WHEN b = 1000000 THEN TIMESTAMP '2999-12-31' ELSE MAKE_TIMESTAMP((1704067200 + b * 86400) * 1000000) END AS until
  FROM spans),
best AS (
  SELECT c.page_id, c.url, c.fetched,
    MAX({'labels': LEN(STRING_SPLIT(t.name, '.')), 'allow': t.allow, 'since': t.since, 'until': t.until, 'name': t.name}) AS r
  FROM captures c JOIN timed t ON (c.host = t.name OR c.host LIKE '%.' || t.name) AND t.since <= c.fetched AND c.fetched < t.until
  GROUP BY ALL)
SELECT c.page_id, c.url, c.fetched, c.host, b.r.name AS matched, b.r.since AS listed_since, COALESCE(NOT b.r.allow, FALSE) AS blocked
FROM captures c LEFT JOIN best b ON c.page_id = b.page_id AND c.url = b.url AND c.fetched = b.fetched
"""

SQL_op10_quality = rf"""
WITH texts AS (
  SELECT doc_id, lang, source, COALESCE(text, '') AS text, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '{WORD_SQL}') AS w FROM documents),
base AS (
  SELECT doc_id, lang, source, w, LEN(w)::BIGINT AS n_words, LENGTH(ARRAY_TO_STRING(w, ''))::BIGINT AS word_chars,
    LEN(REGEXP_EXTRACT_ALL(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    LIST_FILTER(STRING_SPLIT(text, CHR(10)), lambda x: REGEXP_MATCHES(x, '{WORD_SQL}')) AS lines,
    CASE WHEN LEN(w) < 3 THEN [] ELSE LIST_TRANSFORM(RANGE(1, LEN(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS grams
  FROM texts),
places AS (SELECT ROW_NUMBER() OVER () AS r, * FROM base),
gram AS (SELECT r, UNNEST(grams) AS g, GENERATE_SUBSCRIPTS(grams, 1) AS i FROM places),
again AS (SELECT r, i, LEAD(i) OVER (PARTITION BY r ORDER BY i) AS next FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, g) AS n FROM gram) WHERE n > 1),
repeats AS (SELECT r, SUM(LEAST(3, COALESCE(next - i, 3)))::BIGINT AS n_repeat_words FROM again GROUP BY r),
rows AS (
  SELECT doc_id, lang, source, n_words, word_chars, n_symbols, (LEN(lines) - LEN(LIST_DISTINCT(lines)))::BIGINT AS n_dup_lines,
    COALESCE(n_repeat_words, 0)::BIGINT AS n_repeat_words, LEN(lines) AS n_lines
  FROM places LEFT JOIN repeats USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS sym, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup,
    CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS rep, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS len
  FROM rows),
measures AS (
  SELECT lang, source, m, (v >> GREATEST(LENGTH(BIN(v)) - 7, 0)) << GREATEST(LENGTH(BIN(v)) - 7, 0) AS b
  FROM (SELECT lang, source, UNNEST(['sym', 'dup', 'rep', 'len']) AS m, UNNEST([sym, dup, rep, len]) AS v FROM judged WHERE NOT base_failed)),
sketch AS (
  SELECT lang, source, GROUPING(lang, source) AS level, m, b, COUNT(*) AS n FROM measures
  GROUP BY GROUPING SETS ((lang, source, m, b), (lang, m, b), (m, b))),
upto AS (
  SELECT *, SUM(n) OVER w AS total, SUM(n) OVER (PARTITION BY lang, source, level, m ORDER BY b) AS upto FROM sketch
  WINDOW w AS (PARTITION BY lang, source, level, m)),
levels(m, share) AS (VALUES ('sym', 900), ('dup', 995), ('rep', 995), ('len', 995)),
quantiles AS (
  SELECT lang, source, level, m, MIN(b) + (1 << GREATEST(LENGTH(BIN(MIN(b))) - 7, 0)) - 1 AS q, MAX(total) AS docs
  FROM upto JOIN levels USING (m) WHERE upto * 1000 >= total * share GROUP BY ALL),
found AS (
  SELECT j.lang, j.source, j.m, j.q AS own, j.docs, l.q AS above, l.docs AS above_docs, a.q AS top
  FROM quantiles j JOIN quantiles l ON l.level = 1 AND l.m = j.m AND l.lang IS NOT DISTINCT FROM j.lang JOIN quantiles a ON a.level = 3 AND a.m = j.m WHERE j.level = 0),
limits AS (
  SELECT lang, source, MAX(most) FILTER (WHERE m = 'sym') AS max_sym, MAX(most) FILTER (WHERE m = 'dup') AS max_dup, MAX(most) FILTER (WHERE m = 'rep') AS max_rep, MAX(most) FILTER (WHERE m = 'len') AS max_len
  FROM (SELECT *, (own * docs + 100 * ((above * above_docs + 100 * top) // (above_docs + 100))) // (docs + 100) AS most FROM found) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND COALESCE(sym <= max_sym AND dup <= max_dup AND rep <= max_rep AND len <= max_len, TRUE) AS kept
FROM judged j LEFT JOIN limits o ON o.lang IS NOT DISTINCT FROM j.lang AND o.source IS NOT DISTINCT FROM j.source
"""

SQL_op11_neighbours = """
WITH used AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda c: c IS NULL OR NOT ISFINITE(c))) = 0
    AND LEN(LIST_FILTER(embedding, lambda c: c <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, SQRT(LIST_REDUCE(LIST_TRANSFORM(RANGE(1, LEN(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])), lambda a, b: a + b)) AS score
  FROM used q JOIN used c ON q.vec_id % 100 = 0 AND LEN(q.x) = LEN(c.x) AND (q.vec_id <> c.vec_id OR q.x <> c.x))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""


def _lloyd_sql(rounds: int = 3) -> str:
    """Rounds as common table expressions: all are alike."""
    squared = "LIST_SUM(LIST_TRANSFORM(RANGE(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT"
    steps = ""
    for n in range(rounds + 1):
        steps += f""",
near{n} AS (
  SELECT n, ANY_VALUE(vec_id) AS vec_id, ANY_VALUE(k.v) AS v, MIN({{'d': {squared}, 'c': cluster}}) AS best
  FROM kept k CROSS JOIN c{n} c GROUP BY n)"""
        if n < rounds:
            steps += f""",
sums{n} AS (
  SELECT cluster, LIST((total - (total % many + many) % many) // many ORDER BY i)::BIGINT[] AS v
  FROM (SELECT best.c AS cluster, i, SUM(v[i])::BIGINT AS total, COUNT(*) AS many FROM near{n}, RANGE(1, 65) r(i) GROUP BY ALL) GROUP BY cluster),
c{n + 1} AS (SELECT cluster, COALESCE(s.v, c.v) AS v FROM c{n} c LEFT JOIN sums{n} s USING (cluster))"""
    return f"""
WITH kept AS (
  SELECT ROW_NUMBER() OVER () AS n, vec_id, LIST_TRANSFORM(embedding, lambda x: FLOOR(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE LEN(embedding) = 64 AND LEN(LIST_FILTER(embedding, lambda c: c IS NULL OR NOT ISFINITE(c))) = 0),
c0 AS (
  SELECT ROW_NUMBER() OVER (ORDER BY SHA256('1:' || vec_id), v) - 1 AS cluster, v FROM kept QUALIFY cluster < 16){steps}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (SUM(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (SUM(best.d) OVER ())::BIGINT AS inertia, SHA256(ARRAY_TO_STRING(c.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN c{rounds} c ON c.cluster = best.c
"""


SQL_op12_lloyd = _lloyd_sql()


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name[4:]: sql for name, sql in globals().items() if name.startswith("SQL_")}
