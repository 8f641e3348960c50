"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result
as Parquet in the shared folder of ``spark.checkpoint.dir`` and reads it again, so a lost executor
costs no more than its part of one stage. Stages read the whole of what their predecessor kept, and
only the columns of ``documents``: further ones go, whatever their names. An empty table gives an
empty result at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import bpe, langid, mixing, simhash, toxicity
from lexweave.llm.common import shared_folder, table
from lexweave.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents whose language is not rejected stay. Learns from ``docs``.

    Texts that are null or have no letter go; nulls in other columns matter to learning only (rows
    without language or id teach nothing). Repeated rows share their fate. Where no row has a
    language, nothing is known and all rows go.
    """
    return langid.keep_known(docs.select(COLUMNS), langid.fit_langid(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents with a score under 0.3 stay. Learns from ``docs`` and the labels.

    Null and empty texts have no hits and stay. Rows without id or label teach nothing. Repeated
    rows share their fate. Without labels nothing is toxic.
    """
    return toxicity.drop_toxic(docs.select(COLUMNS), toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near copies one row stays: the smallest id, null ids last.

    Null and blank texts are one group. Rows with one id and different texts are told apart by
    their content; of rows equal in all columns one stays.
    """
    return simhash.keep_one(docs.select(COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every document as often as the mix takes it (never, once or twice).

    A null source is a source of its own; a null id hashes as empty text; rows with one id share
    their fate; null texts have no words and go along with their source's rule.
    """
    return mixing.repeat_rows(docs.select(COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: BPE ids of every document, with digests of ids and decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty; every row stays, repeated ones too.
    """
    return bpe.digests(bpe.bpe_round_trip(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", one_of_each),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]

#: Learned models decide in the first stages, so SQL cannot express the whole; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's folder is deleted once the next one is written; the last one's stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
