"""Small inputs that several tests share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Null, empty, blank, tied, repeated, very long and odd texts; nulls in every column.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the quiet river bank.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \t\n ", "fr", None),
    (5, "12345 !!! ???", None, None),
    (6, "word " * 40000, "en", "b"),
    (7, "x", "de", "c"),
    (8, "one two three four five six seven", "en", "c"),
    (8, "one two three four five six seven", "en", "c"),
    (None, "one two three four five six seven", "en", "c"),
    (9, "é 𝒳 漢字 かな ﬁ \x1c \x85 \xa0 İ ß ΑΣ Σ", "fr", "a"),
    (10, "<|endoftext|> said </w> it's <|startoftext|>", "en", "a"),
    (11, "line one\nline one\nline two\n\nline one", "en", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def odd(spark: SparkSession) -> DataFrame:
    """ODD with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("_id", "_text", "key", "size", "fp", "cell", "_key", "_kept", "_whole", "_times", "_copy", "place", "score", "ids", "lang_pred", "marks", "host", "n"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")
