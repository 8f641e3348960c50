"""Sources and sinks: Parquet tables, CSV with a byte-order mark, JSON envelopes, documents as files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name is dropped, fields may hold line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def csv_lines(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as a CSV line with every field quoted and quotes doubled; nulls are empty."""
    fields = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    return df.select(F.concat_ws(",", *fields).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV for spreadsheets: quoted fields, CRLF line ends, a byte-order mark before each file's header."""
    header = "﻿" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)

    def framed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([header + "\r"])], ["value"])
        for b in batches:  # without the input's mark that no value is null
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    lines = csv_lines(df).select(F.concat("value", F.lit("\r")).alias("value"))
    lines.mapInArrow(framed, "value string").write.text(path)


def insert_pages(rows: DataFrame, path: str, page: int) -> None:
    """Append rows in files of ``page`` rows at most; a task writes its own pages, so none waits for another."""
    rows.write.option("maxRecordsPerFile", page).mode("append").parquet(path)


def envelopes(findings: DataFrame, key: str, version: int = 2) -> DataFrame:
    """One JSON envelope for each key: its findings in order of ``ordinal``, with a schema version and a count."""
    fields = [c for c in findings.columns if c != key]
    rows = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", *[c for c in fields if c != "ordinal"]))).alias("findings"))
    return rows.select(key, F.to_json(F.struct(F.lit(version).alias("schema_version"), F.size("findings").alias("count"), "findings")).alias("envelope"))


def read_envelopes(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Findings out of JSON texts that hold an array of them or an object with one under ``findings``."""
    text = F.trim(F.col(column))
    array = F.from_json(text, f"array<{schema}>")
    inside = F.from_json(text, f"struct<findings:array<{schema}>>")["findings"]
    return df.withColumn("finding", F.explode(F.when(text.startswith("["), array).otherwise(inside)))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path as (path, format, text): text and HTML as they are, DOCX by its paragraphs; others null.

    The format follows the file name's ending. Each file is read in the task that lists it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ending.isin("txt", "md", "csv", "json"), "text").when(ending.isin("htm", "html"), "html").when(ending == "docx", "docx").when(ending == "pdf", "pdf").otherwise("unknown")

    @F.pandas_udf("string")
    def extracted(content: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([docx_text(c) if k == "docx" else c.decode("utf-8", "replace") if k in ("text", "html") else None for c, k in zip(content, kind, strict=True)])

    typed = files.select("path", kind.alias("format"), "content")
    return typed.select("path", "format", extracted("content", "format").alias("text"))


def docx_text(content: bytes) -> str | None:
    """Paragraphs of a DOCX body and then of its footnotes, one a line; null if it is no such file."""
    import io
    import zipfile
    from xml.etree import ElementTree

    mark = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    lines: list[str] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for part in ("word/document.xml", "word/footnotes.xml"):
                if part in z.namelist():
                    for p in ElementTree.fromstring(z.read(part)).iter(f"{mark}p"):
                        lines.append("".join(t.text or "" for t in p.iter(f"{mark}t")))
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return None
    return "\n".join(x for x in lines if x.strip())
