"""Chunks of bounded length for embedding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CHARS_PER_TOKEN = 4
PARAGRAPH = re.compile(r"\n{2,}")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z(0-9])")


def packed(parts: list[str], most: int, glue: str, tail: int = 0) -> Iterator[str]:
    """Neighbouring parts joined up to ``most`` characters; a new piece starts with the last ``tail`` of the one before."""
    held = ""
    for p in parts:
        if held and len(held) + len(glue) + len(p) > most:
            yield held
            held = held[-tail:] + glue + p if tail and len(held) > tail else p
        else:
            held = held + glue + p if held else p
    if held:
        yield held


def sentences(paragraph: str, most: int, overlap: int) -> Iterator[str]:
    """Pieces of a long paragraph: runs of sentences, sentences beyond the bound in overlapping windows."""
    run: list[str] = []
    for s in SENTENCE.split(paragraph):
        if len(s) <= most:
            run.append(s)
            continue
        yield from packed(run, most, " ", overlap)
        run = []
        for a in range(0, len(s), most - overlap):
            yield s[max(0, a - overlap) : a + most]
    yield from packed(run, most, " ", overlap)


def chunk_text(text: str | None, max_tokens: int = 500, overlap_tokens: int = 50) -> list[str]:
    """Paragraphs packed to chunks; long paragraphs by sentences, long sentences by length. Blank texts have none."""
    most, overlap = max_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN
    if not (text or "").strip():
        return []
    if len(text) <= most:
        return [text.strip()]
    out: list[str] = []
    short: list[str] = []
    for p in filter(None, map(str.strip, PARAGRAPH.split(text))):
        if len(p) <= most:
            short.append(p)
            continue
        out += [*packed(short, most, "\n\n"), *sentences(p, most, overlap)]
        short = []
    out += packed(short, most, "\n\n")
    return [c.strip() for c in out if c.strip()]


def chunks(df: DataFrame, id_col: str, text_col: str, max_tokens: int = 500, overlap_tokens: int = 50) -> DataFrame:
    """``id_col``, chunk_index, content of every chunk; texts are read whole, without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                out = [(i, n, c) for i, t in enumerate(b.column(1).to_pylist()) for n, c in enumerate(chunk_text(t, max_tokens, overlap_tokens))]
                if out:
                    at, n, c = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(n, pa.int32()), pa.array(c)], [id_col, "chunk_index", "content"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_index int, content string")
