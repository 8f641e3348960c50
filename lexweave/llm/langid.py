"""Operator 1: language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, all but letters become spaces, and every run of 2 to 4 characters within a
word (its edges included) is hashed to a row of an embedding table. The text's vector is the mean of
its rows, and a linear softmax tells the language. Table and softmax are trained together by
stochastic gradient descent on spans of a bounded sample of labelled documents. As the mean and the
softmax's argument are both linear, prediction adds up each row's product with the softmax weights.

Temperature and rejection limit are set on a part of the sample that training leaves out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import learns, slices

ORDERS = (2, 3, 4)
UNKNOWN = "und"
#: Characters of joined texts whose hashes are held at once.
PIECE = 1 << 19


@dataclass(frozen=True)
class Settings:
    """sample_docs bounds the training documents (8 a language at least); spans: how many spans of ``span`` characters are taken of each; reject: share of right answers that rejection may cost."""

    sample_docs: int = 4000
    spans: int = 2
    span: int = 500
    rows: int = 1 << 16
    dims: int = 16
    epochs: int = 6
    rate: float = 0.5
    reject: float = 0.002
    seed: int = 7


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point: is it a letter (or a mark, which stands in words)."""
    global _letters
    if _letters is None:
        _letters = np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])
    return _letters


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, 0 for what is no letter, each text between two zeros; and where each text starts."""
    joined = ("\0" + "\0".join(x.replace("\0", " ") for x in texts) + "\0").lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(points == 0)[:-1]
    return np.where(letters()[points], points, 0).astype(np.uint32), starts


def grams(points: np.ndarray, a: int, b: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the table row of the run at each place from a to b, and whether the run is within a word."""
    own = points[a : b + max(ORDERS) - 1]
    inner = own != 0
    size = b - a
    h = own * np.uint32(0x9E3779B1)
    inside = np.ones(len(own), bool)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x85EBCA6B) + own[n - 1 :] * np.uint32(0xC2B2AE35)
        # The middle must be letters; for n = 2 one of the two must be.
        inside = inside[:-1] & (inner[n - 2 : -1] if n > 2 else inner[:-1] | inner[1:])
        if n in ORDERS:
            x = h ^ (h >> np.uint32(15))
            yield (x[:size] * np.uint32(0x27D4EB2F) >> np.uint32(32 - (rows - 1).bit_length())).astype(np.int64), inside[:size]


def sums(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of table rows and number of runs of each text. The table has a last row of zeros."""
    points, starts = codes(texts)
    rows = len(table) - 1
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    end = len(points)
    for a in range(0, end, PIECE):
        b = min(end, a + PIECE)
        first = np.searchsorted(starts, a, "right") - 1
        own = starts[first : np.searchsorted(starts, b, "left")].copy()
        own[0] = a
        for row, inside in grams(points, a, b, rows):
            n = len(row)
            at = own - a
            live = at < n
            if live.any():
                who = slice(first, first + int(live.sum()))
                total[who] += np.add.reduceat(table[np.where(inside, row, rows)], at[live], axis=0)
                count[who] += np.add.reduceat(inside.astype(np.int64), at[live])
    return total, count


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # embedding table times softmax weights, and a row of zeros
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability, and whether it is too low; no letters (marks alone are none): und, 0, rejected."""
        total, count = sums([x or "" for x in texts], self.table)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        p = self.chances(total, count)
        best = p.argmax(1)
        known = (count > 0) & np.array([any(map(str.isalpha, x or "")) for x in texts], bool)
        score = np.where(known, p.max(1), 0.0)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], score, ~known | (score < self.limit)

    def chances(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, str]], s: Settings) -> Model:
    """Train on (language, span of a text) rows; every tenth row only serves calibration."""
    rows = [r for r in sorted(set(rows), key=lambda r: hash_text(r[1])) if any(c.isalpha() for c in r[1])]
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros((s.rows + 1, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(s.seed)
    y = {lang: k for k, lang in enumerate(langs)}
    fit, check = [r for i, r in enumerate(rows) if i % 10], [r for i, r in enumerate(rows) if i % 10 == 0]
    bags, gold = [], []
    for lang, text in fit or rows:
        points, _ = codes([text])
        got = [row[inside] for row, inside in grams(points, 0, len(points), s.rows)]
        if sum(map(len, got)):
            bags.append(np.unique(np.concatenate(got), return_counts=True))
            gold.append(y[lang])
    share = np.bincount(gold, minlength=len(langs)) / max(len(gold), 1)
    table = rng.normal(0, 0.1, (s.rows, s.dims))
    w, bias = np.zeros((len(langs), s.dims)), np.zeros(len(langs))
    steps, step = s.epochs * len(bags), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(bags)):
            ids, n = bags[i]
            part = n / n.sum()
            v = part @ table[ids]
            z = w @ v + bias
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[gold[i]] -= 1
            g *= min(4.0, 1 / (len(langs) * share[gold[i]]))  # rare languages count as much as common ones
            rate = s.rate * (1 - step / steps) + 0.01
            back = g @ w
            w -= rate * np.outer(g, v)
            bias -= 0.1 * rate * g
            table[ids] -= rate * np.minimum(1, 20 * part)[:, None] * back
            step += 1
    model = Model(langs, np.vstack([table @ w.T, np.zeros(len(langs))]).astype(np.float32), bias)
    return calibrate(model, check or rows, y, s)


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 1)


def calibrate(model: Model, rows: list[tuple[str, str]], y: dict[str, int], s: Settings) -> Model:
    """The temperature of least loss, and the limit below which a share ``reject`` of the right answers lies."""
    total, count = sums([t for _, t in rows], model.table)
    gold = np.array([y[lang] for lang, _ in rows])
    best = np.inf
    for t in np.geomspace(0.1, 10, 41):
        trial = Model(model.langs, model.table, model.bias, float(t))
        loss = -np.log(np.maximum(trial.chances(total, count)[np.arange(len(gold)), gold], 1e-12)).mean()
        if loss < best:
            best, model.temperature = loss, float(t)
    p = model.chances(total, count)
    right = np.sort(p.max(1)[p.argmax(1) == gold])
    if len(right):
        model.limit = min(0.5, float(right[int(s.reject * len(right))]) * 0.9)
    return model


def fit_langid(df: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a language and ``learns(id)``: ``sample_docs`` of them at most, evenly by language.

    The rows with the smallest hashes are the sample, whatever the order of the input, and of each
    ``spans`` spans of 20 to ``span`` characters from places that its id's hash gives; these, not
    the texts, come to the driver. Long texts teach as others do.
    """
    own = df.filter(learns(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    counts = own.groupBy("_lang").count().orderBy("_lang").collect()
    if not counts:
        return train([], s)
    quota = max(8, s.sample_docs // len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[0], min(1.0, quota / r[1]))])
    place = lambda k: F.shiftrightunsigned(F.xxhash64("_id", F.lit(k)), 11) / F.lit(float(1 << 53))
    picked = own.filter(F.coalesce(place(0) < F.element_at(share, F.col("_lang")), F.lit(False)))

    def span(k: int) -> Column:
        n = 20 + F.floor(place(3 * k + 1) * (s.span - 20)).cast("int")
        at = F.floor(place(3 * k + 2) * F.greatest(F.length("_text") - n + 1, F.lit(1))).cast("int")
        return F.substring(F.col("_text"), at + 1, n)

    rows = picked.select("_lang", F.explode(F.array(*[span(k) for k in range(s.spans)])).alias("_span"), place(0).alias("_p")).dropna()
    found = rows.orderBy("_p", "_lang").limit(s.spans * (2 * s.sample_docs + 8 * len(counts))).select("_lang", "_span").collect()
    return train([(r[0], r[1]) for r in found], s)


def predict_language(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score, rejected for every row, from the whole text alone.

    lang_pred is ``und`` (score 0, rejected) where the text is null or has no letter, else a learned
    language; rejected also where the calibrated score is under the model's limit. Rows are neither
    joined nor dropped; other columns are not read; no shuffle. The model (rows x languages floats)
    is broadcast.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            lang, score, rejected = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [id_col, "lang_pred", "score", "rejected"])

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def keep_known(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows that the model does not reject, with their columns as they were; decided row by row in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            rejected = shared.value.predict(b.column(at).to_pylist())[2]
            yield b.filter(pa.array(~rejected))

    return df.mapInArrow(run, df.schema)
