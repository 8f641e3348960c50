"""Operator 9: documents scored by masked pseudo-likelihood.

A network sees the two words on either side of a masked place and predicts the word there: the sides'
embeddings (a table for each side) are summed and pass a tanh layer; a softmax gives the word's class
and a second one, over the class's words, the word. The document's score is the sum of all its words'
conditional log-probabilities.

Counts cover all documents. The most frequent words are the vocabulary, in classes of about equal
mass; all others fall into classes by their last letters, in which every distinct word is equally
likely. Texts become word numbers once, a batch's words parted and told apart by Arrow. The network is trained in numpy, by Adagrad: it starts on a
bounded sample, then every task goes on from there over all the documents it reads, and the tasks'
networks are averaged, each word's embeddings by how often a task saw the word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices
from .quality import bucket

SIDES = (-2, -1, 1, 2)
#: Tasks that each send at most a vocabulary of words to the driver.
SORT_PARTS = 16
#: Words scored in one step, and rows of them whose classes are weighed at once.
STEP, BLOCK = 1 << 15, 1 << 10
#: Logits up to this size are powers of e without a shift (float32 ends at 88).
CALM = 60.0
#: Words that a task holds at once in training, and words whose averages are made in one group.
HELD, SLICE = 1 << 19, 256
#: Tasks that train at once; more partitions share these.
TRAINERS = 2048
#: Tasks whose networks are averaged in one group; groups of groups follow.
FAN = 64


@dataclass(frozen=True)
class Settings:
    """Words with counts of their own: ``vocabulary``, or ``vocabulary_root`` times the root of the number of distinct words if that is more.

    ``own_classes`` is for 8,192 words and grows with the root of the vocabulary, so that a class
    has about as many words as there are classes. The network, which the driver holds, so follows
    the root of the distinct words (some 60 MB for 10^9 of them).

    sample_docs spans of ``sample_span`` words at most are the start of the training (``epochs``
    with ``batch`` and ``rate``); the pass over all words of all documents that follows has
    ``pass_batch`` and ``pass_rate``.
    """

    vocabulary: int = 8192
    vocabulary_root: float = 4.0
    own_classes: int = 64
    rare_classes: int = 32
    hidden: int = 32
    sample_docs: int = 2000
    sample_span: int = 200
    epochs: int = 2
    batch: int = 256
    pass_batch: int = 8192
    rate: float = 0.1
    pass_rate: float = 0.6
    seed: int = 11


def rare_class(word: str, classes: int) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % classes


@dataclass
class Model:
    """Number 0 pads; 1 to V are the vocabulary, class by class; then one number a class of rare words.

    ``params``: tables (side, number, hidden), lift, out, bias (of the classes), inner (number,
    hidden and a last column for the bias); ``squares``: of the gradients, by parameter.
    """

    numbers: dict[str, int]
    class_of: np.ndarray
    share: np.ndarray  # log-probability of a number's word within its class, by the counts
    rare_classes: int
    own_classes: int
    params: list[np.ndarray] = field(default_factory=list)
    squares: list[np.ndarray] | None = None

    def kind(self) -> np.dtype:
        return np.dtype("<u2" if len(self.class_of) < 1 << 16 else "<u4")

    def ranges(self) -> np.ndarray:
        """First number of each own class, and the end of the last."""
        return np.searchsorted(self.class_of[1 : len(self.numbers) + 1], np.arange(self.own_classes + 1)) + 1

    def read(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words (ASCII white space parts them; lower case)."""
        return self.read_all([text])[0]

    def read_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """``read`` of many texts: each distinct word, and each ending of rare words, is looked up once."""
        own, ends = distinct_words(texts)
        known = pc.index_in(own.dictionary, pa.array(list(self.numbers), pa.large_string()))
        numbers = np.asarray(pc.fill_null(known, -1)).astype(np.int64) + 1
        rare = np.flatnonzero(numbers == 0)
        tails = pc.utf8_slice_codeunits(own.dictionary.take(pa.array(rare)), -2).dictionary_encode()
        classes = np.array([rare_class(tail, self.rare_classes) for tail in tails.dictionary.to_pylist()], np.int64)
        numbers[rare] = len(self.numbers) + 1 + classes[np.asarray(tails.indices)]
        flat = numbers.astype(self.kind())[np.asarray(own.indices)]
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def log_likelihoods(self, many: list[np.ndarray]) -> np.ndarray:
        """Sum of conditional log-probabilities of each number sequence."""
        tables, lift, out, bias, inner = self.params
        lengths = np.array([len(x) for x in many], np.int64)
        flat = padded(many)
        places = np.flatnonzero(flat)
        logs = np.empty(len(places))
        first = self.ranges().tolist()
        head = np.vstack([out, bias])
        small = calm(head, inner)
        wide = np.ones((min(STEP, len(places)), inner.shape[1]), inner.dtype)
        for a in range(0, len(places), STEP):
            at = places[a : a + STEP]
            order = np.argsort(self.class_of[flat[at]].astype(np.uint16), kind="stable")
            at = at[order]
            own = flat[at]
            cls = self.class_of[own]
            x = wide[: len(at)]
            x[:, :-1] = hidden(tables, lift, flat, at)
            got = np.empty(len(at))
            for b in range(0, len(at), BLOCK):
                got[b : b + BLOCK] = picked(x[b : b + BLOCK] @ head, cls[b : b + BLOCK], small)
            for c, lo, hi in by_class(cls, self.own_classes):
                got[lo:hi] += picked(x[lo:hi] @ inner[first[c] : first[c + 1]].T, own[lo:hi] - first[c], small)
            rare = np.searchsorted(cls, self.own_classes)
            got[rare:] += self.share[own[rare:]]
            logs[a + order] = got
        ends = np.cumsum(lengths)
        run = np.concatenate([[0.0], np.cumsum(logs)])
        return run[ends] - run[ends - lengths]


def padded(many: list[np.ndarray]) -> np.ndarray:
    """Sequences one behind the other, two pads between and around."""
    gap = np.zeros(max(SIDES), np.int64)
    return np.concatenate([gap, *(x for own in many for x in (own, gap))]).astype(np.int64)


def hidden(tables: np.ndarray, lift: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = lift + np.take(tables[0], flat[at + SIDES[0]], axis=0)
    for k in range(1, len(SIDES)):
        h += np.take(tables[k], flat[at + SIDES[k]], axis=0)
    return np.tanh(h, out=h)


def calm(head: np.ndarray, inner: np.ndarray) -> bool:
    """True if no logit passes CALM: no part of a state passes 1, so none passes its weights' sizes together."""
    return bool(np.abs(head).sum(0).max() <= CALM and np.abs(inner).sum(1).max() <= CALM)


def powers(z: np.ndarray, small: bool) -> np.ndarray:
    """Powers of e of the logits, in their place, and each row's sum; rows are shifted first unless all are small."""
    if not small:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def picked(z: np.ndarray, gold: np.ndarray, small: bool) -> np.ndarray:
    """Log-probability of one column a row; ``z`` is used up."""
    if not small:
        z -= z.max(1, keepdims=True)
    own = z[np.arange(len(z)), gold]
    return own - np.log(powers(z, True))


def by_class(cls: np.ndarray, classes: int) -> Iterator[tuple[int, int, int]]:
    """Each class below ``classes`` that occurs, and where its rows begin and end; rows are in order of their class."""
    edges = np.searchsorted(cls, np.arange(classes + 1))
    for c in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield c, edges[c], edges[c + 1]


def distinct_words(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All texts' lower-case words one behind the other, each distinct one once in the dictionary, and where every text begins and ends."""
    parted = pc.ascii_split_whitespace(pa.array([(x or "").lower() for x in texts], pa.large_string()))
    own, ends = parted.flatten(), np.asarray(parted.offsets)
    real = np.asarray(pc.binary_length(own)) > 0  # white space around a text leaves empty words
    if not real.all():
        own, ends = own.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends]
    return own.dictionary_encode(), ends


def count_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all documents; counts of slices come before the shuffle, and Spark's partial sums of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            own, _ = distinct_words(b.column(0).to_pylist())
            n = np.bincount(np.asarray(own.indices), minlength=len(own.dictionary))
            yield pa.RecordBatch.from_arrays([own.dictionary.cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    return df.select(F.col(text_col).alias("_text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_counts(df: DataFrame, s: Settings, text_col: str = "text") -> Model:
    """Vocabulary, classes and shares from counts over all documents."""
    counts = checkpoint(count_words(df, text_col))
    # A histogram of the counts tells from which count on words can be frequent, so that only those are sorted.
    sizes = sorted(((r["b"], r["count"]) for r in counts.groupBy(bucket(F.col("n")).alias("b")).count().collect()), reverse=True)
    upto = np.cumsum([c for _, c in sizes])
    most = max(s.vocabulary, int(s.vocabulary_root * sum(c for _, c in sizes) ** 0.5))
    least = next((b for (b, _), total in zip(sizes, upto.tolist(), strict=True) if total >= most), 0)
    frequent = counts.filter(F.col("n") >= least).repartition(SORT_PARTS, "word")
    top = [(r["word"], r["n"]) for r in frequent.orderBy(F.desc("n"), "word").limit(most).collect()]
    numbers = {w: k + 1 for k, (w, _) in enumerate(top)}
    if len(top) == most:
        # Words that may be rare, by their last letters: as many types and as much mass as a class has.
        last = counts.filter((F.col("n") < top[-1][1]) | ((F.col("n") == top[-1][1]) & (F.col("word") > top[-1][0])))
        tails = last.groupBy(F.expr("right(word, 2)").alias("tail")).agg(F.count(F.lit(1)).alias("types"))
        tails = tails.groupBy((F.crc32(F.col("tail").cast("binary")) % s.rare_classes).alias("c")).agg(F.sum("types").alias("types")).collect()
    else:
        tails = []
    types = np.ones(s.rare_classes)
    for r in tails:
        types[r["c"]] += r["types"]
    n = np.array([x for _, x in top], float)
    mass = np.cumsum(np.sqrt(n)) / max(np.sqrt(n).sum(), 1e-9)
    classes = max(s.own_classes, int(s.own_classes * (len(n) / 8192) ** 0.5))
    own = np.minimum((mass * classes).astype(np.int64), classes - 1) if len(n) else np.zeros(0, np.int64)
    class_of = np.concatenate([[0], own, classes + np.arange(s.rare_classes)])
    in_class = np.bincount(own, n, classes)
    share = np.concatenate([[0.0], np.log(n / in_class[own]) if len(n) else [], -np.log(types)])
    return Model(numbers, class_of, share, s.rare_classes, classes)


def softmax_slope(z: np.ndarray, gold: np.ndarray, n: int, small: bool) -> np.ndarray:
    """Slope of the loss (of ``n`` places) at the logits, in their place."""
    z *= (1 / (n * powers(z, small)))[:, None]
    z[np.arange(len(z)), gold] -= 1 / n
    return z


def summed(rows: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``rows[order]``. Runs of one row are only copied; two columns go as one complex number, whose parts add up alike."""
    counts = np.diff(starts, append=len(order))
    d, many = np.take(rows, order[starts], axis=0), counts > 1
    if many.any():
        own = np.take(rows, order[np.repeat(many, counts)], axis=0)
        pairs = own.view(np.result_type(own, np.complex64)) if own.shape[1] % 2 == 0 else own
        d[many] = np.add.reduceat(pairs, np.cumsum(counts[many]) - counts[many], axis=0).view(own.dtype)
    return d


def descend(m: Model, params: list[np.ndarray], squares: list[np.ndarray], flat: np.ndarray, places: np.ndarray, batch: int, rate: float) -> None:
    """Adagrad over the places in their order, in place."""
    tables, lift, out, bias, inner = params
    first = m.ranges().tolist()
    rate = np.float32(rate)
    wide = np.ones((min(batch, len(places)), inner.shape[1]), inner.dtype)
    slope = np.zeros_like(inner)

    def step(k: int, d: np.ndarray) -> None:
        squares[k] += d * d
        d = d / np.sqrt(squares[k])
        d *= rate
        params[k] -= d

    for a in range(0, len(places), batch):
        at = places[a : a + batch]
        at = at[np.argsort(m.class_of[flat[at]].astype(np.uint16), kind="stable")]
        own = flat[at]
        cls = m.class_of[own]
        h = hidden(tables, lift, flat, at)
        x = wide[: len(at)]
        x[:, :-1] = h
        head = np.vstack([out, bias])
        small = calm(head, inner)
        back, outer = np.empty_like(h), np.zeros_like(head)
        for b in range(0, len(at), BLOCK):
            g = softmax_slope(x[b : b + BLOCK] @ head, cls[b : b + BLOCK], len(at), small)
            np.matmul(g, out.T, out=back[b : b + BLOCK])
            outer += x[b : b + BLOCK].T @ g
        slope[:] = 0
        for c, lo, hi in by_class(cls, m.own_classes):
            rows = slice(first[c], first[c + 1])
            if rows.stop - rows.start < 2:
                continue
            z = softmax_slope(x[lo:hi] @ inner[rows].T, own[lo:hi] - rows.start, len(at), small)
            back[lo:hi] += z @ inner[rows, :-1]
            np.matmul(z.T, x[lo:hi], out=slope[rows])
        step(4, slope)  # rows without a slope stay
        np.square(h, out=h)
        back *= np.subtract(1, h, out=h)
        step(1, back.sum(0))
        step(2, outer[:-1])
        step(3, outer[-1])
        for k, side in enumerate(SIDES):
            ids = flat[at + side]
            order = np.argsort(ids.astype(np.uint16), kind="stable") if len(m.class_of) < 1 << 16 else np.argsort(ids, kind="stable")
            ids = ids[order]
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ids, d = ids[starts], summed(back, order, starts)
            if len(ids) and ids[0] == 0:
                d[0] = 0  # pads stay zero
            q = np.take(squares[0][k], ids, axis=0)
            q += d * d
            squares[0][k][ids] = q
            d *= rate
            d /= np.sqrt(q, out=q)
            tables[k][ids] -= d


def train(model: Model, many: list[np.ndarray], s: Settings) -> Model:
    """Fit a new network to the masked words of number sequences."""
    rng = np.random.default_rng(s.seed)
    size, classes = len(model.class_of), model.own_classes + model.rare_classes
    tables = rng.normal(0, 0.05, (len(SIDES), size, s.hidden)).astype(np.float32)
    tables[:, 0] = 0
    flat = padded(many)
    places = np.flatnonzero(flat)
    seen = np.bincount(model.class_of[flat[places]], minlength=classes) + 1.0
    bias = np.log(seen / seen.sum()).astype(np.float32)
    model.params = [tables, np.zeros(s.hidden, np.float32), np.zeros((s.hidden, classes), np.float32), bias, np.hstack([np.zeros((size, s.hidden)), model.share[:, None]]).astype(np.float32)]
    model.squares = [np.full(p.shape, 1e-2, np.float32) for p in model.params]
    for _ in range(s.epochs):
        rng.shuffle(places)
        descend(model, model.params, model.squares, flat, places, s.batch, s.rate)
    return model


def encode(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and numbers (little-endian, 2 or 4 bytes a word) of every row's words; null texts have none. No shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shared.value.read_all(b.column(1).to_pylist())], pa.binary())], [id_col, "numbers"])

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, numbers binary")


def spread(encoded: DataFrame) -> DataFrame:
    """Rows of few partitions, as of one small file, over all cores; two or four bytes a word move. Larger inputs stay where they are."""
    cores = encoded.sparkSession.sparkContext.defaultParallelism
    return encoded.repartition(cores) if encoded.rdd.getNumPartitions() < cores else encoded


def sampled(encoded: DataFrame, model: Model, s: Settings, id_col: str) -> list[np.ndarray]:
    """Spans of the ``sample_docs`` documents with the smallest id hashes, each from a place that the hash gives."""
    width = model.kind().itemsize
    n = F.floor(F.octet_length("numbers") / width)
    h = F.xxhash64(F.col(id_col), F.lit(s.seed))
    at = F.floor(F.pmod(h, F.greatest(n - s.sample_span + 1, F.lit(1)))).cast("int") * width

    def cut(at: Column) -> Column:
        return F.substring(F.col("numbers"), at + 1, F.lit(s.sample_span * width))

    rows = encoded.filter(F.octet_length("numbers") > 0).select(h.alias("h"), cut(at).alias("span")).orderBy("h", "span").limit(s.sample_docs).collect()
    return [np.frombuffer(r["span"], model.kind()) for r in rows]


def train_on_all(model: Model, encoded: DataFrame, s: Settings) -> Model:
    """Go on from a started network over all words of all documents, one pass.

    Each task trains its own copy on its rows (TRAINERS tasks at most) and gives out what it changed,
    in slices of the vocabulary: a word's embeddings with the number of times it stood beside
    another, a word's row of its class with the number of words of that class, all else with its
    number of words. Rows that a task did not change are not sent. A shuffle by slice averages them by these
    numbers, ``FAN`` tasks at a time, so no group grows with the input and the driver gets one
    network. What no task changed stays.
    """
    encoded = encoded.select("numbers")
    if encoded.rdd.getNumPartitions() > TRAINERS:
        encoded = encoded.coalesce(TRAINERS)
    parts = encoded.rdd.getNumPartitions()
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    size = len(model.class_of)
    schema = "slice long, part long, at binary, seen binary, own binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        params, squares = [p.copy() for p in m.params], [q.copy() for q in m.squares]
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([s.seed, part])
        seen, golds = np.zeros(size), np.zeros(m.own_classes + m.rare_classes)

        def learn(held: list[np.ndarray]) -> None:
            flat = padded(held)
            places = np.flatnonzero(flat)
            for d in SIDES:
                seen[:] += np.bincount(flat[places + d], minlength=size)
            golds[:] += np.bincount(m.class_of[flat[places]], minlength=len(golds))
            rng.shuffle(places)
            descend(m, params, squares, flat, places, s.pass_batch, s.pass_rate)

        held, n = [], 0
        for b in slices(batches, 256):
            for own in b.column(0).to_pylist():
                got = np.frombuffer(own, m.kind())
                for a in range(0, len(got), HELD):  # a very long text in pieces
                    held.append(got[a : a + HELD])
                    n += len(held[-1])
                    if n >= HELD:
                        learn(held)
                        held, n = [], 0
        learn(held)
        if not golds.any():
            return
        seen[0] = 0  # pads stay zero
        in_class = np.where(m.class_of < m.own_classes, golds[m.class_of], 0)
        in_class[0] = 0

        def given(k: int, at: np.ndarray, w: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            bytes_ = [at.astype(np.int32).tobytes(), w.astype(np.float64).tobytes(), np.ascontiguousarray(v, np.float32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part], pa.int64()), *(pa.array([x], pa.binary()) for x in bytes_)], ["slice", "part", "at", "seen", "own"])

        yield given(-1, np.zeros(1), golds.sum(keepdims=True), np.concatenate([p.ravel() for p in params[1:4]])[None])
        for k in range(0, size, SLICE):
            at = k + np.flatnonzero(seen[k : k + SLICE])
            if len(at):
                yield given(k, at - k, seen[at], params[0][:, at].transpose(1, 0, 2).reshape(len(at), -1))
            at = k + np.flatnonzero(in_class[k : k + SLICE])
            if len(at):
                yield given(-2 - k, at - k, in_class[at], params[4][at])

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        total, mean = np.zeros(SLICE), None
        for r in rows.sort_values("part").itertuples():
            at, n = np.frombuffer(r.at, np.int32), np.frombuffer(r.seen, np.float64)
            own = np.frombuffer(r.own, np.float32).reshape(len(at), -1)
            mean = np.zeros((SLICE if r.slice != -1 else 1, own.shape[1])) if mean is None else mean
            total[at] += n
            mean[at] += n[:, None] * own
        at = np.flatnonzero(total)
        mean = (mean[at] / total[at, None]).astype(np.float32)
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "part": rows["part"].iloc[:1] // FAN, "at": [at.astype(np.int32).tobytes()], "seen": [total[at].tobytes()], "own": [mean.tobytes()]})

    rows = encoded.mapInArrow(run, schema)
    while parts > 1:
        rows = rows.groupBy("slice", F.floor(F.col("part") / FAN).alias("_g")).applyInPandas(lambda own: average(own), schema)
        parts = -(-parts // FAN)
    for r in rows.toLocalIterator():
        k, at = r["slice"], np.frombuffer(r["at"], np.int32)
        v = np.frombuffer(r["own"], np.float32).reshape(len(at), -1)
        if k >= 0:
            model.params[0][:, k + at] = v.reshape(len(at), len(SIDES), -1).transpose(1, 0, 2)
        elif k == -1:
            upto = 0
            for p in model.params[1:4]:
                p[:] = v[0, upto : upto + p.size].reshape(p.shape)
                upto += p.size
        else:
            model.params[4][-2 - k + at] = v
    model.squares = None
    return model


def fit_numbers(model: Model, encoded: DataFrame, s: Settings, id_col: str) -> Model:
    return train_on_all(train(model, sampled(encoded, model, s, id_col), s), encoded, s)


def fit_lm(df: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts over all documents; the network first on a sample of spans, then on all words of all documents.

    The averages depend on the input's partitions. Null texts and ids are fine; an empty table gives
    a model of no words.
    """
    model = fit_counts(df, s, text_col)
    return fit_numbers(model, checkpoint(spread(encode(df, model, id_col, text_col))), s, id_col)


def score_numbers(encoded: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_words, log_likelihood, perplexity from ``encode``'s rows."""
    kind = encoded.schema[id_col].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, 256, 1 << 20):
            many = [np.frombuffer(x, m.kind()) for x in b.column(1).to_pylist()]
            n = np.array([len(x) for x in many], np.int64)
            logs = m.log_likelihoods(many)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(logs), pa.array(np.exp(-logs / np.maximum(n, 1)))], [id_col, "n_words", "log_likelihood", "perplexity"])

    return encoded.select(id_col, "numbers").mapInArrow(run, f"`{id_col}` {kind}, n_words long, log_likelihood double, perplexity double")


def score_lm(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, log_likelihood (summed), perplexity of every row.

    Null and blank texts have no words, log-likelihood 0 and perplexity 1. Whole texts count. Rows
    are neither joined nor dropped; other columns are not read; no shuffle. The model (bounded by
    its settings) is broadcast.
    """
    return score_numbers(encode(df, model, id_col, text_col), model, id_col)


def lm_scores(df: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score_lm`` of every row by a model of these same rows (``fit_lm``); texts are read twice, once for the counts."""
    model = fit_counts(df, s, text_col)
    encoded = checkpoint(spread(encode(df, model, id_col, text_col)))
    return score_numbers(encoded, fit_numbers(model, encoded, s, id_col), id_col)
