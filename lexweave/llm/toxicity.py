"""Operator 2: toxicity by a learned lexicon that tolerates misspelling, and by context.

Terms and stems that mark toxic documents are learned from labelled rows. Every distinct word of the
texts is looked up once: as a term, as a stem with an ending, or, where neither fits, by running a
Levenshtein automaton (one edit or one swap) over the trie of the terms. Each hit is scored in its
window: inside quotation marks, or near words of report, it counts for less than free abuse. The sums
of those scores go through a logistic model whose weights come from labelled rows that the lexicon
did not see.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learns, slices

LETTERS = re.compile(r"[^\W\d_]+")
#: Runs of so many letters, as in scripts without spaces, count by all their pieces of 2 to 6 letters, which a mark tells from words.
LONG_RUN, PIECES, PIECE_MARK = 40, range(2, 7), "\x01"
#: Marks that open or close a quotation.
QUOTES = frozenset("\"'“”„«»‘’‹›")
#: Words of report in four languages; ambiguous short ones are left out.
REPORT = frozenset("said says called calls wrote writes quote quoted quotes quoting word words term phrase insult slur reported alleged sagte schrieb nannte zitierte wort zitat beleidigung écrit appelé déclaré insulte citation dijo escribió llamó palabra insulto cita".split())
CONTEXT = 6
QUOTED, REPORTED = 0.2, 0.5
#: Odd multipliers of the hash functions whose minima tell near copies.
SIGNS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)
#: Words whose lookup a worker remembers.
KEPT = 500_000
FEATURES = ("exact", "stem", "fuzzy", "densest", "held_back", "rate")


@dataclass(frozen=True)
class Settings:
    """toxic_docs and clean_docs bound the labelled sample, terms and stems the lexicon."""

    toxic_docs: int = 4000
    clean_docs: int = 16000
    terms: int = 5000
    stems: int = 500
    least_docs: int = 3
    evidence: float = 9.0
    shortest_fuzzy: int = 5


def terms_of(run: str) -> list[str]:
    """What a run of letters teaches and is looked up by: itself, from three letters on, or the pieces of a long one."""
    if len(run) < LONG_RUN:
        return [run] if len(run) > 2 else []
    return [PIECE_MARK + run[i : i + n] for n in PIECES for i in range(len(run) - n + 1)]


class Trie:
    """The terms as nested dictionaries; the key "" holds a node's term."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def near(self, word: str) -> list[str]:
        """Terms one edit or one swap of neighbours away, or equal: the automaton of ``word`` runs along the trie.

        A state is (place in the word, edits so far); a node is followed as long as a state lives.
        """
        n = len(word)
        found: list[str] = []
        start = frozenset({(0, 0), (1, 1)} if n else {(0, 0)})
        stack = [(self.root, start, "", frozenset())]
        while stack:
            node, states, last, swaps = stack.pop()
            if "" in node and any(n - i + e <= 1 for i, e in states):
                found.append(node[""])
            for c, child in node.items():
                if not c:
                    continue
                after, waiting = set(), set()
                for i, e in states:
                    if i < n and word[i] == c:
                        after.add((i + 1, e))
                    if not e:
                        after |= {(i, 1), (i + 1, 1)} if i < n else {(i, 1)}  # c is extra, or stands for word[i]
                        if i + 1 < n and word[i + 1] == c:
                            after.add((i + 2, 1))  # word[i] is extra
                            waiting.add(i)
                after |= {(i + 2, 1) for i in swaps if word[i] == c}
                if after:
                    stack.append((child, frozenset(after), c, frozenset(waiting)))
        return found


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    shortest_fuzzy: int = 5
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    bias: float = -6.0

    def ready(self) -> None:
        """What a worker needs beside the learned values; made once there."""
        fuzzy = [t for t in self.terms if len(t) >= self.shortest_fuzzy and t[0] != PIECE_MARK]
        self.trie = Trie(fuzzy)
        # One edit or swap leaves either the first or the last letters of a term as they are.
        self.edges: set[tuple[int, str]] = set()
        for t in fuzzy:
            k = 3 if len(t) >= 7 else 2
            for n in (len(t) - 1, len(t), len(t) + 1):
                self.edges |= {(n, t[:k] + "*"), (n, "*" + t[-k:])}
        self.stem_lengths = sorted({len(s) for s in self.stems})
        self.known: set[str] = set()
        self.flagged: dict[str, tuple[int, float]] = {}

    def look_up(self, word: str) -> tuple[int, float] | None:
        """(0 exact, 1 stem or 2 fuzzy; weight) of one word."""
        if (weight := self.terms.get(word)) is not None:
            return 0, weight
        for n in self.stem_lengths:
            if len(word) > n and (weight := self.stems.get(word[:n])) is not None:
                return 1, weight
        n = len(word)
        if n + 1 >= self.shortest_fuzzy and any((n, x) in self.edges for x in (word[:2] + "*", word[:3] + "*", "*" + word[-2:], "*" + word[-3:])):
            near = self.trie.near(word)
            if near:
                return 2, max(self.terms[t] for t in near)
        return None

    def chunk(self, chunk: str) -> tuple[int, float] | None:
        """The best hit in what stands between white space: its runs of letters, or all of it without outer marks."""
        runs = LETTERS.findall(chunk)
        best = None
        for x in runs:
            if len(x) >= LONG_RUN:
                found = [weight for t in terms_of(x) if (weight := self.terms.get(t)) is not None]
                hit = (0, max(found)) if found else None
            else:
                hit = self.look_up(x) if len(x) > 2 else None
            if hit and (best is None or hit[0] < best[0]):
                best = hit
        if best is None and len(runs) != 1 or (runs and len(runs[0]) < len(chunk.strip("".join(QUOTES) + ".,;:!?()[]{}"))):
            core = chunk.strip("".join(QUOTES) + ".,;:!?()[]{}")
            if best is None and 3 < len(core) and any(c.isalpha() for c in core):
                best = self.look_up(core)
        return best

    def features(self, text: str | None) -> list[float]:
        if not hasattr(self, "known"):
            self.ready()
        chunks = (text or "").lower().split()
        distinct = set(chunks)
        if new := distinct - self.known:
            if len(self.known) > KEPT:
                self.known.clear()
                self.flagged.clear()
                new = distinct
            for c in new:
                if hit := self.chunk(c):
                    self.flagged[c] = hit
            self.known |= new
        if self.flagged.keys().isdisjoint(distinct):
            return [0.0] * len(FEATURES)
        sums, held_back, at = [0.0, 0.0, 0.0], 0.0, []
        for i, c in enumerate(chunks):
            if c in self.flagged:
                kind, weight = self.flagged[c]
                share = self.context(chunks, i)
                sums[kind] += weight * share
                held_back += weight * (1 - share)
                at.append((i, weight * share))
        densest, low, run = 0.0, 0, 0.0
        for i, x in at:
            run += x
            while at[low][0] < i - 2 * CONTEXT:
                run -= at[low][1]
                low += 1
            densest = max(densest, run)
        return [*map(np.log1p, sums), float(np.log1p(densest)), float(np.log1p(held_back)), float(np.log1p(100 * sum(sums) / len(chunks)))]

    @staticmethod
    def context(chunks: list[str], i: int) -> float:
        """What a hit counts: less inside quotation marks, less beside words of report."""
        before, after = chunks[max(0, i - CONTEXT) : i + 1], chunks[i : i + CONTEXT + 1]
        opens = any(c[0] in QUOTES for c in before) and not any(c.rstrip(".,;:!?")[-1:] in QUOTES for c in before[:-1])
        closes = any(c.rstrip(".,;:!?")[-1:] in QUOTES for c in after)
        if opens and closes:
            return QUOTED
        near = {c.strip(".,;:!?()\"'") for c in chunks[max(0, i - CONTEXT) : i + CONTEXT + 1]}
        return REPORTED if near & REPORT else 1.0

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method with shortened steps, weights held small by ``penalty`` and, as hits never speak for a text, not below zero.

    The weight of what context held back may be negative.
    """
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    hold = np.full(a.shape[1], penalty)
    hold[-1] = 1e-3
    bounded = np.array([*(name != "held_back" for name in FEATURES), False])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ w)).sum() + (hold * w * w).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + hold * w
        # Weights at zero that the slope would push below stay there for this step.
        free = ~(bounded & (w <= 0) & (slope > 0))
        part = a[:, free]
        step = np.zeros_like(w)
        step[free] = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + np.diag(hold[free]), slope[free])
        size = 1.0
        while size > 1e-6:
            trial = np.where(bounded, np.maximum(w - size * step, 0), w - size * step)
            if (then := loss(trial)) < now:
                break
            size /= 2
        else:
            break
        done, w, now = now - then < 1e-9 * (1 + now), trial, then
        if done:
            break
    return w[:-1], float(w[-1])


def signature(text: str) -> list[int]:
    """Minima of SIGNS hash functions over a text's runs of five words; near copies share some of them."""
    import xxhash

    words = text.lower().split()
    runs = [" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass") for i in range(max(1, len(words) - 4))]
    h = np.array([xxhash.xxh64_intdigest(x) for x in runs], np.uint64)
    return [int(((h ^ (h >> np.uint64(29))) * np.uint64(k)).min() >> np.uint64(1)) for k in SIGNS]


def labelled(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """_toxic, _calibrates, _text of the sample: ids with the smallest hashes, one text of each group of near copies.

    The ids (``toxic_docs`` + ``clean_docs`` at most) are broadcast; a label given twice counts as
    the larger. Near copies share a minimum of ``signature``; were they all counted, any rare word
    of a text with many copies would look like a term.
    """
    own = labels.filter(learns(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_toxic"))
    place = F.xxhash64("_id")
    parts = [own.filter(F.col("_toxic") == k).orderBy(place, "_id").limit(most) for k, most in ((1, s.toxic_docs), (0, s.clean_docs))]
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([signature(x) for x in b.column(3).to_pylist()], pa.list_(pa.int64()))], ["_id", "_toxic", "_h", "_s"])

    signed = texts.join(ids, "_id").select("_id", "_toxic", F.xxhash64("_text").alias("_h"), "_text").mapInArrow(sign, f"_id {kind}, _toxic int, _h long, _s array<long>")
    found = signed.groupBy("_h").agg(F.min("_id").alias("_id"), F.max("_toxic").alias("_toxic"), F.min("_s").alias("_s")).collect()
    seen: set[tuple[int, int]] = set()
    rows = []
    for r in sorted(found, key=lambda r: (-r["_toxic"], r["_h"])):
        signs = set(enumerate(r["_s"]))
        if seen.isdisjoint(signs):
            rows.append(r)
        seen |= signs
    chosen = docs.sparkSession.createDataFrame([(r["_id"], r["_toxic"], r["_h"] % 4 == 0) for r in rows], f"_id {kind}, _toxic int, _calibrates boolean")
    return texts.join(F.broadcast(chosen), "_id").select("_toxic", "_calibrates", "_text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn lexicon and weights from labelled rows with ``learns(id)``, a sample of bounded size."""
    rows = labelled(docs, labels, s, id_col, text_col, label_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        docs_seen = [0, 0]
        for b in slices(batches):
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[toxic].update({t for w in set(LETTERS.findall(text.lower())) for t in terms_of(w)})
                docs_seen[toxic] += 1
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield told(counts)
        yield told(counts)
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([docs_seen[1]], pa.int64()), pa.array([docs_seen[0]], pa.int64())], ["term", "pos", "neg"])

    def told(counts: dict[int, Counter]) -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()), pa.array([counts[0][x] for x in names], pa.int64())], ["term", "pos", "neg"])
        counts[0].clear(), counts[1].clear()
        return out

    found = rows.filter("not _calibrates").select("_toxic", "_text").mapInArrow(count, "term string, pos long, neg long")
    # A term's prefixes of 4 to 7 letters may be stems; n: how many words share one.
    split = F.explode(F.array_distinct(F.concat(F.array(F.struct(F.col("term").alias("t"), F.lit(False).alias("stem"))), F.transform(F.filter(F.sequence(F.lit(4), F.lit(7)), lambda k: (k < F.length("term")) & ~F.col("term").startswith(PIECE_MARK)), lambda k: F.struct(F.substring(F.col("term"), F.lit(1), k).alias("t"), F.lit(True).alias("stem"))))))
    words = found.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = words.select("pos", "neg", split.alias("x")).groupBy("x.t", "x.stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum((F.col("pos") > 0).cast("int")).alias("n"))
    # No term can hold that is as common in clean documents as in toxic ones.
    rare = both.filter((F.col("t") == "") | (F.col("pos") >= s.least_docs) & (F.col("pos") > 2 * F.col("neg")) & (~F.col("stem") | (F.col("n") >= 4)))
    ranked = rare.withColumn("rank", F.when(F.col("t") == "", F.lit(1e18)).otherwise(F.col("pos") * F.log((F.col("pos") + 0.5) / (F.col("pos") + F.col("neg") + 1.0)) + F.col("pos")))
    got = ranked.orderBy(F.desc("rank"), "t", "stem").limit(4 * (s.terms + s.stems)).collect()
    pos_docs = sum(r["pos"] for r in got if r["t"] == "")
    neg_docs = sum(r["neg"] for r in got if r["t"] == "")
    model = Model(shortest_fuzzy=s.shortest_fuzzy)
    if not pos_docs or not neg_docs:
        return model
    base = pos_docs / (pos_docs + neg_docs)

    def evidence(r) -> float:
        """Log likelihood ratio of a term's share of toxic documents against the sample's."""
        p = r["pos"] / (r["pos"] + r["neg"])
        return r["pos"] * np.log(p / base) + (r["neg"] * np.log((1 - p) / (1 - base)) if r["neg"] else 0.0)

    def odds(r) -> float:
        return float(np.log((r["pos"] + 0.5) / (pos_docs + 1)) - np.log((r["neg"] + 0.5) / (neg_docs + 1)))

    strong = [r for r in got if r["t"] and evidence(r) >= s.evidence and r["pos"] / (r["pos"] + r["neg"]) > max(0.5, 2 * base)]
    for r in sorted((r for r in strong if r["stem"] and evidence(r) >= 2 * s.evidence and r["neg"] <= 0.03 * r["pos"]), key=lambda r: (len(r["t"]), -r["pos"]))[: s.stems]:
        if not any(r["t"][:k] in model.stems for k in range(4, len(r["t"]))):
            model.stems[r["t"]] = odds(r)
    model.terms = {r["t"]: odds(r) for r in [r for r in strong if not r["stem"]][: s.terms]}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.features(x) for x in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    seen = sorted((r["y"], tuple(r["x"])) for r in rows.filter("_calibrates").select("_toxic", "_text").mapInArrow(describe, "y int, x array<double>").collect())
    if seen and 0 < sum(y for y, _ in seen) < len(seen):
        model.weights, model.bias = logistic(np.array([x for _, x in seen]), np.array([float(y) for y, _ in seen]))
    else:
        model.weights, model.bias = np.array([1.0, 1.0, 0.5, 0.5, 0.0, 0.0]), -3.0
    return model


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score for every row, from the whole text alone.

    Null, empty and hitless texts get the model's lowest score. Rows are neither joined nor dropped;
    other columns are not read; no shuffle. The model (bounded numbers of terms and stems) is
    broadcast.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            x = np.array([m.features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(x))], [id_col, "score"])

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def drop_toxic(df: DataFrame, model: Model, limit: float = 0.3, text_col: str = "text") -> DataFrame:
    """All rows that score under ``limit``, with their columns as they were; decided row by row in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            x = np.array([m.features(t) for t in b.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(m.scores(x) < limit))

    return df.mapInArrow(run, df.schema)
