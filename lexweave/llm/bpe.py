"""Operator 3: exact BPE encoding by backtracking over longest matches, and decoding by an offset table.

A pre-token is encoded from left to right. An Aho-Corasick automaton over the vocabulary finds the
longest token at each position; a token may follow its predecessor only if merging by rank would
leave that boundary open, which a table of pairs (filled on demand, by undoing merges) tells. Where
no token fits, the encoder drops the predecessor, marks its end as closed, and goes on with shorter
tokens. Each position closes once, so the work is linear in the pre-token's length. The boundaries
that are left are those of merging by rank.

White space never joins a token in this vocabulary, so encodings are kept by white-space-delimited
chunk in a bounded dictionary in each worker.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Stands for the end-of-word mark of the vocabulary behind the bytes of a pre-token.
END = "Ā"
MARK = "</w>"
#: Chunks whose encodings a worker keeps in each of two generations; a full one replaces the older.
KEPT_CHUNKS = 300_000
#: Pairs of tokens whose compatibility a worker keeps.
KEPT_PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A vocabulary of the tokenizers library: BPE on bytes with end-of-word marks, lower case, white space dropped."""

    def __init__(self, source: str) -> None:
        import ahocorasick
        import regex

        spec = json.loads(source)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.pre = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

        def plain(token: str) -> str:
            end = token.endswith(MARK)
            return "".join(chr(letters[c]) for c in (token[: -len(MARK)] if end else token)) + END * end

        self.merged: dict[tuple[int, int], int] = {}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.parts: list[tuple[int, int] | None] = [None] * size
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            new = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = new
            self.parts[new] = (vocab[a], vocab[b])
        self.fits: dict[tuple[int, int], bool] = {}
        #: Only tokens that merging can reach whole.
        strings = {plain(t): i for t, i in vocab.items()}
        self.ids = {s: i for s, i in strings.items() if self.parts[i] is None or self.compatible(*self.parts[i], below=i)}
        self.length = np.ones(size, np.int64).tolist()
        self.shorter: list[int] = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.length[i] = len(s)
            self.shorter[i] = next((self.ids[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.ids), -1)
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        written = [b""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            written[i] = t.encode() + b" "
        self.blob = np.frombuffer(b"".join(written), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in written])])
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging by rank leaves the boundary between two tokens open.

        Tokens are numbered by the rank of their merge. The two are taken apart at the boundary,
        the younger first; if at any time the touching parts had a merge older than the step that
        was just undone, merging would have crossed. ``below``: the merge of the two themselves,
        which may cross; an older one may not.
        """
        limit = below if below is not None else len(self.parts)
        while True:
            both = self.merged.get((left, right))
            if both is not None and both < limit:
                return False
            a, b = self.parts[left], self.parts[right]
            if a is not None and (b is None or left > right):
                left, limit = a[1], min(limit, left)
            elif b is not None:
                # An equal rank on the left comes first, as merges run from left to right.
                right, limit = b[0], min(limit, right + 1)
            else:
                return True

    def fit(self, left: int, right: int) -> bool:
        key = (left, right)
        if (ok := self.fits.get(key)) is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            ok = self.fits[key] = self.compatible(left, right)
        return ok

    def piece(self, word: str) -> list[int]:
        """Token ids of one pre-token, given as its bytes in Latin-1 with END behind them."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        longest = [-1] * n
        length, shorter, fit = self.length, self.shorter, self.fit
        for end, token in self.automaton.iter(word):
            longest[end + 1 - length[token]] = token  # later ends are longer
        open_ = [True] * (n + 1)
        open_[n - 1] = False  # the mark alone is no token
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0 and not (open_[at + length[token]] and (last < 0 or fit(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            elif last < 0:
                raise ValueError("the vocabulary lacks single bytes")
            else:
                open_[at] = False
                token = out.pop()
                at -= length[token]
        return out

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space, already normalised, as little-endian uint32."""
        ids: list[int] = []
        for x in self.pre.findall(chunk):
            ids += self.piece((x if x.isascii() else x.encode().decode("latin-1")) + END)
        return np.array(ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case letter by letter: no final sigma
        text = text.lower()
        # str.split also parts at U+001C to U+001F, which are no white space to the library.
        chunks = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [x for x in self.space.split(text) if x]
        kept, out = self.kept, []
        for c in chunks:
            ids = kept.get(c)
            if ids is None:
                ids = self.older.get(c) or self.chunk(c)
                if len(c) < 256:
                    if len(kept) >= KEPT_CHUNKS:
                        self.older = kept
                        kept = self.kept = {}
                    kept[c] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.special_re.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += [self.plain(text[at : m.start()]), int(self.special[m[0]]).to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, many: list[bytes]) -> list[str]:
        """Texts of several id sequences: the vocabulary's strings between single spaces."""
        ids = np.frombuffer(b"".join(many), "<u4")
        counts = np.array([len(x) // 4 for x in many])
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        # Each output byte's place in the blob: its own number, moved by where its token lies.
        text = self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)].tobytes()
        to = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [text[a : max(a, b - 1)].decode() for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


_codecs: dict[int, Codec] = {}


def codec(source: str) -> Codec:
    """One codec a worker process and vocabulary."""
    key = hash(source)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(source)
    return _codecs[key]


def bpe_round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text.

    ``vocabulary``: path of a tokenizers file, read on the driver and broadcast (under 2 MB).
    Returns ``id_col``, n_tokens long, ids binary (little-endian uint32), decoded string. Null and
    empty texts give no ids and an empty string; rows are neither joined nor dropped, so ties and
    repeated rows stay; other columns are not read. No shuffle; texts are encoded whole, some
    hundred rows at a time.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for b in slices(batches, 256):
            ids = [c.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(c.decode(ids), pa.string())], [id_col, "n_tokens", "ids", "decoded"])

    picked = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")


def encode_texts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``bpe_round_trip``, without decoding: ``id_col``, n_tokens, ids."""
    with open(vocabulary, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for b in slices(batches, 256):
            ids = [c.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """SHA-256 of ids and of decoded texts."""
    return df.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
