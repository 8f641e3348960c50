import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexweave.llm import bpe, packing

from .fixtures import documents, empty, odd

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    return t


def test_documents_as_the_library(spark, sf):
    t = library()
    docs = documents(spark, sf)
    got = {r["doc_id"]: r for r in bpe.digests(bpe.bpe_round_trip(docs, VOCABULARY)).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts_as_the_library(spark):
    t = library()
    texts = [None, "", " ", "don't", "a\x1cb", "ΑΣ ΑΣ.", "İstanbul", "é", "漢字かな", "🙂🙃", "zz" * 300, "<|endoftext|>x", "a</w>b", "\x85 　", "ǅ ﬁ", "aaaaaaaaaaaaaaaaaaaaaaaab", "1234567890", "\u0000a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.bpe_round_trip(df, VOCABULARY).collect():
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids, texts[r["doc_id"]]
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_round_trip(odd(spark), VOCABULARY).count() == odd(spark).count()
    assert bpe.bpe_round_trip(empty(spark), VOCABULARY).count() == 0


def test_random_letters_as_the_library(spark):
    t = library()
    c = bpe.codec(open(VOCABULARY, encoding="utf-8").read())
    rng = np.random.default_rng(1)
    for alphabet in ("ab", "the rin", "aeioust", "ßéà-'", "01.,"):
        for _ in range(150):
            text = "".join(rng.choice(list(alphabet), int(rng.integers(1, 60))))
            assert np.frombuffer(c.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_best_fit_decreasing_as_by_scanning():
    rng = np.random.default_rng(2)
    for _ in range(30):
        length = int(rng.integers(3, 40))
        sizes = rng.integers(1, length + 1, int(rng.integers(1, 60))).tolist()
        rows = packing.best_fit_decreasing(sizes, length)
        free: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [f for f in free if f >= s]
            if fits:
                free[free.index(min(fits))] -= s
            else:
                free.append(length - s)
        assert sorted(length - sum(sizes[k] for k in r) for r in rows) == sorted(free)
        assert sorted(k for r in rows for k in r) == list(range(len(sizes)))


def test_packing_loses_nothing(spark, sf):
    docs = documents(spark, sf)
    rows = packing.pack_tokens(docs, VOCABULARY, length=256, window_tokens=5000)
    got = {r["doc_id"]: bytes(r["ids"]) for r in packing.unpack(rows).collect()}
    want = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode_texts(docs, VOCABULARY).collect() if r["n_tokens"]}
    assert got == want
    for r in rows.collect():
        cu = r["cu_seqlens"]
        assert len(r["ids"]) == 4 * 256 == len(r["position_ids"]) and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 256
        at = np.frombuffer(r["position_ids"], "<u4")
        assert all(at[a:b].tolist() == list(range(b - a)) for a, b in zip(cu, cu[1:]))
    # Little room is left: as many rows as the tokens need, and some.
    assert rows.count() * 256 < 1.1 * sum(len(x) // 4 for x in want.values()) + 256 * 20


def test_packing_of_odd_rows(spark, tmp_path):
    rows = packing.pack_tokens(odd(spark), VOCABULARY)
    assert sum(r["n_tokens"] for r in rows.collect()) == sum(r["n_tokens"] for r in bpe.encode_texts(odd(spark), VOCABULARY).collect())
    assert packing.pack_tokens(empty(spark), VOCABULARY).count() == 0
    packing.write_packed(rows, f"{tmp_path}/packed")
    assert spark.read.parquet(f"{tmp_path}/packed").count() == rows.count()


def test_packing_of_text_ids(spark, sf):
    docs = documents(spark, sf).limit(50).selectExpr("'d' || doc_id doc_id", "text")
    rows = packing.pack_tokens(docs, VOCABULARY, length=256)
    got = {r["doc_id"]: bytes(r["ids"]) for r in packing.unpack(rows).collect()}
    assert got == {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode_texts(docs, VOCABULARY).collect() if r["n_tokens"]}
