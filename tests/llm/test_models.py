"""Operators that learn: held-out accuracy, brute force for their parts, odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import langid, lmscore, toxicity
from lexweave.llm.common import held_out

from .fixtures import documents, empty, odd

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def languages(docs):
    return langid.fit_langid(docs)


@pytest.fixture(scope="module")
def toxic(docs, labels):
    return toxicity.fit_toxicity(docs, labels)


def test_language_of_held_out_documents(docs, languages):
    got = langid.predict_language(docs, languages).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id"))).collect()
    right = [r["lang"] == r["lang_pred"] for r in got]
    assert np.mean(right) > 0.98
    assert np.mean([r["rejected"] for r in got]) < 0.03
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_learns_only_from_three_quarters(docs, languages):
    spoilt = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).repartition(7)
    again = langid.fit_langid(spoilt)
    assert again.langs == languages.langs and np.array_equal(again.table, languages.table) and again.limit == languages.limit


def test_long_texts_and_many_languages_teach(spark):
    words = {f"l{k:03d}": [chr(97 + k % 26) * 2 + chr(97 + (k * 7 + j) % 26) + chr(97 + k // 26) * 3 for j in range(6)] for k in range(140)}
    rows = [(100 * k + i, " ".join(w[(i + j) % 6] for j in range(40 if i else 30_000)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit_langid(df)
    assert len(m.langs) == 140  # none is left out
    long = langid.fit_langid(df.filter("length(text) > 100000"), langid.Settings(epochs=1))
    assert len(long.langs) > 80


def test_language_sums_as_by_brute_force(languages):
    rows = len(languages.table) - 1
    table = np.random.default_rng(0).normal(size=(rows + 1, 3))
    table[-1] = 0
    texts = ["Hello wörld", "", "a", "b2b cc", "x" * 50]
    total, count = langid.sums(texts, table)
    old = langid.PIECE
    langid.PIECE = 7  # pieces that cut words
    try:
        assert np.allclose(langid.sums(texts, table)[0], total)
    finally:
        langid.PIECE = old
    for k, text in enumerate(texts):
        runs = []
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            edged = f"\0{word}\0"
            runs += [edged[i : i + n] for n in langid.ORDERS for i in range(len(edged) - n + 1)]
        assert count[k] == len(runs)


def test_language_of_odd_rows(spark, languages):
    got = langid.predict_language(odd(spark), languages).collect()
    assert len(got) == odd(spark).count()
    for r in got:
        if r["doc_id"] in (2, 3, 4, 5):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in languages.langs
    assert langid.predict_language(empty(spark), languages).count() == 0
    assert set(langid.keep_known(odd(spark), languages).columns) == set(odd(spark).columns)
    marks = spark.createDataFrame([(1, "\u0301"), (2, "\u0e31 \u0301\u0301"), (3, "e\u0301t\u0301")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in langid.predict_language(marks, languages).orderBy("doc_id").collect()] == [True, True, False]
    nothing = langid.fit_langid(empty(spark))
    assert {r["lang_pred"] for r in langid.predict_language(odd(spark), nothing).collect()} == {"und"}


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, m).join(labels, "doc_id").filter(held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).collect()
    y, found = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows]) >= 0.3
    assert (found & (y == 1)).sum() >= 0.8 * y.sum() > 50
    assert (found & (y == 0)).sum() <= 0.01 * (y == 0).sum()


def test_logistic_on_separable_rows_stays_bounded():
    x = np.zeros((200, len(toxicity.FEATURES)))
    x[:100, 0] = 5.0
    w, bias = toxicity.logistic(x, np.array([1.0] * 100 + [0.0] * 100))
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert p[:100].min() > 0.9 and p[100:].max() < 0.1 and np.abs(w).max() < 20


def test_near_copies_share_a_sign():
    words = [f"w{i}" for i in range(200)]
    a, b = toxicity.signature(" ".join(words)), toxicity.signature(" ".join([*words[:100], "other", *words[101:]]))
    assert any(x == y for x, y in zip(a, b)) and not any(x == y for x, y in zip(a, toxicity.signature("something else entirely is written here")))
    assert len(toxicity.signature("")) == len(toxicity.SIGNS)


def edits(a: str, b: str) -> int:
    """Edits and swaps of neighbours between two words, by the full table."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_as_by_brute_force():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abc"), int(rng.integers(1, 7))))
    terms = sorted({word() for _ in range(60)})
    trie = toxicity.Trie(terms)
    for _ in range(300):
        w = word()
        assert sorted(trie.near(w)) == [t for t in terms if edits(t, w) <= 1], w


def test_quotation_counts_less():
    m = toxicity.Model(terms={"foulterm": 3.0}, weights=np.array([1.0, 1, 1, 0, 0, 0]), bias=-3.0)
    free, quoted, said, typo, clean = (m.features(x) for x in ("you are a foulterm today", 'she wrote "you are a foulterm today" once', "the word foulterm is old", "you are a foultrem today", "you are a friend today"))
    assert free[0] > said[0] > quoted[0] > 0 and typo[2] > 0 and sum(clean) == 0


def test_toxicity_of_odd_rows(spark, docs, labels, toxic):
    got = toxicity.score_toxicity(odd(spark), toxic).collect()
    assert len(got) == odd(spark).count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(empty(spark), toxic).count() == 0
    assert toxicity.drop_toxic(odd(spark), toxic).count() == odd(spark).count()
    blank = toxicity.fit_toxicity(docs, labels.limit(0))
    assert max(r["score"] for r in toxicity.score_toxicity(docs, blank).collect()) < 0.3
    void = labels.selectExpr("cast(null as long) doc_id", "quality", "toxic")
    assert not toxicity.fit_toxicity(docs, labels.unionByName(void)).terms.keys() ^ toxic.terms.keys()


def test_lm_scores_as_by_brute_force(spark, sf):
    docs = documents(spark, sf)
    s = lmscore.Settings(vocabulary=500, own_classes=8, rare_classes=4, sample_docs=50)
    m = lmscore.fit_lm(docs, s)
    got = {r["doc_id"]: r for r in lmscore.score_lm(docs, m).collect()}
    tables, lift, out, bias, inner = m.params
    words = {n: w for w, n in m.numbers.items()}
    for r in docs.filter("n_chars < 3000").limit(15).collect():
        ids = m.read(r["text"]).tolist()
        total = 0.0
        for i, own in enumerate(ids):
            around = [ids[i + d] if 0 <= i + d < len(ids) else 0 for d in lmscore.SIDES]
            h = np.tanh(lift + sum(tables[k][w] for k, w in enumerate(around)))
            z = h @ out + bias
            total += z[m.class_of[own]] - np.log(np.exp(z).sum())
            if own in words:
                mates = [n for n in words if m.class_of[n] == m.class_of[own]]
                y = {n: h @ inner[n, :-1] + inner[n, -1] for n in mates}
                total += y[own] - np.log(sum(np.exp(v) for v in y.values()))
            else:
                total += m.share[own]
        assert got[r["doc_id"]]["n_words"] == len(ids)
        assert got[r["doc_id"]]["log_likelihood"] == pytest.approx(total, rel=1e-3)
    both = {r["doc_id"]: r["log_likelihood"] for r in lmscore.lm_scores(docs, s).collect()}
    assert both == pytest.approx({i: r["log_likelihood"] for i, r in got.items()}, rel=1e-6)


def test_lm_slopes_as_by_differences():
    """The training's gradients against differences of the loss."""
    rng = np.random.default_rng(4)
    m = lmscore.Model({f"w{i}": i + 1 for i in range(6)}, np.array([0, 0, 0, 0, 1, 1, 1, 2]), np.zeros(8), 1, 2)
    params = [rng.normal(0, 0.5, shape) for shape in ((4, 8, 3), (3,), (3, 3), (3,), (8, 4))]
    params[0][:, 0] = 0
    flat = lmscore.padded([np.array([1, 2, 3, 7, 4, 5, 6, 1, 1])])
    places = np.flatnonzero(flat)
    m.share = np.zeros(8)

    def loss() -> float:
        m.params = params
        return -float(m.log_likelihoods([flat[2:-2]])[0]) / len(places)

    before, old = loss(), [p.copy() for p in params]
    squares = [np.ones(p.shape) * 1e12 for p in params]
    lmscore.descend(m, params, squares, flat, places, 100, 1e6)  # a step is now the slope itself
    slopes = [o - p for o, p in zip(old, params, strict=True)]
    for p, o, slope in zip(params, old, slopes, strict=True):
        for at in np.ndindex(p.shape):
            if p is params[0] and at[1] == 0:
                continue
            for q, v in zip(params, old, strict=True):
                q[...] = v
            p[at] = o[at] + 1e-5
            assert (loss() - before) / 1e-5 == pytest.approx(slope[at], abs=1e-4)


def test_lm_prefers_text_to_shuffled_text(spark, docs):
    m = lmscore.fit_lm(docs, lmscore.Settings(vocabulary=2000, epochs=3))
    rng = np.random.default_rng(5)
    ids = [m.read(r["text"]) for r in docs.filter("n_chars between 500 and 5000").limit(60).collect()]
    mixed = [rng.permutation(x) for x in ids]
    assert np.mean(m.log_likelihoods(ids) > m.log_likelihoods(mixed)) > 0.8
    assert {(r["n_words"], r["log_likelihood"], r["perplexity"]) for r in lmscore.score_lm(odd(spark), m).filter("doc_id in (2, 3, 4)").collect()} == {(0, 0.0, 1.0)}
    assert lmscore.score_lm(empty(spark), lmscore.fit_lm(empty(spark))).count() == 0
    assert lmscore.lm_scores(odd(spark)).count() == odd(spark).count()


def test_words_within_a_class_depend_on_their_context(spark):
    """Two words of one class, each only beside its own neighbours: the second softmax tells them apart."""
    rng = np.random.default_rng(6)
    texts = [" ".join("red apple falls" if rng.random() < 0.5 else "blue whale swims" for _ in range(200)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    m = lmscore.fit_lm(docs, lmscore.Settings(own_classes=1, rare_classes=1, pass_batch=256))
    right, wrong = m.log_likelihoods([m.read("red apple falls"), m.read("red whale falls")])
    assert right > wrong + 2


def test_lm_learns_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "FAN", 2)  # averages of averages
    word = lambda i: f"w{i:03d}"
    texts = [" ".join(word(10 * i + j % 10) for j in range(60)) for i in range(30)] + [" ".join(word(900 + j % 10) for j in range(20_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    s = lmscore.Settings(sample_docs=1)
    m = lmscore.fit_lm(docs, s)
    start = np.random.default_rng(s.seed).normal(0, 0.05, m.params[0].shape).astype(np.float32)
    assert len(m.numbers) == 310
    assert all(np.abs(m.params[0][:, n] - start[:, n]).max() > 0 for n in m.numbers.values())


def test_vocabulary_follows_the_distinct_words(spark):
    docs = spark.createDataFrame([(i, f"a{i} a{i} b{i}") for i in range(100)], "doc_id long, text string")
    assert len(lmscore.fit_counts(docs, lmscore.Settings(vocabulary=10, vocabulary_root=7.1)).numbers) == 100
    assert len(lmscore.fit_counts(docs, lmscore.Settings(vocabulary=10, vocabulary_root=0.5)).numbers) == 10


def test_words_are_looked_up_once_however_often_they_stand(monkeypatch):
    m = lmscore.Model({"a": 1, "b": 2}, np.array([0, 0, 0, 1, 2, 3, 4]), np.zeros(7), 4, 1)
    looked: list[str] = []
    rare_class = lmscore.rare_class
    monkeypatch.setattr(lmscore, "rare_class", lambda word, classes: looked.append(word) or rare_class(word, classes))
    own = m.read(" ".join(f"a w{i}ing\u00a0X \t B" for i in range(1000)) + "\n")
    assert own.tolist() == [1, 3 + rare_class("\u00a0x", 4), 2] * 1000
    assert len(looked) == 1


def test_counts_of_words_are_made_before_rows(spark):
    """Spark gets each distinct word of a slice once, not a row for every word."""
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(["A b\x1c \n b\x1c", None, " ", "\u0130 a A "] * 500)], "doc_id long, text string").coalesce(1)
    counts = lmscore.count_words(docs)
    assert {r["word"]: r["n"] for r in counts.collect()} == {"a": 1500, "b\x1c": 1000, "i\u0307": 500}
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", [0.5, 300.0])
def test_lm_slopes_and_scores_of_large_logits(size):
    """Logits too large for powers of e are shifted, all others are not; both are as in float64."""
    rng = np.random.default_rng(8)
    m = lmscore.Model({f"w{i}": i + 1 for i in range(6)}, np.array([0, 0, 0, 0, 1, 1, 1, 2]), np.zeros(8), 1, 2)
    params = [rng.normal(0, size, shape).astype(np.float32) for shape in ((4, 8, 4), (4,), (4, 3), (3,), (8, 5))]
    params[0][:, 0] = 0
    assert lmscore.calm(np.vstack(params[2:4]), params[4]) == (size < 1)
    flat = lmscore.padded([rng.integers(1, 8, 3000)])
    places = np.flatnonzero(flat)
    ends = []
    for kind in (np.float32, np.float64):
        own, squares = [p.astype(kind) for p in params], [np.ones(p.shape, kind) for p in params]
        lmscore.descend(m, own, squares, flat, places, 3000, 0.1)
        m.params = [p.astype(kind) for p in params]
        ends.append((*own, m.log_likelihoods([flat[2:-2]])))
    for a, b in zip(*ends, strict=True):
        assert np.isfinite(a).all() and a == pytest.approx(b, rel=1e-3, abs=1e-3)


def test_toxicity_in_a_script_without_spaces(spark):
    """Sentences are one run of letters each; a term stands anywhere in them."""
    rng = np.random.default_rng(12)
    plain = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    said = lambda i: "".join(rng.choice(plain, 60)[:30]) + ("惡言語" if i % 2 else "") + "".join(rng.choice(plain, 30)) + "。" + "".join(rng.choice(plain, 50))
    docs = spark.createDataFrame([(i, said(i)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    m = toxicity.fit_toxicity(docs, labels)
    assert any(t.strip(toxicity.PIECE_MARK) in "惡言語" for t in m.terms) and not any(s.startswith(toxicity.PIECE_MARK) for s in m.stems)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, m).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in got)


def test_pieces_of_long_runs():
    assert toxicity.terms_of("ab") == [] and toxicity.terms_of("x" * 39) == ["x" * 39]
    assert len(toxicity.terms_of("x" * 40)) == sum(41 - n for n in toxicity.PIECES)
    m = toxicity.Model(terms={"foulterm": 3.0}, weights=np.array([1.0, 1, 1, 0, 0, 0]), bias=-3.0)
    assert m.features("foulterm" + "x" * 40)[0] == 0  # a word within a long run of letters is none
    assert m.features("a-" * 20 + "b")[0] == 0
