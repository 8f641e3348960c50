"""The pipeline against brute force, stage by stage, and over odd and empty tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from lexweave.llm import langid, toxicity

from .fixtures import documents, empty, odd
from .test_bpe import library
from .test_groups import naive_components, naive_fingerprint


def rows_of(df):
    return [tuple(r[c] for c in pipeline.COLUMNS) for r in df.select(pipeline.COLUMNS).collect()]


def naive_one_of_each(rows):
    fps = [naive_fingerprint(r[1]) for r in rows]
    top = naive_components(list(enumerate(fps)))
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[top[i]].append(r)
    return {g: min((r[0] is None, r[0] or 0) for r in own) for g, own in groups.items()}, groups


def naive_mix(rows):
    """Copies of each row, by sorting each source's rows by hash."""
    size = lambda t: len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).replace("\x1c", "x").split(" ")) - (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("")
    place = lambda i: int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sums = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(sums.values())
    while free:  # reshare until none is above
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * sums[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sums[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    out = Counter()
    for s in sources:
        own = [r for r in rows if r[3] == s]
        whole = int(target[s] // sums[s]) if sums[s] else 1
        rest, upto, limit = target[s] - whole * sums[s], 0, None
        by = defaultdict(int)
        for r in own:
            by[place(r[0])] += size(r[1])
        for p in sorted(p for p in by if by[p]):
            if upto + by[p] > rest:
                limit = p + 1 if upto + by[p] - rest < rest - upto else p
                break
            upto += by[p]
        for r in own:
            out[r] += whole + (limit is not None and place(r[0]) < limit)
    return +out


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_stages_as_by_brute_force(spark, sf, which, tmp_path):
    docs = documents(spark, sf) if which == "documents" else odd(spark).selectExpr("*", "cast(length(text) as long) n_chars")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before = rows_of(docs)
        if name == "language ID":
            rejected = langid.fit_langid(docs).predict([r[1] for r in before])[2]
            assert Counter(rows_of(out)) == Counter(r for r, no in zip(before, rejected) if not no)
            assert which == "odd" or out.count() > 0.9 * len(before)
        elif name == "toxicity":
            m = toxicity.fit_toxicity(docs, labels)
            scores = m.scores(np.array([m.features(r[1]) for r in before]))
            assert Counter(rows_of(out)) == Counter(r for r, s in zip(before, scores) if s < 0.3)
        elif name == "SimHash near-dedup":
            first, groups = naive_one_of_each(before)
            got = rows_of(out)
            assert len(got) == len(groups)
            for g, own in groups.items():
                assert sum(r in own and (r[0] is None, r[0] or 0) == first[g] for r in got) == 1
        elif name == "mixing sources to target weights":
            assert Counter(rows_of(out)) == naive_mix(before)
        else:
            t = library()
            want = Counter()
            for r in before:
                ids = t.encode(r[1] or "", add_special_tokens=False).ids
                want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
            assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()) == want
        assert k == len(pipeline.STAGES) - 1 or out.columns == pipeline.COLUMNS
        docs = out


def test_stages_over_an_empty_table(spark, sf):
    docs = empty(spark).selectExpr("*", "1L n_chars")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_run(spark, sf):
    got = pipeline.run(spark, sf)
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and got.count() > 0
