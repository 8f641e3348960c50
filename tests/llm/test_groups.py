"""SimHash, mixing, quality rules, URL filters and winnowing against brute force."""

import datetime as dt
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexweave.llm import common, mixing, quality, queries, simhash, urlfilter, winnow

from ..oracle import differences
from .fixtures import documents, empty, odd


def naive_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in " \t\n\x0b\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(rows, radius=2):
    """{id: smallest id reachable} by comparing all pairs."""
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and (a ^ b).bit_count() <= radius:
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: top(i) for i, _ in rows}


def test_fingerprints_and_components_as_by_all_pairs(spark, sf):
    docs = documents(spark, sf)
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs).collect()}
    rows = [(r["doc_id"], naive_fingerprint(r["text"])) for r in docs.collect()]
    assert {i: f"{fp:016x}" for i, fp in rows} == {i: r["fingerprint"] for i, r in got.items()}
    assert naive_components(rows) == {i: r["component_id"] for i, r in got.items()}
    one = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(naive_components(rows).values()))


def planted(seed, n=400):
    """Random fingerprints, chains of near ones, and a crowd that agrees on most bits."""
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 1 << 63, n, np.uint64).tolist()
    for x in out[:40]:
        for _ in range(4):
            x ^= 1 << int(rng.integers(64))
            x ^= 1 << int(rng.integers(64))
            out.append(x)
    crowd = int(rng.integers(1 << 62))
    for _ in range(600):
        x = crowd
        for b in rng.choice(64, int(rng.integers(0, 8)), replace=False).tolist():
            x ^= 1 << b
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("crowd", "held"), [(3, 16), (40, 1 << 17), (4096, 64)])
def test_links_join_what_all_pairs_join(spark, crowd, held, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", held)
    fps = planted(crowd)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df, crowd=crowd)  # a small limit deals crowded cells on
    roots = {r["fp"]: r["root"] for r in simhash.components(edges).collect()}
    want = naive_components(list(zip(signed, fps)))
    assert {x: roots.get(x, x) for x in signed} == want


def test_long_chain_is_one_component(spark):
    rng = np.random.default_rng(9)
    ids = rng.permutation(300).tolist()
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "fp long, to long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_blocks_leave_few_bits_open():
    left = {(1 << 64) - 1}
    for level in range(5):
        masks = simhash.block_masks(level, 3)
        assert sum(masks) == (1 << 64) - 1
        left = {x & ~m for x in left for m in masks}
    assert max(x.bit_count() for x in left) <= 11


def test_one_row_of_each_component_stays(spark):
    base = " ".join(f"w{i}" for i in range(400))
    other = " ".join(f"v{i}" for i in range(400))
    rows = [(5, base, "a"), (3, base, "b"), (3, other, "c"), (3, other, "c"), (None, base, "d"), (None, "lone text of no other", "e"), (None, "lone text of no other", "f"), (9, "unlike all of them here", "g")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _kept string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(3, base), (3, other), (None, "lone text of no other"), (9, "unlike all of them here")])


def test_simhash_of_odd_rows(spark):
    got = simhash.simhash_components(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert {by[i][0]["fingerprint"] for i in (2, 3, 4)} == {"0" * 16} and {by[i][0]["component_id"] for i in (2, 3, 4)} == {2}
    assert len(by[8]) == 2 and by[None][0]["component_id"] == 8
    assert simhash.simhash_components(empty(spark)).count() == 0
    kept = simhash.keep_one(odd(spark))
    assert Counter(r["doc_id"] for r in kept.collect())[8] == 1 and set(kept.columns) == set(odd(spark).columns)


@pytest.mark.parametrize("name", ["op5_mixing", "op7_urlfilter", "op10_quality"])
def test_queries_as_their_sql(spark, sf, name):
    assert differences(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf) == ""


def test_mix_comes_near_its_targets(spark):
    rows = mixing.mix(documents(spark, "/root/testdata/sf0.01")).select("size", "source_size", "target", "taken").collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        target[key] = r["target"]
        largest[key] = max(largest[key], r["size"])
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[k] - target[k]) <= largest[k] for k in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum({k: k[0] for k in target}.values()))


def test_thresholds_nest(spark):
    rows = [("a", int(n), int(p)) for n, p in zip(np.random.default_rng(4).integers(1, 50, 300), np.random.default_rng(5).integers(0, 1 << 60, 300))]
    rows += [("a", 5, rows[0][2] + d) for d in range(6)]  # close hashes: several refinements
    sized = spark.createDataFrame([(k, s, p) for k, s, p in rows], "key string, size long, place long")
    last: set = set()
    for rest in (0.0, 100.0, 1000.0, 4000.0, 1e9):
        got = mixing.thresholds(sized, spark.createDataFrame([("a", rest)], "key string, rest double")).collect()
        order = sorted(rows, key=lambda r: r[2])
        total, want = 0, None
        for _, s, p in order:
            if total + s > rest:
                want = p + 1 if total + s - rest < rest - total else p
                break
            total += s
        assert ([r["threshold"] for r in got] or [None]) == [want]
        took = {p for _, _, p in rows if want is None or p < want}
        assert last <= took
        last = took


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == odd(spark).count() and all(r["target"] is not None for r in got)
    assert mixing.mix(empty(spark)).count() == 0
    rows = mixing.repeat_rows(odd(spark))
    assert set(rows.columns) == set(odd(spark).columns)
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter({r["doc_id"]: 0 for r in got} | Counter(i for r in got for i in [r["doc_id"]] * r["copies"])) - Counter()
    assert {r["_key"] for r in rows.collect()} == {"clash"}


def test_quality_of_odd_rows(spark):
    got = quality.judge_quality(odd(spark)).collect()
    assert len(got) == odd(spark).count() and all(r["kept"] is False for r in got)
    long = [r for r in got if r["doc_id"] == 6][0]
    assert (long["n_words"], long["word_chars"], long["n_repeat_words"], long["base_failed"]) == (40000, 160000, 40000, True)
    lines = [r for r in got if r["doc_id"] == 11][0]
    assert lines["n_dup_lines"] == 2
    assert quality.judge_quality(empty(spark)).count() == 0


def test_repeat_words_as_by_counting(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcd"), int(rng.integers(0, 40)))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' lang", "'y' source")
    for r in quality.judge_quality(df).collect():
        w = texts[r["doc_id"]].split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        assert r["n_repeat_words"] == len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)})


def test_thresholds_follow_their_group(spark):
    plain = lambda k, i, marks: " ".join(f"{k}{i}x{j}" for j in range(60)) + " #" * marks
    rows = [(i, plain("w", i, 1 if i % 2 else 0), "en", "news") for i in range(400)]
    rows += [(1000 + i, plain("c", i, 12 + i % 8), "en", "code") for i in range(300)]  # symbols are usual there
    rows += [(2000, plain("z", 0, 30), "en", "news"), (2001, plain("z", 1, 15), "en", "news"), (2002, plain("z", 2, 40), "en", "code"), (2003, plain("z", 3, 15), "en", "code")]
    got = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[2000]["kept"] and not got[2001]["kept"] and not got[2002]["kept"] and got[2003]["kept"]  # 15 symbols: only news rejects them
    assert np.mean([r["kept"] for i, r in got.items() if i < 400]) > 0.97 and np.mean([r["kept"] for i, r in got.items() if 1000 <= i < 2000]) > 0.85
    assert got[0]["max_sym"] < got[1000]["max_sym"]


def test_own_sketches_decide_at_both_levels(spark):
    """Limits of (language, source), language and all against quantiles by counting; and groups in which the own one differs."""
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = quality.measures(docs.selectExpr("doc_id _id", "coalesce('s' || lang, 'n') _a", "coalesce('s' || source, 'n') _b", "text"), "_id", "text").filter("n_words > 0")
    rows = rows.selectExpr("_a", "_b", "1000 * n_symbols div n_words sym", "if(n_lines > 0, 1000 * n_dup_lines div n_lines, 0) dup", "1000 * n_repeat_words div n_words rep", "100 * word_chars div n_words len")
    found = quality.limits(quality.sketches(rows, ["_a", "_b"]), ["_a", "_b"])
    limits = quality.group_limits(found, ["_a", "_b"]).collect()
    groups, langs = defaultdict(list), defaultdict(list)
    for r in rows.collect():
        groups[r["_a"], r["_b"]].append(r)
        langs[r["_a"]].append(r)

    def at(own, m):
        v = sorted(r[m] for r in own)[-(-len(own) * quality.LEVELS[m] // 1000) - 1]
        bits = max(v.bit_length() - 7, 0)
        return (v >> bits << bits) + (1 << bits) - 1

    everything = [r for own in groups.values() for r in own]
    differ = 0
    for r in limits:
        own, lang = groups[r["_a"], r["_b"]], langs[r["_a"]]
        for m in quality.LEVELS:
            up = (at(lang, m) * len(lang) + at(everything, m) * quality.PRIOR) // (len(lang) + quality.PRIOR)
            assert r[f"own_{m}"] == at(own, m)
            assert r[f"max_{m}"] == (at(own, m) * len(own) + up * quality.PRIOR) // (len(own) + quality.PRIOR)
            differ += r[f"max_{m}"] != up
    assert len(limits) == len(groups) and differ > len(groups)


def test_url_filters_as_by_brute_force(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rng = np.random.default_rng(7)
    names = ["a.com", "x.a.com", "y.x.a.com", "b.org", "w.b.org", "solo"]
    entries = [(str(rng.choice(["block", "allow"])), str(rng.choice(names)), str(rng.choice(["add", "remove"])), day(int(rng.integers(0, 300)))) for _ in range(60)]
    entries += [entries[0], ("block", None, "add", day(1)), ("block", "a.com", "add", None)]
    urls = [f"HTTP://user@{h}:80/p?q" for h in (*names, "Q.y.x.A.com.", "notb.org")] + ["/relative", "", None]
    captures = [(i, str(u) if u is not None else None, None if i % 17 == 0 else day(int(rng.integers(-20, 330))) + dt.timedelta(hours=int(rng.integers(24)))) for i, u in enumerate(urls * 12)]
    got = urlfilter.filter_urls(spark.createDataFrame(captures, "page_id long, url string, fetched timestamp").selectExpr("*", "'c' _id", "'c' host"), spark.createDataFrame(entries, "list string, name string, action string, at timestamp"))
    held = defaultdict(list)
    for e in sorted({e for e in entries if None not in e}, key=lambda e: (e[3], e[2])):
        held[e[0], e[1]].append(e)
    for r in got.collect():
        _, url, at = captures[r["page_id"]]
        host = (url or "").lower().partition("://")[2].partition("/")[0].rpartition("@")[2].partition(":")[0].rstrip(".") or None
        assert r["host"] == host
        best = None
        for (kind, name), own in held.items():
            if host and at and (host == name or host.endswith("." + name)):
                state = [e for e in own if e[3] <= at]
                if state and state[-1][2] == "add":
                    best = max(best or (0,), (name.count(".") + 1, kind == "allow", name))
        assert (r["matched"], r["blocked"]) == ((best[2], not best[1]) if best else (None, False)), r


def test_addresses_have_no_parents(spark):
    day = dt.datetime(2024, 1, 1)
    entries = spark.createDataFrame([("block", n, "add", day) for n in ("3.4", "2001", "[2001:db8::1]", "4.org")], "list string, name string, action string, at timestamp")
    urls = {"http://1.2.3.4/x": ("1.2.3.4", None), "http://[2001:db8::1]:8080/": ("[2001:db8::1]", "[2001:db8::1]"), "http://u@[2001:db8::2]/": ("[2001:db8::2]", None), "http://3.4.org/": ("3.4.org", "4.org"), "http://[broken/": (None, None)}
    captures = spark.createDataFrame([(i, u, day + dt.timedelta(days=900)) for i, u in enumerate(urls)], "page_id long, url string, fetched timestamp")
    assert {r["url"]: (r["host"], r["matched"]) for r in urlfilter.filter_urls(captures, entries).collect()} == urls


def test_slices_keep_rows_and_bound_bytes():
    import pyarrow as pa

    texts = ["a" * n for n in (10, 5, 700, 0, 3, 900, 20, 1)] + [None, "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["i", "t"])
    got = list(common.slices([batch], rows=4, size=100))
    assert [x for b in got for x in b.column(1).to_pylist()] == texts
    assert all(b.num_rows <= 4 and (b.num_rows == 1 or sum(len(x or "") for x in b.column(1).to_pylist()) <= 100) for b in got)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815
        conf = {}

    with pytest.raises(ValueError):
        common.shared_folder(Session)


def spark_hash(tokens):
    h = 42
    for t in tokens:
        h = xxhash.xxh64_intdigest(t.encode(), h)
    return h


def naive_tokens(text):
    """Words; letters of scripts without spaces; letters of a run of over 16 up to its last 16."""
    alone = lambda c: any(a <= ord(c) <= b for a, b in ((0xE00, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x3040, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))
    out, run = [], ""
    for c in text + " ":
        if c not in " \t\n\x0b\f\r" and not alone(c):
            run += c
            continue
        cut = max(0, len(run) - 16)
        out += [*run[:cut], *([run[cut:]] if run else [])]
        run = ""
        if alone(c):
            out.append(c)
    return out


def naive_marks(tokens, level, k=5, w=8):
    """(level, hash, position) of the rightmost least hash of each window."""
    grams = [tokens[i : i + k] for i in range(len(tokens) - k + 1)] if len(tokens) >= k else [tokens][: len(tokens)]
    hashes = [spark_hash(g) >> 25 << 1 | level for g in grams]
    signed = [h - (1 << 40) if h >= 1 << 39 else h for h in hashes]
    windows = [range(a, min(a + w, len(signed))) for a in range(max(1, len(signed) - w + 1))] if signed else []
    best = [min((signed[i], -i) for i in win) for win in windows]
    return {(level, h, -i) for h, i in best}


def all_marks(text):
    t = naive_tokens(text)
    return naive_marks(t, 1) | (naive_marks(list(text), 0) if len(t) < 24 else set())


def marks_of(row):
    return {(m >> winnow.POS_BITS & 1, m >> winnow.POS_BITS, winnow.POS_MASK ^ (m & winnow.POS_MASK)) for m in row}


_letters = lambda seed, alphabet: "".join(np.random.default_rng(seed).choice(list(alphabet), 900))
THAI, KHMER, BASE64 = _letters(1, map(chr, range(0xE01, 0xE2F))), _letters(2, map(chr, range(0x1780, 0x17B3))), _letters(3, "ABCDEFGHIJKLabcdefghijkl0123456789+/")


def test_winnowing_as_by_brute_force(spark, sf):
    texts = [r["text"] for r in documents(spark, sf).select("text").limit(60).collect()]
    texts += [texts[0][:n] for n in range(1, 401, 7)] + ["", "a", "ab cd", "漢字かな kana", "x" * 16, "x" * 17, "y" * 50 + " z", THAI[:40], "one two three four five"]
    rows = winnow.with_marks(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "marks").collect()
    for r in rows:
        assert marks_of(r["marks"]) == all_marks(r["text"]), r["text"][:80]


def test_a_deletion_keeps_most_of_texts_without_spaces(spark):
    pairs = [(t, t[1:]) for t in (THAI, KHMER, BASE64)] + [(t, t[:400] + t[401:]) for t in (THAI, KHMER, BASE64)] + [(BASE64, BASE64[:-1])]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = winnow.with_likeness(winnow.with_marks(winnow.with_marks(df, "a", "x"), "b", "y"), "x", "y", "near")
    assert all(r["near"] > 0.9 for r in df.collect())


def test_next_document_of_other_ids(spark):
    """Texts and times as ids; many rows with one id or none, which are more ranges."""
    rows = [(f"doc-{i:05d}", i) for i in range(300)]
    for kind, make in (("string", lambda i: f"doc-{i:05d}"), ("date", lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)), ("double", lambda i: i / 7), ("long", lambda i: i)):
        df = spark.createDataFrame([(make(i), f"text {i}") for _, i in rows], f"doc_id {kind}, text string")
        got = winnow.with_next(df, "doc_id", "text", carried=("text",)).collect()
        assert {int(r["text"][5:]): int(r["next_text"][5:]) for r in got} == {i: (i - 1) % 300 for _, i in rows}, kind
    hot = [(7 if i % 3 else i, f"text {i}") for i in range(900)] + [(None, f"null {i}") for i in range(300)]
    df = spark.createDataFrame(hot, "doc_id long, text string")
    got = winnow.with_next(df.repartition(5), "doc_id", "text", lambda x: x.withColumn("task", F.spark_partition_id()), ("doc_id", "text")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["next_doc_id"], r["next_text"]) for r in got) == Counter(hot)
    tie = lambda r: np.uint64(spark_hash([r[1]])).astype(np.int64)
    want = sorted(hot, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r)))
    assert {r["text"]: r["next_text"] for r in got} == {a[1]: b[1] for a, b in zip(want, want[1:] + want[:1])}
    assert len({r["task"] for r in got if r["doc_id"] == 7}) > 2 and len({r["task"] for r in got if r["doc_id"] is None}) > 1


def test_shared_passages_share_a_mark(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    shared = [word() for _ in range(12)]  # k + w - 1
    texts = [" ".join([*(word() for _ in range(int(rng.integers(40, 90)))), *shared, *(word() for _ in range(50))]) for _ in range(40)]
    df = winnow.with_marks(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "marks")
    got = [{m >> winnow.POS_BITS for m in r["marks"]} for r in df.collect()]
    assert all(a & got[0] for a in got)


def test_next_document_and_edits(spark):
    df = odd(spark)
    got = winnow.winnow_edits(df).collect()
    rows = sorted([(r["doc_id"], r["text"] or "") for r in df.collect()], key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    want = Counter()
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) // 3
        want[i, t, t[: len(t) - cut] + n[:cut]] += 1
    assert Counter((r["doc_id"], r["text"], r["edited"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert winnow.winnow_edits(empty(spark)).count() == 0
    alone = winnow.winnow_edits(df.filter("doc_id = 1")).first()
    assert alone["near_next"] == 1.0


def test_short_text_within_a_long_one_is_near(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    short = " ".join(word() for _ in range(30))
    rest = " ".join(word() for _ in range(35))
    df = spark.createDataFrame([(2, short), (1, f"{rest} {short}")], "doc_id long, text string")
    assert all(r["near_next"] > 0.2 for r in winnow.winnow_edits(df).collect())


def test_edited_texts_are_nearer_than_next_ones(spark, sf):
    rows = winnow.winnow_edits(documents(spark, sf)).collect()
    assert np.mean([r["near_edited"] > r["near_next"] or r["near_next"] > 0.3 for r in rows if len(r["text"]) > 30]) > 0.97


def test_hot_keys_meet_in_a_broadcast(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)] + [(901, None)], "i long, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 900, 3)], "k string, v long")
    assert [r["k"] for r in common.hot_keys(left, "k").collect()] == ["hot"]
    got = common.join_unique(common.checkpoint(left), right, "k", "left").orderBy("i").collect()
    assert len(got) == 901 and all(r["v"] == (1 if r["i"] % 3 else r["i"]) for r in got[:-1]) and got[-1]["v"] is None
    assert common.join_unique(left, right, "k").count() == 900
    assert left.select(F.max("i")).first()[0] == 901
