"""Pages by their elements, citations of messages, groups of names, and the grader's automata."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import drafts
from lexweave.operators import cases, grading, markup, messages, relations


@pytest.mark.parametrize(
    ("page", "source", "text"),
    [
        ("<p>a<div>b</div>c", "state", "a b\nc"),
        ('x<div id="codes-content"><div>one</div><div>two<div>three</div></div></div><div>four</div>', "justia", "one\ntwo three"),
        ("<div id=codes-content>kept Disclaimer: Justia says\nno</div>", "justia", "kept"),
        ("<main>a<main>b</main>c</main>d", "cornell", "a b c"),  # the inner element does not end the outer one
        ("<article>a</article><main>b</main>", "state", "b"),
        ("<article>a</article><main>b</main>", None, "b"),
        ("<main>never closed <b>bold</i> text", "cornell", "never closed bold text"),
        ("</div></main>a<br>b<br/>c", "odd", "a\nb\nc"),
        ("<script>if (a < b) { '</div>' }</script>a<style>p{}</style><!-- <main>no</main> -->b &amp; &#x41; &nbsp;c", "cornell", "a b & A \xa0c"),
        ("<SCRIPT>never closed", "state", ""),
        ("<p>a &amp;amp &amp b&copy=2 &#65 &lt; &eacute;</p>", "state", "a &amp &amp b&copy=2 &#65 < é"),  # no reference without its semicolon
        ("1 < 2 and 3 > 2", "state", "1 < 2 and 3 > 2"),
        ("", "state", ""),
        (None, "justia", ""),
    ],
)
def test_source_text(page, source, text):
    assert " ".join(markup.source_text(page, source).split(" ")) == text or markup.source_text(page, source).split() == text.split()


def test_elements_hold_their_pieces():
    pieces, elements = markup.parse('<ul><li>a<li>b<ul><li>c</ul></ul><p id="x">d')
    held = [(e.tag, e.name, "".join(pieces[e.start : e.end]).split()) for e in elements]
    assert held == [("ul", "", ["a", "b", "c"]), ("li", "", ["a"]), ("li", "", ["b", "c"]), ("ul", "", ["c"]), ("li", "", ["c"]), ("p", "x", ["d"])]


def test_flowing_text():
    assert markup.flowing_text("<p>a</p>b<br>c<br/>d<div>e  </div><script>s</script>&amp;amp;") == "a\nbc\nde\ns&"
    assert markup.flowing_text(None) == ""


def test_long_pages():
    began = time.time()
    for page in ("<" * 300_000, "<a " * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<!--" * 100_000, "<p>" * 100_000, "<script>" * 50_000, '<a b="' * 50_000, "<div></b>" * 50_000):
        markup.source_text(page, "state"), markup.flowing_text(page)
    assert time.time() - began < 20


def test_message_citations():
    text = "See Cal. Penal Code § 187; 12 U.S.C. § 5301(a). Roe v. Wade, 410 U.S. 113 (1973), at https://a.gov/x?y=1). None."
    assert [(k, t) for _, _, k, t in messages.find_citations(text)] == [("statute", "See Cal. Penal Code § 187"), ("statute", "12 U.S.C. § 5301(a)."), ("case", "Roe v. Wade, 410 U.S. 113 (1973)"), ("url", "https://a.gov/x?y=1")]
    assert messages.find_citations("") == []
    began = time.time()
    for odd in ("Aa " * 30_000, "Aa v. " * 20_000, "Code " * 20_000 + "§", "http://" * 20_000):
        messages.find_citations(odd)
    assert time.time() - began < 30


def test_quoted_sections(spark):
    said = {
        'Section 4.2: "Customer shall pay"': "Customer shall pay",
        "In Section 10.1 GOVERNING LAW: “This Agreement “x” ends” there": "This Agreement “x” ends",
        'Section 1: "tiny"': None,
        "Section 9.1: Supplier may engage others. + Section 8.6: more": "Supplier may engage others",
        "Section 3: If owing, AND Section 8.5: y": None,
        "Section 3: If any amount owing, and section 8.5: y": "If any amount owing",
        "no reference": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", messages.quoted_section(F.col("t")).alias("q"))
    assert {r["t"]: r["q"] for r in df.collect()} == said


def test_vector_text_of_odd_numbers(spark):
    rows = [[None, 1.0], [float("nan")], [float("inf"), 1.0], [1e30], [-2.5e8, 99999999.5], [0.0]]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in rows], "v array<double>").select(drafts.vector_text(F.col("v"))).collect()]
    assert got == [None, None, None, "[1000000000000000000000000000000.0000000]", "[-250000000.0000000,99999999.5000000]", "[0.0000000]"]


def test_names_behind_long_abbreviations():
    names = [x[3] for t in ("He lost. Acme Acquis. Corp. v. Roe, 1 F.3d 2", "Doe Petrol. Co. v. N. Iowa Reins. Grp., 1 F.3d 2", "Roe v. Doe; Bank of the West v. Poe, 1 F.3d 2", "see X and Smith v. Poe, 1 F.3d 2") for x in cases.find_cases(t)]
    assert names == ["Acme Acquis. Corp. v. Roe", "Doe Petrol. Co. v. N. Iowa Reins. Grp.", "West v. Poe", "Smith v. Poe"]


def links_by_force(names):
    words = {n: {w for w in "".join(c if c.isalnum() else " " for c in n.lower()).split() if len(w) >= 3} for n in names}
    return {(a, b) for a, b in itertools.permutations(names, 2) if words[a] and words[b] and len(words[a] & words[b]) >= min(2, len(words[a]))}


def test_fuzzy_groups_hold_all_links(spark):
    rng = np.random.default_rng(9)
    vocabulary = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    names = sorted({" ".join(rng.choice(vocabulary, rng.integers(1, 4))) + str(i % 3) * (i % 2) for i in range(60)}) + ["Alpha, beta", "beta alpha", "", "x y"]
    members, groups = relations.fuzzy_groups(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    of = {}
    for r in members.collect():
        of.setdefault(r["member"], []).append(r["name"])
    parts = {}
    for r in groups.collect():
        parts.setdefault(r["words"], {}).setdefault(r["part"], []).append(r["member"])
    met = {(a, b) for p in parts.values() for a, b in [*itertools.permutations(p.get("both", []), 2), *itertools.product(p.get("from", []), p.get("to", []))]}
    found = {(x, y) for a, b in met for x in of[a] for y in of[b]} | {pair for same in of.values() for pair in itertools.permutations(same, 2)}
    assert found == links_by_force(names)


def test_fuzzy_join_has_every_name(spark, sf):
    from lexweave.plans import textual

    rows = textual.txt_fuzzy_join(spark, sf).filter("part = 'same'").select("member", "representative")
    parts = spark.read.parquet(f"{sf}/part.parquet")
    names = parts.select(F.concat("p_name", F.lit(" v. "), "p_brand", F.lit(" "), "p_type")).union(parts.select(F.concat(F.lit("In re "), "p_type"))).distinct()
    got = [r["member"] for r in rows.collect()]
    assert sorted(got) == sorted(r[0] for r in names.collect())
    assert {r["representative"] for r in rows.collect()} <= set(got)


def test_fuzzy_groups_of_frequent_words_follow_the_names(spark):
    names = spark.range(3000).select(F.concat(F.lit("Common Holding "), F.col("id").cast("string"), F.lit(" party")).alias("name"))
    relations.fuzzy_groups(names.limit(10), "name")[1].count()
    began = time.time()
    assert relations.fuzzy_groups(names, "name")[1].count() < 20_000
    assert time.time() - began < 10


def test_matches_as_by_all_pairs(spark, monkeypatch):
    comments = [(1, "The  Anchor one", "see Rule 10.2 here"), (2, "anchor ONE and two", "keyword alpha"), (3, "two", "nothing"), (4, None, "alpha"), (5, "one", None), (6, "", "alpha")]
    key = [(10, ["anchor one"], "Rule 10", ["beta"]), (20, ["two", "zzz"], "", ["Alpha", "x"]), (30, [""], None, ["alpha"]), (40, [], "rule10", ["see"])]
    c = spark.createDataFrame(comments, "id long, anchor string, body string")
    k = spark.createDataFrame(key, "error_id long, anchors array<string>, rule string, keywords array<string>")
    want = [(1, 10, 2), (2, 20, 1), (2, 30, 1), (6, 30, 1)]
    for block in (5000, 1):
        monkeypatch.setattr(grading, "KEY_BLOCK", block)
        found = grading.matches(c, "id", k)
        assert sorted(tuple(r) for r in found.collect()) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert grading.matches(c, "id", k.limit(0)).collect() == []
