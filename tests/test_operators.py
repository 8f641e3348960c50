"""Operators on odd input, and those that SQL cannot express."""

import datetime as dt
import random
import time

import numpy as np
from pyspark.sql import functions as F

from lexweave.functions import legal, text
from lexweave.operators import chunking, citations, grading, layout, listing, merge, relations, retrieval, rules, spans
from lexweave.plans import incremental, relational
from lexweave.sources import tables
from lexweave.streaming import findings


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, text.slugify(t), t="In re: Smith & Co. v. Jones") == "in-re-smith-co-v-jones"
    assert one(spark, text.slugify(t), t="!!!") == "case" == one(spark, text.slugify(t), t=None)
    assert one(spark, text.slugify(t), t="word " * 30) == "-".join(["word"] * 12)  # 60 characters end in a hyphen, which goes
    assert one(spark, text.humanize(t), t="master_services_agreement") == "Master Services Agreement"
    assert one(spark, text.humanize(t), t="nda_with_exhibits") == "NDA with Exhibits"
    assert one(spark, text.humanize(t), t="macOS-guide") == "macOS Guide" and one(spark, text.humanize(t), t=None) == ""
    assert one(spark, text.html_to_text(t), t="<p>a&amp;b</p><script>x</p></script>c&#233;&#x41;<br>d") == "a&b\ncéA\nd"
    assert one(spark, text.strip_controls(t), t="a\x00b\x1fc\td\x7f") == "abc\td"
    assert one(spark, text.names_match(F.lit("Smith Jones Brown"), t), t="Jones v. Smith Inc.") is True
    assert one(spark, text.names_match(t, F.lit("Jones v. Smith Inc.")), t="Smith Brown Green") is False
    assert one(spark, text.names_match(F.lit("the of"), t), t="the of") is False
    assert one(spark, text.occurrences(t, F.lit("“aa”")), t='x "aa"  "aa"') == 2
    assert one(spark, text.edit_applied(t, F.lit("the old sentence"), F.lit("the new sentence")), t="here is the new sentence") is True
    assert one(spark, text.edit_applied(t, F.lit("old"), F.lit("new")), t="new") is None
    assert one(spark, text.parse_date(t), t="March 5, 2024") == dt.date(2024, 3, 5) and one(spark, text.parse_date(t), t="soon") is None
    assert one(spark, text.tolerant_json(t), t='x ```json\n{"a": {"b": 1}}\n``` y') == '{"a": {"b": 1}}'
    assert one(spark, text.looks_garbled(t), t="§±©" * 40) is True and one(spark, text.looks_garbled(t), t=None) is False


def test_quantities_and_directions(spark):
    q = lambda t: (lambda r: (r["value"], r["kind"]) if r else None)(one(spark, legal.quantity(F.col("t")), t=t))
    assert q("$1,500.50 or 3 days") == (1500.5, "dollars") and q("$2 million") == (2e6, "dollars") and q("Net-30") == (30, "days")
    assert q("within ten (10) business days") == (10, "days") and q("6 months") == (6, "months") and q("99.9% up") == (99.9, "percent") and q("none") is None and q(None) is None
    rows = [("payment", "Vendor", "Net 30", "Net 45"), ("payment", "Buyer", "Net 30", "Net 45"), ("payment", "Guest", "Net 30", "Net 45"), ("sla", "Vendor", "99%", "98%"), (None, None, None, None)]
    got = legal.with_direction(spark.createDataFrame(rows, "category string, role string, source_text string, proposed_text string")).collect()
    assert [(r["verdict"], r["rule"]) for r in got] == [("fail", "commercial-net-term-direction"), ("pass", "commercial-net-term-direction"), ("ambiguous", None), ("ambiguous", None), ("ambiguous", None)]


def test_chunks_are_bounded_and_lose_no_word(spark):
    words = " ".join(f"word{i}" for i in range(3000))
    cases = [None, "", "short", "p one.\n\np two.", words, "A sentence here. " * 400, ("Para. " * 100 + "\n\n") * 20, "x" * 9000]
    for t in cases:
        got = chunking.chunk_text(t)
        assert all(0 < len(c) <= 2000 + 202 for c in got)
        assert set((t or "").split()) <= set(" ".join(got).split()) or " " not in t or t == words
    assert chunking.chunk_text("p one.\n\np two.") == ["p one.\n\np two."]
    df = spark.createDataFrame([(1, None), (2, "a"), (None, "b")], "i long, t string")
    assert [(r["i"], r["chunk_index"], r["content"]) for r in chunking.chunks(df, "i", "t").collect()] == [(2, 0, "a"), (None, 0, "b")]


def test_spans_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "🙂 410 U.S. 113, 115 (1973); 29 CFR 16."), (2, None), (3, ""), (4, "nothing")], "d long, t string")
    got = spans.extract(df, "d", "t").collect()
    assert [(r["d"], r["start"], r["kind"], r["text"]) for r in got] == [(1, 2, "reporter", "410 U.S. 113, 115"), (1, 28, "cfr", "29 CFR 16.")]
    assert {(r["rule_id"]) for r in rules.flags(spans.extract(df, "d", "t")).collect()} == {"cfr-periods", "section-mark"}


def test_sources_of_odd_texts(spark):
    cite = lambda t, group: [(r["kind"], r["text"]) for r in citations.extract(spark.createDataFrame([(1, t)], "d long, t string"), "d", "t", group).orderBy("ordinal").collect()]
    for group in citations.GROUPS:
        assert cite(None, group) == cite("", group) == cite("No. Inc. v. 5 (x)", group) == []
        assert cite("A. " * 50_000, group) == cite("A" * 200_000, group) == cite("( § 5 " * 50_000, group) == []
    assert cite("Fine. See also Tex. const. art IV, § 3. Exec. Order No. 13,769, 82 Fed. Reg. 8977 (Jan. 27, 2017).", "official") == [("constitutional", "Tex. const. art IV, § 3"), ("exec_order", "Exec. Order No. 13,769, 82 Fed. Reg. 8977 (Jan. 27, 2017)")]
    assert cite("Treaty of Amity, U.S.-Iran, Aug. 15, 1955, 8 U.S.T. 899. Vienna Convention, May 23, 1969, 1155 U.N.T.S. 331.", "foreign") == [("bilateral_treaty", "Treaty of Amity, U.S.-Iran, Aug. 15, 1955, 8 U.S.T. 899"), ("multilateral_treaty", "Vienna Convention, May 23, 1969, 1155 U.N.T.S. 331")]
    assert cite("Ann Lee, Fair Use 12 (3d ed. 2001). Acme, Inc. v. Roe, 5 (2001).", "secondary") == [("book", "Ann Lee, Fair Use 12 (3d ed. 2001)")]
    assert cite("Bob Ray, Big Story, N.Y. Times (Jan. 5, 2020), https://a.com/2020/x.", "secondary") == [("internet", "Bob Ray, Big Story, N.Y. Times (Jan. 5, 2020), https://a.com/2020/x.")]


def test_spans_that_touch_what_was_found():
    many = citations.Cover()
    for a in range(0, 2000, 4):
        many.add(a, a + 2)
    assert many.meets(1, 3) and many.meets(3, 5) and not many.meets(2, 4) and not many.meets(2000, 2001)
    many.add(1, 1999)
    assert (many.starts, many.ends) == ([0], [1999])


def test_rules_and_their_fixes(spark):
    rows = [("constitutional", "Tex. const. art IV"), ("constitutional", "U.S. Const. amend. 14, § 1"), ("constitutional", "U.S. Const. amend. 99"), ("fed_reg", "Fed. Reg. 12345"), ("fed_reg", "88 Fed. Reg. 12,345"), ("bill", "S. 5 (2008)"), ("legislative_report", "H.R. Rep. No. 1234"), ("legislative_report", "H.R. Rep. No. 105-12")]
    rows += [("internet", "http://a.com/2020/x"), ("internet", "https://a.com/x."), ("internet", "https://a.com/x/y"), ("internet", "https://a.com/x.pdf"), ("internet", "https://a.com (last visited May 1, 2020)"), ("unreported", "2019 WL 12, at *4 (S.D.N.Y. Sept. 18, 2019)"), ("unreported", "2019 WL 12"), ("news_article", "Story, N.Y. Times (Jan. 5, 2020)"), (None, None), ("bill", None)]
    got: dict = {}
    for r in rules.flags(spark.createDataFrame(rows, "kind string, text string")).collect():
        got.setdefault(r["text"], {})[r["rule_id"]] = r["suggested_fix"]
    assert got == {
        "Tex. const. art IV": {"constitution-article": "Tex. const. art. IV", "constitution-capital": "Tex. Const. art IV", "constitution-part": None},
        "U.S. Const. amend. 14, § 1": {"constitution-roman": "U.S. Const. amend. XIV, § 1"},
        "U.S. Const. amend. 99": {"constitution-roman": "U.S. Const. amend. 99"},
        "Fed. Reg. 12345": {"register-volume": None, "register-comma": "Fed. Reg. 12,345"},
        "S. 5 (2008)": {"bill-congress": None},
        "H.R. Rep. No. 1234": {"report-congress": None},
        "http://a.com/2020/x": {"internet-https": "https://a.com/2020/x"},
        "https://a.com/x.": {"internet-visited": None},
        "2019 WL 12": {"unreported-pin": None, "unreported-date": None},
        "Story, N.Y. Times (Jan. 5, 2020)": {"news-link": None},
    }


def test_decisions_of_odd_rows(spark):
    names = "i long, user_choice string, change_type string, proposed_text string, base_text string, user_custom_text string, action string"
    rows = [(1, None, None, "p", "b", None, "old"), (2, "keep_base", None, " p\n", " b ", None, None), (3, "custom", "addition", "p", None, " ", None), (4, "keep_base", "addition", None, None, None, None), (5, "custom", "deletion", None, "", "c", None), (6, "keep_base", "moved", "p", "b", "c", None), (7, "keep_base", "deletion", None, None, None, None)]
    got = {r["i"]: (r["action"], r["source_text"], r["suggested_text"], r["skipped"]) for r in merge.decisions(spark.createDataFrame(rows, names)).collect()}
    nothing = (None, None, None, None)
    assert got == {1: nothing, 2: ("replace", "p", "b", None), 3: nothing, 4: (*nothing[:3], "addition_without_source"), 5: ("insert", "", "c", None), 6: nothing, 7: (*nothing[:3], "deletion_without_base")}


def test_cut_json_and_markdown(spark):
    for cut, whole in [('x {"a": [1, 2, {"b": "}', '{"a": [1, 2]}'), ('[{"a": 1}, {"b"', '[{"a": 1}]'), ('```json\n{"a": 1}\n``` {', '{"a": 1}'), ('{"a": "\\"', None), ("none", None), (None, None), ("", None), ("[1, 2] and ]", None)]:
        assert text.json_in(cut) == whole
    t = F.col("t")
    md = lambda s: one(spark, text.html_to_markdown(t), t=s)
    assert md(None) == md("") == md("<table></table>") == ""
    assert md("<ol><li>a</li></ol>x<ol><li>b</li><li>c $1</li></ol>") == "1. a\nx\n1. b\n2. c $1"
    assert md("a<br>b <em>c</em><u>d</u>&lt;") == "a\nb *c*_d_<" and md("<body><b>x <i>y</i></b></body>") == "**x y**" and md("<b>a<h2>b</h2>") == "a\n## b"


def test_pages_of_odd_lines(spark):
    rows = [(1, 1, 100.0, "a"), (1, 2, 90.0, " b  c "), (1, 3, 80.0, None), (1, 4, 50.0, "d"), (1, 5, 40.0, "e"), (1, 6, 99.0, "f"), (2, 1, None, "x"), (2, 2, None, "y"), (3, 1, 5.0, " "), (None, 1, 1.0, "z")]
    got = layout.paragraphs(spark.createDataFrame(rows, "page long, n int, y double, t string"), "page", ["n"], "y", "t").collect()
    assert {(r["page"], r["paragraph"], r["content"]) for r in got} == {(1, 0, "a b c"), (1, 1, "d e"), (1, 2, "f"), (2, 0, "x y"), (None, 0, "z")}
    nodes = spark.createDataFrame([(1, 1, 3), (1, 2, 0), (1, 3, 4), (2, 1, 1)], "d long, n int, size int")
    got = layout.node_ranges(nodes, "d", ["n"], F.col("size"), F.lit(2), F.lit(5)).collect()
    assert [(r["d"], r["n"], r["from"], r["to"]) for r in got] == [(1, 1, 2, 3), (1, 3, 0, 2)]


def test_status_and_review_of_odd_rows(spark):
    statutes = spark.createDataFrame([(1, "2020"), (2, None), (3, "2020"), (4, "2020")], "k long, f string")
    bills = spark.createDataFrame([(1, 1, "2021", "enacted"), (1, 2, "2022", "enacted"), (2, 3, None, "enacted"), (3, 4, None, "enacted"), (3, 5, "2021", "pending"), (4, 6, "2021", "failed")], "k long, b long, at string, s string")
    got = relations.amendment_status(statutes, "k", "f", bills, ["b"], "b", "at", "s").orderBy("k").collect()
    assert [(r["classification"], r["bills"], r["top_bill"]) for r in got] == [("enacted", 2, 1), ("enacted", 1, 3), ("pending", 1, 5), ("clean", 0, None)]
    cells = spark.createDataFrame([(1, 0, None, None), (1, 1, "x", [("q", 2), ("r", 3)]), (2, 5, "y", [])], "d long, i int, content string, citations array<struct<quote:string,page:int>>")
    assert [tuple(r) for r in relations.review_table(cells, "d", "i", [0, 1]).orderBy("d").collect()] == [(1, "", "x", "", '"q" (p. 2)'), (2, "", "", "", "")]
    now = F.lit("2024-01-31 01:00:00").cast("timestamp")
    of = lambda t: one(spark, listing.day_group(F.col("t").cast("timestamp"), now), t=t)
    assert [of(t) for t in ("2024-01-31 00:30:00", "2024-01-30 00:00:00", "2024-01-24 02:00:00", "2024-01-24 00:30:00", None)] == ["Today", "Yesterday", "Last week", "Older", "Older"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 1.0]), (5, [1.0, 0.0]), (6, [1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["distance"]) for r in retrieval.nearest(df, [1.0, 0.0], 5).collect()] == [(1, 0.0), (5, 0.0), (4, 1.0)]
    both = [spark.createDataFrame(x, "i long, rank int") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)])]
    assert [r["i"] for r in retrieval.fill(both, "i", 5).collect()] == [1, 2, 3]


def test_grading_without_rows(spark):
    comments = spark.createDataFrame([], "i long, anchor string, body string")
    key = spark.createDataFrame([], "error_id long, anchors array<string>, rule string, keywords array<string>")
    r = grading.grade_one_to_one(comments, "i", key).first()
    assert (r["precision"], r["recall"], r["comments"], r["planted"]) == (1.0, 1.0, 0, 0)


def test_listing_pages(spark):
    df = spark.range(500)
    assert listing.page(df, [F.col("id")], 1000).count() == 200 and listing.page(df, [F.col("id")], 0).count() == 1
    assert one(spark, listing.contains("t", "5%_off"), t="get 5%_OFF now") is True


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"'), (2, None)], "i long, s string").coalesce(1)
    tables.write_csv(df, f"{tmp_path}/csv")
    back = tables.read_csv(spark, f"{tmp_path}/csv")
    assert back.columns == ["i", "s"] and back.count() == 2 and back.filter("i = 1").first()["s"] == 'a "b"'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "in" / "b.docx").write_bytes(b"no zip")
    assert {(r["format"], r["text"]) for r in tables.read_documents(spark, f"{tmp_path}/in").collect()} == {("text", "hello"), ("docx", None)}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    rows = lambda n, x: spark.createDataFrame(x, "case_id long, step string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/steps.parquet")
    run = lambda: findings.latest_into(findings.case_states(findings.read_table(spark, f"{tmp_path}/in", "steps")), f"{tmp_path}/out", f"{tmp_path}/log")
    rows(0, [(1, "opinion"), (2, "annotation"), (3, "other")])
    run()
    states = lambda: {r["case_id"]: r["state"] for r in findings.read_latest(spark, f"{tmp_path}/out", ["case_id"]).collect()}
    assert states() == {1: "fetched", 2: "pending", 3: "pending"}
    rows(1, [(1, "annotation"), (2, "opinion")])
    run()
    assert states() == {1: "annotated", 2: "annotated", 3: "pending"}


def test_windows_of_unordered_files(spark, tmp_path, monkeypatch):
    for day in ("2024-01-20", "2024-01-02", "2024-01-10"):  # files come in the order of their times
        spark.createDataFrame([(f"{day} 01:00:00", "view", 1.5)], "ts string, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(1.1)
    read = findings.read_table
    monkeypatch.setattr(findings, "read_table", lambda *a: read(*a, files_a_batch=1))
    rows = incremental.inc_usage_windows(spark, str(tmp_path)).collect()
    assert sorted((r["since"].day, r["n"], r["cents"]) for r in rows) == [(2, 1, 150), (10, 1, 150), (20, 1, 150)]


def test_timeline_of_all(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at), (900, at)], "o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(2, at, "view"), (700, at, "view")], "user_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r["who"] for r in relational.rel_timeline_all(spark, str(tmp_path)).collect()) == [1, 2, 700, 900]


def test_each_error_takes_one_comment(spark):
    rng = random.Random(3)
    errors = [(e, [f"a{e % 4}"], f"r{e}" if e % 2 else "", [f"w{e % 3}"]) for e in range(6)]
    notes = [(c, " ".join(f"a{rng.randrange(6)}" for _ in range(2)), " ".join(f"{rng.choice('rwx')}{rng.randrange(6)}" for _ in range(2))) for c in range(40)]
    free, caught = dict.fromkeys(c for c, *_ in notes), {}
    score = lambda c, e: 0 if not any(x in c[1] for x in e[1]) else 2 if e[2] and e[2] in c[2].replace(" ", "") else int(any(w in c[2] for w in e[3]))
    for e in errors:
        best = max(((score(c, e), -c[0]) for c in notes if c[0] in free), default=(0, 0))
        if best[0]:
            caught[-best[1]] = e[0]
            del free[-best[1]]
    want = {c[0]: "catch" if c[0] in caught else "duplicate" if any(score(c, e) for e in errors) else "false positive" for c in notes}
    comments = spark.createDataFrame(notes, "i long, anchor string, body string")
    key = spark.createDataFrame(errors, "error_id long, anchors array<string>, rule string, keywords array<string>")
    judged = grading.verdicts(comments, "i", key, ["A5"])
    assert {r["i"]: r["verdict"] for r in judged.collect()} == want
    assert {r["i"]: r["error_id"] for r in judged.filter("verdict = 'catch'").collect()} == caught
    assert {r["error_id"] for r in grading.misses(judged, key).collect()} == {e[0] for e in errors} - set(caught.values())
    r = grading.grade_one_to_one(comments, "i", key, ["A5"]).first()
    assert (r["real_catches"], r["duplicates"], r["precision"]) == (len(caught), list(want.values()).count("duplicate"), round(len(caught) / 40, 3))
    assert r["on_control"] == sum("a5" in c[1] and want[c[0]] == "false positive" for c in notes) > 0
    assert grading.grade_one_to_one(comments.limit(0), "i", key.limit(0)).first()["precision"] == 1.0


def test_nearest_of_many_queries(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.integers(-2, 3, 3).astype(float).tolist() for i in range(300)} | {300: [0.0, 0.0, 0.0], 301: None, 302: [1.0, 2.0], 350: [2.0, 1.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in retrieval.nearest_of_each(df, df.filter("vec_id % 50 = 0"), 7, block=2).collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    norm = lambda v: np.sqrt(np.dot(v, v))
    want = {}
    for q in (i for i, v in vectors.items() if i % 50 == 0 and v and any(v)):
        all_ = sorted((round(1 - np.dot(vectors[q], v) / (norm(vectors[q]) * norm(v)), 9), i) for i, v in vectors.items() if v and any(v) and len(v) == len(vectors[q]))
        want[q] = all_[:7]
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert len(got) >= 6 and retrieval.nearest_of_each(df, df.limit(0), 7).count() == 0


def test_quantities_of_odd_texts(spark):
    rows = ["pay $, then", "pay $, then $5", "$1,250.50 million", "$3 billion", "Net 30", "net-45 days", "6 calendar months", "6 calendar years", "thirty (30) business days", "99.9 %", "none", None, "$" + ",".join(["999"] * 200), "5" * 400 + " days", "2 years or 10 days"]
    got = [r["q"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").select("i", legal.quantity(F.col("t")).alias("q")).orderBy("i").collect()]
    plain = [(q["value"], q["kind"]) if q else None for q in got]
    assert plain[:12] == [None, (5.0, "dollars"), (1250.5e6, "dollars"), (3e9, "dollars"), (30.0, "days"), (45.0, "days"), None, (6.0, "years"), (30.0, "days"), (99.9, "percent"), None, None]
    assert plain[14] == (10.0, "days")


def test_character_references(spark):
    cases = {"&#55357;&#56832;": "😀", "&#xD83D;&#xDE00;": "😀", "&#128512;": "😀", "&#x1F600;": "😀", "&#55357;": "�", "&#99999;": chr(99999), "&#1114112;": "�", "&#0;": "�", "&#999999999;": "�", "a &#65;&amp;&lt;": "a A&<", "&#38;lt;": "<", "no": "no", None: None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.decode_entities(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == cases


def test_long_numbers_as_keys(spark):
    keys = ["9" * 45, "10", "009", "1" + "0" * 44]
    got = spark.createDataFrame([({k: k for k in keys} | {"x": "x"},)], "m map<string, string>").select(text.numbered_values(F.col("m")).alias("v")).first()["v"]
    assert got == ["009", "10", "1" + "0" * 44, "9" * 45]


def test_span_joins_as_by_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(d, i, a, a + rng.choice([0, 1, 5, 30, 300]), rng.randrange(3)) for d in range(4) for i, a in enumerate(rng.choices(range(200), k=40))]
    df = spark.createDataFrame(rows, "doc int, i int, start int, end int, p int")
    kept = []
    for d, i, a, b, p in sorted(rows, key=lambda r: r[4]):
        if not any(k[0] == d and k[4] < p and k[2] <= a and k[3] >= b for k in kept):
            kept.append((d, i, a, b, p))
    got = spans.by_priority([df.filter(F.col("p") == p) for p in range(3)], "doc")
    assert sorted((r["doc"], r["i"], r["p"]) for r in got.collect()) == sorted((d, i, p) for d, i, _, _, p in kept)
    pairs = sorted((x[0], y[1], x[1]) for x in rows for y in rows if x[4] == 1 and y[4] == 0 and x[0] == y[0] and y[2] < x[3] and x[2] < y[3] and not (y[2] <= x[2] and y[3] >= x[3]))
    got = spans.partial_overlaps(df.filter("p = 0"), df.filter("p = 1"), "doc", "i", width=16)
    assert sorted((r["doc"], r["high_i"], r["low_i"]) for r in got.collect()) == pairs


def test_reporters_and_their_forms(spark):
    cites = ["12 N.E.2d 34", "10 P.3d 20", "45 So. 3d 67", "100 Cal. App. 4th 12", "1 S.Ct. 2", "556 US 662", "466 U.S 408", "123 F. 3d 456", "9 Ex. 341", "5 Ill. App. 3d 77", "3 Mass. App. Ct. 8", "123 F.3d 456, 460-61"]
    df = spark.createDataFrame([(i, f"see {c} (1999).") for i, c in enumerate(cites)], "i int, t string")
    got = {r["i"]: r["text"] for r in spans.extract(df, "i", "t", {"reporter": spans.PATTERNS["reporter"]}).collect()}
    assert [got.get(i) for i in range(len(cites))] == cites
