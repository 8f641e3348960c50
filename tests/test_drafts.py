"""Drafts, cases and desk operators on odd input."""

import datetime as dt

from pyspark.sql import functions as F

from lexweave.functions import drafts
from lexweave.operators import cases, desk


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r["x"] for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_fixes_and_messages(spark):
    assert column(spark, [None, "", "So.2d and So. 3d", "Restatement 2d of Torts", "U.S.C. 12", "FRE 12; F.R.Civ.P. 3", "(S.D.N.Y., 2019)"], drafts.static_fixes) == [None, "", "So. 2d and So. 3d", "Restatement 2d of Torts", "U.S.C. § 12", "Fed. R. Evid. 12; F.R.Civ.P. 3", "(S.D.N.Y. 2019)"]
    assert column(spark, [None, "The citation does not exist at all. Next", "hallucinated"], drafts.softened) == [None, f"{drafts.UNLOCATED}. Next", drafts.UNLOCATED]
    assert column(spark, [None, "short", "w" * 100, "word " * 30, " a\n b "], drafts.anchor_needle) == ["", "short", "w" * 70, " ".join(["word"] * 14), "a b"]
    assert column(spark, [None, "", "/docket/1/2/", "/docket/1/2/3/x/", "/docket/1/2/x/y/"], drafts.attachment_number) == ["0", "0", "0", "3", "0"]
    assert column(spark, [[0.5, -0.25], [], None, [0.5, None]], drafts.vector_text, "array<float>") == ["[0.5000000,-0.2500000]", "[]", None, None]


def test_folded_names(spark):
    pairs = [("Halliburton Company v. Erica P. John Fund, Incorporated", "Halliburton Co. v. Erica P. John Fund, Inc.", 1.0), ("O'Brien vs. State", "OBrien v. State", 1.0), ("Ex parte Young", "Young", 1.0), ("Smith v. Jones", "Smith v. Brown", 0.5), ("", "x y", 0.0), (None, None, 0.0), ("the of", "the of", 0.0)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r["x"] for r in rows.select("i", drafts.case_overlap(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()] == [x for *_, x in pairs]


def test_cases_of_odd_texts(spark):
    texts = {
        "He won. Doe v. Acme Corp., 410 U.S. 113, 120 (1973).": ("Doe v. Acme Corp.", None, 1973),
        "See also State ex rel. Roe v. City of Troy, 12 P.3d 4 (Or. 2001)": ("State ex rel. Roe v. City of Troy", "Or.", 2001),
        "They relied on In the Matter of Gault, 387 U.S. 1.": ("In the Matter of Gault", None, None),
        "no name here 12 F.3d 5 (2d Cir. 1994)": (None, "2d Cir.", 1994),
        "x " * 5000 + "v. " + "12 F.2d 7": (None, None, None),
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string").withColumn("id", F.col("t"))
    got = {r["id"]: (r["name"], r["court"], r["year"]) for r in cases.extract_cases(df, "id", "t").collect()}
    assert got == texts
    years = cases.out_of_years(spark.createDataFrame([("F.3d", 1950), ("F.Supp.2d", 2020), ("F.2d", 1980), ("Odd", 1), (None, None)], "reporter string, year int"))
    assert {r["reporter"] for r in years.collect()} == {"F.3d", "F.Supp.2d"}


def test_desk_operators_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, f boolean")
    assert [r["i"] for r in rows.filter(desk.not_true(F.col("f"))).orderBy("i").collect()] == [2, 3]
    assert desk.coded("all", *[F.lit("")] * 4) is None
    day = dt.datetime(2024, 1, 1)
    cache = spark.createDataFrame([("a", day, "x"), ("b", day, ""), ("c", day, None), ("d", None, "x"), ("e", dt.datetime(2023, 1, 1), "x")], "u string, until timestamp, t string")
    assert [r["u"] for r in desk.fresh(cache, "until", F.lit(day), "t").collect()] == ["a"]
    pages = spark.createDataFrame([(1, 0), (1, 10), (1, 25)], "d int, s int")
    offsets = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (1, 99)], "d int, o int")
    assert [r["page"] for r in desk.page_at(offsets, "d", "o", pages, "s").orderBy("o").collect()] == [1, 1, 2, 3]
    cites = spark.createDataFrame([(1, i, b) for i, b in enumerate(["x. ", "(1999); ", "ok ", None])], "d int, i int, b string")
    assert [r["string_cite"] for r in desk.string_cites(cites, "d", [F.col("i")], "b").orderBy("i").collect()] == [True, True, False, False]
    texts = spark.createDataFrame([(1, i, t) for i, t in enumerate(["the end", "of this", "clause is", "near"])], "d int, i int, t string")
    assert [r["last"] for r in desk.runs_to(texts, "d", "i", "t", F.lit("of this clause"), 3).orderBy("i").collect()] == [2, 2, None, None]
    assert desk.runs_to(texts.limit(0), "d", "i", "t", F.lit("x")).count() == 0
