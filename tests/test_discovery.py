"""Duplicate names against brute force, and items stacked into lines."""

import random

from lexweave.functions import text
from lexweave.operators import cases, layout
from pyspark.sql import functions as F


def test_duplicate_names(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(14)] + ["alpha"] * 4
    name = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(1, most)))
    known = spark.createDataFrame([(k, name(6)) for k in range(60)] + [(60, None), (61, "of")], "at int, name string")
    new = spark.createDataFrame([(k, name(6)) for k in range(80)] + [(80, None), (81, ""), (82, "unseen words only"), (3, "word1 word2")], "id int, name string")
    tokens = lambda df, c: [(r[c], r["name"], set(r["t"] or [])) for r in df.withColumn("t", text.name_tokens(F.col("name"))).collect()]
    stored = sorted(x for x in tokens(known, "at") if x[2])
    want = {}
    for k, _, own in tokens(new, "id"):
        for at, theirs, t in stored:
            both = len(own & t)
            if own and (both >= 3 or both / min(len(own), len(t)) >= 0.8):
                want[k] = min(want.get(k, (at, theirs)), (at, theirs))
                break
    got = {r["id"]: r["existing"] for r in cases.duplicate_names(new, known, "id", "name", "at").collect()}
    assert got == {k: n for k, (_, n) in want.items()} and 10 < len(got) < 83
    assert cases.duplicate_names(new, known.limit(0), "id", "name", "at").count() == 0


def test_lines(spark):
    rows = [("p", 1, 100.0, 10.0, "a", False), ("p", 2, 97.0, 10.0, "b", False), ("p", 3, 94.0, 10.0, "c", False), ("p", 4, 94.0, 10.0, "", False), ("p", 5, 80.0, None, "d", False), ("p", 6, 76.5, 0.0, None, True), ("q", 1, None, None, "x", None), (None, 1, 5.0, 1.0, "n", False)]
    items = spark.createDataFrame(rows, "page string, n int, y double, h double, t string, eol boolean")
    got = sorted((str(r["page"]), r["line"], r["y"], r["content"]) for r in layout.stacked(items, "page", ["n"], "y", "h", "t", "eol").collect())
    assert got == [("None", 0, 5.0, "n"), ("p", 0, 100.0, "a b"), ("p", 1, 94.0, "c"), ("p", 2, 80.0, "d "), ("q", 0, 0.0, "x")]
    assert layout.stacked(items.limit(0), "page", ["n"], "y", "h", "t", "eol").count() == 0
