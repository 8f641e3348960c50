"""Scanners of whole documents on odd texts."""

from lexweave.operators import scanners


def issues(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "d int, t string").selectExpr("d", "t", "1 AS start", "'x' AS kind")
    return sorted((r["d"], r["rule_id"], r["text"], r["count"]) for r in scanners.issues(df, "d", "t").collect())


def test_texts_without_issues(spark):
    assert not issues(spark, None, "", " \n\n ", "Congress and the Constitution. Wait ... for it. ¶ 4–6. The congresses", "The Exchange Act of 1934", "    five words but no lead here")


def test_long_texts(spark):
    got = issues(spark, "a" * 200_000 + "…b", "ab-" * 100_000 + "c", "The " * 50_000, "\n" * 100_000 + "    one two three four five\n\nDoe, 1 F.3d at 2" + " x" * 50_000)
    assert [(d, r) for d, r, *_ in got] == [(0, "ellipsis-sign"), (3, "block-quote")]


def test_block_quotes(spark):
    words = " ".join(["word"] * 49)
    got = issues(spark, f"He said:\n\n\t\t\t\t{words}", f"He said:\n\n    {words} more", "He said:\n\n    “one two three four five”", "He said:\n\n    1. one two three four five", "He said:\n \n    one two three four five", "He said:\n\n    A. b c d e f g h")
    assert [(d, r) for d, r, *_ in got] == [(0, "block-quote"), (5, "block-quote")]


def test_names_and_ranges(spark):
    full = "See the Advisers Act of 1940. "
    got = issues(spark, full + "The Market Act.", full + "The Market Act. [Hereinafter Market Act]", full + "The Market Act [hereinafter The Market Act]", "¶1-2 " * 4, "¶1-2 " * 5 + "¶3—4")
    assert got == [(0, "undeclared-name", "The Market Act", 1), *[(3, "paragraph-range", "¶1-2", 1)] * 4, (4, "paragraph-range", "¶1-2", 5), (4, "paragraph-range", "¶3—4", 1)]


def test_only_ranges_and_names_are_sorted_by_document(spark):
    """Many ranges of a text are one row before the shuffle, documents of several rows count together, and tasks are not joined."""
    many = ", ".join(f"¶ {i}-{i + 1}" for i in range(1, 8))
    assert [x[2:] for x in scanners.find_ranges(f"{many}, ¶ 9—10")] == [("7", "¶ 1-2"), ("1", "¶ 9—10")]
    rows = [(1, f"congress. See {many}"), (1, "¶ 20-21, ¶ 22-23"), (2, "¶ 1-2, ¶ 3-4, ¶ 5—6"), (2, "See also ¶ 7-8, ¶ 9-10"), (3, "See ¶ 1-2, ¶ 3-4"), (3, "See so also ¶ 5-6, ¶ 7-8, ¶ 9-10")]
    found = scanners.issues(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = sorted((r["id"], r["text"], r["count"], r["suggested_fix"]) for r in found.collect() if r["rule_id"] == "paragraph-range")
    assert got == [(1, "¶ 20-21", 9, None), (2, "¶ 1-2", 1, "¶ 1–2"), (2, "¶ 3-4", 1, "¶ 3–4"), (2, "¶ 5—6", 1, "¶ 5–6"), (2, "¶ 7-8", 1, "¶ 7–8"), (2, "¶ 9-10", 1, "¶ 9–10"), (3, "¶ 1-2", 5, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Sort ") == 2  # ranges, names
    assert scanners.dealt(found, "id").rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
