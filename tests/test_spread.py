"""Work that costs much a row is dealt to all cores, and costly steps are run once."""

from pyspark.sql import functions as F

from lexweave.operators import cases, citations, rules
from lexweave.sources import batches


def one_part(spark, n=40):
    text = "Roe v. Wade, 410 U.S. 113 (1973). Jane Roe, Fair Use, Harv. L. Rev. 9 (1999). See http://acme.com (last visited May 2, 2020)."
    return spark.range(n).coalesce(1).withColumn("text", F.lit(text))


def test_rows_of_one_part_are_dealt(spark):
    df, wanted = one_part(spark), 4 * spark.sparkContext.defaultParallelism
    assert df.rdd.getNumPartitions() == 1
    assert citations.extract(df, "id", "text", "secondary").rdd.getNumPartitions() == wanted
    assert batches.spread(df.repartition(wanted + 1), "id").rdd.getNumPartitions() == wanted + 1


def test_cases_of_one_part_are_dealt(spark):
    found = cases.extract_cases(one_part(spark), "id", "text")
    assert found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert {(r["name"], r["page"]) for r in found.collect()} == {("Roe v. Wade", 113)} and found.count() == 40


def test_marked_has_all_citations_and_makes_them_once(spark):
    found = citations.extract(one_part(spark, 1), "id", "text", "secondary")
    marked = rules.marked(found)
    assert marked._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    flags = {(r["ordinal"], r["rule_id"]) for r in rules.flags(found).collect()}
    got = {(r["ordinal"], r["rule_id"]) for r in marked.collect()}
    assert {x for x in got if x[1]} == flags and flags and {x[0] for x in got} == {r["ordinal"] for r in found.collect()}


def test_band_summary_meets_each_place_once(spark):
    from lexweave.operators import bands

    left = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("double")).alias("at"))
    right = spark.range(40).select(F.col("id").alias("e"), (F.col("id") / 10.0).alias("other"))
    totals = [F.count("*").alias("n"), F.min("e").alias("first")]
    got = {(r["k"], r["n"], r["first"]) for r in bands.band_summary(left, "at", right, "other", 1.0, 0.5, totals).collect()}
    pairs = bands.band_join(left, "at", right, "other", 1.0, 0.5).groupBy("k").agg(*totals)
    assert got == {(r["k"], r["n"], r["first"]) for r in pairs.collect()} and len(got) == 2400


def test_markdown_is_made_in_many_tasks(spark, sf):
    from lexweave.plans import textual

    assert textual.txt_html_to_markdown(spark, sf).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
