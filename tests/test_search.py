"""Indexes, band joins and as-of joins against scans and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import bands, desk, postings, retrieval, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    """2,000 rows around 20 centres, a crowd of equal rows, and rows without a usable vector."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.normal(size=16)).tolist(), i % 3) for i in range(2000)] + [(5000 + i, [1.0] * 16, 0) for i in range(600)]
    odd = [(6000, None, 0), (6050, [0.0] * 16, 0), (6100, [1.0], 0), (6150, [float("nan")] + [1.0] * 15, 0), (None, [1.0] * 16, 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, kind int").repartition(4).cache()


def pairs(df):
    return {(r["query_id"], r["vec_id"]) for r in df.select("query_id", "vec_id").collect()}


def test_index_recall_and_rows_looked_at(spark, vectors, tmp_path):
    index = vector_index.build(vectors, f"{tmp_path}/a", 16)
    queries = vectors.filter("vec_id % 50 = 0 AND vec_id < 5000")
    exact = pairs(retrieval.nearest_of_each(vectors.filter("vec_id < 5000"), queries, 10))
    found = vector_index.search(index, queries, 10, 6)
    assert found.groupBy("query_id").count().filter("count <> 10").isEmpty()
    assert len(pairs(found) & exact) / len(exact) >= 0.9
    seen = vector_index.looked_at(index, queries, 6).first()
    assert seen["queries"] == 40 and seen["rows"] == 2600 and seen["share"] < 0.5
    again = vector_index.load(spark, f"{tmp_path}/a")
    assert pairs(vector_index.search(again, queries, 10, 6)) == pairs(found)


def test_cells_needed_for_a_recall(spark, vectors, tmp_path):
    """Clustered vectors need few cells, those without clusters many; either way the recall is reached."""
    clustered = vector_index.build(vectors.filter("vec_id < 5000"), f"{tmp_path}/d", 16)
    few = vector_index.needed(clustered, spark)
    assert few <= len(clustered.centroids) // 3
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = vector_index.build(rows, f"{tmp_path}/e", 64)
    queries = rows.filter("vec_id % 50 = 0")
    exact = pairs(retrieval.nearest_of_each(rows, queries, 10))
    found = pairs(vector_index.search(index, queries, 10, vector_index.needed(index, spark)))
    assert len(found & exact) / len(exact) >= 0.9
    assert vector_index.needed(vector_index.build(rows.limit(0), f"{tmp_path}/f", 64), spark) == 1


def test_index_over_all_cells_is_exact(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SLOT_ROWS", 100)  # the crowd's cell has several slots
    monkeypatch.setattr(vector_index, "PART_QUERIES", 7)
    monkeypatch.setattr(vector_index, "RERANKED", 700)
    index = vector_index.build(vectors, f"{tmp_path}/b", 16, where=F.col("kind") != 1, cells=9)
    assert vector_index.indexed(index, spark).agg(F.max("slot")).first()[0] >= 5
    queries = vectors.filter("vec_id % 50 = 0")
    want = retrieval.nearest_of_each(vectors.filter("kind <> 1 AND vec_id IS NOT NULL AND size(embedding) = 16"), queries, 5)
    rows = lambda df: sorted((r["query_id"], r["vec_id"], r["distance"]) for r in df.collect())
    assert rows(vector_index.search(index, queries, 5, 9)) == rows(want)
    vector_index.append(index, vectors.filter("kind = 1"))
    assert vector_index.indexed(index, spark).count() == 2600


def test_index_of_nothing(spark, vectors, tmp_path):
    index = vector_index.build(vectors.limit(0), f"{tmp_path}/c", 16)
    assert vector_index.search(index, vectors, 5, 3).collect() == []


def test_postings_as_by_scan(spark, tmp_path):
    texts = ["The quick brown fox", "the QUICK dog", "quack", "", None, "ab", "é漢字かな x", "aaaa", "fox " * 3000 + "quick"] + [f"row {i} of many" for i in range(200)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    needles = [(i, n) for i, n in enumerate(["quick", "QUICK", "qu", "a", "", None, "zzz", "漢字か", "fox f", "row 1", "aaa", "many", "k dog", "%_.*"])]
    postings.write_postings(chunks, "id", "text", f"{tmp_path}/p", buckets=4)
    rows, counts = (spark.read.parquet(f"{tmp_path}/p/{x}") for x in ("postings", "counts"))
    got = postings.search(spark.createDataFrame(needles, "n long, needle string"), "n", "needle", chunks, "id", "text", rows, counts)
    want = {(i, j) for i, n in needles if n for j, t in enumerate(texts) if t and n.lower() in t.lower()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    found = postings.candidates(spark.createDataFrame([(0, "row 17 of")], "n long, needle string"), "n", "needle", rows, counts)
    assert found.count() < 30  # few of 200 rows are read


def test_postings_by_block_and_lane(spark, tmp_path):
    """One file a lane and not one a bucket and task, a row a gram and block; short needles are answered by masks, equal ones once, and rows without an id are scanned."""
    texts = [f"Row {i} of Many \U0001f600 漢{'' if i % 3 else ' ß'}" for i in range(200)]
    chunks = spark.createDataFrame([*enumerate(texts), (None, "row ab"), (-5, "ab row"), (7000, None)], "id long, text string").repartition(5)
    postings.write_postings(chunks, "id", "text", f"{tmp_path}/p", buckets=2)
    lanes = 2  # of four shuffle partitions
    assert len(list((tmp_path / "p/postings").rglob("*.parquet"))) <= 2 * lanes
    rows, counts = (spark.read.parquet(f"{tmp_path}/p/{x}") for x in ("postings", "counts"))
    assert rows.count() == rows.select("gram", "block").distinct().count()
    needles = [(1, "OW"), (1, "ab"), (2, "ow"), (3, "漢 ß"), (4, "\U0001f600"), (5, "y \U0001f600 漢"), (6, "row 19"), (7, "q")]
    got = sorted(map(tuple, postings.search(spark.createDataFrame(needles, "n long, needle string"), "n", "needle", chunks, "id", "text", rows, counts).collect()), key=str)
    want = sorted(((n, i) for n, x in needles for i, t in [*enumerate(texts), (None, "row ab"), (-5, "ab row")] if x.lower() in t.lower()), key=str)
    assert got == want
    plan = postings.candidates(spark.createDataFrame([(0, "ow")], "n long, needle string"), "n", "needle", rows, counts)
    assert plan.count() == 201 and "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_masks_of_many_letters():
    """More kinds of letters than a number holds beside a bit."""
    import numpy as np

    points = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    texts = ["".join(map(chr, points[a::2])) for a in (0, 1)]
    grams, held = postings.masks([x.encode() for x in texts], np.array([3, 63]))
    assert len(np.unique(grams)) == len(grams) == sum(3 * len(x) - 3 for x in texts)
    assert set(held.view(np.uint64).tolist()) == {1 << 3, 1 << 63}


@pytest.mark.parametrize("part_rows", [100_000, 3])
def test_band_join_as_by_all_pairs(spark, monkeypatch, part_rows):
    monkeypatch.setattr(bands, "PART_ROWS", part_rows)
    rng = np.random.default_rng(2)
    left = [(i, float(x)) for i, x in enumerate(rng.integers(-30, 30, 60))] + [(99, None)]
    right = [(i, float(x)) for i, x in enumerate(rng.normal(scale=20, size=80))] + [(200 + i, 5.0) for i in range(40)] + [(300, None)]
    a, b = spark.createDataFrame(left, "i long, at double"), spark.createDataFrame(right, "j long, other double")
    for before, after, width in ((3, 7, None), (0, 0, None), (5, 5, 1.5)):
        got = bands.band_join(a, "at", b, "other", before, after, width)
        want = sorted((i, j) for i, x in left for j, y in right if x is not None and y is not None and x - before <= y <= x + after)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    plan = bands.band_join(a, "at", b, "other", 3, 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_last_mark_before(spark):
    rows = spark.createDataFrame([("a", 5, 1), ("a", 0, 2), ("a", 9, 3), ("b", 4, 4), (None, 4, 5), ("a", None, 6)], "k string, at int, n int")
    marks = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 5, "z"), ("a", None, "never"), (None, 1, "w")], "k string, place int, name string")
    got = {r["n"]: r["name"] for r in bands.last_at(rows, "k", "at", marks, "place", ["name"]).collect()}
    assert got == {1: "z", 2: None, 3: "z", 4: None, 5: "w", 6: None}


def test_pages_without_lists_of_starts(spark):
    offsets = spark.createDataFrame([(1, 0), (1, 10), (1, 25), (1, -3), (2, 5)], "d long, o int")
    pages = spark.createDataFrame([(1, 0), (1, 10), (1, 10), (1, 20)], "d long, s int")
    found = desk.page_at(offsets, "d", "o", pages, "s")
    assert {(r["d"], r["o"]): r["page"] for r in found.collect()} == {(1, 0): 1, (1, 10): 3, (1, 25): 4, (1, -3): 0, (2, 5): None}
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
