"""Streams of several unordered batches, and tables in buckets."""

import datetime as dt
import zipfile
from pathlib import Path

import pytest

from lexweave.sources import tables
from lexweave.sources.buckets import Buckets, merge_stream
from lexweave.sources.folders import shared_folder
from lexweave.streaming import findings, partials

PARTS = "review long, part long, kind string, findings array<string>, at timestamp"
DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def files(spark, path, batches, schema):
    """A folder with one file a batch, in this order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return stream.parquet(path)


def shown(spark, path):
    return {r["review"]: (r["state"], r["findings"]) for r in findings.read_latest(spark, path, ["review"]).collect()}


def test_previews_give_way_to_the_final_list(spark, tmp_path):
    batches = [
        [(1, 2, "preview", ["b"], at(1)), (2, 1, "preview", ["x"], at(1)), (3, 9, "final", ["only"], at(1))],
        [(1, 1, "preview", ["a"], at(0)), (1, 2, "preview", ["again"], at(1)), (3, 1, "preview", ["late"], at(1))],
        [(2, 2, "preview", ["y", "z"], at(2)), (2, 5, "final", ["end"], at(2)), (1, 3, "preview", [], at(2))],
        [(2, 3, "preview", ["too late"], at(2)), (3, 8, "final", ["older"], at(2)), (4, 1, "preview", ["q"], at(2))],
    ]
    lists = partials.shown_lists(files(spark, f"{tmp_path}/in", batches, PARTS), "1 hour", 10**9)
    findings.latest_into(lists, f"{tmp_path}/out", f"{tmp_path}/log")
    assert shown(spark, f"{tmp_path}/out") == {1: ("preview", ["a", "b"]), 2: ("final", ["end"]), 3: ("final", ["only"]), 4: ("preview", ["q"])}


def test_state_is_bounded_by_time(spark, tmp_path):
    days = [[(100 * d + r, p, "preview", ["f"], at(24 * d)) for r in range(20) for p in range(3)] for d in range(6)]
    stream = files(spark, f"{tmp_path}/in", days, PARTS)
    q = partials.shown_lists(stream, "1 hour", 30 * 3_600_000).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/log").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    total = 6 * 20 * (3 + 1)  # parts and times of all reviews
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] < total


def test_parts_are_held_many_a_row(spark, tmp_path):
    """2,300 parts of a review take a few rows of the state and not one each; parts that come again change nothing."""
    parts = lambda a, b: [(1, p, "preview", [f"f{p}"] * (p % 3), at(1)) for p in range(a, b)]
    batches = [parts(100, 2300) + parts(100, 200), parts(0, 150), parts(50, 60)]
    stream = partials.shown_lists(files(spark, f"{tmp_path}/in", batches, PARTS), "1 hour", 10**9)

    def put(batch, number):
        batch.write.parquet(f"{tmp_path}/out/batch={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/log").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < max(sizes) < 20
    assert shown(spark, f"{tmp_path}/out") == {1: ("preview", [f"f{p}" for p in range(2300) for _ in range(p % 3)])}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2  # the last batch brought no news


ROWS = "k long, v string, n long"


def test_untouched_buckets_keep_their_files_and_retries_change_nothing(spark, tmp_path):
    t = Buckets(spark, f"{tmp_path}/t", ["k"], 8)
    assert t.read() is None
    t.upsert(spark.createDataFrame([(i, "old", 0) for i in range(40)] + [(None, "null", 0)], ROWS), 0)
    before, all_files = t.manifest()["folders"], set(Path(tmp_path).rglob("*.parquet"))
    change = spark.createDataFrame([(3, "first", 1), (3, "new", 2), (100, "added", 1)], ROWS)
    touched = t.upsert(change, 1, ["n"])
    after = t.manifest()["folders"]
    assert 1 <= len(touched) <= 2 and all((after[b] == before[b]) == (int(b) not in touched) for b in before)
    assert all(f.exists() for f in all_files)
    rows = {r["k"]: r["v"] for r in t.read().collect()}
    assert len(rows) == 42 and rows[3] == "new" and rows[100] == "added" and rows[None] == "null"
    assert t.upsert(spark.createDataFrame([(3, "retry", 9)], ROWS), 1) == [] and t.versions() == [1, 2]
    assert {r["v"] for r in t.read(version=1).collect()} == {"old", "null"}
    assert t.compact() == len(touched) and t.versions() == [2]
    assert {r["k"]: r["v"] for r in t.read().collect()} == rows
    assert t.upsert(spark.createDataFrame([], ROWS), 2) == [] and t.read().count() == 42


def test_a_version_is_never_written_twice(spark, tmp_path):
    t = Buckets(spark, f"{tmp_path}/t", ["k"], 4)
    t.upsert(spark.createDataFrame([(1, "a", 0)], ROWS), 0)
    with pytest.raises(RuntimeError):
        t._swap(t.manifest())
    assert t.read().count() == 1


def test_stream_into_buckets(spark, tmp_path):
    batches = [[(1, "a", 1), (2, "b", 1)], [(1, "c", 3), (3, "d", 1)], [(1, "e", 2)]]
    t = Buckets(spark, f"{tmp_path}/t", ["k"], 4)
    for _ in range(2):  # the second run finds nothing new
        merge_stream(files(spark, f"{tmp_path}/in", batches if not Path(f"{tmp_path}/in").exists() else [], ROWS), t, f"{tmp_path}/log", ["n"], "append")
        assert {r["k"]: r["v"] for r in t.read().collect()} == {1: "e", 2: "b", 3: "d"}


def test_appended_parts(spark, tmp_path):
    stream = files(spark, f"{tmp_path}/in", [[(i, "v", n) for i in range(5)] for n in range(3)], ROWS)
    for _ in range(2):
        findings.append_parts(stream, f"{tmp_path}/out", f"{tmp_path}/log")
        assert spark.read.parquet(f"{tmp_path}/out").count() == 15


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared_folder(Elsewhere, "x")


def test_pages_of_rows(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(0, 1203, 1, 2)
    for _ in range(2):
        tables.insert_pages(rows, f"{tmp_path}/p", 50)
    sizes = [pq.read_metadata(f).num_rows for f in Path(f"{tmp_path}/p").glob("*.parquet")]
    assert sum(sizes) == 2406 and max(sizes) == 50


def test_documents_as_files(spark, tmp_path):
    mark = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    paragraph = lambda *runs: f"<w:p>{''.join(f'<w:r><w:t>{x}</w:t></w:r>' for x in runs)}</w:p>"
    with zipfile.ZipFile(tmp_path / "a.DOCX", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{mark}"><w:body>{paragraph("One ", "line &amp; more")}{paragraph()}{paragraph("Two")}</w:body></w:document>')
        z.writestr("word/footnotes.xml", f'<w:footnotes xmlns:w="{mark}">{paragraph("A note")}</w:footnotes>')
    (tmp_path / "b.md").write_text("# text")
    (tmp_path / "c.html").write_text("<p>x</p>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {Path(r["path"]).name: (r["format"], r["text"]) for r in tables.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.DOCX": ("docx", "One line & more\nTwo\nA note"), "b.md": ("text", "# text"), "c.html": ("html", "<p>x</p>"), "d.pdf": ("pdf", None), "e.docx": ("docx", None)}
