"""Lines and pieces of a page: paragraphs by their gaps, and a range of text over the nodes that hold it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A page's gap where no line is below another; how much wider than usual a gap between paragraphs is.
USUAL_GAP = 14.0
WIDER, WIDER_BY, BACK = 1.3, 4.0, 0.5


def paragraphs(lines: DataFrame, page: str, order: list[str], y: str, text: str) -> DataFrame:
    """``page``, paragraph (from 0), content: lines in order, parted where the gap is wide or the text jumps up.

    Heights fall from line to line. A gap is wide above 1.3 times the page's upper median of falls,
    or 4 more than it. Blank lines and nulls count for gaps but not as text.
    """
    w = Window.partitionBy(page).orderBy(*order)
    gaps = lines.select(page, *order, F.col(y).cast("double").alias("_y"), F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")).alias("_t")).withColumn("_gap", F.lag("_y").over(w) - F.col("_y"))
    falls = gaps.filter("_gap > 0").withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy("_gap"))).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(page)))
    median = falls.filter(F.col("_n") == F.floor(F.col("_of") / 2) + 1).select(page, F.col("_gap").alias("_median"))
    known = gaps.join(median, page, "left").withColumn("_median", F.coalesce("_median", F.lit(USUAL_GAP)))
    breaks = (F.col("_gap") > F.greatest(F.col("_median") * WIDER, F.col("_median") + WIDER_BY)) | (F.col("_gap") < -F.col("_median") * BACK)
    shown = known.withColumn("_break", breaks & (F.col("_t") != "")).filter(F.col("_t") != "")
    numbered = shown.withColumn("_first", F.row_number().over(w) == 1).withColumn("paragraph", F.sum(F.when(F.col("_break") & ~F.col("_first"), 1).otherwise(0)).over(w))
    return numbered.groupBy(page, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_t"))), lambda x: x["_t"]), " ").alias("content"))


def node_ranges(nodes: DataFrame, doc: str, order: list[str], length: Column, start: Column, stop: Column) -> DataFrame:
    """Nodes that hold a part of a document's range, with from and to within the node (0-based, end exclusive)."""
    before = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = nodes.withColumn("_len", length).withColumn("_at", F.coalesce(F.sum("_len").over(before), F.lit(0)))
    cut = at.withColumn("from", F.greatest(start, F.col("_at")) - F.col("_at")).withColumn("to", F.least(stop, F.col("_at") + F.col("_len")) - F.col("_at"))
    return cut.filter(F.col("to") > F.col("from")).drop("_len", "_at")


def stacked(items: DataFrame, page: str, order: list[str], y: str, height: str, text: str, eol: str) -> DataFrame:
    """``page``, line (from 0), y and content of the lines that items in order make, for ``paragraphs``.

    An item stays on the line whose first item is at most 40 % of the line's height (at least 2)
    above or below it; so each line follows from the one before, and a page's items go to one task
    in order: a group is a page. Items without text that end no line are left out. A null height or
    0 is the line's before, at first 12; a null place is 0.
    """
    keep = items.filter((F.coalesce(F.col(text), F.lit("")) != "") | F.coalesce(F.col(eol), F.lit(False)))
    plain = keep.select(F.col(page), F.struct(*order).alias("_order"), F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("_y"), F.coalesce(F.col(height).cast("double"), F.lit(0.0)).alias("_h"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    of_page = plain.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("_order", "_y", "_h", "_t"))).alias("_items"))
    kind = items.schema[page].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, numbers, places, contents = [], [], [], []
            for key, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                lines = []
                for item in own:
                    at, high = item["_y"], item["_h"]
                    line = lines[-1] if lines else None
                    if line and abs(line[0] - at) <= max(2.0, (line[1] or high or 12) * 0.4):
                        line[2].append(item["_t"])
                    else:
                        lines.append((at, high or (line[1] if line else 12), [item["_t"]]))
                for n, (at, _, parts) in enumerate(lines):
                    ids.append(key), numbers.append(n), places.append(at), contents.append(" ".join(parts))
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in ids], batch.column(0).type), pa.array(numbers, pa.int32()), pa.array(places, pa.float64()), pa.array(contents, pa.string())], [page, "line", "y", "content"])

    return of_page.select(page, F.transform("_items", lambda x: F.struct(x["_y"].alias("_y"), x["_h"].alias("_h"), x["_t"].alias("_t"))).alias("_items")).mapInArrow(run, f"`{page}` {kind}, line int, y double, content string")
