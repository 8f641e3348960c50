"""Arrow batches cut to what a worker may hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows and bytes of text that a worker turns into Python values at once.
ROWS, SIZE = 512, 8 << 20


def small(batches: Iterator[pa.RecordBatch], text: int = 1, rows: int = ROWS, size: int = SIZE) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows and about ``size`` bytes of the text column at most, one row at least."""
    for batch in batches:
        upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(upto, before + size, "right"))), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key to four tasks a core if they come in fewer parts than that, as key columns of many rows do in one small file.

    For work that costs much more a row than its bytes; inputs of more parts stay where they are.
    """
    wanted = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df
