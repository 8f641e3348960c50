"""Lists of findings that arrive in parts: previews are shown as they come and give way to the final list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed lists and timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHOWN = "review long, state string, findings array<string>"
#: Parts in one row of the state, as each access to it is a call to Spark and back.
HELD = 1000
#: Rows, and bytes of their Arrow batches, that a task looks at together for those of one list.
TOGETHER, SIZE = 1 << 17, 16 << 20
#: Columns whose rows may be one when all of these are equal.
SAME = ["review", "kind", "at"]


class Lists(StatefulProcessor):
    """One review's list: parts until the final list comes, then only the final one's number.

    The parts of a batch are added to the state together, ``HELD`` a row, and read together when
    news come, as the list shown has all of them anyway.

    A part that comes again changes nothing, nor does a preview after the final list or a final
    list with a smaller number than the one before. State that got no news for ``keep_ms`` of event
    time goes, so what is held is bounded by the reviews of that time.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("held", "parts array<long>, findings array<array<string>>")
        self.final = handle.getValueState("final", "part long")
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news: dict[int, list[str]] = {}
        latest = 0
        before = self.final.get()[0] if self.final.exists() else None
        best: tuple[int, list[str]] | None = None
        for batch in rows:
            latest = max(latest, int(batch["at"].max().timestamp() * 1000))
            for parts, kind, findings in zip(batch["parts"], batch["kind"], batch["findings"]):
                for part, found in zip(parts.tolist(), findings):
                    if kind == "final":
                        if best is None or part > best[0]:
                            best = part, list(found)
                    elif before is None and best is None and part not in news:
                        news[part] = list(found)
        self.wait_until(latest + self.keep_ms)
        if best is not None and (before is None or best[0] > before):
            self.parts.clear()
            self.final.update((best[0],))
            yield pd.DataFrame({"review": [key[0]], "state": ["final"], "findings": [best[1]]})
        elif news:
            held = {part: found for row in self.parts.get() for part, found in zip(*row)}
            new = [(part, found) for part, found in news.items() if part not in held]
            if new:
                self.parts.appendList([tuple(map(list, zip(*new[a : a + HELD]))) for a in range(0, len(new), HELD)])
                held.update(new)
                shown = [x for part in sorted(held) for x in held[part]]
                yield pd.DataFrame({"review": [key[0]], "state": ["preview"], "findings": [shown]})

    def wait_until(self, ms: int) -> None:
        if self.until.exists():
            old = self.until.get()[0]
            if old >= ms:
                return
            self.handle.deleteTimer(old)
        self.until.update((ms,))
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.parts, self.final, self.until):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are equal in ``SAME`` as one, with lists of their parts and findings; in the order they came in."""

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = [pc.fill_null(rows.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for c in SAME]
        order = np.lexsort(keys)
        change = np.zeros(len(order) - 1, bool)
        for k in keys:
            change |= k[order][1:] != k[order][:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        upto = pa.array(np.append(starts, len(order)), pa.int32())
        rows = rows.take(pa.array(order))
        lists = [pa.ListArray.from_arrays(upto, rows.column(c).combine_chunks()) for c in ("part", "findings")]
        return pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(starts)).combine_chunks() for c in SAME), *lists], [*SAME, "parts", "findings"])

    held, n, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= TOGETHER or size >= SIZE:
            yield of(held)
            held, n, size = [], 0, 0
    if held:
        yield of(held)


def shown_lists(parts: DataFrame, late: str, keep_ms: int) -> DataFrame:
    """(review, state, findings) of each review that got news, from a stream (review, part, kind, findings, at).

    ``kind`` is preview or final. Rows later than the watermark ``late`` are not taken, so let it
    be shorter than ``keep_ms``. Findings of a preview stand in order of their parts. Rows of one
    review, kind and time go to its state together.
    """
    parts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = parts.select(*SAME, "part", "findings").mapInArrow(packed, "review long, kind string, at timestamp, parts array<long>, findings array<array<string>>")
    return rows.withWatermark("at", late).groupBy("review").transformWithStateInPandas(Lists(keep_ms), SHOWN, "Update", "EventTime")
