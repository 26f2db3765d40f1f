"""Merging of overlapping time intervals per entity into periods and gaps.

Each entity owns an :class:`IntervalMap`, an ordered map of disjoint day intervals. An insertion finds the intervals it
touches by binary search, replaces them by their union and thereby updates the gaps around it. The map is the keyed
state of both the batch operator (:func:`merge_intervals`) and the streaming one (``weftline.streaming.intervals``).

Union of intervals is associative, so the batch operator first merges inside each input partition (a hot entity shrinks
to its few disjoint periods before anything is shuffled), then merges the partial periods by key. After the shuffle rows
arrive sorted by key and are consumed batch by batch: one map is live at a time and no group is ever materialised.

Defined cases: a row without entity, without start, or with its end before its start is left out; a missing end and an
end on one of ``placeholders`` is open; next-day and overlapping intervals merge; equal and repeated rows change
nothing; after an open period there is no gap; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dates that stand for "no end yet".
PLACEHOLDER_ENDS = (date(2099, 12, 31), date(9999, 12, 31))
OPEN = 2**31 - 1
PARTIAL = "entity string, s int, e int"
RESULT = "entity string, kind string, s int, e int"
#: Intervals held by one partition's partial merge before it hands on what it has; only memory depends on it.
PARTIAL_HELD = 200_000


class IntervalMap:
    """Disjoint, non-adjacent closed intervals of day numbers in ascending order."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: Iterable[int] = (), ends: Iterable[int] = ()) -> None:
        self.starts, self.ends = list(starts), list(ends)

    def insert(self, start: int, end: int) -> None:
        """Add one interval: the run of held intervals that overlap it or touch it by a day is replaced by the union."""
        low = bisect_left(self.ends, start - 1)
        high = bisect_right(self.starts, end if end == OPEN else end + 1)
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [start], [end]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return [(e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:])]

    def __len__(self) -> int:
        return len(self.starts)


def _columns(batch: pa.RecordBatch) -> tuple[list, list, list]:
    return batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()


def _premerge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial merge of one input partition, keyed by entity."""
    held: dict[str, IntervalMap] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = [(k, s, e) for k, m in held.items() for s, e in m.periods()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))], ["entity", "s", "e"])

    for batch in batches:
        for key, start, end in zip(*_columns(batch)):
            state = held.get(key)
            if state is None:
                state = held[key] = IntervalMap()
            before = len(state)
            state.insert(start, end)
            size += len(state) - before
            if size > PARTIAL_HELD:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final merge over rows sorted by entity; only the current entity's map is held."""
    current, state = None, IntervalMap()
    rows: list[tuple] = []

    def close() -> None:
        rows.extend((current, "period", s, e) for s, e in state.periods())
        rows.extend((current, "gap", s, e) for s, e in state.gaps())

    def out() -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["entity", "kind", "s", "e"])

    for batch in batches:
        for key, start, end in zip(*_columns(batch)):
            if key != current:
                if current is not None:
                    close()
                current, state = key, IntervalMap()
            state.insert(start, end)
        if len(rows) > 10_000:
            yield out()
            rows = []
    if current is not None:
        close()
    if rows:
        yield out()


def usable_intervals(df: DataFrame, entity: str, start: str, end: str, placeholders: tuple[date, ...] = PLACEHOLDER_ENDS) -> DataFrame:
    """``entity``, ``s`` and ``e`` (day numbers) of the rows that have an entity, a start and no reversed end."""
    began, ended = F.col(f"`{start}`").cast("date"), F.col(f"`{end}`").cast("date")
    opened = ended.isNull() | ended.isin(*placeholders)
    return df.select(
        F.col(f"`{entity}`").cast("string").alias("entity"), F.unix_date(began).alias("s"), F.when(opened, F.lit(OPEN)).otherwise(F.unix_date(ended)).alias("e")
    ).where("entity is not null and s is not null and e >= s")


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, placeholders: tuple[date, ...] = PLACEHOLDER_ENDS) -> DataFrame:
    """Periods and gaps per entity: ``entity, kind ('period' | 'gap'), start_date, end_date`` as ISO days, open ends 'open'."""
    partial = usable_intervals(df, entity, start, end, placeholders).mapInArrow(_premerge, PARTIAL)
    merged = partial.repartition("entity").sortWithinPartitions("entity", "s").mapInArrow(_finish, RESULT)
    day = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    return merged.select("entity", "kind", day("s").alias("start_date"), F.when(F.col("e") == OPEN, F.lit("open")).otherwise(day("e")).alias("end_date"))
