"""The interval map as keyed state of a stream: each arriving interval updates its entity's periods and gaps.

State per entity is the ordered disjoint map, as two arrays. Every batch emits the current periods and gaps of the entities it
touched, with a version, so a downstream upsert by (entity, version) keeps the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from weftline.operators.intervals import OPEN, PLACEHOLDER_ENDS, IntervalMap, usable_intervals

STATE = "starts array<int>, ends array<int>, version bigint"
OUT = "entity string, version bigint, kind string, s int, e int"


def update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    starts, ends, version = state.get if state.exists else ((), (), 0)
    held = IntervalMap(starts, ends)
    for b in batches:
        for s, e in zip(b["s"], b["e"]):
            held.insert(int(s), int(e))
    state.update((held.starts, held.ends, version + 1))
    rows = [("period", s, e) for s, e in held.periods()] + [("gap", s, e) for s, e in held.gaps()]
    yield pd.DataFrame({"entity": key[0], "version": version + 1, "kind": [r[0] for r in rows], "s": [r[1] for r in rows], "e": [r[2] for r in rows]})


def stream_intervals(stream: DataFrame, entity: str, start: str, end: str, placeholders=PLACEHOLDER_ENDS) -> DataFrame:
    """``entity, version, kind, start_date, end_date`` of every entity a batch touched."""
    rows = usable_intervals(stream, entity, start, end, placeholders)
    got = rows.groupBy("entity").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
    day = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    return got.select("entity", "version", "kind", day("s").alias("start_date"), F.when(F.col("e") == OPEN, F.lit("open")).otherwise(day("e")).alias("end_date"))
