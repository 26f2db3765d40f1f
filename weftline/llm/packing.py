"""Filling of fixed-capacity containers with texts, by bulk-synchronous best fit.

Items are ordered by size, largest first, and gaps by size. A round matches all items of the current size at once: the
successor sweep finds the smallest gap class that holds the size, the k-th item of the size goes to the k-th container of
that class (conflicts are resolved by rank), the gaps of the containers used shrink together, and the next round follows
until every size is placed. That is best-fit decreasing, done a class at a time.

What makes it bulk: sizes and gaps are whole numbers up to the capacity, so a round only needs the *number* of items of each
size, not the items. Those counts (at most ``capacity`` rows, whatever the corpus) are aggregated on the executors; the plan
made from them is a list of runs "ranks i.. of size s go to containers j..", broadcast behind a check of its length. The
items themselves are ranked where they are: each partition numbers its items within their size while it counts tokens, and
one shuffle of per-partition counts turns that into global ranks. Items meet those counts in a join by (size, partition); none
is collected or gathered by size alone, so a size that a third of all texts share is as cheap as any other.

A text of more than ``capacity`` tokens is cut into full pieces and a rest; no other text is split.

Defined cases: a null or empty text has no tokens and is listed with container null; repeated rows are packed each; ties are
placed in partition order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import tokens as T
from weftline.session import written

ITEMS = "doc_id bigint, piece int, tokens int, chunk int, k bigint"
PLACED = "doc_id bigint, piece int, tokens int, container bigint"
#: Runs that may be broadcast, 24 bytes each.
MOST_RUNS = 2_000_000


def items(df: DataFrame, key: str, text: str, capacity: int, ranks: str = T.RANKS) -> DataFrame:
    """The pieces of every text with their sizes, each numbered (``k``) within its partition (``chunk``) and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, chunk = T.encoding(ranks), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = T.count(t, enc)
                for piece, size in enumerate([capacity] * (n // capacity) + ([n % capacity] if n % capacity or not n else [])):
                    out.append((i, piece, size, chunk, int(seen[size])))
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], [c.split()[0] for c in ITEMS.split(", ")])

    return df.select(F.col(f"`{key}`").cast("bigint"), F.col(f"`{text}`").cast("string")).mapInArrow(run, ITEMS)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """Runs ``(size, first rank, first container)`` that place ``counts[size]`` items of every size."""
    runs: list[tuple[int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first container, how many)
    open_gaps: list[int] = []
    used = 0

    def add(gap: int, first: int, many: int) -> None:
        if gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, many))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(open_gaps, size)
            if at == len(open_gaps):
                fresh = -(-left // (capacity // size))
                add(capacity, used, fresh)
                used += fresh
                continue
            gap = open_gaps[at]
            first, many = gaps[gap].pop()
            take = min(left, many)
            if take < many:
                gaps[gap].append((first + take, many - take))
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            runs.append((size, rank, first))
            add(gap - size, first, take)
            left, rank = left - take, rank + take
    return runs


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, ranks: str = T.RANKS) -> DataFrame:
    """``doc_id, piece, tokens, container`` of every piece of every text."""
    sized = written(items(df, key, text, capacity, ranks), "packing-items")
    per_chunk = sized.groupBy("tokens", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in per_chunk.where("tokens > 0").groupBy("tokens").agg(F.sum("n")).collect()}
    runs = plan(counts, capacity)
    if len(runs) > MOST_RUNS:
        raise ValueError(f"a plan of {len(runs)} runs is too long to broadcast")
    # (size, rank) as one ordered number
    steps = np.array(sorted((s << 44 | r, c) for s, r, c in runs), np.int64).reshape(-1, 2)
    shared = df.sparkSession.sparkContext.broadcast(steps)
    before = Window.partitionBy("tokens").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select("tokens", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = sized.join(offsets, ["tokens", "chunk"]).select("doc_id", "piece", "tokens", (F.col("offset") + F.col("k")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts = shared.value[:, 0], shared.value[:, 1]
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            if len(keys):
                at = np.clip(np.searchsorted(keys, size << 44 | rank, "right") - 1, 0, None)
                container = firsts[at] + rank - (keys[at] & (2**44 - 1))
            else:
                container = np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(container, pa.int64(), mask=size == 0)], [c.split()[0] for c in PLACED.split(", ")])

    return ranked.mapInArrow(place, PLACED)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: how many containers, tokens, pieces, and the share of the space left unused."""
    # containers are numbered without holes, so no distinct count is needed
    total = packed.where("container is not null").agg(
        (F.coalesce(F.max("container"), F.lit(-1)) + 1).alias("n_containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces")
    )
    return total.withColumn("unused_share", F.try_divide(F.col("n_containers") * capacity - F.col("n_tokens"), F.col("n_containers") * F.lit(capacity)))
