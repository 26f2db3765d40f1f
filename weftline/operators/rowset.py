"""Operators on sets of rows: de-duplication, explosion, ordering, sampling, set operations, reshaping.

Whatever depends on row order takes an explicit ``row_key``; Spark has no order of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import cell_tokens


def dedupe(df: DataFrame, field: str, row_key: str, keep: str = "first", case_sensitive: bool = True, unique_nulls: bool = False) -> DataFrame:
    """One row per value of ``field``, the first or last by ``row_key``.

    An aggregate picks each value's key, with map-side combination, and a semi join keeps those rows: a value that a third
    of all rows share costs one row per partition in the shuffle. Nulls are one value, or each its own with
    ``unique_nulls``. ``row_key`` must be unique; of equal keys all rows stay.
    """
    value = F.col(field) if case_sensitive else F.lower(F.col(field))
    pick = (F.min if keep == "first" else F.max)(row_key).alias("kept_key")
    kept = df.groupBy(value.alias("dedupe_value")).agg(pick)
    nulls = df.where(F.col(field).isNull()) if unique_nulls else None
    if unique_nulls:
        kept = kept.where("dedupe_value is not null")
    rows = df.join(kept.select(F.col("kept_key").alias(row_key)), row_key, "left_semi")
    return rows.unionByName(nulls) if unique_nulls else rows


def duplicate_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each value that occurs more than once over ``columns`` (all by default), with how often: ``columns..., n``."""
    return df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: rows in groups of duplicates, and distinct representatives."""
    return duplicate_audit(df, columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


def explode_columns(df: DataFrame, columns: Sequence[str], sep: str = ",", drop_empty: bool = True) -> DataFrame:
    """Cells to one row per part, column by column (several columns give each row's combinations). Nothing left gives one null."""
    for c in columns:
        if c not in df.columns:
            continue
        parts = F.filter(cell_tokens(F.col(c), sep), lambda t: F.lower(t) != "nan") if drop_empty else F.split(F.col(c), rf"\Q{sep}\E")
        at = df.columns.index(c)
        names = [f"`{x}`" for x in df.columns]
        # outer, so that a cell without parts keeps its row
        df = df.select(*(F.explode_outer(parts).alias(c) if i == at else F.col(n) for i, n in enumerate(names)))
    return df


def hashed_order(key: str, seed: int | str = 42) -> Column:
    """A random order that is the same wherever it is computed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def sample_rows(df: DataFrame, key: str, n: int, seed: int | str = 42) -> DataFrame:
    """``n`` rows at random, the same ones each time: a top-n, not a sort of the table."""
    return df.orderBy(hashed_order(key, seed), F.col(key)).limit(n)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_counts(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values (null is one of them), ties by value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.col(column).asc_nulls_last()).limit(n)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names, one projection; names that the table lacks are ignored."""
    return df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns))


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), pages)


def except_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).subtract(b.select(column))


def union_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The distinct values of both, null being one."""
    return a.select(column).union(b.select(column)).distinct()


def intersect_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def month_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    """The calendar months between two days of each row, both ends clipped: ``range_start, range_end``."""
    a, b = F.to_date(start), F.to_date(end)
    months = df.select(*df.columns, F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month"))).alias("m"))
    return months.select(*df.columns, F.greatest("m", F.to_date(start)).alias("range_start"), F.least(F.last_day("m"), F.to_date(end)).alias("range_end")).where("range_start <= range_end")


def day_ranges(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.select(*df.columns, F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day"))


def column_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def resolve_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Columns whose name agrees with a wanted name in any of four spellings: as is, trimmed lower, letters and digits, without '_' and space."""

    def forms(x: str) -> set[str]:
        low = x.strip().lower()
        return {x, low, "".join(ch for ch in low if ch.isalnum()), low.replace("_", "").replace(" ", "")}

    targets = [forms(w) for w in wanted]
    return [c for c in df.columns if any(forms(c) & t for t in targets)]


def ranked(df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
