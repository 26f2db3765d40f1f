"""Filters as column expressions: the scan's filter and order specs, and the two row filters.

Row filters are two-valued: a predicate that is null counts as not matched, also below a negation. A filter that keeps
matches is emitted bare, since WHERE drops nulls anyway and a bare predicate can be pushed to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERINGS = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def filter_spec(spec: dict[str, Any] | list | None) -> list[Column]:
    """``{field: value}``, ``{field: {"from", "to", "in"}}``, or a list of these and of names of boolean columns."""
    if not spec:
        return []
    if isinstance(spec, list):
        return [c for item in spec for c in ([F.col(item)] if isinstance(item, str) else filter_spec(item))]
    out = []
    for name, wanted in spec.items():
        c = F.col(name)
        if isinstance(wanted, dict):
            unknown = set(wanted) - {"from", "to", "in"}
            if unknown:
                raise ValueError(f"filter on {name}: unknown keys {sorted(unknown)}")
            if wanted.get("from") is not None:
                out.append(c >= F.lit(wanted["from"]))
            if wanted.get("to") is not None:
                out.append(c <= F.lit(wanted["to"]))
            if wanted.get("in") is not None:
                out.append(c.isin(list(wanted["in"])))
        else:
            out.append(c == F.lit(wanted))
    return out


def order_spec(df: DataFrame, spec: dict[str, str] | list[dict[str, str]] | None) -> list[Column]:
    """``{"column", "direction"}`` or a list of these; an unknown column or direction raises ValueError."""
    out = []
    for one in [spec] if isinstance(spec, dict) else spec or []:
        name, way = one.get("column"), str(one.get("direction", "asc")).lower()
        if name not in df.columns:
            raise ValueError(f"cannot order by {name!r}: no such column")
        if way not in ("asc", "desc"):
            raise ValueError(f"cannot order {way!r}: asc or desc")
        out.append(F.col(name).asc_nulls_last() if way == "asc" else F.col(name).desc_nulls_last())
    return out


def _listed(values: Any) -> list[Any]:
    if values is None:
        return [None]
    return list(values) if isinstance(values, Iterable) and not isinstance(values, (str, bytes)) else [values]


def _literal(value: Any) -> tuple[str, Any]:
    """How a comparison reads its literal: as a number, else as a time, else as text."""
    if isinstance(value, bool):
        return "text", str(value)
    if isinstance(value, (int, float)):
        return "number", float(value)
    if isinstance(value, (date, datetime)):
        return "time", value
    text = str(value)
    try:
        return "number", float(text)
    except ValueError:
        pass
    try:
        return "time", datetime.fromisoformat(text)
    except ValueError:
        return "text", text


def compared(c: Column, operator: str, value: Any, dtype: T.DataType | None = None) -> Column:
    """An ordering comparison whose type is decided, once, by what the literal can be read as.

    A column that is known to be of that type is compared as it is, so that the comparison can be pushed to the scan.
    """
    kind, literal = _literal(value)
    if kind == "number" and isinstance(dtype, T.NumericType):
        # NaN is the greatest double: only a lower bound has to refuse it
        above = operator in ("gt", "gte") and isinstance(dtype, (T.DoubleType, T.FloatType))
        test = getattr(c, ORDERINGS[operator])(literal)
        return test & ~F.isnan(c) if above else test
    if kind == "number":
        number = c.try_cast("double")
        c = F.when(~F.isnan(number), number)
    elif kind == "time":
        c = c.try_cast("timestamp_ntz")
        literal = F.lit(literal.isoformat(sep=" ")).cast("timestamp_ntz")
    else:
        c = c.cast("string")
    return getattr(c, ORDERINGS[operator])(literal)


def row_mask(name: str, values: Any = None, operator: str = "in", case_sensitive: bool = True, dtype: T.DataType | None = None) -> Column:
    """The predicate of the row filter; null where neither matched nor refused."""
    c, listed = F.col(name), _listed(values)
    given = [v for v in listed if v is not None]
    folded = (lambda x: x) if case_sensitive else (lambda x: F.lower(F.coalesce(x.cast("string"), F.lit(""))))
    null_wanted = F.isnull(c) if None in listed else None

    def any_of() -> Column:
        same = folded(c).isin([v if case_sensitive else str(v).lower() for v in given]) if given else F.lit(False)
        if not case_sensitive:
            same = same & F.isnotnull(c)
        return same if null_wanted is None else null_wanted | F.coalesce(same, F.lit(False))

    if operator in ("in", "equals"):
        return any_of()
    if operator in ("not_in", "not_equals"):
        return ~F.coalesce(any_of(), F.lit(False))
    if not given:
        return F.lit(False)
    if operator in ORDERINGS:
        return compared(c, operator, given[0], dtype)
    if operator in ("contains", "regex"):
        return F.rlike(c.cast("string"), F.lit(("" if case_sensitive else "(?i)") + str(given[0])))
    return F.lit(False)


def filter_rows(df: DataFrame, field: str, values: Any = None, operator: str = "in", case_sensitive: bool = True, include: bool = True) -> DataFrame:
    """Keep the matching rows (or, with ``include=False``, all others, null included). An absent field leaves the table as it is."""
    if field not in df.columns:
        return df
    mask = row_mask(field, values, operator, case_sensitive, df.schema[field].dataType)
    return df.where(mask) if include else df.where(~F.coalesce(mask, F.lit(False)))


def prefilter_mask(name: str, values: Any, operator: str = "equals", case_sensitive: bool = False) -> Column:
    """The predicate of the preprocessing filter: every value is tried, text is compared trimmed and, by default, without case."""
    listed = _listed(values)
    text = F.col(name).cast("string")
    fold = (lambda x: x) if case_sensitive else F.lower
    given = [str(v) for v in listed if v is not None]
    if operator == "equals":
        tests = [fold(F.trim(text)) == (v.strip() if case_sensitive else v.strip().lower()) for v in given]
    elif operator == "in":
        tests = [fold(text).isin([v if case_sensitive else v.lower() for v in given])] if given else []
    elif operator in ("contains", "regex"):
        tests = [F.rlike(text, F.lit(("" if case_sensitive else "(?i)") + v)) for v in given]
    else:
        raise ValueError(f"unknown operator {operator!r}")
    mask = F.isnull(F.col(name)) if None in listed else F.lit(False)
    for t in tests:
        mask = mask | F.coalesce(t, F.lit(False))
    return mask


def prefilter_rows(df: DataFrame, field: str, values: Any = None, operator: str = "equals", case_sensitive: bool = False, negate: bool = False) -> DataFrame:
    """Remove the matching rows, or keep only them with ``negate``."""
    mask = prefilter_mask(field, values, operator, case_sensitive)
    return df.where(mask) if negate else df.where(~mask)
