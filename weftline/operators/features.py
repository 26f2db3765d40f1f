"""Imputers, scalers, encoders, text vectors, reducers, splits and samplers.

Statistics of all columns of an operator come from one aggregate job. Categories are learned up to ``most`` values; a column
with more raises and should be kept as a vector or indexed by a join instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scalars import LOGS, cell_tokens, cyclic, shifted
from weftline.functions.text import STOPWORDS
from weftline.operators.base import ENCODERS, IMPUTERS, REDUCERS, SAMPLERS, SCALERS, VECTORIZERS, Fitted, Operator
from weftline.operators.rowset import hashed_order
from weftline.session import cut, discard, written

MOST_CATEGORIES = 10_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


# -- column transforms that need a statistic --------------------------------------------------------------------------


class LogTransform(Operator):
    """log1p, log or log10; a column whose least value is 0 or less is first moved so that it becomes 1. Out of domain is null."""

    def __init__(self, columns: Sequence[str], method: str = "log1p", shift: bool = True, suffix: str | None = None) -> None:
        self.columns, self.log, self.shift, self.suffix = list(columns), LOGS[method], shift, suffix

    def fit(self, df: DataFrame) -> Fitted:
        present = [c for c in self.columns if c in df.columns]
        least = df.agg(*(F.min(c).alias(c) for c in present)).first() if self.shift and present else {}

        def apply(d: DataFrame) -> DataFrame:
            move = lambda c: shifted(F.col(c).cast("double"), F.lit(float(least[c]))) if self.shift and least[c] is not None else F.col(c).cast("double")
            return d.withColumns({c + (self.suffix or ""): self.log(move(c)) for c in present if c in d.columns})

        return Fitted(apply, least=least)


class CyclicEncode(Operator):
    def __init__(self, columns: Sequence[str] | str, period: float | dict[str, float] = 12, drop_original: bool = True) -> None:
        self.columns, self.period, self.drop = [columns] if isinstance(columns, str) else list(columns), period, drop_original

    def fit(self, df: DataFrame) -> Fitted:
        def apply(d: DataFrame) -> DataFrame:
            new = {}
            for c in self.columns:
                p = self.period.get(c, 12) if isinstance(self.period, dict) else self.period
                if c in d.columns and p:
                    new[f"{c}_sin"], new[f"{c}_cos"] = cyclic(F.col(c), p)
            done = [c for c in self.columns if f"{c}_sin" in new]
            d = d.withColumns(new) if new else d
            return d.drop(*done) if self.drop else d

        return Fitted(apply)


def catalog_count(df: DataFrame, column: str, row_key: str, sep: str = ",", agg: str = "sum", prefix: str = "catalog_count_") -> DataFrame:
    """Per row, over its distinct parts, the sum, max, min or mean of how many rows carry the part; 0 without parts.

    The part counts are aggregated first and joined back, so a part that most rows share is one row of the join's other side.
    """
    parts = df.select(row_key, F.explode(F.array_distinct(cell_tokens(F.col(column), sep))).alias("part"))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("df"))
    how = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[agg]
    per_row = parts.join(counts, "part").groupBy(row_key).agg(how("df").cast("double").alias("score"))
    return df.join(per_row, row_key, "left").withColumn(prefix + column, F.coalesce("score", F.lit(0.0))).drop("score")


# -- imputers and scalers ---------------------------------------------------------------------------------------------


@IMPUTERS.register("simple", "simple_imputer")
class SimpleImputer(Operator):
    """Numbers by mean or zero, all else by a constant; a filter restricts the rows of the statistic and the rows filled."""

    def __init__(self, columns: Sequence[str] | None = None, numeric_strategy: str = "mean", text_strategy: str = "", filter_column: str | None = None, filter_value: Any = None) -> None:
        if numeric_strategy not in ("mean", "zero"):
            raise ValueError(f"unknown numeric strategy {numeric_strategy!r}")
        self.columns, self.numeric, self.text, self.by, self.wanted = columns, numeric_strategy, text_strategy, filter_column, filter_value

    def _mask(self) -> Column:
        if self.by is None:
            return F.lit(True)
        values = self.wanted if isinstance(self.wanted, (list, tuple, set)) else [self.wanted]
        return F.coalesce(F.col(self.by).isin(list(values)), F.lit(False))

    def fit(self, df: DataFrame) -> Fitted:
        columns = list(self.columns) if self.columns else [c for c in df.columns if c != self.by]
        absent = [c for c in columns if c not in df.columns]
        if absent:
            raise KeyError(f"no such columns: {absent}")
        numbers = set(numeric_columns(df))
        means = {}
        if self.numeric == "mean" and numbers & set(columns):
            wanted = [c for c in columns if c in numbers]
            row = df.agg(*(F.avg(F.when(self._mask(), F.nanvl(F.col(c).cast("double"), F.lit(None)))).alias(c) for c in wanted)).first()
            means = row.asDict()

        def apply(d: DataFrame) -> DataFrame:
            new = {}
            for c in columns:
                value = F.lit(means.get(c) if self.numeric == "mean" else 0.0) if c in numbers else F.lit(self.text)
                have = F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) if c in numbers else F.col(c)
                new[c] = F.when(have.isNull() & self._mask(), value).otherwise(have)
            return d.withColumns(new)

        return Fitted(apply, means=means)


class _Affine(Operator):
    def __init__(self, columns: Sequence[str] | None = None) -> None:
        self.columns = columns

    def _fitted(self, df: DataFrame, columns: list[str]) -> dict:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Fitted:
        columns = [c for c in self.columns if c in df.columns] if self.columns else numeric_columns(df)
        row = self._fitted(df, columns)

        def apply(d: DataFrame) -> DataFrame:
            # a constant column has no spread: it is only centred
            return d.withColumns({c: (F.col(c).cast("double") - F.lit(row[f"{c}__a"])) / F.lit(row[f"{c}__b"] or 1.0) for c in columns})

        return Fitted(apply, statistics=row)


@SCALERS.register("standard")
class StandardScaler(_Affine):
    """(x - mean) / population standard deviation."""

    def _fitted(self, df: DataFrame, columns: list[str]) -> dict:
        pairs = [s.alias(f"{c}__{k}") for c in columns for k, s in zip("ab", (F.avg(c), F.stddev_pop(c)))]
        return df.agg(*pairs).first().asDict()


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], bins: int = 2048) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of whole columns, by narrowing brackets.

    The aggregate ``percentile`` keeps every distinct value of a column in one task. Here each pass counts, for every wanted
    rank, the values in equal parts of its bracket (a few thousand counts, combined on the map side), and the part that holds
    the rank is the next bracket; its data bounds come back with the count, so a bracket of one value ends the search. An
    approximate quantile gives the first bracket, so tails do not matter. All ranks share each pass.
    """
    spread = [0.0, 1.0]
    for p in shares:
        spread += [max(0.0, p - 0.001), min(1.0, p + 0.001)]
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    row = df.agg(*(F.count(x[c]).alias(f"n_{i}") for i, c in enumerate(columns)), *(F.percentile_approx(x[c], spread, 10_000).alias(f"q_{i}") for i, c in enumerate(columns)), *(F.min(x[c]).alias(f"a_{i}") for i, c in enumerate(columns)), *(F.max(x[c]).alias(f"b_{i}") for i, c in enumerate(columns))).first()
    found: dict[tuple[int, int], float] = {}
    open_: dict[tuple[int, int], tuple[float, float]] = {}
    for i in range(len(columns)):
        n = row[f"n_{i}"]
        for j, p in enumerate(shares if n else []):
            for rank in {int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1)))}:
                open_[(i, rank)] = (row[f"q_{i}"][2 + 2 * j], row[f"q_{i}"][3 + 2 * j])
    while open_:
        wanted = list(open_)
        marks = []
        for t, key in enumerate(wanted):
            lo, hi = open_[key]
            v = x[columns[key[0]]]
            part = F.when(v < lo, -1).when(v > hi, bins).otherwise(F.least(F.floor((v - lo) / ((hi - lo) / bins or 1.0)), F.lit(bins - 1)).cast("int"))
            marks.append(F.struct(F.lit(t).alias("t"), part.alias("part"), v.alias("v")))
        got = df.select(F.explode(F.array(*marks)).alias("m")).select("m.*").where("v is not null").groupBy("t", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for t, key in enumerate(wanted):
            before = 0
            for r in sorted((r for r in got if r.t == t), key=lambda r: r.part):
                if before + r.n > key[1]:
                    if r.lo == r.hi:
                        found[key] = r.lo
                        del open_[key]
                    else:
                        open_[key] = (r.lo, r.hi)
                    break
                before += r.n
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        n = row[f"n_{i}"]
        out[c] = []
        for p in shares:
            if not n:
                out[c].append(None)
                continue
            at = p * (n - 1)
            low, high = found[(i, int(np.floor(at)))], found[(i, int(np.ceil(at)))]
            out[c].append(low + (high - low) * (at - np.floor(at)))
    return out


def grouped_quantiles(df: DataFrame, by: str, value: str, shares: Sequence[float], bins: int = 1024, small: int = 1_000_000) -> DataFrame:
    """Exact interpolated quantiles of each group by narrowing brackets: ``by, q`` (an array, one number for each share).

    ``percentile`` keeps all distinct values of a group in one task. Here each pass counts the values of every open group in
    equal parts of its bracket, on the map side first, and keeps the part that holds the wanted ranks; a group whose brackets
    hold at most ``small`` values then gets them from ``percentile`` of those values alone, shifted by the number below. Any
    number of groups goes on in the same passes; their brackets travel as a table that is joined, not collected.
    """
    x = df.select(F.col(by).alias("g"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("x")).where("x is not null")
    counts = x.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # a share lies between two ranks, each of which has a bracket of its own: so each pass narrows every one
    at = [F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), (side(F.lit(float(p)) * (F.col("n") - 1))).alias("rank"), F.lit(k).alias("k")) for i, p in enumerate(shares) for k, side in enumerate((F.floor, F.ceil))]
    wanted = counts.select("g", "n", "lo", "hi", F.explode(F.array(*at)).alias("s")).select("g", "n", "lo", "hi", "s.*", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    wanted = written(wanted, "quantile-ranks")
    open_ = (F.col("inside") > small) & ((F.col("hi") - F.col("lo")) / bins > 0)
    while not wanted.where(open_).isEmpty():
        part = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
        # the brackets are a few rows per group: small beside the table, and joined whichever way suits their size
        inner = x.join(wanted.where(open_), "g").where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        cells = inner.groupBy("g", "i", "k", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b"), *(F.first(c).alias(c) for c in ("n", "p", "rank", "below")))
        before = F.col("below") + F.sum("c").over(Window.partitionBy("g", "i", "k").orderBy("part")) - F.col("c")
        hit = cells.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("before") + F.col("c") > F.col("rank")))
        narrowed = hit.select("g", "n", F.col("a").alias("lo"), F.col("b").alias("hi"), "i", "p", "rank", "k", F.col("before").alias("below"), F.col("c").alias("inside"))
        last, wanted = wanted, written(wanted.where(~open_).unionByName(narrowed), "quantile-ranks")
        discard(last)
    # a bracket of one value needs no look at the table
    keys = ["g", "i", "p", "n", "k"]
    flat = wanted.where("lo = hi").select(*keys, F.col("lo").alias("v"))
    inner = x.join(wanted.where("lo < hi"), "g").where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    per_value = inner.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"), F.first("below").alias("below"), F.first("rank").alias("rank"))
    before = F.col("below") + F.sum("c").over(Window.partitionBy("g", "i", "k").orderBy("x")) - F.col("c")
    found = per_value.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("before") + F.col("c") > F.col("rank"))).select(*keys, F.col("x").alias("v"))
    both = flat.unionByName(found).groupBy("g", "i", "p", "n").agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("b"))
    q = F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") * (F.col("n") - 1) - F.floor(F.col("p") * (F.col("n") - 1)))
    return both.select("g", "i", q.alias("q")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q")).select(F.col("g").alias(by), "q")


@SCALERS.register("robust")
class RobustScaler(_Affine):
    """(x - median) / interquartile range, both interpolated and exact."""

    def _fitted(self, df: DataFrame, columns: list[str]) -> dict:
        got = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
        return {f"{c}__{k}": v for c, (q1, m, q3) in got.items() for k, v in (("a", m), ("b", None if q1 is None else q3 - q1))}


# -- encoders ---------------------------------------------------------------------------------------------------------


def categories(df: DataFrame, value: Column, row_key: str | None = None, most: int = MOST_CATEGORIES) -> list:
    """Distinct values, sorted, or by first appearance along ``row_key``."""
    rows = df.select(value.alias("v"), *([F.col(row_key).alias("k")] if row_key else [])).where("v is not null")
    found = rows.groupBy("v").agg((F.min("k") if row_key else F.count(F.lit(1))).alias("k"))
    got = found.orderBy("k" if row_key else "v", "v").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} categories")
    return [r.v for r in got]


@ENCODERS.register("label", "sklearn_label")
class LabelEncoder(Operator):
    """Sorted distinct values to 0..k-1. Lookup is a join, so the number of values is not limited."""

    def __init__(self, column: str, output: str | None = None, unseen: str = "error") -> None:
        self.column, self.output, self.unseen = column, output or column, unseen

    def codes(self, df: DataFrame) -> DataFrame:
        """``value, code``. Values are range-partitioned and numbered within their part, after the parts before it: no task sees all."""
        values = df.select(F.col(self.column).alias("value")).where("value is not null").distinct()
        # the parts are fixed by computing them once
        parts = cut(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        inner = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
        return parts.withColumn("i", inner).join(offsets, "part").select("value", (F.col("i") + F.col("offset")).cast("long").alias("code"))

    def fit(self, df: DataFrame) -> Fitted:
        codes = self.codes(df)

        def apply(d: DataFrame) -> DataFrame:
            rest = [F.col(f"`{c}`") for c in d.columns if c != self.output]
            got = d.join(codes, d[self.column] == codes["value"], "left")
            code = F.col("code")
            if self.unseen == "error":
                code = F.when(F.col(self.column).isNotNull() & code.isNull(), F.raise_error(F.concat(F.lit("unseen label: "), F.col(self.column).cast("string"))).cast("long")).otherwise(code)
            return got.select(*rest, code.alias(self.output))

        def inverse(d: DataFrame, column: str) -> DataFrame:
            return d.join(codes, d[column] == codes["code"], "left").drop("code")

        return Fitted(apply, codes=codes, inverse=inverse)


class _Indicators(Operator):
    """0/1 columns ``<column>__<category>``, marked as indicators in their metadata."""

    split = False

    def __init__(self, column: str, row_key: str, sep: str = ",", handle_unknown: str = "ignore", drop_original: bool = True) -> None:
        if handle_unknown not in ("ignore", "error"):
            raise ValueError(f"unknown way {handle_unknown!r}: ignore or error")
        self.column, self.row_key, self.sep, self.unknown, self.drop = column, row_key, sep, handle_unknown, drop_original

    def fit(self, df: DataFrame) -> Fitted:
        if self.split:
            parts = F.posexplode(cell_tokens(F.col(self.column), self.sep))
            spread = df.select(F.col(self.row_key), parts.alias("p", "v")).select(F.struct(self.row_key, "p").alias("place"), "v")
            values = categories(spread, F.col("v"), "place")
        else:
            values = categories(df, F.col(self.column).cast("string"), self.row_key)

        def apply(d: DataFrame) -> DataFrame:
            has = (lambda v: F.array_contains(cell_tokens(F.col(self.column), self.sep), v)) if self.split else (lambda v: F.col(self.column).cast("string") == F.lit(v))
            new = [F.coalesce(has(v), F.lit(False)).cast("int").alias(f"{self.column}__{v}", metadata={"kind": "indicator"}) for v in values]
            if self.unknown == "error":
                known = F.array(*map(F.lit, values)).cast("array<string>")
                parts = cell_tokens(F.col(self.column), self.sep) if self.split else F.array(F.col(self.column).cast("string"))
                other = F.get(F.array_except(F.filter(parts, lambda v: v.isNotNull()), known), F.lit(0))
                d = d.where(F.when(other.isNotNull(), F.raise_error(F.concat(F.lit("unknown category: "), other)).cast("boolean")).otherwise(True))
            rest = [F.col(f"`{c}`") for c in d.columns if not (self.drop and c == self.column)]
            return d.select(*rest, *new)

        def inverse(d: DataFrame) -> Column:
            names = F.filter(F.array(*(F.when(F.col(f"`{self.column}__{v}`") != 0, F.lit(v)) for v in values)), lambda x: x.isNotNull())
            return names if self.split else F.get(names, F.lit(0))

        return Fitted(apply, categories=values, inverse=inverse)


@ENCODERS.register("one_hot", "onehot")
class OneHotEncoder(_Indicators):
    pass


@ENCODERS.register("multi_hot", "multihot")
class MultiHotEncoder(_Indicators):
    split = True


@ENCODERS.register("ordinal", "ord")
class OrdinalEncoder(Operator):
    """Given or first-appearance order to 0..k-1; null, and unseen with ``use_encoded_value``, to ``unknown_value``."""

    def __init__(self, column: str, row_key: str | None = None, categories: Sequence[Any] | None = None, handle_unknown: str = "error", unknown_value: int = -1) -> None:
        self.column, self.row_key, self.given, self.unknown, self.value = column, row_key, categories, handle_unknown, unknown_value

    def fit(self, df: DataFrame) -> Fitted:
        values = list(self.given) if self.given is not None else categories(df, F.col(self.column), self.row_key)
        table = F.create_map(*(x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i)))) if values else None

        def apply(d: DataFrame) -> DataFrame:
            c = F.col(self.column)
            code = F.try_element_at(table, c) if table is not None else F.lit(None).cast("int")
            other = F.lit(self.value)
            if self.unknown == "error":
                other = F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("unknown category: "), c.cast("string"))).cast("int")).otherwise(other)
            return d.withColumn(self.column, F.coalesce(code, other))

        def inverse(c: Column) -> Column:
            return F.get(F.array(*map(F.lit, values)), F.when(c >= 0, c))

        return Fitted(apply, categories=values, inverse=inverse)


# -- text vectors and reducers ----------------------------------------------------------------------------------------

TERM = r"[\p{L}\p{N}_]{2,}"


def text_terms(c: Column, pattern: str = TERM, ngram_range: Sequence[int] = (1, 1), stop_words: Sequence[str] = ()) -> Column:
    """The words of a text that are no stop words, and the runs of n of them for each n of ``ngram_range``, as an array."""
    words = F.regexp_extract_all(F.lower(c), F.lit(f"({pattern})"), F.lit(1))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(sorted(set(stop_words))))
    low, high = ngram_range
    if (low, high) == (1, 1):
        return words
    none = F.array().cast("array<string>")
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    every = lambda w: F.concat(*(w if n == 1 else F.when(F.size(w) >= n, runs(w, n)).otherwise(none) for n in range(low, high + 1)))
    # an expression that is named more than once would be computed as often
    return F.get(F.transform(F.array(words), every), F.lit(0))


def terms(df: DataFrame, key: str, text: str, pattern: str = TERM, ngram_range: Sequence[int] = (1, 1), stop_words: Sequence[str] = ()) -> DataFrame:
    """``key, term, tf``."""
    words = df.select(key, F.explode(text_terms(F.col(text), pattern, ngram_range, stop_words)).alias("term"))
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


@VECTORIZERS.register("tfidf")
class TfIdf(Operator):
    """Long-form tf-idf: ln((1+n)/(1+df))+1, rows of length 1. ``key, term, weight``.

    ``ngram_range`` (first and last n), ``stop_words`` (a list, or "english" for the package's own), ``min_df`` and ``max_df``
    (rows if whole numbers, shares if fractions), ``max_features`` (the terms of the greatest total count, ties by term).
    The terms of the fitted table are counted once: the count is written, and both the term statistics and the weights of
    that table are read from it. A row's length comes from a window over its terms, in the shuffle that brings them together.
    """

    def __init__(self, key: str, column: str, pattern: str = TERM, ngram_range: Sequence[int] = (1, 1), stop_words: Sequence[str] | str = (), min_df: float = 1, max_df: float = 1.0, max_features: int | None = None) -> None:
        words = STOPWORDS if stop_words == "english" else stop_words or ()
        self.key, self.column, self.how = key, column, (pattern, tuple(ngram_range), tuple(words))
        self.min_df, self.max_df, self.max_features = min_df, max_df, max_features

    def fit(self, df: DataFrame) -> Fitted:
        n = df.count()
        counts = written(terms(df, self.key, self.column, *self.how), "tfidf-terms")
        least, most = (x * n if isinstance(x, float) else x for x in (self.min_df, self.max_df))
        per_term = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where((F.col("df") >= least) & (F.col("df") <= most))
        if self.max_features:
            per_term = per_term.orderBy(F.desc("total"), "term").limit(self.max_features)
        idf = per_term.select("term", (F.log((F.lit(1.0) + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))

        def apply(d: DataFrame) -> DataFrame:
            tf = counts if d is df else terms(d, self.key, self.column, *self.how)
            w = tf.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
            norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(self.key)))
            return w.select(self.key, "term", (F.col("raw") / norm).alias("weight"))

        def dense(d: DataFrame, output: str = "features") -> DataFrame:
            """``d`` with one array per row over the vocabulary (at most ``max_features`` terms, which must be given), in term order."""
            if not self.max_features or self.max_features > MOST_CATEGORIES:
                raise ValueError(f"a dense vector needs max_features of at most {MOST_CATEGORIES}")
            vocabulary = [r[0] for r in idf.select("term").orderBy("term").collect()]
            per_row = apply(d).groupBy(self.key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("_w"))
            vector = F.array(*(F.coalesce(F.try_element_at("_w", F.lit(t)), F.lit(0.0)) for t in vocabulary)) if len(vocabulary) <= 256 else F.transform(F.array(*map(F.lit, vocabulary)), lambda t: F.coalesce(F.try_element_at(F.col("_w"), t), F.lit(0.0)))
            return d.join(per_row, self.key, "left").withColumn(output, vector).drop("_w")

        return Fitted(apply, idf=idf, n=n, counts=counts, dense=dense)


@VECTORIZERS.register("word2vec")
class WordVectors(Operator):
    """Mean of learned word vectors, zeros without a known word."""

    def __init__(self, column: str, output: str = "vector", vector_size: int = 300, window: int = 5, min_count: int = 2, epochs: int = 10, seed: int = 42, partitions: int = 8) -> None:
        self.column, self.output = column, output
        self.model = Word2Vec(vectorSize=vector_size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=partitions, inputCol="_words", outputCol="_vector")

    def fit(self, df: DataFrame) -> Fitted:
        words = lambda d: d.withColumn("_words", F.filter(F.split(F.coalesce(self.column, F.lit("")), r"\s+"), lambda w: w != ""))
        model = self.model.fit(words(df))
        return Fitted(lambda d: model.transform(words(d)).withColumn(self.output, vector_to_array("_vector")).drop("_words", "_vector"), model=model)


@VECTORIZERS.register("bert")
class Embedder(Operator):
    """Vectors by a supplied Arrow-batched column function; there is no model in this package."""

    def __init__(self, column: str, encode, output: str = "vector") -> None:
        self.column, self.encode, self.output = column, encode, output

    def fit(self, df: DataFrame) -> Fitted:
        return Fitted(lambda d: d.withColumn(self.output, self.encode(F.col(self.column))))


@REDUCERS.register("pca")
class Principal(Operator):
    """Principal components of a numeric array column, centred first."""

    def __init__(self, column: str, n_components: int = 2, output: str = "pca") -> None:
        self.column, self.k, self.output = column, n_components, output

    def fit(self, df: DataFrame) -> Fitted:
        width = len(df.select(self.column).first()[0])
        means = df.agg(*(F.avg(F.get(F.col(self.column), F.lit(i))) for i in range(width))).first()
        centre = F.array(*map(F.lit, means))
        vector = lambda d: d.withColumn("_v", array_to_vector(F.zip_with(F.col(self.column).cast("array<double>"), centre, lambda a, b: a - b)))
        model = PCA(k=self.k, inputCol="_v", outputCol="_p").fit(vector(df))
        return Fitted(lambda d: model.transform(vector(d)).withColumn(self.output, vector_to_array("_p")).drop("_v", "_p"), explained=list(model.explainedVariance), means=list(means))


@REDUCERS.register("truncated_svd")
class TruncatedSvd(Operator):
    """Projection on the leading right singular vectors, rows then scaled to length 1; no centring."""

    def __init__(self, column: str, n_components: int = 2, output: str = "svd", normalise: bool = True) -> None:
        self.column, self.k, self.output, self.normalise = column, n_components, output, normalise

    def fit(self, df: DataFrame) -> Fitted:
        # the cross products of the columns, as partial sums on the executors; their eigenvectors are the singular ones
        wide = df.select(F.col(self.column).cast("array<double>").alias("v")).where("v is not null")

        def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0
            for b in batches:
                if len(b):
                    x = np.stack(b["v"].to_numpy())
                    total = total + x.T @ x
            if not isinstance(total, int):
                yield pd.DataFrame({"g": [total.ravel().tolist()]})

        gram = wide.mapInPandas(products, "g array<double>").select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        side = int(round(len(gram) ** 0.5))
        values, vectors = np.linalg.eigh(gram.sort_values("i")["x"].to_numpy().reshape(side, side))
        order = np.argsort(-values)[: self.k]
        v, singular = vectors[:, order], np.sqrt(np.maximum(values[order], 0))
        # the sign is free: the largest entry of each vector is positive
        v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)
        basis = F.array(*(F.array(*(F.lit(float(x)) for x in v[:, j])) for j in range(v.shape[1])))

        def apply(d: DataFrame) -> DataFrame:
            x = F.col(self.column).cast("array<double>")
            dot = lambda b: F.aggregate(F.zip_with(x, b, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)
            d = d.withColumn("_p", array_to_vector(F.transform(basis, dot)))
            if self.normalise:
                d = Normalizer(inputCol="_p", outputCol="_n", p=2.0).transform(d).drop("_p").withColumnRenamed("_n", "_p")
            return d.withColumn(self.output, vector_to_array("_p")).drop("_p")

        return Fitted(apply, singular=singular.tolist())


# -- splits and samplers ----------------------------------------------------------------------------------------------


def threshold_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` is 'test' for about ``test_size`` of the keys, by their hash: no sort, no shuffle, stable under growth."""
    part = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return df.withColumn("split", F.when(part < test_size, "test").otherwise("train"))


def kfold(df: DataFrame, key: str, k: int = 5, label: str | None = None, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1 by rank in hashed order, within each class if ``label`` is given: every fold has its share of a class.

    Ranks come from counts per class and hash bucket, so no class is gathered in one task.
    """
    bucketed = _hash_ranked(df, key, [label] if label else [], seed)
    return bucketed.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def _hash_ranked(df: DataFrame, key: str, by: list[str], seed: int) -> DataFrame:
    """``_rank`` from 1 in hashed order within ``by``: rank within (by, leading hash byte) plus the rows in earlier buckets."""
    df = df.withColumn("_h", hashed_order(key, seed)).withColumn("_b", F.substring("_h", 1, 2))
    counts = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    on = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in [*by, "_b"]]
    ranked = df.withColumn("_i", inner).alias("l").join(before.alias("r"), on)
    return ranked.select("l.*", (F.col("_i") + F.col("_before")).alias("_rank")).drop("_h", "_b", "_i")


def exact_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` with exactly ceil(n * test_size) test rows, in hashed order."""
    n = df.count()
    test = -(-int(n * test_size * 1_000_000) // 1_000_000)
    return _hash_ranked(df, key, [], seed).withColumn("split", F.when(F.col("_rank") <= test, "test").otherwise("train")).drop("_rank")


@SAMPLERS.register("under", "under_sampler")
class UnderSampler:
    """Each class down to the smallest one's size, or to ``sizes``."""

    def __init__(self, key: str, label: str, sizes: dict | None = None, seed: int = 42) -> None:
        self.key, self.label, self.sizes, self.seed = key, label, sizes, seed

    def resample(self, df: DataFrame) -> DataFrame:
        counts = {r[0]: r[1] for r in df.groupBy(self.label).count().collect()}
        least = min(counts.values(), default=0)
        ranked = _hash_ranked(df, self.key, [self.label], self.seed)
        cap = F.lit(least)
        for value, n in (self.sizes or {}).items():
            cap = F.when(F.col(self.label) == F.lit(value), n).otherwise(cap)
        return ranked.where(F.col("_rank") <= cap).drop("_rank")


@SAMPLERS.register("over", "over_sampler")
class OverSampler:
    """Rows of smaller classes repeated in hashed order until each class has the largest one's size, or that of ``sizes`` if
    larger than its own; ``copy`` numbers repeats."""

    def __init__(self, key: str, label: str, sizes: dict | None = None, seed: int = 42) -> None:
        self.key, self.label, self.sizes, self.seed = key, label, sizes, seed

    def resample(self, df: DataFrame) -> DataFrame:
        counts = df.groupBy(self.label).agg(F.count(F.lit(1)).alias("_n"))
        most = counts.agg(F.max("_n")).first()[0] or 0
        ranked = _hash_ranked(df, self.key, [self.label], self.seed).join(counts.withColumnRenamed(self.label, "_l"), F.col(self.label).eqNullSafe(F.col("_l"))).drop("_l")
        # row r of a class of n is taken for the places r, r + n, r + 2n, ... up to the size wanted
        wanted = F.lit(most) if self.sizes is None else F.col("_n")
        for value, n in (self.sizes or {}).items():
            wanted = F.when(F.col(self.label) == F.lit(value), F.greatest(F.lit(n), F.col("_n"))).otherwise(wanted)
        times = F.floor((wanted - F.col("_rank")) / F.col("_n")).cast("int")
        return ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), times))).drop("_n", "_rank")


@SAMPLERS.register("composite")
class CompositeSampler:
    def __init__(self, steps: Sequence) -> None:
        self.steps = steps

    def resample(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.resample(df)
        return df


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Each row's ``weight`` n / (k * n_c), by a join with the class counts."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weights = counts.select(F.col(label).alias("_l"), (F.lit(float(total.n or 0)) / (F.lit(float(total.k or 1)) * F.col("_n"))).alias("weight"))
    return df.join(weights, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
