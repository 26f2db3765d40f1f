"""Profiling: group statistics, summaries, histograms, box statistics, associations, cluster profiles, chart data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.base import PROFILES
from weftline.operators.features import exact_quantiles, grouped_quantiles, numeric_columns
from weftline.operators.rowset import column_pairs, duplicate_audit, top_counts

GROUP_STATISTICS = ("count", "mean", "median", "std", "min", "max")


def _long(df: DataFrame, by: str | None, columns: Sequence[str]) -> DataFrame:
    """``grp`` (group and column number as one key), ``x``: one row per group column and row."""
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")
    return df.select(group.alias("g"), F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("i", "x")).withColumn("key", F.concat_ws("|", F.col("i").cast("string"), "g"))


def _group_of(c: Column) -> Column:
    """The group's name back from a key; null for the group of null."""
    return F.when(F.length(c) > 0, F.substring(c, F.lit(2), F.length(c)))


def group_profile(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Per group and number column: count, mean, median, sample deviation, min, max; long form.

    All but the median is one aggregate; medians come from :func:`weftline.operators.features.grouped_quantiles`, so no group's
    values are gathered in one task, however large it is.
    """
    long = _long(df, by, columns)
    stats = long.groupBy("key", "g", "i").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    median = grouped_quantiles(long, "key", "x", [0.5]).select("key", F.get("q", F.lit(0)).alias("median"))
    names = F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1)
    return stats.join(median, "key", "left").select(_group_of(F.col("g")).alias("cluster"), names.alias("feature"), "n", "mean", "median", "std", "min", "max")


def profile_long(stats: DataFrame) -> DataFrame:
    """``cluster, feature, statistic, value``."""
    wide = stats.select("cluster", "feature", F.col("n").cast("double").alias("count"), *[c for c in GROUP_STATISTICS if c != "count"])
    return wide.unpivot(["cluster", "feature"], list(GROUP_STATISTICS), "statistic", "value")


def prevalence(df: DataFrame, by: str, indicators: Sequence[str]) -> DataFrame:
    """Share of each 0/1 column per group."""
    return df.groupBy(by).agg(*(F.avg(c).alias(c) for c in indicators))


def indicator_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.metadata.get("kind") == "indicator"]


def crosstab(df: DataFrame, by: str, column: str, top_n: int = 10) -> DataFrame:
    """Counts per group of the column's ``top_n`` most frequent values, 0 where absent."""
    values = [r[0] for r in top_counts(df.where(F.col(column).isNotNull()), column, top_n).collect()]
    return df.groupBy(by).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def ranking(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group n, median, mean and third quartile; rank 1.. by median, largest first."""
    s = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    # null is a group too
    key = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    q = grouped_quantiles(df.select(key.alias("_g"), F.col(value).alias("_x")), "_g", "_x", [0.5, 0.75]).select("_g", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("q75"))
    s = s.withColumn("_g", key).join(q, "_g", "left").select(by, "n", "median", "mean", "q75")
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("median"), by)).cast("long"))


@PROFILES.register("value_counts")
def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


@PROFILES.register("info")
def info(df: DataFrame) -> DataFrame:
    """Column, non-null count and type: one aggregate over the table."""
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns))
    long = counts.unpivot([], df.columns, "column", "non_null") if df.columns else counts
    types = F.create_map(*(x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))))
    return long.select("column", "non_null", types[F.col("column")].alias("dtype"))


def null_audit(df: DataFrame) -> DataFrame:
    counts = df.agg(*(F.count_if(F.col(c).isNull() | (F.isnan(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.lit(False))).alias(c) for c in df.columns))
    return counts.unpivot([], df.columns, "column", "n_null").where("n_null > 0")


@PROFILES.register("describe_info")
def describe_all(df: DataFrame) -> DataFrame:
    """Per column: count, distinct, most frequent value and its count, mean, deviation, min, quartiles, max."""
    numbers = numeric_columns(df)
    quartiles = exact_quantiles(df, numbers, (0.25, 0.5, 0.75)) if numbers else {}
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"), (F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("x")) for i, c in enumerate(df.columns))))
    # one row per column and distinct value, from which all else follows
    counts = df.select(cells.alias("c")).select("c.*").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x"))
    # sums of squares about the mean, from value counts: no cancellation of large sums
    mean = counts.groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("mean"))
    per = counts.join(F.broadcast(mean), "i").groupBy("i").agg(  # one row per column
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.max(F.struct("n", "v")).alias("most"), F.first("mean").alias("mean"),
        F.sqrt(F.try_divide(F.sum(F.col("n") * F.pow(F.col("x") - F.col("mean"), F.lit(2))), F.sum("n") - 1)).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    every = df.sparkSession.createDataFrame([(i, c, *map(float_or_none, quartiles.get(c, [None] * 3))) for i, c in enumerate(df.columns)], "i int, `column` string, q25 double, q50 double, q75 double")
    out = every.join(per, "i", "left").orderBy("i")
    return out.select("column", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("unique", F.lit(0)).alias("unique"), F.col("most.v").alias("top"), F.col("most.n").alias("freq"), "mean", "std", "min", "q25", "q50", "q75", "max")


def float_or_none(x) -> float | None:
    return None if x is None else float(x)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*(F.count_distinct(c).alias(c) for c in columns)).unpivot([], list(columns), "column", "n_distinct")


def is_categorical(df: DataFrame, column: str, most: int = 20) -> bool:
    """Not a number, or a number with at most ``most`` distinct values."""
    return column not in numeric_columns(df) or df.select(column).distinct().limit(most + 1).count() <= most


@PROFILES.register("histogram")
def histogram(df: DataFrame, column: str, bins: int = 10, transform=None) -> DataFrame:
    """Equal-width bins between the least and greatest value; the last bin holds its upper edge. ``bin, low, high, n``."""
    x = F.col(column).cast("double")
    values = df.select((transform(x) if transform else x).alias("x")).where("x is not null and not isnan(x)")
    edge = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if edge.lo is None:
        return values.select(F.lit(0).alias("bin"), F.col("x").alias("low"), F.col("x").alias("high"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (edge.hi - edge.lo) / bins or 1.0
    at = F.least(F.floor((F.col("x") - F.lit(edge.lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(edge.lo) + F.col("bin") * width).alias("low"), (F.lit(edge.lo) + (F.col("bin") + 1) * width).alias("high"), "n")


@PROFILES.register("boxplot", "boxplots")
def box_statistics(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 interquartile ranges) and outlier counts per column, and group if given."""
    long = _long(df, by, columns).where("x is not null")
    q = grouped_quantiles(long, "key", "x", [0.25, 0.5, 0.75])
    q = q.select("key", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    inside = F.col("x").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    out = long.join(q, "key").groupBy("g", "i", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.count_if(~inside).alias("n_out"))
    names = F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1)
    return out.select((_group_of(F.col("g")) if by else F.lit("all")).alias("grp"), names.alias("feature"), "q1", "median", "q3", "low", "high", "n_out")


@PROFILES.register("class_balance")
def class_balance(df: DataFrame, target: str, most: int = 20, bins: int = 10) -> DataFrame:
    """``target`` and ``n``: counts of a categorical target's values, or of the bins (named by their edges) of one with many numbers."""
    if is_categorical(df, target, most):
        return value_counts(df, target)
    cells = histogram(df, target, bins)
    return cells.select(F.format_string("%.6g to %.6g", "low", "high").alias(target), "n")


@PROFILES.register("duplicate_check")
def duplicate_check(df: DataFrame) -> DataFrame:
    return duplicate_audit(df)


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs of number columns: one pass."""
    pairs = column_pairs(columns)
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs))
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramer's V without correction, from the contingency counts."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, cols = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    # sum n^2/(na nb) - 1 is chi^2 / n, cells of count 0 included
    s = t.join(rows, "a").join(cols, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    return s.select(F.sqrt(F.try_divide(F.greatest(F.col("s") - 1, F.lit(0.0)), (F.least("r", "c") - 1).cast("double"))).alias("cramers_v"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """Eta: square root of between-group over total sum of squares."""
    x = F.col(value).cast("double")
    g = df.where(F.col(category).isNotNull() & x.isNotNull()).groupBy(category).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return t.select(F.sqrt(F.try_divide(F.greatest(between, F.lit(0.0)), between + F.col("within"))).alias("eta"))


@PROFILES.register("dython_correlation", "association", "correlation_matrix", "dython_correlation_matrix")
def association(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mixed-type association of every pair: Pearson, Cramer's V or eta; date columns are left out. ``a, b, measure, value``.

    Three scans, whatever the number of columns: one aggregate for all Pearson pairs, one count of all (pair, value, value)
    for Cramer's V, one of all (pair, category) moments for eta.
    """
    usable = [f.name for f in df.schema if not isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) and (columns is None or f.name in columns)]
    numbers = set(numeric_columns(df))
    pairs = column_pairs(usable)
    number = {p: i for i, p in enumerate(pairs)}
    both = [p for p in pairs if p[0] in numbers and p[1] in numbers]
    none = [p for p in pairs if p[0] not in numbers and p[1] not in numbers]
    mixed = [p for p in pairs if (p[0] in numbers) != (p[1] in numbers)]
    parts = []
    if both:
        row = df.agg(*(F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(str(number[a, b])) for a, b in both))
        parts.append(row.unpivot([], [str(number[p]) for p in both], "pair", "value").select(F.col("pair").cast("int").alias("pair"), F.lit("pearson").alias("measure"), "value"))
    if none:
        cells = F.explode(F.array(*(F.struct(F.lit(number[a, b]).alias("pair"), F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")) for a, b in none)))
        t = df.select(cells.alias("c")).select("c.*").where("a is not null and b is not null").groupBy("pair", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
        na, nb = (t.groupBy("pair", x).agg(F.sum("n").alias(f"n{x}")) for x in "ab")
        s = t.join(na, ["pair", "a"]).join(nb, ["pair", "b"]).groupBy("pair").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("s"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
        parts.append(s.select("pair", F.lit("cramers_v").alias("measure"), F.sqrt(F.try_divide(F.greatest(F.col("s") - 1, F.lit(0.0)), (F.least("r", "c") - 1).cast("double"))).alias("value")))
    if mixed:
        turned = [(p, (p[1], p[0]) if p[0] in numbers else p) for p in mixed]
        cells = F.explode(F.array(*(F.struct(F.lit(number[p]).alias("pair"), F.col(f"`{c}`").cast("string").alias("g"), F.col(f"`{v}`").cast("double").alias("x")) for p, (c, v) in turned)))
        g = df.select(cells.alias("c")).select("c.*").where("g is not null and x is not null").groupBy("pair", "g").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
        t = g.groupBy("pair").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("within"))
        between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
        parts.append(t.select("pair", F.lit("eta").alias("measure"), F.sqrt(F.try_divide(F.greatest(between, F.lit(0.0)), between + F.col("within"))).alias("value")))
    if not parts:
        return df.sparkSession.createDataFrame([], "a string, b string, measure string, value double")
    side = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in pairs)), F.col("pair") + 1)
    return reduce(DataFrame.unionByName, parts).select(side(0).alias("a"), side(1).alias("b"), "measure", "value")


@PROFILES.register("pair_scatter")
def pair_scatter(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Points of every pair of columns, both present: ``a, b, x, y``."""
    points = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in column_pairs(columns)))
    return df.select(F.explode(points).alias("p")).select("p.*").where("x is not null and y is not null")


@PROFILES.register("scatter", "scatter_plot")
def scatter(df: DataFrame, columns: Sequence[str], color_by: str | None = None) -> DataFrame:
    return df.select(*columns, *([F.col(color_by).alias("color")] if color_by else [])).dropna(subset=list(columns))


@PROFILES.register("word_cloud", "wordcloud", "wordcloud_global")
def word_frequencies(df: DataFrame, text: str, by: str | None = None) -> DataFrame:
    """How often each word (letters, digits, underscore; lower case) occurs, per class if given."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("word")
    keys = [by, "word"] if by else ["word"]
    return df.select(*([by] if by else []), words).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@PROFILES.register("wordcloud_by_class")
def word_frequencies_by_class(df: DataFrame, text: str, by: str) -> DataFrame:
    return word_frequencies(df, text, by)


def cluster_summary(df: DataFrame, label: str, coordinates: Sequence[str], least: int = 100) -> DataFrame:
    """Size and centre of each cluster; noise (-1) and small clusters are not labelled."""
    s = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in coordinates))
    return s.withColumn("labelled", (F.col("n") >= least) & (F.col(label) != -1))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of each (truth, predicted)."""
    return df.groupBy(F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
