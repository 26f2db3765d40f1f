"""The data of charts by chart name; drawing is left to whatever shows them. Every result is small or as large as its points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import profile
from weftline.operators.base import CHARTS
from weftline.operators.features import MOST_CATEGORIES, numeric_columns


@CHARTS.register("confusion_matrix")
def confusion_matrix(df: DataFrame, truth: str, predicted: str, normalise: str | None = None) -> DataFrame:
    """``y_true, y_pred, n, value``: every pair of the labels that occur on either side, absent ones with 0.

    ``value`` is the count, or its share of the true label's rows ('true'), of the predicted label's ('pred') or of all ('all').
    """
    if normalise not in (None, "true", "pred", "all"):
        raise ValueError(f"unknown normalisation {normalise!r}: true, pred or all")
    counts = df.select(F.col(truth).cast("string").alias("y_true"), F.col(predicted).cast("string").alias("y_pred")).dropna().groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.col("y_true").alias("y")).union(counts.select("y_pred")).distinct()
    got = sorted(r[0] for r in labels.limit(MOST_CATEGORIES + 1).collect())
    if len(got) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} labels")
    every = F.array(*map(F.lit, got)) if got else F.array().cast("array<string>")
    grid = df.sparkSession.range(1).select(F.explode(every).alias("y_true")).select("y_true", F.explode(every).alias("y_pred"))
    full = grid.join(counts, ["y_true", "y_pred"], "left").fillna(0, ["n"])
    if normalise is None:
        return full.withColumn("value", F.col("n").cast("double"))
    by = {"true": ["y_true"], "pred": ["y_pred"], "all": []}[normalise]
    total = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    full = full.join(total, by, "left") if by else full.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    return full.withColumn("value", F.coalesce(F.try_divide("n", "_t"), F.lit(0.0))).drop("_t")


@CHARTS.register("bar_chart")
def bar_chart(df: DataFrame, column: str, value: str | None = None, top_n: int = 20, exclude_columns: Sequence[str] | str = ()) -> DataFrame:
    """``label, value``: counts of the ``top_n`` most frequent labels, or the greatest values; no rows for an excluded column."""
    out = profile.top_counts(df, column, top_n).select(F.col(column).cast("string").alias("label"), F.col("n").cast("double").alias("value"))
    if value:
        out = df.select(F.col(column).cast("string").alias("label"), F.col(value).cast("double").alias("value")).orderBy(F.desc_nulls_last("value"), "label").limit(top_n)
    return out.limit(0) if column in ([exclude_columns] if isinstance(exclude_columns, str) else exclude_columns) else out


@CHARTS.register("word_cloud")
def word_cloud(df: DataFrame, text: str, top_n: int = 200) -> DataFrame:
    """``word, n, size``: the most frequent words; ``size`` is relative to the first."""
    top = profile.word_frequencies(df, text).orderBy(F.desc("n"), "word").limit(top_n)
    most = top.agg(F.max("n").alias("_m")).withColumn("_k", F.lit(1))
    return top.withColumn("_k", F.lit(1)).join(most, "_k").select("word", "n", (F.col("n") / F.col("_m")).alias("size"))


@CHARTS.register("cluster_plot")
def cluster_plot(df: DataFrame, vector: str, label: str = "cluster", dimensions: int = 2, hover: Sequence[str] = ()) -> DataFrame:
    """``x, y[, z], label`` and the hover columns of every row; the coordinates are the vector's first ones."""
    if dimensions not in (2, 3):
        raise ValueError("two or three dimensions")
    return df.select(*(F.get(F.col(vector), F.lit(i)).cast("double").alias("xyz"[i]) for i in range(dimensions)), F.col(label).alias("label"), *hover)


CHARTS.register("correlation_matrix", "dython_correlation_matrix")(profile.association)
CHARTS.register("histogram")(profile.histogram)
CHARTS.register("pair_scatter")(profile.pair_scatter)


@CHARTS.register("boxplot")
def boxplot(df: DataFrame, columns: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    return profile.box_statistics(df, columns or [c for c in numeric_columns(df) if c != by], by)


@CHARTS.register("metric_lines")
def metric_lines(runs: DataFrame, metrics: DataFrame, names: Sequence[str], offsets: dict[str, float] | None = None, pad: float = 0.2) -> DataFrame:
    """``name, metric, value, y_min, y_max``: metrics of runs in per cent, moved by small offsets so that equal lines stay apart."""
    move = F.lit(0.0)
    for m, by in (offsets or {}).items():
        move = F.when(F.col("metric") == m, F.lit(by)).otherwise(move)
    rows = metrics.where(F.col("metric").isin(list(names))).join(runs.select("run_id", "name"), "run_id").select("name", "metric", (F.col("value") * 100 + move).alias("value"))
    edge = rows.agg((F.min("value") - pad).alias("y_min"), (F.max("value") + pad).alias("y_max")).withColumn("_k", F.lit(1))
    return rows.withColumn("_k", F.lit(1)).join(edge, "_k").drop("_k")
