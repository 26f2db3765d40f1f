"""Where tables go: files, idempotent appends, run tracking, models."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.joins import new_keys, upsert


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; whole-number columns stay whole. One file only on request: it runs in one task."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True)


def write_text_report(lines: DataFrame, path: str) -> None:
    lines.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in lines.columns)).alias("value")).write.mode("overwrite").text(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = (), per_file: int = 0) -> None:
    """Append the rows whose key the table at ``path`` does not hold; a second run appends nothing."""
    spark = df.sparkSession
    fresh = new_keys(df, spark.read.parquet(path), keys) if exists(spark, path) else df.dropna(subset=list(keys)).dropDuplicates(list(keys))
    writer = fresh.write.mode("append").partitionBy(*partition_by) if partition_by else fresh.write.mode("append")
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).parquet(path)


def upsert_to(df: DataFrame, path: str, staging: str, keys: Sequence[str]) -> None:
    """Merge by key: the result is written to ``staging`` and then takes the table's place; nothing is read and overwritten at once.

    The old table is moved aside before and removed after, so whenever this stops there is a whole table at ``path`` or at
    ``path`` + ".old"; the next call moves that back first.
    """
    spark = df.sparkSession
    P, aside = spark._jvm.org.apache.hadoop.fs.Path, f"{path}.old"
    fs = P(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def move(a: str, b: str) -> None:
        if not fs.rename(P(a), P(b)):
            raise OSError(f"{a} could not be moved to {b}")

    if exists(spark, aside) and not exists(spark, path):
        move(aside, path)
    fs.delete(P(aside), True)
    had = exists(spark, path)
    merged = upsert(spark.read.parquet(path), df, keys) if had else df
    merged.write.mode("overwrite").parquet(staging)
    if had:
        move(path, aside)
    move(staging, path)
    fs.delete(P(aside), True)


class Runs:
    """Append-only tables of experiment runs, parameters and metrics."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def log(self, run_id: str, name: str, params: dict[str, Any], metrics: dict[str, float]) -> None:
        at = datetime.now(timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(run_id, name, at, json.dumps(params, default=str, sort_keys=True))], "run_id string, name string, at timestamp_ntz, params string").write.mode("append").parquet(f"{self.folder}/runs")
        if metrics:
            self.spark.createDataFrame([(run_id, k, float(v)) for k, v in metrics.items()], "run_id string, metric string, value double").write.mode("append").parquet(f"{self.folder}/metrics")

    def last(self, n: int = 9) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/runs").orderBy(F.desc("at"), "run_id").limit(n)

    def by_ids(self, ids: Sequence[str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/runs").where(F.col("run_id").isin(list(ids)))

    def metrics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/metrics")

    def renamed(self, names: dict[str, str]) -> DataFrame:
        """The runs under new names; others keep theirs."""
        runs = self.spark.read.parquet(f"{self.folder}/runs")
        table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else None
        return runs if table is None else runs.withColumn("name", F.coalesce(F.try_element_at(table, F.col("run_id")), F.col("name")))

    def broken(self) -> DataFrame:
        """Runs without a single metric."""
        return self.spark.read.parquet(f"{self.folder}/runs").join(self.metrics().where("value is not null").select("run_id").distinct(), "run_id", "left_anti")


def write_excel(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One sheet of a small table, for people to read; a table of more rows than a sheet holds raises. Needs ``openpyxl``."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a sheet holds at most {most} rows")
    rows.to_excel(path, index=False)


def save_model(fitted, path: str) -> None:
    """A fitted model as MLlib's own files, which any executor of any session can read again."""
    fitted.state["model"].write().overwrite().save(path)


def json_safe(df: DataFrame) -> DataFrame:
    """Every column as JSON can hold it: nested ones as JSON text, times as ISO text, what is no number as null."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("struct", "array", "map", "variant"):
            c = F.to_json(c)
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd'T'HH:mm:ss")
        elif kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif kind == "binary":
            c = F.base64(c)
        elif kind == "decimal":
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_result(path: str, name: str, params: dict[str, Any], metrics: dict[str, float]) -> None:
    """One experiment's result as JSON on the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as out:
        json.dump({"name": name, "params": params, "metrics": metrics, "at": datetime.now(timezone.utc).isoformat()}, out, default=str, indent=1)
