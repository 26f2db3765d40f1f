"""Scans of catalogued tables with filter, order and sample specs, and point lookups."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.predicates import filter_spec, order_spec
from weftline.operators.rowset import sample_rows
from weftline.sources.connectors import load
from weftline.sources.records import parsed
from weftline.sources.schemas import ENTITIES, Entity
from weftline.sources.sinks import exists


class Catalog:
    """Where the entities' tables are: a folder of parquet tables by default, or any reader ``table name -> DataFrame``."""

    def __init__(self, spark: SparkSession, folder: str | None = None, reader: Callable[[str], DataFrame] | None = None) -> None:
        self.spark = spark
        self.read = reader or (lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    @staticmethod
    def jdbc(spark: SparkSession, url: str, database_schema: str = "dbo", partition: dict[str, Any] | None = None, **options: str) -> Catalog:
        """Tables of a database; ``partition`` holds column, lowerBound, upperBound and numPartitions for parallel reads."""

        def read(name: str) -> DataFrame:
            reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"{database_schema}.{name}").options(**options)
            for k, v in (partition or {}).items():
                reader = reader.option("partitionColumn" if k == "column" else k, str(v))
            return reader.load()

        return Catalog(spark, reader=read)

    @staticmethod
    def create_tables(spark: SparkSession, folder: str, models: list[str] | None = None) -> list[str]:
        """Empty tables, with their columns, of the entities that ``folder`` does not hold yet; which were made."""
        made = []
        for name in models or sorted(ENTITIES):
            entity = ENTITIES[name]
            path = f"{folder}/{entity.table}.parquet"
            if not exists(spark, path):
                spark.createDataFrame([], entity.schema).write.parquet(path)
                made.append(entity.table)
        return made

    def entity(self, model: str) -> Entity:
        if model not in ENTITIES:
            raise ValueError(f"unknown model {model!r}; known: {', '.join(sorted(ENTITIES))}")
        return ENTITIES[model]

    def scan(self, model: str, filters: Any = None, order_by: Any = None, sample: int | None = None) -> DataFrame:
        """All columns of a model's table. ``sample`` without an order takes rows at random, with one the first rows."""
        entity = self.entity(model)
        df = self.read(entity.table)
        for predicate in filter_spec(filters):
            df = df.where(predicate)
        if order_by:
            df = df.orderBy(*order_spec(df, order_by))
            return df.limit(sample) if sample else df
        return sample_rows(df, entity.key[0], sample) if sample else df

    def fetch_by_id(self, model: str, value: Any, column: str = "Id") -> DataFrame:
        """The first match, if any."""
        return self.read(self.entity(model).table).where(F.col(column) == F.lit(value)).limit(1)

    def fetch_by_game_id(self, value: int) -> DataFrame:
        return self.fetch_by_id("RobloxGame", value, "gameID")

    def discussion_ids(self, where: str | None = None) -> DataFrame:
        """Ids of discussions that satisfy a raw SQL condition."""
        df = self.read(self.entity("BoardsDiscussion").table)
        return (df.where(where) if where else df).select("DiscussionId")


def source_of(config: dict[str, Any], catalog: Catalog | None = None, spark: SparkSession | None = None, **how: Any) -> DataFrame:
    """Ids by a source's ``type``: 'db' from the catalogue with a raw condition, 'api' from a connector's records."""
    kind = config.get("type")
    if kind == "db":
        return catalog.discussion_ids(config.get("where"))
    if kind == "api":
        raw = load(spark, config["connector"], **how, **{k: str(v) for k, v in (config.get("options") or {}).items()})
        return parsed(raw, config["connector"]).select(F.col(config.get("column", "discussionID")).cast("bigint").alias("DiscussionId")).dropna()
    raise ValueError(f"unknown source type {kind!r}: db or api")


def read_embedding(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """A saved embedding (CSV with a header) and what its columns are."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df, load_embedding(df)


def load_embedding(df: DataFrame) -> dict[str, list[str]]:
    """The columns of a saved embedding: two or three of x, y, z, the labels, and the rest."""
    coordinates = [c for c in ("x", "y", "z") if c in df.columns]
    if len(coordinates) not in (2, 3):
        raise ValueError("an embedding has two or three of the columns x, y, z")
    labels = [c for c in ("label", "labels", "cluster") if c in df.columns][:1]
    return {"coordinates": coordinates, "labels": labels, "metadata": [c for c in df.columns if c not in coordinates + labels]}
