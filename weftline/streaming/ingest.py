"""Incremental ingestion: new files once, new keys once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.sinks import append_new


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: Sequence[str], glob: str | None = None) -> int:
    """Read what came into ``source`` since the last call and append rows of unknown keys to ``target``; rows of the last batch.

    A batch that is run again after a failure finds its keys stored and appends nothing.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(source)
    query = stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, target, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def first_seen(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stream.dropDuplicates(list(keys))
