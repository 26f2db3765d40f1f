"""Whole pipelines and streams as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans import pipeline
from weftline.queries import general
from weftline.queries.register import Queries
from weftline.session import shared_dir, table
from weftline.sources.catalog import Catalog
from weftline.streaming.ingest import ingest
from weftline.streaming.intervals import stream_intervals

q = Queries()


@q("""
SELECT source, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT source, lower(coalesce(text, '')) AS t FROM documents WHERE lower(trim(lang)) = 'en') WHERE t <> '' GROUP BY source""")
def pipeline_flow(spark, d):
    entries = [
        {"stage": "preprocess", "params": {"steps": [{"name": "filter_rows", "params": {"field": "lang", "values": ["EN"], "negate": True}}, {"name": "lowercase", "params": {"field": "text"}}]}},
        {"stage": "filter", "filter_features": [{"name": "drop_columns", "params": {"columns_to_drop": ["n_chars"]}}]},
        {"stage": "profile", "params": {"steps": [{"name": "value_counts", "params": {"column": "source"}}]}},
    ]
    flow = pipeline.run(entries, spark, Catalog(spark, d), table(spark, d, "documents"))
    return flow.data.where("text != ''").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT Id, DiscussionId, Closed FROM boards_discussions WHERE CategoryId >= 100 AND CategoryId <= 110")
def catalog_scan(spark, d):
    return Catalog(spark, d).scan("BoardsDiscussion", {"CategoryId": {"from": 100, "to": 110}}).select("Id", "DiscussionId", "Closed")


@q("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_size > 25) AS cluster, CAST(count(*) OVER (PARTITION BY p_size > 25) AS BIGINT) AS n, 'word' || CAST(CAST(p_size > 25 AS INTEGER) AS VARCHAR) AS keyword FROM part")
def cluster_flow(spark, d):
    """Texts of two kinds through the whole clustering stage: tf-idf, reduction, clusters, layout, evaluation, keywords."""
    kind = F.concat(F.lit("word"), (F.col("p_size") > 25).cast("int").cast("string"))
    df = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", kind, kind, kind, kind, F.lit("common"), F.concat(F.lit("x"), (F.col("p_partkey") % 5).cast("string"))).alias("text"))
    entry = {
        "stage": "cluster", "name": "c", "vectorizer": {"name": "tfidf", "params": {"key": "p_partkey", "column": "text", "max_features": 50}}, "reducers": [{"name": "truncated_svd", "params": {"n_components": 3}}],
        "model": "kmeans", "model_params": {"k": 2}, "layout": 2, "keywords": {"key": "p_partkey", "text": "text", "n": 1}, "evaluators": [{"name": "clustering_quality"}],
    }
    flow = pipeline.run([entry], spark, data=df)
    first = flow.data.groupBy("cluster").agg(F.min("p_partkey").alias("name"), F.count(F.lit(1)).alias("n"))
    words = flow.results["c_keywords"].select("cluster", F.col("term").alias("keyword"))
    return flow.data.select("p_partkey", "cluster").join(first, "cluster").join(words, "cluster").select("p_partkey", F.col("name").alias("cluster"), "n", "keyword")


@q("SELECT CAST(f AS INTEGER) AS fold, 1.0 AS accuracy, 1.0 AS f1 FROM range(3) t(f) UNION ALL SELECT -1, 1.0, 1.0")
def experiment_flow(spark, d):
    """A separable text task through the classification experiment: vectorised inside each fold, sampled, weighed; -1 is the test set."""
    kind = (F.col("p_size") > 25).cast("int")
    word = F.concat(F.lit("word"), kind.cast("string"))
    df = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", word, word, F.lit("common")).alias("text"), kind.cast("double").alias("label"))
    entries = [
        {"stage": "split", "params": {"key": "p_partkey", "exact": True}},
        {"stage": "experiment", "name": "e", "model": "naive_bayes", "vectorizer": {"name": "tfidf", "params": {"key": "p_partkey", "column": "text", "max_features": 20}}, "cv": {"key": "p_partkey", "folds": 3}, "sampler": {"name": "under", "params": {"key": "p_partkey", "label": "label"}}, "class_weights": True},
    ]
    got = pipeline.run(entries, spark, data=df).results["e"]
    whole = got["metrics"].withColumn("fold", F.lit(-1))
    return got["folds"].select("fold", "accuracy", "f1").unionByName(whole.select("fold", "accuracy", "f1"))


@q("SELECT DISTINCT AppID FROM steam_games WHERE AppID IS NOT NULL")
def stream_incremental_ingest(spark, d):
    """The games table ingested twice as a bounded stream; the second run finds every key stored."""
    import uuid

    base = f"{shared_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    games = table(spark, d, "steam_games").select("AppID", "Name")
    games.write.parquet(f"{base}/in")
    for at in ("one", "two"):
        ingest(spark, f"{base}/in", games.schema, f"{base}/out", f"{base}/state-{at}", ["AppID"])
    return spark.read.parquet(f"{base}/out").select("AppID")


@q(general.ORACLES["p3_found"])
def stream_membership_periods(spark, d):
    """Memberships as a bounded stream through keyed interval state; the last version per member is the batch result."""
    import uuid

    base = f"{shared_dir(spark).rstrip('/')}/periods-{uuid.uuid4().hex}"
    m = table(spark, d, "oireachtas_member_memberships").select("pId", "membership_start_date", "membership_end_date")
    m.write.parquet(f"{base}/in")
    stream = stream_intervals(spark.readStream.schema(m.schema).parquet(f"{base}/in"), "pId", "membership_start_date", "membership_end_date")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.groupBy("entity").agg(F.max("version").alias("version"))
    return out.join(last, ["entity", "version"]).select(F.col("entity").alias("pid"), "kind", "start_date", "end_date")
