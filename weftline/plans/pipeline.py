"""Pipelines of stages from YAML or dicts; a stage maps a table (or a train/test pair) lazily to the next.

A stage that fails is tried again as often as its entry's ``max_retries`` says, then raises, unless its entry says ``on_error:
skip``. Stages that learn are fitted on the training table and
applied to both. Nothing runs until a sink or the caller asks for rows, apart from the statistics a fit needs.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.functions import text as X
from weftline.functions.predicates import filter_rows, prefilter_rows
from weftline.operators import charts, features, joins, ml, profile, rowset  # noqa: F401  (charts registers)
from weftline.operators.base import CHARTS, ENCODERS, EVALUATORS, EXPERIMENTS, IMPUTERS, MODELS, PROFILES, REDUCERS, SAMPLERS, SCALERS, VECTORIZERS
from weftline.session import cut, written
from weftline.sources import connectors, records, sinks
from weftline.sources.catalog import Catalog

log = logging.getLogger(__name__)


@dataclass
class Flow:
    """What runs through a pipeline: one table, or two after a split, and what stages left behind by name."""

    spark: SparkSession
    catalog: Catalog | None = None
    data: DataFrame | None = None
    test: DataFrame | None = None
    results: dict[str, Any] = field(default_factory=dict)

    def map(self, f: Callable[[DataFrame], DataFrame]) -> None:
        self.data = f(self.data)
        self.test = f(self.test) if self.test is not None else None

    def fit(self, operator) -> None:
        fitted = operator.fit(self.data)
        self.map(fitted.transform)


STAGES: dict[str, Callable[[Flow, dict], None]] = {}


def stage(*names: str):
    def add(f):
        STAGES.update(dict.fromkeys(names, f))
        return f

    return add


@stage("extract", "table")
def _extract(flow: Flow, p: dict) -> None:
    flow.data = flow.catalog.scan(p["model"], p.get("filters"), p.get("order_by"), p.get("sample_size"))
    for c in p.get("date_columns", []):
        if c in flow.data.columns:
            flow.data = flow.data.withColumn(c, F.col(c).try_cast("timestamp_ntz"))
    if p.get("output_csv"):
        sinks.write_csv(flow.data, p["output_csv"])


@stage("ingest")
def _ingest(flow: Flow, p: dict) -> None:
    """Read a connector and append what is new to the tables of ``folder``; ``transport`` may be injected in code.

    Questions get their answers (``answers: true``, fetched by ``xml_transport``); games get review summaries and player
    counts (``lookups: true``).
    """
    transport = p.get("transport", connectors.http)
    options = {k: str(v) for k, v in (p.get("options") or {}).items()}
    raw = cut(connectors.load(flow.spark, p["connector"], transport, **options))
    tables = records.rows_of(raw, p["connector"])
    if p["connector"] == "oireachtas_questions" and p.get("answers"):
        rows, keys = tables["oireachtas_questions"]
        tables["oireachtas_questions"] = (records.with_answers(rows, p.get("xml_transport", connectors.http_text)), keys)
    if p["connector"] == "steam_store" and p.get("lookups"):
        rows, keys = tables["steam_games"]
        for name in ("steam_review", "steam_current_user"):
            found = cut(connectors.load(flow.spark, name, transport, **options))
            rows = joins.lookup_overwrite(rows, records.rows_of(found, name)[name][0], "AppID")
        tables["steam_games"] = (rows, keys)
    for name, (rows, keys) in tables.items():
        target = f"{p['folder']}/{name}.parquet"
        if p.get("upsert") and name == p.get("upsert"):
            sinks.upsert_to(rows, target, f"{target}.staging", keys)
        else:
            sinks.append_new(rows, target, keys)
        flow.results[name] = rows


#: Preprocessors of whole tables: (table, parameters) -> table.
TABLE_STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "remove_duplicates": lambda d, p: rowset.dedupe(d, p["field"], p["row_key"], p.get("keep", "first"), p.get("case_sensitive", True), not p.get("dropna", True)),
    "explode_columns": lambda d, p: rowset.explode_columns(d, p["columns"], p.get("sep", ",")),
    "filter_rows": lambda d, p: prefilter_rows(d, p["field"], p.get("values"), p.get("operator", "equals"), p.get("case_sensitive", False), p.get("negate", False)),
    "count_features": lambda d, p: d.withColumns({p.get("prefix", "num_") + c: S.count_features(F.col(c), p.get("sep", ",")) for c in p["columns"] if c in d.columns}),
    "catalog_count": lambda d, p: _fold(d, p["columns"], lambda x, c: features.catalog_count(x, c, p["row_key"], p.get("sep", ","), p.get("agg", "sum"))),
    "merge_features": lambda d, p: d.withColumn(p.get("merge_to", "merged_feature"), X.merge_features(*(F.col(c) for c in p["columns"]))),
    "temporal_features": lambda d, p: d.withColumns(S.temporal_features(F.col(p["date_column"]), p.get("prefix") or p["date_column"], p.get("day", True), p.get("month", True), p.get("year", True), p.get("quarter", False), p.get("quarter_format", "label"), F.lit(p["reference_date"]).cast("timestamp_ntz") if p.get("days_since") else None)),
    "cyclic_encode": lambda d, p: features.CyclicEncode(p["columns"], p.get("period", 12), p.get("drop_original", True)).fit_transform(d),
    "normalise_feature": lambda d, p: d.withColumn(p.get("result_col") or f"{p['numerator']}_per_{p['denominator']}", S.ratio(F.col(p["numerator"]), F.col(p["denominator"]), p.get("denom_transform", "log1p"), None, p.get("smoothing", 1e-9), p.get("post_log", True)) if {p["numerator"], p["denominator"]} <= set(d.columns) else F.lit(None).cast("double")),
    "mask_genre_words": lambda d, p: d.withColumn(p.get("description_field", "Description"), X.mask_words(F.col(p.get("description_field", "Description")), p["genre_words"], p.get("mask_token", "<MASKED>")) if p.get("genre_words") else X.mask_label_words(F.col(p.get("description_field", "Description")), F.col(p.get("genre_field", "Genre")), p.get("mask_token", "<MASKED>"))),
}
#: Names the same step goes by.
TABLE_ALIASES = {"deduplicate": "remove_duplicates", "explode": "explode_columns", "count": "count_features", "catalog": "catalog_count", "merge": "merge_features", "temporal": "temporal_features", "cyclic": "cyclic_encode", "normalise": "normalise_feature", "mask_genre": "mask_genre_words"}


def _fold(d: DataFrame, columns, f) -> DataFrame:
    for c in columns:
        d = f(d, c)
    return d


@stage("cleanup", "preprocessing", "preprocess")
def _cleanup(flow: Flow, p: dict) -> None:
    """Table steps one after the other; text steps (with ``field`` or ``columns``, or on the stage's ``text_field``) as one projection each run."""
    steps = [dict(name=x) if isinstance(x, str) else dict(x) for x in p.get("steps") or p.get("cleanup_steps") or p.get("preprocessors") or []]
    if any("applies_to" in x for x in steps) or p.get("data_preprocessors"):
        # table steps first, then those for both, then text steps, then those for both again on the text field
        to = lambda x: x.get("applies_to", "text").lower() if x.get("applies_to", "text").lower() in ("text", "data", "both") else "text"
        data = [x for x in steps if to(x) == "data"] + [dict(x) for x in p.get("data_preprocessors") or []]
        both, text = ([x for x in steps if to(x) == kind] for kind in ("both", "text"))
        on_table = [x for x in both if TABLE_ALIASES.get(x["name"], x["name"]) in TABLE_STEPS]
        steps = data + on_table + text + [x for x in both if x["name"] in X.REGISTRY]
    for step in steps:
        name, params = step["name"], dict(step.get("params") or {})
        name = TABLE_ALIASES.get(name, name)
        if name in ("log_transform", "log"):
            flow.fit(features.LogTransform(**params))
        elif name in TABLE_STEPS:
            flow.map(lambda d, n=name, q=params: TABLE_STEPS[n](d, q))
        elif name in X.REGISTRY:
            columns = params.pop("columns", None) or [params.pop("field", None) or p["text_field"]]
            params.pop("field", None)
            flow.map(lambda d, n=name, q=params, cs=columns: d.withColumns({c: X.REGISTRY[n](F.col(c), **q) for c in cs if c in d.columns}))
        else:
            raise KeyError(f"unknown preprocessor {name!r}")


# fixed values: identifiers, names and what success is computed from, none of which a model of success may see
LEAKAGE = ("Id", "AppId", "Name", "Total_Reviews", "Total_Positive", "Total_Negative")


@stage("filter")
def _filter(flow: Flow, p: dict) -> None:
    for f in p.get("filter_features") or []:
        params = dict(f.get("params") or {})
        if f["name"] in ("drop_columns", "drop_columns_filter"):
            flow.map(lambda d, q=params: d.drop(*(q.get("columns_to_drop") or q.get("columns"))))
        elif f["name"] == "drop_leakage":
            flow.map(lambda d, q=params: d.drop(*(q.get("columns") or LEAKAGE)))
        elif f["name"] == "filter_rows":
            flow.map(lambda d, q=params: filter_rows(d, **q))
        else:
            raise KeyError(f"unknown filter {f['name']!r}")


@stage("impute", "imputer")
def _impute(flow: Flow, p: dict) -> None:
    for i in p.get("imputers") or [{"name": "simple", "params": p}]:
        flow.fit(IMPUTERS.create(i.get("name", "simple"), **(i.get("params") or {})))


@stage("scale", "scaler")
def _scale(flow: Flow, p: dict) -> None:
    s = p.get("scaler") or p
    flow.fit(SCALERS.create(s.get("name", "standard"), columns=s.get("columns")))


@stage("encode", "encoder")
def _encode(flow: Flow, p: dict) -> None:
    for e in p["encoders"]:
        for c in e["columns"]:
            flow.fit(ENCODERS.create(e["name"], column=c, **(e.get("params") or {})))


@stage("split")
def _split(flow: Flow, p: dict) -> None:
    how = features.exact_split if p.get("exact") else features.threshold_split
    both = how(flow.data, p["key"], p.get("test_size", 0.2), p.get("random_state", 42))
    flow.data, flow.test = both.where("split = 'train'").drop("split"), both.where("split = 'test'").drop("split")


@stage("target")
def _target(flow: Flow, p: dict) -> None:
    flow.fit(features.LabelEncoder(p["target_column"], p.get("output", "label")))


@stage("eda", "profile")
def _profile(flow: Flow, p: dict) -> None:
    for s in p.get("steps") or []:
        got = PROFILES.create(s["name"], df=flow.data, **{k: v for k, v in (s.get("params") or {}).items() if k != "filename_prefix"})
        name = (s.get("params") or {}).get("filename_prefix") or s["name"]
        flow.results[name] = got
        if p.get("save_path"):
            sinks.write_csv(got, f"{p['save_path']}/{name}")


@stage("visualise", "charts")
def _charts(flow: Flow, p: dict) -> None:
    """The data of the charts asked for, as results and, with ``save_path``, as CSV."""
    for c in p.get("charts") or []:
        got = CHARTS.create(c["name"], df=flow.data, **(c.get("params") or {}))
        flow.results[c.get("as") or c["name"]] = got
        if p.get("save_path"):
            sinks.write_csv(got, f"{p['save_path']}/{c.get('as') or c['name']}")


@stage("vectorize", "reduce")
def _learned_columns(flow: Flow, p: dict) -> None:
    registry = VECTORIZERS if p["name"] in VECTORIZERS.made else REDUCERS
    flow.fit(registry.create(p["name"], **(p.get("params") or {})))


@stage("sample")
def _sample(flow: Flow, p: dict) -> None:
    flow.data = SAMPLERS.create(p["name"], **(p.get("params") or {})).resample(flow.data)


@stage("lookup")
def _lookup(flow: Flow, p: dict) -> None:
    right = flow.catalog.read(p["table"])
    flow.map(lambda d: joins.lookup_overwrite(d, right, p["key"], p.get("version")))


def _prepared(p: dict, train: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectorise, reduce, sample and weigh: whatever learns does so on the training rows, and only those are sampled."""
    column = p.get("features", "features")
    v = p.get("vectorizer")
    if v:
        how = dict(v.get("params") or {})
        if v["name"] == "tfidf":
            fitted = features.TfIdf(**({"max_features": 512} | how)).fit(train)
            train, held = (fitted.state["dense"](d, column) for d in (train, held))
        else:
            fitted = VECTORIZERS.create(v["name"], **how, output=column).fit(train)
            train, held = fitted.transform(train), fitted.transform(held)
    for r in p.get("reducers") or ([p["reducer"]] if p.get("reducer") else []):
        fitted = REDUCERS.create(r["name"], column=column, output=column, **(r.get("params") or {})).fit(train)
        train, held = fitted.transform(train), fitted.transform(held)
    if p.get("sampler"):
        train = SAMPLERS.create(p["sampler"]["name"], **(p["sampler"].get("params") or {})).resample(train)
    if p.get("class_weights"):
        train = features.class_weights(train, p.get("label", "label"))
    if any(p.get(x) for x in ("vectorizer", "reducer", "reducers", "sampler", "class_weights")):
        # fits and evaluations pass over these rows many times: they are made once
        train, held = written(train, "prepared"), written(held, "prepared")
    return train, held


def _model(p: dict):
    weight = {"weight": "weight"} if p.get("class_weights") else {}
    return MODELS.create(p["model"], **(p.get("model_params") or {}), features=p.get("features", "features"), label=p.get("label", "label"), **weight)


@EXPERIMENTS.register("classification")
def classification_experiment(train: DataFrame, test: DataFrame, p: dict) -> dict[str, Any]:
    """Cross-validation, a final model, and its evaluation on the test rows.

    Inside every fold all that learns (vectoriser, reducer, sampler, weights, model) is fitted on the fold's training rows.
    ``cv``: {key, folds, stratified}. Results: ``folds`` and their means and deviations (``cv``), ``predictions``, ``metrics``,
    ``confusion``, ``model``.
    """
    label, out = p.get("label", "label"), {}
    cv = p.get("cv")
    if cv:
        folds = cv.get("folds", 5)
        df = written(features.kfold(train, cv["key"], folds, label if cv.get("stratified", True) else None), "cv-folds")
        parts = []
        for k in range(folds):
            fit, held = _prepared(p, df.where(F.col("fold") != k).drop("fold"), df.where(F.col("fold") == k).drop("fold"))
            parts.append(ml.classification_metrics(_model(p).fit(fit).transform(held), label, "prediction").withColumn("fold", F.lit(k)))
        out["folds"] = written(rowset.union_pages(parts), "cv-metrics")
        names = ("accuracy", "precision", "recall", "f1")
        out["cv"] = out["folds"].agg(*(F.avg(m).alias(f"mean_{m}") for m in names), *(F.stddev_pop(m).alias(f"std_{m}") for m in names))
    fit, held = _prepared(p, train, test)
    fitted = _model(p).fit(fit)
    predicted = fitted.transform(held)
    out |= {"predictions": predicted, "metrics": EVALUATORS.create("classification", df=predicted, truth=label, predicted="prediction"), "confusion": profile.confusion(predicted, label, "prediction"), "model": fitted}
    if p.get("save_model"):
        sinks.save_model(fitted, p["save_model"])
    return out


@EXPERIMENTS.register("clustering")
def clustering_experiment(train: DataFrame, test: DataFrame, p: dict) -> dict[str, Any]:
    """Fit a clusterer on the training rows, label the test rows, evaluate both labellings."""
    fit, held = _prepared(p, train, test)
    fitted = MODELS.create(p["model"], **(p.get("model_params") or {}), features=p.get("features", "features"), output="cluster").fit(fit)
    out = {"model": fitted, "predictions": fitted.transform(held)}
    out["quality"] = EVALUATORS.create("clustering_quality", df=out["predictions"], vector=p.get("features", "features"))
    return out


@stage("experiment")
def _experiment(flow: Flow, p: dict) -> None:
    """Run a registered experiment (``kind``, classification by default); ``results[name]`` holds what it gives."""
    out = EXPERIMENTS.create(p.get("kind", "classification"), train=flow.data, test=flow.test if flow.test is not None else flow.data, p=p)
    name = p.get("name", p["model"])
    flow.results[name] = out
    metrics = out["metrics"].first().asDict() if p.get("runs") or p.get("save_path") else {}
    if p.get("runs"):
        sinks.Runs(flow.spark, p["runs"]).log(p.get("run_id", p["model"]), name, p.get("model_params") or {}, metrics)
    if p.get("save_path"):
        sinks.write_result(f"{p['save_path']}/{name}.json", name, p.get("model_params") or {}, metrics)


@stage("cross_validate")
def _cross_validate(flow: Flow, p: dict) -> None:
    cv = {"key": p["key"], "folds": p.get("folds", 5), "stratified": p.get("stratified", True)}
    flow.results[p.get("name", "cross_validation")] = classification_experiment(flow.data, flow.data, p | {"cv": cv})["folds"]


@stage("cluster", "clustering")
def _cluster(flow: Flow, p: dict) -> None:
    """Vectorise, reduce, cluster, lay out, evaluate, keywords, save; every step but the clustering is optional.

    ``vectorizer``, ``reducers``, ``evaluators`` (each {name, params}), ``keywords`` ({key, text, n}), ``layout`` (dimensions),
    ``profile`` (number columns), ``save_path``, ``output_csv``. Columns of identifiers and of what success is computed from
    are left out when the features are made from number columns.
    """
    column, name = p.get("features", "features"), p.get("name", "clusters")
    df = flow.data
    if not p.get("vectorizer") and column not in df.columns:
        numbers = [c for c in features.numeric_columns(df) if c not in LEAKAGE]
        df = df.withColumn(column, F.array(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in numbers)))
    df, _ = _prepared({k: v for k, v in p.items() if k in ("vectorizer", "reducer", "reducers", "features")}, df, df)
    # labels are read by every step below: they are computed once
    fitted = MODELS.create(p.get("model", "kmeans"), **(p.get("model_params") or {}), features=column, output="cluster").fit(df)
    labelled = written(fitted.transform(df), "clusters")
    flow.results[name] = fitted
    if p.get("layout"):
        layout = REDUCERS.create("umap", column=column, n_components=int(p["layout"]), output="umap").fit(labelled).transform(labelled)
        flow.results[f"{name}_plot"] = charts.cluster_plot(layout, "umap", dimensions=int(p["layout"]))
        flow.results[f"{name}_centres"] = profile.cluster_summary(flow.results[f"{name}_plot"], "label", ["x", "y", "z"][: int(p["layout"])])
    for e in p.get("evaluators") or []:
        params = dict(e.get("params") or {}) | ({"metrics": e["metrics"]} if e.get("metrics") and e["name"] != "cluster_profile" else {})
        if e["name"] in ("clustering_quality", "clustering"):
            params = {"vector": column} | params
        flow.results[e.get("as") or e["name"]] = EVALUATORS.create(e["name"], df=labelled, **params)
    if p.get("profile"):
        flow.results["cluster_profile"] = profile.group_profile(labelled, "cluster", p["profile"])
    if p.get("keywords"):
        k = p["keywords"]
        flow.results[f"{name}_keywords"] = top_keywords(labelled, k["key"], k["text"], "cluster", k.get("n", 10))
    flow.data = labelled
    flat = labelled.drop(*(f.name for f in labelled.schema if f.dataType.typeName() in ("array", "struct", "map")))
    if p.get("output_csv"):
        sinks.write_csv(flat, p["output_csv"])
    if p.get("save_path"):
        sinks.write_csv(flat, f"{p['save_path']}/{name}_clustered_data")
        for part in ("plot", "centres", "keywords"):
            if f"{name}_{part}" in flow.results:
                sinks.write_csv(flow.results[f"{name}_{part}"], f"{p['save_path']}/{name}_{part}")


@stage("write")
def _write(flow: Flow, p: dict) -> None:
    if p.get("keys"):
        sinks.append_new(flow.data, p["path"], p["keys"])
    elif p.get("format", "parquet") == "csv":
        sinks.write_csv(flow.data, p["path"])
    else:
        flow.data.write.mode(p.get("mode", "overwrite")).format(p.get("format", "parquet")).save(p["path"])


def top_keywords(df: DataFrame, key: str, text: str, cluster: str, n: int = 10) -> DataFrame:
    """The ``n`` terms of the largest mean weight per cluster, noise left out: ``cluster, term, weight, rank``."""
    w = features.TfIdf(key, text).fit_transform(df).join(df.select(key, cluster).where(F.col(cluster) != -1), key)
    size = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    mean = w.groupBy(cluster, "term").agg(F.sum("weight").alias("s")).join(size, cluster).select(cluster, "term", (F.col("s") / F.col("_n")).alias("weight"))
    return rowset.ranked(mean, [cluster], [F.desc("weight"), F.col("term")]).where(F.col("rank") <= n)


def load(path: str) -> list[dict]:
    """The enabled entries of a YAML file's ``pipelines`` list."""
    with open(path) as f:
        entries = (yaml.safe_load(f) or {}).get("pipelines") or []
    return [e for e in entries if e.get("enabled", True)]


def run(entries: list[dict], spark: SparkSession, catalog: Catalog | None = None, data: DataFrame | None = None) -> Flow:
    """Run entries ``{stage, params, on_error}`` in order. Settings may stand beside ``params`` as well as in it."""
    flow = Flow(spark, catalog, data)
    for e in entries:
        name = e.get("stage") or e.get("type") or e.get("name")
        if name not in STAGES:
            raise KeyError(f"unknown stage {name!r}; known: {', '.join(sorted(STAGES))}")
        own = {"stage", "type", "params", "enabled", "on_error", "max_retries"} | (set() if e.get("stage") or e.get("type") else {"name"})
        params = {k: v for k, v in e.items() if k not in own} | (e.get("params") or {})
        before = (flow.data, flow.test)
        for left in range(int(e.get("max_retries", 0)), -1, -1):
            try:
                STAGES[name](flow, params)
                break
            except Exception:
                flow.data, flow.test = before
                if not left and e.get("on_error") != "skip":
                    raise
                log.exception("stage %s %s", name, "is tried again" if left else "skipped")
    return flow
