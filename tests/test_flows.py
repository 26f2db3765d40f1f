"""Sources, sinks, streams, pipelines and the registered queries."""

import json
import re
from datetime import date

import duckdb
import pytest
from pyspark.ml.classification import NaiveBayesModel
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.operators.base import CHARTS, EVALUATORS, MODELS, PROFILES
from weftline.plans import pipeline
from weftline.sources import connectors, records, sinks
from weftline.sources.catalog import Catalog, load_embedding
from weftline.sources.schemas import ENTITIES

SF = "/root/testdata/sf0.001"


def replies(total: int):
    """Recorded replies by page; a closure, so that it travels to the workers by value."""

    def transport(url, params):
        at, limit = int(params.get("skip", 0)), int(params["limit"])
        rows = [{"question": {"uri": f"q{i}"}} for i in range(at, min(at + limit, total))]
        return 200, {"head": {"counts": {"resultCount": total}}, "results": rows}

    return transport


def test_pages_and_windows():
    asked = connectors.requests("oireachtas_questions", {"date_start": "2024-01-15", "date_end": "2024-03-02"}, replies(2500))
    assert [(r.params["date_start"], r.params["date_end"]) for r in asked] == [("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-02")]
    got = list(connectors.pages(connectors.SERVICES["oireachtas_questions"], asked[0], replies(2500)))
    assert len(got) == 2500
    daily = connectors.requests("oireachtas_questions", {"date_start": "2024-01-30", "date_end": "2024-02-01"}, replies(9500))
    assert len(daily) == 3
    assert connectors.months(date(2024, 1, 31), date(2024, 2, 1)) == [(date(2024, 1, 31),) * 2, (date(2024, 2, 1),) * 2]


def test_requests_of_every_connector():
    ask = lambda name, **o: [r.params for r in connectors.requests(name, o, replies(1))]
    assert ask("boards", category_id="5", date_start="2024-01-01", date_end="2024-01-02") == [{"CategoryID": "5", "dateLastComment": f"2024-01-0{i}"} for i in (1, 2)]
    assert ask("boards_comments", ids="7,8", date_start="2024-01-01") == [{"discussionid": i, "dateInserted": "[2024-01-01,2024-01-01]"} for i in "78"]
    assert ask("oireachtas_debates", date_start="2024-01-01", date_end="2024-01-01") == [{"date": "2024-01-01"}]
    assert ask("oireachtas_members", chamber="dail", date_start="2024-01-01", date_end="2024-02-01") == [{"chamber": "dail", "date_start": "2024-01-01", "date_end": "2024-02-01"}]
    assert ask("steam_current_user", ids="1,2") == [{"appid": "1"}, {"appid": "2"}]
    none = connectors._Reader("steam_current_user", {"ids": "3"}, lambda url, params: (404, None))
    assert [json.loads(v) for p in none.partitions() for (v,) in none.read(p)] == [{"AppID": 3}]


def test_fetch_retries():
    calls, waits = [], []

    def flaky(url, params):
        calls.append(url)
        return (429, None) if len(calls) == 1 else (503, None) if len(calls) == 2 else (200, {"ok": 1})

    assert connectors.fetch(flaky, "u", {}, sleep=waits.append) == {"ok": 1} and waits == [10.0, 2.0]
    assert connectors.fetch(lambda u, p: (404, None), "u", {}, sleep=waits.append) is None


def test_what_is_not_read_raises():
    service = connectors.SERVICES["oireachtas_questions"]
    read = lambda transport: list(connectors.pages(service, connectors.Request({}, "u", {}), transport, sleep=lambda s: None))

    def broken(status, total=2500):
        return lambda url, params: (status, None) if params["skip"] >= 2000 else replies(total)(url, params)

    for transport in (broken(503), broken(404), replies(30_000)):
        with pytest.raises(connectors.Incomplete):
            read(transport)
    # an outage at once is no empty answer, a plain refusal is
    with pytest.raises(connectors.Incomplete):
        connectors.fetch(lambda u, p: (503, None), "u", {}, sleep=lambda s: None)
    assert read(lambda url, params: (404, None)) == [] and read(replies(0)) == [] and len(read(broken(503, 2000))) == 2000


def test_rate_limit():
    now, slept = [0.0], []
    limiter = connectors.Limiter(2, 10.0, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        limiter.wait()
    assert slept == [10.0]


def test_connector_reads_in_partitions(spark):
    df = connectors.load(spark, "oireachtas_questions", replies(1500), date_start="2024-01-01", date_end="2024-02-10")
    assert df.count() == 3000
    with pytest.raises(KeyError):
        connectors.source("nope")


def test_records(spark):
    xml = '<a xmlns="urn:x"><speech by="#Min"><recordedTime time="2024-01-01T10:00:00"/><p> one <b>two</b></p><p/><p>three</p></speech><speech><p>no</p></speech></a>'
    got = {r.k: (r.speaker, r.recorded, r.answer) for r in records.parse_answers(spark.createDataFrame([(1, xml), (2, "<a/>"), (3, "broken <"), (4, None)], "k int, x string"), "k", "x").collect()}
    assert got == {1: ("Min", "2024-01-01T10:00:00", "one two\nthree"), 2: (None,) * 3, 3: (None,) * 3, 4: (None,) * 3}
    game = {"steam_appid": 5, "name": "G", "is_free": True, "developers": ["a", "b"], "platforms": {"windows": True, "mac": False}, "genres": [{"description": "Action"}], "release_date": {"date": "21 Aug, 2012"}}
    ddl = "data struct<steam_appid:bigint,name:string,type:string,is_free:boolean,developers:array<string>,publishers:array<string>,platforms:map<string,boolean>,categories:array<struct<description:string>>,genres:array<struct<description:string>>,supported_languages:string,price_overview:struct<currency:string,initial:bigint,final:bigint,discount_percent:bigint>,recommendations:struct<total:bigint>,metacritic:struct<score:bigint,url:string>,release_date:struct<date:string>,content_descriptors:struct<ids:array<int>>>"
    row = spark.createDataFrame([(json.dumps({"data": game}),)], "j string").select(F.from_json("j", ddl).alias("j")).select("j.*").select(*records.game_row()).first()
    assert (row.AppID, row.Is_Free, row.Developers, row.Platforms, row.Genres, row.Release_Date.year, row.Price_Final) == (5, "True", "a,b", "windows", "Action", 2012, None)


def test_debates(spark):
    row = {"debateRecord": {"date": "2024-01-01", "debateSections": [{"debateSection": {"debateSectionId": "s", "showAs": "t", "contributions": [{"text": "a", "speaker": {"showAs": "n", "uri": "u", "role": "r"}, "contributionType": "speech"}, {"text": None, "speaker": None, "contributionType": None}]}}, {"debateSection": {"debateSectionId": None, "showAs": "x", "contributions": None}}]}}
    ddl = "debateRecord struct<date:string,debateSections:array<struct<debateSection:struct<debateSectionId:string,showAs:string,contributions:array<struct<text:string,speaker:struct<showAs:string,uri:string,role:string>,contributionType:string>>>>>>"
    df = spark.createDataFrame([(json.dumps(row),)], "j string").select(F.from_json("j", ddl).alias("j")).select("j.*")
    sections, contributions = records.debate_rows(df)
    assert sections.count() == 1 and [(r.ContributionText, r.Sequence) for r in contributions.collect()] == [("a", 1)]


def test_sinks_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "k int, v string")
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.append_new(df, path, ["k"])
    assert spark.read.parquet(path).count() == 2
    sinks.upsert_to(spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), path, str(tmp_path / "stage"), ["k"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "B"), (3, "c")}
    runs = sinks.Runs(spark, str(tmp_path / "runs"))
    runs.log("r1", "one", {"a": 1}, {"f1": 0.5})
    runs.log("r2", "two", {}, {})
    assert runs.last(1).first().run_id == "r2" and [r.run_id for r in runs.broken().collect()] == ["r2"]
    assert {r.name for r in runs.renamed({"r1": "new"}).collect()} == {"new", "two"}


def test_catalog(spark):
    c = Catalog(spark, SF)
    assert c.scan("SteamGame", sample=5).count() == 5 and c.fetch_by_id("SteamGame", 1).count() == 1
    assert c.scan("SteamGame", order_by={"column": "Id", "direction": "desc"}, sample=1).first().Id == c.scan("SteamGame").agg(F.max("Id")).first()[0]
    with pytest.raises(ValueError):
        c.scan("Nope")
    for model, e in ENTITIES.items():
        if model in ("BoardsComment", "BoardsDiscussion", "OireachtasQuestion", "OireachtasDebateSection", "OireachtasMember", "OireachtasMemberMembership", "SteamGame"):
            have = dict(c.scan(model).dtypes)
            assert [(f.name, f.dataType.simpleString()) for f in e.schema] == list(have.items()), model
    assert load_embedding(spark.createDataFrame([(1.0, 2.0, 3, "m")], "x double, y double, label int, note string")) == {"coordinates": ["x", "y"], "labels": ["label"], "metadata": ["note"]}


def test_pipeline_yaml(spark, tmp_path):
    config = tmp_path / "p.yaml"
    config.write_text("""
pipelines:
  - {stage: extract, params: {model: SteamGame, filters: {Type: game}}}
  - {stage: cleanup, params: {cleanup_steps: [{name: remove_html_tags, params: {columns: [Supported_Languages]}}, {name: count_features, params: {columns: [Genres]}}, {name: log_transform, params: {columns: [Total_Reviews]}}]}}
  - {stage: filter, filter_features: [{name: drop_columns, params: {columns_to_drop: [URL]}}]}
  - {stage: impute, params: {imputers: [{name: simple, params: {columns: [Metacritic_Score], numeric_strategy: mean}}]}}
  - {stage: scale, params: {scaler: {name: standard, columns: [Metacritic_Score]}}}
  - {stage: split, params: {key: Id, exact: true}}
  - {stage: nothing, enabled: false}
  - {stage: filter, on_error: skip, filter_features: [{name: nope}]}
""")
    flow = pipeline.run(pipeline.load(str(config)), spark, Catalog(spark, SF))
    whole = Catalog(spark, SF).scan("SteamGame", {"Type": "game"}).count()
    assert flow.data.count() + flow.test.count() == whole and "URL" not in flow.data.columns and "num_Genres" in flow.test.columns
    with pytest.raises(KeyError):
        pipeline.run([{"stage": "nope"}], spark)


def test_ingest_stage_is_idempotent(spark, tmp_path):
    entry_ = {"stage": "ingest", "params": {"connector": "oireachtas_questions", "transport": replies(30), "folder": str(tmp_path), "options": {"date_start": "2024-01-01", "date_end": "2024-01-20"}}}
    for _ in range(2):
        pipeline.run([entry_], spark)
    assert spark.read.parquet(str(tmp_path / "oireachtas_questions.parquet")).count() == 30


def test_every_record_kind_has_rows(spark):
    samples = {
        "oireachtas_parties": {"party": {"showAs": "P", "partyCode": "p", "house": {"houseCode": "dail", "houseNo": "33"}}}, "boards": {"discussionID": "5", "name": "t", "body": "b", "closed": True, "dateInserted": "2024-01-01T10:00:00"},
        "boards_comments": {"commentID": 1, "discussionID": 5, "body": "x", "dateInserted": "2024-01-01T10:00:00"}, "steam_store": {"steam_appid": 7, "name": "G"}, "oireachtas_members": {"member": {"pId": "P1", "fullName": "A B", "memberships": []}},
        "oireachtas_debates": {"debateRecord": {"date": "2024-01-01", "debateSections": [{"debateSection": {"debateSectionId": "s", "contributions": []}}]}},
        "steam_review": {"AppID": 7, "total_reviews": 3, "review_score": 8}, "steam_current_user": {"AppID": 7, "player_count": 5}, "steam_app_list": {"appid": 7, "name": "G", "last_modified": 1},
    }
    assert set(samples) | {"oireachtas_questions"} == set(connectors.SERVICES)
    for name, sample in samples.items():
        got = records.rows_of(spark.createDataFrame([(json.dumps(sample),)], "value string"), name)
        first, keys = next(iter(got.values()))
        assert first.count() == 1 and all(first.first()[k] is not None for k in keys), name
    with pytest.raises(KeyError):
        records.rows_of(spark.createDataFrame([("{}",)], "value string"), "nope")


def test_experiment(spark):
    rows = [(i, [float(i % 2), 1.0], float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label double")
    flow = pipeline.run([{"stage": "split", "params": {"key": "id", "exact": True}}, {"stage": "experiment", "params": {"model": "logistic_regression", "name": "e", "class_weights": True}}, {"stage": "cluster", "params": {"model": "kmeans", "model_params": {"k": 2}}}], spark, data=df)
    assert flow.results["e"]["metrics"].first().accuracy == 1.0 and "cluster" in flow.data.columns


def game_replies():
    """Recorded replies of the three services that a game's row is made from; a closure, as above."""

    def transport(url, params):
        if "appdetails" in url:
            return 200, {params["appids"]: {"success": True, "data": {"steam_appid": int(params["appids"]), "name": "G" + params["appids"]}}}
        if "appreviews" in url:
            return 200, {"query_summary": {"total_reviews": 30, "total_positive": 20, "total_negative": 10, "review_score": 7, "review_score_desc": "Good"}}
        return (200, {"response": {"player_count": 5}}) if params["appid"] == "1" else (404, None)

    return transport


def test_games_are_stored_with_reviews_and_players(spark, tmp_path):
    pipeline.run([{"stage": "ingest", "params": {"connector": "steam_store", "transport": game_replies(), "lookups": True, "folder": str(tmp_path), "options": {"ids": "1,2"}}}], spark)
    got = {r.AppID: r for r in spark.read.parquet(str(tmp_path / "steam_games.parquet")).collect()}
    assert {(i, r.Name, r.Total_Reviews, r.Review_Score_Desc, r.Current_Players) for i, r in got.items()} == {(1, "G1", 30, "Good", 5), (2, "G2", 30, "Good", None)}


def test_answers_are_fetched_once_for_each_address(spark):
    def transport(url, params):
        return (404, None) if url.endswith("gone") else (200, f'<a><speech by="#{url[-1]}"><recordedTime time="2024-01-01T10:00:00"/><p>said</p></speech></a>')

    rows = [("q1", "http://x/1"), ("q2", "http://x/1"), ("q3", "http://x/gone"), ("q4", None)]
    got = {r.QuestionURI: (r.AnswerText, r.AnswerSpeaker, r.AnswerRecordedTime and r.AnswerRecordedTime.hour) for r in records.with_answers(spark.createDataFrame(rows, "QuestionURI string, AnswerXMLURI string"), transport).collect()}
    assert got == {"q1": ("said", "1", 10), "q2": ("said", "1", 10), "q3": (None,) * 3, "q4": (None,) * 3}


def test_the_rate_holds_over_all_partitions():
    reader = connectors._Reader("steam_store", {"ids": ",".join(map(str, range(10))), "parallel": "3"}, game_replies())
    parts = reader.partitions()
    assert [len(p.requests) for p in parts] == [4, 3, 3] and all(p.parts == 3 for p in parts)
    assert connectors.share_of(200, 300.0, 3) == (66, 300.0) and connectors.share_of(2, 10.0, 4) == (1, 20.0)
    assert sorted(json.loads(v)["AppID"] for p in parts for (v,) in reader.read(p)) == list(range(10))


def test_tables_are_made_and_replaced_whole(spark, tmp_path):
    assert "steam_games" in Catalog.create_tables(spark, str(tmp_path)) and Catalog.create_tables(spark, str(tmp_path)) == []
    assert spark.read.parquet(str(tmp_path / "boards_comments.parquet")).count() == 0
    path, stage = str(tmp_path / "t"), str(tmp_path / "s")
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(path + ".old")
    # a call that stopped between its two moves left the table aside
    sinks.upsert_to(spark.createDataFrame([(2, "b")], "k int, v string"), path, stage, ["k"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "b")} and not sinks.exists(spark, path + ".old")
    row = sinks.json_safe(spark.createDataFrame([(float("nan"), [1, 2], date(2024, 1, 2))], "x double, a array<int>, d date")).first()
    assert tuple(row) == (None, "[1,2]", "2024-01-02")


def test_every_registered_name_works_in_its_stage(spark, tmp_path):
    rows = [(i, [float(i % 2), 1.0 + i % 3], float(i % 2), "ab"[i % 2] + f" word{i % 4}", float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label double, text string, x double").cache()
    text = {"boxplots": {"columns": ["x"]}, "boxplot": {"columns": ["x"]}, "pair_scatter": {"columns": ["x", "label"]}, "scatter": {"columns": ["x", "label"]}, "scatter_plot": {"columns": ["x", "label"]}, "histogram": {"column": "x"}, "value_counts": {"column": "label"}, "class_balance": {"target": "label"}, "wordcloud_by_class": {"text": "text", "by": "label"}}
    plain = {"info", "describe_info", "duplicate_check", "association", "dython_correlation", "correlation_matrix", "dython_correlation_matrix"}
    few = df.select("id", "label", "text", "x")
    for name in PROFILES.made:
        params = {} if name in plain else text.get(name, {"text": "text"})
        flow = pipeline.run([{"stage": "eda", "params": {"steps": [{"name": name, "params": params}]}}], spark, data=few)
        assert flow.results[name].count() >= 0, name
    chart = {"confusion_matrix": {"truth": "label", "predicted": "label"}, "bar_chart": {"column": "text"}, "word_cloud": {"text": "text"}, "cluster_plot": {"vector": "features", "label": "label"}, "histogram": {"column": "x"}, "pair_scatter": {"columns": ["x", "label"]}, "boxplot": {"columns": ["x"]}}
    for name in set(CHARTS.made) - {"metric_lines"}:
        flow = pipeline.run([{"stage": "charts", "charts": [{"name": name, "params": chart.get(name, {"columns": ["x", "text"]})}]}], spark, data=df)
        assert flow.results[name].count() > 0, name
    clusterers = {"kmeans": {"k": 2}, "kmeans_mini": {"k": 2, "steps": 5}, "agglomerative": {}, "hdbscan": {}}
    for name in MODELS.made:
        if name in clusterers:
            flow = pipeline.run([{"stage": "cluster", "model": name, "model_params": clusterers[name], "evaluators": [{"name": "clustering_quality"}]}], spark, data=df)
            assert flow.data.where("cluster is null").count() == 0 and flow.results["clustering_quality"].count() > 0, name
        elif name not in ("linear_regression", "gbt"):
            small = {"linear_svc": {"max_iter": 3}, "svm": {"max_iter": 3, "dimensions": 16}, "xgboost": {"rounds": 1}, "gbt": {"rounds": 1}, "random_forest": {"trees": 3}}
            flow = pipeline.run([{"stage": "experiment", "model": name, "name": "e", "model_params": small.get(name, {})}], spark, data=df)
            assert flow.results["e"]["metrics"].first().accuracy > 0.8, name
    labelled = df.withColumn("cluster", F.col("label").cast("int"))
    assert set(EVALUATORS.create("clustering", df=labelled, key="id", numeric=["x"], k_max=4, metrics=("silhouette_average", "silhouette_per_point", "elbow", "descriptive_stats"))) == {"quality", "silhouettes", "elbow", "numeric_summary"}
    runs = sinks.Runs(spark, str(tmp_path / "r"))
    runs.log("r1", "one", {}, {"f1": 0.5, "other": 1.0})
    assert [tuple(r) for r in CHARTS.create("metric_lines", runs=runs.last(), metrics=runs.metrics(), names=["f1"], offsets={"f1": 0.1}).collect()] == [("one", "f1", 50.1, 49.9, 50.300000000000004)]
    pipeline.run([{"stage": "experiment", "model": "naive_bayes", "save_model": str(tmp_path / "m"), "save_path": str(tmp_path / "res")}], spark, data=df)
    assert NaiveBayesModel.load(str(tmp_path / "m")).numClasses == 2 and (tmp_path / "res" / "naive_bayes.json").exists()


def test_preprocessing_order_and_retries(spark):
    df = spark.createDataFrame([(1, "A <b>x</b>"), (2, None)], "id int, text string")
    steps = [{"name": "lowercase", "applies_to": "text"}, {"name": "count_features", "applies_to": "data", "params": {"columns": ["text"], "sep": " "}}, {"name": "remove_html_tags", "applies_to": "both"}]
    got = pipeline.run([{"stage": "preprocessing", "text_field": "text", "preprocessors": steps}], spark, data=df).data.collect()
    assert [tuple(r) for r in got] == [(1, "a x", 2), (2, "", 0)]
    tried = []

    def fails(flow, p):
        tried.append(1)
        if len(tried) < 3:
            raise OSError("not yet")

    pipeline.STAGES["fails"] = fails
    pipeline.run([{"stage": "fails", "max_retries": 2}], spark, data=df)
    tried.clear()
    with pytest.raises(OSError):
        pipeline.run([{"stage": "fails", "max_retries": 1}], spark, data=df)
    del pipeline.STAGES["fails"]


def test_registered_queries_match_sql(spark):
    """A cheap cross-section of the queries against DuckDB; the whole catalogue runs outside the test suite."""
    con = duckdb.connect()
    names = ["filter_exclude_keeps_null", "explode_tokens", "text_stopwords", "catalog_count_mean", "describe_all", "kfold_stratified", "tfidf_norms", "p3_found", "month_ranges", "silhouette_squared"]
    queries, sql = entry.queries(), entry.oracle_sql()
    for t in {t for n in names for t in re.findall(r"\b(?:FROM|JOIN)\s+\(*\s*([a-z_]+)", sql[n], re.I)} & {p.stem for p in __import__("pathlib").Path(SF).glob("*.parquet")}:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    show = lambda v: "" if v is None else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)
    for n in names:
        df = queries[n](spark, SF)
        got = con.execute(sql[n])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns), n
        mine = sorted(tuple(show(r[c]) for c in sorted(columns)) for r in df.collect())
        theirs = sorted(tuple(show(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall())
        assert mine == theirs, n


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_filters_and_form_no_cross_products(spark):
    q = entry.queries()
    plan = _plan(q["scan_filter_range"](spark, SF))
    assert "GreaterThanOrEqual(o_totalprice" in plan.partition("PushedFilters:")[2] and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    assert "EqualTo(o_orderstatus,F)" in _plan(q["scan_filter_eq"](spark, SF))
    assert "GreaterThan(o_totalprice" in _plan(q["filter_gt_numeric"](spark, SF))
    for name in ("p3_found", "p6_found", "dedupe_first", "lookup_join_overwrite", "anti_join_new_keys", "upsert_merge", "catalog_count_sum", "tfidf_norms", "box_stats", "cramers_v", "kfold_stratified", "class_weights", "nearest_rows", "word_freq_by_class"):
        plan = _plan(q[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    # interval merging shuffles once, and what it shuffles is merged already
    assert _plan(q["p3_found"](spark, SF)).count("Exchange hashpartitioning") == 1
