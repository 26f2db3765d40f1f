"""Operators on small tables with known results."""

import math
import resource
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.functions import text as X
from weftline.functions.predicates import filter_rows, filter_spec, order_spec, prefilter_rows
from weftline.operators import features as L
from weftline.operators import joins, ml, profile, rowset
from weftline.operators.base import MODELS


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def out(spark, values, build, ddl="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).select(build(F.col("v"))).collect()]


# -- filters ----------------------------------------------------------------------------------------------------------


def test_row_filter_is_two_valued(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 10), (2, "2025-12-31", 20), (3, "2026-01-01", 30), (4, None, 40)], "id int, day string, score int")
    assert ids(filter_rows(df, "day", "2025-12-31", "gt", include=False)) == [1, 2, 4]
    assert ids(filter_rows(df, "day", [None])) == [4]
    assert ids(filter_rows(df, "score", 25, "gte")) == [3, 4]
    assert ids(filter_rows(df, "day", "x", "no such operator")) == []
    assert ids(filter_rows(df, "absent", 1)) == [1, 2, 3, 4]
    assert ids(filter_rows(df, "day", ["2024-01-01"], "not_in")) == [2, 3, 4]


def test_comparisons_refuse_nan_and_read_text(spark):
    df = spark.createDataFrame([(1, 5.0, "5"), (2, float("nan"), "nan"), (3, None, "x"), (4, 9.0, "10")], "id int, x double, t string")
    assert ids(filter_rows(df, "x", 6, "gt")) == [4] and ids(filter_rows(df, "x", 6, "gt", include=False)) == [1, 2, 3] and ids(filter_rows(df, "x", 6, "lt")) == [1]
    assert ids(filter_rows(df, "t", 6, "gt")) == [4] and ids(filter_rows(df, "t", "9", "lte")) == [1]


def test_prefilter(spark):
    df = spark.createDataFrame([(1, " Action "), (2, "rpg"), (3, None)], "id int, g string")
    assert ids(prefilter_rows(df, "g", "action")) == [2, 3]
    assert ids(prefilter_rows(df, "g", [None], negate=True)) == [3]
    assert ids(prefilter_rows(df, "g", ["^R"], "regex", negate=True)) == [2]
    with pytest.raises(ValueError):
        prefilter_rows(df, "g", "x", "like")


def test_specs(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    assert len(filter_spec({"id": {"from": 1, "to": 2, "in": [1]}})) == 3
    assert ids(df.where(filter_spec(["ok"])[0])) == [1]
    with pytest.raises(ValueError):
        order_spec(df, {"column": "nope"})
    with pytest.raises(ValueError):
        order_spec(df, {"column": "id", "direction": "up"})


# -- text -------------------------------------------------------------------------------------------------------------


def test_cleaning_fixtures(spark):
    urls = ["Check this out: http://a.b/c", "No urls here, just text.", "WWW.x.y", None]
    assert out(spark, urls, X.remove_urls) == ["Check this out: ", "No urls here, just text.", "", None]
    assert out(spark, ["English<strong>*</strong><br>French", None], X.remove_html_tags) == ["English*, French", None]
    noisy = lambda c: X.remove_whitespace(X.remove_punctuation_noise(X.remove_repeated_characters(c)))
    assert out(spark, ["Sooocl!! Visit", "a   b"], noisy) == ["Scl! Visit", "ab"]
    assert out(spark, ["The cat, and DOGS!"], X.remove_stopwords) == ["cat dogs"]
    assert out(spark, ["hi \U0001f600 there☀"], X.remove_emoji) == ["hi  there"]
    assert out(spark, ["ThisIsAVeryLongLabelOne", "Short"], X.truncate_label) == ["ThisIsA...", "Short"]
    assert out(spark, [True, False, None], X.python_bool, "v boolean") == ["True", "False", "None"]
    with pytest.raises(KeyError):
        X.chain(F.col("v"), ["nope"])


def test_masking(spark):
    df = spark.createDataFrame([("Action, Shooter", "An action packed shooters game"), (None, "An action game"), ("RPG & c++", "rpgs in c++ (old)")], "g string, d string")
    assert [r[0] for r in df.select(X.mask_label_words(F.col("d"), F.col("g"))).collect()][:2] == ["An <MASKED> packed <MASKED> game", "An action game"]


def test_porter_published_examples():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat sized size hopping hop falling fall happy happi relational relat digitizer digit operator oper feudalism feudal triplicate triplic goodness good revival reviv adjustment adjust adoption adopt probate probat controll control".split()
    assert [X.porter(w) for w in pairs[::2]] == pairs[1::2]


def test_scalars(spark):
    assert out(spark, ["Ritual,Night", None, "", "A, B, C"], S.count_features) == [2, 0, 0, 3]
    got = out(spark, ["21 Aug, 2012", "Aug, 2012", "Coming soon", "x", None], S.parse_release_date)
    assert [g and g.date().isoformat() for g in got] == ["2012-08-21", "2012-08-01", None, None, None]
    df = spark.createDataFrame([(10.0, 2.0), (5.0, 1.0), (0.0, 0.0), (None, 3.0)], "n double, d double")
    ratio = [r[0] for r in df.select(S.ratio(F.col("n"), F.col("d"))).collect()]
    assert ratio[:3] == pytest.approx([2.312772, 2.105776, 0.0], abs=1e-6) and ratio[3] is None
    parts = spark.createDataFrame([("2020-01-15",), ("bad",), (None,)], "v string").select(*(c.alias(n) for n, c in S.temporal_features(F.col("v"), "d", quarter=True).items())).collect()
    assert tuple(parts[0]) == (15, 1, 2020, "Q1") and tuple(parts[1]) == (None,) * 4


# -- rows and joins ---------------------------------------------------------------------------------------------------


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "Action"), (2, "action"), (3, "Puzzle"), (4, None), (5, None)], "id int, g string")
    assert ids(rowset.dedupe(df, "g", "id", case_sensitive=False)) == [1, 3, 4]
    assert ids(rowset.dedupe(df, "g", "id", "last", case_sensitive=False)) == [2, 3, 5]
    assert ids(rowset.dedupe(df, "g", "id", case_sensitive=False, unique_nulls=True)) == [1, 3, 4, 5]


def test_explode(spark):
    df = spark.createDataFrame([(1, "Windows, Mac", "a,b"), (2, None, " , "), (3, "nan", "z")], "id int, p string, q string")
    got = sorted((r.id, r.p, r.q) for r in rowset.explode_columns(df, ["p", "q", "absent"]).collect() if r.id == 1)
    assert got == [(1, "Mac", "a"), (1, "Mac", "b"), (1, "Windows", "a"), (1, "Windows", "b")]
    assert rowset.explode_columns(df, ["p"]).where("p is null").count() == 2


def test_name_resolution(spark):
    df = spark.createDataFrame([(1, 2)], "`Total Reviews` int, other int")
    assert rowset.resolve_columns(df, ["total_reviews"]) == ["Total Reviews"]


def test_lookup_and_upsert(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, x string")
    right = spark.createDataFrame([(1, None, 9, 1), (2, "old", 8, 1), (2, "new", 7, 2)], "k int, x string, y int, at int")
    got = sorted(tuple(r) for r in joins.lookup_overwrite(left, right, "k", "at").collect())
    assert got == [(1, None, 9), (2, "new", 7), (3, "c", None)]
    fresh = joins.new_keys(spark.createDataFrame([(3, "z"), (4, "y"), (4, "y2"), (None, "n")], "k int, x string"), left, ["k"])
    assert ids(fresh, "k") == [4]
    assert sorted(tuple(r) for r in joins.upsert(left, fresh.withColumn("x", F.lit("y")), ["k"]).collect())[-1] == (4, "y")
    assert joins.matching_null_keys(spark.createDataFrame([(None, 1), (1, 2)], "a int, b int"), spark.createDataFrame([(None, 1)], "a int, b int"), ["a", "b"]).count() == 1


def test_members(spark):
    row = '{"member": {"pId": 7, "memberCode": "m", "fullName": "A B", "dateOfDeath": "x", "memberships": [{"membership": {"uri": "u1", "house": {"houseCode": "dail", "houseNo": "33"}, "dateRange": {"start": "2020-02-08", "end": null}, "parties": [{"party": {"partyCode": "P", "showAs": "Party", "dateRange": {"start": "2020-02-08", "end": null}}}], "represents": [{"represent": {"representCode": "R", "showAs": "Place", "representType": "constituency"}}]}}]}}'
    ddl = "member struct<pId:bigint,memberCode:string,firstName:string,fullName:string,showAs:string,gender:string,dateOfDeath:string,memberships:array<struct<membership:struct<uri:string,house:struct<houseCode:string,houseNo:string>,dateRange:struct<start:string,end:string>,parties:array<struct<party:struct<partyCode:string,showAs:string,dateRange:struct<start:string,end:string>>>>,represents:array<struct<represent:struct<representCode:string,showAs:string,representType:string>>>>>>>"
    payload = spark.createDataFrame([(row,), (row,)], "j string").select(F.from_json("j", ddl).alias("j")).select("j.*")
    got = joins.normalise_members(payload)
    assert {k: v.count() for k, v in got.items()} == {"members": 1, "memberships": 1, "parties": 1, "representations": 1}
    assert got["members"].first().pId == "7" and got["memberships"].first().houseNo == 33
    assert got["parties"].first().membership_id == got["memberships"].first().membership_id


# -- learned ----------------------------------------------------------------------------------------------------------


def test_imputer(spark):
    df = spark.createDataFrame([(1, None, 0.0), (1, 0.0, 0.0), (0, 10.0, 9.99), (0, None, None), (0, 5.0, 4.99)], "free int, p double, q double")
    zero = L.SimpleImputer(["p", "q"], "zero", filter_column="free", filter_value=1).fit_transform(df)
    got = L.SimpleImputer(["p", "q"], "mean", filter_column="free", filter_value=0).fit_transform(zero).collect()
    assert [r.p for r in got] == [0, 0, 10, 7.5, 5] and [round(r.q, 2) for r in got] == [0, 0, 9.99, 7.49, 4.99]
    with pytest.raises(ValueError):
        L.SimpleImputer(numeric_strategy="guess")
    with pytest.raises(KeyError):
        L.SimpleImputer(["absent"]).fit(df)


def test_cyclic_and_log(spark):
    df = spark.createDataFrame([(1.0,), (6.0,), (12.0,), (None,)], "m double")
    got = L.CyclicEncode("m", 12).fit_transform(df).collect()
    assert got[0].m_sin == pytest.approx(0.5) and got[1].m_cos == pytest.approx(-1) and got[3].m_sin is None
    logs = L.LogTransform(["p"]).fit_transform(spark.createDataFrame([(0.0,), (10.0,), (-5.0,), (None,)], "p double")).collect()
    assert [r.p and math.exp(r.p) for r in logs][:3] == pytest.approx([7, 17, 2])


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (4.0, 3.0), (10.0, 3.0)], "x double, c double")
    got = L.RobustScaler().fit_transform(df).collect()
    assert [r.x for r in got] == pytest.approx([(v - 3.0) / 3.75 for v in (1, 2, 4, 10)]) and {r.c for r in got} == {0.0}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float), st.floats(-1e9, 1e9, allow_subnormal=False)), min_size=1, max_size=40))
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    mine = L.exact_quantiles(df, ["x"], (0.25, 0.5, 0.9), bins=4)["x"]
    known = [v for v in values if v is not None]
    want = list(np.quantile(known, (0.25, 0.5, 0.9))) if known else [None] * 3
    assert mine == (pytest.approx(want, rel=1e-9, abs=1e-9) if known else want)


def test_encoders(spark):
    pets = spark.createDataFrame([(i, v) for i, v in enumerate(["cat", "dog", "cat", "mouse", None])], "k int, pet string")
    assert L.OneHotEncoder("pet", "k").fit_transform(pets).columns == ["k", "pet__cat", "pet__dog", "pet__mouse"]
    p = spark.createDataFrame([(i, v) for i, v in enumerate(["win, mac", "linux, win", "mac", "linux, mac, win", None])], "k int, platforms string")
    got = L.MultiHotEncoder("platforms", "k").fit_transform(p).orderBy("k")
    assert got.columns[1:] == ["platforms__win", "platforms__mac", "platforms__linux"]
    assert [tuple(r)[1:] for r in got.collect()] == [(1, 1, 0), (1, 0, 1), (0, 1, 0), (1, 1, 1), (0, 0, 0)]
    assert profile.indicator_columns(got) == got.columns[1:]
    o = spark.createDataFrame([(i, v) for i, v in enumerate(["low", "medium", "high", "low", None])], "k int, pr string")
    fitted = L.OrdinalEncoder("pr", "k").fit(o)
    coded = fitted.transform(o).orderBy("k")
    assert [r.pr for r in coded.collect()] == [0, 1, 2, 0, -1]
    assert [r[0] for r in coded.select(fitted.state["inverse"](F.col("pr"))).collect()] == ["low", "medium", "high", "low", None]
    label = L.LabelEncoder("pr", "code").fit(o)
    with pytest.raises(Exception):
        label.transform(o.union(spark.createDataFrame([(9, "new")], o.schema))).collect()


def test_splits_and_samples(spark):
    df = spark.range(200).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    split = L.exact_split(df, "id", 0.2)
    assert split.where("split = 'test'").count() == 40 and split.count() == 200
    folds = {(r.y, r.fold): r["count"] for r in L.kfold(df, "id", 5, "y").groupBy("y", "fold").count().collect()}
    assert set(folds.values()) == {4, 36}
    assert {r["count"] for r in L.UnderSampler("id", "y").resample(df).groupBy("y").count().collect()} == {20}
    assert {r["count"] for r in L.OverSampler("id", "y").resample(df).groupBy("y").count().collect()} == {180}
    w = {r.y: r.weight for r in L.class_weights(df, "y").select("y", "weight").distinct().collect()}
    assert w == pytest.approx({0: 200 / 360, 1: 5.0})


def test_smote_lies_between(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(20)] + [(100 + i, 1, [float(i), 5.0]) for i in range(4)]
    got = ml.Smote("id", "y", "v", k=2).resample(spark.createDataFrame(rows, "id bigint, y int, v array<double>"))
    assert {r["count"] for r in got.groupBy("y").count().collect()} == {20}
    assert all(r.v[1] == 5.0 and 0 <= r.v[0] <= 3 for r in got.where("synthetic").collect())


def _pairs_drawn(spark, small, large, **how):
    """Synthetic rows by the pair of neighbours that they lie between; pair p of the small class is at 100 p and 100 p + 1."""
    rows = [(i, 0, [float(i), 0.0]) for i in range(large)] + [(1000 + i, 1, [100.0 * (i // 2) + i % 2, 5.0]) for i in range(small)]
    got = ml.Smote("id", "y", "v", k=1, **how).resample(spark.createDataFrame(rows, "id bigint, y int, v array<double>")).where("synthetic").collect()
    assert len(got) == large - small
    return Counter(int(r.v[0] // 100) for r in got)


def test_smote_seeds_every_row_of_a_class(spark):
    assert _pairs_drawn(spark, 30, 60, most_seeds=7) == {p: 2 for p in range(15)}


def test_smote_seeds_are_a_sample_where_few_are_missing(spark):
    assert max(_pairs_drawn(spark, 100, 120)) >= 25


def test_smote_query_takes_the_whole_table(spark):
    from weftline.queries import queries

    folder = "/root/testdata/sf0.001"
    sizes = Counter(r.label for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("label").collect())
    got = queries()["smote"](spark, folder).collect()
    assert {r.label: (r.n_real, r.n_synthetic) for r in got} == {c: (n, max(sizes.values()) - n) for c, n in sizes.items()} and all(r.between for r in got)


def test_profiles(spark):
    df = spark.createDataFrame([(1, 3, 1), (2, 2, 1), (3, 1, 2)], "A int, B int, C int")
    r = {(x.a, x.b): x.r for x in profile.pearson(df, ["A", "B", "C"]).collect()}
    assert r[("A", "B")] == pytest.approx(-1) and r[("A", "C")] == pytest.approx(0.8660254)
    h = profile.histogram(spark.createDataFrame([(float(v),) for v in range(10)], "x double"), "x", 5).collect()
    assert sorted(x.n for x in h) == [2] * 5
    assert profile.histogram(spark.createDataFrame([], "x double"), "x").count() == 0
    assert {(x.platforms, x.n) for x in profile.value_counts(spark.createDataFrame([("W",), ("M",), ("W",)], "platforms string"), "platforms").collect()} == {("W", 2), ("M", 1)}


def test_models_and_clusters(spark):
    rows = [(i, [float(i % 2) * 10 + i * 0.01, float(i % 3)], float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label double")
    for name in ("logistic_regression", "linear_svc", "random_forest", "xgboost", "svm"):
        params = {"rounds": 2} if name == "xgboost" else {"dimensions": 64, "gamma": 0.05} if name == "svm" else {}
        got = MODELS.create(name, **params).fit(df).transform(df)
        assert got.where("prediction = label").count() >= 57, name
    km = MODELS.create("kmeans", k=3).fit(df).transform(df)
    assert {r.prediction for r in km.select("prediction").distinct().collect()} <= {0, 1, 2} and km.count() == 60
    agg = ml.agglomerative(df, "id", "features", 2)
    assert len({(r.cluster, r.id % 2) for r in agg.collect()}) == 2
    dense = ml.density_clusters(df, "id", "features", 5)
    assert dense.where("cluster >= 0").select("cluster").distinct().count() >= 2
    with pytest.raises(KeyError):
        MODELS.create("nope")


def test_nearest_block(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0], str(i % 2)) for i in range(50)], "id bigint, v array<double>, y string")
    got = ml.nearest(rows.where("id = 10"), rows, "id", "v", 2)
    assert {r.neighbour for r in got.collect()} == {9, 11}


@pytest.mark.parametrize("exclude_self", [True, False])
@pytest.mark.parametrize("kind", ["normal", "grid", "equal", "far"])
def test_nearest_is_that_of_all_pairs(spark, kind, exclude_self):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(0, 1, (700, 3)), "grid": rng.integers(0, 4, (700, 3)).astype(float), "equal": np.ones((700, 3)), "far": 1e8 + rng.normal(0, 1, (700, 3))}[kind]
    rows = spark.createDataFrame([(i, v.tolist(), None if i % 9 == 0 else str(i % 4)) for i, v in enumerate(x)] + [(1000, None, "n"), (1001, [1.0, float("nan"), 1.0], "n"), (1002, [1.0, None, 1.0], "n")], "id bigint, v array<double>, y string")
    got = ml.nearest(rows.where("id < 400 or id > 999"), rows.repartition(3), "id", "v", 4, "y", exclude_self)
    assert got.columns == ["query", "neighbour", "distance", "y", "rank"]
    found = {(r.query, r["rank"]): (r.neighbour, round(r.distance, 9), r.y) for r in got.collect()}
    want = {}
    for q in range(400):
        d = np.sqrt(((x[q] - x) ** 2).sum(1))
        own = sorted((round(float(d[i]), 9), i) for i in range(700) if i != q or not exclude_self)[:4]
        want |= {(q, j + 1): (i, far, None if i % 9 == 0 else str(i % 4)) for j, (far, i) in enumerate(own)}
    assert found == want


def test_knn_of_many_equal_rows_in_little_memory(spark):
    n = 20_000
    df = spark.range(0, n, 1, 1).select("id", F.expr("array(cast(id % 2 * 4 + id % 7 / 100 as double), cast(id % 7 as double))").alias("features"), F.expr("cast(id % 2 as double)").alias("label"))
    odd = spark.createDataFrame([(-1, None, 1.0), (-2, [float("nan"), 0.0], 1.0)], "id bigint, features array<double>, label double")
    got = MODELS.create("knn").fit(df).transform(df.unionAll(odd))
    assert got.columns == ["id", "features", "label", "prediction"] and dict(got.dtypes)["prediction"] == "double"
    said = got.groupBy(F.expr("id >= 0 and prediction = label").alias("right"), F.expr("id < 0 and prediction is null").alias("none")).count().collect()
    assert {(r.right, r.none): r["count"] for r in said} == {(True, False): n, (False, True): 2}

    def peak(batches):
        for _ in batches:
            pass
        yield pa.record_batch([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024])], ["mb"])

    assert spark.range(0, 8, 1, 8).mapInArrow(peak, "mb bigint").agg(F.max("mb")).first()[0] < 1000


def test_knn_of_different_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ml, "MOST_FOUND", 900)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (500, 2)).tolist()
    df = spark.createDataFrame([(i, v, int(v[0] > 0)) for i, v in enumerate(x)], "id int, features array<double>, label int")
    got = {r.id: r.prediction for r in MODELS.create("knn", k=5).fit(df).transform(df).collect()}
    for i, v in enumerate(np.array(x)):
        own = np.argsort(((v - np.array(x)) ** 2).sum(1), kind="stable")[:5]
        assert got[i] == int(sum(x[j][0] > 0 for j in own) > 2)


@pytest.mark.parametrize("bins, small", [(7, 4), (1024, 200_000)])
def test_grouped_quantiles_by_brackets(spark, bins, small):
    rng = np.random.default_rng(bins)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 97), ("d", 40)) for x in rng.normal(0, 10, n).round(1)] + [("e", 5.0)] * 9 + [("f", None), (None, 1.0), (None, 2.0)] + [("c", float("nan"))]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in L.grouped_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", shares, bins, small).collect()}
    for g in "abcde":
        x = np.array([v for k, v in rows if k == g and v is not None and not np.isnan(v)])
        assert np.allclose(got[g], np.quantile(x, shares)), g
    assert "f" not in got


@pytest.mark.parametrize("linkage", ["ward", "average", "complete", "single"])
def test_hierarchy_by_chains_is_that_of_closest_pairs(linkage):
    rng = np.random.default_rng(7)
    for n, k in ((1, 1), (9, 3), (30, 4)):
        x = rng.normal(0, 1, (n, 2))
        groups = [[i] for i in range(n)]

        def far(a, b):
            d = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2))
            if linkage == "ward":
                return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
            return {"average": d.mean(), "complete": d.max(), "single": d.min()}[linkage]

        while len(groups) > k:
            i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: far(groups[p[0]], groups[p[1]]))
            groups[j] += groups.pop(i)
        got = ml.hierarchy(x, k, linkage)
        assert {frozenset(np.flatnonzero(got == c)) for c in set(got)} == {frozenset(g) for g in groups}


def test_clusterers_of_bounded_tables_take_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(ml, "MOST_LOCAL_ROWS", 50)
    df = spark.createDataFrame([(i, [float(i % 2) * 9 + (i % 7) / 10, 0.0]) for i in range(200)], "id bigint, features array<double>")
    for name, params in (("agglomerative", {}), ("hdbscan", {"min_cluster_size": 2})):
        got = ml.MODELS.create(name, **params).fit(df).transform(df).select("id", "prediction").collect()
        assert len({(r.id % 2, r.prediction) for r in got if r.prediction != -1}) >= 2 and all(len({r.id % 2 for r in got if r.prediction == c}) == 1 for c in {r.prediction for r in got} - {-1}), name
    layout = ml.NeighbourLayout("features", most=40).fit(df).transform(df)
    assert layout.where("umap is null or size(umap) != 2").count() == 0
    labels, prob, persist, outlier = ml.density(np.array([[0.0], [0.1], [0.2], [0.3], [0.4], [5.0], [5.1], [5.2], [5.3], [5.4], [50.0]]), 3)
    assert labels[10] == -1 and outlier[10] == outlier.max() and len(set(labels[:5])) == len(set(labels[5:10])) == 1


def test_unknown_categories_and_repeated_lookups(spark):
    df, other = spark.createDataFrame([(1, "a,b"), (2, "b")], "id int, c string"), spark.createDataFrame([(3, "a,z"), (4, None)], "id int, c string")
    for cls in (L.OneHotEncoder, L.MultiHotEncoder):
        fitted = cls("c", "id", handle_unknown="error").fit(df)
        assert fitted.transform(df).count() == 2
        with pytest.raises(Exception, match="unknown category"):
            fitted.transform(other).collect()
        assert cls("c", "id").fit(df).transform(other).count() == 2
    right = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 3)], "id int, c string, n int")
    assert [tuple(r) for r in joins.lookup_overwrite(df, right, "id").orderBy("id").collect()] == [(1, "y", 2), (2, "b", None)]
    assert [tuple(r) for r in joins.lookup_overwrite(df, right, "id", "n").orderBy("id").collect()] == [(1, "y"), (2, "b")]


def test_stemmers(spark):
    # pairs published with the second stemmer
    words = {"consolingly": "consol", "consistency": "consist", "knackeries": "knackeri", "generously": "generous", "communication": "communic", "dying": "die", "hoping": "hope", "hopping": "hop", "sensibilities": "sensibl", "succeeded": "succeed", "ties": "tie", "cry": "cri", "say": "say", "it's": "it"}
    assert {w: X.snowball(w) for w in words} == words
    row = spark.createDataFrame([("Generously hoping",)], "t string").select(X.stem_text(F.col("t")).alias("s"), X.stem_text(F.col("t"), "porter").alias("p")).first()
    assert row.s == "generous hope" and row.p == "gener hope"
    with pytest.raises(ValueError):
        X.stem_text(F.col("t"), "other")


def test_tfidf_parameters(spark):
    df = spark.createDataFrame([(1, "red red fish"), (2, "the red fish swims"), (3, None)], "id int, t string")
    fitted = L.TfIdf("id", "t", ngram_range=(1, 2), stop_words="english", min_df=2).fit(df)
    assert {r.term for r in fitted.state["idf"].collect()} == {"red", "fish", "red fish"}
    wide = L.TfIdf("id", "t", max_features=2).fit(df)
    got = {r.id: r.features for r in wide.state["dense"](df).collect()}
    assert len(got[1]) == 2 and got[3] == [0.0, 0.0] and abs(sum(v * v for v in got[1]) - 1) < 1e-9
