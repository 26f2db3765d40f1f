"""Imputers, scalers, encoders, vectors, splits, profiles, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import features as L
from weftline.functions.text import STOPWORDS
from weftline.operators import charts, ml, profile  # noqa: F401  (charts registers)
from weftline.operators.base import CHARTS, MODELS
from weftline.queries.register import Queries
from weftline.session import table, written

q = Queries()


def _holes(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr("nullif(c_custkey % 5, 0) * 1.5D").alias("x"), "c_mktsegment", F.expr("nullif(c_name, concat('Customer#', lpad('7', 9, '0')))").alias("t"))


@q("SELECT c_custkey, round(coalesce(x, avg(x) OVER ()), 9) AS x FROM (SELECT c_custkey, CAST(nullif(c_custkey % 5, 0) AS DOUBLE) * 1.5 AS x FROM customer)")
def impute_mean(spark, d):
    return L.SimpleImputer(["x"]).fit_transform(_holes(spark, d)).select("c_custkey", F.round("x", 9).alias("x"))


@q("""
SELECT c_custkey, round(CASE WHEN x IS NULL AND c_mktsegment = 'BUILDING' THEN m ELSE x END, 9) AS x
FROM (SELECT c_custkey, c_mktsegment, x, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN x END) OVER () AS m
      FROM (SELECT c_custkey, c_mktsegment, CAST(nullif(c_custkey % 5, 0) AS DOUBLE) * 1.5 AS x FROM customer))""")
def impute_filtered(spark, d):
    return L.SimpleImputer(["x"], filter_column="c_mktsegment", filter_value="BUILDING").fit_transform(_holes(spark, d)).select("c_custkey", F.round("x", 9).alias("x"))


@q("SELECT c_custkey, coalesce(nullif(c_name, 'Customer#000000007'), 'unknown') AS t FROM customer")
def impute_text(spark, d):
    return L.SimpleImputer(["t"], text_strategy="unknown").fit_transform(_holes(spark, d)).select("c_custkey", "t")


@q("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity FROM lineitem")
def scale_standard(spark, d):
    got = L.StandardScaler(["l_quantity"]).fit_transform(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    return got.withColumn("l_quantity", F.round("l_quantity", 6))


@q("""
SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / (b - a), 6) AS l_extendedprice
FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)""")
def scale_robust(spark, d):
    got = L.RobustScaler(["l_extendedprice"]).fit_transform(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"))
    return got.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@q("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS code FROM events")
def encode_label(spark, d):
    return L.LabelEncoder("event_type", "code").fit_transform(table(spark, d, "events").select("event_id", "event_type")).select("event_id", "code")


_EVENTS = ("click", "error", "purchase", "signup", "view")


@q("SELECT event_id, " + ", ".join(f"CAST(event_type = '{e}' AS INTEGER) AS event_type__{e}" for e in _EVENTS) + " FROM events")
def encode_onehot(spark, d):
    got = L.OneHotEncoder("event_type", "event_id").fit_transform(table(spark, d, "events").select("event_id", "event_type"))
    return got.select("event_id", *(f"event_type__{e}" for e in _EVENTS))


_PLATFORMS = ("windows", "mac", "linux")


@q("SELECT Id, " + ", ".join(f"CAST(coalesce(list_contains(list_transform(string_split(Platforms, ','), lambda x: trim(x)), '{p}'), false) AS INTEGER) AS Platforms__{p}" for p in _PLATFORMS) + " FROM steam_games")
def encode_multihot(spark, d):
    got = L.MultiHotEncoder("Platforms", "Id").fit_transform(table(spark, d, "steam_games").select("Id", "Platforms"))
    return got.select("Id", *(f"Platforms__{p}" for p in _PLATFORMS))


@q("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS o_orderstatus FROM orders")
def encode_ordinal(spark, d):
    return L.OrdinalEncoder("o_orderstatus", categories=["F", "O"], handle_unknown="use_encoded_value").fit_transform(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))


@q("SELECT event_id, event_type AS back FROM events")
def encode_inverse(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type")
    fitted = L.OneHotEncoder("event_type", "event_id").fit(df)
    coded = fitted.transform(df)
    return coded.select("event_id", fitted.state["inverse"](coded).alias("back"))


@q("SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || '42'), c_custkey) <= ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM customer")
def split_train_test(spark, d):
    return L.exact_split(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@q("SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '42'), 1, 8) AS BIGINT) / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders")
def split_hashed(spark, d):
    return L.threshold_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@q("SELECT vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '42'), vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings")
def kfold_stratified(spark, d):
    return L.kfold(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", 5, "label").select("vec_id", "fold")


@q("""
SELECT vec_id, label FROM embeddings
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '42'), vec_id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))""")
def sample_under(spark, d):
    return L.UnderSampler("vec_id", "label").resample(table(spark, d, "embeddings").select("vec_id", "label"))


@q("""
WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '42'), vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
m AS (SELECT max(n) AS m FROM r)
SELECT vec_id, label, CAST(unnest(generate_series(0, CAST(floor((m - r) / n) AS BIGINT))) AS INTEGER) AS copy FROM r, m""")
def sample_over(spark, d):
    return L.OverSampler("vec_id", "label").resample(table(spark, d, "embeddings").select("vec_id", "label"))


@q("SELECT event_id, round((SELECT count(*) FROM events) / ((SELECT count(DISTINCT event_type) FROM events) * CAST(count(*) OVER (PARTITION BY event_type) AS DOUBLE)), 9) AS weight FROM events")
def class_weights(spark, d):
    return L.class_weights(table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", F.round("weight", 9).alias("weight"))


@q("SELECT label, CAST(count(*) AS BIGINT) AS n_real, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) - count(*) AS BIGINT) AS n_synthetic, true AS between FROM embeddings GROUP BY label")
def smote(spark, d):
    """Classes after balancing, and whether every synthetic vector lies within the bounds of its class."""
    e = table(spark, d, "embeddings")
    made = written(ml.Smote("vec_id", "label", "embedding").resample(e), "smote-rows")
    cells = lambda t: t.select("label", "synthetic", F.posexplode("embedding").alias("i", "x"))
    edge = cells(made.where("not synthetic")).groupBy("label", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    inside = cells(made.where("synthetic")).join(edge, ["label", "i"]).groupBy("label").agg(F.bool_and((F.col("x") >= F.col("lo") - 1e-9) & (F.col("x") <= F.col("hi") + 1e-9)).alias("ok"))
    counts = made.groupBy("label").agg(F.count_if(~F.col("synthetic")).alias("n_real"), F.count_if("synthetic").alias("n_synthetic"))
    return counts.join(inside, "label", "left").select("label", "n_real", "n_synthetic", F.coalesce("ok", F.lit(True)).alias("between"))


_TERMS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents WHERE text IS NOT NULL"
_TFIDF = f"""
WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN idf USING (term)),
n AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY doc_id)
"""


@q(_TFIDF + "SELECT doc_id, round(norm, 6) AS norm, CAST(count(*) AS BIGINT) AS n_terms FROM w JOIN n USING (doc_id) GROUP BY ALL")
def tfidf_norms(spark, d):
    docs = table(spark, d, "documents")
    fit = L.TfIdf("doc_id", "text").fit(docs)
    raw = L.terms(docs, "doc_id", "text").join(fit.state["idf"], "term").withColumn("raw", F.col("tf") * F.col("idf"))
    return raw.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("raw") * F.col("raw"))), 6).alias("norm"), F.count(F.lit(1)).alias("n_terms"))


@q(_TFIDF + "SELECT term, round(sum(raw / norm), 6) AS weight FROM w JOIN n USING (doc_id) GROUP BY term ORDER BY weight DESC, term LIMIT 50")
def tfidf_top_terms(spark, d):
    w = L.TfIdf("doc_id", "text").fit_transform(table(spark, d, "documents"))
    return w.groupBy("term").agg(F.round(F.sum("weight"), 6).alias("weight")).orderBy(F.desc("weight"), "term").limit(50)


_GRAMS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in STOPWORDS) + "))"


@q(f"""
WITH words AS (SELECT doc_id, {_GRAMS} AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
kept AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3 ORDER BY sum(tf) DESC, term LIMIT 2000),
w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS raw FROM tf JOIN kept USING (term)),
n AS (SELECT *, sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS norm FROM w)
SELECT term, CAST(count(*) AS BIGINT) AS n_docs, round(sum(raw / norm), 6) AS weight FROM n GROUP BY term""")
def tfidf_ngrams(spark, d):
    """Words and word pairs without stop words, in three rows at least, the 2,000 most frequent."""
    w = L.TfIdf("doc_id", "text", ngram_range=(1, 2), stop_words="english", min_df=3, max_features=2000).fit_transform(table(spark, d, "documents"))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("weight"), 6).alias("weight"))


@q("SELECT vec_id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), m), lambda p: (p[1] - p[2]) ** 2)), 4) AS length2 FROM embeddings, (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i))")
def pca_whole(spark, d):
    """All components: a rotation, so every row keeps its distance from the mean."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    got = L.Principal("embedding", 64).fit_transform(e)
    return got.select("vec_id", F.round(F.aggregate("pca", F.lit(0.0), lambda s, x: s + x * x), 4).alias("length2"))


@q("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 4) AS length2 FROM embeddings")
def truncated_svd_whole(spark, d):
    """All singular vectors, rows not scaled: every row keeps its length."""
    got = L.TruncatedSvd("embedding", 64, normalise=False).fit_transform(table(spark, d, "embeddings").select("vec_id", "embedding"))
    return got.select("vec_id", F.round(F.aggregate("svd", F.lit(0.0), lambda s, x: s + x * x), 4).alias("length2"))


@q()
def word2vec(spark, d):
    return L.WordVectors("text", vector_size=16, epochs=1).fit_transform(table(spark, d, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", "vector")


@q()
def neighbour_layout(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return ml.NeighbourLayout("embedding").fit_transform(e).select("vec_id", "umap")


# -- profiles ---------------------------------------------------------------------------------------------------------

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")


def _one(c: str) -> str:
    return f"SELECT l_returnflag AS cluster, '{c}' AS feature, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 6) AS mean, median({c}) AS median, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max FROM lineitem GROUP BY l_returnflag"


@q(" UNION ALL ".join(map(_one, _NUMBERS)))
def group_profile(spark, d):
    got = profile.group_profile(table(spark, d, "lineitem"), "l_returnflag", _NUMBERS)
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@q(f"UNPIVOT (SELECT cluster, feature, CAST(n AS DOUBLE) AS count, mean, median, std, min, max FROM ({' UNION ALL '.join(map(_one, _NUMBERS))})) ON count, mean, median, std, min, max INTO NAME statistic VALUE value")
def group_profile_long(spark, d):
    return profile.profile_long(group_profile(spark, d))


@q("""
SELECT l_shipmode AS shipflag, n, median, mean, q75, CAST(row_number() OVER (ORDER BY median DESC, l_shipmode) AS BIGINT) AS rank FROM (
  SELECT l_linenumber AS l_shipmode, CAST(count(*) AS BIGINT) AS n, median(l_extendedprice) AS median, round(avg(l_extendedprice), 6) AS mean, quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY l_linenumber)""")
def cluster_ranking(spark, d):
    return profile.ranking(table(spark, d, "lineitem"), "l_linenumber", "l_extendedprice").withColumn("mean", F.round("mean", 6)).withColumnRenamed("l_linenumber", "shipflag")


@q("SELECT CategoryId, round(avg(CAST(Closed = 'True' AS INTEGER)), 9) AS closed, round(avg(CAST(countComments > 5 AS INTEGER)), 9) AS busy FROM boards_discussions GROUP BY CategoryId")
def prevalence(spark, d):
    df = table(spark, d, "boards_discussions").select("CategoryId", (F.col("Closed") == "True").cast("int").alias("closed"), (F.col("countComments") > 5).cast("int").alias("busy"))
    return profile.prevalence(df, "CategoryId", ["closed", "busy"]).select("CategoryId", F.round("closed", 9).alias("closed"), F.round("busy", 9).alias("busy"))


@q("SELECT user_id, " + ", ".join(f'CAST(count(*) FILTER (event_type = \'{e}\') AS BIGINT) AS "{e}"' for e in _EVENTS) + " FROM events GROUP BY user_id")
def pivot_topn(spark, d):
    return profile.crosstab(table(spark, d, "events"), "user_id", "event_type", 10).select("user_id", *_EVENTS)


@q("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "documents"), "lang")


_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars", "origin_key", "fetched_at")
_TYPES = ("bigint", "string", "string", "string", "bigint", "string", "timestamp_ntz")


@q(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS non_null, '{t}' AS dtype FROM documents" for c, t in zip(_COLUMNS, _TYPES)))
def info_nulls(spark, d):
    return profile.info(table(spark, d, "documents"))


@q("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM documents" for c in _COLUMNS) + ") WHERE n_null > 0")
def null_audit(spark, d):
    return profile.null_audit(table(spark, d, "documents"))


@q(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM part" for c in ("p_name", "p_brand", "p_type", "p_size")))
def distinct_counts(spark, d):
    return profile.distinct_counts(table(spark, d, "part"), ["p_name", "p_brand", "p_type", "p_size"])


def _described(c: str, number: bool) -> str:
    x = f"CAST({c} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    return f"""
SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, CAST(count(DISTINCT {c}) AS BIGINT) AS "unique",
  (SELECT CAST({c} AS VARCHAR) FROM part WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) DESC LIMIT 1) AS top,
  (SELECT CAST(count(*) AS BIGINT) FROM part WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq,
  round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, min({x}) AS min, quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75, max({x}) AS max FROM part"""


@q(" UNION ALL ".join(_described(c, n) for c, n in (("p_name", False), ("p_brand", False), ("p_size", True))))
def describe_all(spark, d):
    got = profile.describe_all(table(spark, d, "part").select("p_name", "p_brand", "p_size"))
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@q("""
WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * w, 6) AS low, round(lo + (b + 1) * w, 6) AS high, CAST(count(*) AS BIGINT) AS n
FROM (SELECT least(floor((l_extendedprice - lo) / w), 9) AS b, lo, w FROM lineitem, e) GROUP BY b, lo, w""")
def histogram(spark, d):
    return profile.histogram(table(spark, d, "lineitem"), "l_extendedprice").withColumns({c: F.round(c, 6) for c in ("low", "high")})


@q("""
WITH x AS (SELECT l_returnflag AS grp, l_extendedprice AS x FROM lineitem),
k AS (SELECT grp, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY grp)
SELECT grp, 'l_extendedprice' AS feature, q1, median, q3,
  min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
  CAST(count(*) FILTER (NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_out
FROM x JOIN k USING (grp) GROUP BY grp, q1, median, q3""")
def box_stats(spark, d):
    return profile.box_statistics(table(spark, d, "lineitem"), ["l_extendedprice"], "l_returnflag")


@q("SELECT a, b, round(r, 6) AS r FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)")
def corr_pearson(spark, d):
    return profile.pearson(table(spark, d, "lineitem"), _NUMBERS).withColumn("r", F.round("r", 6))


@q("""
WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM t)
SELECT round(sqrt(greatest(sum(n * n / (na * nb)) - 1, 0) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 6) AS cramers_v FROM m""")
def cramers_v(spark, d):
    return profile.cramers_v(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("cramers_v", 6).alias("cramers_v"))


@q("""
WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY p_brand), o AS (SELECT avg(p_retailprice) AS m, sum((p_retailprice - (SELECT avg(p_retailprice) FROM part)) ** 2) AS ss FROM part)
SELECT round(sqrt(sum(n * (g.m - o.m) ** 2) / any_value(ss)), 5) AS eta FROM g, o""")
def correlation_ratio(spark, d):
    return profile.correlation_ratio(table(spark, d, "part"), "p_brand", "p_retailprice").select(F.round("eta", 5).alias("eta"))


@q("SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) GROUP BY word")
def word_freq_global(spark, d):
    return profile.word_frequencies(table(spark, d, "documents"), "text")


@q("SELECT source, word, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) GROUP BY source, word")
def word_freq_by_class(spark, d):
    return profile.word_frequencies(table(spark, d, "documents"), "text", "source")


def _eta(c: str, v: str) -> str:
    return f"SELECT '{c}' AS a, '{v}' AS b, 'eta' AS measure, round(sqrt(sum(n * (m - (SELECT avg({v}) FROM part)) ** 2) / (SELECT sum(({v} - (SELECT avg({v}) FROM part)) ** 2) FROM part)), 5) AS value FROM (SELECT count(*) AS n, avg({v}) AS m FROM part GROUP BY {c})"


@q(f"""
{_eta('p_brand', 'p_size')} UNION ALL {_eta('p_brand', 'p_retailprice')} UNION ALL {_eta('p_type', 'p_size')} UNION ALL {_eta('p_type', 'p_retailprice')}
UNION ALL SELECT 'p_size', 'p_retailprice', 'pearson', round(corr(p_size, p_retailprice), 5) FROM part
UNION ALL SELECT 'p_brand', 'p_type', 'cramers_v', round(sqrt(greatest(sum(n * n / (na * nb)) - 1, 0) / (least(count(DISTINCT p_brand), count(DISTINCT p_type)) - 1)), 5)
FROM (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS na, sum(n) OVER (PARTITION BY p_type) AS nb FROM (SELECT p_brand, p_type, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY ALL))""")
def association_matrix(spark, d):
    return profile.association(table(spark, d, "part"), ["p_brand", "p_type", "p_size", "p_retailprice"]).withColumn("value", F.round("value", 5))


# -- models -----------------------------------------------------------------------------------------------------------

_NEAR = """
WITH qs AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT qs.vec_id AS query, r.vec_id AS neighbour, r.label, list_distance(CAST(qs.e AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS distance FROM qs, embeddings r WHERE r.vec_id <> qs.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), neighbour) AS rank FROM d QUALIFY rank <= 5)
"""


@q(_NEAR + "SELECT query, neighbour, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM top")
def nearest_rows(spark, d):
    e = table(spark, d, "embeddings")
    return ml.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding").select("query", "neighbour", "rank", F.round("distance", 6).alias("distance"))


@q(_NEAR + "SELECT query, CAST(label AS VARCHAR) AS prediction FROM (SELECT query, label, count(*) AS n FROM top GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, CAST(label AS VARCHAR)) = 1")
def knn_predict(spark, d):
    e = table(spark, d, "embeddings")
    return ml.knn_predict(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "label")


@q("""
WITH d AS (SELECT a.vec_id, a.label, b.label AS other, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS x FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
m AS (SELECT vec_id, label, other, avg(x) AS x FROM d GROUP BY ALL),
s AS (SELECT vec_id, max(x) FILTER (label = other) AS a, min(x) FILTER (label <> other) AS b FROM m GROUP BY vec_id)
SELECT vec_id, round(coalesce((b - a) / greatest(a, b), 0), 5) AS silhouette FROM s""")
def silhouette_queries(spark, d):
    e = table(spark, d, "embeddings")
    return ml.silhouette_of(e.where("vec_id % 20 = 0"), e, "vec_id", "label", "embedding").withColumn("silhouette", F.round("silhouette", 5))


@q("""
WITH d AS (SELECT a.vec_id, a.label, b.label AS other, a.vec_id = b.vec_id AS self, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) ** 2 AS x FROM embeddings a, embeddings b),
m AS (SELECT vec_id, label, other, avg(x) FILTER (NOT self) AS x FROM d GROUP BY ALL),
s AS (SELECT vec_id, max(x) FILTER (label = other) AS a, min(x) FILTER (label <> other) AS b FROM m GROUP BY vec_id)
SELECT vec_id, round(coalesce((b - a) / greatest(a, b), 0), 5) AS silhouette FROM s""")
def silhouette_squared(spark, d):
    return ml.silhouette_squared(table(spark, d, "embeddings"), "vec_id", "label", "embedding").withColumn("silhouette", F.round("silhouette", 5))


@q("SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(embedding[1]), 6) AS x, round(avg(embedding[2]), 6) AS y, count(*) >= 45 AND label <> -1 AS labelled FROM embeddings GROUP BY label")
def cluster_centroids(spark, d):
    e = table(spark, d, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    got = profile.cluster_summary(e, "label", ["x", "y"], least=45)
    return got.withColumns({c: F.round(c, 6) for c in ("x", "y")})


@q(f"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL),
src AS (SELECT doc_id, source, doc_id % 4 = 0 AS test FROM documents WHERE source IS NOT NULL),
l AS (SELECT source, term, tf FROM t JOIN src USING (doc_id) WHERE NOT test),
v AS (SELECT count(DISTINCT term) AS size FROM l),
cls AS (SELECT source, sum(tf) AS total FROM l GROUP BY source),
pri AS (SELECT source, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM src WHERE NOT test)) AS prior FROM src WHERE NOT test GROUP BY source),
c AS (SELECT source, term, sum(tf) AS c FROM l GROUP BY ALL),
words AS (SELECT doc_id, term, tf FROM t JOIN src USING (doc_id) WHERE test AND term IN (SELECT term FROM l)),
grid AS (SELECT s.doc_id, p.source, p.prior, cls.total FROM src s, pri p JOIN cls USING (source) WHERE s.test),
len AS (SELECT doc_id, sum(tf) AS len FROM words GROUP BY doc_id),
gain AS (SELECT w.doc_id, c.source, sum(w.tf * ln((c.c + 1.0) / 1.0)) AS gain FROM words w JOIN c USING (term) GROUP BY ALL)
SELECT doc_id, source AS prediction FROM (
  SELECT grid.doc_id, grid.source, prior + coalesce(len, 0) * ln(1.0 / (total + size)) + coalesce(gain, 0) AS score
  FROM grid LEFT JOIN len USING (doc_id) LEFT JOIN gain USING (doc_id, source), v)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, source) = 1""")
def nb_predict(spark, d):
    docs = table(spark, d, "documents").where("source is not null").select("doc_id", "source", "text")
    terms = L.terms(docs, "doc_id", "text")
    test = F.col("doc_id") % 4 == 0
    return ml.nb_predict(docs.where(~test), docs.where(test), "doc_id", "source", terms.where(~test), terms.where(test))


def _judged(spark, d):
    return table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, "view").otherwise(F.col("event_type")).alias("said"))


_JUDGED = "SELECT event_type AS y, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS p FROM events"


@q(f"""
WITH j AS ({_JUDGED}),
m AS (SELECT y, count(*) AS support, count(*) FILTER (y = p) AS hit FROM j GROUP BY y),
s AS (SELECT p AS y, count(*) AS said FROM j GROUP BY p),
k AS (SELECT y, support, hit, coalesce(hit / CAST(nullif(said, 0) AS DOUBLE), 0) AS pr, hit / CAST(support AS DOUBLE) AS re FROM m LEFT JOIN s USING (y)),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM k)
SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision, round(sum(re * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM f""")
def classification_metrics(spark, d):
    got = ml.classification_metrics(_judged(spark, d), "event_type", "said")
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@q(f"SELECT y AS y_true, p AS y_pred, CAST(count(*) AS BIGINT) AS n FROM ({_JUDGED}) GROUP BY ALL")
def confusion_matrix(spark, d):
    return profile.confusion(_judged(spark, d), "event_type", "said")


@q("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def linreg_coeffs(spark, d):
    df = table(spark, d, "lineitem").select(F.array("l_quantity").alias("features"), F.col("l_extendedprice").alias("label"))
    m = MODELS.create("linear_regression").fit(df).state["model"]
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))], "slope double, intercept double")


@q()
def hdbscan_fit(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return MODELS.create("hdbscan", features="embedding").fit_transform(e).select("vec_id", "prediction", "probability", "persistence", "outlier_score")


# -- models on rows that a rule separates: whatever learns must give the rule back -------------------------------------


def _separable(spark, d):
    side = F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)
    near = (F.col("p_partkey") % 7) / 100.0
    return table(spark, d, "part").select("p_partkey", F.array(side * 4 + near, (1 - side) * 4 + near, near).alias("features"), side.alias("label"))


def _rule(name: str, registered: str, **params) -> None:
    def f(spark, d):
        df = _separable(spark, d)
        return MODELS.create(registered, **params).fit(df).transform(df).select("p_partkey", F.col("prediction").cast("int").alias("prediction"))

    f.__name__ = f"{name}_rule"
    q("SELECT p_partkey, CAST(p_size > 25 AS INTEGER) AS prediction FROM part")(f)


for _name, _registered, _params in (
    ("logreg", "logistic_regression", {}), ("linear_svc", "linear_svc", {"max_iter": 10}), ("naive_bayes", "naive_bayes", {}), ("knn", "knn", {}), ("random_forest", "random_forest", {"trees": 10}), ("gbt", "xgboost", {"rounds": 2}), ("svm", "svm", {"gamma": 0.1, "dimensions": 64, "max_iter": 10}),
):
    _rule(_name, _registered, **_params)


def _groups(name: str, registered: str, **params) -> None:
    def f(spark, d):
        df = _separable(spark, d)
        got = MODELS.create(registered, **params).fit(df).transform(df).select("p_partkey", "prediction")
        first = got.groupBy("prediction").agg(F.min("p_partkey").alias("cluster"))
        return got.join(first, "prediction").select("p_partkey", "cluster")

    f.__name__ = f"{name}_rule"
    q("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_size > 25) AS cluster FROM part")(f)


for _name, _registered, _params in (("kmeans", "kmeans", {"k": 2}), ("kmeans_mini", "kmeans_mini", {"k": 2}), ("agglomerative", "agglomerative", {"n_clusters": 2}), ("agglomerative_single", "agglomerative", {"n_clusters": 2, "linkage": "single"})):
    _groups(_name, _registered, **_params)


@q("SELECT 2 AS best_from, 2 AS n_clusters, true AS inertia_falls, CAST(count(*) AS BIGINT) AS n FROM part")
def elbow_rule(spark, d):
    """Two groups: inertia falls at every k and the quality of the two-cluster labelling is near 1."""
    df = _separable(spark, d)
    bends = ml.elbow(df, "features", 2, 5).orderBy("k").collect()
    labelled = MODELS.create("kmeans", k=2, output="cluster").fit(df).transform(df)
    quality = {r.metric: r.value for r in ml.clustering_quality(labelled, key="p_partkey").collect()}
    falls = all(a.inertia >= b.inertia for a, b in zip(bends, bends[1:])) and quality["silhouette_average"] > 0.9 and quality["noise_share"] == 0
    return df.agg(F.lit(bends[0].k).alias("best_from"), F.lit(int(quality["n_clusters"])).alias("n_clusters"), F.lit(falls).alias("inertia_falls"), F.count(F.lit(1)).alias("n"))


@q(f"SELECT y_true, y_pred, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY y_true), 6) AS value FROM (SELECT a.y AS y_true, b.y AS y_pred FROM (SELECT DISTINCT event_type AS y FROM events) a, (SELECT DISTINCT event_type AS y FROM events) b) LEFT JOIN (SELECT y AS y_true, p AS y_pred, CAST(count(*) AS BIGINT) AS n FROM ({_JUDGED}) GROUP BY ALL) USING (y_true, y_pred)")
def chart_confusion(spark, d):
    return CHARTS.create("confusion_matrix", df=_judged(spark, d), truth="event_type", predicted="said", normalise="true").withColumn("value", F.round("value", 6))


@q("SELECT p_brand AS label, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY p_brand ORDER BY value DESC, label LIMIT 5")
def chart_bars(spark, d):
    return CHARTS.create("bar_chart", df=table(spark, d, "part"), column="p_brand", top_n=5)


@q("SELECT word, n, round(n / CAST(max(n) OVER () AS DOUBLE), 6) AS size FROM (SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 100)")
def chart_words(spark, d):
    return CHARTS.create("word_cloud", df=table(spark, d, "documents"), text="text", top_n=100).withColumn("size", F.round("size", 6))
