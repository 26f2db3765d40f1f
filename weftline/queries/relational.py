"""Scans, filters, joins, row sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.predicates import filter_rows, filter_spec, order_spec, prefilter_rows
from weftline.operators import joins, rowset
from weftline.plans import pipeline
from weftline.queries.register import Queries
from weftline.session import table
from weftline.sources.catalog import Catalog, source_of
from weftline.sources.schemas import key_violations, orphans

q = Queries()


@q("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_filter_eq(spark, d):
    return table(spark, d, "orders").where(filter_spec({"o_orderstatus": "F"})[0]).select("o_orderkey", "o_custkey", "o_totalprice")


@q("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000")
def scan_filter_range(spark, d):
    df = table(spark, d, "orders")
    for c in filter_spec({"o_totalprice": {"from": 100000, "to": 200000}}):
        df = df.where(c)
    return df.select("o_orderkey", "o_totalprice")


@q("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus = 'O'")
def scan_filter_in(spark, d):
    df = table(spark, d, "orders")
    for c in filter_spec({"o_orderpriority": {"in": ["1-URGENT", "5-LOW"]}, "o_orderstatus": "O"}):
        df = df.where(c)
    return df.select("o_orderkey", "o_orderpriority")


@q("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def scan_order_limit(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return df.orderBy(*order_spec(df, [{"column": "o_totalprice", "direction": "desc"}, {"column": "o_orderkey"}])).limit(100)


@q("SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '42'), o_orderkey LIMIT 500")
def scan_random_sample(spark, d):
    return rowset.sample_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@q("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 200")
def scan_page(spark, d):
    return rowset.page(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 200, 50)


@q("SELECT * FROM steam_games WHERE Id = 7")
def point_lookup(spark, d):
    return Catalog(spark, d).fetch_by_id("SteamGame", 7)


@q("SELECT * FROM (SELECT 9 AS Id, 77 AS gameID) WHERE gameID = 77")
def point_lookup_game(spark, d):
    games = spark.createDataFrame([(9, 77), (10, 78)], "Id int, gameID int")
    return Catalog(spark, reader=lambda name: games).fetch_by_game_id(77)


@q("SELECT Id, Type, Closed FROM boards_discussions WHERE coalesce(TRY_CAST(Closed AS BOOLEAN), false) AND CategoryId < 130")
def scan_filter_flag(spark, d):
    """A filter list that names a boolean column."""
    df = table(spark, d, "boards_discussions").withColumn("is_closed", F.col("Closed").try_cast("boolean"))
    for c in filter_spec(["is_closed"]):
        df = df.where(c)
    return df.where("CategoryId < 130").select("Id", "Type", "Closed")


SIZED = "nullif(p_size % 7, 0)"


def _sized(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(SIZED).alias("size7"))


@q(f"SELECT p_partkey FROM part WHERE {SIZED} IN (1, 3) OR {SIZED} IS NULL")
def filter_in_null(spark, d):
    return filter_rows(_sized(spark, d), "size7", [1, 3, None]).select("p_partkey")


@q(f"SELECT p_partkey FROM part WHERE NOT coalesce({SIZED} IN (1, 3), false)")
def filter_not_in(spark, d):
    return filter_rows(_sized(spark, d), "size7", [1, 3], "not_in").select("p_partkey")


@q("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000.5")
def filter_gt_numeric(spark, d):
    return filter_rows(table(spark, d, "orders"), "o_totalprice", "250000.5", "gt").select("o_orderkey")


@q("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def filter_gt_datetime(spark, d):
    return filter_rows(table(spark, d, "orders"), "o_orderdate", "1998-01-01", "gte").select("o_orderkey")


@q("SELECT p_partkey FROM part WHERE p_brand > 'Brand#2'")
def filter_gt_string(spark, d):
    return filter_rows(table(spark, d, "part"), "p_brand", "Brand#2", "gt").select("p_partkey")


@q("SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'red|RING', 'i')")
def filter_contains(spark, d):
    return filter_rows(table(spark, d, "part"), "p_name", "red|RING", "contains", case_sensitive=False).select("p_partkey")


@q("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^s.*g$')")
def filter_regex(spark, d):
    return filter_rows(table(spark, d, "part"), "p_name", "^s.*g$", "regex").select("p_partkey")


@q(f"SELECT p_partkey FROM part WHERE NOT coalesce({SIZED} > 3, false)")
def filter_exclude_keeps_null(spark, d):
    return filter_rows(_sized(spark, d), "size7", 3, "gt", include=False).select("p_partkey")


@q("SELECT p_partkey FROM part WHERE lower(p_type) IN ('economy', 'promo')")
def filter_equals_ci(spark, d):
    return filter_rows(table(spark, d, "part"), "p_type", ["Economy", "Promo"], "equals", case_sensitive=False).select("p_partkey")


@q("SELECT event_id FROM events WHERE lower(trim(event_type)) NOT IN ('click', 'view')")
def prefilter_equals(spark, d):
    return prefilter_rows(table(spark, d, "events"), "event_type", ["CLICK ", "view"]).select("event_id")


@q("SELECT event_id FROM events WHERE regexp_matches(event_type, 'sign|err', 'i')")
def prefilter_negate(spark, d):
    return prefilter_rows(table(spark, d, "events"), "event_type", ["SIGN", "err"], "contains", negate=True).select("event_id")


def _staged(spark, d, name, *entries):
    return pipeline.run(list(entries), spark, Catalog(spark, d), table(spark, d, name)).data


@q("SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer")
def drop_columns(spark, d):
    return _staged(spark, d, "customer", {"stage": "filter", "filter_features": [{"name": "drop_columns", "params": {"columns_to_drop": ["c_acctbal", "c_mktsegment", "not_there"]}}]})


@q("SELECT * EXCLUDE (Id, AppID, Name, Total_Reviews, Total_Positive, Total_Negative) FROM steam_games")
def drop_leakage(spark, d):
    return _staged(spark, d, "steam_games", {"stage": "filter", "filter_features": [{"name": "drop_leakage"}]})


@q("SELECT Id, DiscussionId, Title AS \"name\", CategoryId AS category FROM boards_discussions")
def rename_project(spark, d):
    return rowset.renamed(table(spark, d, "boards_discussions").select("Id", "DiscussionId", "Title", "CategoryId"), {"Title": "name", "CategoryId": "category", "not_there": "x"})


@q("SELECT DiscussionId FROM boards_discussions WHERE CategoryId < 110 AND countComments > 5")
def raw_where_ids(spark, d):
    return source_of({"type": "db", "where": "CategoryId < 110 AND countComments > 5"}, Catalog(spark, d))


@q("""
SELECT o.o_orderkey, o.k, CASE WHEN c.k IS NOT NULL THEN c.seg ELSE o.seg END AS seg, c.bal
FROM (SELECT o_orderkey, o_custkey AS k, o_orderpriority AS seg FROM orders) o
LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE c_acctbal > 0) c ON o.k = c.k""")
def lookup_join_overwrite(spark, d):
    left = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("seg"))
    right = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    return joins.lookup_overwrite(left, right, "k")


@q("""
SELECT l.o_orderkey, l.k, CASE WHEN r.k IS NOT NULL THEN r.status ELSE l.status END AS status, r.price
FROM (SELECT o_orderkey, o_custkey AS k, 'none' AS status FROM orders) l
LEFT JOIN (SELECT o_custkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_totalprice > 100000
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) r ON l.k = r.k""")
def lookup_join_last_wins(spark, d):
    """Most keys occur many times on the right: the last order of each customer counts."""
    o = table(spark, d, "orders")
    right = o.where("o_totalprice > 100000").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.struct("o_orderdate", "o_orderkey").alias("v"))
    return joins.lookup_overwrite(o.select("o_orderkey", F.col("o_custkey").alias("k"), F.lit("none").alias("status")), right, "k", "v")


@q("""
SELECT l.o_orderkey, l.k, r.price FROM (SELECT o_orderkey, o_custkey AS k FROM orders) l
LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) r ON l.k = r.k""")
def lookup_join_repeated(spark, d):
    """Repeated keys without a version: one row per left row still."""
    o = table(spark, d, "orders")
    return joins.lookup_overwrite(o.select("o_orderkey", F.col("o_custkey").alias("k")), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price")), "k")


@q("""
SELECT c_custkey, c_nationkey, c_mktsegment FROM customer c WHERE c_custkey > 1000 OR NOT EXISTS (SELECT 1 FROM customer s WHERE s.c_custkey <= 500 AND s.c_nationkey = c.c_nationkey AND s.c_mktsegment = c.c_mktsegment)""")
def upsert_children(spark, d):
    """Children whose keys are stored (null matching null) are left out, the parent's rows replace; here only the child is shown."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    late = c.where("c_custkey > 1000").withColumn("c_nationkey", F.lit(-1).cast(c.schema["c_nationkey"].dataType))
    keys = {"child": ["c_nationkey", "c_mktsegment"]}
    new = joins.upsert_children({"child": c.where("c_custkey <= 500")}, {"child": late.unionByName(c.where("c_custkey <= 1000"))}, keys, "parent")["child"]
    return new.join(c.select("c_custkey", F.col("c_nationkey").alias("n")), "c_custkey").select("c_custkey", F.col("n").alias("c_nationkey"), "c_mktsegment")


@q("SELECT CategoryId AS c FROM boards_discussions UNION SELECT categoryID FROM boards_comments WHERE score > 20")
def union_labels(spark, d):
    return rowset.union_values(table(spark, d, "boards_discussions").select(F.col("CategoryId").alias("c")), table(spark, d, "boards_comments").where("score > 20").select(F.col("categoryID").alias("c")), "c")


@q("SELECT DISTINCT discussionID AS DiscussionId FROM boards_comments WHERE discussionID IS NOT NULL AND discussionID NOT IN (SELECT DiscussionId FROM boards_discussions WHERE CategoryId < 130)")
def anti_join_new_keys(spark, d):
    """What is new to a store that holds the discussions of some categories."""
    stored = table(spark, d, "boards_discussions").where("CategoryId < 130").select("DiscussionId")
    return joins.new_keys(table(spark, d, "boards_comments").select(F.col("discussionID").alias("DiscussionId")), stored, ["DiscussionId"])


@q("SELECT Id FROM boards_comments c WHERE EXISTS (SELECT 1 FROM boards_discussions b WHERE b.DiscussionId = c.discussionID)")
def semi_join_keys(spark, d):
    stored = table(spark, d, "boards_discussions").select(F.col("DiscussionId").alias("discussionID"))
    return joins.known_keys(table(spark, d, "boards_comments"), stored, ["discussionID"]).select("Id")


@q("""
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey >= 500
UNION ALL SELECT c_custkey, c_acctbal + 1000 FROM customer WHERE c_custkey < 500""")
def upsert_merge(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return joins.upsert(c, c.where("c_custkey < 500").withColumn("c_acctbal", F.col("c_acctbal") + 1000), ["c_custkey"])


@q("""
SELECT DiscussionId, Id, Title FROM boards_discussions
QUALIFY row_number() OVER (PARTITION BY DiscussionId ORDER BY coalesce(DateUpdated, DateInserted) DESC NULLS LAST, Id DESC) = 1""")
def latest_snapshot(spark, d):
    df = table(spark, d, "boards_discussions").select("DiscussionId", "Id", "Title", F.struct(F.coalesce("DateUpdated", "DateInserted").alias("t"), "Id").alias("v"))
    return joins.last_by_key(df, ["DiscussionId"], "v").select("DiscussionId", "Id", "Title")


@q("SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_first(spark, d):
    return rowset.dedupe(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@q("SELECT AppID, Id FROM steam_games QUALIFY row_number() OVER (PARTITION BY AppID ORDER BY Id DESC) = 1")
def dedupe_last(spark, d):
    return rowset.dedupe(table(spark, d, "steam_games").select("AppID", "Id"), "AppID", "Id", keep="last")


@q("SELECT doc_id, lang FROM documents QUALIFY lang IS NULL OR row_number() OVER (PARTITION BY lower(lang) ORDER BY doc_id) = 1")
def dedupe_ci_unique_null(spark, d):
    return rowset.dedupe(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", case_sensitive=False, unique_nulls=True)


@q("SELECT text, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_audit(spark, d):
    return rowset.duplicate_audit(table(spark, d, "documents"), ["text"])


@q("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_groups FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_summary(spark, d):
    return rowset.duplicate_summary(table(spark, d, "documents"), ["text"])


_PARTS = "list_filter(list_transform(string_split(coalesce({c}, ''), ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND lower(x) <> 'nan')"


@q(f"""
SELECT Id, unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE p END) AS Platforms
FROM (SELECT Id, {_PARTS.format(c='Platforms')} AS p FROM steam_games)""")
def explode_tokens(spark, d):
    return rowset.explode_columns(table(spark, d, "steam_games").select("Id", "Platforms"), ["Platforms"])


@q(f"""
SELECT Id, Platforms, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS Supported_Languages FROM (
  SELECT Id, unnest(CASE WHEN len(p) = 0 THEN [NULL] ELSE p END) AS Platforms, s
  FROM (SELECT Id, {_PARTS.format(c='Platforms')} AS p, {_PARTS.format(c='Supported_Languages')} AS s FROM steam_games))""")
def explode_cartesian(spark, d):
    return rowset.explode_columns(table(spark, d, "steam_games").select("Id", "Platforms", "Supported_Languages"), ["Platforms", "Supported_Languages"])


@q("UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value")
def unpivot_metrics(spark, d):
    return rowset.melt(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@q("""
SELECT pId, range_start, range_end FROM (
  SELECT pId, greatest(m, s) AS range_start, least(CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), e) AS range_end FROM (
    SELECT pId, s, e, CAST(unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH)) AS DATE) AS m
    FROM (SELECT pId, membership_start_date AS s, membership_end_date AS e FROM oireachtas_member_memberships
          WHERE membership_end_date < DATE '2030-01-01' AND membership_start_date <= membership_end_date)))""")
def month_ranges(spark, d):
    m = table(spark, d, "oireachtas_member_memberships").where("membership_end_date < date'2030-01-01' and membership_start_date <= membership_end_date")
    return rowset.month_ranges(m.select("pId", "membership_start_date", "membership_end_date"), "membership_start_date", "membership_end_date").select("pId", "range_start", "range_end")


@q("SELECT o_orderkey AS k, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def union_pages(spark, d):
    one = lambda t, k, n: table(spark, d, t).select(F.col(k).alias("k"), F.lit(n).alias("kind"))
    return rowset.union_pages([one("orders", "o_orderkey", "order"), one("customer", "c_custkey", "customer"), one("supplier", "s_suppkey", "supplier")])


@q("SELECT CategoryId AS c FROM boards_discussions EXCEPT SELECT categoryID FROM boards_comments WHERE score > 20")
def except_labels(spark, d):
    return rowset.except_values(table(spark, d, "boards_discussions").select(F.col("CategoryId").alias("c")), table(spark, d, "boards_comments").where("score > 20").select(F.col("categoryID").alias("c")), "c")


@q("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersect_labels(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return rowset.intersect_values(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "k")


@q("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang NULLS LAST LIMIT 3")
def top_categories(spark, d):
    return rowset.top_counts(table(spark, d, "documents"), "lang", 3)


@q("SELECT QuestionURI, CAST(count(*) AS BIGINT) AS n FROM oireachtas_questions GROUP BY QuestionURI HAVING count(*) > 1 OR QuestionURI IS NULL")
def key_check(spark, d):
    return key_violations(table(spark, d, "oireachtas_questions"), ("QuestionURI",))


@q("SELECT membership_id, pId FROM oireachtas_member_memberships m WHERE pId IS NOT NULL AND NOT EXISTS (SELECT 1 FROM oireachtas_members x WHERE x.pId = m.pId AND x.dateOfDeath IS NULL)")
def link_check(spark, d):
    """Memberships without a living member: all links into the whole table hold."""
    m = table(spark, d, "oireachtas_member_memberships").select("membership_id", "pId")
    return orphans(m, "pId", table(spark, d, "oireachtas_members").where("dateOfDeath is null"), "pId").select("membership_id", "pId")
