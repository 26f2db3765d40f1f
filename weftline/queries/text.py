"""Text, array, date and number expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scalars as S
from weftline.functions import text as X
from weftline.operators import features
from weftline.queries.register import Queries
from weftline.session import table
from weftline.sources.records import parse_answers

q = Queries()
WS = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}\\x{85}]"


def _on(source: str, key: str, column: str, build, alias: str = "out"):
    return lambda spark, d: table(spark, d, source).select(key, build(F.col(column)).alias(alias))


def _text(name: str, source: str, key: str, column: str, build, sql: str | None) -> None:
    f = _on(source, key, column, build)
    f.__name__ = name
    q(f"SELECT {key}, {sql} AS out FROM {source}" if sql else None)(f)


_text("text_lower", "documents", "doc_id", "text", X.lowercase, "lower(coalesce(text, ''))")
_text("text_urls", "documents", "doc_id", "text", X.remove_urls, "regexp_replace(text, 'https?://\\S+|www\\.\\S+', '', 'gi')")
_text("text_html", "boards_discussions", "Id", "Body", X.remove_html_tags, f"regexp_replace(regexp_replace(regexp_replace(Body, '<br\\s*/?>', ', ', 'gi'), '<[^>]+>', '', 'g'), '^{WS}+|{WS}+$', '', 'g')")
_text("text_whitespace", "documents", "doc_id", "text", X.remove_whitespace, f"regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')")
_text("text_punct_noise", "boards_discussions", "Id", "Body", X.remove_punctuation_noise, "regexp_replace(regexp_replace(regexp_replace(regexp_replace(Body, '!{2,}', '!', 'g'), '\\?{2,}', '?', 'g'), '\\.{2,}', '.', 'g'), ',{2,}', ',', 'g')")
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_PUNCT = X.PUNCTUATION.replace("'", "''")
_text("text_stopwords", "documents", "doc_id", "text", X.remove_stopwords, f"array_to_string(list_filter(regexp_split_to_array(translate(lower(text), '{_PUNCT}', ''), '{WS}+'), lambda w: w <> '' AND w NOT IN ({_STOP})), ' ')")
_text("text_game_stopwords", "steam_games", "Id", "Name", lambda c: X.remove_stopwords(c, X.STOPWORDS + X.GAME_STOPWORDS), f"array_to_string(list_filter(regexp_split_to_array(translate(lower(Name), '{_PUNCT}', ''), '{WS}+'), lambda w: w <> '' AND w NOT IN ({_STOP}, {', '.join(repr(w) for w in X.GAME_STOPWORDS)})), ' ')")
_text("text_emoji", "boards_discussions", "Id", "Body", X.remove_emoji, f"regexp_replace(Body, '{X.EMOJI}', '', 'g')")
_text("text_mask_words", "documents", "doc_id", "text", lambda c: X.mask_words(c, ["court", "energy", "school bus"]), "regexp_replace(text, '(?i)\\b(?:school bus|energy|court)\\w*\\b', '<MASKED>', 'g')")
_text("text_truncate", "part", "p_partkey", "p_name", X.truncate_label, "CASE WHEN length(p_name) > 10 THEN substr(p_name, 1, 7) || '...' ELSE p_name END")
_text("text_python_bool", "steam_games", "Id", "Is_Free", lambda c: X.python_bool(F.lower(c) == "true"), "CASE WHEN Is_Free IS NULL THEN 'None' WHEN lower(Is_Free) = 'true' THEN 'True' ELSE 'False' END")
_text("text_stem", "documents", "doc_id", "text", lambda c: X.stemmer()(c), None)
_text("count_features", "steam_games", "Id", "Genres", S.count_features, "CAST(len(list_filter(string_split(coalesce(Genres, ''), ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) AS INTEGER)")
_text("json_number", "events", "event_id", "props", lambda c: S.json_field(c, "k", "int"), "CAST(json_extract_string(props, '$.k') AS INTEGER)")
_text("json_flag", "boards_comments", "Id", "attributes", lambda c: S.json_field(c, "edited"), "json_extract_string(attributes, '$.edited')")
_text("percent_offset", "lineitem", "l_orderkey", "l_discount", lambda c: F.round(S.percent(c, 0.1), 9), "round(l_discount * 100 + 0.1, 9)")
_text("age_in_years", "orders", "o_orderkey", "o_orderdate", lambda c: S.age_years(c.cast("date"), F.lit("2024-06-30").cast("date")), "CASE WHEN CAST(o_orderdate AS DATE) <= DATE '2024-06-30' THEN CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2024-06-30') AS INTEGER) END")
_text("platform_keys", "steam_games", "Id", "Platforms", lambda c: S.keys_where_true(F.map_from_arrays(F.array(F.lit("windows"), F.lit("mac"), F.lit("linux")), F.array(*(F.contains(c, F.lit(x)) for x in ("windows", "mac", "linux"))))), "CASE WHEN Platforms IS NULL THEN '' ELSE concat_ws(',', CASE WHEN contains(Platforms, 'windows') THEN 'windows' END, CASE WHEN contains(Platforms, 'mac') THEN 'mac' END, CASE WHEN contains(Platforms, 'linux') THEN 'linux' END) END")
_text("iso_date", "orders", "o_orderkey", "o_orderdate", lambda c: S.parse_date(F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00Z"))), "CAST(o_orderdate AS DATE)")
_text("game_url", "steam_games", "Id", "AppID", lambda c: F.concat(F.lit("https://store.steampowered.com/app/"), c.cast("string")), "'https://store.steampowered.com/app/' || CAST(AppID AS VARCHAR)")
_text("quarter_label", "orders", "o_orderkey", "o_orderdate", S.quarter_label, "'Q' || quarter(o_orderdate)")
_text("cell_array_to_csv", "steam_games", "Id", "Publishers", lambda c: S.join_strings(S.cell_tokens(c, ","), sep=";"), "array_to_string(list_filter(list_transform(string_split(coalesce(Publishers, ''), ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ';')")


@q("""
WITH chars AS (
  SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text IS NOT NULL AND text <> ''),
runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS g FROM chars),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ch, g) AS n FROM runs)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.out, '') END AS out
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS out FROM sized WHERE n < 3 OR ch IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)) GROUP BY doc_id) k USING (doc_id)""")
def text_repeat_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", X.remove_repeated_characters(F.col("text")).alias("out"))


@q("SELECT p_partkey, regexp_replace(p_name || ' ' || p_type, '(?i)\\b(?:\\Q' || lower(p_type) || '\\E)\\w*\\b', '<MASKED>', 'g') AS out FROM part")
def text_mask_label(spark, d):
    return table(spark, d, "part").select("p_partkey", X.mask_label_words(F.concat_ws(" ", "p_name", "p_type"), F.col("p_type")).alias("out"))


@q("SELECT Id, trim(coalesce(Title, '') || ' ' || coalesce(CAST(CategoryId AS VARCHAR), '') || ' ' || coalesce(CanonicalURL, '')) AS out FROM boards_discussions")
def text_merge(spark, d):
    return table(spark, d, "boards_discussions").select("Id", X.merge_features(F.col("Title"), F.col("CategoryId"), F.col("CanonicalURL")).alias("out"))


@q(f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, round(avg(n), 6) AS mean_tokens, CAST(max(n) AS BIGINT) AS max_tokens FROM (
  SELECT lang, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(translate(lower(regexp_replace(text, 'https?://\\S+|www\\.\\S+', '', 'gi')), '{_PUNCT}', ''), '{WS}+'), lambda w: w <> '' AND w NOT IN ({_STOP}))) END AS n
  FROM documents) GROUP BY lang""")
def text_pipeline(spark, d):
    words = X.tokens(X.chain(F.col("text"), ["remove_urls", "stopwords"]))
    n = table(spark, d, "documents").select("lang", F.coalesce(F.size(words), F.lit(0)).alias("n"))
    n = n.withColumn("n", F.greatest("n", F.lit(0)))
    return n.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("n"), 6).alias("mean_tokens"), F.max("n").cast("bigint").alias("max_tokens"))


_XML = "SELECT Id, AnswerSpeaker, strftime(AnswerRecordedTime, '%Y-%m-%dT%H:%M:%S') AS t, AnswerText FROM oireachtas_questions WHERE AnswerText IS NOT NULL"


@q(f"""
SELECT Id, AnswerSpeaker AS speaker, t AS recorded,
       array_to_string(list_filter(list_transform(string_split(AnswerText, chr(10)), lambda p: regexp_replace(p, '^{WS}+|{WS}+$', '', 'g')), lambda p: p <> ''), chr(10)) AS answer
FROM ({_XML})""")
def xml_speech(spark, d):
    """Answer documents built from the table, then read back."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    t = F.date_format("AnswerRecordedTime", "yyyy-MM-dd'T'HH:mm:ss")
    xml = F.concat(
        F.lit('<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0/CSD13"><debate><speech'), F.coalesce(F.concat(F.lit(' by="#'), "AnswerSpeaker", F.lit('"')), F.lit("")), F.lit(">"),
        F.coalesce(F.concat(F.lit('<recordedTime time="'), t, F.lit('"/>')), F.lit("")), F.lit("<p>"), F.replace(escape(F.col("AnswerText")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></speech></debate></akomaNtoso>"),
    )
    return parse_answers(table(spark, d, "oireachtas_questions").where("AnswerText is not null").select("Id", xml.alias("xml")), "Id", "xml")


@q("SELECT o_orderkey, CAST(day(o_orderdate) AS INTEGER) AS d_day, CAST(month(o_orderdate) AS INTEGER) AS d_month, CAST(year(o_orderdate) AS INTEGER) AS d_year, CAST(quarter(o_orderdate) AS INTEGER) AS d_quarter FROM orders")
def temporal_parts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *(c.alias(n) for n, c in S.temporal_features(F.col("o_orderdate"), "d", quarter=True, quarter_format="int").items()))


@q("SELECT event_id, floor((epoch_us(TIMESTAMP '2024-06-30 12:00:00') - epoch_us(ts)) / 86400000000.0) AS days FROM events")
def days_since(spark, d):
    return table(spark, d, "events").select("event_id", S.days_since(F.col("ts"), F.lit("2024-06-30 12:00:00").cast("timestamp_ntz")).alias("days"))


@q("SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 9) AS m_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 9) AS m_cos FROM orders")
def cyclic_month(spark, d):
    df = features.CyclicEncode("m", 12).fit_transform(table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("m")))
    return df.select("o_orderkey", F.round("m_sin", 9).alias("m_sin"), F.round("m_cos", 9).alias("m_cos"))


@q("SELECT Id, CASE WHEN Id % 3 = 0 THEN date_trunc('month', Release_Date) WHEN Id % 3 = 1 THEN Release_Date END AS out FROM steam_games")
def parse_release_date(spark, d):
    df = table(spark, d, "steam_games").select("Id", F.when(F.col("Id") % 3 == 0, F.date_format("Release_Date", "MMM, yyyy")).when(F.col("Id") % 3 == 1, F.concat(F.lit(" "), F.date_format("Release_Date", "d MMM, yyyy"))).otherwise("Coming soon").alias("t"))
    return df.select("Id", S.parse_release_date(F.col("t")).cast("timestamp_ntz").alias("out"))


@q("SELECT c_custkey, round(ln(1 + c_acctbal + (SELECT CASE WHEN min(c_acctbal) <= 0 THEN 1 - min(c_acctbal) ELSE 0 END FROM customer)), 9) AS c_acctbal FROM customer")
def log1p_shift(spark, d):
    df = features.LogTransform(["c_acctbal"]).fit_transform(table(spark, d, "customer").select("c_custkey", "c_acctbal"))
    return df.select("c_custkey", F.round("c_acctbal", 9).alias("c_acctbal"))


@q("SELECT l_orderkey, l_linenumber, round(ln(1 + greatest(l_extendedprice / (ln(1 + l_quantity) + 1e-9), 0)), 9) AS out FROM lineitem")
def normalise_feature(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.ratio(F.col("l_extendedprice"), F.col("l_quantity")), 9).alias("out"))


@q("SELECT Id, round(ln(1 + Total_Reviews) * Review_Score, 9) AS out FROM steam_games")
def success_index(spark, d):
    return table(spark, d, "steam_games").select("Id", F.round(S.success_index(F.col("Total_Reviews"), F.col("Review_Score")), 9).alias("out"))


def _catalog(agg: str, sql_agg: str) -> None:
    def f(spark, d):
        got = features.catalog_count(table(spark, d, "steam_games").select("Id", "Tags"), "Tags", "Id", agg=agg)
        return got.select("Id", F.round("catalog_count_Tags", 9).alias("out"))

    f.__name__ = f"catalog_count_{agg}"
    q(f"""
WITH p AS (SELECT Id, unnest(list_distinct(list_filter(list_transform(string_split(coalesce(Tags, ''), ','), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> ''))) AS t FROM steam_games),
n AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (SELECT Id, CAST({sql_agg}(df) AS DOUBLE) AS v FROM p JOIN n USING (t) GROUP BY Id)
SELECT g.Id, round(coalesce(v, 0.0), 9) AS out FROM steam_games g LEFT JOIN s USING (Id)""")(f)


for _a, _s in (("sum", "sum"), ("max", "max"), ("min", "min"), ("mean", "avg")):
    _catalog(_a, _s)
