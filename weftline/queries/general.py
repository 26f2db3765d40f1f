"""Queries of the general data problems: nested records, intervals, packed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import intervals, nested, packed
from weftline.session import table

PACKED = ["Genres", "Tags", "Categories", "Developers"]
#: Names of these columns in which a slash is part of the name.
WITH_SLASH = ("Shared/Split Screen",)


def _debates(spark: SparkSession, d: str) -> nested.Routed:
    return nested.route(nested.shred(table(spark, d, "oireachtas_debate_sections"), "Id", "RawJSON"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object of every debate record with its path and its parent's path: the common keys of all variant tables."""
    return _debates(spark, d).common().select("id", "entity", "path", "parent_path")


def p2_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rows routed to each shape variant."""
    return _debates(spark, d).variants()


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """Per entity: its rows, its records, and how many rows are linked to a parent row."""
    rows = _debates(spark, d).common()
    parents = rows.select("id", F.col("path").alias("parent_path"), F.lit(1).alias("found"))
    linked = rows.where("path != ''").join(parents, ["id", "parent_path"], "left").groupBy("entity").agg(F.count("found").alias("n_linked"))
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_records")).join(linked, "entity", "left").fillna(0, ["n_linked"])


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The typed tables of the paragraph variants whose number is a whole number, and those where it is text, side by side."""
    routed = _debates(spark, d)
    whole, text = "struct<`num`:bigint,`text`:string>", "struct<`num`:string,`text`:string>"
    one = lambda v: routed.table("paragraph", v).select("id", "path", "parent_path", F.col("own.num").cast("string").alias("num"), F.lit(v == whole).alias("whole"), F.col("own.text").alias("text"))
    return one(whole).unionAll(one(text))


def p2_contributions(spark: SparkSession, d: str) -> DataFrame:
    """The contribution table over all variants: speaker given as a name or as an object, role given as a name or as an object."""
    got = _debates(spark, d).entity(
        "contribution",
        {"speaker_name": "$.speaker.showAs", "speaker_text": "$.speaker", "speaker_uri": "$.speaker.uri", "role_name": "$.speaker.role.showAs", "role_text": "$.speaker.role", "kind": "$.contributionType", "recorded": "$.recordedTime"},
    )
    plain = lambda c: F.when(~F.startswith(F.col(c), F.lit("{")), F.col(c))
    return got.select("id", "path", "parent_path", F.coalesce("speaker_name", plain("speaker_text")).alias("speaker"), "speaker_uri", F.coalesce("role_name", plain("role_text")).alias("role"), "kind", F.try_to_timestamp("recorded").alias("recorded"), "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods and gaps of each member's memberships."""
    merged = intervals.merge_intervals(table(spark, d, "oireachtas_member_memberships"), "pId", "membership_start_date", "membership_end_date")
    return merged.withColumnRenamed("entity", "pid")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of the packed game cells, one per row."""
    return packed.explode_values(table(spark, d, "steam_games"), "Id", PACKED, WITH_SLASH)


def p6_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many games carry each value, values compared without case."""
    found = packed.explode_values(table(spark, d, "steam_games"), "Id", PACKED, WITH_SLASH)
    return found.groupBy("field", F.lower("value").alias("value_key")).agg(F.count_distinct("id").alias("n_games"))


QUERIES = {f.__name__: f for f in (p2_found, p2_variants, p2_entities, p2_paragraphs, p2_contributions, p3_found, p6_found, p6_value_counts)}

# every object of the debate records by recursion over their JSON: encoded twice, wrapped, single objects for lists
_NODES = """
WITH RECURSIVE kinds(plural, wrapper, kind) AS (VALUES ('debateSections','debateSection','subsection'),('contributions','contribution','contribution'),('paragraphs','paragraph','paragraph'),('references','reference','reference'),('divisions','division','division'),('votes','vote','vote')),
read AS (SELECT Id AS id, try_cast(RawJSON AS JSON) AS j FROM oireachtas_debate_sections WHERE json_valid(RawJSON)),
again AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) ELSE j END AS j FROM read),
root AS (SELECT id, CASE WHEN json_type(j) = 'OBJECT' AND json_keys(j) = ['debateSection'] THEN json_extract(j, '$.debateSection') ELSE j END AS j FROM again),
nodes AS (
  SELECT id, 'section' AS entity, '' AS path, '' AS parent_path, j FROM root WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT id, kind, path || plural || '/' || CAST(i AS VARCHAR), parent, CASE WHEN json_type(x) = 'OBJECT' AND json_keys(x) = [wrapper] THEN json_extract(x, '$.' || wrapper) ELSE x END
  FROM (
    SELECT id, kind, plural, wrapper, CASE WHEN path = '' THEN '' ELSE path || '/' END AS path, path AS parent, unnest(list) AS x, generate_subscripts(list, 1) - 1 AS i
    FROM (
      SELECT id, kind, plural, wrapper, path, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'NULL' THEN [] ELSE [v] END AS list
      FROM (
        SELECT id, kind, plural, wrapper, path, CASE WHEN json_type(w) = 'OBJECT' AND json_keys(w) = [wrapper] THEN json_extract(w, '$.' || wrapper) ELSE w END AS v
        FROM (
          SELECT id, kind, plural, wrapper, path, CASE WHEN json_type(c) = 'VARCHAR' AND json_valid(c ->> '$') THEN CAST(c ->> '$' AS JSON) WHEN json_type(c) = 'VARCHAR' THEN NULL ELSE c END AS w
          FROM (SELECT n.id, k.kind, k.plural, k.wrapper, n.path, json_extract(n.j, '$.' || k.plural) AS c FROM nodes n, kinds k WHERE json_type(n.j) = 'OBJECT') WHERE c IS NOT NULL) WHERE w IS NOT NULL)))
  WHERE json_type(x) <> 'NULL')
"""
_PARAGRAPH = "entity = 'paragraph' AND json_type(j) = 'OBJECT' AND json_type(j, '$.text') = 'VARCHAR' AND len(json_keys(j)) = 2"

ORACLES = {
    "p2_found": _NODES + "SELECT id, entity, path, parent_path FROM nodes",
    "p2_entities": _NODES
    + """
, linked AS (SELECT n.entity, count(*) AS n FROM nodes n JOIN nodes p ON p.id = n.id AND p.path = n.parent_path WHERE n.path <> '' GROUP BY n.entity)
SELECT entity, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS n_records, CAST(coalesce(any_value(l.n), 0) AS BIGINT) AS n_linked FROM nodes LEFT JOIN linked l USING (entity) GROUP BY entity""",
    "p2_paragraphs": _NODES
    + f"""
SELECT id, path, parent_path, j ->> '$.num' AS num, json_type(j, '$.num') <> 'VARCHAR' AS whole, j ->> '$.text' AS text
FROM nodes WHERE {_PARAGRAPH} AND json_type(j, '$.num') IN ('UBIGINT', 'BIGINT', 'VARCHAR')""",
    "p2_contributions": _NODES
    + """
SELECT id, path, parent_path, CASE json_type(j, '$.speaker') WHEN 'VARCHAR' THEN j ->> '$.speaker' WHEN 'OBJECT' THEN j ->> '$.speaker.showAs' END AS speaker, j ->> '$.speaker.uri' AS speaker_uri,
  CASE json_type(j, '$.speaker.role') WHEN 'VARCHAR' THEN j ->> '$.speaker.role' WHEN 'OBJECT' THEN j ->> '$.speaker.role.showAs' END AS role,
  j ->> '$.contributionType' AS kind, try_cast(j ->> '$.recordedTime' AS TIMESTAMP) AS recorded, coalesce(j ->> '$.text', j ->> '$.showAs') AS text
FROM nodes WHERE entity = 'contribution'""",
    "p3_found": """
WITH usable AS (
  SELECT pId AS pid, membership_start_date AS s,
         CASE WHEN membership_end_date IS NULL OR membership_end_date IN (DATE '2099-12-31', DATE '9999-12-31')
              THEN DATE '9999-12-30' ELSE membership_end_date END AS e
  FROM oireachtas_member_memberships WHERE pId IS NOT NULL AND membership_start_date IS NOT NULL),
kept AS (SELECT * FROM usable WHERE e >= s),
marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY pid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
                 THEN 0 ELSE 1 END AS fresh FROM kept),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY pid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked),
periods AS (SELECT pid, min(s) AS s, max(e) AS e FROM grouped GROUP BY pid, g),
gaps AS (SELECT pid, e + 1 AS s, lead(s) OVER (PARTITION BY pid ORDER BY s) - 1 AS e FROM periods)
SELECT pid, 'period' AS kind, strftime(s, '%Y-%m-%d') AS start_date,
       CASE WHEN e = DATE '9999-12-30' THEN 'open' ELSE strftime(e, '%Y-%m-%d') END AS end_date FROM periods
UNION ALL
SELECT pid, 'gap', strftime(s, '%Y-%m-%d'), strftime(e, '%Y-%m-%d') FROM gaps WHERE e IS NOT NULL""",
}
