"""Queries of the text problems, and the SQL they are held against where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import leakage, neardup, packing, pii, stuffing, subjects
from weftline.session import table, written

QUESTION_TEXTS = ["QuestionText", "AnswerText"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of question rows whose texts are versions of each other."""
    return neardup.linked_pairs(table(spark, d, "oireachtas_questions"), "Id", QUESTION_TEXTS)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per text with its class, named by its smallest Id, and how many texts the class holds."""
    found = neardup.classes(table(spark, d, "oireachtas_questions"), "Id", QUESTION_TEXTS)
    names = F.element_at(F.array(*map(F.lit, QUESTION_TEXTS)), F.col("field") + 1)
    per_class = found.groupBy("field", "class_id").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_texts"))
    return found.join(per_class, ["field", "class_id"]).select(names.alias("field"), "id", F.col("first_id").alias("class_id"), "n_texts")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of a test item, and which."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The documents without the leaked passages."""
    return leakage.scrubbed(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Leaking documents and leaked items by source."""
    docs = table(spark, d, "documents")
    found = leakage.leaks(docs, table(spark, d, "eval_items"))
    hit = docs.select("doc_id", "source").join(found, "doc_id")
    return hit.groupBy("source").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("item_id").alias("n_items"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of every question and discussion."""
    model = subjects.train(subjects.examples_of(table(spark, d, "subject_examples")))
    parts = [(table(spark, d, "oireachtas_questions"), "question", "Id", "QuestionText"), (table(spark, d, "boards_discussions"), "discussion", "Id", "Body")]
    return subjects.label(parts, model)


def p4_mix(spark: SparkSession, d: str) -> DataFrame:
    """The composition of the corpus by subject."""
    return p4_found(spark, d).groupBy("src", "subject").agg(F.count(F.lit(1)).alias("n_texts"))


def _names(spark: SparkSession, d: str) -> pii.Names:
    return pii.names_from(table(spark, d, "oireachtas_members"), "firstName", "fullName")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in titles and bodies."""
    return pii.find(table(spark, d, "boards_discussions"), "Id", ["Title", "Body"], _names(spark, d))


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    """Titles and bodies with personal data replaced by placeholders."""
    return pii.mask(table(spark, d, "boards_discussions"), "Id", ["Title", "Body"], _names(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of one that exceeds a container."""
    return packing.pack(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.fill(packing.pack(table(spark, d, "documents")))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What a filling must keep: every document is there once, no container is overfull, nothing is split that fits, no piece is empty or too large."""
    docs = table(spark, d, "documents")
    # tokens are counted once: everything below reads the same filling
    packed = written(packing.pack(docs), "p7-checks")
    overfull = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("n_overfull"))
    per_doc = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("places"), F.sum("tokens").alias("n"), F.max("tokens").alias("most"))
    split = per_doc.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= 2048)).alias("n_split"), F.count_if((F.col("pieces") != F.col("places")) | (F.col("most") > 2048)).alias("n_odd"))
    empty = packed.agg(F.count_if(F.col("container").isNull()).alias("n_empty"))
    one = F.lit(1).alias("k")
    return overfull.select(one, "*").join(split.select(one, "*"), "k").join(empty.select(one, "*"), "k").drop("k")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of which at least half the words stand in lists."""
    return stuffing.stuffed(table(spark, d, "documents")).select("doc_id")


def p9_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Words of each kind and stuffed pages by source."""
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    words = stuffing.page_words(docs).where("n_words > 0")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_prose", "n_links", "n_tags", "n_menu")]
    return docs.select("doc_id", "source").join(words, "doc_id").groupBy("source").agg(F.count_if(F.col("n_prose") <= 0.5 * F.col("n_words")).alias("n_stuffed"), *sums)


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p4_found, p4_mix, p5_found, p5_masked, p7_containers, p7_fill, p7_checks, p8_found, p8_cleaned, p8_by_source, p9_found, p9_by_source)}
_CLASSES = """
WITH RECURSIVE texts AS (
  SELECT Id, 'QuestionText' AS field, QuestionText AS x FROM oireachtas_questions UNION ALL SELECT Id, 'AnswerText', AnswerText FROM oireachtas_questions),
words AS (SELECT field, Id, regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+') AS w FROM texts WHERE x IS NOT NULL),
runs AS (SELECT DISTINCT field, Id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM words WHERE len(w) >= 12),
sizes AS (SELECT field, Id, count(*) AS n FROM runs GROUP BY ALL),
shared AS (SELECT field, a.Id AS a, b.Id AS b, count(*) AS k FROM runs a JOIN runs b USING (field, g) WHERE a.Id < b.Id GROUP BY ALL),
links AS (SELECT s.field, a, b FROM shared s JOIN sizes x ON x.field = s.field AND x.Id = a JOIN sizes y ON y.field = s.field AND y.Id = b WHERE 2 * k >= x.n + y.n - k),
both_ways AS (SELECT field, a, b FROM links UNION ALL SELECT field, b, a FROM links),
reach AS (SELECT field, a, b FROM both_ways UNION SELECT r.field, r.a, e.b FROM reach r JOIN both_ways e ON e.field = r.field AND e.a = r.b)
"""
ORACLES: dict[str, str] = {
    "p7_checks": "SELECT CAST(0 AS BIGINT) AS n_overfull, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_odd, CAST(count(*) FILTER (coalesce(text, '') = '') AS BIGINT) AS n_empty FROM documents",
    # all pairs that share a run of words; in reach on the small tables the check uses
    "p1_found": _CLASSES + "SELECT field, a AS id_a, b AS id_b FROM reach WHERE a < b",
    "p1_classes": _CLASSES
    + """
SELECT field, id, class_id, CAST(count(*) OVER (PARTITION BY field, class_id) AS BIGINT) AS n_texts FROM (
  SELECT s.field, s.Id AS id, least(s.Id, coalesce(min(r.b), s.Id)) AS class_id FROM sizes s LEFT JOIN reach r ON r.field = s.field AND r.a = s.Id GROUP BY s.field, s.Id)""",
}
