"""Comment, cluster and record views over the generated tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import lexicons as lx
from earshot.operators import explore

# Words that occur in the generated texts and that Java and RE2 count alike.
SIGNALS = {"payment": ("license", "token"), "trust": ("that",), "blocker": ("apache",), "religious": ("was",)}
STRONG_MARKERS = ("der",)
WEAK_MARKERS = ("the", "that", "was")
TAGS = {
    "Ads Sensitivity": ("token",),
    "Monetization Risk": ("license",),
    "Trust & Authenticity": ("apache",),
    "Quran / Tafseer": ("der",),
    "Prayer & Worship": ("was",),
    "Performance Risk": ("that",),
    "Search & UX": ("the",),
}


# Text tables and their keys.
_SPREAD = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table.  Rows of the two text tables are dealt by key.

    Their files hold one row group, hence one split, each, and what the catalogue does with texts costs far
    more than moving them once.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(_SPREAD[name]) if name in _SPREAD else df


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    toxic, quality = F.col("toxic"), F.col("quality")
    return (
        docs.join(labels, "doc_id", "left")
        .withColumn("severity", F.when(toxic == 1, "High").when(quality == 0, "Medium").otherwise("Low"))
        .withColumn("sentiment", F.when(toxic == 1, "Negative").when(quality == 1, "Positive").otherwise("Neutral"))
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"))
    return (
        _labelled(spark, sf_dir)
        .join(times, "doc_id", "left")
        .select(
            F.col("doc_id").alias("row_id"),
            F.col("text").alias("comment"),
            F.col("source").alias("topic"),
            F.concat_ws(":", "lang", "source").alias("contextual_subtopic"),
            F.concat_ws("/", "lang", (F.col("n_chars") % 50).cast("string")).alias("granular_subtopic"),
            "severity",
            "sentiment",
            "created_at",
        )
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id")
        .join(label, "doc_id", "left")
        .select(
            F.col("doc_id").alias("row_id"),
            F.coalesce(F.col("label"), F.lit(-1)).alias("cluster_id"),
            F.coalesce(F.col("label") % 3, F.lit(-1)).alias("parent_id"),
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, embedding, cluster_id, masked_id`` (every fifth label turned into noise)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        "embedding",
        F.col("label").alias("cluster_id"),
        F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("label")).alias("masked_id"),
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return _labelled(spark, sf_dir).select(
        (doc + 1).alias("record_id"),
        F.when(doc % 3 == 0, "General Review").otherwise("Suggestion").alias("classification"),
        F.col("source").alias("topic"),
        F.col("lang").alias("raw_topic"),
        F.when(doc % 10 != 0, F.concat_ws("-p", "lang", (F.col("n_chars") % 5).cast("string"))).alias("parent_issue"),
        F.when(doc % 25 != 7, F.concat_ws("-c", "lang", (F.col("n_chars") % 20).cast("string"))).alias("child_issue"),
        "severity",
        "sentiment",
        F.col("text").alias("original_feedback"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.derive_records(raw_records(spark, sf_dir), TAGS)


# --------------------------------------------------------------------------- SQL twins

_LABELLED = """
  SELECT d.*,
         CASE WHEN l.toxic = 1 THEN 'High' WHEN l.quality = 0 THEN 'Medium' ELSE 'Low' END AS severity,
         CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive' ELSE 'Neutral' END AS sentiment
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

FEEDBACK_SQL = f"""feedback AS (
  SELECT b.doc_id AS row_id, b.text AS comment, b.source AS topic, b.lang || ':' || b.source AS contextual_subtopic,
         b.lang || '/' || (b.n_chars % 50) AS granular_subtopic, b.severity, b.sentiment, e.ts AS created_at
  FROM ({_LABELLED}) b LEFT JOIN events e ON e.event_id = b.doc_id)"""

CLUSTERS_SQL = """clusters AS (
  SELECT d.doc_id AS row_id, coalesce(e.label, -1) AS cluster_id, coalesce(e.label % 3, -1) AS parent_id
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

VECTORS_SQL = """vectors AS (
  SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v, label AS cluster_id,
         CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS masked_id
  FROM embeddings)"""


def sql_word(text: str, words) -> str:
    return f"regexp_matches({text}, '{lx.ascii_word_pattern(words)}')"


_TAG_LIST = ", ".join(f"CASE WHEN {sql_word('corpus', words)} THEN '{tag}' END" for tag, words in TAGS.items())

RAW_RECORDS_SQL = f"""raw_records AS (
  SELECT b.doc_id + 1 AS record_id,
         CASE WHEN b.doc_id % 3 = 0 THEN 'General Review' ELSE 'Suggestion' END AS classification,
         b.source AS topic, b.lang AS raw_topic,
         CASE WHEN b.doc_id % 10 <> 0 THEN b.lang || '-p' || (b.n_chars % 5) END AS parent_issue,
         CASE WHEN b.doc_id % 25 <> 7 THEN b.lang || '-c' || (b.n_chars % 20) END AS child_issue,
         b.severity, b.sentiment, b.text AS original_feedback
  FROM ({_LABELLED}) b)"""

RECORDS_SQL = f"""{RAW_RECORDS_SQL}, filled AS (
  SELECT record_id, classification, topic, raw_topic, coalesce(parent_issue, '{lx.UNASSIGNED_PARENT}') AS parent_issue,
         child_issue, severity, sentiment, coalesce(original_feedback, '') AS original_feedback
  FROM raw_records), found AS (
  SELECT *, list_filter([{_TAG_LIST}], lambda x: x IS NOT NULL) AS hits
  FROM (SELECT *, concat_ws(' ', topic, parent_issue, child_issue, original_feedback) AS corpus FROM filled)), tagged AS (
  SELECT * EXCLUDE (corpus, hits),
         CASE WHEN len(hits) > 0 THEN hits ELSE ['{lx.DEFAULT_TAG}'] END AS risk_tags FROM found), records AS (
  SELECT *, risk_tags[1] AS risk_primary,
         CAST(CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 1 END
            + CASE sentiment WHEN 'Positive' THEN 0 WHEN 'Neutral' THEN 1 WHEN 'Negative' THEN 2 ELSE 1 END
            + CASE WHEN list_contains(risk_tags, '{lx.TRUST_TAG}') THEN 2 ELSE 1 END AS INTEGER) AS priority_score
  FROM tagged)"""
