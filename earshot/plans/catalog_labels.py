"""Term, representative and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import lexicons as lx
from earshot.functions import text as tx
from earshot.operators import labels, profile
from earshot.plans import fixtures as fx
from earshot.plans.catalog_text import SQL_CLEAN, fill
from earshot.plans.catalog_vectors import centroids_sql
from earshot.plans.registry import Catalog

CATALOG = Catalog()
r = profile.rounded


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fx.feedback(spark, sf_dir).withColumn("text_clean", tx.clean_text(F.col("comment")))
    return text.join(fx.clusters(spark, sf_dir), "row_id")


def _rows_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).join(fx.vectors(spark, sf_dir).select("row_id", "embedding"), "row_id")


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(set(words))) + "]"


TERMS_SQL = f"""{fx.FEEDBACK_SQL}, {fx.CLUSTERS_SQL}, live AS (
      SELECT c.cluster_id, f.*, {fill(SQL_CLEAN, 'f.comment')} AS t FROM feedback f JOIN clusters c ON c.row_id = f.row_id
      WHERE c.cluster_id <> -1), words AS (
      SELECT cluster_id, list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'),
        lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND NOT list_contains({_quoted(lx.STOP_WORDS)}, w)) AS k FROM live), tf AS (
      SELECT cluster_id, term, count(*) AS tf FROM (
        SELECT cluster_id, unnest(k) AS term FROM words
        UNION ALL SELECT cluster_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) FROM words)
      GROUP BY ALL), kept AS (
      SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), w AS (
      SELECT cluster_id, tf.term, tf * (ln((1 + (SELECT count(DISTINCT cluster_id) FROM live)) / (1.0::DOUBLE + df)) + 1) AS w
      FROM tf JOIN kept ON kept.term = tf.term), weighted AS (
      SELECT cluster_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id)), 12) AS weight FROM w), terms AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS rank FROM weighted
        WHERE weight > 0 AND NOT list_has_any(string_split(term, ' '), {_quoted(lx.EXTRA_STOP_WORDS)})) WHERE rank <= 10)"""

CATALOG.add(
    "ctfidf_terms",
    lambda spark, sf_dir: r(labels.cluster_terms(_rows(spark, sf_dir))),
    f"""WITH {TERMS_SQL} SELECT CAST(cluster_id AS INTEGER) AS cluster_id, CAST(rank AS INTEGER) AS rank, term,
      round(weight, 6) AS weight FROM terms""",
)


def _mmr_sql(k: int = 8, balance: float = 0.5) -> str:
    """One common table per pick, for the SQL check."""
    parts = [
        fx.VECTORS_SQL.replace(
            "CAST(embedding AS DOUBLE[]) AS v",
            "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product("
            "CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v",
        ),
        centroids_sql("cluster_id", "centers"),
        """mmr_rows AS MATERIALIZED (SELECT v.row_id, v.cluster_id, v.v, c.size, list_dot_product(v.v, c.c) AS closeness
      FROM vectors v JOIN centers c ON c.cluster_id = v.cluster_id)""",
        f"""s1 AS MATERIALIZED (SELECT row_id, cluster_id, v, closeness, -2.0::DOUBLE AS nearest,
        round(closeness, 12) AS score FROM mmr_rows WHERE size > {k})""",
    ]
    for i in range(1, k + 1):
        parts.append(
            f"""p{i} AS MATERIALIZED (SELECT cluster_id, row_id, v FROM (SELECT *, row_number() OVER (
        PARTITION BY cluster_id ORDER BY score DESC, row_id) AS q FROM s{i}) WHERE q = 1)"""
        )
        if i < k:
            parts.append(
                f"""s{i + 1} AS MATERIALIZED (SELECT row_id, cluster_id, v, closeness, nearest,
        round({balance}::DOUBLE * closeness - {1 - balance}::DOUBLE * nearest, 12) AS score FROM (
          SELECT s.row_id, s.cluster_id, s.v, s.closeness, greatest(s.nearest, list_dot_product(s.v, p.v)) AS nearest
          FROM s{i} s JOIN p{i} p ON p.cluster_id = s.cluster_id AND p.row_id <> s.row_id))"""
            )
    picks = " UNION ALL ".join(f"SELECT cluster_id, {i} AS position, row_id FROM p{i}" for i in range(1, k + 1))
    parts.append(
        f"""representatives AS ({picks} UNION ALL SELECT cluster_id,
        row_number() OVER (PARTITION BY cluster_id ORDER BY row_id), row_id FROM mmr_rows WHERE size <= {k})"""
    )
    return ", ".join(parts)


CATALOG.add(
    "mmr_representatives",
    lambda spark, sf_dir: labels.representatives(fx.vectors(spark, sf_dir)),
    f"""WITH {_mmr_sql()} SELECT cluster_id, CAST(position AS INTEGER) AS position, row_id FROM representatives""",
)
CATALOG.add(
    "cluster_mix",
    lambda spark, sf_dir: labels.cluster_mix(_rows(spark, sf_dir), "sentiment").withColumn("field", F.lit("sentiment")),
    f"""WITH {fx.FEEDBACK_SQL}, {fx.CLUSTERS_SQL} SELECT CAST(cluster_id AS INTEGER) AS cluster_id, sentiment AS value,
      count(*) AS n, 'sentiment' AS field FROM feedback JOIN clusters USING (row_id) WHERE cluster_id <> -1 GROUP BY 1, 2""",
)


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.cluster_contexts(_rows_with_vectors(spark, sf_dir))


LABELS_SQL = f"""WITH {TERMS_SQL}, {_mmr_sql()}, sized AS (SELECT cluster_id, count(*) AS size FROM live GROUP BY 1), short AS (
      SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank <= 4) AS label,
        string_agg(term, ', ' ORDER BY rank) AS top_terms FROM terms GROUP BY cluster_id), mixes AS (
      SELECT cluster_id, 'sentiment' AS field, sentiment AS value, count(*) AS n FROM live GROUP BY ALL
      UNION ALL SELECT cluster_id, 'severity', severity, count(*) FROM live GROUP BY ALL), tops AS (
      SELECT cluster_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, field
        ORDER BY n DESC, value) AS q FROM mixes) WHERE q = 1), term_labels AS (
      SELECT s.cluster_id, coalesce(t.label, '(no terms)') AS label,
        'Cluster of ' || s.size || ' feedback comments centered on: ' || coalesce(t.label, '(no terms)') || '. Top sentiment: '
          || a.value || '; top severity: ' || b.value || '.' AS description, f.comment AS example_quote,
        '' AS suspected_root_cause, 'terms' AS label_mode, s.size, coalesce(t.top_terms, '') AS top_terms
      FROM sized s LEFT JOIN short t ON t.cluster_id = s.cluster_id
      JOIN tops a ON a.cluster_id = s.cluster_id AND a.field = 'sentiment'
      JOIN tops b ON b.cluster_id = s.cluster_id AND b.field = 'severity'
      JOIN representatives p ON p.cluster_id = s.cluster_id AND p.position = 1 JOIN feedback f ON f.row_id = p.row_id)"""
_LABEL_COLUMNS = """CAST(cluster_id AS INTEGER) AS cluster_id, label, description, example_quote, suspected_root_cause,
      label_mode"""
CATALOG.add(
    "term_labels",
    lambda spark, sf_dir: labels.term_labels(contexts(spark, sf_dir)),
    f"{LABELS_SQL} SELECT {_LABEL_COLUMNS} FROM term_labels",
)
CATALOG.add(
    "label_table",
    lambda spark, sf_dir: labels.label_table(contexts(spark, sf_dir)),
    f"{LABELS_SQL} SELECT {_LABEL_COLUMNS}, size, top_terms FROM term_labels",
)
CATALOG.add(
    "parent_labels",
    lambda spark, sf_dir: labels.label_parents(
        fx.clusters(spark, sf_dir), labels.label_table(contexts(spark, sf_dir))
    ),
    f"""{LABELS_SQL}, per AS (SELECT parent_id, cluster_id, count(*) AS n FROM clusters WHERE parent_id <> -1 GROUP BY ALL),
      ranked AS (SELECT p.*, l.label, row_number() OVER (PARTITION BY parent_id ORDER BY l.size DESC, p.cluster_id) AS q
        FROM per p LEFT JOIN term_labels l ON l.cluster_id = p.cluster_id)
    SELECT CAST(parent_id AS INTEGER) AS parent_id, CAST(sum(n) AS BIGINT) AS rows, count(label) AS n_clusters,
      coalesce(string_agg(label, ' · ' ORDER BY q) FILTER (WHERE q <= 3), '(unlabeled)') AS label
    FROM ranked GROUP BY parent_id""",
)


def cluster_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = lambda name: F.array_join(F.transform(name, lambda m: F.concat_ws("=", m.value, m.n.cast("string"))), ", ")
    return contexts(spark, sf_dir).select(
        "cluster_id",
        "size",
        F.array_join("representatives", "\n").alias("representatives"),
        F.array_join("top_terms", ", ").alias("top_terms"),
        mix("sentiment_mix").alias("sentiment_mix"),
        mix("severity_mix").alias("severity_mix"),
    )


CATALOG.add(
    "cluster_contexts",
    cluster_contexts,
    f"""{LABELS_SQL}, quotes AS (SELECT p.cluster_id, string_agg(f.comment, chr(10) ORDER BY p.position) AS representatives
        FROM representatives p JOIN feedback f ON f.row_id = p.row_id GROUP BY 1), texts AS (
      SELECT cluster_id, field, string_agg(value || '=' || n, ', ' ORDER BY n DESC, value) AS mix FROM mixes GROUP BY 1, 2)
    SELECT CAST(l.cluster_id AS INTEGER) AS cluster_id, l.size, q.representatives, l.top_terms,
      a.mix AS sentiment_mix, b.mix AS severity_mix
    FROM term_labels l JOIN quotes q ON q.cluster_id = l.cluster_id
      JOIN texts a ON a.cluster_id = l.cluster_id AND a.field = 'sentiment'
      JOIN texts b ON b.cluster_id = l.cluster_id AND b.field = 'severity'""",
)
_INTRO, _ASK = (part.replace("'", "''") for part in labels.prompt_frame("a consumer app"))
CATALOG.add(
    "label_prompts",
    lambda spark, sf_dir: labels.label_prompts(contexts(spark, sf_dir)),
    f"""{LABELS_SQL}, quotes AS (
        SELECT p.cluster_id, string_agg('- ' || substr(f.comment, 1, 300), chr(10) ORDER BY p.position) AS quotes
        FROM representatives p JOIN feedback f ON f.row_id = p.row_id GROUP BY 1), texts AS (
      SELECT cluster_id, field, string_agg(value || '=' || n, ', ' ORDER BY n DESC, value) AS mix FROM mixes GROUP BY 1, 2)
    SELECT CAST(l.cluster_id AS INTEGER) AS cluster_id, '{_INTRO}' || 'Comments in the group: ' || l.size
      || chr(10) || 'Frequent terms: ' || coalesce(nullif(l.top_terms, ''), '(none)') || chr(10) || 'Sentiment: ' || a.mix
      || chr(10) || 'Severity: ' || b.mix || chr(10) || 'Typical comments:' || chr(10) || q.quotes || '{_ASK}' AS prompt
    FROM term_labels l JOIN quotes q ON q.cluster_id = l.cluster_id
      JOIN texts a ON a.cluster_id = l.cluster_id AND a.field = 'sentiment'
      JOIN texts b ON b.cluster_id = l.cluster_id AND b.field = 'severity'""",
)


def parse_label_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made from the records: fenced, plain, with a key missing, or cut short."""
    rows = fx.raw_records(spark, sf_dir).select(F.col("record_id").alias("cluster_id"), "raw_topic", "topic")
    full = F.to_json(F.struct(F.col("raw_topic").alias("label"), F.col("topic").alias("description"),
                              F.lit("a \"quote\"").alias("example_quote"), F.lit("cause").alias("suspected_root_cause")))
    few = F.to_json(F.struct(F.col("raw_topic").alias("label")))
    kind = F.col("cluster_id") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 1, full)
        .when(kind == 2, few)
        .otherwise(F.substring(full, 1, 12))
    )
    return labels.parse_label_replies(rows.select("cluster_id", reply.alias("reply")))


CATALOG.add(
    "parse_label_json",
    parse_label_json,
    f"""WITH {fx.RAW_RECORDS_SQL}, k AS (SELECT record_id AS cluster_id, record_id % 4 AS kind, * FROM raw_records)
    SELECT cluster_id, CASE WHEN kind < 3 THEN raw_topic END AS label,
      CASE WHEN kind < 2 THEN topic WHEN kind = 2 THEN '' END AS description,
      CASE WHEN kind < 2 THEN 'a "quote"' WHEN kind = 2 THEN '' END AS example_quote,
      CASE WHEN kind < 2 THEN 'cause' WHEN kind = 2 THEN '' END AS suspected_root_cause,
      'service' AS label_mode, kind = 3 AS unreadable FROM k""",
)
