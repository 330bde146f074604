"""Profiling, ranking and issue-metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators import issues, profile, rank
from earshot.plans import fixtures as fx
from earshot.plans.catalog_text import (
    LENGTHS_SQL,
    MARKERS,
    SCORED_SQL,
    SQL_BLANK,
    SQL_LANGUAGE,
    fill,
    languages,
    text_lengths,
)
from earshot.plans.registry import Catalog

CATALOG = Catalog()
r = profile.rounded

for _field in ("topic", "severity", "sentiment"):
    CATALOG.add(
        f"freq_{_field}",
        lambda spark, sf_dir, c=_field: profile.frequency(fx.feedback(spark, sf_dir), c),
        f"WITH {fx.FEEDBACK_SQL} SELECT {_field}, count(*) AS count FROM feedback WHERE {_field} IS NOT NULL GROUP BY 1",
    )

CATALOG.add(
    "feedback_summary",
    lambda spark, sf_dir: profile.feedback_summary(fx.feedback(spark, sf_dir)),
    f"""WITH {fx.FEEDBACK_SQL} SELECT count(*) AS rows,
      count(DISTINCT contextual_subtopic) AS unique_contextual_subtopic,
      count(DISTINCT granular_subtopic) AS unique_granular_subtopic,
      count(*) FILTER (WHERE {fill(SQL_BLANK, 'comment')}) AS blank_feedback FROM feedback""",
)
CATALOG.add(
    "feedback_frequencies",
    lambda spark, sf_dir: profile.feedback_frequencies(fx.feedback(spark, sf_dir)),
    f"""WITH {fx.FEEDBACK_SQL}
    SELECT 'topic' AS field, topic AS value, count(*) AS count FROM feedback GROUP BY 2
    UNION ALL SELECT 'severity', severity, count(*) FROM feedback GROUP BY 2
    UNION ALL SELECT 'sentiment', sentiment, count(*) FROM feedback GROUP BY 2""",
)
CATALOG.add(
    "fragmentation_stats",
    lambda spark, sf_dir: r(profile.fragmentation_stats(fx.feedback(spark, sf_dir))),
    f"""WITH {fx.FEEDBACK_SQL}, g AS (SELECT count(*) AS n FROM feedback GROUP BY granular_subtopic),
      c AS (SELECT count(*) AS n FROM feedback GROUP BY contextual_subtopic)
    SELECT (SELECT count(*) FROM g) AS n_granular_labels, (SELECT count(*) FROM c) AS n_contextual_labels,
      (SELECT round(avg(n), 6) FROM g) AS rows_per_granular_mean,
      (SELECT round(median(n), 6) FROM g) AS rows_per_granular_median,
      (SELECT count(*) FILTER (WHERE n = 1) FROM g) AS granular_singletons,
      (SELECT round(avg(CAST(n = 1 AS INTEGER)) * 100, 6) FROM g) AS granular_singletons_pct,
      (SELECT count(*) FILTER (WHERE n <= 3) FROM g) AS granular_le_3_rows,
      (SELECT round(avg(CAST(n <= 3 AS INTEGER)) * 100, 6) FROM g) AS granular_le_3_rows_pct,
      (SELECT round(avg(n), 6) FROM c) AS rows_per_contextual_mean,
      (SELECT round(median(n), 6) FROM c) AS rows_per_contextual_median""",
)
CATALOG.add(
    "hierarchy_consistency",
    lambda spark, sf_dir: profile.hierarchy_consistency(fx.feedback(spark, sf_dir)),
    f"""WITH {fx.FEEDBACK_SQL}
    SELECT distinct_parents, count(*) AS granular_count FROM (
      SELECT granular_subtopic, count(DISTINCT contextual_subtopic) AS distinct_parents FROM feedback GROUP BY 1)
    GROUP BY 1""",
)


def _describe_sql(kind: str) -> str:
    return f"""SELECT '{kind}' AS kind, count({kind}) AS count, round(avg({kind}), 6) AS mean,
      round(stddev_samp({kind}), 6) AS std, round(CAST(min({kind}) AS DOUBLE), 6) AS min,
      round(quantile_cont({kind}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({kind}::DOUBLE, 0.9), 6) AS p90,
      round(quantile_cont({kind}::DOUBLE, 0.95), 6) AS p95, round(quantile_cont({kind}::DOUBLE, 0.99), 6) AS p99,
      round(CAST(max({kind}) AS DOUBLE), 6) AS max FROM lengths"""


CATALOG.add(
    "length_describe",
    lambda spark, sf_dir: r(profile.length_describe(text_lengths(spark, sf_dir))),
    f"WITH {LENGTHS_SQL} " + " UNION ALL ".join(_describe_sql(k) for k in ("chars", "words", "lines")),
)


def _hist_sql(values: str, cap: int, bins: int) -> str:
    return f"""v AS (SELECT CAST(least(x, {cap}) AS DOUBLE) AS x FROM ({values}) WHERE x IS NOT NULL),
      e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
    SELECT CAST(CASE WHEN lo = hi THEN {bins // 2 + 1}
        ELSE least(floor({bins} * (x - lo) / (hi - lo)) + 1, {bins}) END AS INTEGER) AS bin, count(*) AS count
    FROM v, e GROUP BY 1"""


CATALOG.add(
    "hist_chars",
    lambda spark, sf_dir: profile.histogram(text_lengths(spark, sf_dir), "chars", cap=1000, bins=60),
    f"WITH {LENGTHS_SQL}, {_hist_sql('SELECT chars AS x FROM lengths', 1000, 60)}",
)
CATALOG.add(
    "hist_words",
    lambda spark, sf_dir: profile.histogram(text_lengths(spark, sf_dir), "words", cap=200, bins=60),
    f"WITH {LENGTHS_SQL}, {_hist_sql('SELECT words AS x FROM lengths', 200, 60)}",
)
CATALOG.add(
    "hist_label_sizes",
    lambda spark, sf_dir: profile.histogram(
        profile.label_sizes(fx.feedback(spark, sf_dir), "granular_subtopic"), "size", cap=20, bins=20
    ),
    f"""WITH {fx.FEEDBACK_SQL},
    {_hist_sql('SELECT count(*) AS x FROM feedback GROUP BY granular_subtopic', 20, 20)}""",
)
CATALOG.add(
    "length_outliers",
    lambda spark, sf_dir: profile.length_outliers(text_lengths(spark, sf_dir)),
    f"""WITH {LENGTHS_SQL}
    SELECT count(*) FILTER (WHERE chars < 5) AS very_short, count(*) FILTER (WHERE chars > 500) AS very_long FROM lengths""",
)
CATALOG.add(
    "language_mix",
    lambda spark, sf_dir: r(profile.language_mix(languages(spark, sf_dir))),
    f"""WITH l AS (SELECT {fill(SQL_LANGUAGE, 'text')} AS language FROM documents)
    SELECT language, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM l), 6) AS pct,
      (SELECT round(100.0 * count(*) FILTER (WHERE language <> 'english') / count(*), 6) FROM l) AS non_english_pct
    FROM l GROUP BY language""",
)

# --------------------------------------------------------------------------- ranks and buckets

BUCKET_SQL = """CAST(greatest(((r - 1) * {q} + n - 2) // (n - 1) - 1, 0) AS INTEGER)"""


def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.feedback(spark, sf_dir)
    return df.select("row_id", rank.time_bucket(df).alias("time_bucket"))


CATALOG.add(
    "time_buckets",
    time_buckets,
    f"""WITH {fx.FEEDBACK_SQL}, ranked AS (
      SELECT row_id, row_number() OVER (ORDER BY created_at, row_id) AS r, count(*) OVER () AS n FROM feedback)
    SELECT row_id, {BUCKET_SQL.format(q=8)} AS time_bucket FROM ranked""",
)


def time_buckets_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.feedback(spark, sf_dir).drop("created_at")
    return df.select("row_id", rank.time_bucket(df).alias("time_bucket"))


CATALOG.add(
    "time_buckets_by_row",
    time_buckets_by_row,
    f"""WITH {fx.FEEDBACK_SQL}, ranked AS (
      SELECT row_id, row_number() OVER (ORDER BY row_id) AS r, count(*) OVER () AS n FROM feedback)
    SELECT row_id, {BUCKET_SQL.format(q=8)} AS time_bucket FROM ranked""",
)


def time_buckets_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("date")
    )
    return df.select(rank.time_bucket(df, n_buckets=12).alias("time_bucket"), "row_id").groupBy("time_bucket").agg(
        F.count("*").alias("n_rows"), F.min("row_id").alias("min_id"), F.max("row_id").alias("max_id")
    )


CATALOG.add(
    "time_buckets_orders",
    time_buckets_orders,
    f"""WITH ranked AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r,
      count(*) OVER () AS n FROM orders)
    SELECT time_bucket, count(*) AS n_rows, min(row_id) AS min_id, max(row_id) AS max_id
    FROM (SELECT row_id, {BUCKET_SQL.format(q=12)} AS time_bucket FROM ranked) GROUP BY time_bucket""",
)
CATALOG.add(
    "global_rank",
    lambda spark, sf_dir: rank.global_rank(
        fx.table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type", "event_id"]
    ),
    "SELECT event_id, event_type, row_number() OVER (ORDER BY event_type, event_id) AS rank FROM events",
)
CATALOG.add(
    "sample_anchors",
    lambda spark, sf_dir: rank.sample_ids(fx.vectors(spark, sf_dir), n=20),
    """SELECT vec_id AS row_id FROM embeddings ORDER BY md5('42|' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 20""",
)

# --------------------------------------------------------------------------- issue metrics


def _issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ids first: texts of noise rows are never cleaned.
    live = fx.clusters(spark, sf_dir).filter(F.col("cluster_id") != issues.NOISE)
    return profile.normalize_feedback(fx.feedback(spark, sf_dir).join(live, "row_id"), **MARKERS)


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.issue_cube(_issue_rows(spark, sf_dir), lexicon=fx.SIGNALS)


def issue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r(issues.issue_metrics(_cube(spark, sf_dir)))


METRICS_SQL = f"""{SCORED_SQL}, {fx.CLUSTERS_SQL}, live AS (
  SELECT s.*, c.cluster_id, c.parent_id FROM scored s JOIN clusters c ON c.row_id = s.row_id
  WHERE c.cluster_id <> -1 AND length(s.t) > 0), ranked AS (
  SELECT row_id, row_number() OVER (ORDER BY created_at, row_id) AS r, count(*) OVER () AS n FROM live), bucketed AS (
  SELECT live.*, {BUCKET_SQL.format(q=8)} AS time_bucket FROM live JOIN ranked ON ranked.row_id = live.row_id), last2 AS (
  SELECT cluster_id, n, row_number() OVER (PARTITION BY cluster_id ORDER BY time_bucket DESC) AS back
  FROM (SELECT cluster_id, time_bucket, count(*) AS n FROM bucketed GROUP BY ALL)), grown AS (
  SELECT cluster_id, count(*) AS seen, max(CASE WHEN back = 1 THEN n END) AS recent,
         max(CASE WHEN back = 2 THEN n END) AS previous FROM last2 WHERE back <= 2 GROUP BY cluster_id), growth AS (
  SELECT cluster_id,
    CASE WHEN seen < 2 THEN 0.0 ELSE (recent - previous)::DOUBLE / greatest(previous, 1) END AS growth_rate,
    CASE WHEN seen < 2 THEN 0.0 ELSE 1 / (1 + exp(-((recent - previous)::DOUBLE / greatest(previous, 1)))) END
      AS growth_score,
    CASE WHEN seen < 2 THEN 0 ELSE recent END AS recent_count FROM grown), parents AS (
  SELECT cluster_id, parent_id FROM (
    SELECT cluster_id, parent_id, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, parent_id) AS k
    FROM live GROUP BY cluster_id, parent_id) WHERE k = 1), base AS (
  SELECT cluster_id, count(*) AS count,
    sum(CAST(row_urgency AS DECIMAL(12, 9)))::DOUBLE / count(*) AS urgency_score,
    avg(CAST(severity = 'High' AS INTEGER)) AS pct_high, avg(CAST(sentiment = 'Negative' AS INTEGER)) AS pct_negative,
    avg(signal_payment) AS signal_payment_rate, avg(signal_trust) AS signal_trust_rate,
    avg(signal_blocker) AS signal_blocker_rate, avg(signal_religious) AS signal_religious_rate
  FROM live GROUP BY cluster_id), metrics AS (
  SELECT b.cluster_id, CAST(p.parent_id AS INTEGER) AS parent_id, b.count, b.count::DOUBLE / t.n AS share,
    b.urgency_score, g.growth_rate, g.growth_score,
    100.0::DOUBLE * (0.55::DOUBLE * b.urgency_score + 0.25::DOUBLE * g.growth_score + 0.20::DOUBLE *
      least(greatest(ln(1 + b.count) / ln(1 + t.n), 0.0), 1.0)) AS priority_score,
    CAST(g.recent_count AS BIGINT) AS recent_count, b.pct_high, b.pct_negative, b.signal_payment_rate,
    b.signal_trust_rate, b.signal_blocker_rate, b.signal_religious_rate,
    CASE WHEN why = '' THEN 'frequency-driven' ELSE why END AS explain_reasons
  FROM (SELECT b.*, concat_ws('; ',
      CASE WHEN b.pct_high >= 0.2 THEN 'high severity concentration' END,
      CASE WHEN b.pct_negative >= 0.5 THEN 'mostly negative sentiment' END,
      CASE WHEN b.signal_payment_rate >= 0.2 THEN 'payment/subscription risk' END,
      CASE WHEN b.signal_blocker_rate >= 0.15 THEN 'blocker/crash language' END,
      CASE WHEN b.signal_trust_rate >= 0.2 AND b.signal_religious_rate >= 0.2 THEN 'religious trust sensitivity' END,
      CASE WHEN gg.growth_rate > 0.25 THEN 'rapid recent growth' END) AS why
    FROM base b JOIN growth gg USING (cluster_id)) b
  JOIN growth g ON g.cluster_id = b.cluster_id JOIN parents p ON p.cluster_id = b.cluster_id,
  (SELECT greatest(count(*), 1) AS n FROM live) t)"""

_ROUNDED = (
    "share", "urgency_score", "growth_rate", "growth_score", "priority_score", "pct_high", "pct_negative",
    "signal_payment_rate", "signal_trust_rate", "signal_blocker_rate", "signal_religious_rate",
)
_METRIC_LIST = (
    "cluster_id, parent_id, count, recent_count, explain_reasons, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED)
)

CATALOG.add("issue_metrics", issue_metrics, f"WITH {METRICS_SQL} SELECT {_METRIC_LIST} FROM metrics")
CATALOG.add(
    "issue_metrics_top15",
    lambda spark, sf_dir: r(
        issues.by_priority(issues.issue_metrics(_cube(spark, sf_dir)))
        .limit(15)
        .select("cluster_id", "priority_score", "urgency_score", "growth_rate", "count", "explain_reasons")
    ),
    f"""WITH {METRICS_SQL} SELECT cluster_id, round(priority_score, 6) AS priority_score,
      round(urgency_score, 6) AS urgency_score, round(growth_rate, 6) AS growth_rate, count, explain_reasons
    FROM (SELECT * FROM metrics ORDER BY priority_score DESC, count DESC, cluster_id LIMIT 15)""",
)
CATALOG.add(
    "cluster_growth",
    lambda spark, sf_dir: r(issues.growth(_cube(spark, sf_dir))),
    f"""WITH {METRICS_SQL} SELECT cluster_id, round(growth_rate, 6) AS growth_rate,
      round(growth_score, 6) AS growth_score, CAST(recent_count AS BIGINT) AS recent_count FROM growth""",
)
CATALOG.add(
    "parent_metrics",
    lambda spark, sf_dir: r(issues.parent_metrics(issues.issue_metrics(_cube(spark, sf_dir)))),
    f"""WITH {METRICS_SQL} SELECT parent_id, CAST(sum(count) AS BIGINT) AS total_count,
      round(avg(priority_score), 6) AS mean_priority, round(max(priority_score), 6) AS max_priority,
      round(avg(urgency_score), 6) AS mean_urgency, round(avg(growth_rate), 6) AS mean_growth,
      count(*) FILTER (WHERE priority_score >= 70) AS high_priority_clusters FROM metrics GROUP BY parent_id""",
)


def modal_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent language bucket number per cluster: a parent that varies inside a cluster."""
    rows = fx.clusters(spark, sf_dir).join(fx.feedback(spark, sf_dir).select("row_id", "comment"), "row_id")
    small = rows.select("cluster_id", (F.length("comment") % 7).alias("parent_id"))
    return issues.modal_parent(small.groupBy("cluster_id", "parent_id").agg(F.count("*").alias("n")))


CATALOG.add(
    "modal_parent",
    modal_parent,
    f"""WITH {fx.FEEDBACK_SQL}, {fx.CLUSTERS_SQL}, counts AS (
      SELECT c.cluster_id, length(f.comment) % 7 AS parent_id, count(*) AS n
      FROM clusters c JOIN feedback f ON f.row_id = c.row_id GROUP BY ALL)
    SELECT cluster_id, CAST(parent_id AS INTEGER) AS parent_id FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, parent_id) AS k FROM counts) WHERE k = 1""",
)
CATALOG.add(
    "join_clusters",
    lambda spark, sf_dir: fx.feedback(spark, sf_dir)
    .join(fx.clusters(spark, sf_dir), "row_id")
    .select("row_id", "topic", "severity", "sentiment", "cluster_id", "parent_id"),
    f"""WITH {fx.FEEDBACK_SQL}, {fx.CLUSTERS_SQL}
    SELECT f.row_id, topic, severity, sentiment, CAST(cluster_id AS INTEGER) AS cluster_id,
      CAST(parent_id AS INTEGER) AS parent_id FROM feedback f JOIN clusters c ON c.row_id = f.row_id""",
)
CATALOG.add(
    "top_clusters",
    lambda spark, sf_dir: fx.clusters(spark, sf_dir)
    .filter(F.col("cluster_id") != -1)
    .groupBy("cluster_id")
    .agg(F.count("*").alias("size"))
    .orderBy(F.desc("size"), "cluster_id")
    .limit(10),
    f"""WITH {fx.CLUSTERS_SQL} SELECT CAST(cluster_id AS INTEGER) AS cluster_id, count(*) AS size FROM clusters
    WHERE cluster_id <> -1 GROUP BY 1 ORDER BY size DESC, 1 LIMIT 10""",
)
