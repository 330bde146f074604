"""Queries over classified records."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import lexicons as lx
from earshot.operators import explore, filters, keywords, profile, rank, sketches
from earshot.plans import fixtures as fx
from earshot.plans.catalog_text import EVIDENCE_SQL, SQL_COLLAPSE, fill, sql_clip
from earshot.plans.registry import Catalog
from earshot.sources.shared import new_path

CATALOG = Catalog()
r = profile.rounded
R = fx.RECORDS_SQL
IDS = ("record_id", "severity", "sentiment", "risk_primary")
PINS = (
    ("topic", "src1"),
    ("raw_topic", "en"),
    ("parent_issue", "en-p1"),
    ("child_issue", "fr-c3"),
    ("risk_primary", "Search & UX"),
    ("risk_primary", "Trust & Authenticity"),
    ("topic", "no such topic"),
)


def _view(spec: filters.FilterSpec):
    return lambda spark, sf_dir: filters.apply_filters(fx.records(spark, sf_dir), spec).select(*IDS)


def _where(condition: str) -> str:
    return f"WITH {R} SELECT {', '.join(IDS)} FROM records WHERE {condition}"


def _any_tag(*tags: str) -> str:
    return "list_has_any(risk_tags, [" + ", ".join(f"'{t}'" for t in tags) + "])"


def _drill_sql(drill: dict) -> str:
    parts = []
    for name, values in drill.items():
        if name == "risk_primary":
            parts.append(_any_tag(*values))
        else:
            parts.append(f"{name} IN (" + ", ".join(f"'{v}'" for v in values) + ")")
    return " AND ".join(parts) or "true"


_DRILL = {"severity": ["Low", "Medium"], "raw_topic": ["en", "fr"], "topic": [], "unknown": ["x"]}
CATALOG.add(
    "drill_filter",
    _view(filters.FilterSpec(drill=_DRILL)),
    _where("severity IN ('Low', 'Medium') AND raw_topic IN ('en', 'fr')"),
)
CATALOG.add(
    "tag_filter",
    _view(filters.FilterSpec(drill={"risk_primary": ["Ads Sensitivity", "Trust & Authenticity"]})),
    _where(_any_tag("Ads Sensitivity", "Trust & Authenticity")),
)
CATALOG.add(
    "toggle_filters",
    _view(filters.FilterSpec(only_negative=True, only_high=True, only_parented=True)),
    _where(f"sentiment = 'Negative' AND severity = 'High' AND parent_issue <> '{lx.UNASSIGNED_PARENT}'"),
)
CATALOG.add(
    "toggle_trust", _view(filters.FilterSpec(only_trust=True)), _where(f"list_contains(risk_tags, '{lx.TRUST_TAG}')")
)
_SEARCH = " OR ".join(f"coalesce(contains(lower({f}), '{{q}}'), false)" for f in filters.SEARCH_FIELDS)
CATALOG.add("keyword_search", _view(filters.FilterSpec(keyword=" License ")), _where(_SEARCH.replace("{q}", "license")))
_SEARCH_RE = " OR ".join(f"coalesce(regexp_matches(lower({f}), 'en-p[12]'), false)" for f in filters.SEARCH_FIELDS)
CATALOG.add("keyword_search_regex", _view(filters.FilterSpec(keyword="en-p[12]", regex=True)), _where(_SEARCH_RE))
for _key, _name in {
    "preset_all": "All Feedback",
    "preset_trust": "Trust Escalations",
    "preset_money": "Subscription Pain",
    "preset_critical": "Quran/Tafseer Critical",
    "preset_ads": "Ads Sensitivity",
    "preset_performance": "Performance Critical",
}.items():
    CATALOG.add(
        _key, _view(filters.FilterSpec(drill=filters.preset(_name))), _where(_drill_sql(filters.preset(_name)))
    )
for _key, _name in {
    "quick_filter_negative": "Negative Only",
    "quick_filter_high": "High Severity Only",
    "quick_filter_medium_plus": "Medium+ Severity",
    "quick_filter_suggestions": "Suggestions Only",
    "quick_filter_reviews": "Reviews Only",
}.items():
    CATALOG.add(
        _key,
        _view(filters.FilterSpec(drill=filters.quick_filter(_name))),
        _where(_drill_sql(filters.quick_filter(_name))),
    )
_SCOPED = filters.scope_filter({"raw_topic": ["de"], "severity": ["Low"]}, "topic", "src2")
CATALOG.add("scope_filter", _view(filters.FilterSpec(drill=_SCOPED)), _where("severity = 'Low' AND topic = 'src2'"))
_COMPOSED = filters.FilterSpec(
    keyword="the", only_parented=True, drill={"severity": ["Low", "Medium"], "risk_primary": ["Performance Risk"]}
)
_COMPOSED_SQL = (
    f"({_SEARCH.replace('{q}', 'the')}) AND parent_issue <> '{lx.UNASSIGNED_PARENT}' "
    f"AND severity IN ('Low', 'Medium') AND {_any_tag('Performance Risk')}"
)
CATALOG.add("filtered_view", _view(_COMPOSED), _where(_COMPOSED_SQL))


def _indexed(spec: filters.FilterSpec):
    """The view through a keyword index written for the records."""

    def query(spark, sf_dir):
        index = keywords.build_index(
            fx.records(spark, sf_dir), new_path(spark, "keywords"), blocks=64, order_by=["raw_topic", "topic", "record_id"]
        )
        return keywords.search(spark, index, spec).select(*IDS)

    return query


CATALOG.add("keyword_search_indexed", _indexed(filters.FilterSpec(keyword=" License ")), _where(_SEARCH.replace("{q}", "license")))
CATALOG.add("filtered_view_indexed", _indexed(_COMPOSED), _where(_COMPOSED_SQL))
CATALOG.add(
    "view_share",
    lambda spark, sf_dir: r(explore.view_share(fx.records(spark, sf_dir), _COMPOSED)),
    f"""WITH {R} SELECT count(*) FILTER (WHERE {_COMPOSED_SQL}) AS in_view, count(*) AS total,
      round(count(*) FILTER (WHERE {_COMPOSED_SQL}) * 100.0 / count(*), 6) AS pct FROM records""",
)
CATALOG.add(
    "name_search",
    lambda spark, sf_dir: filters.name_search(fx.records(spark, sf_dir), "En"),
    f"""WITH {R}, names AS (
      SELECT 0 AS ordinal, 'raw_topic' AS level, raw_topic AS value FROM records
      UNION SELECT 1, 'child_issue', child_issue FROM records UNION SELECT 2, 'parent_issue', parent_issue FROM records
      UNION SELECT 3, 'topic', topic FROM records), hits AS (SELECT * FROM names WHERE contains(lower(value), 'en'))
    SELECT CAST(ordinal AS INTEGER) AS ordinal, level, value FROM hits h
    WHERE (SELECT count(*) FROM hits b WHERE b.ordinal < h.ordinal) < 50 ORDER BY ordinal, value LIMIT 30""",
)
CATALOG.add(
    "filter_options",
    lambda spark, sf_dir: filters.filter_options(fx.records(spark, sf_dir)),
    f"WITH {R} "
    + " UNION ".join(
        f"SELECT '{f}' AS field, {f} AS value FROM records WHERE {f} IS NOT NULL" for f in filters.FILTER_FIELDS
    ),
)
CATALOG.add(
    "evidence_table", lambda spark, sf_dir: explore.evidence_table(fx.records(spark, sf_dir)), EVIDENCE_SQL
)
CATALOG.add(
    "record_lookup",
    lambda spark, sf_dir: explore.record_lookup(fx.records(spark, sf_dir), 17),
    f"""WITH {R} SELECT record_id, classification, topic, severity, sentiment, parent_issue, child_issue, raw_topic,
      array_to_string(risk_tags, ', ') AS tags, original_feedback FROM records WHERE record_id = 17""",
)

# --------------------------------------------------------------------------- counts

CATALOG.add(
    "kpis",
    lambda spark, sf_dir: explore.kpis(fx.records(spark, sf_dir)),
    f"""WITH {R} SELECT count(*) AS total, count(*) FILTER (WHERE sentiment = 'Negative') AS negative,
      count(*) FILTER (WHERE severity = 'High') AS high, count(*) FILTER (WHERE list_contains(risk_tags, '{lx.TRUST_TAG}')) AS trust,
      count(*) FILTER (WHERE list_contains(risk_tags, '{lx.MONEY_TAG}')) AS money FROM records""",
)
CATALOG.add(
    "topic_volume",
    lambda spark, sf_dir: r(explore.topic_volume(fx.records(spark, sf_dir))),
    f"""WITH {R} SELECT raw_topic, topic, count(*) AS count,
      round(avg(CAST(sentiment = 'Negative' AS INTEGER)), 6) AS negative_rate,
      round(avg(CAST(severity = 'High' AS INTEGER)), 6) AS high_severity_rate,
      {sql_clip('topic', 38)} || ' (' || count(*) || ')' AS label FROM records GROUP BY raw_topic, topic""",
)
CATALOG.add(
    "taxonomy_tree",
    lambda spark, sf_dir: r(explore.taxonomy_tree(fx.records(spark, sf_dir))),
    f"""WITH {R}, known AS (SELECT parent_issue, child_issue, CAST(sentiment = 'Negative' AS INTEGER) AS negative
      FROM records WHERE child_issue IS NOT NULL)
    SELECT parent_issue, child_issue, 'child' AS level, count(*) AS count, round(avg(negative), 6) AS negative_rate
    FROM known GROUP BY parent_issue, child_issue
    UNION ALL SELECT parent_issue, NULL, 'parent', count(*), round(avg(negative), 6) FROM known GROUP BY parent_issue""",
)
CATALOG.add(
    "top_topics",
    lambda spark, sf_dir: explore.top_values(fx.records(spark, sf_dir), "topic", 12),
    f"WITH {R} SELECT topic, count(*) AS count FROM records GROUP BY topic ORDER BY count DESC, topic LIMIT 12",
)
CATALOG.add(
    "top_parents",
    lambda spark, sf_dir: explore.top_values(fx.records(spark, sf_dir), "parent_issue", 15),
    f"""WITH {R} SELECT parent_issue, count(*) AS count FROM records GROUP BY parent_issue
    ORDER BY count DESC, parent_issue LIMIT 15""",
)
CATALOG.add(
    "top_children",
    lambda spark, sf_dir: explore.top_children(fx.records(spark, sf_dir)),
    f"""WITH {R} SELECT parent_issue, child_issue, count(*) AS count, {sql_clip('child_issue', 55)} AS label
    FROM records WHERE child_issue IS NOT NULL
    GROUP BY parent_issue, child_issue ORDER BY count DESC, parent_issue, child_issue LIMIT 30""",
)
CATALOG.add(
    "pain_map",
    lambda spark, sf_dir: explore.pain_map(fx.records(spark, sf_dir)),
    f"WITH {R} SELECT parent_issue, "
    + ", ".join(f"count(*) FILTER (WHERE severity || ' · ' || sentiment = '{c}') AS \"{c}\"" for c in explore.PAIN_CELLS)
    + ", count(*) AS total FROM records GROUP BY parent_issue",
)
CATALOG.add(
    "drill_detail",
    lambda spark, sf_dir: r(explore.drill_detail(fx.records(spark, sf_dir), {"raw_topic": ["en"], "topic": ["src1"]})),
    f"""WITH {R} SELECT count(*) AS count, count(DISTINCT child_issue) AS unique_children,
      round(avg(CAST(sentiment = 'Negative' AS INTEGER)) * 100, 6) AS negative_pct,
      round(avg(CAST(severity = 'High' AS INTEGER)) * 100, 6) AS high_pct
    FROM records WHERE raw_topic = 'en' AND topic = 'src1'""",
)
CATALOG.add(
    "drill_examples",
    lambda spark, sf_dir: explore.drill_examples(fx.records(spark, sf_dir), {"raw_topic": ["en"]}),
    f"""WITH {R} SELECT record_id, {sql_clip('original_feedback', 190)} AS example FROM records
    WHERE raw_topic = 'en' ORDER BY record_id LIMIT 7""",
)
CATALOG.add(
    "risk_counts",
    lambda spark, sf_dir: explore.risk_counts(fx.records(spark, sf_dir)),
    f"WITH {R} SELECT risk_domain, count(*) AS count FROM (SELECT unnest(risk_tags) AS risk_domain FROM records) GROUP BY 1",
)
_WEIGHT = " ".join(f"WHEN '{t}' THEN {w}" for t, w in lx.QUEUE_TAG_WEIGHTS.items())
CATALOG.add(
    "escalation_queue",
    lambda spark, sf_dir: r(explore.escalation_queue(fx.records(spark, sf_dir))),
    f"""WITH {R}, x AS (SELECT *, unnest(risk_tags) AS risk_tag FROM records), s AS (
      SELECT *, 2 * CASE risk_tag {_WEIGHT} ELSE 1 END
        + CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 1 END
        + CASE sentiment WHEN 'Positive' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Negative' THEN 3 ELSE 2 END AS score FROM x), q AS (
      SELECT risk_tag, parent_issue, child_issue, count(*) AS total_count, count(*) FILTER (WHERE severity = 'High') AS high_severity,
        count(*) FILTER (WHERE sentiment = 'Negative') AS negative, avg(score) AS priority_score,
        arg_min(original_feedback, record_id) AS sample
      FROM s WHERE child_issue IS NOT NULL GROUP BY risk_tag, parent_issue, child_issue
      ORDER BY priority_score DESC, total_count DESC, risk_tag, parent_issue, child_issue LIMIT 30)
    SELECT risk_tag, parent_issue, child_issue, total_count, high_severity, negative,
      round(priority_score, 6) AS priority_score, {sql_clip('sample', 130)} AS sample_feedback FROM q""",
)
CATALOG.add(
    "priority_matrix",
    lambda spark, sf_dir: r(explore.priority_matrix(fx.records(spark, sf_dir))),
    f"""WITH {R}, m AS (SELECT parent_issue, child_issue, count(*) AS frequency,
        avg(CAST(severity = 'High' AS INTEGER)) AS h, avg(CAST(sentiment = 'Negative' AS INTEGER)) AS n,
        avg(CAST(list_contains(risk_tags, '{lx.TRUST_TAG}') AS INTEGER)) AS t
      FROM records WHERE child_issue IS NOT NULL GROUP BY parent_issue, child_issue
      ORDER BY frequency DESC, parent_issue, child_issue LIMIT 120)
    SELECT parent_issue, child_issue, frequency, round(h, 6) AS high_severity_rate, round(n, 6) AS negative_rate,
      round(t, 6) AS trust_rate, frequency AS impact,
      round(0.45::DOUBLE * h + 0.40::DOUBLE * n + 0.15::DOUBLE * t, 6) AS urgency,
      {sql_clip('child_issue', 42)} AS label_short FROM m""",
)

# --------------------------------------------------------------------------- ranks, feeds, pins

_BY_LEVEL = " UNION ALL ".join(
    [f"SELECT '{c}' AS level, {c} AS value, classification = 'Suggestion' AS scoped, * FROM records" for c in filters.TAXONOMY]
    + ["SELECT 'risk_primary' AS level, unnest(risk_tags) AS value, true AS scoped, * FROM records"]
)
_PIN_ROWS = ", ".join(f"({i}, '{level}', '{value}')" for i, (level, value) in enumerate(PINS))
_RANKS_SQL = f"""{R}, spread AS (SELECT * FROM ({_BY_LEVEL}) WHERE value IS NOT NULL),
    counts AS (SELECT level, value, count(*) AS n, count(*) FILTER (WHERE scoped) AS n_scoped FROM spread GROUP BY level, value),
    pins(pin, level, value) AS (VALUES {_PIN_ROWS}),
    own AS (SELECT p.*, c.n, coalesce(c.n_scoped, 0) AS n_scoped FROM pins p LEFT JOIN counts c USING (level, value)),
    picked AS (SELECT o.level, o.value, o.n AS own_n, CASE WHEN o.n_scoped > 0 THEN o.n_scoped ELSE o.n END AS own_count,
        c.value AS other, CASE WHEN o.n_scoped > 0 THEN c.n_scoped ELSE c.n END AS cnt
      FROM own o JOIN counts c ON c.level = o.level),
    ranks AS (SELECT level, value,
        CASE WHEN max(own_n) IS NULL THEN 0
             ELSE 1 + count(*) FILTER (WHERE cnt > own_count OR (cnt = own_count AND other < value)) END AS rank,
        count(*) AS total FROM picked WHERE cnt > 0 GROUP BY level, value)"""


def _ranked(*pins: tuple[str, str]):
    return lambda spark, sf_dir: explore.rank_among(fx.records(spark, sf_dir), pins)


def _ranks_where(condition: str) -> str:
    return f"WITH {_RANKS_SQL} SELECT level, value, rank, total FROM ranks WHERE {condition}"


CATALOG.add("rank_among", _ranked(*[p for p in PINS if p[0] != "risk_primary"]), _ranks_where("level <> 'risk_primary'"))
CATALOG.add(
    "rank_among_risk", _ranked(*[p for p in PINS if p[0] == "risk_primary"]), _ranks_where("level = 'risk_primary'")
)
_FEED_SQL = f"""WITH {R}, p AS (SELECT *, CAST(
      2 * CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 1 END
      + CASE sentiment WHEN 'Positive' THEN 1 WHEN 'Neutral' THEN 2 WHEN 'Negative' THEN 3 ELSE 2 END AS INTEGER) AS pain
      FROM records), n AS (SELECT *, row_number() OVER (ORDER BY pain DESC, record_id) AS k FROM p)"""
for _page in (0, 3):
    CATALOG.add(
        f"feed_page_{_page}",
        lambda spark, sf_dir, page=_page: rank.feed_page(fx.records(spark, sf_dir), page=page),
        f"""{_FEED_SQL} SELECT CAST(k AS INTEGER) AS number, record_id, pain, severity, sentiment,
          {sql_clip('coalesce(child_issue, topic)', 38)} AS chip, {sql_clip('original_feedback', 280)} AS comment
        FROM n WHERE k > {_page * 20} AND k <= {_page * 20 + 20}""",
    )
CATALOG.add(
    "feed_page_after",
    lambda spark, sf_dir: rank.feed_page_after(fx.records(spark, sf_dir), pain=4, record_id=100),
    f"""{_FEED_SQL} SELECT record_id, pain, severity, sentiment, original_feedback FROM n
    WHERE pain < 4 OR (pain = 4 AND record_id > 100) ORDER BY pain DESC, record_id LIMIT 20""",
)
_TEXT = fill(SQL_COLLAPSE, "coalesce(original_feedback, '')")
CATALOG.add(
    "sample_comments",
    lambda spark, sf_dir: rank.sample_comments(fx.raw_records(spark, sf_dir), k=3),
    f"""WITH {fx.RAW_RECORDS_SQL}, d AS (
      SELECT {_TEXT} AS text, min(record_id) AS first_id FROM raw_records GROUP BY 1), e AS (
      SELECT count(*) FILTER (WHERE length(text) BETWEEN 20 AND 240) >= 3 AS enough FROM d)
    SELECT first_id, text FROM d, e WHERE CASE WHEN enough THEN length(text) BETWEEN 20 AND 240 ELSE length(text) > 0 END
    ORDER BY CASE WHEN enough THEN md5('42|' || text) END, first_id LIMIT 3""",
)
_MODAL = """(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM spread s WHERE s.level = p.level AND s.value = p.value
      AND {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1))"""
_DETAILS_SQL = f"""{_RANKS_SQL}, details AS (
    SELECT p.pin, p.level, p.value, count(*) AS count, avg(CAST(severity = 'High' AS INTEGER)) * 100 AS high_pct,
      avg(CAST(sentiment = 'Negative' AS INTEGER)) * 100 AS negative_pct, count(DISTINCT child_issue) AS n_children,
      count(DISTINCT parent_issue) AS n_parents
    FROM pins p JOIN spread s ON s.level = p.level AND s.value = p.value GROUP BY p.pin, p.level, p.value), modes AS (
    SELECT p.pin, 'parent_issue' AS kind, parent_issue AS v, count(*) AS n FROM pins p JOIN spread s
      ON s.level = p.level AND s.value = p.value GROUP BY ALL
    UNION ALL SELECT p.pin, 'raw_topic', raw_topic, count(*) FROM pins p JOIN spread s
      ON s.level = p.level AND s.value = p.value GROUP BY ALL), modal AS (
    SELECT pin, kind, v FROM (SELECT *, row_number() OVER (PARTITION BY pin, kind ORDER BY n DESC, v) AS k FROM modes
      WHERE v IS NOT NULL) WHERE k = 1), full_details AS (
    SELECT d.*, r.rank, r.total, coalesce(a.v, '—') AS top_parent, coalesce(b.v, '—') AS top_raw_topic
    FROM details d JOIN ranks r ON r.level = d.level AND r.value = d.value
    LEFT JOIN modal a ON a.pin = d.pin AND a.kind = 'parent_issue'
    LEFT JOIN modal b ON b.pin = d.pin AND b.kind = 'raw_topic')"""
CATALOG.add(
    "issue_detail",
    lambda spark, sf_dir: r(explore.issue_details(fx.records(spark, sf_dir), [PINS[2]]).drop("pin")),
    f"""WITH {_DETAILS_SQL} SELECT level, value, rank, total, count, round(high_pct, 6) AS high_pct,
      round(negative_pct, 6) AS negative_pct, top_parent, top_raw_topic, n_children, n_parents
    FROM full_details WHERE level = '{PINS[2][0]}' AND value = '{PINS[2][1]}'""",
)
CATALOG.add(
    "issue_records",
    lambda spark, sf_dir: explore.issue_records(fx.records(spark, sf_dir), "topic", "src1"),
    f"""WITH {R} SELECT record_id, {sql_clip('original_feedback', 220)} AS comment,
      {sql_clip('coalesce(child_issue, topic)', 36)} AS chip FROM records WHERE topic = 'src1' ORDER BY record_id LIMIT 200""",
)
CATALOG.add(
    "pin_compare",
    lambda spark, sf_dir: r(explore.pin_compare(fx.records(spark, sf_dir), PINS)),
    f"""WITH {_DETAILS_SQL} SELECT CAST(pin AS INTEGER) AS pin, {sql_clip('value', 36)} AS issue, level,
      '#' || rank || '/' || total AS rank, count, round(high_pct, 6) AS high_pct,
      round(negative_pct, 6) AS negative_pct, {sql_clip('top_parent', 28)} AS top_parent FROM full_details""",
)
CATALOG.add(
    "pin_rates_long",
    lambda spark, sf_dir: r(explore.pin_rates_long(explore.pin_compare(fx.records(spark, sf_dir), PINS))),
    f"""WITH {_DETAILS_SQL} SELECT CAST(pin AS INTEGER) AS pin, {sql_clip('value', 36)} AS issue,
      'High severity %' AS metric, round(high_pct, 6) AS pct FROM full_details
    UNION ALL SELECT CAST(pin AS INTEGER), {sql_clip('value', 36)}, 'Negative %', round(negative_pct, 6) FROM full_details""",
)
CATALOG.add(
    "pin_export",
    lambda spark, sf_dir: explore.pin_export(fx.records(spark, sf_dir), PINS),
    f"""WITH {_RANKS_SQL} SELECT p.level AS pinned_level, p.value AS pinned_value, {', '.join(explore.EXPORT)}
    FROM pins p JOIN spread s ON s.level = p.level AND s.value = p.value""",
)

# --------------------------------------------------------------------------- estimates


_SKETCHED = {"severity": ["Low", "Medium"], "risk_primary": ["Search & UX", "Performance Risk"]}


def sketch_errors(spark, sf_dir):
    """Estimates per topic of a filtered view, from sketches per cell, held against the exact values."""
    rows = fx.records(spark, sf_dir).withColumn("chars", F.length("original_feedback"))
    cells = sketches.category_sketches(rows, distinct=["original_feedback"], measures=["chars"])
    found = sketches.sketch_summary(cells, drill=_SKETCHED, by=["topic"], quantiles=(0.5, 0.9)).withColumnRenamed("n", "n_rows")
    view = rows.filter(filters.drill_predicate(_SKETCHED, rows.columns)).select("topic", "chars", F.xxhash64("original_feedback").alias("mark"))
    n = F.count("chars")
    off = []
    for q in (50, 90):
        value = F.first(f"chars_p{q}")
        below, upto = F.count_if(F.col("chars") < F.col(f"chars_p{q}")) / n, F.count_if(F.col("chars") <= F.col(f"chars_p{q}")) / n
        off.append((value.isNotNull() & (below <= q / 100 + 0.03) & (upto >= q / 100 - 0.03)).alias(f"p{q}_near"))
    exact, guess = F.count_distinct("mark"), F.first("original_feedback_distinct")
    return view.join(found, "topic").groupBy("topic").agg(
        F.first("n_rows").alias("n_rows"), exact.alias("n_texts"), (F.abs(guess - exact) <= 0.06 * exact + 0.5).alias("distinct_near"), *off
    )


CATALOG.add(
    "sketch_errors",
    sketch_errors,
    f"""WITH {R} SELECT topic, count(*) AS n_rows, count(DISTINCT original_feedback) AS n_texts, true AS distinct_near,
      true AS p50_near, true AS p90_near
    FROM records WHERE severity IN ('Low', 'Medium') AND {_any_tag('Search & UX', 'Performance Risk')} GROUP BY topic""",
)
