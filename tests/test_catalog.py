"""Catalogue queries against SQL (small scale, the quick ones; ``harness.py`` runs all) and plan shape."""

import re

import __spark_entry__ as entry
import pytest
from harness import compare, connect

from earshot.operators import explore, filters, profile, rank
from earshot.plans import fixtures as fx

SMALL, CHECKED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUICK = (
    "clean_text clean_text_pages normalize_feedback detect_language text_lengths risk_signals sensitivity_tags "
    "scan_feedback_csv sink_csv corpus_fingerprint fragmentation_stats length_describe hist_chars language_mix issue_metrics "
    "filtered_view name_search pain_map escalation_queue priority_matrix pin_compare pin_export feed_page_0 sample_comments "
    "knn_exact soft_assign ctfidf_terms parse_label_json"
).split()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


# There are no noise rows to speak of at the smallest scale; everything else has rows there.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    problem = compare(spark, connect(SMALL), entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert problem is None or (problem == "both empty" and name in MAY_BE_EMPTY), problem


@pytest.mark.full
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_every_query_matches_its_sql(spark, name):
    """``pytest -m full``: all SQL checks at the scale they are meant for."""
    problem = compare(spark, connect(CHECKED), entry.queries()[name], entry.oracle_sql()[name], CHECKED)
    assert problem is None, problem


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROW_LEVEL = {
    "records": lambda s: fx.records(s, SMALL),
    "filtered": lambda s: filters.apply_filters(fx.records(s, SMALL), filters.FilterSpec(keyword="x")),
    "kpis": lambda s: explore.kpis(fx.records(s, SMALL)),
    "cleaned": lambda s: profile.normalize_feedback(fx.feedback(s, SMALL), normalise=False),
}


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_no_python_and_no_row_window(spark, name):
    text = plan(ROW_LEVEL[name](spark))
    assert "EvalPython" not in text and "Window" not in text and "CartesianProduct" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(profile.frequency(fx.feedback(spark, SMALL), "topic"))
    documents = next(s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "source" in s)
    assert "text" not in documents


def test_texts_are_cleaned_once_and_above_the_exchange(spark):
    text = plan(profile.normalize_feedback(fx.feedback(spark, SMALL)))
    assert text.count("ArrowEvalPython") == 1
    assert text.count("www") == 1 and text.index("www") < text.index("REPARTITION_BY_COL")


@pytest.mark.parametrize("query", [explore.risk_counts, explore.escalation_queue])
def test_tags_are_worked_out_once(spark, query):
    text = plan(query(fx.records(spark, SMALL)))
    tags = text.count("RLIKE") + text.count("rlike")
    assert "size(risk_tags" not in text and tags <= 2 * len(fx.TAGS)


def test_samples_shuffle_no_long_texts(spark):
    text = plan(rank.sample_comments(fx.records(spark, SMALL)))
    assert "hashpartitioning(text" in text
    below = text[text.index("hashpartitioning(text") :]
    assert "240" in below
