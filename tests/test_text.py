import unicodedata
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import lexicons as lx
from earshot.functions import scoring, text as tx
from earshot.operators import dedup, issues, keywords, labels, profile, vectors


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_clean_text(spark):
    given = ["Ｆｕｌｌ ﬁle", "see HTTPS://x.y/z?a=1 now", ". - • hello", "a  b", " .-_ ", "", None, "www.site.org", "ok \U0001f600!"]
    want = ["Full file", "see now", "hello", "a b", "", "", "", "", "ok \U0001f600!"]
    assert column(spark, given, tx.clean_text) == want


def test_nfkc_equals_unicodedata(spark):
    given = ["é", "é", "ﬁ①", "آ", "ſ", "…", "plain", "Ĳ", "가", "가", None]
    want = [None if g is None else unicodedata.normalize("NFKC", g) for g in given]
    assert column(spark, given, tx.nfkc) == want


def test_language(spark):
    given = ["سلام", "hello سلام", "bohat slow", "acha kya", "acha one", "12 !?", "  ", None, "BAHUT", "﻿12"]
    want = ["urdu_script", "mixed", "roman_urdu", "roman_urdu", "english", "other", "blank", "blank", "roman_urdu", "other"]
    assert column(spark, given, tx.detect_language) == want


def test_lengths(spark):
    assert column(spark, ["a b\nc", "", None, "\U0001f600 x"], tx.n_words) == [3, 0, 0, 2]
    assert column(spark, ["a b\nc", "", None], tx.n_lines) == [2, 0, 0]
    assert column(spark, ["\U0001f600 x"], tx.n_chars) == [3]


def test_clip(spark):
    got = column(spark, ["a  b", "x" * 12, None], lambda c: tx.clip_text(c, 10))
    assert got == ["a b", "x" * 9 + "…", ""]


def test_char_ngrams(spark):
    def grams(c):
        return F.array_sort(tx.char_ngrams(tx.gram_text(c)))

    emoji = "ab\U0001f600cde"
    given = ["Abcdef  g", "abc", "", None, "aaaaaaa", emoji]
    low = "abcdef g"
    want = [sorted({low[i : i + 5] for i in range(4)}), ["abc"], [], [], ["aaaaa"], sorted({emoji[:5], emoji[1:]})]
    got = column(spark, given, grams)
    assert [sorted(g) for g in got] == want


def test_gram_summary(spark):
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))
    given = ["abcabcabc ab", "abc", "", None, "aaaaaaa", "ab\U0001f600cde", "zé\uffee\U0001f600aéz", wide + wide[:9], wide[::-1]]
    summary = F.struct(tx.gram_summary(F.col("t")).alias("s"), F.array_sort(tx.char_ngrams(F.col("t"))).alias("g"))
    df = spark.createDataFrame([(t,) for t in given], "t string").select(F.coalesce("t", F.lit("")).alias("t"))
    got = [r.x for r in df.select(summary.alias("x")).collect()]
    assert [tuple(r.s) for r in got] == [(len(r.g), *((r.g[0], r.g[-1]) if r.g else (None, None))) for r in got]
    # The same whether texts are worked on together or one by one.
    texts = [t or "" for t in given] * 3
    assert tx._summaries(texts, 5, 1) == tx._summaries(texts, 5) == [tuple(r.s) for r in got] * 3


def test_char_ngrams_query_builds_no_gram_strings(spark):
    from earshot.plans import catalog_vectors, fixtures

    plan = catalog_vectors.char_ngrams(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" not in plan and "array_distinct" not in plan


def test_collapse_equals_runs(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    given = ["a" + x + y + "b" + x + " c" for x in spaces for y in ("", " ", "  ", x, "\t\u3000 ")] + ["   ", "", None, "\x00\x7f\u200b a"]
    want = [t if t is None else " ".join(t.split()) for t in given]
    assert column(spark, given, tx.collapse) == want


def test_ascii_words(spark):
    assert column(spark, ["The café naïve ab abc_d foo Bar9 baz"], tx.ascii_words) == [["the", "foo", "baz"]]


def test_risk_signals(spark):
    df = spark.createDataFrame([("Premium payment nahi hua, galat charge",), (None,)], "t string")
    got = df.select(*[c.alias(n) for n, c in tx.risk_signals(F.col("t")).items()]).collect()
    assert (got[0].signal_payment, got[0].signal_trust) == (1, 1)
    assert tuple(got[1]) == (0, 0, 0, 0)


def test_urgency_grid(spark):
    flags = ["signal_payment", "signal_trust", "signal_blocker", "signal_religious"]
    severities, sentiments = ("Low", "Medium", "High", None), ("Positive", "Neutral", "Negative", "odd")
    grid = [(*c, *f) for c in product(severities, sentiments) for f in product((0, 1), repeat=4)]
    df = spark.createDataFrame(grid, "severity string, sentiment string, " + ", ".join(f"{f} int" for f in flags))
    rows = df.withColumn("u", scoring.row_urgency(F.col("severity"), F.col("sentiment"), {f: F.col(f) for f in flags})).collect()
    assert len(rows) == 256
    for r in rows:
        s = lx.SEVERITY_SCORE.get(r.severity, 0.4)
        t = lx.SENTIMENT_SCORE.get(r.sentiment, 0.35)
        want = 0.4 * s + 0.26 * t + 0.12 * r.signal_payment + 0.12 * r.signal_blocker + 0.08 * r.signal_trust
        want += 0.02 * (r.signal_religious and r.signal_trust)
        assert 0 <= r.u <= 1 and r.u == pytest.approx(want)


def test_tags(spark):
    df = spark.createDataFrame([("Add an ad please",), ("quran search is slow",), ("nothing",)], "t string")
    tags = tx.tags_or_default(tx.matching_tags(F.col("t")))
    got = [r[0] for r in df.select(tags).collect()]
    assert got == [["Ads Sensitivity"], ["Quran / Tafseer", "Performance Risk", "Search & UX"], ["General Product"]]


def test_eight_row_metrics(spark):
    rows = [(i, 10, 1, "ok", "Low", "Neutral") for i in (1, 2, 3)]
    rows += [(i, 20, 2, "payment not done", "High", "Negative") for i in (4, 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "row_id long, cluster_id int, parent_id int, text_clean string, severity string, sentiment string")
    metrics = issues.issue_metrics(issues.issue_cube(df))
    got = {r.cluster_id: r for r in metrics.collect()}
    assert got[20].priority_score == pytest.approx(71.7093, abs=1e-4)
    assert got[10].priority_score == pytest.approx(34.5236, abs=1e-4)
    assert got[10].explain_reasons == "frequency-driven"
    assert got[20].explain_reasons == (
        "high severity concentration; mostly negative sentiment; payment/subscription risk"
    )
    assert (got[20].recent_count, got[20].growth_score, got[20].parent_id) == (1, 0.5, 2)
    parents = {r.parent_id: r for r in issues.parent_metrics(metrics).collect()}
    assert (parents[2].high_priority_clusters, parents[1].high_priority_clusters) == (1, 0)


def test_all_noise_gives_empty_metrics(spark):
    df = spark.createDataFrame(
        [(1, -1, -1, "x", "Low", "Neutral")],
        "row_id long, cluster_id int, parent_id int, text_clean string, severity string, sentiment string",
    )
    metrics = issues.issue_metrics(issues.issue_cube(df))
    assert metrics.count() == 0 and len(metrics.columns) == 16


def test_growth_cases(spark):
    rows = [(1, 0, 5), (2, 0, 2), (2, 3, 3), (3, 1, 4), (3, 2, 1), (4, None, 9)]
    cube = spark.createDataFrame([(c, 0, b, n) for c, b, n in rows], "cluster_id int, parent_id int, time_bucket int, n long")
    got = {r.cluster_id: r for r in issues.growth(cube).collect()}
    assert (got[1].growth_rate, got[1].growth_score, got[1].recent_count) == (0, 0, 0)
    assert got[2].growth_rate == pytest.approx(0.5) and got[2].recent_count == 3
    assert got[3].growth_rate == pytest.approx(-0.75) and got[3].growth_score < 0.5
    assert 4 not in got
    dense = {r.cluster_id: r for r in issues.growth(cube, dense_buckets=True).collect()}
    assert dense[2].growth_rate == pytest.approx(3.0)


def test_label_replies(spark):
    good = '{"label":"L","description":"D","example_quote":"Q","suspected_root_cause":"C"}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, '{"label":"only"}'), (4, "sorry, no"), (5, None), (6, "[1]")]
    df = spark.createDataFrame(rows, "cluster_id int, reply string")
    got = {r.cluster_id: r for r in labels.parse_label_replies(df).collect()}
    assert got[1].label == got[2].label == "L" and got[2].suspected_root_cause == "C"
    assert (got[3].label, got[3].description, got[3].unreadable) == ("only", "", False)
    assert all(got[i].unreadable and got[i].label is None for i in (4, 5, 6))


def test_terms_bridge_stop_words_and_single_cluster_is_empty(spark):
    rows = [(1, "login and button broken"), (1, "login button"), (2, "login the button"), (-1, "noise words"), (3, "")]
    df = spark.createDataFrame(rows, "cluster_id int, text_clean string")
    got = {(r.cluster_id, r.term) for r in labels.cluster_terms(df).collect()}
    assert got == {(c, t) for c in (1, 2) for t in ("login", "button", "login button")}
    assert labels.cluster_terms(df.filter("cluster_id = 1")).count() == 0


def test_histogram_computes_its_column_once_for_a_row(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def costly(x):
        seen.add(1)
        return x

    rows = spark.range(50).select((F.col("id") % 7).cast("int").alias("x"))
    got = {r.bin: r["count"] for r in profile.histogram(rows.select(costly("x").alias("y")), "y", cap=5, bins=2).collect()}
    assert got == {1: 22, 2: 28} and seen.value == 50


def test_signatures_of_many_texts_are_those_of_each(spark):
    texts = ["", "ab", "abcdefgh", "x" * 300, "".join(chr(97 + i * i % 23) for i in range(900))]
    sets = [g for g in (dedup._gram_hashes(t, 5) for t in texts) if len(g)]
    a, b = dedup._permutations(16, 1)
    want = [[int((((g >> np.uint64(32)).astype(np.uint32) * x + y).min())) for x, y in zip(a, b)] for g in sets]
    for step in (50, 100, 65536):
        assert dedup._signatures(sets, a, b, step).tolist() == want
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", dedup.minhash_signature(F.col("t"), permutations=16, seed=1).alias("s"))
    got = {r.id: r.s for r in df.collect()}
    assert got[0] is None and [got[i] for i in range(1, 5)] == want


def counted(spark, kind):
    """A function that gives its argument back, and how often it was called."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf(kind)
    def same(x):
        seen.add(1)
        return x

    return same, seen


def test_tfidf_takes_texts_apart_once(spark):
    same, seen = counted(spark, "string")
    rows = spark.range(20).select(F.col("id").alias("row_id"), same(F.concat_ws(" ", F.lit("word"), F.col("id").cast("string"))).alias("text_clean"))
    got = vectors.embed_texts(rows, dim=32).collect()
    assert len(got) == 20 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in got) and seen.value == 20


def test_index_computes_records_once(spark, tmp_path):
    same, seen = counted(spark, "string")
    rows = spark.range(40).select(F.col("id").alias("record_id"), same(F.concat(F.lit("topic "), (F.col("id") % 4).cast("string"))).alias("topic"))
    index = keywords.build_index(rows, str(tmp_path / "index"), blocks=4, order_by=["topic", "record_id"], fields=("topic",), page_rows=4)
    assert index.records(spark).count() == 40 and seen.value == 40


def test_contexts_read_rows_three_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def scanned(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    words = ("alpha beta", "beta gamma", "gamma alpha")
    rows = [(i, i % 3, words[i % 3], "Low", "Neutral", [float(i + 1), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id bigint, cluster_id int, comment string, severity string, sentiment string, embedding array<double>")
    df = df.withColumn("text_clean", F.col("comment"))
    got = {r.cluster_id: r for r in labels.cluster_contexts(df.mapInPandas(scanned, df.schema), n_representatives=2).collect()}
    assert sorted(got) == [0, 1, 2] and all(r.size == 4 and len(r.representatives) == 2 for r in got.values())
    assert got[0].top_terms[:2] == ["alpha", "beta"]
    # Once without texts, once for terms and once for quotes.
    assert seen.value == 3 * 12
