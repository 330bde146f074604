import pandas as pd
import pytest
from pyspark.sql import functions as F

from earshot.operators import filters, profile, rank
from earshot.sources import shared, splitcsv, tables

HEADER = ",Topic,Feedback Comment,Contextual_Subtopic,Granular_Subtopic,Severity,Sentiment\n"


def write(tmp_path, body, header=HEADER):
    path = tmp_path / "export.csv"
    path.write_text("﻿" + header + body, encoding="utf-8")
    return str(path)


def test_csv_scan(spark, tmp_path):
    body = '0,T,"line one\nsaid ""hi""",C,G,Low,Neutral\n1,,NA,null,,High,Negative\n'
    got = tables.scan_feedback_csv(spark, write(tmp_path, body)).orderBy("row_id").collect()
    assert got[0].comment == 'line one\nsaid "hi"'
    assert (got[1].topic, got[1].comment, got[1].contextual_subtopic, got[1].granular_subtopic) == ("", "NA", "null", "")


@pytest.mark.parametrize("most_ranges", [splitcsv.MOST_RANGES, 1])
def test_one_csv_file_in_many_tasks(spark, tmp_path, monkeypatch, most_ranges):
    texts = ['a "quoted" word, and\n\n"more"\n' * (i % 4) + f"t{i}" for i in range(300)]
    # Records of several ranges, and cells that look like records.
    texts += ["0,T,x\n" * 900, '"\n' * 700, "", "last\n"]
    frame = pd.DataFrame({"Topic": "T", "Feedback Comment": texts, "Contextual_Subtopic": "C"})
    frame = frame.assign(Granular_Subtopic="G", Severity="Low", Sentiment="Neutral")
    folder = tmp_path / "exports"
    folder.mkdir()
    frame[:150].to_csv(folder / "a.csv", lineterminator="\r\n")
    frame[150:].to_csv(folder / "b.csv", lineterminator="\n")
    (folder / "c.csv").write_text(HEADER.strip(), encoding="utf-8")
    (folder / "d.csv").write_text("\ufeff" + HEADER + '\n900,T,"no end\nof it', encoding="utf-8")
    monkeypatch.setattr(splitcsv, "MOST_RANGES", most_ranges)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
        got = tables.scan_feedback_csv(spark, str(folder), split=True, validate=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {i: t for i, t in enumerate(texts)} | {900: "no end\nof it"}
    assert len(got) == len(want) and {x.row_id: x.comment for x in got} == want
    assert {x.topic for x in got} == {"T"} and {x.severity for x in got} <= {"Low", ""}


def test_csv_contract(spark, tmp_path):
    with pytest.raises(tables.ContractError, match="Urgent"):
        tables.scan_feedback_csv(spark, write(tmp_path, "0,T,x,C,G,Urgent,Neutral\n"))
    with pytest.raises(tables.ContractError, match="unnamed"):
        tables.scan_feedback_csv(spark, write(tmp_path, "0,T,x,C,G,Low,Neutral\n", "id" + HEADER))
    with pytest.raises(tables.ContractError, match="Sentiment"):
        tables.scan_feedback_csv(spark, write(tmp_path, "0,T,x,C,G,Low\n", ",Topic,Feedback Comment,Contextual_Subtopic,Granular_Subtopic,Severity\n"))
    with pytest.raises(Exception):
        tables.scan_feedback_csv(spark, write(tmp_path, "x1,T,x,C,G,Low,Neutral\n")).collect()


def test_json_array(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('[{"topic":"a","parent_issue":null},{"topic":"b","severity":"Low"}]')
    got = tables.scan_records_json(spark, str(path), array_file=True).orderBy("topic").collect()
    assert [(r.topic, r.parent_issue, r.severity) for r in got] == [("a", None, None), ("b", None, "Low")]


def test_materialize(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "m")
    assert [shared.materialize(df, path, s)[1] for s in ("a", "a", "b", "b")] == [False, True, False, True]
    assert shared.materialize(df, path, "b", n_rows=6)[1] is False


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 10, 23])
def test_time_buckets_match_quantile_cut(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "row_id long")
    got = [r[0] for r in df.orderBy("row_id").select(rank.time_bucket(df)).collect()]
    want = [0] if n == 1 else pd.qcut(pd.Series(range(n)).rank(method="first"), 8, labels=False, duplicates="drop").tolist()
    assert got == want


def test_time_column_gate_and_ties(spark):
    rows = [(i, "2024-01-01" if i < 150 else "oops", "x") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, Created_At string, t string")
    cov = rank.time_parse_coverage(df, "Created_At").first()
    assert (cov.rows, cov.parsed, cov.usable) == (200, 150, True)
    got = df.select("row_id", rank.time_bucket(df).alias("b")).collect()
    assert all(r.b is None for r in got if r.row_id >= 150)
    want = pd.qcut(pd.Series(range(150)).rank(method="first"), 8, labels=False).tolist()
    assert [r.b for r in sorted(got) if r.row_id < 150] == want
    below = df.filter("row_id >= 60")
    assert rank.time_parse_coverage(below, "Created_At").first().usable is False
    assert below.filter(rank.time_bucket(below).isNull()).count() == 0


def test_time_column_choice():
    assert rank.choose_time_column(["Date", "TIMESTAMP", "x"]) == "TIMESTAMP"
    assert rank.choose_time_column(["x"]) is None


def test_global_rank_with_hot_key(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    got = rank.global_rank(df, ["k", "id"]).orderBy("rank").collect()
    assert [(r.k, r.id) for r in got] == sorted((int(i % 3 == 0), i) for i in range(3000))
    assert [r["rank"] for r in got] == list(range(1, 3001))


def test_value_ranks_ties_and_absent(spark):
    counts = spark.createDataFrame(
        [("t", "a", 5, 0), ("t", "b", 3, 3), ("t", "c", 3, 3), ("t", "d", 9, 1)], "level string, value string, n long, n_scoped long"
    )
    wanted = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c"), ("t", "z")], "level string, value string")
    got = {r.value: (r["rank"], r.total) for r in rank.value_ranks(counts, wanted).collect()}
    assert got == {"a": (2, 4), "b": (1, 3), "c": (2, 3), "z": (0, 4)}


def test_filter_state():
    drill = {"topic": ["a", "b", "c"], "severity": ["High"]}
    assert filters.scope_filter(drill, "child_issue", " ") == {"severity": ["High"]}
    assert filters.scope_filter(drill, "child_issue", "x") == {"severity": ["High"], "child_issue": ["x"]}
    spec = filters.FilterSpec(keyword=" ads ", only_trust=True)
    assert spec.narrowing() == {"search": ["ads"], "only_sensitive": ["true"]}
    assert filters.preset("no such") == {}


def test_keyword_is_literal_unless_asked(spark):
    df = spark.createDataFrame([("C++ crash", None, "p", "t"), ("cc", "x", None, "t")], "original_feedback string, child_issue string, parent_issue string, topic string")
    assert df.filter(filters.keyword_predicate("c++")).count() == 1
    assert df.filter(filters.keyword_predicate("^c{2}$", regex=True)).count() == 1


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0,), (5,), (10,), (99,)], "v int")
    got = {r.bin: r["count"] for r in profile.histogram(df, "v", cap=10, bins=5).collect()}
    assert got == {1: 1, 3: 1, 5: 2}
    same = profile.histogram(df.filter("v = 5"), "v", cap=10, bins=60).collect()
    assert [(r.bin, r["count"]) for r in same] == [(31, 1)]


def test_describe_matches_pandas(spark):
    values = [1, 2, 3, 10, 10, 57]
    df = spark.createDataFrame([(v, v, v) for v in values], "chars int, words int, lines int")
    got = {r.kind: r for r in profile.length_describe(df).collect()}["words"]
    want = pd.Series(values).describe(percentiles=[0.5, 0.9, 0.95, 0.99])
    pairs = {"mean": "mean", "std": "std", "p50": "50%", "p90": "90%", "p95": "95%", "p99": "99%", "max": "max"}
    for ours, theirs in pairs.items():
        assert got[ours] == pytest.approx(want[theirs])


def test_only_changed_buckets_are_recomputed(spark):
    rows = [(i, f"text {i}", None if i % 4 else i) for i in range(200)] + [(None, "no id", 1), (5, "text 5", None)]
    schema = "id bigint, text string, other int"
    path = shared.new_path(spark, "buckets")
    computed = []

    def compute(df):
        return df.select("id", F.upper("text").alias("upper"), "other")

    def run(rows, **options):
        df = spark.createDataFrame(rows, schema).repartition(3)
        out, again = shared.materialize_buckets(df, compute, path, id_col="id", buckets=16, **options)
        want = sorted(map(str, ((i, t and t.upper(), o) for i, t, o in rows)))
        assert sorted(str((r["id"], r["upper"], r["other"])) for r in out.collect()) == want
        computed.append(len(again))
        return out, again

    first, _ = run(rows)
    run(rows[::-1])
    changed = [(i, "new" if i == 77 else t, o) for i, t, o in rows]
    third, again = run(changed)
    assert computed == [16, 0, 1]
    home = spark.range(1).select(shared.bucket_of(F.lit(77), 16)).first()[0]
    assert again == [home]
    # The former result still reads what it read, and rows that go or come are changes of their buckets.
    assert "TEXT 77" in {r.upper for r in first.collect()}
    run(changed[:-1])
    run([*changed[:-1], (1000, None, 3)])
    assert computed[3:] == [1, 1]
    run([*changed[:-1], (1000, None, 3)], version="2")
    assert computed[-1] == 16
    run([r for r in changed if r[0] == 77])
    run([])
    run(rows)
    assert computed[-1] == 16


def test_an_interrupted_call_leaves_the_former_state(spark, monkeypatch):
    path = shared.new_path(spark, "buckets")
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    shared.materialize_buckets(df, lambda d: d, path, id_col="id", buckets=4)

    def broken(d):
        return d.withColumn("x", F.when(F.col("id") == 3, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("x")))

    with pytest.raises(Exception, match="lost"):
        shared.materialize_buckets(df.withColumn("x", F.col("x") + 1), broken, path, id_col="id", buckets=4)
    out, again = shared.materialize_buckets(df, lambda d: d, path, id_col="id", buckets=4)
    assert again == [] and sorted(map(tuple, out.collect())) == [(i, 2 * i) for i in range(50)]
