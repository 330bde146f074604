import pytest

from earshot.operators import filters, keywords
from earshot.sources.shared import new_path

FIELDS = ("original_feedback", "child_issue")
WORDS = ["Alpha", "billing", "crash", "delta", "İstanbul", "übel", "😀😀😀smile", "a.b*c", "ﬁne"]


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, f"{WORDS[i * len(WORDS) // 600]} row {i}\nnext", None if i % 3 else f"child{i % 7}", i % 2 == 0) for i in range(600)]
    rows += [(1000, None, None, True), (1001, "", "", True), (1002, "xy", "za", False)]
    df = spark.createDataFrame(rows, "record_id int, original_feedback string, child_issue string, flag boolean").cache()
    index = keywords.build_index(df, new_path(spark, "index"), blocks=12, order_by=["record_id"], fields=FIELDS, page_rows=16)
    return df, index


def both(spark, made, monkeypatch, keyword, **options):
    df, index = made
    monkeypatch.setattr(keywords.filters, "SEARCH_FIELDS", FIELDS)
    real = filters.keyword_predicate
    monkeypatch.setattr(filters, "keyword_predicate", lambda q, regex=False: real(q, fields=FIELDS, regex=regex))
    spec = filters.FilterSpec(keyword=keyword, **options)
    got = keywords.search(spark, index, spec)
    return got, sorted(r.record_id for r in got.collect()), sorted(r.record_id for r in filters.apply_filters(df, spec).collect())


@pytest.mark.parametrize(
    "keyword", [" CRASH ", "billing row 1", "child3", "row 59", "i̇stanbul", "ÜBEL", "😀😀😀smile", "😀s", "a.b*c", "ﬁne", "xy", "xyza", "", "zzz", "\nnext"]
)
def test_same_rows_as_a_scan(spark, made, monkeypatch, keyword):
    _, got, want = both(spark, made, monkeypatch, keyword)
    assert got == want


def test_patterns_read_everything(spark, made, monkeypatch):
    _, got, want = both(spark, made, monkeypatch, "cr.sh", regex=True)
    assert got == want and got


def read_files(df):
    """Files of the records that a finished query has read."""
    def walk(node):
        yield node
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))
        if "AdaptiveSparkPlan" in node.nodeName():
            yield from walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            yield from walk(node.plan())

    scans = [n for n in walk(df._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet") and "_block" in n.toString()]
    return max(s.metrics().apply("numFiles").value() for s in scans)


def test_only_blocks_with_the_keyword_are_read(spark, made, monkeypatch):
    got, ids, want = both(spark, made, monkeypatch, "billing")
    got = got.select("*")
    assert len(got.collect()) == len(want) and want
    assert 1 <= read_files(got) <= 3


def test_grams_must_meet_in_a_page(spark, made):
    _, index = made
    assert keywords.candidates(spark, index, "alpha").count() < 4
    assert keywords.candidates(spark, index, "alpha billing").count() == 0
    with pytest.raises(ValueError):
        keywords.build_index(made[0], "unused", blocks=0, order_by=["record_id"])


def test_other_fields_are_searched_by_a_scan(spark):
    schema = ", ".join(f"{f} string" for f in filters.SEARCH_FIELDS)
    df = spark.createDataFrame([(1, "x", "y", "z", "crash"), (2, "crash", "y", "z", "x")], "record_id int, " + schema)
    index = keywords.build_index(df, new_path(spark, "index"), blocks=2, order_by=["record_id"], fields=FIELDS)
    assert keywords.search(spark, index, filters.FilterSpec(keyword="crash")).count() == 2


def test_no_records(spark):
    df = spark.createDataFrame([], "record_id int, original_feedback string, child_issue string")
    index = keywords.build_index(df, new_path(spark, "index"), blocks=4, order_by=["record_id"], fields=FIELDS)
    assert keywords.candidates(spark, index, "crash").collect() == []
