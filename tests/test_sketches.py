import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import explore, sketches


def records(spark, n):
    cats = [F.concat(F.lit(f"{c}-"), (F.col("id") % (2 + i % 3)).cast("string")).alias(c) for i, c in enumerate(explore.CATEGORIES) if c != "risk_tags"]
    tags = F.array(F.concat(F.lit("tag"), (F.col("id") % 2).cast("string"))).alias("risk_tags")
    return spark.range(n).select("*", *cats, tags, (F.col("id") % 7919).alias("author"), F.when(F.col("id") % 11 > 0, F.col("id") * 3 % 10007).alias("chars"))


@pytest.fixture(scope="module")
def made(spark):
    df = records(spark, 60_000).cache()
    return df, sketches.category_sketches(df, distinct=["author"], measures=["chars"]).cache()


@pytest.mark.parametrize("drill", [{}, {"severity": ["severity-0"]}, {"risk_primary": ["tag1"], "topic": ["topic-1", "topic-0"]}, {"topic": []}])
def test_any_filter_from_the_cells(spark, made, drill):
    df, cells = made
    got = sketches.sketch_summary(cells, drill=drill, quantiles=(0.1, 0.5, 0.99)).first()
    rows = df.filter(sketches.filters.drill_predicate(drill, df.columns)).select("author", "chars").toPandas()
    assert got.n == len(rows)
    assert abs(got.author_distinct / rows.author.nunique() - 1) < 0.06
    values = np.sort(rows.chars.dropna().to_numpy())
    for q, v in ((0.1, got.chars_p10), (0.5, got.chars_p50), (0.99, got.chars_p99)):
        assert np.searchsorted(values, v, "left") / len(values) - 0.03 < q < np.searchsorted(values, v, "right") / len(values) + 0.03


def test_groups_and_odd_input(spark, made):
    df, cells = made
    by = {r.severity: r.n for r in sketches.sketch_summary(cells, by=["severity"]).collect()}
    assert by == {r.severity: r["count"] for r in df.groupBy("severity").count().collect()}
    none = df.limit(0)
    assert sketches.sketch_summary(sketches.category_sketches(none, distinct=["author"], measures=["chars"]), by=["topic"]).collect() == []
    nulls = df.limit(5).withColumn("chars", F.lit(None).cast("int")).withColumn("author", F.lit(None).cast("string"))
    row = sketches.sketch_summary(sketches.category_sketches(nulls, distinct=["author"], measures=["chars"])).first()
    assert (row.n, row.author_distinct, row.chars_p50) == (5, 0, None)
    # Few values: exact.
    few = sketches.category_sketches(df.filter("id between 1 and 10"), distinct=["author"], measures=["chars"])
    row = sketches.sketch_summary(few).first()
    assert (row.author_distinct, row.chars_p50) == (10, 15.0)
