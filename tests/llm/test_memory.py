"""What the pipeline's stages hold in an executor: Arrow batches, freed memory, files of small rounds."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from earshot.llm import common, tokens
from earshot.llm.queries import tokenizer_path
from earshot.operators import graph
from earshot.sources.shared import BATCH_BYTES, bound_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    before = spark.conf.getAll.get(KEY)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def test_stages_bound_batches_by_bytes(unbounded):
    spark = unbounded
    rows = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 600).alias("text"))
    docs = rows.withColumns({"source": F.lit("a"), "lang": F.lit("en"), "n_chars": F.lit(3000).cast("bigint")})
    corpus_pipeline.mix_sources(spark, docs, "")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes], "n": [batch.num_rows]})

    seen = rows.mapInArrow(sizes, "size bigint, n bigint").collect()
    assert sum(r["n"] for r in seen) == 5000
    assert max(r["size"] for r in seen) < 1.1 * BATCH_BYTES


def test_own_bound_of_a_session_stands(unbounded):
    unbounded.conf.set(KEY, 1000)
    bound_batches(unbounded)
    assert unbounded.conf.get(KEY) == "1000"


def test_memory_is_given_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append("kept"))
    monkeypatch.setattr(tokens, "give_back", lambda: calls.append("task"))
    monkeypatch.setattr(common, "_KEPT", {})
    batch = pa.RecordBatch.from_pydict({"id": [1], "text": ["some words"], "part": pa.array([0], pa.int32())})
    assert len(list(tokens._block_writer(tokenizer_path(), b"", "", 0, 3)(iter([batch])))) == 1
    common.word_hashes()
    common.word_hashes()
    assert calls == ["task", "kept"]


def test_rounds_of_components_write_as_many_files_as_their_edges_need(spark, monkeypatch):
    wrote = []
    cut = graph.cut_measured

    def noted(df, name, **metrics):
        out, seen = cut(df, name, **metrics)
        folder = os.path.dirname(out.inputFiles()[0].removeprefix("file:"))
        wrote.append(sum(f.endswith(".parquet") for f in os.listdir(folder)))
        return out, seen

    monkeypatch.setattr(graph, "cut_measured", noted)
    edges = spark.range(2000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = graph.connected_components(edges.filter("src % 10 < 9"))
        assert got.filter("component <> node - node % 10").count() == 0
        assert got.count() == 2000
        assert set(wrote[1:]) == {1}
        monkeypatch.setattr(graph, "TASK_EDGES", 600)
        wrote.clear()
        graph.connected_components(edges.filter("src % 10 < 9"))
        assert set(wrote[1:]) == {4}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
