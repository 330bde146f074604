"""Sides that are too large to be handed to every task."""

import __spark_entry__ as entry
import numpy as np
import pytest
from harness import compare, connect
from pyspark.sql import functions as F

from earshot.operators import blocks, clusters, labels, rank, vectors
from earshot.plans import fixtures as fx
from earshot.plans.catalog_vectors import N_PARENTS, r

SMALL = "/root/testdata/sf0.001"
# A twentieth of ten centroids of 64 coordinates.
TINY = 256

IN_BLOCKS = {
    "soft_assign": lambda v: r(vectors.soft_assign(v, cluster_col="masked_id", block_bytes=TINY)),
    "knn_exact": lambda v: r(vectors.nearest_neighbors(v, rank.sample_ids(v, n=20), k=5, block_bytes=TINY)),
    "parent_themes": lambda v: clusters.parent_themes(vectors.cluster_centroids(v), n_parents=N_PARENTS, block_bytes=TINY),
    "mmr_representatives": lambda v: labels.representatives(v, block_bytes=TINY),
}


@pytest.mark.parametrize("name", IN_BLOCKS)
def test_blocks_give_what_sql_gives(spark, name):
    centers = vectors.cluster_centroids(fx.vectors(spark, SMALL))
    assert vectors.small_side(centers, "cluster_id", "centroid", block_bytes=TINY) is None
    query = lambda s, sf_dir: IN_BLOCKS[name](fx.vectors(s, sf_dir))
    assert compare(spark, connect(SMALL), query, entry.oracle_sql()[name], SMALL) is None


def test_a_hot_key_is_dealt_over_many_tasks(spark):
    rng = np.random.default_rng(4)
    m, side = rng.normal(size=(300, 4)), rng.normal(size=(6, 4))
    rows = [(i, v.tolist(), 1 if i < 200 else i % 6, None if i % 3 else 0.5) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "row_id long, v array<double>, cluster_id int, near double")
    # Clusters 4 and 5 have no vector; row 7 is where cluster 1 has its own from.
    own = [(i, [1000, 7, 1001, 1002][i], side[i].tolist()) for i in range(4)]
    few = spark.createDataFrame(own, "cluster_id int, row_id long, c array<double>")
    known = dict(key="cluster_id", vec_col="v", side_vec="c", name="near", id_col="row_id", n=4, dim=4)
    got = blocks.with_own(df, few, block_bytes=64, **known)
    assert got.columns == df.columns and dict(got.dtypes) == dict(df.dtypes)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    tasks = got.filter("cluster_id = 1").select(F.spark_partition_id().alias("task")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert tasks > 2
    found = {x.row_id: x for x in got.collect()}
    assert len(found) == 300 and found[7].near == float("inf")
    for i, v, c, before in rows:
        if i == 7:
            continue
        want = [x for x in (before, float(m[i] @ side[c]) if c < 4 else None) if x is not None]
        assert found[i].near == (pytest.approx(max(want)) if want else None)


def test_ties_between_blocks_and_text_ids(spark):
    rows = [(f"r{i}", [1.0, 0.0] if i % 2 else [0.6, 0.8], -1) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id string, embedding array<float>, cluster_id int")
    cents = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 4, 12, 6)], "cluster_id int, centroid array<double>")
    got = vectors.soft_assign(df, centroids=cents, block_bytes=16).collect()
    assert len(got) == 20 and {x.soft_cluster_id for x in got} == {4}
    assert {x.soft_sim for x in got if int(x.row_id[1:]) % 2} == {1.0} and all(x.own_sim is None for x in got)
    none = vectors.soft_assign(df.limit(0), centroids=cents, block_bytes=16)
    assert none.count() == 0 and none.columns == ["row_id", "cluster_id", "soft_cluster_id", "soft_sim", "own_sim"]


def test_representatives_in_blocks(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(
        [(i, v.tolist(), 1 if i < 60 else 2 + i % 2) for i, v in enumerate(rng.normal(size=(90, 5)))],
        "row_id long, embedding array<double>, cluster_id int",
    )
    whole = sorted(tuple(x) for x in labels.representatives(df, k=4).collect())
    assert whole == sorted(tuple(x) for x in labels.representatives(df, k=4, block_bytes=50).collect())
