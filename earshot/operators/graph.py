"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.sources.shared import cut_measured

#: Edges that one task writes; every file costs the executor three processes where Hadoop has no native library.
TASK_EDGES = 200_000


def connected_components(edges: DataFrame, *, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node that has an edge; a component is named by its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014).  Every step is a min
    aggregate, which shrinks a hub before the shuffle, and an inner join that adaptive execution splits
    when one key is hot.  Each round is written out, so lineage does not grow.
    """
    pairs = (
        edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).filter("hi <> lo").distinct()
    )
    marks = {"n": F.count(F.lit(1)), "mix": F.bit_xor(F.xxhash64("hi", "lo"))}
    state, mark = cut_measured(pairs, "edges", **marks)
    for _ in range(max_rounds):
        before = mark
        # A round makes no more edges than there were, so their number tells how many files they need.
        step = _small_star(_large_star(state)).coalesce(1 + before["n"] // TASK_EDGES)
        state, mark = cut_measured(step, "edges", **marks)
        if mark == before:
            roots = state.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            return state.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionAll(
        edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    )
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    return larger.join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()
