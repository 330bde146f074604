"""Density clusters with noise, parent themes, and the assembled cluster table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators import dedup, hierarchy, rank, vectors as vec
from earshot.operators.blocks import against_all, small_side, strips
from earshot.operators.boxes import Near, boxed, halved, near_blocks, streamed
from earshot.operators.graph import connected_components
from earshot.sources.shared import cut, cut_measured

NOISE = -1


# --------------------------------------------------------------------------- density clusters


def density_clusters(
    df: DataFrame,
    *,
    eps: float,
    min_samples: int = 3,
    min_cluster_size: int = 10,
    vec_col: str = "reduced",
    id_col: str = "row_id",
    grid_dims: int = 3,
    block_points: int = 512,
) -> DataFrame:
    """``(row_id, cluster_id)``: connected groups of core rows at distance ``eps``; all other rows are -1.

    A row is core when at least ``min_samples`` rows, itself included, lie within ``eps``.  Groups with
    fewer than ``min_cluster_size`` core rows are dropped.  Clusters are numbered by their smallest row.

    Exact.  Equal vectors become one weighted point; points of one fine cell (its diagonal is ``eps``) are
    neighbours by construction and are never compared, and a fine cell holding ``min_samples`` rows is one
    node from then on.  Other points lie in blocks of a box tree, of at most ``block_points``, and two blocks are
    compared only if their bounding boxes come within ``eps``, streaming past groups of blocks that tasks hold.  A
    point looks for neighbours only until it has enough to be core, first in the blocks of its own part of the
    tree, and blocks that are known to lie in one component are not compared, so vectors without structure do
    not have all blocks meet.  ``grid_dims`` is of no effect: boxes of all coordinates need no grid.
    """
    rows = df.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double") + 0.0).alias("v"))
    points = _blocked(_points(rows, eps, min_samples, grid_dims), block_points, grid_dims)
    # How many of the pairs lie in different parts of the tree tells if there is more than one part.
    apart = _part("left") != _part("right")
    pairs, seen = cut_measured(block_pairs(points, eps, grid_dims).select("left", "right"), "block-pairs", apart=F.count_if(apart))
    core = _core(points, pairs, eps, min_samples, seen["apart"])
    state = _joined(core, pairs, eps, seen["apart"])
    big = state.groupBy("comp").agg(F.sum("weight").alias("size")).filter(F.col("size") >= min_cluster_size)
    # Nodes are named by row ids, so a component's smallest node is its smallest row.
    numbered = rank.global_rank(big.select("comp"), ["comp"], name="number")
    by_point = state.join(numbered, "comp").select("v", (F.col("number") - 1).cast("int").alias("cluster_id"))
    return rows.join(by_point, "v", "left").select(
        F.col("id").alias("row_id"), F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id")
    )


def _points(rows: DataFrame, eps: float, min_samples: int, grid_dims: int) -> DataFrame:
    """Distinct vectors with their weight, coarse cell, fine cell and node."""
    distinct = rows.groupBy("v").agg(F.min("id").alias("p"), F.count("*").alias("weight"))
    side = F.lit(eps) / F.sqrt(F.size("v"))
    fine = F.transform("v", lambda x: F.floor(x / F.col("side")))
    coarse = [F.floor(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)) / eps).alias(f"g{i}") for i in range(grid_dims)]
    # A hair under eps on the diagonal: rounding must not put a pair just beyond it into one cell.
    placed = distinct.withColumn("side", side * (1 - 1e-9)).select("v", "p", "weight", fine.alias("fine"), *coarse)
    cells = placed.groupBy("fine").agg(F.min("p").alias("cell"), F.sum("weight").alias("cell_weight"))
    dense = F.col("cell_weight") >= min_samples
    return (
        placed.join(cells, "fine")
        .withColumn("dense", dense)
        .withColumn("node", F.when(dense, F.col("cell")).otherwise(F.col("p")))
        .drop("fine")
    )


def _blocked(points: DataFrame, block_points: int, grid_dims: int) -> DataFrame:
    """Add ``block``, of a box tree over all coordinates."""
    return halved(points.drop(*[f"g{i}" for i in range(grid_dims)]), block_points)


def block_pairs(points: DataFrame, eps: float, grid_dims: int) -> DataFrame:
    """``(left, right, n_left, n_right)``: pairs of blocks, each with itself too, whose boxes come within ``eps``."""
    sizes = points.groupBy("block").agg(F.count("*").alias("n"), F.min("p").alias("first"), (F.max("p") + 1).alias("last"))
    sizes = cut(sizes, "sizes")
    near = near_blocks(boxed(points), sizes.select("block", F.lit(float(eps)).alias("reach"), "first", "last"))
    for side in ("left", "right"):
        near = near.join(sizes.select(F.col("block").alias(side), F.col("n").alias(f"n_{side}")), side)
    return near.select("left", "right", "n_left", "n_right")


def _part(block: str) -> Column:
    """The part of the tree a block is in: some 32 blocks, which one task can hold."""
    return F.substring(block, F.lit(1), F.length(block) - 5)


def _core(points: DataFrame, pairs: DataFrame, eps: float, min_samples: int, apart: int) -> DataFrame:
    """The core points.  Points that do not find enough in their own part of the tree look in all."""
    state = points.withColumn("need", F.lit(min_samples).cast("bigint") - F.col("cell_weight"))
    columns = ("weight", "cell", "need")
    # A task compares what it holds with all that streams past, of other parts too: the second step counts anew.
    for among in [pairs.filter(_part("left") == _part("right")), pairs] if apart else [pairs]:
        side = state.select("block", "p", "v", *columns)
        found = streamed(side.filter("need > 0"), side, among, _count_neighbours(eps), "p bigint, w bigint", columns)
        around = found.groupBy("p").agg(F.sum("w").alias("around"))
        enough = F.when(F.col("around") >= F.col("need"), 0).otherwise(F.col("need"))
        state = cut(state.join(around, "p", "left").withColumn("need", enough).drop("around"), "counted")
    return state.filter("need <= 0").drop("need")


def _joined(core: DataFrame, pairs: DataFrame, eps: float, apart: int) -> DataFrame:
    """Core points with the component ``comp`` of each, named by its smallest node.

    Components are joined within the parts of the tree, then between one block of each part and those of the others,
    and then between all blocks that are not known to lie in one component.
    """
    nodes = core.groupBy("node").agg(F.max("cell").alias("cell"))
    # Core points of one sparse fine cell are neighbours too (at most min_samples - 1 of them).
    first = nodes.groupBy("cell").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    links = nodes.join(first, "cell").filter("node <> a").select("a", F.col("node").alias("b"))
    state = core.withColumn("comp", F.col("node"))

    def step(among: DataFrame, links: DataFrame | None) -> DataFrame:
        slim = state.select("block", "p", "v", "comp")
        found = streamed(slim, slim, among, _spanning_links(eps), "a bigint, b bigint", ("comp",), mirrored=False)
        comps = connected_components(found if links is None else found.unionAll(links), src="a", dst="b")
        named = state.join(comps.withColumnRenamed("node", "comp"), "comp", "left")
        return cut(named.withColumn("comp", F.coalesce("component", "comp")).drop("component"), "joined")

    state = step(pairs.filter(_part("left") == _part("right")), links)
    if not apart:
        return state
    heads = state.groupBy(_part("block").alias("part")).agg(F.min("block").alias("head"))
    between = pairs.join(heads.select(F.col("head").alias("left")), "left", "left_semi")
    state = step(between.join(heads.select(F.col("head").alias("right")), "right", "left_semi"), None)
    ends = cut(state.groupBy("block").agg(F.min("comp").alias("first"), F.max("comp").alias("last")), "ends")
    open_ = pairs
    for side in ("left", "right"):
        open_ = open_.join(ends.select(F.col("block").alias(side), F.col("first").alias(f"{side}_first"), F.col("last").alias(f"{side}_last")), side)
    one = F.least("left_first", "right_first") == F.greatest("left_last", "right_last")
    return step(open_.filter(~one).select("left", "right"), None)


def _count_neighbours(eps: float):
    """Kernel of ``streamed``: rows around held points that are not of their fine cell, until they are enough."""

    def kernel(own: list[tuple], blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        points, xs, _, cells, needs = (list(c) for c in zip(*own))
        near, left = Near(xs, eps), [n.copy() for n in needs]
        for _, y, weight, cell, _ in blocks:
            for i in near.blocks(y):
                rows = np.flatnonzero(left[i] > 0)
                if not len(rows):
                    continue
                a, b = near.pairs(i, rows)
                fits = cells[i][a] != cell[b]
                np.subtract.at(left[i], a[fits], weight[b[fits]])
        for p, need, rest in zip(points, needs, left):
            seen = need > rest
            yield pa.RecordBatch.from_arrays([pa.array(p[seen]), pa.array((need - rest)[seen])], ["p", "w"])

    return kernel


def _spanning_links(eps: float):
    """Kernel of ``streamed``: links that join the components of near points, each as long as it joins two."""

    def kernel(own: list[tuple], blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        links: list[tuple[int, int]] = []

        def find(n: int) -> int:
            while (up := root.setdefault(n, n)) != n:
                root[n] = n = root[up]
            return n

        def roots(names: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.array([find(n) for n in names.tolist()], np.int64)[at]

        near = Near([b[1] for b in own], eps)
        known = [np.unique(b[2], return_inverse=True) for b in own]
        mine, fresh = [roots(*k) for k in known], [0] * len(own)
        for _, y, comp in blocks:
            names = np.unique(comp, return_inverse=True)
            theirs, seen = roots(*names), len(links)
            for i in near.blocks(y):
                if fresh[i] != len(links):
                    mine[i], fresh[i] = roots(*known[i]), len(links)
                if seen != len(links):
                    theirs, seen = roots(*names), len(links)
                one = theirs[0] if (theirs == theirs[0]).all() else None
                rows = np.arange(len(mine[i])) if one is None else np.flatnonzero(mine[i] != one)
                if not len(rows):
                    continue
                a, b = near.pairs(i, rows)
                x, z = mine[i][a], theirs[b]
                differ = x != z
                for m, n in set(zip(x[differ].tolist(), z[differ].tolist())):
                    r, s = find(m), find(n)
                    if r != s:
                        root[max(r, s)] = min(r, s)
                        links.append((m, n))
        a, b = (list(c) for c in zip(*links)) if links else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return kernel


# --------------------------------------------------------------------------- parent themes


def parent_themes(centroids: DataFrame, *, n_parents: int = 12, block_bytes: int = vec.BLOCK_BYTES) -> DataFrame:
    """``(cluster_id, parent_id)``: average-linkage groups of cluster centroids by cosine distance.

    The mean cosine between two groups of unit vectors is the product of the groups' mean vectors, so a
    group is carried as its mean.  Every round merges all pairs of groups that are each other's nearest;
    for average linkage this gives the same tree as merging one pair at a time, in about log K rounds.
    The tree is then cut where ``n_parents`` groups are left.  Parents are numbered by their smallest cluster.
    """
    first = centroids.select(
        F.col("cluster_id").cast("bigint").alias("g"), F.col("centroid").alias("mean"), F.lit(1).cast("bigint").alias("n")
    )
    count = F.count(F.lit(1))
    groups, size = cut_measured(first, "groups", n=count, dim=F.max(F.size("mean")))
    total = left = size["n"]
    merges, step = None, 0
    while total > n_parents and left > 1:
        nearest = _mutual_nearest(groups, block_bytes, left, size["dim"])
        mutual, found = cut_measured(nearest, "mutual", n=count)
        tagged = mutual.select("a", "b", (1 - F.col("sim")).alias("height"), F.lit(step).alias("step"))
        merges = tagged if merges is None else merges.unionAll(tagged)
        left, step = left - found["n"], step + 1
        if left > 1:
            groups = cut(_merge(groups, mutual), "groups")
    leaves = centroids.select(F.col("cluster_id").cast("bigint").alias("node"))
    if merges is None:
        comps = leaves.select("node", F.col("node").alias("component"))
    else:
        # Heights of a tree of K leaves: the number of merges to take is known, their place by a global rank.
        placed = rank.global_rank(merges, ["height", "step", "a"], name="place")
        taken = placed.filter(F.col("place") <= total - max(n_parents, 1))
        joined = connected_components(taken, src="a", dst="b")
        comps = leaves.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    # At most n_parents rows.
    roots = comps.groupBy("component").agg(F.min("node").alias("first"))
    number = F.row_number().over(Window.orderBy("first")) - 1
    return comps.join(F.broadcast(roots.select("component", number.alias("parent_id"))), "component").select(
        F.col("node").cast("int").alias("cluster_id"), "parent_id"
    )


def _mutual_nearest(groups: DataFrame, block_bytes: int, n: int, dim: int) -> DataFrame:
    """Pairs ``(a, b, sim)``, a < b, of groups that are each other's nearest; ties go to the smallest id."""
    side = small_side(groups, "g", "mean", block_bytes=block_bytes, n=n, dim=dim)
    if side is None:
        names = dict(key="g", vec_col="mean", side_key="g", side_vec="mean")
        near = against_all(
            groups, groups, _nearest_other, "g bigint, other bigint, sim double", dim=dim, block_bytes=block_bytes, **names
        )
    else:
        near = groups.select("g", _nearest_other_udf(groups, side)("g", "mean").alias("x")).select("g", "x.*")
    # Without another group there is none that is nearest.
    best = near.filter("other is not null")
    back = best.select(F.col("g").alias("other"), F.col("other").alias("g"))
    return best.join(back, ["g", "other"]).filter("g < other").select(F.col("g").alias("a"), F.col("other").alias("b"), "sim")


def _nearest_other(keys, g: np.ndarray, means: np.ndarray, side) -> Iterator[pa.RecordBatch]:
    other, sim = np.zeros(len(g), np.int64), np.full(len(g), -np.inf)
    for names, block in side:
        for s in strips(len(g)):
            sims = np.round(means[s] @ block.T, vec.DIGITS)
            sims[g[s, None] == names[None, :]] = -np.inf
            at = sims.argmax(axis=1)
            found = sims[np.arange(len(sims)), at]
            other[s] = np.where(found > sim[s], names[at], other[s])
            sim[s] = np.maximum(sim[s], found)
    yield pa.RecordBatch.from_arrays([keys, pa.array(other, mask=np.isinf(sim)), pa.array(sim)], ["g", "other", "sim"])


def _nearest_other_udf(df: DataFrame, side: tuple):
    shared = df.sparkSession.sparkContext.broadcast(side)

    @F.pandas_udf("other bigint, sim double")
    def nearest(g: pd.Series, mean: pd.Series) -> pd.DataFrame:
        means = np.stack(mean.to_numpy())
        (found,) = _nearest_other(pa.array(g), g.to_numpy(), means, [shared.value])
        return pd.DataFrame({"other": found.column(1).to_pandas(integer_object_nulls=True), "sim": found.column(2).to_numpy()})

    return nearest


def _merge(groups: DataFrame, mutual: DataFrame) -> DataFrame:
    into = mutual.select(F.col("b").alias("g"), F.col("a").alias("into"))
    moved = groups.join(into, "g", "left").select(F.coalesce("into", "g").alias("g"), "mean", "n")
    # One or two rows per group.
    both = moved.groupBy("g").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("n", "mean"))).alias("m"))
    one, two = F.col("m")[0], F.get("m", F.lit(1))
    mixed = F.zip_with(
        one["mean"], two["mean"], lambda x, y: (x * one["n"] + y * two["n"]) / F.col("total")
    )
    return both.select("g", F.when(F.size("m") == 1, one["mean"]).otherwise(mixed).alias("mean"), F.col("total").alias("n"))


def parent_of(clusters: DataFrame, parents: DataFrame, *, cluster_col: str, name: str) -> DataFrame:
    """Add the parent of ``cluster_col``; noise and unknown clusters get -1."""
    table = parents.select(F.col("cluster_id").alias(cluster_col), F.col("parent_id").alias(name))
    return clusters.join(table, cluster_col, "left").withColumn(name, F.coalesce(name, F.lit(NOISE)))


# --------------------------------------------------------------------------- the cluster table


def cluster_table(
    texts: DataFrame,
    vectors: DataFrame,
    *,
    text_col: str = "text_clean",
    id_col: str = "row_id",
    vec_col: str = "embedding",
    n_components: int = 10,
    eps: float | None = None,
    min_samples: int = 3,
    min_cluster_size: int = 10,
    min_sim: float = 0.0,
    n_parents: int = 12,
) -> DataFrame:
    """One row per vector: cluster, soft cluster, parents, duplicate group and 2-d position.

    Duplicate groups, projection, density clusters, soft assignment and parent themes, all joined on the row id.
    Clusters are hierarchical; ``eps``, a distance between projected vectors, asks for those of one level instead.
    """
    ids = vectors.select(F.col(id_col).alias("row_id"), F.col(vec_col).alias("embedding"))
    groups = dedup.assign_duplicate_groups(texts, text_col=text_col, id_col=id_col)
    reduced = cut(vec.project(ids, dims=n_components), "reduced")
    sizes = dict(min_samples=min_samples, min_cluster_size=min_cluster_size)
    labels = hierarchy.density_clusters_auto(reduced, **sizes) if eps is None else density_clusters(reduced, eps=eps, **sizes)
    labelled = cut(ids.join(labels, "row_id"), "labelled")
    centroids = cut(vec.cluster_centroids(labelled), "centroids")
    soft = vec.soft_assign(labelled, min_sim=min_sim, centroids=centroids)
    parents = parent_themes(centroids, n_parents=n_parents)
    flat = vec.project(ids, dims=2, name="xy").select("row_id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
    out = parent_of(soft, parents, cluster_col="cluster_id", name="parent_id")
    out = parent_of(out, parents, cluster_col="soft_cluster_id", name="soft_parent_id")
    return (
        out.join(groups, "row_id", "left")
        .join(flat, "row_id")
        .select(
            "row_id",
            "cluster_id",
            "soft_cluster_id",
            F.col("soft_sim").cast("float").alias("soft_sim"),
            "parent_id",
            "soft_parent_id",
            "duplicate_group_id",
            F.col("x").cast("float").alias("x"),
            F.col("y").cast("float").alias("y"),
        )
    )


def cluster_summary(table: DataFrame) -> DataFrame:
    """One row of counts and shares about a cluster table."""
    n = F.count("*")
    groups = F.count_distinct("duplicate_group_id")
    real = F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))
    parent = F.when(F.col("parent_id") != NOISE, F.col("parent_id"))
    return table.agg(
        n.alias("rows"),
        F.count_distinct(real).alias("n_clusters"),
        F.count_distinct(parent).alias("n_parents"),
        _rounded_share(F.count_if(F.col("cluster_id") == NOISE), n, 4).alias("noise_fraction_strict"),
        _rounded_share(F.count_if(F.col("soft_cluster_id") == NOISE), n, 4).alias("noise_fraction_soft"),
        groups.alias("n_duplicate_groups"),
        F.round(F.lit(100) * (1 - F.try_divide(groups, n)), 2).alias("duplicate_collapse_pct"),
    )


def _rounded_share(part: Column, whole: Column, digits: int) -> Column:
    return F.round(F.try_divide(part, whole), digits)
