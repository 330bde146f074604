"""Hierarchical density clusters: no distance has to be given.

The distance at which two rows come together is their mutual reachability: the greatest of their distance and of
both rows' core distances, which is that to the ``min_samples``-th other row.  The minimum spanning tree of these
distances gives the hierarchy; a group of at least ``min_cluster_size`` rows is a cluster in it, from the distance
at which it joins another such group down to where it falls apart; and the clusters with the greatest excess of
mass, none inside another, are the result.

The tree comes from rounds in which components find their lightest links, in lists of nearest points where these
settle it, else over blocks that are near enough to hold it.  The links are then dealt by rank over ranges of bounded size: halving the ranges, the links of
a lower half contract what the upper half joins, all ranges at once, until every range is one task's work.

Equal vectors are one point of their weight.  Ties between links go to the smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators import rank
from earshot.operators.boxes import SLACK, Boxes, BoxTree, block_reach, box_tree, near_blocks, nearest_points, off, squares, streamed
from earshot.operators.graph import connected_components
from earshot.sources.shared import cut, cut_measured

NOISE = -1
DIGITS = 12
#: Distances that round to the same may be this far apart.
TIE = 4 * 10.0**-DIGITS
#: Nearest points listed for every point; most lightest links are among them.
LISTED = 16
#: Links closer than this count as this close.
CLOSEST = 1e-12


def _lightest(own: list[tuple], blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Kernel of ``streamed``: the lightest link of every held component that leaves it, at most its ``reach``.

    Products screen the links against the lightest one known; only what passes is computed again.
    """
    points, xs, core, comp, reach = (list(c) for c in zip(*own))
    boxes, norms = Boxes(xs), [(x * x).sum(axis=1) for x in xs]
    names, index = np.unique(np.concatenate(comp), return_inverse=True)
    index = np.split(index, np.cumsum([len(x) for x in xs])[:-1])
    bound, best = np.full(len(names), np.inf), np.full(len(names), np.inf)
    lo, hi, other = (np.zeros(len(names), np.int64) for _ in range(3))
    for at, far in zip(index, reach):
        bound[at] = far
    for q, y, core_q, comp_q, _ in blocks:
        yy = (y * y).sum(axis=1)
        apart = boxes.squares(y)
        for i, x in enumerate(xs):
            within, slack = bound[index[i]], off(norms[i], yy)
            if apart[i] * (1 - 1e-9) > (within.max() + TIE) ** 2 + slack:
                continue
            s = squares(x, y, norms[i], yy)
            a, b = np.nonzero(s <= ((within + TIE) ** 2 + slack)[:, None])
            fits = (comp[i][a] != comp_q[b]) & (np.maximum(core[i][a], core_q[b]) <= within[a])
            a, b = a[fits], b[fits]
            if not len(a):
                continue
            cores, c = np.maximum(core[i][a], core_q[b]), index[i][a]
            least = np.full(len(names), np.inf)
            np.minimum.at(least, c, np.maximum(np.sqrt(np.maximum(s[a, b] + slack, 0.0)), cores))
            fits = np.maximum(np.sqrt(np.maximum(s[a, b] - slack, 0.0)), cores) <= least[c] + TIE
            a, b, c, cores = a[fits], b[fits], c[fits], cores[fits]
            m = np.maximum(np.round(np.sqrt(((x[a] - y[b]) ** 2).sum(axis=1)), DIGITS), cores)
            low, high = np.minimum(points[i][a], q[b]), np.maximum(points[i][a], q[b])
            order = np.lexsort((high, low, m, c))
            first = order[np.concatenate([[True], c[order][1:] != c[order][:-1]])]
            c, m, low, high, there = c[first], m[first], low[first], high[first], comp_q[b[first]]
            less = (m < best[c]) | ((m == best[c]) & ((low < lo[c]) | ((low == lo[c]) & (high < hi[c]))))
            c = c[less]
            best[c], lo[c], hi[c], other[c] = m[less], low[less], high[less], there[less]
            bound[c] = np.minimum(bound[c], best[c])
    found = np.isfinite(best)
    yield pa.RecordBatch.from_arrays(
        [pa.array(x[found]) for x in (names, best, lo, hi, other)], ["comp", "m", "lo", "hi", "other"]
    )


def core_distances(tree: BoxTree, min_samples: int, listed: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """``(points with core and limit, near)``: core distances, and links ``(p, q, d)`` to the ``listed`` nearest points.

    A point's own block bounds how far its nearest points can be; only blocks within that are compared then.  No point
    that is not listed is nearer than ``limit``.
    """
    points, listed = tree.points, max(listed, min_samples)
    pairs = cut(near_blocks(tree, block_reach(tree, listed + 1, cosine=False)), "block-pairs")
    slim = points.select("block", "p", "v")
    found = streamed(slim, slim, pairs, nearest_points(listed + 1, False, DIGITS), "p bigint, q bigint, m double", ())
    place = F.row_number().over(Window.partitionBy("p").orderBy("m", "q"))
    best = found.filter("p <> q").withColumn("place", place).filter(F.col("place") <= listed)
    weights = points.select(F.col("p").alias("q"), F.col("weight").alias("w"))
    near = cut(best.join(weights, "q").select("p", "q", F.col("m").alias("d"), "w"), "near")
    kth = points.join(_kth(near, min_samples), "p", "left")
    limit = F.when(F.col("lines") >= listed, F.col("furthest")).otherwise(float("inf"))
    cored = kth.withColumn("core", F.coalesce(_core("weight", min_samples), F.lit(0.0)))
    cored = cored.withColumn("limit", F.greatest("core", F.coalesce(limit, F.lit(float("inf")))))
    return cut(cored.drop("nearest", "lines", "furthest"), "cored"), near.select("p", "q", "d")


def _kth(near: DataFrame, k: int) -> DataFrame:
    """Distances of the ``k`` nearest points with their weights, the number of points listed and the furthest of them."""
    nearest = F.slice(F.sort_array(F.collect_list(F.struct("d", "w"))), 1, k).alias("nearest")
    return near.groupBy("p").agg(nearest, F.count(F.lit(1)).alias("lines"), F.max("d").alias("furthest"))


def _core(weight: str, k: int):
    """The distance at which ``k`` other rows are reached, or the greatest there is."""
    start = F.struct((F.col(weight) - 1).alias("n"), F.lit(0.0).alias("d"))
    step = lambda s, x: F.struct((s["n"] + x["w"]).alias("n"), F.when(s["n"] >= k, s["d"]).otherwise(x["d"]).alias("d"))
    return F.aggregate("nearest", start, step)["d"]


def spanning_tree(points: DataFrame, tree: BoxTree, near: DataFrame) -> DataFrame:
    """Links ``(lo, hi, m)`` of the minimum spanning tree of ``points`` (with ``core``, ``limit``), found in rounds.

    The lightest listed link of a component is its lightest of all if it is below the ``limit`` of all its points.  While
    that settles a fourth of the components, no distance is computed.  Else the others look for theirs, but for the
    largest, which the others find: only points whose limit does not rule it out look, and only at blocks within what
    is known, the lightest listed link or the distance to a point elsewhere.
    """
    core = points.select("p", "core")
    mutual = near.join(core.withColumnRenamed("core", "cp"), "p").join(core.select(F.col("p").alias("q"), F.col("core").alias("cq")), "q")
    mutual = cut(mutual.select("p", "q", F.greatest("d", "cp", "cq").alias("m")), "mutual")
    state, seen = cut_measured(points.withColumn("comp", F.col("p")), "components", n=F.count(F.lit(1)))
    left, links = seen["n"], None
    while left > 1:
        comp = state.select("p", "comp")
        ends = mutual.join(comp, "p").join(comp.select(F.col("p").alias("q"), F.col("comp").alias("other")), "q").filter("comp <> other")
        ends = cut(ends, "ends")
        mutual = ends.select("p", "q", "m")
        link = lambda there: F.struct("m", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), F.col(there).alias("other")).alias("x")
        known = ends.select("comp", link("other")).unionAll(ends.select(F.col("other").alias("comp"), link("comp")))
        known = known.groupBy("comp").agg(F.min("x").alias("x"))
        facts = state.groupBy("comp").agg(F.min("limit").alias("limit"), F.count(F.lit(1)).alias("n")).join(known, "comp", "left")
        sure = F.coalesce(F.col("x.m") < F.col("limit"), F.lit(False)).alias("sure")
        facts, seen = cut_measured(facts.select("comp", "n", "x.*", sure), "facts", sure=F.count_if("sure"), largest=F.max(F.struct("n", "comp")))
        chosen = facts.filter("sure").select("comp", "m", "lo", "hi", "other")
        if seen["sure"] * 4 < left:
            asking = facts.filter(~F.col("sure") & (F.col("comp") != seen["largest"]["comp"]))
            chosen = chosen.unionAll(_searched(state, tree, asking))
        chosen = cut(chosen, "chosen")
        new, taken = cut_measured(chosen.select("lo", "hi", "m").distinct(), "links", n=F.count(F.lit(1)))
        links = new if links is None else links.unionAll(new)
        left -= taken["n"]
        joined = connected_components(chosen, src="comp", dst="other")
        state = cut(
            state.join(joined, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component"),
            "components",
        )
    empty = points.sparkSession.createDataFrame([], "lo bigint, hi bigint, m double")
    return empty if links is None else links


def _searched(state: DataFrame, tree: BoxTree, asking: DataFrame) -> DataFrame:
    """The lightest links of the components in ``asking``, which have the lightest listed one, if any."""
    bounds = asking.join(_far_points(state), "comp").select("comp", F.least("far", "m").alias("reach"))
    asked = cut(state.join(bounds, "comp").filter("limit <= reach"), "asked")
    reach = state.groupBy("block").agg(F.min("comp").alias("first"), F.max("comp").alias("last"))
    reach = reach.join(asked.groupBy("block").agg(F.max("reach").alias("reach")), "block", "left")
    # A block that does not look is met by those that do.
    pairs = cut(near_blocks(tree, reach.withColumn("reach", F.coalesce("reach", F.lit(-1.0)))), "block-pairs")
    columns = ("core", "comp", "reach")
    side = state.withColumn("reach", F.lit(-1.0))
    schema = "comp bigint, m double, lo bigint, hi bigint, other bigint"
    found = streamed(asked.select("block", "p", "v", *columns), side, pairs, _lightest, schema, columns)
    listed = asking.filter("m is not null").select("comp", "m", "lo", "hi", "other")
    both = found.unionAll(listed).groupBy("comp").agg(F.min(F.struct("m", "lo", "hi", "other")).alias("x"))
    return both.select("comp", "x.*")


def _far_points(state: DataFrame) -> DataFrame:
    """``(comp, far)``: the mutual reachability of one point of each component to one point elsewhere."""
    one = state.select("comp", "p", "v", "core").orderBy("p").first()
    two = state.select("comp", "p", "v", "core").filter(F.col("comp") != one["comp"]).orderBy("p").first()
    own = state.groupBy("comp").agg(F.min_by(F.struct("v", "core"), "p").alias("x")).select("comp", "x.*")

    def to(z) -> Column:
        there = F.lit(np.array(z["v"], float))
        d = F.sqrt(F.aggregate(F.zip_with("v", there, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        return F.greatest(d * SLACK + 10.0**-DIGITS, "core", F.lit(z["core"]))

    return own.select("comp", F.when(F.col("comp") == one["comp"], to(two)).otherwise(to(one)).alias("far"))


# --------------------------------------------------------------------------- the hierarchy


def dendrogram(points: DataFrame, links: DataFrame, min_cluster_size: int, range_links: int) -> DataFrame:
    """``(r, m, lo, hi, a, na, b, nb, cluster)``: what each link joins, in order.

    ``a`` and ``b`` name the two sides by the last link inside them, or minus the point of a lone one, with their
    rows ``na`` and ``nb``.  ``cluster`` is the link that made the cluster which the link adds to, null while small.
    """
    ranked = rank.global_rank(links, ["m", "lo", "hi"], name="r")
    size = points.select("p", F.col("weight").alias("n"))
    edges = ranked.join(size.select(F.col("p").alias("lo"), F.col("n").alias("na")), "lo").join(
        size.select(F.col("p").alias("hi"), F.col("n").alias("nb")), "hi"
    )
    part = F.floor((F.col("r") - 1) / range_links).cast("bigint")
    edges = edges.select("r", "m", "lo", "hi", (-F.col("lo")).alias("a"), "na", (-F.col("hi")).alias("b"), "nb", part.alias("part"))
    edges, seen = cut_measured(edges, "ranked", parts=F.max("part"))
    width = 1
    while width <= (seen["parts"] or 0):
        width *= 2
    many = width > 1
    while width > 1:
        edges = cut(_contracted(edges, width), "contracted")
        width //= 2
    joined = edges.groupBy("part").applyInPandas(
        _solver(min_cluster_size), "r bigint, m double, lo bigint, hi bigint, a bigint, na bigint, b bigint, nb bigint, cluster bigint"
    )
    joined = cut(joined, "joined")
    while many:
        # A cluster that goes on from an earlier range is looked up there, twice as far back each time.
        back = joined.select(F.col("r").alias("cluster"), F.col("cluster").alias("further"))
        moved = joined.join(back, "cluster", "left").withColumn("further", F.coalesce("further", "cluster"))
        moved, seen = cut_measured(moved, "joined", n=F.count_if(F.col("further") != F.col("cluster")))
        joined, many = moved.drop("cluster").withColumnRenamed("further", "cluster"), seen["n"]
    return joined


def _contracted(edges: DataFrame, width: int) -> DataFrame:
    """In every run of ``width`` ranges, the links of the upper half join what those of the lower half have made."""
    run = F.floor(F.col("part") / width).cast("bigint")
    placed = edges.withColumn("run", run).withColumn("upper", F.col("part") % width >= width // 2)
    name = lambda side: F.concat_ws(":", "run", side)
    lower = placed.filter(~F.col("upper"))
    pairs = cut(lower.select(name("a").alias("x"), name("b").alias("y"), "r", "na", "nb"), "lower")
    comps = cut(connected_components(pairs, src="x", dst="y"), "runs")
    nodes = pairs.select(F.col("x").alias("node"), "r", F.col("na").alias("n")).unionAll(pairs.select(F.col("y").alias("node"), "r", F.col("nb").alias("n")))
    nodes = nodes.groupBy("node").agg(F.max("r").alias("r"), F.max("n").alias("n"))
    made = nodes.join(comps, "node").groupBy("component").agg(F.max("r").alias("last"), F.sum("n").alias("rows"))
    made = cut(comps.join(made, "component").select("node", "last", "rows"), "made")
    for side in ("a", "b"):
        now = made.select(F.col("node").alias("_key"), F.col("last").alias("_last"), F.col("rows").alias("_rows"))
        key = F.when(F.col("upper"), name(side))
        placed = placed.withColumn("_key", key).join(now, "_key", "left").withColumns(
            {side: F.coalesce("_last", side), f"n{side}": F.coalesce("_rows", f"n{side}")}
        ).drop("_key", "_last", "_rows")
    return placed.drop("run", "upper")


def _solver(min_cluster_size: int):
    def solve(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values("r")
        root: dict[int, int] = {}
        held: dict[int, tuple[int, int]] = {}
        cluster: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        out = []
        for r, m, lo, hi, a, na, b, nb in edges[["r", "m", "lo", "hi", "a", "na", "b", "nb"]].itertuples(index=False):
            x, y = find(a), find(b)
            (a, na), (b, nb) = held.get(x, (a, na)), held.get(y, (b, nb))
            big = [n for n, size in ((a, na), (b, nb)) if size >= min_cluster_size]
            own = None
            if len(big) == 1:
                # The side's cluster, or the link before this range that it goes back to.
                own = cluster.get(big[0], big[0])
            elif big or na + nb >= min_cluster_size:
                own = r
            if own is not None:
                cluster[r] = own
            root[y] = x
            held[x] = (r, na + nb)
            out.append((r, m, lo, hi, a, na, b, nb, own))
        made = pd.DataFrame(out, columns=["r", "m", "lo", "hi", "a", "na", "b", "nb", "cluster"])
        return made.astype({"cluster": "Int64"})

    return solve


def condensed_tree(points: DataFrame, joined: DataFrame, min_cluster_size: int) -> DataFrame:
    """``(cluster, parent, stability)``: clusters of the hierarchy; the one that holds all has no parent.

    A point of so many equal rows that it is a cluster by itself is named by its negative.
    """
    big_a, big_b = F.col("na") >= min_cluster_size, F.col("nb") >= min_cluster_size
    both = F.col("na") + F.col("nb")
    density = 1.0 / F.greatest("m", F.lit(CLOSEST))
    leaving = F.when(F.col("cluster") == F.col("r"), both).when(big_a, F.col("nb")).otherwise(F.col("na"))
    left = joined.filter("cluster is not null").select("cluster", (leaving * density).alias("mass"))
    heavy = points.filter(F.col("weight") >= min_cluster_size)
    alone = heavy.select((-F.col("p")).alias("cluster"), (F.col("weight") / F.greatest("core", F.lit(CLOSEST))).alias("mass"))
    mass = left.unionAll(alone).groupBy("cluster").agg(F.sum("mass").alias("mass"))
    splits = joined.filter(big_a & big_b)
    sides = [
        splits.select(F.col(s).alias("last"), F.col(f"n{s}").alias("n"), F.col("r").alias("parent"), density.alias("born")) for s in ("a", "b")
    ]
    names = joined.select(F.col("r").alias("last"), "cluster")
    born = sides[0].unionAll(sides[1]).join(names, "last", "left").select(F.coalesce("cluster", "last").alias("cluster"), "parent", "n", "born")
    tree = mass.join(born, "cluster", "left")
    own = F.col("mass") - F.coalesce(F.col("n") * F.col("born"), F.lit(0.0))
    return cut(tree.select("cluster", "parent", own.alias("stability")), "condensed")


def _settle(clusters: pd.DataFrame) -> pd.DataFrame:
    """All clusters that are left, in order: a cluster is named by a later link than those within it."""
    clusters = clusters.sort_values("cluster")
    within = dict(zip(clusters["cluster"], clusters["within"]))
    wins, best = [], []
    for name, parent, own in zip(clusters["cluster"], clusters["parent"], clusters["stability"]):
        wins.append(bool(own >= within[name]))
        best.append(float(own) if wins[-1] else within[name])
        if parent in within:
            within[parent] += best[-1]
    parents = clusters["parent"].astype("Int64")
    return pd.DataFrame({"cluster": clusters["cluster"], "parent": parents, "wins": np.array(wins, bool), "best": np.array(best, float)})


def excess_of_mass(tree: DataFrame, *, allow_single: bool = False, last_clusters: int = 200_000) -> DataFrame:
    """``(cluster, top)``: for each cluster in or under a chosen one, the chosen one.

    From the leaves up, a cluster is chosen over those within it if it is at least as stable as they are together.
    One round settles all clusters whose children are settled.  Once no more than ``last_clusters`` are left, one task
    settles them: a tree may be as deep as it has clusters.
    """
    count, kind = F.count(F.lit(1)), "cluster bigint, parent bigint, wins boolean, best double"
    nodes = tree if allow_single else tree.withColumn("stability", F.when(F.col("parent").isNotNull(), F.col("stability")))
    open_, seen = cut_measured(nodes.withColumns({"within": F.lit(0.0)}), "open", n=count)
    settled = None
    while seen["n"]:
        if seen["n"] <= last_clusters:
            done = cut(open_.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_settle, kind), "settled")
            settled = done if settled is None else settled.unionAll(done)
            break
        waiting = open_.filter("parent is not null").select(F.col("parent").alias("cluster")).distinct()
        ready = open_.join(waiting, "cluster", "left_anti")
        wins = F.coalesce(F.col("stability") >= F.col("within"), F.lit(False))
        done = cut(ready.select("cluster", "parent", wins.alias("wins"), F.when(wins, F.col("stability")).otherwise(F.col("within")).alias("best")), "settled")
        settled = done if settled is None else settled.unionAll(done)
        up = done.filter("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("more"))
        rest = open_.join(waiting, "cluster", "left_semi").join(up, "cluster", "left")
        rest = rest.withColumn("within", F.col("within") + F.coalesce("more", F.lit(0.0))).drop("more")
        open_, seen = cut_measured(rest, "open", n=count)
    if settled is None:
        return tree.select("cluster", F.col("cluster").alias("top")).limit(0)
    # The uppermost chosen cluster of each, looking twice as far up each time.
    path, seen = cut_measured(
        settled.select("cluster", F.col("parent").alias("up"), F.when(F.col("wins"), F.col("cluster")).alias("top")), "paths", n=F.count("up")
    )
    while seen["n"]:
        above = path.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        path, seen = cut_measured(
            path.join(above, "up", "left").select("cluster", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top")), "paths", n=F.count("up")
        )
    return path.filter("top is not null").select("cluster", "top")


def density_clusters_auto(
    df: DataFrame,
    *,
    min_samples: int = 3,
    min_cluster_size: int = 10,
    allow_single: bool = False,
    vec_col: str = "reduced",
    id_col: str = "row_id",
    block_points: int = 512,
    range_links: int = 200_000,
) -> DataFrame:
    """``(row_id, cluster_id)``: density clusters without a distance; rows in none are -1.

    Clusters are numbered by their smallest row.  A cluster of all rows is none unless ``allow_single``.  Rows
    without a vector are -1.  ``block_points`` bounds what is compared in a task, ``range_links`` what is joined.
    """
    rows = df.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double") + 0.0).alias("v"))
    distinct = rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    points = rank.global_rank(distinct, ["id"], name="p")
    tree = box_tree(points.select("p", "v", "weight"), block_points)
    cored, near = core_distances(tree, min_samples)
    links = spanning_tree(cored, tree, near)
    joined = dendrogram(cored, links, min_cluster_size, range_links)
    top = excess_of_mass(condensed_tree(cored, joined, min_cluster_size), allow_single=allow_single)
    # What is joined while small goes over to a cluster as a whole, with the link that takes up its last one.
    small = F.col("na") + F.col("nb") < min_cluster_size
    ends = cut(joined.filter(small).select("lo", "hi", "r"), "small")
    comps = connected_components(ends, src="lo", dst="hi")
    last = ends.join(comps, F.col("lo") == F.col("node")).groupBy("component").agg(F.max("r").alias("last"))
    pieces = cored.select("p", "weight").join(comps, F.col("p") == F.col("node"), "left").join(last, "component", "left")
    pieces = pieces.select("p", "weight", F.coalesce("last", -F.col("p")).alias("last"))
    taken = [joined.filter(F.col(f"n{s}") < min_cluster_size).select(F.col(s).alias("last"), "cluster") for s in ("a", "b")]
    found = pieces.join(taken[0].unionAll(taken[1]).filter("cluster is not null"), "last", "left")
    # A point that is large enough by itself is a cluster by itself.
    own = F.coalesce("cluster", F.when(F.col("weight") >= min_cluster_size, -F.col("p")))
    members = cut(found.select("p", own.alias("cluster")).join(top, "cluster").select("p", "top"), "members")
    first = members.groupBy("top").agg(F.min("p").alias("first"))
    numbered = rank.global_rank(first, ["first"], name="number")
    label = members.join(numbered, "top").select("p", (F.col("number") - 1).cast("int").alias("cluster_id"))
    by_vector = points.select("p", "v").join(label, "p").select("v", "cluster_id")
    return rows.join(by_vector, "v", "left").select(F.col("id").alias("row_id"), F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id"))
