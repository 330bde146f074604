"""Density clusters without a distance, against one link and one point at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import boxes, hierarchy


def plain(rows, min_samples, size, allow_single=False):
    """Clusters by (id, vector) rows, as sets of ids; every link is tried."""
    points = {}
    for i, v in sorted(rows):
        points.setdefault(tuple(v), []).append(i)
    points = sorted((ids[0], v, len(ids), ids) for v, ids in points.items())
    n = len(points)
    d = np.array([[round(float(np.sqrt(((np.array(a[1]) - np.array(b[1])) ** 2).sum())), 12) for b in points] for a in points])
    core = []
    for x in range(n):
        held, out = points[x][2] - 1, 0.0
        for y in sorted((y for y in range(n) if y != x), key=lambda y: d[x, y]):
            if held >= min_samples:
                break
            held, out = held + points[y][2], d[x, y]
        core.append(out)
    links = sorted((max(d[x, y], core[x], core[y]), x, y) for x in range(n) for y in range(x + 1, n))
    comp = {x: x for x in range(n)}
    members = {x: [x] for x in range(n)}
    weight = {x: points[x][2] for x in range(n)}
    cluster = {x: -x - 1 if points[x][2] >= size else None for x in range(n)}
    own = {x: cluster[x] for x in range(n)}
    mass = {-x - 1: points[x][2] / max(core[x], 1e-12) for x in range(n) if points[x][2] >= size}
    parent, less = {}, {}
    for r, (m, x, y) in enumerate(links, 1):
        a, b = comp[x], comp[y]
        if a == b:
            continue
        density = 1 / max(m, 1e-12)
        big = [c for c in (a, b) if weight[c] >= size]
        new = r if len(big) == 2 else cluster[big[0]] if big else r if weight[a] + weight[b] >= size else None
        if len(big) == 2:
            for c in big:
                parent[cluster[c]], less[cluster[c]] = r, weight[c] * density
        if new is not None:
            leaving = weight[a] + weight[b] if new == r else weight[b] if weight[a] >= size else weight[a]
            mass[new] = mass.get(new, 0.0) + leaving * density
            for p in members[a] + members[b]:
                own[p] = own[p] if own[p] is not None else new
        for p in members[b]:
            comp[p] = a
        members[a] += members.pop(b)
        weight[a] += weight.pop(b)
        cluster[a] = new
    chosen, best = set(), {}
    for c in sorted(mass):
        inside = sum(best[x] for x in mass if parent.get(x) == c)
        own_mass = mass[c] - less.get(c, 0.0)
        wins = own_mass >= inside and (allow_single or c in parent)
        best[c] = own_mass if wins else inside
        if wins:
            chosen.add(c)
    out = {}
    for p in range(n):
        c, top = own[p], None
        while c is not None:
            top = c if c in chosen else top
            c = parent.get(c)
        if top is not None:
            out.setdefault(top, set()).update(points[p][3])
    return sorted(map(sorted, out.values()))


def clustered(seed, n, dim, copies=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(4, dim)) * 6
    rows = [(i, [float(x) for x in middles[i % 4] + rng.normal(size=dim) * (0.3 + i % 4)]) for i in range(n)]
    rows += [(n + i, [float(x) for x in rng.uniform(-12, 12, dim)]) for i in range(n // 5)]
    return rows + [(10_000 + i, rows[i % 3][1]) for i in range(copies)]


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "row_id bigint, reduced array<double>").repartition(4)
    got = hierarchy.density_clusters_auto(df, **options).collect()
    assert sorted(r.row_id for r in got) == sorted(i for i, _ in rows)
    out = {}
    for r in got:
        if r.cluster_id >= 0:
            out.setdefault(r.cluster_id, []).append(r.row_id)
    assert sorted(out) == list(range(len(out)))
    assert [min(out[c]) for c in sorted(out)] == sorted(min(x) for x in out.values())
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize(
    "seed,n,dim,copies,min_samples,size,block_points,range_links",
    [(1, 60, 2, 0, 3, 5, 30, 1000), (2, 36, 3, 15, 2, 5, 20, 12), (3, 60, 5, 0, 4, 4, 1000, 30)],
)
def test_clusters_equal_the_plain_hierarchy(spark, seed, n, dim, copies, min_samples, size, block_points, range_links):
    rows = clustered(seed, n, dim, copies)
    want = plain(rows, min_samples, size)
    options = dict(min_samples=min_samples, min_cluster_size=size, block_points=block_points, range_links=range_links)
    assert found(spark, rows, **options) == want and len(want) > 1


def test_few_rows(spark):
    assert found(spark, [], min_cluster_size=2) == []
    assert found(spark, [(5, [1.0, 2.0])], min_cluster_size=2) == []
    same = [(i, [0.5, 0.5]) for i in range(6)] + [(9, [3.0, 3.0])]
    assert found(spark, same, min_samples=2, min_cluster_size=3) == []
    assert found(spark, same, min_samples=2, min_cluster_size=3, allow_single=True) == plain(same, 2, 3, True)


def test_far_blocks_are_not_compared(spark):
    rows = clustered(7, 300, 2)
    points = spark.createDataFrame([(i, v, 1) for i, v in rows], "p bigint, v array<double>, weight bigint")
    tree = boxes.box_tree(points, 30)
    sizes = [r["count"] for r in tree.points.groupBy("block").count().collect()]
    assert max(sizes) <= 30 and sum(sizes) == len(rows)
    reach = tree.points.groupBy("block").agg(F.lit(0.4).alias("reach"), F.min("p").alias("first"), F.max("p").alias("last"))
    pairs = {(r.left, r.right) for r in boxes.near_blocks(tree, reach).collect()}
    held = {}
    for r in tree.points.collect():
        held.setdefault(r.block, []).append(r.v)
    gap = lambda a, b: np.sqrt(sum(max(0.0, min(x[k] for x in held[a]) - max(x[k] for x in held[b]), min(x[k] for x in held[b]) - max(x[k] for x in held[a])) ** 2 for k in range(2)))
    want = {(a, b) for a in held for b in held if a <= b and gap(a, b) <= 0.4 and (a != b or len(held[a]) > 1)}
    assert pairs == want and len(pairs) < len(held) ** 2 / 3


def test_a_deep_tree_is_settled_in_few_rounds(spark, monkeypatch):
    n = 60
    chain = [(i, i + 1 if i < n else None, float(1 + i % 3)) for i in range(1, n + 1)]
    tree = spark.createDataFrame(chain, "cluster bigint, parent bigint, stability double").repartition(3)
    written = []
    real = hierarchy.cut
    monkeypatch.setattr(hierarchy, "cut", lambda df, name: written.append(name) or real(df, name))
    got = {r.cluster: r.top for r in hierarchy.excess_of_mass(tree).collect()}
    assert got == {i: max(j for j in range(1, n) if j % 3 == 2) if i <= 59 else None for i in range(1, 60)}
    assert len(written) == 1


def test_a_block_travels_once_for_each_group(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(rng.normal(size=(400, 8)))]
    tree = boxes.box_tree(spark.createDataFrame(rows, "p bigint, v array<double>, weight bigint"), 20)
    names = sorted(r.block for r in tree.points.select("block").distinct().collect())
    every = spark.createDataFrame([(a, b) for a in names for b in names if a <= b], "left string, right string")

    def kernel(own, blocks):
        import pyarrow as pa

        blocks = list(blocks)
        sizes = [sum(len(b[0]) for b in side) for side in (own, blocks)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*sizes, sum(sizes) * 8 * 8)], ["held", "met", "bytes"])

    points = tree.points.select("block", "p", "v")
    got = boxes.streamed(points, points, every, kernel, "held bigint, met bigint, bytes bigint", (), held_bytes=200 * 64).collect()
    # Every point meets every point, though blocks hold 20 at most and meet more than 20 others.
    assert sum(r.held * r.met for r in got) == 400 * 400
    assert max(r.held for r in got) <= 200 and len(names) > 20
    groups = len({r.held for r in got})
    assert sum(r.met for r in got) <= 400 * max(groups, 4)
