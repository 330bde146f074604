import numpy as np

from earshot.operators import boxes, neighbors


def plain(rows, k):
    names = [i for i, _ in rows]
    v = np.array([x for _, x in rows])
    v = v / np.sqrt((v**2).sum(axis=1))[:, None]
    out = []
    for i, row in zip(names, np.round(v @ v.T, 12)):
        best = sorted((-s, j) for s, j in zip(row, names) if j != i)[:k]
        out += [(i, at + 1, j, round(-s, 9)) for at, (s, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in rows], "row_id bigint, embedding array<double>")
    got = neighbors.knn_graph(df.unionAll(spark.createDataFrame([(-5, None)], df.schema)).repartition(4), **options)
    return sorted((r.row_id, r.rank, r.neighbor_id, round(r.similarity, 9)) for r in got.collect())


def test_neighbours_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 3))
    rows = [(i * 3, middles[i % 12] + rng.normal(size=3) * 0.02) for i in range(200)]
    rows += [(1000 + i, rows[i % 2][1]) for i in range(30)]
    asked = []
    real = neighbors.near_blocks
    monkeypatch.setattr(neighbors, "near_blocks", lambda *a: (lambda p: asked.append(p.count()) or p)(real(*a)))
    assert found(spark, rows, k=4, block_points=16) == plain(rows, 4)
    blocks = 200 / 16
    assert asked[0] < blocks * blocks / 2


def test_few_rows(spark):
    assert found(spark, [(1, [1, 0])], k=3) == []
    rows = [(1, [1, 0]), (2, [0, 2]), (3, [5, 0])]
    assert found(spark, rows, k=3) == plain(rows, 3)


def test_products_screen_in_single_precision(monkeypatch):
    """Only a block's own bound takes products in doubles, unless the points are too near for single precision."""
    rng = np.random.default_rng(6)
    calls = []
    real = boxes.squares
    monkeypatch.setattr(boxes, "squares", lambda *a: calls.append(1) or real(*a))
    for offset, doubled in ((0.0, False), (1e6, True)):
        v = rng.normal(size=(320, 8)) + offset
        blocks = [(np.arange(i, i + 40), v[i : i + 40]) for i in range(0, 320, 40)]
        calls.clear()
        (*got,) = boxes.nearest_points(5, False, 12)(blocks, iter(blocks))
        assert (len(calls) > len(blocks)) == doubled
        near = {}
        for batch in got:
            for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                near.setdefault(p, set()).add(q)
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
        assert [near[p] for p in range(320)] == [set(np.argsort(row, kind="stable")[:5].tolist()) for row in d]
