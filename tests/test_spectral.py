import numpy as np

from earshot.operators import neighbors, spectral, vectors


def curve(n=90):
    """Points of a closed curve that its two principal components fold onto itself."""
    t = np.arange(n) * 2 * np.pi / n
    return np.stack([f(m * t) * s for m, s in ((1, 0.6), (2, 1.0), (3, 1.0)) for f in (np.cos, np.sin)], axis=1)


def frame(spark, points):
    return spark.createDataFrame([(i * 2, list(map(float, v))) for i, v in enumerate(points)], "row_id bigint, embedding array<double>")


def dense(rows):
    ids = sorted({r.row_id for r in rows})
    at = {x: i for i, x in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for r in rows:
        w[at[r.row_id], at[r.neighbor_id]] += 0.5
        w[at[r.neighbor_id], at[r.row_id]] += 0.5
    return ids, w


def overlap(points, ids, at, k):
    """Share of a row's k nearest that are among its k nearest on the map."""
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    far = np.linalg.norm(at[:, None] - at[None], axis=2)
    share = []
    for i in range(len(ids)):
        others = [j for j in range(len(ids)) if j != i]
        real = set(sorted(others, key=lambda j: -unit[i] @ unit[j])[:k])
        share.append(len(real & set(sorted(others, key=lambda j: far[i, j])[:k])) / k)
    return np.mean(share)


def test_map_keeps_neighbours(spark):
    points = curve()
    df = frame(spark, points).cache()
    k, rounds = 12, 40
    got = {r.row_id: r.reduced for r in spectral.spectral_map(df, k=k, rounds=rounds, copy_links=8).collect()}
    ids, w = dense(neighbors.knn_graph(df, k=k).collect())
    assert sorted(got) == ids
    at, deg = np.array([got[i] for i in ids]), w.sum(axis=1)
    # Mean 0, variance 1, no correlation, weighted by degree.
    assert np.allclose(deg @ at, 0, atol=1e-8)
    assert np.allclose((at.T * deg) @ at / deg.sum(), np.eye(2), atol=1e-9)
    # The same rounds on the whole matrix.
    s = w / np.sqrt(deg[:, None] * deg[None])
    constant = np.sqrt(deg / deg.sum())[:, None]
    y = np.array([[spark_start(i, a) - 0.5 for a in range(2)] for i in ids])
    for t in range(rounds + 1):
        y = y - constant @ (constant.T @ y)
        q, r = np.linalg.qr(y)
        q = q * np.sign(np.diag(r))
        y = s @ q + (t % 2) * q
    assert np.allclose(at, q * np.sqrt(deg.sum() / deg)[:, None], atol=1e-7)
    # Near the true axes, and a better map than the principal components.
    values, axes = np.linalg.eigh(s)
    inside = axes[:, -3:] @ (axes[:, -3:].T @ q)
    assert np.linalg.norm(inside) > 0.97 * np.sqrt(2)
    plain = {r.row_id: r.reduced for r in vectors.project(df, dims=2).collect()}
    assert overlap(points, ids, at, k) > overlap(points, ids, np.array([plain[i] for i in ids]), k) + 0.2


def spark_start(node, axis):
    import hashlib

    return int(hashlib.md5(f"{axis}|{node}".encode()).hexdigest()[:8], 16) / 2**32


def test_odd_input(spark):
    schema = "row_id bigint, embedding array<double>"
    assert spectral.spectral_map(spark.createDataFrame([], schema), rounds=2).collect() == []
    assert spectral.spectral_map(spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], schema), rounds=2).collect() == []
    # Fewer nodes than axes, and a hub that a third of all rows hang on: finite numbers for each row.
    two = spectral.spectral_map(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema), rounds=3).collect()
    assert [len(r.reduced) for r in two] == [2, 2] and all(np.isfinite(r.reduced).all() for r in two)
    copies = [(i, [1.0, 0.5]) for i in range(60)] + [(100 + i, [float(i), 1.0]) for i in range(60)]
    got = spectral.spectral_map(spark.createDataFrame(copies, schema), k=3, rounds=5, copy_links=10).collect()
    assert len(got) == 120 and all(np.isfinite(r.reduced).all() for r in got)
