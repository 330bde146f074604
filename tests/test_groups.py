import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import clusters, dedup, labels, vectors
from earshot.operators.graph import connected_components


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, size=(90, 2))]
    edges += [(i, i + 1) for i in range(500, 540)] + [(900, i) for i in range(901, 960)]
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == components(nodes, edges)
    assert connected_components(df.filter("src < 0")).count() == 0


def grams(t):
    return {t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else ({t} if t else set())


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def make_texts():
    """Exact copies, one crowd of near copies, one crowd around the threshold, loners, short and empty texts."""
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghij klmno"))
    base = "".join(rng.choice(letters, 300))
    texts = [base] * 12 + ["", "", "abc", "abc", "xyz"]
    for _ in range(25):
        t = list(base)
        for at in rng.integers(0, 300, size=2):
            t[at] = "z"
        texts.append("".join(t))
    chain = list("".join(rng.choice(letters, 200)))
    for i in range(25):
        chain[int(rng.integers(0, 200))] = str(i % 10)
        if i % 2:
            chain[int(rng.integers(0, 200))] = "y"
        texts.append("".join(chain))
    texts += ["".join(rng.choice(letters, 150)) for _ in range(10)]
    return [" ".join(t.split()) for t in texts]


@pytest.mark.parametrize("block", [128, 3])
def test_near_duplicates_match_brute_force(spark, block):
    texts = make_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text_clean string")
    copies, edges = dedup.near_duplicate_edges(df, block=block)
    near = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.85]
    got = {r.row_id: r.duplicate_group_id for r in dedup.duplicate_groups(copies, edges).collect()}
    assert got == components(range(len(texts)), near)
    first = {}
    for i, j in near:
        first.setdefault(j, i)
    found = {r.row_id: (r.first_id, r.similarity) for r in dedup.first_near_duplicate(copies, edges).collect()}
    assert {k: v[0] for k, v in found.items()} == first
    assert all(s == pytest.approx(jaccard(texts[i], texts[k])) for k, (i, s) in found.items())


def test_signature_estimates_jaccard(spark):
    a, b = "the quick brown fox jumps over the lazy dog again", "the quick brown fox jumps over the lazy cat again"
    df = spark.createDataFrame([(0, a), (1, b), (2, "")], "i int, t string")
    got = [r.s for r in df.orderBy("i").select(dedup.minhash_signature(F.col("t"), permutations=512).alias("s")).collect()]
    assert got[2] is None and len(got[0]) == 512
    assert np.mean(np.array(got[0]) == np.array(got[1])) == pytest.approx(jaccard(a, b), abs=0.09)


def blobs(seed=3, dims=4):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, 0.05, size=(30, dims)) for c in (0.0, 1.0, 2.2)]
    points = np.vstack([*parts, rng.uniform(-3, 5, size=(15, dims)), np.zeros((25, dims)), np.full((2, dims), 9.0)])
    return points


def density_by_hand(x, eps, min_samples, min_size):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = [i for i in range(len(x)) if (d[i] <= eps).sum() >= min_samples]
    comp = components(core, [(i, j) for i in core for j in core if i < j and d[i, j] <= eps])
    sizes = {}
    for c in comp.values():
        sizes[c] = sizes.get(c, 0) + 1
    names = {c: k for k, c in enumerate(sorted(c for c, n in sizes.items() if n >= min_size))}
    return {i: names.get(comp.get(i), -1) for i in range(len(x))}


@pytest.mark.parametrize("eps", [0.08, 0.15, 1.3])
def test_density_clusters_match_brute_force(spark, eps):
    x = blobs()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, reduced array<double>")
    for block_points in (512, 7):
        found = clusters.density_clusters(df, eps=eps, min_cluster_size=8, block_points=block_points)
        assert {r.row_id: r.cluster_id for r in found.collect()} == density_by_hand(x, eps, 3, 8)


def test_compared_pairs_grow_with_the_clusters(spark):
    """Four times as many clusters: about four times as many compared points, and blocks of bounded size."""
    compared = []
    for n in (8, 32):
        rng = np.random.default_rng(n)
        points = np.vstack([rng.normal(c, 0.02, size=(40, 6)) for c in rng.uniform(-8, 8, size=(n, 6))])
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "id long, v array<double>")
        placed = clusters._blocked(clusters._points(df, 0.1, 3, 3), 32, 3)
        assert placed.groupBy("block").count().filter("count > 32").count() == 0
        pairs = clusters.block_pairs(placed, 0.1, 3)
        compared.append(sum(r["n_left"] * r["n_right"] for r in pairs.collect()))
    assert compared[1] <= 6 * compared[0] and compared[1] <= 0.2 * (32 * 40) ** 2


def unit(seed, n, dims):
    m = np.random.default_rng(seed).normal(size=(n, dims))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def linkage_by_hand(m, k):
    groups = [[i] for i in range(len(m))]
    while len(groups) > k:
        best = min(
            (1 - np.mean([m[i] @ m[j] for i in a for j in b]), x, y)
            for x, a in enumerate(groups)
            for y, b in enumerate(groups)
            if x < y
        )
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_parent_themes_match_average_linkage(spark, block_bytes):
    m = unit(5, 14, 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "cluster_id int, centroid array<double>")
    got = {}
    for r in clusters.parent_themes(df, n_parents=4, block_bytes=block_bytes).collect():
        got.setdefault(r.parent_id, set()).add(r.cluster_id)
    assert {frozenset(g) for g in got.values()} == linkage_by_hand(m, 4)
    assert [min(got[p]) for p in sorted(got)] == sorted(min(g) for g in got.values())


def test_soft_assign_blocks_and_untouched_rows(spark):
    m = unit(9, 60, 5)
    rows = [(i, v.tolist(), -1 if i % 4 == 0 else i % 7) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, cluster_id int")
    whole = {r.row_id: tuple(r) for r in vectors.soft_assign(df).collect()}
    parts = {r.row_id: tuple(r) for r in vectors.soft_assign(df, block_bytes=100).collect()}
    assert whole == parts
    for i, _, c in rows:
        assert c == -1 or whole[i][2] == c
        assert (whole[i][2] == -1) == (c == -1 and whole[i][3] < 0)
    nothing = vectors.soft_assign(df.withColumn("cluster_id", F.lit(-1)))
    assert nothing.filter("soft_cluster_id = -1 and soft_sim = 0").count() == 60


def test_neighbors_blocks_and_duplicates(spark):
    m = unit(11, 40, 5)
    m[30:] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "row_id long, embedding array<double>")
    anchors = df.filter("row_id in (3, 35, 8)").select("row_id")
    whole = sorted(tuple(r) for r in vectors.nearest_neighbors(df, anchors, k=4).collect())
    assert whole == sorted(tuple(r) for r in vectors.nearest_neighbors(df, anchors, k=4, block_bytes=45).collect())
    assert [r[2] for r in whole if r[0] == 35] == [3, 30, 31, 32, 33]
    others = vectors.nearest_neighbors(df, anchors, k=4, include_self=False).collect()
    assert all(r.anchor_id != r.neighbor_id for r in others) and len(others) == 12


def test_representatives(spark):
    m = unit(13, 30, 6)
    rows = [(i, v.tolist(), 1 if i < 25 else 2) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, cluster_id int")
    got = {}
    for r in labels.representatives(df, k=6).orderBy("cluster_id", "position").collect():
        got.setdefault(r.cluster_id, []).append(r.row_id)
    assert got[2] == [25, 26, 27, 28, 29]
    x = m[:25]
    c = x.mean(axis=0)
    rel = x @ (c / np.linalg.norm(c))
    want = [int(rel.argmax())]
    while len(want) < 6:
        score = 0.5 * rel - 0.5 * (x @ x[want].T).max(axis=1)
        score[want] = -9
        want.append(int(score.argmax()))
    assert got[1] == want


def test_embeddings(spark):
    df = spark.createDataFrame([(0, "good app"), (1, "good app"), (2, "bad ads"), (3, "")], "row_id long, text_clean string")
    got = {r.row_id: np.array(r.embedding) for r in vectors.embed_texts(df, dim=64).collect()}
    assert all(len(v) == 64 for v in got.values()) and np.array_equal(got[0], got[1])
    assert [round(float(np.linalg.norm(got[i])), 5) for i in range(4)] == [1, 1, 1, 0]
    custom = vectors.embed_texts(df, dim=2, encoder=lambda ts: np.array([[len(t), 1.0] for t in ts]))
    assert custom.count() == 4
    with pytest.raises(Exception, match="encoder returned shape"):
        vectors.embed_texts(df, dim=3, encoder=lambda ts: np.zeros((len(ts), 2))).collect()


def test_label_parents(spark):
    c = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (3, 1), (-1, -1)], "cluster_id int, parent_id int")
    named = spark.createDataFrame([(1, "one", 2), (2, "two", 9)], "cluster_id int, label string, size long")
    got = {r.parent_id: tuple(r)[1:] for r in labels.label_parents(c, named).collect()}
    assert got == {0: (3, 2, "two · one"), 1: (1, 0, "(unlabeled)")}


@pytest.mark.parametrize("block", [128, 3])
def test_linking_without_pairs_finds_the_same(spark, block):
    texts = make_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, text_clean string").repartition(3)
    linked = dedup.linked_texts(df, block=block)
    copies, edges = dedup.near_duplicate_edges(df)
    order = lambda rows: sorted(map(tuple, rows.collect()))
    assert order(dedup.group_table(linked)) == order(dedup.duplicate_groups(copies, edges))
    want = order(dedup.first_near_duplicate(copies, edges))
    for rounds in (1, 4):
        assert order(dedup.first_near_duplicate(copies, dedup.first_links(linked, pivot_rounds=rounds))) == want


def test_a_crowd_of_near_copies_is_not_quadratic(spark, monkeypatch):
    n = 1500
    letters = "abcdefghijklmnopqrstuvwxyz     "
    rng = np.random.default_rng(3)
    base = "".join(letters[i] for i in rng.integers(0, len(letters), 400))
    rows = [(i, base[: (at := 5 + i * 7 % 390)] + f"{i:05d}" + base[at + 1 :]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, text_clean string").repartition(4)
    verified = []
    real = dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda pairs, *a: verified.append(pairs.count()) or real(pairs, *a))
    linked = dedup.linked_texts(df)
    assert dedup.group_table(linked).filter("duplicate_group_id <> 0").count() == 0
    assert dedup.first_links(linked).groupBy("a").count().collect()[0]["count"] == n - 1
    assert sum(verified) < 10 * n


def test_density_kernels_stop_where_all_is_known(monkeypatch):
    """Vectors without structure: points that are core and components that are joined are not compared again."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    asked = []
    real = clusters.Near.pairs
    monkeypatch.setattr(clusters.Near, "pairs", lambda self, i, rows: asked.append(len(rows)) or real(self, i, rows))
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 3.0**2
    ones, names = np.ones(400, np.int64), np.arange(400)
    counted = [(names[i : i + 40], x[i : i + 40], ones[i : i + 40], names[i : i + 40], ones[i : i + 40] * 2) for i in range(0, 400, 40)]
    found = {p: w for b in clusters._count_neighbours(3.0)(counted, iter(counted)) for p, w in zip(*(c.to_pylist() for c in b.columns))}
    assert {p for p, w in found.items() if w >= 2} == {p for p in range(400) if near[p].sum() >= 3}
    assert sum(asked) < 0.5 * 400 * 10
    asked.clear()
    blocks = [b[:2] + (b[3],) for b in counted]
    (links,) = clusters._spanning_links(3.0)(blocks, iter(blocks))
    pairs = list(zip(links.column(0).to_pylist(), links.column(1).to_pylist()))
    want = components(list(range(400)), [(i, j) for i in range(400) for j in np.flatnonzero(near[i]) if i < j])
    assert components(list(range(400)), pairs) == want
    assert len(pairs) == 400 - len(set(want.values()))
    assert sum(asked) < 0.5 * 400 * 10
