"""Vector, near-duplicate and clustering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import text as tx
from earshot.functions import vectors as vx
from earshot.operators import clusters, dedup, hierarchy, neighbors, profile, rank, spectral, vectors
from earshot.plans import fixtures as fx
from earshot.plans.catalog_text import SQL_CLEAN, SQL_COLLAPSE, fill, sql_clip
from earshot.plans.registry import Catalog

CATALOG = Catalog()
r = profile.rounded
V = fx.VECTORS_SQL


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = (F.col("row_id") % 3 + 1).cast("double")
    v = fx.vectors(spark, sf_dir).withColumn("factor", factor)
    return v.select("row_id", F.transform("embedding", lambda x: x.cast("double") * F.col("factor")).alias("embedding"))


CATALOG.add(
    "l2_normalize",
    lambda spark, sf_dir: r(
        vectors.l2_normalize(_scaled(spark, sf_dir)).select("row_id", F.posexplode("embedding").alias("pos", "x"))
    ),
    f"""WITH {V}, s AS (SELECT row_id, list_transform(v, lambda x: x * (row_id % 3 + 1)) AS v FROM vectors)
    SELECT row_id, CAST(i - 1 AS INTEGER) AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x
    FROM s, range(1, 65) t(i)""",
)


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every vector to the one with the next id."""
    v = fx.vectors(spark, sf_dir).select("row_id", "embedding")
    after = v.select((F.col("row_id") - 1).alias("row_id"), F.col("embedding").alias("next"))
    return r(v.join(after, "row_id").select("row_id", vx.dot("embedding", "next").alias("similarity")))


CATALOG.add(
    "cosine_pairs",
    cosine_pairs,
    f"""WITH {V} SELECT a.row_id, round(list_dot_product(a.v, b.v), 6) AS similarity
    FROM vectors a JOIN vectors b ON b.row_id = a.row_id + 1""",
)
CATALOG.add(
    "align_vectors",
    lambda spark, sf_dir: r(
        fx.feedback(spark, sf_dir)
        .join(fx.vectors(spark, sf_dir), "row_id")
        .select("row_id", "severity", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").alias("dim"))
    ),
    f"""WITH {fx.FEEDBACK_SQL}, {V} SELECT f.row_id, f.severity, round(v[1], 6) AS first,
      CAST(len(v) AS INTEGER) AS dim FROM feedback f JOIN vectors USING (row_id)""",
)

_ANCHORS = f"""{V}, anchors AS (SELECT row_id, v FROM vectors ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id LIMIT 20)"""
_NEAR = """SELECT a.row_id AS anchor_id, b.row_id AS neighbor_id, round(list_dot_product(a.v, b.v), 12) AS similarity
      FROM anchors a, vectors b"""


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.vectors(spark, sf_dir)
    return r(vectors.nearest_neighbors(v, rank.sample_ids(v, n=20), k=5))


CATALOG.add(
    "knn_exact",
    knn_exact,
    f"""WITH {_ANCHORS}, s AS ({_NEAR})
    SELECT anchor_id, CAST(k AS INTEGER) AS rank, neighbor_id, round(similarity, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY similarity DESC, neighbor_id) AS k FROM s) WHERE k <= 6""",
)

CATALOG.add(
    "knn_graph",
    lambda spark, sf_dir: r(neighbors.knn_graph(fx.vectors(spark, sf_dir), k=5)),
    f"""WITH {V}, s AS (SELECT a.row_id, b.row_id AS neighbor_id, round(list_dot_product(a.v, b.v)
        / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 12) AS similarity
      FROM vectors a JOIN vectors b ON a.row_id <> b.row_id)
    SELECT row_id, CAST(k AS INTEGER) AS rank, neighbor_id, round(similarity, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY similarity DESC, neighbor_id) AS k FROM s) WHERE k <= 5""",
)


def neighbor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbor_report(fx.vectors(spark, sf_dir), fx.feedback(spark, sf_dir))


_REPORT = f"""WITH {_ANCHORS}, {fx.FEEDBACK_SQL}, s AS ({_NEAR} WHERE a.row_id <> b.row_id), report AS (
    SELECT anchor_id, CAST(k AS INTEGER) AS rank, neighbor_id, similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY similarity DESC, neighbor_id) AS k FROM s) WHERE k <= 5)"""
CATALOG.add(
    "neighbor_report",
    lambda spark, sf_dir: r(neighbor_report(spark, sf_dir)),
    f"""{_REPORT} SELECT anchor_id, rank, neighbor_id, round(similarity, 6) AS similarity,
      {sql_clip('x.comment', 110)} AS anchor_text, {sql_clip('y.comment', 110)} AS neighbor_text
    FROM report JOIN feedback x ON x.row_id = anchor_id JOIN feedback y ON y.row_id = neighbor_id""",
)
CATALOG.add(
    "neighbor_quality",
    lambda spark, sf_dir: r(vectors.neighbor_quality(neighbor_report(spark, sf_dir))),
    f"""{_REPORT} SELECT round(avg(CASE WHEN rank = 1 THEN similarity END), 6) AS mean_top1,
      round(avg(similarity), 6) AS mean_topk FROM report""",
)


def centroids_sql(cluster: str, name: str = "centroids") -> str:
    return f"""{name}_means AS (SELECT {cluster} AS cluster_id, i, avg(v[i]) AS x, count(*) AS size
      FROM vectors, range(1, 65) t(i) WHERE {cluster} <> -1 GROUP BY ALL), {name} AS (
      SELECT cluster_id, size, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM (
        SELECT cluster_id, max(size) AS size, list(x ORDER BY i) AS c FROM {name}_means GROUP BY cluster_id))"""


CATALOG.add(
    "cluster_centroids",
    lambda spark, sf_dir: r(
        vectors.cluster_centroids(fx.vectors(spark, sf_dir), cluster_col="masked_id").select(
            "cluster_id", "size", F.posexplode("centroid").alias("pos", "x")
        )
    ),
    f"""WITH {V}, {centroids_sql('masked_id')}
    SELECT cluster_id, size, CAST(i - 1 AS INTEGER) AS pos, round(c[i], 6) AS x FROM centroids, range(1, 65) t(i)""",
)

SOFT_SQL = f"""{V}, {centroids_sql('masked_id')}, sims AS (
      SELECT row_id, masked_id, c.cluster_id, round(list_dot_product(v, c.c), 12) AS sim FROM vectors, centroids c), best AS (
      SELECT row_id, masked_id AS cluster_id, arg_max(cluster_id, (sim, -cluster_id)) AS best, max(sim) AS sim,
        max(CASE WHEN cluster_id = masked_id THEN sim END) AS own FROM sims GROUP BY row_id, masked_id), soft AS (
      SELECT row_id, cluster_id, CASE WHEN cluster_id = -1 AND sim >= {{min_sim}} THEN best ELSE cluster_id END
        AS soft_cluster_id, sim AS soft_sim, own AS own_sim FROM best)"""


def soft_assign(spark: SparkSession, sf_dir: str, min_sim: float = 0.0) -> DataFrame:
    return vectors.soft_assign(fx.vectors(spark, sf_dir), cluster_col="masked_id", min_sim=min_sim)


for _key, _min in {"soft_assign": 0.0, "soft_assign_strict": 0.2}.items():
    CATALOG.add(
        _key,
        lambda spark, sf_dir, m=_min: r(soft_assign(spark, sf_dir, m)),
        f"""WITH {SOFT_SQL.format(min_sim=_min)} SELECT row_id, CAST(cluster_id AS INTEGER) AS cluster_id,
          CAST(soft_cluster_id AS INTEGER) AS soft_cluster_id, round(soft_sim, 6) AS soft_sim,
          round(own_sim, 6) AS own_sim FROM soft""",
    )


def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent of every soft cluster; cluster 7 is left out of the parent table and so counts as noise."""
    known = fx.clusters(spark, sf_dir).filter("cluster_id not in (-1, 7)").select("cluster_id", "parent_id").distinct()
    return clusters.parent_of(
        soft_assign(spark, sf_dir).select("row_id", "soft_cluster_id"),
        known,
        cluster_col="soft_cluster_id",
        name="soft_parent_id",
    )


CATALOG.add(
    "parent_lookup",
    parent_lookup,
    f"""WITH {SOFT_SQL.format(min_sim=0.0)} SELECT row_id, CAST(soft_cluster_id AS INTEGER) AS soft_cluster_id,
      CAST(CASE WHEN soft_cluster_id IN (-1, 7) THEN -1 ELSE soft_cluster_id % 3 END AS INTEGER) AS soft_parent_id
    FROM soft""",
)

# --------------------------------------------------------------------------- near-duplicates


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), tx.clean_text(F.col("text")).alias("text_clean")
    )


def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _comments(spark, sf_dir).select("row_id", tx.gram_text(F.col("text_clean")).alias("t"))
    return t.select("row_id", tx.gram_summary(F.col("t")).alias("g")).select("row_id", "g.n_grams", "g.first", "g.last")


_PREPARED = fill(SQL_COLLAPSE, f"lower({fill(SQL_CLEAN, 'text')})")
_GRAM_LIST = """list_distinct(CASE WHEN length(t) >= 5 THEN list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))
      WHEN length(t) > 0 THEN [t] ELSE [] END)"""
CATALOG.add(
    "char_ngrams",
    char_ngrams,
    f"""SELECT row_id, CAST(len(g) AS INTEGER) AS n_grams, list_min(g) AS first, list_max(g) AS last FROM (
      SELECT row_id, {_GRAM_LIST} AS g FROM (SELECT doc_id AS row_id, {_PREPARED} AS t FROM documents))""",
)


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _comments(spark, sf_dir).select("row_id", tx.gram_text(F.col("text_clean")).alias("t"))
    return t.select("row_id", dedup.minhash_signature(F.col("t")).alias("signature"))


CATALOG.add("minhash_signature", minhash_signature)

# The check finds pairs by exact prefix filtering, a different method from the one it checks.
NEAR_SQL = f"""docs AS (SELECT doc_id AS id, {_PREPARED} AS t FROM documents), firsts AS (
      SELECT min(id) AS id, t FROM docs WHERE t <> '' GROUP BY t), copies AS (
      SELECT d.id, coalesce(f.id, d.id) AS first_id FROM docs d LEFT JOIN firsts f ON f.t = d.t), grams AS MATERIALIZED (
      SELECT id, unnest({_GRAM_LIST}) AS g FROM firsts), sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
    counts AS (SELECT g, count(*) AS df FROM grams GROUP BY g), prefix AS MATERIALIZED (
      SELECT id, g FROM (SELECT x.id, x.g, s.n, row_number() OVER (PARTITION BY x.id ORDER BY c.df, x.g) AS r
        FROM grams x JOIN counts c ON c.g = x.g JOIN sizes s ON s.id = x.id) WHERE r <= n - ceil(0.85 * n - 1e-9) + 1),
    candidates AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON b.g = a.g AND a.id < b.id),
    common AS (SELECT c.a, c.b, count(*) AS k FROM candidates c JOIN grams x ON x.id = c.a
      JOIN grams y ON y.id = c.b AND y.g = x.g GROUP BY c.a, c.b),
    pairs AS MATERIALIZED (SELECT a, b, k::DOUBLE / (x.n + y.n - k) AS similarity FROM common
      JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.85),
    sym AS MATERIALIZED (SELECT a, b, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs)"""


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row that has an earlier near-duplicate, with the first of them."""
    return r(dedup.first_near_duplicates(_comments(spark, sf_dir)))


CATALOG.add(
    "near_dup_pairs",
    near_dup_pairs,
    f"""WITH {NEAR_SQL}, around AS (
      SELECT first_id AS a, first_id AS b, 1.0::DOUBLE AS similarity FROM copies GROUP BY first_id
      UNION ALL SELECT a, b, similarity FROM sym)
    SELECT x.id AS row_id, min(y.id) AS first_id, round(arg_min(s.similarity, y.id), 6) AS similarity
    FROM copies x JOIN around s ON s.a = x.first_id JOIN copies y ON y.first_id = s.b AND y.id < x.id GROUP BY x.id""",
)
GROUPS_SQL = f"""WITH RECURSIVE {NEAR_SQL}, reach AS (
      SELECT DISTINCT a AS node, a AS other FROM sym
      UNION SELECT reach.node, sym.b FROM reach JOIN sym ON sym.a = reach.other), named AS (
      SELECT node, min(other) AS component FROM reach GROUP BY node), duplicate_groups AS (
      SELECT c.id AS row_id, coalesce(n.component, c.first_id) AS duplicate_group_id
      FROM copies c LEFT JOIN named n ON n.node = c.first_id)"""
CATALOG.add(
    "duplicate_groups",
    lambda spark, sf_dir: dedup.assign_duplicate_groups(_comments(spark, sf_dir)),
    f"{GROUPS_SQL} SELECT row_id, duplicate_group_id FROM duplicate_groups",
)

# --------------------------------------------------------------------------- clusters

EPS, MIN_SAMPLES, MIN_SIZE = 1.15, 3, 5
CATALOG.add(
    "density_clusters",
    lambda spark, sf_dir: clusters.density_clusters(
        fx.vectors(spark, sf_dir), eps=EPS, min_samples=MIN_SAMPLES, min_cluster_size=MIN_SIZE, vec_col="embedding"
    ),
    f"""WITH RECURSIVE {V}, close AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b FROM vectors a, vectors b
        WHERE list_distance(a.v, b.v) <= {EPS}),
      core AS MATERIALIZED (SELECT a AS node FROM close GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
      links AS MATERIALIZED (SELECT a, b FROM close WHERE a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)),
      reach AS (SELECT node, node AS other FROM core
        UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other),
      named AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
      big AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster_id FROM named
        GROUP BY component HAVING count(*) >= {MIN_SIZE})
    SELECT v.row_id, CAST(coalesce(big.cluster_id, -1) AS INTEGER) AS cluster_id FROM vectors v
      LEFT JOIN named n ON n.node = v.row_id LEFT JOIN big ON big.component = n.component""",
)
AUTO_SAMPLES, AUTO_SIZE = 3, 5
CATALOG.add(
    "density_clusters_auto",
    lambda spark, sf_dir: hierarchy.density_clusters_auto(
        fx.vectors(spark, sf_dir), min_samples=AUTO_SAMPLES, min_cluster_size=AUTO_SIZE, vec_col="embedding"
    ),
    # One point after the other joins the spanning tree, one link after the other the hierarchy.
    f"""WITH RECURSIVE {V}, pts AS MATERIALIZED (SELECT min(row_id) AS p, v, count(*) AS weight FROM vectors GROUP BY v),
      far AS MATERIALIZED (SELECT a.p AS a, b.p AS b, a.weight - 1 AS own, b.weight AS w, round(list_distance(a.v, b.v), 12) AS d
        FROM pts a JOIN pts b ON a.p <> b.p),
      reached AS (SELECT a, d, own + sum(w) OVER (PARTITION BY a ORDER BY d, b) AS n, own FROM far),
      core AS MATERIALIZED (SELECT a AS p, CASE WHEN max(own) >= {AUTO_SAMPLES} THEN 0.0
        ELSE coalesce(min(d) FILTER (n >= {AUTO_SAMPLES}), max(d)) END AS core FROM reached GROUP BY a),
      mutual AS MATERIALIZED (SELECT a, b, greatest(d, x.core, y.core) AS m, least(a, b) AS lo, greatest(a, b) AS hi
        FROM far JOIN core x ON x.p = a JOIN core y ON y.p = b),
      prim AS (
        SELECT 0 AS step, p, p = (SELECT min(p) FROM pts) AS done, m, lo, hi
        FROM pts LEFT JOIN mutual ON b = p AND a = (SELECT min(p) FROM pts)
        UNION ALL
        SELECT step + 1, r.p, r.done OR r.p = k.p,
          CASE WHEN (e.m, e.lo, e.hi) < (r.m, r.lo, r.hi) THEN e.m ELSE r.m END,
          CASE WHEN (e.m, e.lo, e.hi) < (r.m, r.lo, r.hi) THEN e.lo ELSE r.lo END,
          CASE WHEN (e.m, e.lo, e.hi) < (r.m, r.lo, r.hi) THEN e.hi ELSE r.hi END
        FROM prim r CROSS JOIN (SELECT p FROM prim WHERE NOT done ORDER BY m, lo, hi LIMIT 1) k
        LEFT JOIN mutual e ON e.a = k.p AND e.b = r.p),
      links AS (SELECT step, min(row(m, lo, hi)) AS x FROM prim WHERE NOT done GROUP BY step),
      ranked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x) AS r, x[1] AS m, x[2] AS lo, x[3] AS hi FROM links),
      grow AS (
        SELECT 0::BIGINT AS r, p, p AS comp, weight::HUGEINT AS n,
          CASE WHEN weight >= {AUTO_SIZE} THEN -p END AS cl, CASE WHEN weight >= {AUTO_SIZE} THEN -p END AS own FROM pts
        UNION ALL
        SELECT j.r, g.p, CASE WHEN g.comp = j.cb THEN j.ca ELSE g.comp END,
          CASE WHEN g.comp IN (j.ca, j.cb) THEN j.n ELSE g.n END, CASE WHEN g.comp IN (j.ca, j.cb) THEN j.cl ELSE g.cl END,
          coalesce(g.own, CASE WHEN g.comp IN (j.ca, j.cb) THEN j.cl END)
        FROM grow g, (SELECT e.r, a.comp AS ca, b.comp AS cb, a.n + b.n AS n,
            CASE WHEN a.n >= {AUTO_SIZE} AND b.n >= {AUTO_SIZE} THEN e.r WHEN a.n >= {AUTO_SIZE} THEN a.cl
              WHEN b.n >= {AUTO_SIZE} THEN b.cl WHEN a.n + b.n >= {AUTO_SIZE} THEN e.r END AS cl
          FROM ranked e JOIN grow a ON a.p = e.lo AND a.r = e.r - 1 JOIN grow b ON b.p = e.hi) j),
      joined AS MATERIALIZED (SELECT e.r, 1.0 / greatest(e.m, 1e-12) AS density, a.n AS na, b.n AS nb, a.cl AS cla, b.cl AS clb, c.cl
        FROM ranked e JOIN grow a ON a.r = e.r - 1 AND a.p = e.lo JOIN grow b ON b.r = e.r - 1 AND b.p = e.hi
        JOIN grow c ON c.r = e.r AND c.p = e.lo),
      mass AS (SELECT cl, sum(mass) AS mass FROM (
        SELECT cl, CASE WHEN cl = r THEN na + nb WHEN na >= {AUTO_SIZE} THEN nb ELSE na END * density AS mass
          FROM joined WHERE cl IS NOT NULL
        UNION ALL SELECT -p, weight / greatest(core, 1e-12) FROM pts JOIN core USING (p) WHERE weight >= {AUTO_SIZE}) GROUP BY cl),
      born AS (SELECT cla AS cl, r AS parent, na * density AS less FROM joined WHERE na >= {AUTO_SIZE} AND nb >= {AUTO_SIZE}
        UNION ALL SELECT clb, r, nb * density FROM joined WHERE na >= {AUTO_SIZE} AND nb >= {AUTO_SIZE}),
      tree AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cl) AS k, cl, parent, mass - less AS s FROM mass LEFT JOIN born USING (cl)),
      settled AS (
        SELECT 0::BIGINT AS k, k AS own, cl, parent, s, NULL::DOUBLE AS best, false AS wins FROM tree
        UNION ALL
        SELECT t.k + 1, own, t.cl, t.parent, t.s,
          CASE WHEN own = t.k + 1 THEN CASE WHEN s >= coalesce(below, 0) THEN s ELSE coalesce(below, 0) END ELSE best END,
          CASE WHEN own = t.k + 1 THEN coalesce(s >= coalesce(below, 0), false) ELSE wins END
        FROM settled t LEFT JOIN (SELECT parent AS cl, sum(best) AS below FROM settled GROUP BY parent) c ON c.cl = t.cl
        WHERE t.k < (SELECT max(k) FROM tree)),
      last AS MATERIALIZED (SELECT cl, parent, wins FROM settled WHERE k = (SELECT max(k) FROM tree)),
      path AS (SELECT cl, cl AS up FROM last UNION ALL SELECT path.cl, parent FROM path JOIN last ON last.cl = up WHERE parent IS NOT NULL),
      top AS (SELECT path.cl, max(up) AS top FROM path JOIN last ON last.cl = up WHERE wins GROUP BY path.cl),
      members AS (SELECT g.p, top FROM grow g JOIN top ON top.cl = g.own WHERE g.r = (SELECT max(r) FROM ranked)),
      named AS (SELECT top, row_number() OVER (ORDER BY min(p)) - 1 AS cluster_id FROM members GROUP BY top)
    SELECT v.row_id, CAST(coalesce(named.cluster_id, -1) AS INTEGER) AS cluster_id FROM vectors v JOIN pts USING (v)
      LEFT JOIN members m ON m.p = pts.p LEFT JOIN named USING (top)""",
)
N_PARENTS = 4


def _merges_sql(steps: int = 6) -> str:
    """One merge of the two most similar groups per step, while more than the parents wanted are left."""
    parts = ["g0 AS (SELECT cluster_id AS m, cluster_id AS g FROM centroids)"]
    for k in range(steps):
        parts.append(
            f"""p{k} AS (SELECT x.g AS a, y.g AS b, avg(s) AS s FROM sims JOIN g{k} x ON x.m = a JOIN g{k} y ON y.m = b
              WHERE x.g < y.g AND (SELECT count(DISTINCT g) FROM g{k}) > {N_PARENTS}
              GROUP BY x.g, y.g ORDER BY s DESC, 1, 2 LIMIT 1),
            g{k + 1} AS (SELECT m, CASE WHEN g = (SELECT b FROM p{k}) THEN (SELECT a FROM p{k}) ELSE g END AS g FROM g{k})"""
        )
    return ", ".join(parts)


CATALOG.add(
    "parent_themes",
    lambda spark, sf_dir: clusters.parent_themes(
        vectors.cluster_centroids(fx.vectors(spark, sf_dir)), n_parents=N_PARENTS
    ),
    f"""WITH {V}, {centroids_sql('cluster_id')}, sims AS (
      SELECT x.cluster_id AS a, y.cluster_id AS b, list_dot_product(x.c, y.c) AS s FROM centroids x, centroids y),
      {_merges_sql()}
    SELECT CAST(m AS INTEGER) AS cluster_id,
      CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS parent_id
    FROM (SELECT m, min(m) OVER (PARTITION BY g) AS first FROM g6)""",
)


def project(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    p = vectors.project(fx.vectors(spark, sf_dir), dims=dims)
    return r(p.select("row_id", *[F.col("reduced")[i].alias(f"c{i + 1}") for i in range(dims)]))


CATALOG.add("project_2d", lambda spark, sf_dir: project(spark, sf_dir, 2))
CATALOG.add("project_10d", lambda spark, sf_dir: project(spark, sf_dir, 10))

SPECTRAL_K, SPECTRAL_ROUNDS = 15, 12


def spectral_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spectral.spectral_map(fx.vectors(spark, sf_dir), dims=2, k=SPECTRAL_K, rounds=SPECTRAL_ROUNDS)
    return r(p.select("row_id", *[F.col("reduced")[i].alias(f"c{i + 1}") for i in range(2)]))


def _spectral_sql() -> str:
    """The rounds one by one: the constant axis is taken out, then the axes are orthonormalised, then multiplied."""
    centre = "y{a} - sqrt(deg) * (sum(y{a} * sqrt(deg)) OVER ()) / (sum(deg) OVER ())"
    parts = []
    for t in range(SPECTRAL_ROUNDS + 1):
        parts.append(
            f"""c{t} AS MATERIALIZED (SELECT id, deg, {centre.format(a=0)} AS y0, {centre.format(a=1)} AS y1 FROM y{t}),
            u{t} AS MATERIALIZED (SELECT id, deg, y0 / sqrt(sum(y0 * y0) OVER ()) AS q0, y1 FROM c{t}),
            v{t} AS MATERIALIZED (SELECT id, deg, q0, y1 - q0 * sum(q0 * y1) OVER () AS y1 FROM u{t}),
            q{t} AS MATERIALIZED (SELECT id, deg, q0, y1 / sqrt(sum(y1 * y1) OVER ()) AS q1 FROM v{t})"""
        )
        if t < SPECTRAL_ROUNDS:
            moved = [f"any_value(m.q{a}) * {t % 2} + sum(w * o.q{a} / sqrt(o.deg)) / sqrt(m.deg) AS y{a}" for a in (0, 1)]
            parts.append(
                f"""y{t + 1} AS MATERIALIZED (SELECT m.id, m.deg, {', '.join(moved)}
                FROM q{t} m JOIN edges ON a = m.id JOIN q{t} o ON o.id = b GROUP BY m.id, m.deg)"""
            )
    start = [f"CAST(concat('0x', substr(md5(concat('{a}|', a)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE - 0.5 AS y{a}" for a in (0, 1)]
    return f"""WITH {V}, s AS (SELECT a.row_id AS a, b.row_id AS b, round(list_dot_product(a.v, b.v)
        / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 12) AS similarity
      FROM vectors a JOIN vectors b ON a.row_id <> b.row_id),
    near AS MATERIALIZED (SELECT a, b FROM (
      SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS k FROM s) WHERE k <= {SPECTRAL_K}),
    edges AS MATERIALIZED (SELECT a, b, count(*) / 2.0::DOUBLE AS w
      FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) GROUP BY a, b),
    y0 AS MATERIALIZED (SELECT a AS id, sum(w) AS deg, {', '.join(start)} FROM edges GROUP BY a),
    {', '.join(parts)}
    SELECT id AS row_id, round(q0 * sqrt((sum(deg) OVER ()) / deg), 6) AS c1,
      round(q1 * sqrt((sum(deg) OVER ()) / deg), 6) AS c2 FROM q{SPECTRAL_ROUNDS}"""


CATALOG.add("spectral_2d", spectral_2d, _spectral_sql())
CATALOG.add(
    "embed_tfidf", lambda spark, sf_dir: vectors.embed_texts(_comments(spark, sf_dir), dim=256)
)


def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.vectors(spark, sf_dir)
    return r(clusters.cluster_table(_comments(spark, sf_dir), v, min_cluster_size=5, n_parents=N_PARENTS))


CATALOG.add("cluster_table", cluster_table)


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = soft_assign(spark, sf_dir, 0.2).select("row_id", "cluster_id", "soft_cluster_id")
    parent = F.when(F.col("cluster_id") == -1, -1).otherwise(F.col("cluster_id") % 3)
    groups = dedup.assign_duplicate_groups(_comments(spark, sf_dir))
    return r(clusters.cluster_summary(soft.withColumn("parent_id", parent).join(groups, "row_id")))


CATALOG.add(
    "cluster_summary",
    cluster_summary,
    f"""{GROUPS_SQL}, {SOFT_SQL.format(min_sim=0.2)}, t AS (SELECT s.*, g.duplicate_group_id FROM soft s JOIN duplicate_groups g USING (row_id))
    SELECT count(*) AS rows, count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS n_clusters,
      count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id % 3 END) AS n_parents,
      round(avg(CAST(cluster_id = -1 AS INTEGER)), 4) AS noise_fraction_strict,
      round(avg(CAST(soft_cluster_id = -1 AS INTEGER)), 4) AS noise_fraction_soft,
      count(DISTINCT duplicate_group_id) AS n_duplicate_groups,
      round(100.0 * (1 - count(DISTINCT duplicate_group_id)::DOUBLE / count(*)), 2) AS duplicate_collapse_pct FROM t""",
)
