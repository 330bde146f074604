"""Unit vectors, nearest neighbours, centroids, soft assignment and projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions import text as tx
from earshot.functions import vectors as vx
from earshot.operators import rank
from earshot.operators.blocks import BLOCK_BYTES, against_all, own_products, small_side, strips, with_own
from earshot.sources.shared import cut

NOISE = -1
# Similarities closer than this are ties, whatever order they were summed in.
DIGITS = 12


def l2_normalize(df: DataFrame, *, vec_col: str = "embedding") -> DataFrame:
    """Vectors to unit length, in DOUBLE; a zero vector stays zero."""
    return (
        df.withColumn("_norm", vx.norm(vec_col)).withColumn(vec_col, vx.scale(vec_col, F.col("_norm"))).drop("_norm")
    )


def embed_texts(
    df: DataFrame,
    *,
    text_col: str = "text_clean",
    id_col: str = "row_id",
    dim: int = 1024,
    encoder: Callable[[list[str]], np.ndarray] | None = None,
    batch: int = 64,
) -> DataFrame:
    """``(id, embedding ARRAY<FLOAT>)`` of unit length.

    The default is hashed TF-IDF over words and word pairs; ``encoder`` may be any function from texts
    to a matrix, called on Arrow batches inside the tasks.
    """
    texts = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if encoder is None:
        return _embed_tfidf(texts, id_col, dim)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                m = np.asarray(encoder(part["_text"].tolist()), dtype=np.float64)
                if m.shape != (len(part), dim):
                    raise ValueError(f"encoder returned shape {m.shape}, expected {(len(part), dim)}")
                length = np.linalg.norm(m, axis=1, keepdims=True)
                unit = (m / np.where(length == 0, 1.0, length)).astype(np.float32)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": list(unit)})

    kind = dict(df.dtypes)[id_col]
    return texts.mapInPandas(encode, f"`{id_col}` {kind}, embedding array<float>")


def _embed_tfidf(texts: DataFrame, id_col: str, dim: int) -> DataFrame:
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.regexp_extract_all(F.lower("_text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    pairs = F.when(
        F.size("_words") > 1,
        F.zip_with(
            F.slice("_words", 1, F.size("_words") - 1),
            F.slice("_words", 2, F.size("_words") - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    terms = texts.select(id_col, words.alias("_words")).select(id_col, F.concat("_words", pairs).alias("_terms"))
    counted = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dim).transform(terms)
    # Read twice, by the fit and by the weights: counts are written, so that texts are taken apart once.
    tf = cut(counted.select(id_col, "_tf"), "term-counts")
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(tf).transform(tf)
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0).transform(weighted)
    return unit.select(id_col, vector_to_array("_unit", "float32").alias("embedding"))


# --------------------------------------------------------------------------- neighbours


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest_neighbors(
    vectors: DataFrame,
    anchors: DataFrame,
    *,
    k: int = 5,
    id_col: str = "row_id",
    vec_col: str = "embedding",
    include_self: bool = True,
    metric: str = "cosine",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(anchor_id, rank, neighbor_id, similarity)``: the k nearest rows of every anchor, exactly.

    Each task multiplies its batches with the anchors and keeps k rows per anchor, so only
    ``tasks * anchors * k`` rows are shuffled.  Anchors of more than ``block_bytes`` stream past blocks of rows
    instead, and a block keeps k rows per anchor.  With ``include_self`` the anchor competes as any other
    row and k + 1 rows are returned.  ``euclidean`` ranks by distance and reports it negated.
    """
    keep = k + 1 if include_self else k
    own = vectors.join(anchors.select(id_col).distinct(), id_col, "left_semi")
    side = small_side(own, id_col, vec_col, block_bytes=block_bytes)
    schema = "anchor_id bigint, neighbor_id bigint, similarity double"
    if side is None:
        best = against_all(
            vectors, own, _top_of_block(keep, include_self, metric), schema,
            key=id_col, vec_col=vec_col, side_key=id_col, side_vec=vec_col, block_bytes=block_bytes,
        )
    elif len(side[0]):
        shared = vectors.sparkSession.sparkContext.broadcast(side)
        kernel = _top_kernel(shared, keep, id_col, vec_col, include_self, metric)
        best = vectors.select(id_col, vec_col).mapInPandas(kernel, schema)
    else:
        best = vectors.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("similarity"), "neighbor_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= keep)
        .select("anchor_id", "rank", "neighbor_id", "similarity")
    )


def _similarities(anchors: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    sims = anchors @ v.T
    if metric == "euclidean":
        squares = (anchors**2).sum(axis=1)[:, None] + (v**2).sum(axis=1)[None, :] - 2 * sims
        sims = -np.sqrt(np.maximum(squares, 0.0))
    return np.round(sims, DIGITS)


def _best(sim: np.ndarray, who: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    if len(sim) > keep:
        # All rows tied with the last kept one stay in until ids decide.
        floor = np.partition(sim, len(sim) - keep)[len(sim) - keep]
        sim, who = sim[sim >= floor], who[sim >= floor]
        order = np.lexsort((who, -sim))[:keep]
        sim, who = sim[order], who[order]
    return sim, who


def _top_kernel(shared, keep: int, id_col: str, vec_col: str, include_self: bool, metric: str):
    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, anchors = shared.value
        held_sim = [np.empty(0)] * len(ids)
        held_id = [np.empty(0, dtype=np.int64)] * len(ids)
        for frame in frames:
            if frame.empty:
                continue
            rows = frame[id_col].to_numpy(dtype=np.int64)
            sims = _similarities(anchors, _stack(frame[vec_col]), metric)
            for i, anchor in enumerate(ids):
                sim = np.concatenate([held_sim[i], sims[i]])
                who = np.concatenate([held_id[i], rows])
                if not include_self:
                    other = who != anchor
                    sim, who = sim[other], who[other]
                held_sim[i], held_id[i] = _best(sim, who, keep)
        for i, anchor in enumerate(ids):
            if len(held_id[i]):
                yield pd.DataFrame({"anchor_id": anchor, "neighbor_id": held_id[i], "similarity": held_sim[i]})

    return kernel


def _top_of_block(keep: int, include_self: bool, metric: str):
    def kernel(_, rows, v, side) -> Iterator[pa.RecordBatch]:
        for ids, anchors in side:
            for s in strips(len(ids)):
                sims = _similarities(anchors[s], v, metric)
                for anchor, own in zip(ids[s].tolist(), sims):
                    other = slice(None) if include_self else rows != anchor
                    sim, who = _best(own[other], rows[other], keep)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(who), anchor)), pa.array(who), pa.array(sim)],
                        ["anchor_id", "neighbor_id", "similarity"],
                    )

    return kernel


def neighbor_report(
    vectors: DataFrame,
    texts: DataFrame,
    *,
    n_anchors: int = 20,
    k: int = 5,
    seed: int = 42,
    text_limit: int = 110,
    id_col: str = "row_id",
    text_col: str = "comment",
) -> DataFrame:
    """Neighbours of seeded random anchors with both texts, for reading; the anchor itself is left out by id."""
    anchors = rank.sample_ids(vectors, n=n_anchors, seed=seed, id_col=id_col)
    # n_anchors * k rows from here on.
    near = nearest_neighbors(vectors, anchors, k=k, include_self=False, id_col=id_col)
    text = tx.clip_text(F.col(text_col), text_limit)
    left = texts.select(F.col(id_col).alias("anchor_id"), text.alias("anchor_text"))
    right = texts.select(F.col(id_col).alias("neighbor_id"), text.alias("neighbor_text"))
    return near.join(left, "anchor_id").join(right, "neighbor_id")


def neighbor_quality(report: DataFrame) -> DataFrame:
    return report.agg(
        F.avg(F.when(F.col("rank") == 1, F.col("similarity"))).alias("mean_top1"),
        F.avg("similarity").alias("mean_topk"),
    )


# --------------------------------------------------------------------------- centroids


def cluster_centroids(
    df: DataFrame, *, cluster_col: str = "cluster_id", vec_col: str = "embedding", noise: int = NOISE
) -> DataFrame:
    """``(cluster_id, size, centroid)``: mean vector of each non-noise cluster, then unit length.

    Averaged per coordinate, so a cluster of any size is reduced before the shuffle.
    """
    coordinate = F.posexplode(vec_col).alias("pos", "x")
    means = (
        df.filter(F.col(cluster_col) != noise)
        .select(F.col(cluster_col).alias("cluster_id"), coordinate)
        .groupBy("cluster_id", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("size"))
    )
    # One entry per coordinate.
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    raw = means.groupBy("cluster_id").agg(
        F.max("size").alias("size"), F.transform(ordered, lambda s: s.x).alias("centroid")
    )
    return l2_normalize(raw, vec_col="centroid")


def soft_assign(
    df: DataFrame,
    *,
    cluster_col: str = "cluster_id",
    vec_col: str = "embedding",
    id_col: str = "row_id",
    min_sim: float = 0.0,
    centroids: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id, cluster_id, soft_cluster_id, soft_sim, own_sim)``.

    ``soft_sim`` is the best similarity to any centroid; a noise row takes that centroid's cluster when
    it reaches ``min_sim``, other rows keep theirs.  ``own_sim`` is the similarity to the own centroid.
    Ties go to the smallest cluster id.  Centroids of more than ``block_bytes`` stream past blocks of rows.
    """
    cents = centroids if centroids is not None else cluster_centroids(df, cluster_col=cluster_col, vec_col=vec_col)
    rows = df.select(id_col, F.col(cluster_col).alias("cluster_id"), vec_col)
    side = small_side(cents, "cluster_id", "centroid", block_bytes=block_bytes)
    if side is None:
        kinds = dict(rows.dtypes)
        schema = f"`{id_col}` {kinds[id_col]}, cluster_id bigint, best int, sim double, own double"
        near = against_all(
            rows, cents, _nearest_of_all, schema,
            key=id_col, vec_col=vec_col, side_key="cluster_id", side_vec="centroid", label="cluster_id", block_bytes=block_bytes,
        ).select(id_col, F.col("cluster_id").cast(kinds["cluster_id"]), F.struct("best", "sim", "own").alias("_n"))
    elif len(side[0]):
        near = rows.withColumn("_n", _nearest_udf(df, *side)(F.col(vec_col), F.col("cluster_id")))
    else:
        near = rows.withColumn("_n", F.lit(None).cast("struct<best:int,sim:double,own:double>"))
    promote = (F.col("cluster_id") == NOISE) & (F.col("_n.sim") >= min_sim)
    return near.select(
        id_col,
        "cluster_id",
        F.when(promote, F.col("_n.best")).otherwise(F.col("cluster_id")).cast("int").alias("soft_cluster_id"),
        F.coalesce("_n.sim", F.lit(0.0)).alias("soft_sim"),
        F.col("_n.own").alias("own_sim"),
    )


def own_product(df: DataFrame, sides: list[tuple], *, vec_col: str, cluster_col: str, id_col: str | None = None):
    """The largest product of a row's vector with those of its cluster in ``sides``, as a Column.

    A side is what ``small_side`` gave, with ``carry`` the ids of the rows that its vectors are of.  Such a
    row itself gets infinity, if ``id_col`` is named.
    """
    shared = df.sparkSession.sparkContext.broadcast(sides)
    ids = bool(id_col)

    # Not deterministic for the optimizer, which else evaluates it again in each filter on the result.
    @F.pandas_udf("double")
    def product(vec: pd.Series, cluster: pd.Series, row_id: pd.Series) -> pd.Series:
        vectors, keys = _stack(vec), cluster.to_numpy()
        who = row_id.to_numpy() if ids else None
        found = np.full(len(keys), np.nan)
        for side in shared.value:
            found = np.fmax(found, own_products(vectors, keys, who, side))
        return pd.Series(found).astype(object).where(~np.isnan(found), None)

    return product.asNondeterministic()(F.col(vec_col), F.col(cluster_col), F.col(id_col or cluster_col))


def with_own_product(
    df: DataFrame,
    side: DataFrame,
    *,
    side_vec: str,
    name: str,
    vec_col: str = "v",
    cluster_col: str = "cluster_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``name``, the product of a row's vector with that of its cluster in ``side`` (one row per cluster)."""
    size = side.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(side_vec)).alias("dim")).first()
    known = dict(n=size["n"], dim=size["dim"] or 0, block_bytes=block_bytes)
    small = small_side(side, cluster_col, side_vec, carry=cluster_col, **known)
    if small is None:
        return with_own(df, side, key=cluster_col, vec_col=vec_col, side_vec=side_vec, name=name, **known)
    return df.withColumn(name, own_product(df, [small], vec_col=vec_col, cluster_col=cluster_col))


def _nearest_udf(df: DataFrame, ids: np.ndarray, matrix: np.ndarray):
    shared = df.sparkSession.sparkContext.broadcast((ids, matrix))

    @F.pandas_udf("best int, sim double, own double")
    def nearest(vec: pd.Series, own_id: pd.Series) -> pd.DataFrame:
        best, sim, own = _nearest(own_id.to_numpy(), _stack(vec), [shared.value])
        out = pd.DataFrame({"best": best.astype(np.int32), "sim": sim})
        out["own"] = pd.Series(own).astype(object).where(~np.isnan(own), None)
        return out

    return nearest


def _nearest(own_id: np.ndarray, v: np.ndarray, side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its similarity and that of the own one; the side's ids ascend, so ties go to the smaller."""
    best, sim, own = np.full(len(v), NOISE), np.full(len(v), -np.inf), np.full(len(v), np.nan)
    for names, centroids in side:
        mine = np.minimum(np.searchsorted(names, own_id), len(names) - 1)
        known = names[mine] == own_id
        for s in strips(len(v)):
            sims = np.round(v[s] @ centroids.T, DIGITS)
            line, at = np.arange(len(sims)), sims.argmax(axis=1)
            own[s] = np.where(known[s], sims[line, mine[s]], own[s])
            better = sims[line, at] > sim[s]
            best[s] = np.where(better, names[at], best[s])
            sim[s] = np.where(better, sims[line, at], sim[s])
    return best, sim, own


def _nearest_of_all(keys, own_id, v, side) -> Iterator[pa.RecordBatch]:
    best, sim, own = _nearest(own_id, v, side)
    columns = [keys, pa.array(own_id, pa.int64()), pa.array(best, pa.int32()), pa.array(sim), pa.array(own, mask=np.isnan(own))]
    yield pa.RecordBatch.from_arrays(columns, ["key", "cluster_id", "best", "sim", "own"])


# --------------------------------------------------------------------------- projection


def project(df: DataFrame, *, dims: int, vec_col: str = "embedding", id_col: str = "row_id", name: str = "reduced") -> DataFrame:
    """``(id, reduced ARRAY<DOUBLE>)``: the first principal components, largest loading positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    doubles = F.transform(vec_col, lambda x: x.cast("double"))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(df.select(array_to_vector(doubles).alias("_v")))
    axes = model.pc.toArray()
    largest = axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])]
    axes = axes * np.where(largest < 0, -1.0, 1.0)
    shared = df.sparkSession.sparkContext.broadcast(axes)

    @F.pandas_udf("array<double>")
    def apply(vec: pd.Series) -> pd.Series:
        return pd.Series(list(_stack(vec) @ shared.value))

    return df.select(id_col, apply(vec_col).alias(name))
