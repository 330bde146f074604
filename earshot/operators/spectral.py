"""A map that keeps neighbours: leading eigenvectors of the neighbour graph, by orthogonal iteration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators import neighbors
from earshot.sources.shared import cut, cut_measured

#: Links into one node beyond this are dealt over several copies of it in the join of a round.
COPY_LINKS = 10_000


def spectral_map(
    df: DataFrame,
    *,
    dims: int = 2,
    k: int = 15,
    rounds: int = 40,
    id_col: str = "row_id",
    vec_col: str = "embedding",
    name: str = "reduced",
    copy_links: int = COPY_LINKS,
) -> DataFrame:
    """``(id, reduced ARRAY<DOUBLE>)``: rows that are neighbours in ``vec_col`` lie close to each other.

    The graph links every row to its ``k`` nearest, weight 1/2, or 1 if both name each other.  The axes are those on
    which linked rows differ least: the leading eigenvectors of the degree-normalised graph after the constant one.
    Weighted by degree they have mean 0, variance 1 and no correlation.  The closer the eigenvalues, the more ``rounds``
    they take to part; fewer give a mix of smooth axes.  Rows without a vector or neighbours are absent.
    """
    near = neighbors.knn_graph(df, k=k, id_col=id_col, vec_col=vec_col)
    axes = spectral_axes(near.select(F.col("row_id").alias("a"), F.col("neighbor_id").alias("b")), dims=dims, rounds=rounds, copy_links=copy_links)
    return axes.select(F.col("id").alias(id_col), F.col("at").alias(name))


def spectral_axes(links: DataFrame, *, dims: int = 2, rounds: int = 40, copy_links: int = COPY_LINKS) -> DataFrame:
    """``(id, at)`` for the nodes of directed ``links`` (a, b), each link once.

    A round is one join and one map-side-combined sum.  Products of the axes (``dims`` squared numbers) are taken while
    a round is written; the next one reads them as constants, so orthonormalising costs no pass of its own.  Rounds
    multiply by the graph and by the graph plus identity in turn, which leaves negative eigenvalues behind.  The start
    depends on ids alone, so runs agree.
    """
    edges, nodes = _graph(links, copy_links)
    axes = range(dims)
    start = [_start(F.col("id"), a) - 0.5 for a in axes]
    state, seen = _written(nodes.select("id", "deg", "copies", *[x.alias(f"y{a}") for a, x in enumerate(start)]), dims)
    for t in range(rounds):
        if not seen["n"]:
            break
        held = state.select("id", "deg", "copies", *[q.alias(f"q{a}") for a, q in enumerate(_orthonormal(seen, dims))])
        out = held.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(
            F.col("id").alias("b"), "copy", *[(F.col(f"q{a}") / F.sqrt("deg")).alias(f"x{a}") for a in axes]
        )
        sums = edges.join(out, ["b", "copy"]).groupBy("a").agg(*[F.sum(F.col("w") * F.col(f"x{a}")).alias(f"s{a}") for a in axes])
        shift = float(t % 2)
        moved = [(F.col(f"s{a}") / F.sqrt("deg") + shift * F.col(f"q{a}")).alias(f"y{a}") for a in axes]
        state, seen = _written(held.join(sums.withColumnRenamed("a", "id"), "id").select("id", "deg", "copies", *moved), dims)
    if not seen["n"]:
        return state.select("id", F.array(*[F.lit(0.0) for _ in axes]).alias("at"))
    scale = F.sqrt(F.lit(float(seen["volume"])) / F.col("deg"))
    return state.select("id", F.array(*[q * scale for q in _orthonormal(seen, dims)]).alias("at"))


def _graph(links: DataFrame, copy_links: int) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b, w, copy)`` in both directions, and nodes ``(id, deg, copies)``."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(both.groupBy("a", "b").agg((F.count(F.lit(1)) / 2.0).alias("w")), "edges")
    copies = F.ceil(F.count(F.lit(1)) / copy_links).cast("int")
    nodes = cut(edges.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("deg"), copies.alias("copies")), "nodes")
    hubs = nodes.filter("copies > 1").select(F.col("id").alias("b"), "copies")
    # The few hubs that have copies are at most one in every copy_links links.
    dealt = edges.join(hubs, "b", "left").select("a", "b", "w", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"))
    return cut(dealt, "dealt"), nodes


def _start(node: Column, axis: int) -> Column:
    """A number in [0, 1) that depends on the node and the axis alone."""
    digest = F.md5(F.concat(F.lit(f"{axis}|"), node.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _written(state: DataFrame, dims: int) -> tuple[DataFrame, dict]:
    """The state as a table, with the products of its axes, and of each with the constant one, the root of the degree."""
    sums = {f"g{a}_{b}": F.sum(F.col(f"y{a}") * F.col(f"y{b}")) for a in range(dims) for b in range(a + 1)}
    flat = {f"f{a}": F.sum(F.col(f"y{a}") * F.sqrt("deg")) for a in range(dims)}
    return cut_measured(state, "axes", n=F.count(F.lit(1)), volume=F.sum("deg"), **sums, **flat)


def _orthonormal(seen: dict, dims: int) -> list[Column]:
    """The axes without the constant one, orthonormal in their order, as expressions on the written state.

    An axis that depends on earlier ones (in graphs of no more nodes than axes) is 0.
    """
    flat = np.array([seen[f"f{a}"] for a in range(dims)]) / seen["volume"]
    gram = np.zeros((dims, dims))
    for a in range(dims):
        for b in range(a + 1):
            gram[a, b] = gram[b, a] = seen[f"g{a}_{b}"] - flat[a] * flat[b] * seen["volume"]
    # Gram-Schmidt on the products alone: row a of `rows` writes axis a in terms of the given ones.
    rows: list[np.ndarray] = []
    for a in range(dims):
        row = np.eye(dims)[a]
        for earlier in rows:
            row = row - (earlier @ gram[a]) * earlier
        size = row @ gram @ row
        rows.append(row / np.sqrt(size) if size > 1e-24 * max(seen[f"g{a}_{a}"], 1e-300) else np.zeros(dims))
    centred = [F.col(f"y{a}") - float(flat[a]) * F.sqrt("deg") for a in range(dims)]
    out = []
    for a, row in enumerate(rows):
        total = F.lit(0.0)
        for b in range(a + 1):
            total = total + float(row[b]) * centred[b]
        out.append(total)
    return out
