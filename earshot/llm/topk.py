"""Exact top-k search by distributed histogram selection.

Rows and queries are packed into blocks of a fixed number of vectors, so a block has a fixed size
whatever the table holds.  Every query block meets every row block once per round, and a round counts
scores in a histogram per query.  A block only sends the bins from its own highest scores down to its
k-th: the global k-th score cannot be lower than that of any block, so those counts are complete where
they matter.  Each round narrows the range of every query to one bin, until a bin is one score wide:
that is the k-th score.  Then rows at or above it are kept, at most k per query and block, and ranked.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id,
take no part.  Only vectors of equal length meet.  A query never meets rows of its own id.  An id that
occurs repeatedly is as many rows, and as many queries with the same ``query_id``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.sources.shared import cut, cut_measured

_BLOCK = "block string, dim int, n int, ids binary, data binary, norm2 double"
#: Products of integers stay exact in doubles up to here.
_EXACT = 2.0**53
_LIMIT = 2**60


def exact_top_k(
    rows: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    block_rows: int = 2048,
    bins: int = 1024,
    slices: int | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows with the highest inner product for each query.

    A component x counts as floor(scale * x).  ``is_query`` selects the queries among ``rows``; all rows
    are candidates.  Ties go to the smaller id; fewer than k candidates are all returned.  Scores beyond
    +-2**60 are set to that limit.
    """
    spark = rows.sparkSession
    x, v = F.col(id_col), F.col(vector_col)
    valid = x.isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    wanted = rows.filter(valid).select(
        x.cast("bigint").alias("id"), v.cast("array<double>").alias("vector"), is_query.alias("q")
    )
    marks = {"n": F.count(F.lit(1)), "norm2": F.max("norm2")}
    pack = _packer(scale, block_rows)
    spread = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts, _ = cut_measured(wanted.select("id", "vector").mapInArrow(pack, _BLOCK), "topk-rows", **marks)
    asked = wanted.filter("q").select("id", "vector")
    # Few rows ask; they are gathered into full blocks through a shuffle of the queries alone.
    queries, seen = cut_measured(
        asked.repartition(1 + spread // 8).mapInArrow(pack, _BLOCK), "topk-queries", **marks
    )
    bound = parts.agg(F.max("norm2")).first()[0]
    if bound is None or not seen["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # No score is beyond the product of the longest vectors' lengths (with room for rounding).
    top = math.isqrt(int(bound)) * math.isqrt(int(seen["norm2"])) + 2 * math.isqrt(int(bound + seen["norm2"])) + 4
    top = min(_LIMIT, top + (top >> 40))
    width = 1 << max(0, (2 * top + 1).bit_length())
    step = max(2, bins)

    queries = queries.withColumnRenamed("block", "qb").withColumnsRenamed({"ids": "q_ids", "data": "q_data", "n": "q_n"})
    # Every query block is copied to each slice, every row block to each query block of its length.
    fan_q = queries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    keys = queries.select("dim", "qb")
    blocks = parts.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int")).drop("norm2")
    fan_r = blocks.join(keys, "dim")
    state = queries.select("qb", F.lit(None).cast("binary").alias("low"))
    low = -top - 1
    while width > 1:
        width = -(-width // step)
        met = _meet(fan_q, state, fan_r)
        counted = met.mapInArrow(_histogram(low, width, step, k), "qb string, pos int, bin int, n bigint")
        found = _locate(counted.groupBy("qb", "pos", "bin").agg(F.sum("n").alias("n")), k)
        state = cut(_advance(queries, state, found, low, width), "topk-state")
    kept = _meet(fan_q, state, fan_r).mapInArrow(_select(low, k), "qb string, pos int, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("qb", "pos").orderBy(F.desc("score"), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _packer(scale: float, block_rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for batch in batches:
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            whole = np.floor(scale * flat)
            for i, row_id in enumerate(batch.column(0).to_pylist()):
                ids, data = held.setdefault(int(sizes[i]), ([], []))
                ids.append(row_id)
                data.append(whole[ends[i] - sizes[i] : ends[i]])
                if len(ids) == block_rows:
                    yield _block(int(sizes[i]), *held.pop(int(sizes[i])))
        for dim, (ids, data) in held.items():
            yield _block(dim, ids, data)

    return pack


def _block(dim: int, ids: list[int], data: list[np.ndarray]) -> pa.RecordBatch:
    m = np.vstack(data) if dim else np.zeros((len(ids), 0))
    with np.errstate(over="ignore"):
        norm2 = min(float((m * m).sum(axis=1).max(initial=0)), 2.0**124)
    return pa.RecordBatch.from_pydict(
        {
            "block": [uuid.uuid4().hex],
            "dim": pa.array([dim], pa.int32()),
            "n": pa.array([len(ids)], pa.int32()),
            "ids": [np.array(ids, np.int64).tobytes()],
            "data": [m.tobytes()],
            "norm2": [norm2],
        }
    )


def _meet(fan_q: DataFrame, state: DataFrame, fan_r: DataFrame) -> DataFrame:
    return fan_q.join(state, "qb").drop("dim", "norm2").join(fan_r.drop("dim", "block"), ["qb", "slice"]).select(
        "qb", "q_n", "q_ids", "q_data", "low", "n", "ids", "data"
    )


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the queries and rows of a block pair and their scores; own rows get the smallest long."""
    q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    a = np.frombuffer(row["q_data"]).reshape(len(q_ids), -1) if row["q_data"] else np.zeros((len(q_ids), 0))
    b = np.frombuffer(row["data"]).reshape(len(ids), -1) if row["data"] else np.zeros((len(ids), 0))
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < _EXACT:
        out = (a @ b.T).astype(np.int64)
    else:
        big = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
        out = np.clip(big, -_LIMIT, _LIMIT).astype(np.int64)
    out[q_ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
    return q_ids, ids, out


def _lows(row: dict, n: int, first: int) -> np.ndarray:
    return np.full(n, first, np.int64) if row["low"] is None else np.frombuffer(row["low"], np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _histogram(first: int, width: int, step: int, k: int):
    """Counts per query and bin from the top down to the bin that holds the block's own k-th score.

    Scores above the range of a round belong to its top bin ``step``; those below it are left out, as
    an earlier round has shown that at least k scores are not below.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _pairs(batches):
            q_ids, _, s = _scores(row)
            for a in range(0, len(q_ids), 256):
                part = s[a : a + 256]
                low = _lows(row, len(q_ids), first)[a : a + 256, None]
                known = part > np.iinfo(np.int64).min
                at = np.where(known & (part >= low), np.minimum((part - np.where(known, low, 0)) // width, step), -1)
                at = at + (np.arange(len(part)) * (step + 2))[:, None] + 1
                n = np.bincount(at.ravel(), minlength=len(part) * (step + 2)).reshape(len(part), step + 2)[:, 1:]
                above = n[:, ::-1].cumsum(axis=1)[:, ::-1] - n
                pos, which = np.nonzero((n > 0) & (above < k))
                yield pa.RecordBatch.from_pydict(
                    {
                        "qb": pa.array([row["qb"]] * len(pos), pa.string()),
                        "pos": pa.array(pos + a, pa.int32()),
                        "bin": pa.array(which, pa.int32()),
                        "n": pa.array(n[pos, which], pa.int64()),
                    }
                )

    return count


def _locate(counts: DataFrame, k: int) -> DataFrame:
    """The bin of each query's k-th score; the lowest bin there is if it has fewer scores."""
    down = Window.partitionBy("qb", "pos").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("sum", F.sum("n").over(down))
    return reached.groupBy("qb", "pos").agg(
        F.coalesce(F.max(F.when(F.col("sum") >= k, F.col("bin"))), F.lit(0)).alias("bin")
    )


def _advance(queries: DataFrame, state: DataFrame, found: DataFrame, first: int, width: int) -> DataFrame:
    """The lower ends of all queries' ranges, packed per query block."""
    bins = found.groupBy("qb").agg(F.collect_list(F.struct("pos", "bin")).alias("bins"))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _pairs(batches):
            low = _lows(row, row["q_n"], first).copy()
            for x in row["bins"] or ():
                low[x["pos"]] += x["bin"] * width
            yield pa.RecordBatch.from_pydict({"qb": [row["qb"]], "low": [low.tobytes()]})

    joined = queries.select("qb", "q_n").join(state, "qb").join(bins, "qb", "left").select("qb", "q_n", "low", "bins")
    return joined.mapInArrow(move, "qb string, low binary")


def _select(first: int, k: int):
    """Rows not below their query's k-th score, at most the k best of each block."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _pairs(batches):
            q_ids, ids, s = _scores(row)
            low = np.maximum(_lows(row, len(q_ids), first), np.iinfo(np.int64).min + 1)
            rank_of_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            for a in range(0, len(q_ids), 256):
                pos, at = np.nonzero(s[a : a + 256] >= low[a : a + 256, None])
                score = s[a : a + 256][pos, at]
                order = np.lexsort((rank_of_id[at], -score, pos))
                pos, at, score = pos[order], at[order], score[order]
                place = np.arange(len(pos)) - np.searchsorted(pos, pos, "left")
                keep = place < k
                pos, at, score = pos[keep], at[keep], score[keep]
                yield pa.RecordBatch.from_pydict(
                    {
                        "qb": pa.array([row["qb"]] * len(pos), pa.string()),
                        "pos": pa.array(pos + a, pa.int32()),
                        "query_id": q_ids[a + pos],
                        "vec_id": ids[at],
                        "score": score,
                    }
                )

    return select
