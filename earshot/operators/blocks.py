"""Products of a large table of vectors with a side that may be large as well.

A side whose measured size is within ``block_bytes`` goes to every task as it is (``small_side``).  A larger
one never passes through the driver: rows and side are dealt to blocks by a shuffle and met there.

* ``against_all``: each block of rows is held by one task while all of the side streams past it, so what a
  row needs of the whole side (its nearest, its best) is known when the stream ends, without a second shuffle.
  The rows travel once, the side once for each block of rows.
* ``with_own``: each row needs one vector of the side.  Keys are dealt to blocks; a block of the side is held
  while its rows stream past.  A block with many rows is split, so a key with a third of all rows is dealt over
  as many tasks as its bytes need.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest dense block that is held at once.
BLOCK_BYTES = 64 << 20
#: Rows multiplied at once.
STRIP = 1024


def small_side(
    df: DataFrame,
    key: str,
    vec_col: str,
    *,
    block_bytes: int = BLOCK_BYTES,
    n: int | None = None,
    dim: int | None = None,
    carry: str | None = None,
) -> tuple[np.ndarray, ...] | None:
    """``(keys, matrix)`` by key, or None if that is more than ``block_bytes``.  ``carry`` adds one more column.

    The size is measured first unless it is known.
    """
    if n is None or dim is None:
        size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec_col)).alias("dim")).first()
        n, dim = size["n"], size["dim"] or 0
    if n * dim * 8 > block_bytes:
        return None
    rows = df.select(key, vec_col, *([carry] if carry else [])).orderBy(key).collect()
    side = np.array([x[0] for x in rows]), np.array([x[1] for x in rows], dtype=np.float64).reshape(len(rows), dim)
    return (*side, np.array([x[2] for x in rows])) if carry else side


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    """``(block, salt, tag, rows)`` of consecutive rows that share the first three columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        edges = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
        for lo, hi in itertools.pairwise([0, *edges.tolist(), batch.num_rows]):
            yield (*keys[:, lo].tolist(), batch.slice(lo, hi - lo))


def _doubles(column: str) -> Column:
    return F.transform(column, lambda x: x.cast("double"))


Kernel = Callable[[pa.Array, np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]]


def against_all(
    rows: DataFrame,
    side: DataFrame,
    kernel: Kernel,
    schema: str,
    *,
    key: str,
    vec_col: str,
    side_key: str,
    side_vec: str,
    label: str | None = None,
    dim: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """What ``kernel(keys, labels, matrix, side)`` yields for each block of rows and all of the side.

    ``side`` comes to it as ``(keys, matrix)`` parts, keys (bigint) ascending over all of them.  ``label`` is a
    bigint of a row (by default its key), so that ``key`` itself may be of any type.
    """
    if dim is None:
        dim = side.agg(F.max(F.size(side_vec)).alias("dim")).first()["dim"] or 1
    n = -(-rows.count() * dim * 8 // block_bytes)
    kind = dict(rows.dtypes)[key]
    held = rows.select(
        F.pmod(F.xxhash64(key), F.lit(max(n, 1))).cast("int").alias("block"),
        F.lit(0).alias("salt"),
        F.lit(0).alias("tag"),
        F.col(label or key).cast("bigint").alias("label"),
        F.col(key).alias("key"),
        _doubles(vec_col).alias("v"),
    )
    streamed = side.select(
        F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("block"),
        F.lit(0).alias("salt"),
        F.lit(1).alias("tag"),
        F.col(side_key).cast("bigint").alias("label"),
        F.lit(None).cast(kind).alias("key"),
        _doubles(side_vec).alias("v"),
    )
    placed = held.unionByName(streamed).repartition("block").sortWithinPartitions("block", "tag", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in itertools.groupby(_runs(batches), key=lambda r: r[0]):
            own, first = [], None
            for piece in part:
                if piece[2]:
                    first = piece
                    break
                own.append(piece[3])
            if not own:
                continue
            # A copy of the batches, which may be slices of larger ones.
            block = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            others = itertools.chain([first] if first else [], part)
            parts = ((p[3].column(3).to_numpy(), matrix(p[3].column(5))) for p in others)
            labels = block.column(3).to_numpy(zero_copy_only=False)
            yield from kernel(block.column(4), labels, matrix(block.column(5)), parts)

    return placed.mapInArrow(run, schema)


def strips(n: int) -> Iterator[slice]:
    return (slice(a, min(a + STRIP, n)) for a in range(0, n, STRIP))


def own_products(vectors: np.ndarray, keys: np.ndarray, who: np.ndarray | None, side: tuple) -> np.ndarray:
    """Products of rows with the vector of their key; NaN without one, infinity for the row the vector is of."""
    names, against, ids = side
    if not len(names):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    known = names[at] == keys
    found = np.full(len(keys), np.nan)
    for s in strips(len(keys)):
        found[s] = np.where(known[s], (vectors[s] * against[at[s]]).sum(axis=1), np.nan)
    if who is not None:
        found[known & (who == ids[at])] = np.inf
    return found


def with_own(
    rows: DataFrame,
    side: DataFrame,
    *,
    key: str,
    vec_col: str,
    side_vec: str,
    name: str,
    id_col: str | None = None,
    n: int,
    dim: int,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Set ``name`` to the larger of itself and a row's product with the side's vector of its key.

    ``n`` and ``dim`` are the side's size.  With ``id_col``, the row that the side's vector is of gets infinity.
    """
    columns = rows.columns if name in rows.columns else [*rows.columns, name]
    rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast("double"))
    kinds = dict(rows.dtypes)
    blocks = max(-(-n * dim * 8 // block_bytes), 1)
    block = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("_block", block)
    salts = dealt.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) * dim * 8 / block_bytes).cast("int").alias("_salts"))
    streamed = (
        dealt.join(salts, "_block")
        .withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int"))
        .select("_block", "_salt", F.lit(1).alias("_tag"), *columns)
    )
    carried = {key: F.col(key).cast(kinds[key]), vec_col: F.col(side_vec).cast(kinds[vec_col])}
    if id_col:
        carried[id_col] = F.col(id_col).cast(kinds[id_col])
    held = (
        side.withColumn("_block", block)
        .join(salts, "_block")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        .select(
            "_block", "_salt", F.lit(0).alias("_tag"), *[carried.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in columns]
        )
    )
    placed = held.unionByName(streamed).repartition("_block", "_salt").sortWithinPartitions("_block", "_salt", "_tag", key)
    at = {c: columns.index(c) + 3 for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys_of(piece, column):
            return piece.column(at[column]).to_numpy(zero_copy_only=False)

        def sorted_side(pieces):
            names = np.concatenate([keys_of(p, key) for p in pieces]) if pieces else np.zeros(0, np.int64)
            ids = np.concatenate([keys_of(p, id_col) for p in pieces]) if pieces and id_col else names
            return names, np.concatenate([matrix(p.column(at[vec_col])) for p in pieces]) if pieces else None, ids

        for _, part in itertools.groupby(_runs(batches), key=lambda r: r[:2]):
            pieces, index = [], None
            for _, _, tag, piece in part:
                if not tag:
                    pieces.append(piece)
                    continue
                if index is None:
                    index, pieces = sorted_side(pieces), []
                who = keys_of(piece, id_col) if id_col else None
                found = own_products(matrix(piece.column(at[vec_col])), keys_of(piece, key), who, index)
                before = piece.column(at[name]).to_numpy(zero_copy_only=False).astype(float)
                found = np.fmax(found, before)
                out = [pa.array(found, pa.float64(), mask=np.isnan(found)) if c == name else piece.column(at[c]) for c in columns]
                yield pa.RecordBatch.from_arrays(out, columns)

    return placed.mapInArrow(run, rows.select(*columns).schema)
