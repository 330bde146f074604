"""A box tree over vectors: blocks of bounded size, and the pairs of blocks that come near each other."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.sources.shared import cut, cut_measured

#: Bounds lean to the safe side of rounding.
SLACK = 1 + 1e-9


@dataclass
class BoxTree:
    """``points`` with their ``block``, and ``nodes (node, leaf, box)`` of the tree; a block is a path of 0 and 1."""

    points: DataFrame
    nodes: DataFrame
    depth: int


def box_tree(points: DataFrame, block_points: int) -> BoxTree:
    """Halve blocks of ``points (p, v, ..)``, all different, at the mean of their widest coordinate while they are too full.

    Only blocks that are too full are read and written again.  All coordinates count, so the blocks stay compact
    whatever the number of dimensions.
    """
    return boxed(halved(points, block_points))


def halved(points: DataFrame, block_points: int) -> DataFrame:
    """``points`` with their ``block`` in the tree."""
    done, full = [], cut(points.withColumn("block", F.lit("")), "blocks")
    while True:
        sizes = full.groupBy("block").agg(F.count("*").alias("n"))
        crowded, seen = cut_measured(sizes.filter(F.col("n") > block_points).select("block"), "crowded", n=F.count(F.lit(1)))
        done.append(full.join(crowded, "block", "left_anti"))
        if not seen["n"]:
            break
        rest = full.join(crowded, "block", "left_semi")
        spread = rest.select("block", F.posexplode("v").alias("dim", "x")).groupBy("block", "dim").agg(
            (F.max("x") - F.min("x")).alias("width"), F.avg("x").alias("middle")
        )
        at = F.max_by(F.struct("dim", "middle"), F.struct("width", -F.col("dim"))).alias("at")
        side = F.when(F.get("v", F.col("at.dim")) <= F.col("at.middle"), "0").otherwise("1")
        halved = rest.join(spread.groupBy("block").agg(at), "block").withColumn("block", F.concat("block", side))
        full = cut(halved.drop("at"), "blocks")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return cut(out, "boxed")


def boxed(placed: DataFrame) -> BoxTree:
    """The tree of points that have their ``block``."""
    ends = placed.select("block", F.posexplode("v").alias("dim", "x")).groupBy("block", "dim").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    ends = cut(ends, "ends")
    up = F.transform(F.sequence(F.lit(0), F.length("block")), lambda i: F.substring("block", F.lit(1), i))
    over = ends.select(F.explode(up).alias("node"), "block", "dim", "lo", "hi")
    wide = over.groupBy("node", "dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.col("node") == F.col("block")).alias("leaf"))
    box = F.transform(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))), lambda s: F.struct(s.lo, s.hi))
    nodes, seen = cut_measured(wide.groupBy("node").agg(box.alias("box"), F.max("leaf").alias("leaf")), "nodes", depth=F.max(F.length("node")))
    return BoxTree(placed, nodes, seen["depth"] or 0)


def _apart(one: str, other: str) -> Column:
    """The least distance between points of two boxes."""
    gap = F.zip_with(one, other, lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"], F.lit(0.0)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, d: s + d * d))


def near_blocks(tree: BoxTree, reach: DataFrame) -> DataFrame:
    """``(left, right)``: pairs of blocks, left <= right, whose distance is within the reach of either.

    ``reach (block, reach, first, last)`` says how far a block looks, and the least and greatest group of its points:
    blocks that lie in one and the same group are not paired.  The tree is descended from the root on both sides
    at once, so pairs that are far apart fall away high up and are never listed.
    """
    up = F.transform(F.sequence(F.lit(0), F.length("block")), lambda i: F.substring("block", F.lit(1), i))
    own = reach.select(F.explode(up).alias("node"), "reach", "first", "last").groupBy("node").agg(
        F.max("reach").alias("reach"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    nodes = cut(tree.nodes.join(own, "node"), "reaching")
    sides = {
        side: nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("box", "leaf", "reach", "first", "last")], F.col("node").alias(side))
        for side in ("left", "right")
    }

    def kept(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sides["left"], "left").join(sides["right"], "right")
        far = F.greatest("left_reach", "right_reach") * SLACK
        one = (F.least("left_first", "right_first") == F.greatest("left_last", "right_last"))
        return both.filter(~one & (_apart("left_box", "right_box") <= far)).select("left", "right", "left_leaf", "right_leaf")

    spark = tree.nodes.sparkSession
    pairs = kept(spark.createDataFrame([("", "")], "left string, right string"))
    for _ in range(tree.depth):
        below = lambda side: F.explode(
            F.when(F.col(f"{side}_leaf"), F.array(side)).otherwise(F.array(F.concat(side, F.lit("0")), F.concat(side, F.lit("1"))))
        ).alias(side)
        wider = pairs.select(below("left"), "right", "right_leaf").select("left", below("right")).filter("left <= right")
        pairs = cut(kept(wider), "near-blocks")
    return pairs.select("left", "right")


def compared(
    points: DataFrame, pairs: DataFrame, kernel, schema: str, columns: tuple[str, ...] = ("v", "weight", "cell", "node")
) -> DataFrame:
    """``kernel`` on the points of every pair of blocks, one pair at a time."""
    slim = points.select("block", "p", *columns)
    keyed = pairs.select("left", "right", F.explode(F.when(F.col("left") == F.col("right"), F.array(F.lit(0))).otherwise(
        F.array(F.lit(0), F.lit(1)))).alias("side"))
    members = keyed.withColumn("block", F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right"))).join(slim, "block")
    placed = members.select("left", "right", "side", "p", *columns).repartition("left", "right")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            while len(frame):
                same = (frame["left"] == frame["left"].iloc[0]) & (frame["right"] == frame["right"].iloc[0])
                n = len(frame) if same.all() else int((~same).to_numpy().argmax())
                part, frame = frame.iloc[:n], frame.iloc[n:]
                if held and (held[0]["left"].iloc[0], held[0]["right"].iloc[0]) != (part["left"].iloc[0], part["right"].iloc[0]):
                    yield kernel(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield kernel(pd.concat(held))

    return placed.sortWithinPartitions("left", "right", "side", "p").mapInPandas(run, schema)


#: Vectors that one task holds while blocks stream past it.
HELD_BYTES = 16 << 20


def streamed(
    held: DataFrame,
    side: DataFrame,
    pairs: DataFrame,
    kernel,
    schema: str,
    columns: tuple[str, ...],
    *,
    held_bytes: int = HELD_BYTES,
    mirrored: bool = True,
) -> DataFrame:
    """``kernel(held, blocks)`` on groups of the blocks of ``held``, with the blocks of ``side`` that ``pairs`` put near them.

    Both have ``block, p, v`` and ``columns``; ``pairs (left, right)`` are taken in both directions, or, if not ``mirrored``,
    with the left one held.  A group is what lies
    under the uppermost node of the box tree that fits in ``held_bytes``.  A block travels once for each group it is near,
    not for each block, so what is shuffled falls with the bytes held.  Few groups are held by several tasks each, which
    divide the blocks that stream past.  The kernel gets lists of blocks, each ``(p, v, *columns)`` as arrays.
    """
    spark = held.sparkSession
    counts = held.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"))
    up = F.transform(F.sequence(F.lit(0), F.length("block")), lambda i: F.substring("block", F.lit(1), i))
    nodes = counts.select(F.explode(up).alias("node"), "block", "n", "dim")
    inside = nodes.groupBy("node").agg(F.sum(F.col("n") * F.col("dim") * 8).alias("bytes"))
    fits = (F.col("bytes") <= held_bytes) | (F.col("node") == F.col("block"))
    groups = nodes.join(inside, "node").filter(fits).groupBy("block").agg(F.min_by("node", F.length("node")).alias("node"))
    groups, seen = cut_measured(groups, "groups", n=F.count(F.lit(1)))
    # One row for every group, which is some megabytes of vectors.
    named = groups.select("node").distinct().withColumn("g", F.row_number().over(Window.orderBy("node")) - 1)
    named, found = cut_measured(named, "group-numbers", n=F.count(F.lit(1)))
    groups = groups.join(F.broadcast(named), "node").select("block", "g")
    salts = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // max(found["n"], 1)), seen["n"]))
    both = pairs.select("left", "right")
    if mirrored:
        both = both.unionAll(pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
    asked = both.join(groups, F.col("left") == F.col("block")).select("g", F.col("right").alias("block")).distinct()
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    each = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    part = (F.col("g") * salts + F.col("salt")).cast("int").alias("part")
    rows = [
        df.join(to, "block").select(part, F.lit(tag).alias("tag"), "block", "p", "v", *columns) for tag, df, to in ((0, held, each), (1, side, asked))
    ]
    placed = rows[0].unionByName(rows[1]).repartitionById(max(found["n"] * salts, 1), F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in itertools.groupby(_blocks(batches), key=lambda b: b[0]):
            own: list[tuple] = []
            first = None
            for _, tag, block in found:
                if tag:
                    first = block
                    break
                own.append(block)
            if own and first is not None:
                yield from kernel(own, itertools.chain([first], (b for _, _, b in found)))

    return placed.sortWithinPartitions("part", "tag", "block", "p").mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, tuple]]:
    """``(part, tag, (p, v, ..))`` of every block, whole."""

    def arrays(pieces: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(pieces).combine_chunks()
        flat = table.column("v").combine_chunks()
        v = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=True).reshape(len(flat), -1)
        rest = [table.column(i).to_numpy() for i in range(5, table.num_columns)]
        return (table.column("p").to_numpy(), v, *rest)

    now, pieces = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        # Blocks are runs; one that goes on in the next batch has the same key there.
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        new = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        for lo, hi in itertools.pairwise([0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]):
            key = tuple(k[lo] for k in keys)
            if now is not None and key != now:
                yield now[0], now[1], arrays(pieces)
                pieces = []
            now = key
            pieces.append(batch.slice(lo, hi - lo))
    if pieces:
        yield now[0], now[1], arrays(pieces)


class Boxes:
    """The bounding boxes of blocks of points, and how near other points can be to each."""

    def __init__(self, blocks: list[np.ndarray]):
        self.lo = np.stack([v.min(axis=0) for v in blocks])
        self.hi = np.stack([v.max(axis=0) for v in blocks])

    def squares(self, v: np.ndarray) -> np.ndarray:
        """The least squared distance from each block to the box of ``v``."""
        gap = np.maximum(np.maximum(self.lo - v.max(axis=0), v.min(axis=0) - self.hi), 0.0)
        return (gap * gap).sum(axis=1)


def squares(x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Squared distances as one product; off by rounding, within ``off(xx, yy)``."""
    out = x @ y.T
    out *= -2
    out += xx[:, None]
    out += yy[None, :]
    return out


def off(xx: np.ndarray, yy: np.ndarray) -> float:
    return 1e-11 * float(xx.max() + yy.max()) + 1e-300


#: Single precision screens while its rounding is below this share of the squared distances it is held against.
FINE = 1e-2


class Single:
    """A block in single precision, for products that tell which pairs of points may be within a distance.

    Half the squared distance is half of both norms less the product: the streaming side carries its half as one more
    coordinate, the held side's is part of what the products are held against.  Unit vectors need neither.
    """

    def __init__(self, v: np.ndarray, norms: np.ndarray, units: bool = False, streams: bool = False):
        self.half, self.top, self.dim = norms / 2, float(norms.max()), v.shape[1]
        self.units = units
        if self.top > 1e30:
            self.v = None
        elif units:
            self.v = v.astype(np.float32)
        else:
            more = -self.half if streams else np.ones(len(v))
            self.v = np.column_stack([v, more]).astype(np.float32)

    def rounding(self, other: Single) -> float:
        """What rounding may put a squared distance off by; infinite if single precision cannot hold the vectors."""
        if self.v is None or other.v is None:
            return np.inf
        return (self.dim + 8) * 2.0**-21 * (self.top + other.top) + 1e-30

    def products(self, other: Single) -> np.ndarray:
        return self.v @ other.v.T

    def least(self, far: np.ndarray) -> np.ndarray:
        """What a product is at least if its squared distance is at most ``far``."""
        return ((1 - far / 2) if self.units else self.half - far / 2).astype(np.float32)

    def within(self, other: Single, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose squared distance, as computed, is at most ``far`` of the held point."""
        found = self.products(other) >= self.least(far)[:, None]
        return np.divmod(_set(found.ravel()), found.shape[1])


def _set(flags: np.ndarray) -> np.ndarray:
    """Places of the few flags that are set, looked for eight at a time."""
    whole = len(flags) // 8 * 8
    eights = flags[:whole].reshape(-1, 8)
    some = np.flatnonzero(eights.view(np.uint64))
    at, place = np.nonzero(eights[some])
    return np.concatenate([some[at] * 8 + place, whole + np.flatnonzero(flags[whole:])])


class Near:
    """Which points of blocks that stream past lie within ``eps`` of held ones."""

    def __init__(self, xs: list[np.ndarray], eps: float):
        self.xs, self.eps, self.boxes = xs, eps, Boxes(xs)
        self.norms = [(x * x).sum(axis=1) for x in xs]
        self.short = [Single(x, n) for x, n in zip(xs, self.norms)]

    def blocks(self, y: np.ndarray) -> np.ndarray:
        """Held blocks whose box comes within ``eps`` of that of ``y``, which is looked at from now on."""
        self.y, self.yy = y, (y * y).sum(axis=1)
        self.other = Single(y, self.yy, streams=True)
        return np.flatnonzero(self.boxes.squares(y) <= self.eps**2 * SLACK)

    def pairs(self, i: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points of ``rows`` of held block ``i`` and points of ``y`` within ``eps``.

        Where rounding of the products could decide, the difference is taken.
        """
        far, short, x = self.eps**2, self.short[i], self.xs[i]
        rounding = short.rounding(self.other)
        if rounding <= FINE * far:
            found = short.v[rows] @ self.other.v.T
            at = _set((found >= short.least(far + rounding)[rows][:, None]).ravel())
            a, b = np.divmod(at, found.shape[1])
            sure = found.ravel()[at] >= short.least(far - rounding)[rows][a]
        else:
            s = squares(x[rows], self.y, self.norms[i][rows], self.yy)
            slack = 1e-9 * (1.0 + far + self.norms[i].max() + self.yy.max())
            a, b = np.nonzero(s <= far + slack)
            sure = s[a, b] < far - slack
        a, open_ = rows[a], np.flatnonzero(~sure)
        sure[open_] = np.sqrt(((x[a[open_]] - self.y[b[open_]]) ** 2).sum(axis=1)) <= self.eps
        return a[sure], b[sure]


def nearest_points(keep: int, cosine: bool, digits: int):
    """Kernel of ``streamed``: ``(p, q, m)``, the ``keep`` nearest points of each held one, itself included, ties to smaller ``q``.

    ``m`` is the distance, or minus the cosine of unit vectors, rounded to ``digits``.  A product screens the points of a
    block against the worst one kept so far; only what passes is computed again, as a sum in the order of the coordinates.
    """

    def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.round(-(x * y).sum(axis=1) if cosine else np.sqrt(((x - y) ** 2).sum(axis=1)), digits)

    tie = 4 * 10.0**-digits

    def kernel(own: list[tuple], blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        points, xs = [b[0] for b in own], [b[1] for b in own]
        boxes, norms = Boxes(xs), [(x * x).sum(axis=1) for x in xs]
        slack = [off(n, n) for n in norms]
        short = [Single(x, n, cosine) for x, n in zip(xs, norms)]

        def screened(i: int, y: np.ndarray, yy: np.ndarray) -> np.ndarray:
            return -(xs[i] @ y.T) if cosine else squares(xs[i], y, norms[i], yy)

        def limit(m: np.ndarray, i: int) -> np.ndarray:
            return m + tie + slack[i] if cosine else (m + tie) ** 2 + slack[i]

        def far(i: int) -> np.ndarray:
            """Limits as squared distances."""
            return 2 + 2 * limits[i] if cosine else limits[i]

        # A block bounds the nearest points of its own.
        limits, held, room = [], [], []
        for i, x in enumerate(xs):
            bound = np.full(len(x), np.inf)
            if len(x) >= keep:
                s = np.partition(screened(i, x, norms[i]), keep - 1, axis=1)[:, keep - 1]
                bound = limit(s if cosine else np.sqrt(np.maximum(s, 0.0) + slack[i]), i) + slack[i]
            limits.append(bound)
            held.append([])
            room.append(float(np.median(far(i))))
        waiting = [0] * len(xs)

        def merged(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at, q, m = (np.concatenate(c) for c in zip(*held[i])) if held[i] else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            order = np.lexsort((q, m, at))
            at, q, m = at[order], q[order], m[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            best = place < keep
            last = place == keep - 1
            limits[i][at[last]] = np.minimum(limits[i][at[last]], limit(m[last], i))
            held[i], waiting[i] = [(at[best], q[best], m[best])], 0
            room[i] = float(np.median(far(i)))
            return at[best], q[best], m[best]

        for q, y, *_ in blocks:
            yy = (y * y).sum(axis=1)
            apart = boxes.squares(y)
            other = Single(y, yy, cosine, streams=True)
            for i in range(len(xs)):
                if apart[i] * (1 - 1e-9) > far(i).max() + off(norms[i], yy):
                    continue
                rounding = short[i].rounding(other)
                if rounding <= FINE * room[i]:
                    a, b = short[i].within(other, far(i) + rounding)
                else:
                    a, b = np.nonzero(screened(i, y, yy) <= (limits[i] + off(norms[i], yy))[:, None])
                if not len(a):
                    continue
                for s in range(0, len(a), 65536):
                    one, two = a[s : s + 65536], b[s : s + 65536]
                    held[i].append((one, q[two], exact(xs[i][one], y[two])))
                waiting[i] += len(a)
                if waiting[i] > 4 * len(xs[i]):
                    merged(i)
        for i in range(len(xs)):
            at, q, m = merged(i)
            yield pa.RecordBatch.from_arrays([pa.array(points[i][at]), pa.array(q), pa.array(m)], ["p", "q", "m"])

    return kernel


def block_reach(tree: BoxTree, keep: int, cosine: bool) -> DataFrame:
    """``(block, reach, first, last)``: how far the ``keep`` nearest points of any of a block's points can be, itself included.

    A block with fewer points knows no bound.  Every point is its own group, so only pairs of a lone point with itself
    are left out by ``near_blocks``, and a block is paired with itself.
    """

    def kernel(block: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(block["v"].to_numpy())
        xx = (x * x).sum(axis=1)
        reach = float("inf")
        if len(x) >= keep:
            s = 2 - 2 * (x @ x.T) if cosine else squares(x, x, xx, xx)
            reach = float(np.sqrt(max(np.partition(s, keep - 1, axis=1)[:, keep - 1].max(), 0.0) + off(xx, xx) + 1e-11))
        p = block["p"].to_numpy()
        return pd.DataFrame({"block": [block["left"].iloc[0]], "reach": [reach], "first": [int(p.min())], "last": [int(p.max()) + 1]})

    own = tree.points.select(F.col("block").alias("left"), F.col("block").alias("right")).distinct()
    return compared(tree.points, own, kernel, "block string, reach double, first bigint, last bigint", ("v",))
