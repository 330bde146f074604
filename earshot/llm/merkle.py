"""Merkle manifest of a dataset, with levels kept as strings.

Rows are leaves; the leaves of a group, in order, make a tree in which every ``fan`` consecutive nodes become
their hash until one is left, and the groups' roots make a tree of the same kind.  An aligned block of
``fan * fan`` nodes is one row that keeps each of its levels as one string of hexadecimal digests.  A parent is
then the hash of a substring of fixed width, and the siblings of a node are the parts of that substring on
either side of it.  The roots of blocks are the nodes of the next layer, whose rows are fewer by the block's
size, until no group has more than one block.  Everything is SQL on strings; no group is ever in one task.

Defined results: a null field is written ``-`` and differs from an empty one; null groups are one group, the
first; ties of the order are broken by the leaf, and rows that repeat are leaves each; an empty table has no
layers and no root.  Columns that are neither fields, group nor order are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.numbering import group_key, numbered
from earshot.sources.shared import cut, cut_measured

FAN = 16
#: Characters of a digest.
WIDTH = 64

PATH = "array<struct<left:string,right:string>>"


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The hash of the fields in order: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value), F.lit(":"), value)))
    return digest(F.concat(*parts))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def proof(path: Column) -> Column:
    """All siblings of a leaf, level by level up to the root, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


@dataclass
class Manifest:
    """Written layers of blocks: those of the groups' trees from the leaves up, and those of the tree of their roots."""

    groups: list[DataFrame]
    roots: list[DataFrame]
    root: str | None
    fan: int


def _parents(level: Column, fan: int) -> Column:
    run = fan * WIDTH
    runs = F.ceil(F.octet_length(level) / run).cast("int")
    made = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: digest(F.substring(level, i * run + 1, F.lit(run))))
    return F.array_join(made, "").cast("binary")


def _layers(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """Layers of blocks over ``(key, pos, digest, carried)``; ``digest`` is binary."""
    out = []
    while True:
        rest = [c for c in nodes.columns if c not in ("key", "pos")]
        block = F.floor(F.col("pos") / (fan * fan)).cast("bigint")
        blocks = nodes.groupBy("key", block.alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("nodes")
        )
        texts = F.transform("nodes", lambda x: F.lower(F.hex(x["digest"])))
        n = F.size("nodes")
        # Only a first block can be all of a group: then it has as many levels as it takes to get to one node.
        alone = F.col("block") == 0
        levels = F.when(alone & (n == 1), 0).when(alone & (n <= fan), 1).otherwise(2)
        blocks = blocks.withColumn("level0", F.array_join(texts, "").cast("binary")).withColumn("levels", levels)
        blocks = blocks.withColumn("nodes", F.transform("nodes", lambda x: x.dropFields("digest")))
        blocks = blocks.withColumn("level1", F.when(F.col("levels") > 0, _parents(F.col("level0"), fan)))
        top = F.when(F.col("levels") == 0, F.col("level0")).when(F.col("levels") == 1, F.col("level1"))
        blocks = blocks.withColumn("top", top.otherwise(_parents(F.col("level1"), fan)).cast("string"))
        layer, seen = cut_measured(blocks, "merkle", most=F.max("block"))
        out.append(layer)
        if not seen["most"]:
            return out
        nodes = layer.select("key", F.col("block").alias("pos"), F.unhex("top").alias("digest"))


def merkle_manifest(
    docs: DataFrame,
    *,
    fields: Sequence[str],
    group_col: str,
    order_col: str,
    carry: Sequence[Column] = (),
    fan: int = FAN,
) -> Manifest:
    """The manifest of ``docs``; ``carry`` are further columns that ``proofs`` gives back with each row."""
    x = F.col(order_col)
    leaves = docs.select(
        group_key(F.col(group_col)).alias("key"),
        F.col(group_col).alias("group"),
        x.alias("id"),
        F.unhex(leaf_digest([F.col(c) for c in fields])).alias("digest"),
        F.struct(F.lit(0).alias("none"), *carry).alias("carried"),
    )
    # Texts are hashed once: what is sorted by ranges is the written narrow table.
    placed = numbered(cut(leaves, "leaves"), "key", [F.col("id").asc_nulls_first(), F.col("digest")])
    groups = _layers(placed.select("key", "pos", "digest", "group", "id", "carried"), fan)
    tops = groups[-1].select("key", F.unhex("top").alias("digest"))
    tops = numbered(tops.withColumnRenamed("key", "of").withColumn("key", F.lit("")), "key", [F.col("of")])
    roots = _layers(tops.select("key", "pos", "digest", "of"), fan)
    found = roots[-1].select("top").first()
    return Manifest(groups, roots, found and found["top"], fan)


def levels(manifest: Manifest) -> DataFrame:
    """``(tree, layer, group_key, block, n, level0, level1, top)``: what is to be stored with the dataset."""
    parts = [
        layer.select(
            F.lit(tree).alias("tree"),
            F.lit(i).alias("layer"),
            F.col("key").alias("group_key"),
            "block",
            F.size("nodes").alias("n"),
            F.col("level0").cast("string").alias("level0"),
            F.col("level1").cast("string").alias("level1"),
            "top",
        )
        for tree, layers in (("group", manifest.groups), ("root", manifest.roots))
        for i, layer in enumerate(layers)
    ]
    return reduce(DataFrame.unionAll, parts)


def _opened(blocks: DataFrame, fan: int) -> DataFrame:
    """A row per node, its siblings within the block put before those of the block (``above``)."""

    def steps(i: Column) -> Column:
        out = []
        for level, at in (("level0", i), ("level1", F.floor(i / fan).cast("int"))):
            run, own = F.floor(at / fan).cast("int") * (fan * WIDTH), (at % fan) * WIDTH
            left = F.substring(level, run + 1, own)
            right = F.substring(level, run + own + WIDTH + 1, fan * WIDTH - WIDTH - own)
            out.append(F.struct(left.cast("string").alias("left"), right.cast("string").alias("right")))
        return F.slice(F.array(*out), F.lit(1), F.col("levels"))

    node = F.transform(
        "nodes",
        lambda x, i: F.struct(
            x.alias("node"), F.substring("level0", i * WIDTH + 1, F.lit(WIDTH)).cast("string").alias("digest"), steps(i).alias("steps")
        ),
    )
    rest = [c for c in blocks.columns if c not in ("nodes", "level0", "level1", "levels", "top", "block")]
    opened = blocks.select(*rest, F.explode(node).alias("x"))
    return opened.select(
        *[c for c in rest if c != "above"], "x.node.*", "x.digest", F.concat("x.steps", "above").alias("path")
    )


def _descend(layers: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """Paths of the leaves, from those ``above`` the last layer's only block of each group."""
    for layer in reversed(layers):
        nodes = _opened(layer.join(above, ["key", "block"]), fan)
        kept = [c for c in above.columns if c not in ("key", "block", "above")]
        above = nodes.select("key", F.col("pos").alias("block"), F.col("path").alias("above"), *kept)
    return nodes


def proofs(manifest: Manifest) -> DataFrame:
    """``(group, id, leaf, subroot, root, path, carried)`` per row; ``path`` holds the siblings on both sides by level."""
    none = F.array().cast(PATH)
    start = manifest.roots[-1].select("key", "block", none.alias("above"))
    subroots = _descend(manifest.roots, start, manifest.fan)
    above = subroots.select(
        F.col("of").alias("key"), F.lit(0).cast("bigint").alias("block"), F.col("path").alias("above"), F.col("digest").alias("subroot")
    )
    nodes = _descend(manifest.groups, above, manifest.fan)
    return nodes.select("group", "id", F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), "path", "carried")
