"""Near-duplicates by a chosen-path set similarity join over word shingles.

1. Every document becomes its set of distinct word shingles.  Equal sets collapse to the smallest id, so a
   group of copies is one node whatever its size.
2. Several independent trees branch the sets by minwise tokens.  A root's children are the values of one
   minwise hash; a child with few members is compared exhaustively on byte signatures, a larger one is
   branched again on two further hash positions chosen by its path.  A node that branching no longer makes
   smaller holds sets that are much alike: its members are compared with one of them, and only those that
   differ from it go on, in blocks, against the whole node.
3. What a node compares ends as stars around smallest ids, not as pairs: a group of n gives at most n - 1 links.
   Components of these candidate links are computed and confirmed on full sets.  A component of one block
   is compared exhaustively.  A larger one is compared with two of its members, which leaves those that
   did not get into its largest linked part; new members are chosen from these while that settles half of
   them, and what is left then is compared with the whole component, block by block.  Blocks are bounded in
   sets and in bytes of text and there may be any number of them.  Components of confirmed links are the
   result.

A pair at similarity t meets in a tree with probability of at least t at the root, and of about 0.97 of
that below it; ``trees`` independent trees miss it with about (1 - t) ** trees (6e-9 for 0.85 and ten
trees).  Signatures of 128 positions let through pairs 5.4 standard deviations below t.

Defined results: texts that are null or without words have 0 shingles and are linked with nothing; rows
without an id are not compared, have a null component and are kept; rows that share an id are one
document, linked through whichever of their texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import WordHashes, folded_words, mixed, rolling, slices, word_hashes
from earshot.operators.graph import connected_components
from earshot.sources.shared import cut, cut_measured

SIGNATURE = 128
#: Largest node that is compared exhaustively on signatures; blocks of larger ones.
LEAF = 2048
#: A node that keeps more than this share of its parent's members is not branched further.
DENSE = 0.8
MAX_DEPTH = 6
BRANCHES = 2
#: Sets, and bytes of their texts, in a block of a component that is confirmed exactly.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Members whose node sizes one task writes; fewer tasks write fewer files.
TASK_MEMBERS = 200_000
#: Parts of a join on a component that may hold a third of all sets.
SALTS = 16

_FACTOR = 0x5851F42D4C957F2D | 1


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; of fewer words, of all of them."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    n = min(size, len(words))
    return np.unique(rolling(h + np.uint64(n), n, _FACTOR))


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def minwise(items: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least high half of item * multiplier for each multiplier."""
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(items), 1024):
        part = (items[None, a : a + 1024] * multipliers[:, None]).min(axis=1)
        np.minimum(out, part, out=out)
    return out >> np.uint64(32)


def _sketcher(size: int, trees: int, seed: int):
    roots, own = _multipliers(trees, seed), _multipliers(SIGNATURE, seed + 1)
    both = np.concatenate([roots, own])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            for part in slices(batch):
                counts, digests, paths, signatures = [], [], [], []
                for text in part.column(0).to_pylist():
                    s = shingles(folded_words(text), size, hashes)
                    counts.append(len(s))
                    if not len(s):
                        digests.append(None)
                        paths.append(None)
                        signatures.append(None)
                        continue
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    found = minwise(s, both)
                    tree = np.arange(trees, dtype=np.uint64) << np.uint64(32)
                    paths.append(mixed(found[:trees] | tree).view(np.int64))
                    signatures.append((found[trees:] & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1),
                        part.column(2),
                        pc.binary_length(part.column(0)).cast(pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(paths, pa.list_(pa.int64())),
                        pa.array(signatures, pa.binary()),
                    ],
                    ["doc_id", "mark", "bytes", "n_shingles", "digest", "paths", "sig"],
                )

    return sketch


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    percent: int = 85,
    trees: int = 10,
    leaf: int = LEAF,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
    seed: int = 29,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    Sets A and B are linked when 100 |A and B| >= percent |A or B|.
    """
    rows = docs.select(
        F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("mark")
    )
    sketch = cut(
        rows.mapInArrow(
            _sketcher(words, trees, seed),
            "doc_id bigint, mark bigint, bytes bigint, n_shingles bigint, digest binary, paths array<bigint>, sig binary",
        ),
        "sketches",
    )
    sets = cut(
        sketch.filter("doc_id is not null and digest is not null")
        .groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "mark", "bytes")).alias("first"),
            F.first("n_shingles").alias("n"),
            F.first("paths").alias("paths"),
            F.first("sig").alias("sig"),
        )
        .select("digest", F.col("first.doc_id").alias("id"), "first.mark", "first.bytes", "n", "paths", "sig"),
        "sets",
    )
    t = percent / 100
    least = math.ceil(SIGNATURE * max(0.0, t - 5.4 * math.sqrt(t * (1 - t) / SIGNATURE)))
    candidates = candidate_links(sets, least, leaf=leaf)
    groups = connected_components(candidates)
    confirmed = confirmed_links(rows, sets, groups, words, percent, block, block_bytes)
    joined = connected_components(confirmed)
    named = sets.select("digest", "id").join(
        joined.select(F.col("node").alias("id"), "component"), "id", "left"
    ).select("digest", F.coalesce("component", "id").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )


def candidate_links(sets: DataFrame, least: int, *, leaf: int = LEAF) -> DataFrame:
    """Links ``(src, dst)`` whose components hold every pair that may reach the similarity asked for."""
    light = sets.select("id", "digest", "sig")
    members = sets.select(F.explode("paths").alias("path"), "digest").withColumn("parent_n", F.lit(None).cast("bigint"))
    n_members = sets.agg(F.sum(F.size("paths"))).first()[0] or 0
    found: list[DataFrame] = []
    for depth in range(MAX_DEPTH + 1):
        counted = members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sizes = cut(counted.coalesce(1 + n_members // TASK_MEMBERS), "sizes")
        small = members.join(sizes.filter(F.col("n") <= leaf), "path").join(light, "digest")
        cells = small.select("path", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "id", "sig")
        found.append(_compare(cells, _by_signature(least)))
        met = members.join(sizes.filter(F.col("n") > leaf), "path").join(light, "digest")
        dense = F.coalesce(F.col("n") > DENSE * F.col("parent_n"), F.lit(False)) if depth < MAX_DEPTH else F.lit(True)
        large, seen = cut_measured(
            met.withColumn("dense", dense), "nodes", n=F.count(F.lit(1)), n_dense=F.count_if("dense")
        )
        if seen["n_dense"]:
            found += _dense(large.filter("dense"), least, leaf)
        if seen["n"] == seen["n_dense"]:
            break
        n_members = BRANCHES * (seen["n"] - seen["n_dense"])
        members = _branch(large.filter(~F.col("dense")).select("path", "digest", "n", "sig"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _branch(large: DataFrame) -> DataFrame:
    """The children of each member: values at positions that depend on the path alone."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(0).to_numpy().view(np.uint64)
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(path), SIGNATURE)
            children = []
            for j in range(BRANCHES):
                own = mixed(path + np.uint64(j + 1))
                at = (own % np.uint64(SIGNATURE)).astype(np.int64)
                children.append(mixed(own ^ sig[np.arange(len(path)), at].astype(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(children)),
                    pa.chunked_array([batch.column(1)] * BRANCHES).combine_chunks(),
                    pa.chunked_array([batch.column(2)] * BRANCHES).combine_chunks(),
                ],
                ["path", "digest", "parent_n"],
            )

    return large.mapInArrow(choose, "path bigint, digest binary, parent_n bigint")


def _dense(nodes: DataFrame, least: int, leaf: int) -> list[DataFrame]:
    """Links of nodes that do not branch: with one member, and of those unlike it with all, in blocks."""
    pivots = nodes.groupBy("path").agg(F.min(F.struct(F.xxhash64("path", "id"), "id", "sig")).alias("pivot"))
    met = nodes.join(pivots.select("path", F.col("pivot.id").alias("pivot"), F.col("pivot.sig").alias("pivot_sig")), "path")

    def like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for i in (3, 5))
            alike = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], alike], ["path", "n", "id", "sig", "pivot", "alike"])

    judged = cut(
        met.select("path", "n", "id", "sig", "pivot", "pivot_sig").mapInArrow(
            like, "path bigint, n bigint, id bigint, sig binary, pivot bigint, alike boolean"
        ),
        "dense",
    )
    star = judged.filter("alike and id <> pivot").select(F.col("id").alias("src"), F.col("pivot").alias("dst"))
    rest = judged.filter("not alike")
    counts = rest.groupBy("path").agg(F.count(F.lit(1)).alias("n_rest"))
    half = leaf // 2
    blocks = lambda n: F.ceil(n / half)
    of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    left = rest.join(counts, "path").select(
        "path", of(blocks(F.col("n_rest"))).alias("a"), every(blocks(F.col("n"))).alias("b"), F.lit(0).alias("side"), "id", "sig"
    )
    right = judged.join(counts, "path").select(
        "path", every(blocks(F.col("n_rest"))).alias("a"), of(blocks(F.col("n"))).alias("b"), F.lit(1).alias("side"), "id", "sig"
    )
    return [star, _compare(left.unionByName(right), _by_signature(least))]


def _compare(cells: DataFrame, links) -> DataFrame:
    """Links found in each cell.  ``cells``: path, a, b, side, id and what ``links`` compares.

    Sides 0 and 1 are compared with each other; a cell of one side is compared within itself.
    """
    keys = ["path", "a", "b"]
    placed = cells.repartition(*keys).sortWithinPartitions(*keys, "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, side, ids, data in _cells(batches):
            if out := links(side, ids, data):
                src, dst = zip(*out)
                yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return placed.select(*keys, "side", "id", cells.columns[-1]).mapInArrow(run, "src bigint, dst bigint")


def _cells(batches: Iterator[pa.RecordBatch]):
    """Consecutive rows of equal key, one cell at a time."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:3] != now:
                if len(held) > 1:
                    yield now, *zip(*held)
                held, now = [], row[:3]
            # Repeated rows are one.
            if not held or row[3:] != held[-1]:
                held.append(row[3:])
    if len(held) > 1:
        yield now, *zip(*held)


def stars(ids: tuple[int, ...], side: np.ndarray, near) -> list[tuple[int, int]]:
    """Links from each member of a component to its smallest id; ``near(i, others)`` tells which are linked to i.

    Breadth-first, asking only for members that no link has reached yet, so a cell whose members are all
    alike costs one question.  As all trees name a component's smallest id where they can, most of their
    links are the same and are counted once.
    """
    open_ = np.ones(len(ids), bool)
    two = bool(side.any()) and not side.all()
    out = []
    for root in range(len(ids)):
        if not open_[root]:
            continue
        open_[root] = False
        queue, reached = [root], [root]
        while queue:
            i = queue.pop()
            others = np.nonzero(open_ & (side != side[i]) if two else open_)[0]
            if not len(others):
                continue
            new = others[near(i, others)].tolist()
            open_[new] = False
            queue += new
            reached += new
        least = min(ids[i] for i in reached)
        out += [(ids[i], least) for i in reached if ids[i] != least]
    return out


def _by_signature(least: int):
    def links(side, ids, data):
        sig = np.frombuffer(b"".join(data), np.uint8).reshape(len(ids), SIGNATURE)
        near = lambda i, others: (sig[others] == sig[i]).sum(axis=1) >= least
        return stars(ids, np.array(side), near)

    return links


def _by_sets(size: int, percent: int):
    def links(side, ids, data):
        hashes = word_hashes()
        sets = [shingles(folded_words(t), size, hashes) for t in data]
        n = np.array([len(s) for s in sets], np.int64)
        flat, code = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(n)
        marked = np.zeros(len(flat), bool)

        def near(i, others):
            # Sizes alone rule out most; what is shared is counted on the full sets.
            ok = 100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])
            asked = others[ok]
            if not len(asked):
                return ok
            own = code[ends[i] - n[i] : ends[i]]
            marked[own] = True
            if 4 * len(asked) > len(n):
                shared = np.add.reduceat(marked[code], ends - n, dtype=np.int64)[asked]
            else:
                shared = np.array([np.count_nonzero(marked[code[ends[j] - n[j] : ends[j]]]) for j in asked], np.int64)
            marked[own] = False
            ok[ok] = 100 * shared >= percent * (n[asked] + n[i] - shared)
            return ok

        return stars(ids, np.array(side), near)

    return links


def confirmed_links(
    rows: DataFrame,
    sets: DataFrame,
    groups: DataFrame,
    words: int,
    percent: int,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Links on full sets that span each group's components; ``groups`` is (node, component)."""
    links = _by_sets(words, percent)

    def blocks(n, size):
        return F.ceil(F.greatest(n / block, F.coalesce(size, F.lit(0)) / block_bytes)).cast("int")

    grouped = sets.select("id", "mark", "bytes").join(
        groups.select(F.col("node").alias("id"), F.col("component").alias("path")), "id"
    )
    sizes = grouped.groupBy("path").agg(blocks(F.count(F.lit(1)), F.sum("bytes")).alias("blocks"))
    wanted = _of_path(grouped, sizes)
    texts, seen = cut_measured(
        rows.join(wanted, (F.col("doc_id") == F.col("id")) & (rows["mark"] == wanted["mark"])).select(
            "path", "blocks", "bytes", "id", "text"
        ),
        "texts",
        n=F.count_if(F.col("blocks") > 1),
    )
    zero = F.lit(0)
    single = texts.filter("blocks = 1").select("path", zero.alias("a"), zero.alias("b"), zero.alias("side"), "id", "text")
    found = _compare(single, links)
    if not seen["n"]:
        return found
    large = texts.filter("blocks > 1")
    nodes = large.select("path", "id").distinct()
    left, apart, turn, spanning = seen["n"], nodes, 0, None
    while True:
        more = cut(_compare(_pivot_cells(large, apart, turn), links), "links")
        spanning = more if spanning is None else spanning.unionByName(more)
        parts = connected_components(spanning).select(F.col("node").alias("id"), "component")
        named = nodes.join(parts, "id", "left").select("path", "id", F.coalesce("component", "id").alias("part"))
        counts = named.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n"))
        main = counts.groupBy("path").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
        apart, seen = cut_measured(
            _of_path(named, main).filter("part <> main").select("path", "id"), "apart", n=F.count(F.lit(1))
        )
        if not seen["n"]:
            return found.unionByName(spanning)
        if 2 * seen["n"] > left:
            break
        left, turn = seen["n"], turn + 1
    rest = _compare(_rest_cells(large, apart, blocks), links)
    return found.unionByName(spanning).unionByName(rest)


def _of_path(members: DataFrame, paths: DataFrame) -> DataFrame:
    """Add what ``paths`` holds for a member's component, over several keys for each component."""
    salted = paths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["path", "_salt"]).drop("_salt")


def _pivot_cells(large: DataFrame, apart: DataFrame, turn: int) -> DataFrame:
    """Each block of a component with two of the members that are ``apart`` from its largest linked part."""
    marks = [F.min(F.struct(F.xxhash64(F.lit(2 * turn + j), "id"), "id"))["id"] for j in range(2)]
    chosen = apart.groupBy("path").agg(F.array(*marks).alias("ids"))
    pivots = chosen.select("path", F.explode(F.array_distinct("ids")).alias("id"))
    met = _of_path(large, chosen.select("path"))
    side = lambda df, a, n: df.select("path", a.alias("a"), F.lit(0).alias("b"), F.lit(n).alias("side"), "id", "text")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return side(large.join(pivots, ["path", "id"]), every, 0).unionByName(side(met, own, 1))


def _rest_cells(large: DataFrame, apart: DataFrame, blocks) -> DataFrame:
    """Blocks of the members ``apart`` meet each other and those of the largest linked part.

    The blocks apart are numbered first, so block x meets each block y >= x in the cell (x, y), and in (x, x)
    it is compared within itself; two blocks of the largest part do not meet.
    """
    marked = large.join(apart.withColumn("apart", F.lit(True)), ["path", "id"], "left").withColumn(
        "apart", F.coalesce("apart", F.lit(False))
    )
    n = {
        name: blocks(F.count_if(which), F.sum(F.when(which, F.col("bytes"))))
        for name, which in (("k", F.col("apart")), ("m", ~F.col("apart")))
    }
    counted = marked.groupBy("path").agg(*[v.alias(name) for name, v in n.items()]).filter("k > 0")
    hashed = F.xxhash64("id")
    own = F.when(F.col("apart"), F.pmod(hashed, F.col("k"))).otherwise(F.col("k") + F.pmod(hashed, F.col("m")))
    last = F.when(F.col("apart"), F.col("k") + F.col("m") - 1).otherwise(F.col("k") - 1)
    to = (
        _of_path(marked, counted)
        .withColumn("own", own.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    )
    return to.select(
        "path",
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "id",
        "text",
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti").select(*docs.columns)

