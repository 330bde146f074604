"""Near-duplicate comments: MinHash candidates, full-set Jaccard, transitive groups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import text as tx
from earshot.operators.graph import connected_components
from earshot.sources.shared import cut, cut_measured

THRESHOLD = 0.85
NGRAM = 5
PERMUTATIONS = 128
SEED = 42
# Hash values for candidates, and rows per band.  32 bands of 8: a pair at 0.85 is missed with probability
# 4e-5, one at 0.3 meets in 0.2 % of cases.
CANDIDATE_HASHES = 256
BAND_ROWS = 8
# Rows compared with one another at once; a bucket of any size is taken in blocks of this many.
BLOCK = 128

# Pre-filters on sizes lean to the safe side of rounding.
SLACK = 1e-9

_PRIME_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX_STEPS = (
    (np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)), (np.uint64(31), None)
)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (multiply and xor-shift, wrapping)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _gram_hashes(text: str, n: int) -> np.ndarray:
    """One 64-bit hash per distinct character n-gram."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    width = min(n, len(codes))
    if width == 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(len(codes) - width + 1, width, dtype=np.uint64)
    spare = np.empty_like(h)
    for i in range(width):
        h *= _PRIME_MIX
        h += codes[i : i + len(h)]
        # As _mix, in place.
        for shift, factor in _MIX_STEPS:
            np.right_shift(h, shift, out=spare)
            h ^= spare
            if factor:
                h *= factor
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 31, size=count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 1 << 32, size=count, dtype=np.uint32)


def _signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int = 65536) -> np.ndarray:
    """Minimum of every permutation over the upper hash halves of every set, none of them empty.

    Sets are laid end to end up to ``step`` hashes, so that a permutation is a few calls for many texts; 32-bit lanes
    keep them vectorised.
    """
    out = np.empty((len(sets), len(a)), dtype=np.uint64)
    lo = 0
    while lo < len(sets):
        hi, size = lo + 1, len(sets[lo])
        while hi < len(sets) and size + len(sets[hi]) <= step:
            size += len(sets[hi])
            hi += 1
        halves = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(x) for x in sets[lo : hi - 1]]])
        # A text of more than a step is taken piece by piece, for the cache.
        least = np.full((hi - lo, len(a)), np.iinfo(np.uint32).max, dtype=np.uint32)
        for at in range(0, len(halves), step):
            block = halves[at : at + step]
            mixed = np.empty_like(block)
            for i, (x, y) in enumerate(zip(a, b)):
                np.multiply(block, x, out=mixed)
                mixed += y
                np.minimum(least[:, i], np.minimum.reduceat(mixed, starts), out=least[:, i])
        out[lo:hi] = least
        lo = hi
    return out


def minhash_signature(prepared: Column, *, n: int = NGRAM, permutations: int = PERMUTATIONS, seed: int = SEED) -> Column:
    """MinHash signature of a prepared text as ARRAY<BIGINT>; NULL for an empty text."""

    @F.pandas_udf("array<bigint>")
    def sign(text: pd.Series) -> pd.Series:
        a, b = _permutations(permutations, seed)
        grams = [_gram_hashes(t or "", n) for t in text]
        signed = iter(_signatures([g for g in grams if len(g)], a, b).view(np.int64))
        return pd.Series([next(signed) if len(g) else None for g in grams])

    return sign(prepared)


def _sketch(prepared: Column, n: int, hashes: int, seed: int, band_rows: int) -> Column:
    """``struct<n_grams, bands, sig>``: the size of the n-gram set, one key per band, one byte per hash value."""

    @F.pandas_udf("n_grams int, bands array<bigint>, sig binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a, b = _permutations(hashes, seed)
        for text in batches:
            grams = [_gram_hashes(t or "", n) for t in text]
            full = np.array([len(g) > 0 for g in grams], dtype=bool)
            signature = _signatures([g for g in grams if len(g)], a, b)
            small = (_mix(signature) & np.uint64(255)).astype(np.uint8)
            parts = signature.reshape(len(signature), -1, band_rows)
            h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
            for i in range(band_rows):
                h = _mix(h * _PRIME_MIX + parts[:, :, i])
            at = np.cumsum(full) - 1
            sizes = [len(g) for g in grams]
            sigs = [small[i].tobytes() if f else b"" for i, f in zip(at, full)]
            keys = [h[i].view(np.int64) if f else np.empty(0, dtype=np.int64) for i, f in zip(at, full)]
            yield pd.DataFrame({"n_grams": pd.Series(sizes, dtype="int32"), "bands": keys, "sig": sigs})

    return sketch(prepared)


def exact_copies(signed: DataFrame) -> DataFrame:
    """``(id, first_id)``: the smallest row with the same prepared text.  Only digests are shuffled.

    An empty text has no n-grams and resembles nothing, not even another empty text; it and a text that
    occurs once stand for themselves.
    """
    full = signed.filter("n_grams > 0").select("id", "digest")
    first = full.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    named = full.join(first.select("digest", "first_id"), "digest", "left")
    return named.select("id", F.coalesce("first_id", "id").alias("first_id")).unionAll(
        signed.filter("n_grams = 0").select("id", F.col("id").alias("first_id"))
    )


def near_duplicate_edges(
    df: DataFrame,
    *,
    text_col: str = "text_clean",
    id_col: str = "row_id",
    threshold: float = THRESHOLD,
    n: int = NGRAM,
    hashes: int = CANDIDATE_HASHES,
    seed: int = SEED,
    band_rows: int = BAND_ROWS,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """``(copies, edges)``: exact copies, and all verified pairs ``(a, b, similarity)`` of distinct texts, a < b.

    Copies are reduced to one row each before anything is compared, so the pairs are between different
    texts only.  Rows that share a band are compared on their signatures, in blocks of fixed size, whatever
    the size of the bucket; pairs whose signatures are near enough are then verified on whole n-gram sets.

    A pair at similarity t is missed with probability (1 - t ** band_rows) ** (hashes / band_rows), and with
    less than 1e-7 by the signature test, which lets through what is 5.4 standard deviations below t.
    """
    signed, docs, copies = _signed(df, text_col, id_col, n, hashes, seed, band_rows)
    pairs = candidate_pairs(docs, threshold, hashes, block)
    return copies, cut(_verified(pairs, docs, threshold, n), "near")


def _signed(df, text_col, id_col, n, hashes, seed, band_rows) -> tuple[DataFrame, DataFrame, DataFrame]:
    prepared = df.select(F.col(id_col).alias("id"), tx.gram_text(F.col(text_col)).alias("t"))
    signed = cut(
        prepared.withColumns(
            {"digest": F.sha2("t", 256), "_b": _sketch(F.col("t"), n, hashes, seed, band_rows)}
        ).select("id", "t", "digest", "_b.n_grams", "_b.bands", "_b.sig"),
        "signed",
    )
    copies = cut(exact_copies(signed), "copies")
    firsts = copies.filter(F.col("id") == F.col("first_id")).select("id")
    return signed, signed.filter("n_grams > 0").join(firsts, "id", "left_semi").drop("digest"), copies


def candidate_pairs(docs: DataFrame, threshold: float = THRESHOLD, hashes: int = CANDIDATE_HASHES, block: int = BLOCK) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, that share a band and whose signatures and sizes fit the threshold."""
    members = docs.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    placed = members.join(buckets, ["band", "key"]).select(
        "band", "key", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    )
    cells = placed.select(
        "band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "id",
    ).join(docs.select("id", "n_grams", "sig"), "id")
    order = ["band", "key", "x", "y"]
    sorted_cells = cells.select(*order, "side", "id", "n_grams", "sig").repartition(*order).sortWithinPartitions(*order, "side", "id")
    least = hashes * max(0.0, threshold - 5.4 * (threshold * (1 - threshold) / hashes) ** 0.5)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def compared() -> pa.RecordBatch:
            side, ids, sizes, sigs = zip(*held)
            side, ids, sizes = np.array(side), np.array(ids, np.int64), np.array(sizes, np.float64)
            sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), hashes)
            found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            two = side.any()
            for i in range(len(ids)):
                others = np.nonzero(side != side[i])[0] if two else np.arange(i + 1, len(ids))
                if two and side[i]:
                    break
                fits = np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i]) - SLACK
                others = others[fits]
                others = others[(sig[others] == sig[i]).sum(axis=1) >= least]
                found_a.append(np.minimum(ids[others], ids[i]))
                found_b.append(np.maximum(ids[others], ids[i]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != now:
                    if len(held) > 1:
                        yield compared()
                    now, held = row[:4], []
                held.append(row[4:])
        if len(held) > 1:
            yield compared()

    return cut(sorted_cells.mapInArrow(alike, "a bigint, b bigint").distinct(), "pairs")


def _size_fits(na: str, nb: str, threshold: float) -> Column:
    return F.least(na, nb) >= F.lit(threshold) * F.greatest(na, nb) - SLACK


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float, n: int) -> DataFrame:
    """Exact Jaccard similarity of candidate pairs, at or above the threshold."""
    left = docs.select(F.col("id").alias("a"), F.col("t").alias("ta"), F.col("n_grams").alias("na"))
    right = docs.select(F.col("id").alias("b"), F.col("t").alias("tb"), F.col("n_grams").alias("nb"))
    joined = pairs.join(left, "a").join(right, "b").filter(_size_fits("na", "nb", threshold))
    return (
        joined.select("a", "b", "na", "nb", _common(n)("ta", "tb").alias("c"))
        .withColumn("similarity", F.col("c") / (F.col("na") + F.col("nb") - F.col("c")))
        .filter(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )


def _common(n: int):
    """How many distinct n-grams two texts share (by 64-bit hash, like the set sizes)."""

    @F.pandas_udf("int")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        # One text is often compared with many: it is hashed once then.
        known: dict[str, np.ndarray] = {}

        def grams(text: str) -> np.ndarray:
            if text not in known:
                if len(known) >= 64:
                    known.clear()
                known[text] = _gram_hashes(text, n)
            return known[text]

        sizes = [np.intersect1d(grams(x), grams(y), assume_unique=True).size for x, y in zip(a, b)]
        return pd.Series(sizes, dtype="int32")

    return common


def first_near_duplicate(copies: DataFrame, edges: DataFrame) -> DataFrame:
    """``(row_id, first_id, similarity)``: for each row that has one, its smallest earlier near-duplicate."""
    both = edges.select(F.col("b").alias("first_id"), F.col("a").alias("other"), "similarity").unionAll(
        edges.select(F.col("a").alias("first_id"), F.col("b").alias("other"), "similarity")
    )
    best = both.groupBy("first_id").agg(F.min(F.struct("other", "similarity")).alias("n"))
    joined = copies.join(best, "first_id", "left")
    own = F.when(F.col("id") != F.col("first_id"), F.struct(F.col("first_id").alias("other"), F.lit(1.0).alias("similarity")))
    near = F.when(F.col("n.other") < F.col("id"), F.col("n"))
    picked = joined.select("id", F.least(own, near).alias("p")).filter("p is not null")
    return picked.select(F.col("id").alias("row_id"), F.col("p.other").alias("first_id"), F.col("p.similarity"))


def duplicate_groups(copies: DataFrame, edges: DataFrame) -> DataFrame:
    """``(row_id, duplicate_group_id)``: transitive groups named by their smallest row; a lone row is its own group."""
    comps = connected_components(edges, src="a", dst="b")
    return copies.join(comps, F.col("first_id") == F.col("node"), "left").select(
        F.col("id").alias("row_id"), F.coalesce("component", "first_id").alias("duplicate_group_id")
    )


# --------------------------------------------------------------------------- without all pairs


@dataclass
class Linked:
    """Exact copies, texts with their signatures, members of shared buckets, and the groups ``(node, component)``."""

    copies: DataFrame
    docs: DataFrame
    members: DataFrame
    groups: DataFrame
    threshold: float
    n: int
    hashes: int
    block: int


def linked_texts(
    df: DataFrame,
    *,
    text_col: str = "text_clean",
    id_col: str = "row_id",
    threshold: float = THRESHOLD,
    n: int = NGRAM,
    hashes: int = CANDIDATE_HASHES,
    seed: int = SEED,
    band_rows: int = BAND_ROWS,
    block: int = BLOCK,
    pivots: int = 3,
) -> Linked:
    """Groups of near-duplicates without the pairs inside them.

    Every text is verified against a few pivots of its buckets first; n near copies of one text are a group after
    that, with at most ``pivots`` comparisons each.  What then shares a bucket but is in different groups is compared in full, in
    blocks, and what is found joins the groups.  So two texts that share a bucket are linked by a path if they are
    similar, as they are when all pairs are verified; misses are those of ``near_duplicate_edges``.
    """
    _, docs, copies = _signed(df, text_col, id_col, n, hashes, seed, band_rows)
    each = docs.select("id", F.posexplode("bands").alias("band", "key"))
    shared = each.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1").select("band", "key")
    members = cut(each.join(shared, ["band", "key"]), "members")
    alone = members.select(F.col("id").alias("node")).distinct().withColumn("component", F.col("node"))
    out = Linked(copies, docs, members, alone, threshold, n, hashes, block)
    pairs = cut(_stars(out, pivots), "stars")
    links, seen = cut_measured(_verified(_alike(pairs, out), docs, threshold, n), "links", n=F.count(F.lit(1)))
    if seen["n"]:
        out.groups = _regrouped(alone, links)
    rest = _verified(_between_groups(out), docs, threshold, n)
    rest, seen = cut_measured(rest, "links", n=F.count(F.lit(1)))
    if seen["n"]:
        out.groups = _regrouped(alone, links.unionAll(rest))
    return out


def _regrouped(alone: DataFrame, links: DataFrame) -> DataFrame:
    comps = connected_components(links, src="a", dst="b").withColumnRenamed("component", "found")
    return cut(alone.join(comps, "node", "left").select("node", F.coalesce("found", "component").alias("component")), "groups")


def _grouped_members(linked: Linked) -> DataFrame:
    return linked.members.join(linked.groups.withColumnRenamed("node", "id"), "id")


def _stars(linked: Linked, pivots: int) -> DataFrame:
    """Up to ``pivots`` pairs for every text: with the first pivots of its buckets.

    Pivots are first by a hash of their ids that is the same in every ``pivots``-th band, so near copies have the same
    few in all of their buckets.
    """
    kind = F.pmod("band", F.lit(pivots)).alias("kind")
    rows = linked.members.select("band", "key", "id", kind)
    order = F.struct(F.xxhash64("id", "kind").alias("h"), "id")
    first = rows.groupBy("band", "key").agg(F.min(order).alias("pivot"))
    best = rows.join(first, ["band", "key"]).groupBy("id", "kind").agg(F.min("pivot").alias("pivot"))
    return (
        best.select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).filter("a <> b").distinct()
    )


def _least_matches(threshold: float, hashes: int) -> float:
    """Equal signature values of all but one in ten million pairs at the threshold."""
    return hashes * max(0.0, threshold - 5.4 * (threshold * (1 - threshold) / hashes) ** 0.5)


def _alike(pairs: DataFrame, linked: Linked) -> DataFrame:
    """The pairs whose sizes and signatures fit the threshold."""
    least = _least_matches(linked.threshold, linked.hashes)

    @F.pandas_udf("boolean")
    def matches(x: pd.Series, y: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
        return pd.Series((one == two).sum(axis=1) >= least) if len(x) else pd.Series([], dtype=bool)

    side = lambda s: linked.docs.select(F.col("id").alias(s), F.col("sig").alias(f"s{s}"), F.col("n_grams").alias(f"n{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_size_fits("na", "nb", linked.threshold))
    return both.filter(matches("sa", "sb")).select("a", "b")


def _between_groups(linked: Linked) -> DataFrame:
    """All pairs of texts that share a bucket, fit by signature and are in different groups.

    In a bucket only texts outside its largest group are compared with the others, so one that is a single group
    is not looked at, however many it holds.
    """
    rows = _grouped_members(linked)
    counts = rows.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("band", "key").agg(
        F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("m"), F.count("*").alias("groups")
    )
    mixed = cut(largest.filter("groups > 1").select("band", "key", "m", F.col("most.component").alias("main"), F.col("most.n").alias("inside")), "mixed")
    placed = rows.join(mixed, ["band", "key"])
    asking = F.col("component") != F.col("main")
    return _compared_in_blocks(placed, asking, F.col("m") - F.col("inside"), linked, lambda x, y: x["component"] != y["component"])


def _compared_in_blocks(placed: DataFrame, asking: Column, n_asking: Column, linked: Linked, wanted) -> DataFrame:
    """Pairs of an ``asking`` text and another of its bucket that fit by size and signature, where ``wanted`` holds.

    ``placed`` has bucket, id, component and the bucket's size ``m``.  Cells of two blocks are one task's work at a time.
    """
    x_blocks, y_blocks = (F.ceil(c / linked.block).cast("int") for c in (n_asking, F.col("m")))
    own = lambda blocks: F.pmod(F.xxhash64("id"), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    keep = ("band", "key", "id", "component")
    asked = placed.filter(asking).select(*keep, own(x_blocks).alias("x"), every(y_blocks).alias("y"), F.lit(0).alias("side"))
    others = placed.select(*keep, every(x_blocks).alias("x"), own(y_blocks).alias("y"), F.lit(1).alias("side"))
    cells = asked.unionByName(others).join(linked.docs.select("id", "n_grams", "sig"), "id")
    order = ["band", "key", "x", "y"]
    rows = cells.select(*order, "side", "id", "component", "n_grams", "sig").repartition(*order).sortWithinPartitions(*order, "side", "id")
    least, threshold, hashes = _least_matches(linked.threshold, linked.hashes), linked.threshold, linked.hashes

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(held: list[tuple]) -> pa.RecordBatch:
            side, ids, comps, sizes, sigs = zip(*held)
            split = sum(s == 0 for s in side)
            ids, comps, sizes = np.array(ids, np.int64), np.array(comps, np.int64), np.array(sizes, np.float64)
            sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), hashes)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            second = {"id": ids[split:], "component": comps[split:]}
            for i in range(split):
                fits = np.minimum(sizes[split:], sizes[i]) >= threshold * np.maximum(sizes[split:], sizes[i]) - SLACK
                fits &= wanted({"id": ids[i], "component": comps[i]}, second)
                at = np.nonzero(fits)[0] + split
                at = at[(sig[at] == sig[i]).sum(axis=1) >= least]
                a.append(np.minimum(ids[at], ids[i]))
                b.append(np.maximum(ids[at], ids[i]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] != now:
                    if held and held[0][0] == 0:
                        yield compared(held)
                    now, held = row[:4], []
                held.append(row[4:])
        if held and held[0][0] == 0:
            yield compared(held)

    return cut(rows.mapInArrow(alike, "a bigint, b bigint").distinct(), "pairs")


def group_table(linked: Linked) -> DataFrame:
    """``(row_id, duplicate_group_id)``: transitive groups named by their smallest row; a lone row is its own group."""
    return linked.copies.join(linked.groups, F.col("first_id") == F.col("node"), "left").select(
        F.col("id").alias("row_id"), F.coalesce("component", "first_id").alias("duplicate_group_id")
    )


def first_links(linked: Linked, *, pivot_rounds: int = 4) -> DataFrame:
    """``(a, b, similarity)``: for each text ``b`` that has one, its smallest earlier near-duplicate ``a``.

    A near-duplicate is in the same group.  So the smallest of the group is tried first, for all of them; then, for
    those it does not resemble, the second, and so on for a few rounds.  Texts still without are compared with the
    earlier ones of their buckets, in blocks.
    """
    groups = linked.groups.join(linked.groups.filter("node <> component").select("component").distinct(), "component", "left_semi")
    open_, found = groups.filter("node <> component"), None
    pivots = groups.groupBy("component").agg(F.min("node").alias("pivot"))
    count = F.count(F.lit(1))
    for _ in range(pivot_rounds):
        pivots = cut(pivots, "pivots")
        asked = cut(open_.join(pivots, "component").filter("node > pivot"), "asked")
        pairs = asked.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        hits = cut(_verified(_alike(pairs, linked), linked.docs, linked.threshold, linked.n), "first")
        found = hits if found is None else found.unionAll(hits)
        open_, seen = cut_measured(asked.join(hits.select(F.col("b").alias("node")), "node", "left_anti").select("node", "component"), "open", n=count)
        if not seen["n"]:
            return found
        after = groups.join(pivots, "component").filter("node > pivot")
        pivots = after.groupBy("component").agg(F.min("node").alias("pivot"))
    # All up to the last pivot have been tried.
    asking = open_.join(pivots, "component").filter("node > pivot").select(F.col("node").alias("id"), "pivot")
    rows = _grouped_members(linked).join(asking, "id", "left")
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("m"), F.count("pivot").alias("n_asking")).filter("n_asking > 0")
    placed = rows.join(cut(sizes, "sizes"), ["band", "key"])
    earlier = lambda x, y: (y["component"] == x["component"]) & (y["id"] < x["id"])
    pairs = _compared_in_blocks(placed, F.col("pivot").isNotNull(), F.col("n_asking"), linked, earlier)
    rest = _verified(pairs, linked.docs, linked.threshold, linked.n)
    best = rest.groupBy("b").agg(F.min(F.struct("a", "similarity")).alias("x")).select("x.a", "b", "x.similarity")
    return found.unionAll(cut(best, "first"))


def first_near_duplicates(df: DataFrame, **options) -> DataFrame:
    """``(row_id, first_id, similarity)``: for each row that has one, its smallest earlier near-duplicate."""
    linked = linked_texts(df, **options)
    return first_near_duplicate(linked.copies, first_links(linked))


def assign_duplicate_groups(df: DataFrame, **options) -> DataFrame:
    return group_table(linked_texts(df, **options))
