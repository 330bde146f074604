"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

The documents of a source are dealt to shards by a seeded hash; in a shard they lie end to end in seeded
order, cut into blocks of ``block_words`` words.  Sainte-Lague gives each source, and then each of its
shards, a whole number of blocks by highest quotients.  A shard with n blocks and a quota of q takes block
j as often as floor(((j+1) q + o) / n) - floor((j q + o) / n), with a seeded start o: exactly q blocks,
spread evenly, each at most once more than any other.  That is a closed form, so a document only needs its
place in its shard, and no block is ever a row.

Only sums per source and shard reach the driver; a source has at most ``max_shards`` shards.

Defined results: a null text has size 0; the null source is a source of its own, last in order; rows that
repeat are documents of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.common import encoded, word_counts
from earshot.sources.shared import cut

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_SOURCES = 1_000_000
SEED = 17


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Split ``share`` of all sizes by weight; what is above ``most`` times a size is shared anew by weight."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            open_.remove(i)
        left -= sum(out[i] for i in over)
    return out


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Whole seats by the highest quotients weight / (2 s + 1), none above its ``most``.

    Starts from the rounded shares and then gives or takes single seats at the margin, which ends at the
    same seats as giving them one by one; equal quotients go to the earlier party.
    """
    seats = min(seats, sum(m for w, m in zip(weights, most) if w > 0))
    total = sum(weights)
    if not seats or not total:
        return [0] * len(weights)
    out = [min(m, int(w * seats / total + 0.5)) for w, m in zip(weights, most)]
    have = sum(out)
    if have < seats:
        heap = [(-w / (2 * s + 1), i) for i, (w, s) in enumerate(zip(weights, out)) if w > 0 and s < most[i]]
        heapq.heapify(heap)
        while have < seats:
            _, i = heapq.heappop(heap)
            out[i] += 1
            have += 1
            if out[i] < most[i]:
                heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    heap = [(w / (2 * s - 1), -i) for i, (w, s) in enumerate(zip(weights, out)) if s]
    heapq.heapify(heap)
    while have > seats:
        _, i = heapq.heappop(heap)
        out[-i] -= 1
        have -= 1
        if out[-i]:
            heapq.heappush(heap, (weights[-i] / (2 * out[-i] - 1), i))
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rest = batch.column(0), [batch.column(i) for i in range(1, batch.num_columns)]
        n = word_counts(texts)
        yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64())], [*batch.schema.names[1:], "size"])


def mix_quotas(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 16,
    shard_words: int = 20_000,
    max_shards: int = 4096,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken`` and its place in the mix.

    The further columns ``shard, blocks, quota, offset, first`` tell which blocks are taken.
    """
    spark = docs.sparkSession
    text, source = F.col(text_col), F.col(source_col)
    mark = F.xxhash64(F.lit(seed), F.col(id_col), text)
    narrow = docs.select(
        text.alias("text"), F.col(id_col).alias("doc_id"), source.alias("source"), mark.alias("mark")
    )
    kind = dict(narrow.dtypes)
    out = f"doc_id {kind['doc_id']}, source {kind['source']}, mark bigint, size bigint"
    sized = cut(narrow.mapInArrow(_sizes, out), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in sums]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], share, most)
    shards = [min(max_shards, 1 + n // shard_words) for n in sizes]
    at = {r["source"]: i for i, r in enumerate(sums)}

    of = spark.createDataFrame(
        [(r["source"], i, r["size"], goal[i], shards[i]) for i, r in enumerate(sums)],
        f"_source {kind['source']}, _at int, source_size bigint, target double, _shards int",
    )
    placed = sized.join(of, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "shard", F.pmod(F.xxhash64("mark"), F.col("_shards")).cast("int")
    )
    parts = placed.groupBy("_at", "shard").agg(F.sum("size").alias("size")).collect()
    parts.sort(key=lambda r: (r["_at"], r["shard"]))
    blocks = [-(-r["size"] // block_words) for r in parts]
    caps = [0] * len(sums)
    own: dict[int, list[int]] = {i: [] for i in at.values()}
    for j, r in enumerate(parts):
        caps[r["_at"]] += int(most * blocks[j])
        own[r["_at"]].append(j)
    seats = sainte_lague(goal, round(sum(goal) / block_words), caps)
    # A source of less than one block is counted in blocks of its own size, so that it does not vanish.
    for i, n in enumerate(sizes):
        if 0 < n < block_words:
            seats[i] = min(caps[i], max(1, round(goal[i] / n)))
    quota = [0] * len(parts)
    for i, members in own.items():
        given = sainte_lague([parts[j]["size"] for j in members], seats[i], [int(most * blocks[j]) for j in members])
        for j, n in zip(members, given):
            quota[j] = n
    plan = spark.createDataFrame(
        [(r["_at"], r["shard"], n, q) for r, n, q in zip(parts, blocks, quota)],
        "_at int, shard int, blocks bigint, quota bigint",
    )
    ends = Window.partitionBy("_at", "shard").orderBy("mark", "doc_id")
    rows = placed.withColumn(
        "first", F.sum("size").over(ends.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    ).join(plan, ["_at", "shard"])
    start = F.pmod(F.xxhash64(F.lit(seed), "_at", "shard"), F.greatest("blocks", F.lit(1)))
    rows = rows.withColumn("offset", start)
    taken = _words_before(F.col("first") + F.col("size"), block_words) - _words_before(F.col("first"), block_words)
    return rows.select(
        "doc_id", "source", "mark", "size", "source_size", "target",
        F.coalesce(taken, F.lit(0)).cast("bigint").alias("taken"),
        "shard", "blocks", "quota", "offset", "first",
    )


def _words_before(x: Column, block_words: int) -> Column:
    """Words taken from the first ``x`` words of a shard, repeats counted."""
    n = F.when(F.col("blocks") > 0, F.col("blocks"))
    block = F.call_function("div", x, F.lit(block_words))

    def blocks_before(j: Column) -> Column:
        return F.call_function("div", j * F.col("quota") + F.col("offset"), n)

    done = blocks_before(block)
    return done * block_words + (x - block * block_words) * (blocks_before(block + 1) - done)


def times_taken(words: int, first: int, blocks: int, quota: int, offset: int, block_words: int) -> np.ndarray:
    """How often each word of a document is taken."""
    block = (first + np.arange(words, dtype=np.int64)) // block_words
    return ((block + 1) * quota + offset) // blocks - (block * quota + offset) // blocks


def mix(docs: DataFrame, *, block_words: int = 16, length_col: str = "n_chars", **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``.

    The words taken once or more form a row, those taken twice or more another one, and so on.  A row
    that takes the whole document keeps its text as it is; else the taken stretches are joined by one
    space.  ``length_col``, if there is one, is set anew.  Rows that take no word are left out, except
    that documents without words stay.
    """
    facts = ("size", "taken", "blocks", "quota", "offset", "first")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    plan = mix_quotas(docs, block_words=block_words, **options)
    # Rows that are alike in id and text are told apart by a running number on either side.
    alike = Window.partitionBy("doc_id", "mark").orderBy("first")
    plan = plan.select(
        F.col("doc_id").alias("_mix_id"),
        F.col("mark").alias("_mix_mark"),
        F.row_number().over(alike).alias("_mix_nth"),
        *[F.col(f).alias(f"_mix_{f}") for f in facts],
    )
    mark = F.xxhash64(F.lit(options.get("seed", SEED)), F.col(id_col), F.col(text_col))
    same = Window.partitionBy(id_col, "_mix_own").orderBy(F.xxhash64(*docs.columns))
    left = docs.withColumn("_mix_own", mark).withColumn("_mix_own_nth", F.row_number().over(same))
    joined = left.join(
        plan,
        F.col(id_col).eqNullSafe(F.col("_mix_id"))
        & (F.col("_mix_own") == F.col("_mix_mark"))
        & (F.col("_mix_own_nth") == F.col("_mix_nth")),
    )
    names = list(docs.columns)
    schema = docs.schema

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            texts: list[str | None] = []
            texts_in = batch.column(names.index(text_col)).to_pylist()
            given = [batch.column(len(names) + i).to_pylist() for i in range(len(facts))]
            for i, text in enumerate(texts_in):
                size, taken, blocks, quota, offset, first = (g[i] for g in given)
                if not size:
                    rows.append(i)
                    texts.append(text)
                    continue
                if not taken:
                    continue
                times = times_taken(size, first, blocks, quota, offset, block_words)
                for n in range(1, int(times.max()) + 1):
                    keep = times >= n
                    rows.append(i)
                    texts.append(text if keep.all() else _kept(text, keep))
            out = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(len(names))]
            out[names.index(text_col)] = pa.array(texts, pa.string())
            if length_col in names:
                out[names.index(length_col)] = pa.array(
                    [None if t is None else len(t) for t in texts], pa.int64()
                ).cast(out[names.index(length_col)].type)
            yield pa.RecordBatch.from_arrays(out, names)

    return joined.select(*names, *[f"_mix_{f}" for f in facts]).mapInArrow(build, schema)


def _kept(text: str, keep: np.ndarray) -> str:
    words = encoded(text).split()
    return b" ".join(w for w, k in zip(words, keep) if k).decode("utf-8", "surrogatepass")
