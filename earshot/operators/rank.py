"""Global ranks, equal-frequency buckets, value ranks, paging and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions import lexicons as lx
from earshot.functions import scoring, text as tx
from earshot.sources.shared import cut


def global_rank(df: DataFrame, order: Sequence[str], *, name: str = "rank") -> DataFrame:
    """Number rows 1..n in the given order without bringing them to one task.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the sizes
    of the partitions before it.  End ``order`` with a unique column: it makes the result definite and
    lets a value shared by very many rows spread over partitions.
    """
    index = F.monotonically_increasing_id()
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", index),
        "rank",
    )
    # An id is (partition << 33) + position in it.
    part, position = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # One row per partition, so an unpartitioned window is fine here.
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + position + 1).cast("bigint"))
        .drop("_part", "_place", "_before")
    )


def choose_time_column(columns: Sequence[str], candidates: Sequence[str] = lx.TIME_COLUMNS) -> str | None:
    """First candidate present in ``columns``, ignoring case; of equal names the last one counts."""
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c] for c in candidates if c in by_lower), None)


def as_utc_time(df: DataFrame, column: str) -> Column:
    """TIMESTAMP value of a column of any type; what does not parse is NULL."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp":
        return F.col(column)
    if kind in ("timestamp_ntz", "date"):
        return F.col(column).cast("timestamp")
    return F.try_to_timestamp(F.col(column).cast("string"))


def time_parse_coverage(df: DataFrame, column: str, *, min_rows: int = 100, min_share: float = 0.6) -> DataFrame:
    """One row: rows, parsed rows, and whether the column is usable as a time axis."""
    parsed = as_utc_time(df, column)
    needed = F.greatest(F.lit(min_rows), F.floor(F.count("*") * min_share))
    return df.agg(
        F.count("*").alias("rows"), F.count(parsed).alias("parsed"), (F.count(parsed) >= needed).alias("usable")
    )


def order_key(
    df: DataFrame, *, id_col: str = "row_id", min_rows: int = 100, min_share: float = 0.6
) -> tuple[Column, int]:
    """The column rows are bucketed by (event time when usable, else the row id) and its non-null count.

    Time is usable when at least ``min_rows`` rows and ``min_share`` of all have one.
    """
    name = choose_time_column(df.columns)
    if name is not None:
        found = time_parse_coverage(df, name, min_rows=min_rows, min_share=min_share).first()
        if found["usable"]:
            return as_utc_time(df, name), found["parsed"]
        return F.col(id_col), found["rows"]
    return F.col(id_col), df.count()


def time_bucket(
    df: DataFrame, *, n_buckets: int = 8, id_col: str = "row_id", min_rows: int = 100, min_share: float = 0.6
) -> Column:
    """Equal-frequency bucket 0..n-1 of every row, as an expression over ``df``'s columns.

    Row r of n (by time, then id) is in bucket ``ceil((r-1)*q/(n-1)) - 1``, at least 0; rows without a
    time have no bucket.  Only the q-1 rows that open a bucket are looked up, through a rank over the
    two key columns; rows themselves are then bucketed where they lie, without a shuffle or a join.
    """
    key, n = order_key(df, id_col=id_col, min_rows=min_rows, min_share=min_share)
    first_rank = [b * (n - 1) // n_buckets + 2 for b in range(1, n_buckets)]
    wanted = sorted({r for r in first_rank if r <= n})
    bucket = F.lit(0)
    if wanted:
        keys = df.select(key.alias("k"), F.col(id_col).alias("i")).filter("k is not null")
        ranked = global_rank(keys, ["k", "i"])
        kind, row_id = dict(ranked.dtypes)["k"], F.col(id_col)
        # At most n_buckets - 1 rows.
        edges = {r["rank"]: r for r in ranked.filter(F.col("rank").isin(wanted)).collect()}
        for at in (edges[r] for r in first_rank if r <= n):
            opening = F.lit(at["k"]).cast(kind)
            later = (key > opening) | ((key == opening) & (row_id >= F.lit(at["i"])))
            bucket = bucket + later.cast("int")
    return F.when(key.isNotNull(), bucket)


def value_ranks(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rank wanted ``(level, value)`` rows among all values of their level, most frequent first.

    ``counts`` is ``(level, value, n, n_scoped)``.  A value seen in the scope is ranked by scoped counts
    among scoped values, otherwise by all counts; a value not seen at all gets rank 0.  Ties rank by
    value.  ``wanted`` is a short parameter list (see ``explore.pins_frame``).
    """
    own = counts.select("level", "value", F.col("n").alias("own_n"), F.col("n_scoped").alias("own_scoped"))
    target = wanted.join(own, ["level", "value"], "left").select(
        "level", F.col("value").alias("target"), "own_n", "own_scoped"
    )
    scoped = F.coalesce(F.col("own_scoped"), F.lit(0)) > 0
    count = F.when(scoped, F.col("n_scoped")).otherwise(F.col("n"))
    own_count = F.when(scoped, F.col("own_scoped")).otherwise(F.col("own_n"))
    ahead = (count > own_count) | ((count == own_count) & (F.col("value") < F.col("target")))
    return (
        counts.join(F.broadcast(target), "level")
        .filter(count > 0)
        .groupBy("level", "target")
        .agg(
            F.when(F.max("own_n").isNull(), 0).otherwise(1 + F.count_if(ahead)).cast("bigint").alias("rank"),
            F.count("*").alias("total"),
        )
        .withColumnRenamed("target", "value")
    )


def feed_page(records: DataFrame, *, page: int = 0, size: int = 20) -> DataFrame:
    """Rows of one page of the feed: worst first, then by id, with the running number.

    The cost grows with the page number; ``feed_page_after`` is the way to read on.
    """
    pain = scoring.pain_score(F.col("severity"), F.col("sentiment"))
    rows = (
        records.select("record_id", pain.alias("pain"), "severity", "sentiment", "child_issue", "topic", "original_feedback")
        .orderBy(F.desc("pain"), "record_id")
        .offset(page * size)
        .limit(size)
    )
    # At most one page of rows is left, so an unpartitioned window is fine here.
    number = F.row_number().over(Window.orderBy(F.desc("pain"), "record_id")) + page * size
    return rows.select(
        number.alias("number"),
        "record_id",
        "pain",
        "severity",
        "sentiment",
        tx.clip_text(F.coalesce("child_issue", "topic"), 38).alias("chip"),
        tx.clip_text(F.col("original_feedback"), 280).alias("comment"),
    )


def feed_page_after(records: DataFrame, *, pain: int, record_id: int, size: int = 20) -> DataFrame:
    """The page after a given last row; costs the same however deep it lies."""
    score = scoring.pain_score(F.col("severity"), F.col("sentiment"))
    beyond = (score < pain) | ((score == pain) & (F.col("record_id") > record_id))
    return (
        records.filter(beyond)
        .select("record_id", score.alias("pain"), "severity", "sentiment", "original_feedback")
        .orderBy(F.desc("pain"), "record_id")
        .limit(size)
    )


def sample_comments(
    records: DataFrame, *, k: int = 3, seed: int = 42, text_col: str = "original_feedback", id_col: str = "record_id"
) -> DataFrame:
    """``k`` distinct sample texts: of middle length in a seeded order if there are enough, else the first ones."""
    t = tx.collapse(F.coalesce(F.col(text_col), F.lit("")))
    rows = tx.once(records.select(F.col(text_col), F.col(id_col).alias("id")), "text", t).select("id", "text")
    size = F.length("text")
    rows = rows.filter(size > 0)
    mid = (size >= 20) & (size <= 240)
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("text")))
    # Short texts only are grouped by; of the others the k that come first by id are enough.
    short = rows.filter(mid).groupBy("text").agg(F.min("id").alias("first_id")).orderBy(order, "first_id").limit(k)
    first = _first_texts(rows, k)
    both = short.select("first_id", "text", F.lit(1).alias("way")).unionAll(first.select("first_id", "text", F.lit(2).alias("way")))
    # At most 2 k rows.
    few = both.withColumn("n", F.count_if(F.col("way") == 1).over(Window.partitionBy(F.lit(0))))
    return few.filter(F.col("way") == F.when(F.col("n") >= k, 1).otherwise(2)).select("first_id", "text")


def _first_texts(rows: DataFrame, k: int) -> DataFrame:
    """The k different texts that come first by id; digests stand for the texts until they are chosen."""
    firsts = rows.groupBy(F.md5("text").alias("digest")).agg(F.min("id").alias("first_id"))
    chosen = firsts.orderBy("first_id").limit(k).select("first_id")
    return rows.join(F.broadcast(chosen), F.col("id") == F.col("first_id")).select("first_id", "text")


def sample_ids(df: DataFrame, *, n: int, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """``n`` ids without replacement, in a seeded order that any engine can reproduce."""
    return df.select(id_col).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))), id_col).limit(n)
