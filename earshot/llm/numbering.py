"""Places within groups, without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.sources.shared import cut


def group_key(column: Column) -> Column:
    """A group's value as text that is never null and sorts like it: null first, then by UTF-8 bytes."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def numbered(df: DataFrame, key: str, order: list[Column], name: str = "pos") -> DataFrame:
    """``df``, written, with every row's place (from 0) within its ``key`` in the given order.

    Rows are range-partitioned by key and order, so a key that holds a third of all rows is dealt over many
    tasks.  A place is the one inside the partition plus the rows of the key in the partitions before it;
    those counts have one row per key and partition.  Ties in ``order`` must be between rows that are alike.
    """
    placed = cut(
        df.repartitionByRange(F.col(key), *order)
        .sortWithinPartitions(F.col(key), *order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "places",
    )
    part = F.shiftright("_place", 33)
    runs = placed.groupBy(F.col(key), part.alias("_part")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # Written first, so that the join below knows their size when it is planned.
    shift = cut(runs.select(key, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "runs")
    return (
        placed.withColumn("_part", part)
        .join(shift, [key, "_part"])
        .withColumn(name, F.col("_place") + F.col("_shift"))
        .drop("_part", "_place", "_shift")
    )
