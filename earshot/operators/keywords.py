"""Keyword search over an index of three-letter pieces, written once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from earshot.functions import text as tx
from earshot.operators import filters
from earshot.sources.shared import cut

GRAM = 3
PAGE_ROWS = 64
#: The numbers of all blocks are broadcast in a search: at most 4 MB.
MOST_BLOCKS = 1_000_000


@dataclass(frozen=True)
class KeywordIndex:
    """Records in blocks, each a folder of its own that can be read alone, and postings of the grams in them."""

    path: str
    schema: StructType
    fields: tuple[str, ...]

    def records(self, spark: SparkSession) -> DataFrame:
        """The records with ``_block`` and ``_page``."""
        placed = StructType(list(self.schema)).add("_page", LongType()).add("_block", IntegerType())
        return spark.read.schema(placed).parquet(f"{self.path}/records")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("gram string, block int, pages array<bigint>").parquet(f"{self.path}/postings")


def build_index(
    records: DataFrame,
    path: str,
    *,
    blocks: int,
    order_by: Sequence[str],
    fields: Sequence[str] = filters.SEARCH_FIELDS,
    page_rows: int = PAGE_ROWS,
) -> KeywordIndex:
    """Write ``records`` in ``blocks`` ranges of ``order_by`` and, for every gram, the pages of each block that hold it.

    Order by columns that go with what is searched for, and equal words share blocks.  One shuffle places the
    records; grams come from the written records, distinct per record before they are combined per block, so a word
    in every record is one posting a block.  A page is ``page_rows`` records: grams of a keyword must meet in a page,
    else the block is not read.
    """
    if not 0 < blocks <= MOST_BLOCKS:
        raise ValueError(f"blocks must be 1 to {MOST_BLOCKS}, not {blocks}")
    spark = records.sparkSession
    # The ranges are sampled first: that reads written records, whose columns may be costly.
    placed = cut(records, "records").repartitionByRange(blocks, *order_by).sortWithinPartitions(*order_by)
    # The lower 33 bits number the rows of a partition, the upper ones the partition.
    number = F.monotonically_increasing_id()
    numbered = placed.withColumn("_number", number).select(
        "*", F.floor(F.col("_number").bitwiseAND((1 << 33) - 1) / page_rows).alias("_page"), F.shiftright("_number", 33).cast("int").alias("_block")
    )
    numbered.drop("_number").write.partitionBy("_block").parquet(f"{path}/records")
    index = KeywordIndex(path, records.schema, tuple(fields))
    parts = [tx.char_ngrams(F.lower(F.coalesce(F.col(f), F.lit(""))), GRAM) for f in fields]
    grams = index.records(spark).select("_block", "_page", F.explode(F.array_distinct(F.concat(*parts))).alias("gram"))
    pages = grams.filter(F.length("gram") == GRAM).groupBy("gram", F.col("_block").alias("block")).agg(
        F.array_sort(F.collect_set("_page")).alias("pages")
    )
    # Sorted by gram, so that a search reads the few row groups its grams lie in.
    pages = cut(pages, "pages")
    pages.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{path}/postings")
    return index


def candidates(spark: SparkSession, index: KeywordIndex, keyword: str) -> DataFrame | None:
    """The blocks ``(_block)`` with a page that holds all grams of a keyword; None if it is shorter than a gram."""
    low = keyword.strip().lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)} - {g for g in _outside(low)})
    if not wanted:
        return None
    found = index.postings(spark).filter(F.col("gram").isin(wanted)).groupBy("block").agg(F.collect_list("pages").alias("lists"))
    shared = F.aggregate("lists", F.col("lists")[0], lambda x, y: F.array_intersect(x, y))
    return found.filter((F.size("lists") == len(wanted)) & (F.size(shared) > 0)).select(F.col("block").alias("_block"))


def _outside(low: str) -> list[str]:
    """Grams with characters beyond 16 bits or unpaired surrogates, which are not asked for."""
    return [low[i : i + GRAM] for i in range(len(low) - GRAM + 1) if any(ord(c) > 0xFFFF or 0xD800 <= ord(c) < 0xE000 for c in low[i : i + GRAM])]


def search(spark: SparkSession, index: KeywordIndex, spec: filters.FilterSpec) -> DataFrame:
    """The rows that ``filters.apply_filters`` gives for the same records, reading only blocks that can hold the keyword.

    What the postings let through is searched again in full, so results do not depend on the index.  Patterns, empty
    keywords and those shorter than a gram read all records, as do keywords in fields that are not indexed.
    """
    rows = index.records(spark)
    covered = set(filters.SEARCH_FIELDS) <= set(index.fields)
    hits = None if spec.regex or not covered else candidates(spark, index, spec.keyword)
    if hits is not None:
        # The folders of other blocks are pruned while the query runs.
        rows = rows.join(F.broadcast(hits), "_block", "left_semi")
    return filters.apply_filters(rows.select(*index.schema.names), spec)

