"""CSV whose quoted cells hold line breaks, one file read by many tasks.

Where a quoted cell may hold a line break, a task that starts inside a file cannot know whether its first line
starts a record.  The number of quotes before it tells: outside of quoted cells it is even, as a quote inside
a cell is doubled.  So lines are read twice, in the ranges Spark splits files into:

1. the quotes of each range are counted, and summed over the ranges before it: one row for each range;
2. each range joins its lines to records; what begins in one range and ends in a later one comes out as at most
   two pieces a range, and only these are brought together.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.sources.shared import cut_measured

#: Ranges whose state is handed to every task; of more, lines are shuffled to their range.
MOST_RANGES = 100_000

# A whole record, or the piece of one that ends a range, begins one, or fills one.
WHOLE, OPENS, CLOSES, INSIDE = range(4)


def read_csv(spark: SparkSession, path: str, *, most_ranges: int | None = None) -> DataFrame:
    """All columns as strings, named by the header that each file has as its first line.

    Quotes are ``"``, doubled inside a quoted cell, and do not occur in unquoted ones.  Lines end in ``\\n`` or
    ``\\r\\n``; line breaks inside cells are kept as they are.  Blank lines are left out, missing cells are null, and
    a record whose last quote is missing ends with its file.
    """
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    records = _records(spark, path, MOST_RANGES if most_ranges is None else most_ranges)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    cells = F.from_csv("record", F.lit(schema), {"escape": '"', "maxCharsPerColumn": "-1"})
    return records.select(cells.alias("c")).select("c.*")


def _records(spark: SparkSession, path: str, most_ranges: int) -> DataFrame:
    """``(record)``: every record but the headers."""
    text = spark.read.option("lineSep", "\n").text(path)
    place = {"path": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start")}
    lines = text.select("value", *[c.alias(name) for name, c in place.items()], F.monotonically_increasing_id().alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state, seen = cut_measured(
        lines.groupBy("path", "start")
        .agg(F.sum(quotes).alias("quotes"))
        .select("path", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int").alias("open")),
        "ranges",
        n=F.count(F.lit(1)),
    )
    # A broadcast join leaves lines in the order they are read in.
    if seen["n"] <= most_ranges:
        known = lines.join(F.broadcast(state), ["path", "start"])
    else:
        known = lines.join(state, ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "at")
    pieces, seen = cut_measured(
        known.select("path", "start", "open", "value").mapInArrow(_join_lines, "path string, start bigint, kind int, record string"),
        "records",
        n=F.count_if(F.col("kind") != WHOLE),
    )
    whole = pieces.filter(F.col("kind") == WHOLE).select("record")
    if not seen["n"]:
        return whole
    # At most two pieces a range; the one that closes a record comes before the one that opens the next.
    order = [F.col("start"), -F.col("kind")]
    run = Window.partitionBy("path").orderBy(*order)
    parts = pieces.filter(F.col("kind") != WHOLE).withColumn("nth", F.count_if(F.col("kind") == OPENS).over(run))
    in_order = F.array_sort(F.collect_list(F.struct("start", (-F.col("kind")).alias("kind"), "record")))
    joined = parts.groupBy("path", "nth").agg(F.array_join(F.transform(in_order, lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(joined.select(F.regexp_replace("record", "\r$", "").alias("record")))


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of each range, whose lines come one after the other."""

    def rows():
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def found():
        for (path, start), lines in itertools.groupby(rows(), key=lambda row: row[:2]):
            held: list[str] = []
            cut_off = inside = None
            header = start == 0
            for _, _, opened, line in lines:
                if inside is None:
                    cut_off = inside = bool(opened)
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if inside:
                    continue
                record, held = "\n".join(held), []
                if cut_off:
                    yield path, start, CLOSES, record
                elif header:
                    header = False
                elif record.strip("\r"):
                    yield path, start, WHOLE, record.removesuffix("\r")
                cut_off = False
            if held:
                yield path, start, INSIDE if cut_off else OPENS, "\n".join(held)

    out = found()
    # One record may be long, so a batch is a few of them.
    while some := list(itertools.islice(out, 256)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.int64(), pa.int32(), pa.string()))],
            ["path", "start", "kind", "record"],
        )
