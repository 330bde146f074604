"""Scans and sinks for comment exports and classified records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions import lexicons as lx
from earshot.sources import splitcsv

# Header names of the export, in order after the unnamed index column.
EXPORT_COLUMNS = (
    "Topic",
    "Feedback Comment",
    "Contextual_Subtopic",
    "Granular_Subtopic",
    "Severity",
    "Sentiment",
)
# The names operators use for them.
COLUMN_NAMES = {
    "Topic": "topic",
    "Feedback Comment": "comment",
    "Contextual_Subtopic": "contextual_subtopic",
    "Granular_Subtopic": "granular_subtopic",
    "Severity": "severity",
    "Sentiment": "sentiment",
}
DOMAINS = {"severity": lx.VALID_SEVERITY, "sentiment": lx.VALID_SENTIMENT}

RECORD_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "classification",
            "topic",
            "parent_issue",
            "child_issue",
            "sentiment",
            "severity",
            "raw_topic",
            "original_feedback",
        )
    ]
)


class ContractError(ValueError):
    """The export does not follow the agreed schema or value domains."""


def scan_feedback_csv(spark: SparkSession, path: str, *, validate: bool = True, split: bool = False) -> DataFrame:
    """Scan an export: unnamed index column, text columns, blanks kept as ``""``.

    Quoted cells may hold newlines, so one file is one task, unless ``split`` asks for many: see ``splitcsv``.
    Extra columns of the export (a time column, for instance) are kept.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    if split:
        raw = splitcsv.read_csv(spark, path)
    first = raw.columns[0] if raw.columns else None
    if first not in ("_c0", "Unnamed: 0"):
        raise ContractError(f"the first column must be the unnamed row index, found {first!r}")
    missing = [c for c in EXPORT_COLUMNS if c not in raw.columns]
    if missing:
        raise ContractError(f"columns missing from the export: {missing}")
    df = raw.withColumnRenamed(first, "row_id").withColumnsRenamed(COLUMN_NAMES)
    df = df.withColumn("row_id", F.col("row_id").cast("bigint"))
    df = df.fillna("", subset=[c for c in df.columns if c != "row_id"])
    if validate:
        check_contract(df)
    return df


def contract_violations(df: DataFrame, domains: dict[str, tuple[str, ...]] = DOMAINS) -> DataFrame:
    """``(column, value, n_rows)`` for every value outside its domain; empty when the table is clean."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in domains])
    ).alias("pair")
    bad = None
    for name, allowed in domains.items():
        hit = (F.col("column") == name) & (F.col("value").isNull() | ~F.col("value").isin(*allowed))
        bad = hit if bad is None else bad | hit
    return df.select(pairs).select("pair.*").filter(bad).groupBy("column", "value").agg(F.count("*").alias("n_rows"))


def check_contract(df: DataFrame) -> None:
    """Raise listing offending values (the first hundred; the count of kinds is complete)."""
    kinds = contract_violations(df).orderBy("column", "value").limit(101).collect()
    if kinds:
        shown = ", ".join(f"{r['column']}={r['value']!r}" for r in kinds[:100])
        raise ContractError(f"values outside their domain: {shown}{' and more' if len(kinds) > 100 else ''}")


def scan_records_json(spark: SparkSession, path: str, *, array_file: bool = False) -> DataFrame:
    """Scan classified records: JSON lines (splittable), or whole JSON-array files (one task per file)."""
    return spark.read.schema(RECORD_SCHEMA).option("multiLine", array_file).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that ``spark.read`` with ``escape='"'`` and ``multiLine`` reads back unchanged."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
