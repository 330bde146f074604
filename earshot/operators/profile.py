"""Normalisation and profiling of a comment table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import text as tx
from earshot.sources.shared import cut


def normalize_feedback(df: DataFrame, *, text_col: str = "comment", normalise: bool = True, **markers) -> DataFrame:
    """Add ``text_clean`` and ``language`` (judged on the raw text); drop rows blank after cleaning."""
    cleaned = tx.once(df.drop("text_clean"), "text_clean", tx.clean_text(F.col(text_col), normalise=normalise))
    return cleaned.filter(F.length("text_clean") > 0).withColumn(
        "language", tx.detect_language(F.col(text_col), **markers)
    )


def text_lengths(df: DataFrame, *, text_col: str = "comment", id_col: str = "row_id") -> DataFrame:
    t = F.col(text_col)
    return df.select(
        id_col, tx.n_chars(t).alias("chars"), tx.n_words(t).alias("words"), tx.n_lines(t).alias("lines")
    )


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Non-null value counts."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def feedback_summary(df: DataFrame, *, text_col: str = "comment") -> DataFrame:
    """One row: rows, distinct subtopics, blank comments."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_distinct("contextual_subtopic").alias("unique_contextual_subtopic"),
        F.count_distinct("granular_subtopic").alias("unique_granular_subtopic"),
        F.count_if(tx.is_blank(F.col(text_col))).alias("blank_feedback"),
    )


def feedback_frequencies(df: DataFrame, columns: Sequence[str] = ("topic", "severity", "sentiment")) -> DataFrame:
    """``(field, value, count)`` for several columns from one scan."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]))
    return (
        df.select(pair.alias("p"))
        .select("p.*")
        .filter(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count("*").alias("count"))
    )


def fragmentation_stats(
    df: DataFrame, *, granular: str = "granular_subtopic", contextual: str = "contextual_subtopic"
) -> DataFrame:
    """One row describing how many rows each label has, for both label levels."""
    sizes = feedback_frequencies(df, (granular, contextual))
    n, g, c = F.col("count"), F.col("field") == granular, F.col("field") == contextual
    only_g, only_c = F.when(g, n), F.when(c, n)
    return sizes.agg(
        F.count(only_g).alias("n_granular_labels"),
        F.count(only_c).alias("n_contextual_labels"),
        F.avg(only_g).alias("rows_per_granular_mean"),
        F.median(only_g).alias("rows_per_granular_median"),
        F.count_if(g & (n == 1)).alias("granular_singletons"),
        (F.avg((only_g == 1).cast("int")) * 100).alias("granular_singletons_pct"),
        F.count_if(g & (n <= 3)).alias("granular_le_3_rows"),
        (F.avg((only_g <= 3).cast("int")) * 100).alias("granular_le_3_rows_pct"),
        F.avg(only_c).alias("rows_per_contextual_mean"),
        F.median(only_c).alias("rows_per_contextual_median"),
    )


def hierarchy_consistency(
    df: DataFrame, *, child: str = "granular_subtopic", parent: str = "contextual_subtopic"
) -> DataFrame:
    """How many child labels have 1, 2, .. distinct parents."""
    return (
        df.filter(F.col(child).isNotNull())
        .groupBy(child)
        .agg(F.count_distinct(parent).alias("distinct_parents"))
        .groupBy("distinct_parents")
        .agg(F.count("*").alias("granular_count"))
        .filter(F.col("distinct_parents") > 0)
    )


def length_describe(lengths: DataFrame, columns: Sequence[str] = ("chars", "words", "lines")) -> DataFrame:
    """One row per length kind: count, mean, sample deviation, min, p50, p90, p95, p99, max.

    Percentiles interpolate linearly and are exact.  Lengths are small integers, so they are computed
    from value counts: what reaches the final aggregate is one row per distinct length.
    """
    kinds = feedback_frequencies(lengths.select(*[F.col(c).cast("double").alias(c) for c in columns]), columns)
    value, weight = F.col("value"), F.col("count")
    n = F.sum(weight)
    mean = F.sum(value * weight) / n
    spread = F.sum(value * value * weight) - n * mean * mean
    cuts = F.percentile(value, F.array(*[F.lit(p) for p in (0.5, 0.9, 0.95, 0.99)]), weight)
    return (
        kinds.groupBy(F.col("field").alias("kind"))
        .agg(
            n.alias("count"),
            mean.alias("mean"),
            F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).alias("std"),
            F.min(value).alias("min"),
            cuts.alias("cuts"),
            F.max(value).alias("max"),
        )
        .select(
            "kind",
            "count",
            "mean",
            "std",
            "min",
            *[F.element_at("cuts", i + 1).alias(p) for i, p in enumerate(("p50", "p90", "p95", "p99"))],
            "max",
        )
    )


def histogram(df: DataFrame, column: str, *, cap: int, bins: int) -> DataFrame:
    """Equal-width bins between the observed ends of the capped values; empty bins are left out.

    Works on value counts, so the ends and the bins come from one small table, written once: the column, which may be
    costly, is computed once for a row.
    """
    values = tx.once(df, "v", F.least(F.col(column), F.lit(cap)).cast("double")).select("v")
    counts = cut(values.filter(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n")), "values")
    ends = counts.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    lo, hi = F.col("e.lo"), F.col("e.hi")
    raw = F.width_bucket("v", lo, hi, F.lit(bins))
    # All values equal: the reference range is half a unit to either side, so the middle bin takes all.
    bucket = F.when(lo == hi, F.lit(bins // 2 + 1)).otherwise(F.least(raw, F.lit(bins)))
    return (
        counts.withColumn("e", ends)
        .select(bucket.cast("int").alias("bin"), "n")
        .groupBy("bin")
        .agg(F.sum("n").alias("count"))
    )


def label_sizes(df: DataFrame, label: str) -> DataFrame:
    return frequency(df, label).select(F.col("count").alias("size"))


def length_outliers(lengths: DataFrame, *, short: int = 5, long: int = 500) -> DataFrame:
    chars = F.col("chars")
    return lengths.agg(F.count_if(chars < short).alias("very_short"), F.count_if(chars > long).alias("very_long"))


def language_mix(languages: DataFrame, column: str = "language") -> DataFrame:
    """Rows and share per language bucket, with the share that is not English on every row."""
    counts = frequency(languages, column)
    totals = counts.agg(
        F.struct(
            F.sum("count").alias("n"), F.sum(F.when(F.col(column) != "english", F.col("count")).otherwise(0)).alias("x")
        )
    )
    return counts.withColumn("t", totals.scalar()).select(
        column,
        "count",
        (F.col("count") / F.col("t.n") * 100).alias("pct"),
        (F.col("t.x") / F.col("t.n") * 100).alias("non_english_pct"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE / FLOAT column, for comparison across engines."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(F.round(c.cast("double"), digits).alias(name) if kind in ("double", "float") else c)
    return df.select(*out)
