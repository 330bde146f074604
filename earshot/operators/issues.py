"""Issue metrics of clusters and their parents."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions import lexicons as lx
from earshot.functions import scoring, text as tx
from earshot.operators import rank
from earshot.sources.shared import cut

NOISE = -1
SIGNALS = ("payment", "trust", "blocker", "religious")


def score_rows(
    df: DataFrame,
    *,
    text_col: str = "text_clean",
    lexicon: Mapping[str, Iterable[str]] = lx.RISK_SIGNALS,
) -> DataFrame:
    """Add the four ``signal_*`` flags and ``row_urgency``."""
    signals = tx.risk_signals(F.col(text_col), lexicon)
    flagged = df.withColumns(signals)
    return flagged.withColumn(
        "row_urgency",
        scoring.row_urgency(F.col("severity"), F.col("sentiment"), {name: F.col(name) for name in signals}),
    )


def issue_cube(
    rows: DataFrame,
    *,
    cluster_col: str = "cluster_id",
    parent_col: str = "parent_id",
    text_col: str = "text_clean",
    id_col: str = "row_id",
    lexicon: Mapping[str, Iterable[str]] = lx.RISK_SIGNALS,
    n_buckets: int = 8,
    min_timed_rows: int = 100,
    min_timed_share: float = 0.6,
) -> DataFrame:
    """Sums per (cluster, parent, time bucket) over non-noise rows.

    Texts are read once: scores, ids and time are written as a narrow table, from which bucket edges and
    sums are taken.  The sums are one hash aggregate whose map side already shrinks a cluster of any
    size to a few rows; the small result is written, since every metric below reads it.
    """
    live = rows.filter(F.col(cluster_col) != NOISE)
    if id_col not in live.columns:
        # Without an id, rows keep the order they are read in.
        live = live.withColumn(id_col, F.monotonically_increasing_id())
    time_col = rank.choose_time_column(live.columns)
    scored = cut(
        score_rows(live, text_col=text_col, lexicon=lexicon).select(
            F.col(id_col).alias("row_id"),
            F.col(cluster_col).alias("cluster_id"),
            F.col(parent_col).alias("parent_id"),
            "severity",
            "sentiment",
            "row_urgency",
            *[f"signal_{s}" for s in SIGNALS],
            *([time_col] if time_col else []),
        ),
        "scored",
    )
    bucket = rank.time_bucket(scored, n_buckets=n_buckets, min_rows=min_timed_rows, min_share=min_timed_share)
    sums = (
        scored.withColumn("time_bucket", bucket)
        .groupBy("cluster_id", "parent_id", "time_bucket")
        .agg(
            F.count("*").alias("n"),
            # Exact decimal sums do not depend on the order rows arrive in.
            F.sum(F.col("row_urgency").cast("decimal(12,9)")).alias("urgency"),
            F.count_if(F.col("severity") == "High").alias("high"),
            F.count_if(F.col("sentiment") == "Negative").alias("negative"),
            *[F.sum(f"signal_{s}").alias(s) for s in SIGNALS],
        )
    )
    return cut(sums, "cube")


def growth(cube: DataFrame, *, dense_buckets: bool = False) -> DataFrame:
    """Growth between the last two buckets a cluster occurs in (or the last two buckets of all).

    A cluster seen in fewer than two buckets gets zeros, score included.
    """
    counts = (
        cube.filter(F.col("time_bucket").isNotNull())
        .groupBy("cluster_id", "time_bucket")
        .agg(F.sum("n").alias("n"))
    )
    if dense_buckets:
        last = counts.agg(F.max("time_bucket")).scalar()
        position = last - F.col("time_bucket") + 1
        ranked = counts.withColumn("back", position)
        seen = F.lit(2)
    else:
        newest = Window.partitionBy("cluster_id").orderBy(F.desc("time_bucket"))
        ranked = counts.withColumn("back", F.row_number().over(newest))
        seen = F.count("*")
    two = (
        ranked.filter(F.col("back") <= 2)
        .groupBy("cluster_id")
        .agg(
            seen.alias("seen"),
            F.coalesce(F.max(F.when(F.col("back") == 1, F.col("n"))), F.lit(0)).alias("recent"),
            F.coalesce(F.max(F.when(F.col("back") == 2, F.col("n"))), F.lit(0)).alias("previous"),
        )
    )
    usable, rate = F.col("seen") >= 2, (F.col("recent") - F.col("previous")) / F.greatest(F.col("previous"), F.lit(1))
    return two.select(
        "cluster_id",
        F.when(usable, rate).otherwise(0.0).alias("growth_rate"),
        F.when(usable, 1 / (1 + F.exp(-rate))).otherwise(0.0).alias("growth_score"),
        F.when(usable, F.col("recent")).otherwise(0).cast("bigint").alias("recent_count"),
    )


def modal_parent(cube: DataFrame) -> DataFrame:
    """Most frequent parent per cluster, the smallest on ties."""
    sizes = cube.filter(F.col("parent_id").isNotNull()).groupBy("cluster_id", "parent_id").agg(F.sum("n").alias("n"))
    best = F.max_by("parent_id", F.struct("n", -F.col("parent_id")))
    return sizes.groupBy("cluster_id").agg(best.alias("parent_id"))


def reasons(pct_high: Column, pct_negative: Column, rates: Mapping[str, Column], growth_rate: Column) -> Column:
    """Which thresholds a cluster passes, as text."""
    text = F.concat_ws(
        "; ",
        F.when(pct_high >= 0.2, "high severity concentration"),
        F.when(pct_negative >= 0.5, "mostly negative sentiment"),
        F.when(rates["payment"] >= 0.2, "payment/subscription risk"),
        F.when(rates["blocker"] >= 0.15, "blocker/crash language"),
        F.when((rates["trust"] >= 0.2) & (rates["religious"] >= 0.2), "religious trust sensitivity"),
        F.when(growth_rate > 0.25, "rapid recent growth"),
    )
    return F.when(text == "", "frequency-driven").otherwise(text)


def issue_metrics(cube: DataFrame, *, dense_buckets: bool = False) -> DataFrame:
    """One row per cluster with its 16 metrics; order by priority and count where an order is wanted."""
    per_cluster = cube.groupBy("cluster_id").agg(
        F.sum("n").alias("count"),
        F.sum("urgency").cast("double").alias("urgency"),
        F.sum("high").alias("high"),
        F.sum("negative").alias("negative"),
        *[F.sum(s).alias(s) for s in SIGNALS],
    )
    total = cube.agg(F.greatest(F.sum("n"), F.lit(1))).scalar()
    n = F.col("count")
    rates = {s: F.col(s) / n for s in SIGNALS}
    impact = scoring.clip01(F.log1p(n) / F.log1p(F.col("total")))
    w = lx.PRIORITY_WEIGHTS
    return (
        per_cluster.join(growth(cube, dense_buckets=dense_buckets), "cluster_id", "left")
        .join(modal_parent(cube), "cluster_id", "left")
        .fillna(0, ["growth_rate", "growth_score", "recent_count"])
        .withColumn("total", total)
        .withColumns(
            {
                "urgency_score": F.col("urgency") / n,
                "pct_high": F.col("high") / n,
                "pct_negative": F.col("negative") / n,
                **{f"signal_{s}_rate": rates[s] for s in SIGNALS},
            }
        )
        .select(
            "cluster_id",
            "parent_id",
            "count",
            (n / F.col("total")).alias("share"),
            "urgency_score",
            "growth_rate",
            "growth_score",
            (
                100.0
                * (F.col("urgency_score") * w["urgency"] + F.col("growth_score") * w["growth"] + impact * w["impact"])
            ).alias("priority_score"),
            "recent_count",
            "pct_high",
            "pct_negative",
            *[f"signal_{s}_rate" for s in SIGNALS],
            reasons(
                F.col("pct_high"),
                F.col("pct_negative"),
                {s: F.col(f"signal_{s}_rate") for s in SIGNALS},
                F.col("growth_rate"),
            ).alias("explain_reasons"),
        )
    )


def by_priority(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("priority_score"), F.desc("count"), "cluster_id")


def parent_metrics(metrics: DataFrame, *, high: float = lx.HIGH_PRIORITY) -> DataFrame:
    """Roll cluster metrics up to parents."""
    return metrics.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(
        F.sum("count").alias("total_count"),
        F.avg("priority_score").alias("mean_priority"),
        F.max("priority_score").alias("max_priority"),
        F.avg("urgency_score").alias("mean_urgency"),
        F.avg("growth_rate").alias("mean_growth"),
        F.count_if(F.col("priority_score") >= high).alias("high_priority_clusters"),
    )
