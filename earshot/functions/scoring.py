"""Row-level scores.  Weights and value maps are arguments with the usual defaults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions import lexicons as lx


def lookup(value: Column, table: Mapping[str, float], default: float) -> Column:
    """Constant-table lookup; unknown and NULL values get the default."""
    out = None
    for key, score in table.items():
        out = F.when(value == key, F.lit(score)) if out is None else out.when(value == key, F.lit(score))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def row_urgency(
    severity: Column,
    sentiment: Column,
    signals: Mapping[str, Column],
    weights: Mapping[str, float] = lx.URGENCY_WEIGHTS,
) -> Column:
    """Weighted sum in [0, 1]; a religious word counts only together with a trust word."""
    both = signals["signal_religious"] * signals["signal_trust"]
    return clip01(
        lookup(severity, lx.SEVERITY_SCORE, lx.UNKNOWN_SEVERITY_SCORE) * weights["severity"]
        + lookup(sentiment, lx.SENTIMENT_SCORE, lx.UNKNOWN_SENTIMENT_SCORE) * weights["sentiment"]
        + signals["signal_payment"] * F.lit(weights["payment"])
        + signals["signal_blocker"] * F.lit(weights["blocker"])
        + signals["signal_trust"] * F.lit(weights["trust"])
        + both * F.lit(weights["religious_trust"])
    )


def record_priority(severity: Column, sentiment: Column, tags: Column) -> Column:
    return (
        lookup(severity, lx.SEVERITY_RANK, 1)
        + lookup(sentiment, lx.SENTIMENT_RANK_FROM_ZERO, 1)
        + F.when(F.array_contains(tags, lx.TRUST_TAG), 2).otherwise(1)
    )


def pain_score(severity: Column, sentiment: Column) -> Column:
    return lookup(severity, lx.SEVERITY_RANK, 1) * 2 + lookup(sentiment, lx.SENTIMENT_RANK, 2)


def queue_score(tag: Column, severity: Column, sentiment: Column) -> Column:
    return (
        lookup(tag, lx.QUEUE_TAG_WEIGHTS, 1) * 2
        + lookup(severity, lx.SEVERITY_RANK, 1)
        + lookup(sentiment, lx.SENTIMENT_RANK, 2)
    )


def matrix_urgency(high_rate: Column, negative_rate: Column, trust_rate: Column) -> Column:
    w = lx.MATRIX_WEIGHTS
    return high_rate * w["high"] + negative_rate * w["negative"] + trust_rate * w["trust"]
