"""Scores and decisions as column expressions. Weights and thresholds are parameters with the customary defaults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def exponential_decay(days: Column, life: Column | float) -> Column:
    """exp(-days / life): after `life` days 1/e is left."""
    return F.exp(-days / life)


def half_life_decay(days: Column, half_life: Column | float) -> Column:
    """0.5 ^ (days / half_life)."""
    return F.pow(F.lit(0.5), days / half_life)


def ramp_decay(days: Column, full: int = 7, end: int = 90, floor: float = 0.1) -> Column:
    """1 up to `full` days, then linear down to `floor` at `end` days."""
    return F.when(days <= full, 1.0).when(days >= end, floor).otherwise(1 - (1 - floor) * (days - full) / (end - full))


def weighted(parts: Mapping[str, tuple[Column, float]]) -> Column:
    out = F.lit(0.0)
    for c, w in parts.values():
        out = out + c * w
    return out


def trust(good: Column, bad: Column, n: Column) -> Column:
    """(good / (n + 1)) (1 - bad / (n + 1))."""
    return good / (n + 1) * (1 - bad / (n + 1))


def weighted_mean(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """key, n, score: sum(value weight) / sum(weight); 0 without weight."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * F.col(weight)).alias("_s"), F.sum(weight).alias("_w"))
    return g.select(key, "n", F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(0.0).alias("score"))


def graded(score: Column, steps: Mapping[str, float], below: str) -> Column:
    out: Column | None = None
    for name, least in steps.items():
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(below)


def penalty_score(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """key, score: 100 less the sum of weights, not below 0."""
    return rows.groupBy(key).agg(clamp(100 - F.sum(weight), 0, 100).alias("score"))
