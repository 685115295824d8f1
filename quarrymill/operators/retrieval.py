"""Fusing ranked lists and filling a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fuse(lists: Sequence[DataFrame], key: str, score: str, k: int = 60) -> DataFrame:
    """key, fused: reciprocal rank fusion, the sum of 1 / (k + rank) over lists, ranks from 0 by descending score.

    The lists are results of searches, limited to their top rows, so that each is ranked as a whole.
    """
    ranked = None
    for n, part in enumerate(lists):
        w = Window.partitionBy("_l").orderBy(F.desc(score), key)
        r = part.select(key, score, F.lit(n).alias("_l")).withColumn("_r", F.row_number().over(w) - 1).select(key, (1.0 / (k + F.col("_r"))).alias("_s"))
        ranked = r if ranked is None else ranked.unionByName(r)
    return ranked.groupBy(key).agg(F.sum("_s").alias("fused"))


def within_budget(df: DataFrame, group: str, cost: str, budget: int, *order: Column) -> DataFrame:
    """The rows of each group that fit a budget, taken in order until one does not fit."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def first_and_last(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """df with place: the best rows first and last, the weakest in the middle (1st, 3rd, ... from the front, 2nd, 4th, ... from the back)."""
    w = Window.partitionBy(group)
    r = F.row_number().over(w.orderBy(F.desc(score), key))
    n = F.count(F.lit(1)).over(w)
    return df.withColumns({"_r": r, "_n": n}).withColumn("place", F.when(F.col("_r") % 2 == 1, (F.col("_r") + 1) / 2).otherwise(F.col("_n") + 1 - F.col("_r") / 2).cast("bigint")).drop("_r", "_n")
