"""Merging replicated state: counters, registers, observed-remove sets, vector clocks. Every merge is an aggregate, so order and repeats do not matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter(states: DataFrame, key: str, agent: str, count: str) -> DataFrame:
    """key, value of a grow-only counter: the greatest count of each agent, summed."""
    return states.groupBy(key, agent).agg(F.max(count).alias("_m")).groupBy(key).agg(F.sum("_m").alias("value"))


def last_writer(states: DataFrame, key: str, at: str, agent: str, value: str) -> DataFrame:
    """key, value of the latest write; ties go to the greater agent, then value."""
    return states.groupBy(key).agg(F.max_by(value, F.struct(at, agent, value)).alias(value))


def concurrent_values(states: DataFrame, key: str, agent: str, at: str, value: str) -> DataFrame:
    """key, values of a multi-value register: the last value of each agent that no later one of another agent within the same instant replaced."""
    own = states.groupBy(key, agent).agg(F.max(F.struct(at, value)).alias("w")).select(key, agent, "w.*")
    top = own.groupBy(key).agg(F.max(at).alias("_top"))
    return own.join(top, key).where(F.col(at) == F.col("_top")).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def observed_remove_set(adds: DataFrame, removes: DataFrame, key: str, item: str, tag: str) -> DataFrame:
    """key, item of a set: items with an add whose tag was not removed."""
    return adds.join(removes.select(key, item, tag).distinct(), [key, item, tag], "left_anti").select(key, item).distinct()


def clock(states: DataFrame, key: str, agent: str, tick: str) -> DataFrame:
    """key, clock (map of agent to its greatest tick)."""
    return states.groupBy(key, agent).agg(F.max(tick).alias("_t")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(agent, "_t")))).alias("clock"))


def clock_order(a: Column, b: Column) -> Column:
    """before, after, equal or concurrent of two clocks; a missing agent counts as 0."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    less, more = F.exists(both, lambda d: d < 0), F.exists(both, lambda d: d > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def merged_clock(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def sync_delta(local: DataFrame, remote: DataFrame, key: str, content: str, at: str) -> DataFrame:
    """key, action: push what only local has, pull what only remote has; of different contents the later wins, a tie keeps local."""
    a, b = local.select(key, F.col(content).alias("_a"), F.col(at).alias("_ta"), F.lit(1).alias("_l")), remote.select(key, F.col(content).alias("_b"), F.col(at).alias("_tb"), F.lit(1).alias("_r"))
    action = F.when(F.col("_r").isNull(), "push").when(F.col("_l").isNull(), "pull").when(F.col("_a").eqNullSafe(F.col("_b")), None).when(F.col("_tb") > F.col("_ta"), "take_remote").otherwise("keep_local")
    return a.join(b, key, "full_outer").withColumn("action", action).where(F.col("action").isNotNull()).select(key, "action")


def without_cycles(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """edges without the weakest (tie: greatest ends) of each pair that points both ways: the first step of breaking cycles."""
    w = Window.partitionBy(F.least(src, dst), F.greatest(src, dst)).orderBy(F.desc(weight), src, dst)
    return edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
