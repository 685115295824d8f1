"""Upkeep of stored facts: retention, compaction, baselines, conventions, invariants, merges of candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retained(df: DataFrame, at: str, now: Column, days_by: Mapping[str, int], kind: str, other: int) -> DataFrame:
    """Rows younger than the days their kind is kept for."""
    keep = F.lit(other)
    for k, d in days_by.items():
        keep = F.when(F.col(kind) == k, d).otherwise(keep)
    return df.where(F.col(at) >= now - keep * 86400)


def compactable(events: DataFrame, entity: str, nr: str, snapshots: DataFrame) -> DataFrame:
    """Events up to the verified snapshot (entity, upto) of their entity, which may be moved to the archive."""
    return events.join(snapshots.select(entity, F.col("upto").alias("_u")), entity).where(F.col(nr) <= F.col("_u")).drop("_u")


def snapshot_due(events: DataFrame, entity: str, nr: str, snapshots: DataFrame, least: int) -> DataFrame:
    """entity, pending: events since the last snapshot, where there are `least` or more."""
    since = events.join(snapshots.select(entity, F.col("upto").alias("_u")), entity, "left").where(F.col("_u").isNull() | (F.col(nr) > F.col("_u")))
    return since.groupBy(entity).agg(F.count(F.lit(1)).alias("pending")).where(F.col("pending") >= least)


def dominant(df: DataFrame, group: str, option: str, least: float = 0.3) -> DataFrame:
    """group, option, n, share, consistency (first share less the second's), dominant (share >= least)."""
    counts = df.groupBy(group, option).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    shared = counts.withColumn("share", F.col("n") / F.sum("n").over(w))
    o = w.orderBy(F.desc("n"), option)
    ranked = shared.withColumns({"_r": F.row_number().over(o), "_next": F.coalesce(F.lead("share").over(o), F.lit(0.0))})
    return ranked.where("_r = 1").select(group, option, "n", "share", (F.col("share") - F.col("_next")).alias("consistency"), (F.col("share") >= least).alias("dominant"))


def deviants(df: DataFrame, group: str, option: str, least: float = 0.6) -> DataFrame:
    """Rows whose option is not the one that holds `least` of their group."""
    best = dominant(df, group, option).where(F.col("share") >= least).select(group, F.col(option).alias("_best"))
    return df.join(best, group).where(F.col(option) != F.col("_best")).drop("_best")


def merged_candidates(candidates: DataFrame, key: str, score: str, bonus: float = 0.05) -> DataFrame:
    """key, sources, score: the best score, with a bonus for each further source, at most 1."""
    g = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("sources"), F.max(score).alias("_s"))
    return g.select(key, "sources", F.least(F.lit(1.0), F.col("_s") + bonus * (F.col("sources") - 1)).alias("score"))


def consensus(df: DataFrame, kind: str, tags: str, agent: str, least: int) -> DataFrame:
    """kind, tags, agents, n of what at least `least` different agents hold with the same kind and set of tags."""
    g = df.groupBy(kind, F.array_sort(F.array_distinct(tags)).alias("tags")).agg(F.countDistinct(agent).alias("agents"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("agents") >= least)


def invariants(df: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """key, broken: each named condition that a row does not meet; null meets none."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return df.select(key, F.explode(broken).alias("broken"))


def line_changes(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, added, removed: how many different lines one text has that the other has not."""
    a, b = F.split(F.col(before), "\n"), F.split(F.col(after), "\n")
    return df.select(key, F.size(F.array_except(b, a)).alias("added"), F.size(F.array_except(a, b)).alias("removed"))


def adaptive_weights(feedback: DataFrame, kind: str, failed: str, base: float = 1.0, boost: float = 0.5, most: float = 2.0, least: int = 5) -> DataFrame:
    """kind, weight: raised by the share of failures, base where there are fewer than `least` samples."""
    g = feedback.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad"))
    return g.select(kind, F.when(F.col("n") < least, F.lit(base)).otherwise(F.least(F.lit(most), base * (1 + F.col("bad") / F.col("n") * boost))).alias("weight"))


def keyword_class(text: Column, classes: Sequence[tuple[str, Sequence[str]]], other: str) -> Column:
    """The class with the most of its words in a text; the first of equal ones, `other` without any."""
    low = F.lower(text)
    scored = F.array(*[F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(classes)])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["name"]).otherwise(other)
