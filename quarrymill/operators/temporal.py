"""Bitemporal and event-sourced operators: as-of, ranges, differences, replay, corrections, stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_periods(df: DataFrame, key: str, at: str, *tie: str) -> DataFrame:
    """df with valid_until: when the next version of its key begins; null for the last."""
    w = Window.partitionBy(key).orderBy(at, *tie)
    return df.withColumn("valid_until", F.lead(at).over(w))


def as_of(df: DataFrame, instant: Column, start: str, end: str) -> DataFrame:
    """Rows valid at an instant: start <= instant < end, a null end being open."""
    return df.where((F.col(start) <= instant) & (F.col(end).isNull() | (instant < F.col(end))))


def in_range(df: DataFrame, start: str, end: str, lo: Column, hi: Column, mode: str) -> DataFrame:
    """Rows whose period [start, end) relates to [lo, hi]: overlaps, contains, started_during or ended_during."""
    s, e = F.col(start), F.col(end)
    if mode == "overlaps":
        return df.where((s <= hi) & (e.isNull() | (e > lo)))
    if mode == "contains":
        return df.where((s <= lo) & (e.isNull() | (e >= hi)))
    if mode == "started_during":
        return df.where((s >= lo) & (s <= hi))
    if mode == "ended_during":
        return df.where((e >= lo) & (e <= hi))
    raise ValueError(f"unknown mode {mode}")


def latest_at(events: DataFrame, key: str, at: str, nr: str, value: str, instant: Column) -> DataFrame:
    """key, value: the last value of each key at or before an instant, by partial aggregation."""
    return events.where(F.col(at) <= instant).groupBy(key).agg(F.max_by(value, F.struct(at, nr)).alias(value))


def difference(before: DataFrame, after: DataFrame, key: str, value: str, shift: float) -> DataFrame:
    """key, change: created, removed, or shifted where the value moved by more than `shift`; others are left out."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in")), after.select(key, F.col(value).alias("_b"), F.lit(True).alias("_out"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("_in").isNull(), "created").when(F.col("_out").isNull(), "removed").when(F.abs(F.col("_b") - F.col("_a")) > shift, "shifted")
    return j.withColumn("change", change).where(F.col("change").isNotNull()).select(key, "change")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, nr: str, chunk: int = 3600) -> DataFrame:
    """left with `value` of the last row of right(key, at, nr, value) at or before its own time (a timestamp): unions and windows, no range join.

    right is reduced to its last row in each chunk of seconds; a running last over a key's chunks gives what each begins with, and
    only rows of one key and one chunk are ordered together, however many a hot key has. Rows of left with a null key or time get null.
    """
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType), "_nr": F.lit(None).cast("bigint")}).unionByName(
        right.where(F.col(value).isNotNull()).select(key, at, F.col(nr).cast("bigint").alias("_nr"), F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    ).withColumn("_c", F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / chunk))
    lasts = both.where("_side = 0").groupBy(key, "_c").agg(F.max(F.struct(at, "_nr", "_v")).alias("_last"))
    chunks = both.select(key, "_c").distinct().join(lasts, [key, "_c"], "left")
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    begins = chunks.select(key, "_c", F.last("_last", ignorenulls=True).over(before)["_v"].alias("_carried"))
    w = Window.partitionBy(key, "_c").orderBy(at, "_side", "_nr").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_now", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return inside.join(begins, [key, "_c"], "left").withColumn(value, F.coalesce("_now", "_carried")).select(*left.columns, value)


def within_after(left: DataFrame, right: DataFrame, keys: list[str], at_left: str, at_right: str, width: int) -> DataFrame:
    """Pairs of rows of equal keys with 0 <= at_right - at_left <= width (numbers): a range join over buckets of that width."""
    a = left.withColumn("_b", F.explode(F.array(F.floor(F.col(at_left) / width), F.floor(F.col(at_left) / width) + 1)))
    b = right.withColumn("_b", F.floor(F.col(at_right) / width))
    return a.join(b, [*keys, "_b"]).where((F.col(at_right) >= F.col(at_left)) & (F.col(at_right) - F.col(at_left) <= width)).drop("_b")


def stability(events: DataFrame, entity: str, kind: str, at: str, changes: list[str], lo: Column, hi: Column) -> DataFrame:
    """population, changes, ksi: 1 - changes / (2 population) within 0..1, of the entities known before `hi`."""
    e = events.where(F.col(at) < hi)
    n = e.agg(F.countDistinct(entity).alias("population"), F.count_if((F.col(at) >= lo) & F.col(kind).isin(*changes)).alias("changes"))
    ksi = F.when(F.col("population") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("changes") / (2 * F.col("population"))))).otherwise(1.0)
    return n.withColumn("ksi", ksi)


def trajectory(events: DataFrame, entity: str, at: str, nr: str, value: str, points: DataFrame) -> DataFrame:
    """at, mean: the mean of the entities' latest values at each of points(at): changes of the sum are accumulated, so the work is one row a change.

    The window over all changes runs over one row an instant of `points`.
    """
    w = Window.partitionBy(entity).orderBy(at, nr)
    moved = events.where(F.col(value).isNotNull()).withColumns({"_d": F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0)), "_new": F.when(F.lag(value).over(w).isNull(), 1).otherwise(0)})
    edges = points.select(F.col("at").alias("_p")).agg(F.array_sort(F.collect_set("_p")).alias("_ps"))  # the asked points
    placed = moved.join(F.broadcast(edges)).select("_d", "_new", F.array_min(F.filter("_ps", lambda p: p >= F.col(at))).alias("at")).where("at IS NOT NULL")
    steps = placed.groupBy("at").agg(F.sum("_d").alias("_d"), F.sum("_new").alias("_n"))
    dense = points.select("at").distinct().join(steps, "at", "left").withColumn("_all", F.lit(0))
    run = Window.partitionBy("_all").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select("at", (F.sum(F.coalesce("_d", F.lit(0.0))).over(run) / F.sum(F.coalesce("_n", F.lit(0))).over(run)).alias("mean"))


def corrected(table: DataFrame, corrections: DataFrame, key: str, start: str, end: str, value: str) -> DataFrame:
    """Type-2 history after corrections(key, start, value): the version open at `start` is closed there and a new one inserted, which lasts as long as that one did."""
    versions = table.select(key, start, end, value)
    hit = versions.join(corrections.select(key, F.col(start).alias("_from"), F.col(value).alias("_value")), key).where((F.col("_from") > F.col(start)) & (F.col(end).isNull() | (F.col("_from") < F.col(end))))
    closed = hit.groupBy(key, start).agg(F.min("_from").alias("_cut"))
    old = versions.join(closed, [key, start], "left").withColumn(end, F.when(F.col("_cut").isNotNull() & (F.col(end).isNull() | (F.col("_cut") < F.col(end))), F.col("_cut")).otherwise(F.col(end))).select(key, start, end, value)
    w = Window.partitionBy(key, start).orderBy("_from")
    new = hit.withColumn("_next", F.lead("_from").over(w)).select(key, F.col("_from").alias(start), F.coalesce("_next", end).alias(end), F.col("_value").alias(value))
    return old.unionByName(new)
