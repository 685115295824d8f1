"""Relational operators: latest rows, pre-aggregated fan-in joins, anti and semi joins, table differences, retention, paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column, keep: int = 1) -> DataFrame:
    """The first `keep` rows of each key in the given order (the filter on row_number becomes a window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def best_by(df: DataFrame, keys: Sequence[str], value: str, *order: str) -> DataFrame:
    """keys and the value with the greatest (order..., then smallest value): partial aggregation, no window."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def top_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and the most frequent value of each; ties go to the smaller value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    first = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_b"))
    return first.select(*keys, F.col("_b.v").alias(value))


def fan_in(base: DataFrame, key: str, parts: Sequence[tuple[DataFrame, Mapping[str, object]]]) -> DataFrame:
    """base left-joined with parts, each already one row a key, their missing columns defaulted."""
    for part, defaults in parts:
        base = base.join(part, key, "left").fillna({k: v for k, v in defaults.items() if v is not None})
    return base


def located(matches: DataFrame) -> DataFrame:
    """pattern_id, file, line, column_num, confidence: each place of a pattern once, with its greatest confidence."""
    return matches.groupBy("pattern_id", "file", "line", "column_num").agg(F.max("confidence").alias("confidence"))


def pattern_groups(matches: DataFrame) -> DataFrame:
    """pattern_id, locations, file_spread, mean, stddev (sample, 0 for one) of the places of each pattern.

    The mean is of decimals, so that it does not depend on the order of summation.
    """
    return located(matches).groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("locations"),
        F.countDistinct("file").alias("file_spread"),
        (F.sum(F.col("confidence").cast("decimal(18,9)")).cast("double") / F.count("confidence")).alias("mean"),
        F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("stddev"),
    )


def table_diff(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """key, status (added, removed, modified, unchanged) of a full outer comparison; null values are equal."""
    a, b = now.select(key, F.col(value).alias("_now"), F.lit(1).alias("_in")), before.select(key, F.col(value).alias("_then"), F.lit(1).alias("_was"))
    status = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_in").isNull(), "removed").when(F.col("_now").eqNullSafe(F.col("_then")), "unchanged").otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def referencing_neither(edges: DataFrame, ends: Sequence[str], doomed: DataFrame, key: str) -> DataFrame:
    """edges without those one of whose ends is among doomed keys."""
    for end in ends:
        edges = edges.join(doomed.select(F.col(key).alias(end)).distinct(), end, "left_anti")
    return edges


def page(df: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    """The `size` rows that follow the cursor key: keyset paging, the filter reaches the scan."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def cursor(key: Column) -> Column:
    """An opaque cursor of a key: base64 of its JSON."""
    return F.base64(F.to_json(F.struct(key.alias("id"))))


def cursor_key(c: Column) -> Column:
    return F.get_json_object(F.unbase64(c).cast("string"), "$.id")


def kept_snapshots(df: DataFrame, entity: str, at: str, nr: str) -> DataFrame:
    """The last snapshot (greatest nr) of each entity and month."""
    last = df.groupBy(entity, F.trunc(at, "month").alias("_month")).agg(F.max(nr).alias(nr))
    return df.join(last.select(nr), nr, "left_semi")


def numbered_versions(df: DataFrame, entity: str, *order: Column) -> DataFrame:
    return df.withColumn("version", F.row_number().over(Window.partitionBy(entity).orderBy(*order)).cast("bigint"))


def merge_children(patterns: DataFrame, locations: DataFrame, merges: DataFrame) -> DataFrame:
    """parent_id, locations, file_spread after merging: of each pair (a, b) the one with more locations (tie: smaller id) is the parent; places are united."""
    size = patterns.select("pattern_id", "location_count")
    both = (
        merges.join(size.select(F.col("pattern_id").alias("a"), F.col("location_count").alias("na")), "a")
        .join(size.select(F.col("pattern_id").alias("b"), F.col("location_count").alias("nb")), "b")
        .select(
            F.when((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))), F.struct(F.col("a").alias("p"), F.col("b").alias("c")))
            .otherwise(F.struct(F.col("b").alias("p"), F.col("a").alias("c")))
            .alias("m")
        )
        .select("m.*")
        .distinct()
    )
    # Children of several parents go to each of them, as their pairs say.
    members = both.select("p", F.col("c").alias("pattern_id")).unionByName(both.select("p", F.col("p").alias("pattern_id"))).distinct()
    places = locations.select("pattern_id", "file", "line", "column_num").distinct()
    return (
        members.join(places, "pattern_id").groupBy(F.col("p").alias("parent_id"))
        .agg(F.countDistinct("file", F.coalesce("line", F.lit(-1)), F.coalesce("column_num", F.lit(-1))).alias("locations"), F.countDistinct("file").alias("file_spread"))
    )
