"""Totals and averages over trailing periods.

Block decomposition: days are cut into blocks as long as the window. Inside a block, a prefix sum and a suffix
sum are kept; the window that ends on day d is the prefix sum at d joined with the suffix sum that begins L-1 days
earlier, in the block before. Each series is padded with L-1 empty days before its first, so that every day has both. Nothing is
subtracted, so no total carries the rounding of another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Days of the years 1970 to 9999: a reading at another time is none, for the days between would be without number.
FIRST_DAY, LAST_DAY = 0, 2_932_896


def daily_series(readings: DataFrame, key: str = "key", day: str = "day", value: str = "value", pad: int = 29) -> DataFrame:
    """key, day, first_day, total, n: one row for each key and day from `pad` days before its first to its last, days without readings included.

    readings: key, day (days since the epoch), value; rows with a null in any of them, or outside of the years 1970 to 9999, are no
    reading. Readings are summed per key and day before anything is gathered by key, so a hot key costs one row a day. An
    empty input gives an empty result; other columns are ignored.
    """
    daily = (
        readings.where(F.col(key).isNotNull() & F.col(day).between(FIRST_DAY, LAST_DAY) & F.col(value).isNotNull())
        .groupBy(F.col(key).alias("key"), F.col(day).cast("bigint").alias("day"))
        .agg(F.sum(F.col(value).cast("double")).alias("total"), F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("key").orderBy("day")
    first = F.min("day").over(w)
    spaced = daily.select(
        "*", F.coalesce(F.lead("day").over(w) - 1, F.col("day")).alias("until"), first.alias("first_day"), F.when(F.col("day") == first, F.col("day") - pad).otherwise(F.col("day")).alias("since")
    )
    filled = spaced.select("key", "first_day", F.col("day").alias("at"), "total", "n", F.explode(F.sequence("since", "until")).alias("day"))
    real = F.col("day") == F.col("at")
    return filled.select(
        "key", "day", "first_day", F.when(real, F.col("total")).otherwise(0.0).alias("total"), F.when(real, F.col("n")).otherwise(0).cast("bigint").alias("n")
    )


def trailing(series: DataFrame, lengths: Sequence[int] = (7, 30), columns: Sequence[str] = ("total", "n")) -> DataFrame:
    """series from its first_day on with, for each length L and column c, c_L: the sum of c over the L days ending that day.

    series must be dense and padded with at least the longest L less one (daily_series). All windows share the partitioning by
    key, so there is one exchange of one row per key and day.
    """
    by_key = Window.partitionBy("key").orderBy("day")
    out = series
    for length in lengths:
        out = out.withColumn("_block", F.floor(F.col("day") / length))
        inside = Window.partitionBy("key", "_block").rowsBetween(Window.unboundedPreceding, 0)
        up, down = inside.orderBy("day"), inside.orderBy(F.desc("day"))
        out = out.withColumns({f"_up_{c}": F.sum(c).over(up) for c in columns}).withColumns({f"_down_{c}": F.sum(c).over(down) for c in columns})
        whole = F.col("day") % length == length - 1  # the window is the block itself
        before = {c: F.when(whole, F.lit(0)).otherwise(F.lag(f"_down_{c}", length - 1).over(by_key)) for c in columns}
        out = out.withColumns({f"{c}_{length}": F.col(f"_up_{c}") + before[c] for c in columns})
        out = out.drop("_block", *[f"_{s}_{c}" for s in ("up", "down") for c in columns])
    return out.where("day >= first_day")


def metric_readings(metrics: DataFrame) -> DataFrame:
    """key, day, value of bridge_metrics rows: each id once, names trimmed and in lower case, milliseconds made seconds.

    No reading: null, NaN or negative metric_value, a null or blank name, a null time. Rows that share an id count once
    (the least of them, if they differ).
    """
    from quarrymill.functions.keys import epoch_seconds, loose_key

    rows = metrics.select(
        "id",
        loose_key(F.col("metric_name")).alias("key"),
        F.floor(epoch_seconds(F.col("recorded_at")) / 86400).alias("day"),
        F.col("metric_value").cast("double").alias("value"),
    ).where(F.col("key").isNotNull() & F.col("day").isNotNull() & (F.col("value") >= 0) & ~F.isnan("value"))
    with_id = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("key", "day", "value")).alias("r")).select("r.*")
    return with_id.unionByName(rows.where(F.col("id").isNull()).drop("id"))


def metric_trailing(metrics: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    """metric_name, day, first_day and the totals, counts and daily averages of both periods."""
    t = trailing(daily_series(metric_readings(metrics), pad=max(short, long) - 1), (short, long))
    return t.select(
        F.col("key").alias("metric_name"),
        "day",
        "first_day",
        *[x for n in (short, long) for x in (F.col(f"total_{n}"), (F.col(f"total_{n}") / n).alias(f"average_{n}"), F.col(f"n_{n}").alias(f"readings_{n}"))],
    )


def silences_and_surges(metrics: DataFrame, short: int = 7, long: int = 30, factor: float = 2.0) -> DataFrame:
    """metric_name, day, kind: 'silent' without a reading in the short period, 'surge' if its daily average exceeds factor times the long one's, from the long-th day on."""
    from quarrymill.functions.keys import day_text

    t = metric_trailing(metrics, short, long)
    silent = F.when(F.col(f"readings_{short}") == 0, F.lit("silent"))
    surge = F.when(
        (F.col("day") >= F.col("first_day") + long - 1) & (F.col(f"average_{short}") > factor * F.col(f"average_{long}")), F.lit("surge")
    )
    return (
        t.select("metric_name", day_text(F.col("day")).alias("day"), F.explode(F.array(silent, surge)).alias("kind")).where(F.col("kind").isNotNull())
    )
