"""Outliers, distributions and trends of groups, as column algebra over windows and aggregates."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions import numeric

#: Largest group for which the SQL of the single-outlier test has critical values; the operator has no such limit.
MOST_TABULATED = 1500


def zscore_outliers(df: DataFrame, group: str, value: str, threshold: float = 2.5, passes: int = 3) -> DataFrame:
    """df with z, outlier, score: iterative z-score with the sample deviation; each pass leaves out what the passes before found.

    One aggregate and join a pass, so that no group is gathered. score = (|z| - t) / (2 t), at most 1.
    """
    out = df.withColumns({"outlier": F.lit(False), "z": F.lit(None).cast("double")})
    for _ in range(passes):
        stats = out.where(~F.col("outlier") & F.col(value).isNotNull()).groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n"))
        z = F.abs(F.col(value) - F.col("_m")) / F.col("_s")
        hit = ~F.col("outlier") & (F.col("_n") >= 3) & (F.col("_s") > 0) & (z > threshold)
        out = out.join(stats, group, "left").withColumns({"z": F.when(hit, z).otherwise(F.col("z")), "outlier": F.col("outlier") | F.coalesce(hit, F.lit(False))}).drop("_m", "_s", "_n")
    score = F.when(F.col("outlier"), F.least((F.col("z") - threshold) / (2 * threshold), F.lit(1.0)))
    return out.withColumn("score", score)


def iqr_outliers(df: DataFrame, group: str, value: str, k: float = 1.5) -> DataFrame:
    """df with outlier, score by Tukey's fences (interpolated quartiles); without spread, whatever differs from the median is one."""
    q = df.groupBy(group).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    x, lo, mid, hi = F.col(value), F.col("_q")[0], F.col("_q")[1], F.col("_q")[2]
    margin = k * (hi - lo)
    far = F.when(hi == lo, F.abs(x - mid)).otherwise(F.greatest(lo - margin - x, x - hi - margin))
    hit = F.when(hi == lo, F.abs(x - mid) > 1e-12).otherwise(far > 0)
    return df.join(q, group).withColumns({"outlier": hit, "score": F.when(hit, F.when(hi == lo, F.lit(1.0)).otherwise(far / (far + margin)))}).drop("_q")


def mad_outliers(df: DataFrame, group: str, value: str, threshold: float = 3.5) -> DataFrame:
    """df with modified z (0.6745 (x - median) / MAD) and outlier; with a MAD of 0, whatever differs from the median is one."""
    med = df.groupBy(group).agg(F.median(value).alias("_med"))
    dev = df.join(med, group).withColumn("_d", F.abs(F.col(value) - F.col("_med")))
    mad = dev.groupBy(group).agg(F.median("_d").alias("_mad"))
    z = F.when(F.col("_mad") > 0, 0.6745 * F.col("_d") / F.col("_mad"))
    hit = F.when(F.col("_mad") > 0, z > threshold).otherwise(F.col("_d") > 1e-12)
    return dev.join(mad, group).withColumns({"modified_z": z, "outlier": hit}).drop("_med", "_d", "_mad")


@F.pandas_udf(T.DoubleType())
def _critical(n: pd.Series, alpha: pd.Series) -> pd.Series:
    """Grubbs's critical value of n values, worked out once for each size of a batch."""
    sizes = pd.DataFrame({"n": n.astype(float), "alpha": alpha}).drop_duplicates()
    t = numeric.student_quantile(1 - sizes["alpha"].to_numpy() / (2 * sizes["n"].to_numpy()), sizes["n"].to_numpy() - 2)
    m = sizes["n"].to_numpy()
    found = dict(zip(zip(sizes["n"], sizes["alpha"]), (m - 1) / m**0.5 * (t * t / (m - 2 + t * t)) ** 0.5))
    return pd.Series([found[k] for k in zip(n.astype(float), alpha)], dtype=float)


def grubbs_outlier(df: DataFrame, group: str, key: str, value: str, alpha: float = 0.05) -> DataFrame:
    """group, key, g, critical, outlier of the most extreme value of each group of 3 values or more (tie: smallest key)."""
    stats = df.groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n")).where((F.col("_n") >= 3) & (F.col("_s") > 0))
    dev = df.join(stats, group).withColumn("_g", F.abs(F.col(value) - F.col("_m")) / F.col("_s"))
    top = dev.groupBy(group).agg(F.min(F.struct((-F.col("_g")).alias("g"), F.col(key).alias("k"))).alias("_t"), F.first("_n").alias("_n"))
    sized = top.select(group, F.col("_t.k").alias(key), (-F.col("_t.g")).alias("g"), _critical("_n", F.lit(alpha)).alias("critical"))
    return sized.withColumn("outlier", F.col("g") > F.col("critical"))


@lru_cache(maxsize=100_000)
def _esd_criticals(n: int, most: int, alpha: float) -> tuple[float, ...]:
    """Critical values of the first `most` steps over n values, in one call for all of them."""
    m = n - np.arange(most, dtype=float)
    m = m[m >= 3]
    t = numeric.student_quantile(1 - alpha / (2 * m), m - 2)
    return tuple(((m - 1) * t / np.sqrt((m - 2 + t * t) * m)).tolist())


def esd_outliers(df: DataFrame, group: str, key: str, value: str, least: int = 25, alpha: float = 0.05) -> DataFrame:
    """group, key of the outliers by the generalised ESD test, in groups of `least` values or more. Keys are unique in a group.

    At most ten values are taken out, each the least or the largest left: a task sees the ten extremes of either side, and count,
    mean and squared deviations of the others.
    """
    import math

    clean = df.where(F.col(value).isNotNull()).select(group, key, F.col(value).cast("double").alias("_v"))
    sized = clean.groupBy(group).agg(F.count("_v").alias("_all")).where(F.col("_all") >= least)
    kept = clean.join(sized, group)
    side = lambda order: kept.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).where("_k <= 10").drop("_k")
    ends = side(F.asc("_v")).unionByName(side(F.desc("_v"))).distinct()
    others = kept.join(ends.select(group, key), [group, key], "left_anti").groupBy(group).agg(F.count("_v").alias("_n"), F.avg("_v").alias("_m"), F.var_pop("_v").alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    rows = ends.join(others, group, "left")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        n, first = int(pdf["_all"].iloc[0]), pdf.iloc[0]
        core = 0 if pd.isna(first["_n"]) else int(first["_n"])
        left, order, last = pdf.sort_values(key), [], 0
        most = min(max(1, min(10, math.ceil(math.sqrt(n)))), n // 2)
        criticals = _esd_criticals(n, most, alpha)
        for i in range(1, most + 1):
            x = left["_v"].to_numpy()
            m = len(x) + core
            lo, hi = (min(x.min(), first["_lo"]), max(x.max(), first["_hi"])) if core else (x.min(), x.max())
            if m < 3 or not hi > lo:
                break
            base = first["_m"] if core and first["_hi"] > first["_lo"] else first["_lo"] if core else x[0]
            shift = (x - base).sum() / m
            mean = base + shift
            dev = math.sqrt((np.square(x - mean).sum() + (core * (first["_s"] + shift * shift) if core else 0)) / (m - 1))
            far = (left["_v"] - mean).abs()
            at = far.idxmax()
            order.append(at)
            if far[at] / dev > criticals[i - 1]:
                last = i
            left = left.drop(index=at)
        return pdf.loc[order[:last], [group, key]]

    return rows.groupBy(group).applyInPandas(test, rows.select(group, key).schema)


def normality(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, skew, kurtosis, normal (|skew| <= 2 and |excess kurtosis| <= 7) and the tests its size and shape call for."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"))
    normal = F.coalesce((F.abs("skew") <= 2) & (F.abs("kurtosis") <= 7), F.lit(False))
    n = F.col("n")
    method = (
        F.when(n < 10, "rules").when(n >= 30, F.when(normal, "zscore").otherwise("iqr")).when(n >= 25, F.when(normal, "esd").otherwise("mad")).otherwise(F.when(normal, F.lit("grubbs")).otherwise("mad"))
    )
    return g.withColumns({"normal": normal, "method": method})


def significance(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.4, "moderate").otherwise("low")


def beta_posterior(hits: Column, total: Column) -> dict[str, Column]:
    """alpha, beta, mean and variance of the posterior of a share with a uniform prior."""
    a, b = hits + 1.0, total - hits + 1.0
    return {"alpha": a, "beta": b, "mean": a / (a + b), "variance": a * b / ((a + b) * (a + b) * (a + b + 1))}


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def credible_interval(alpha: pd.Series, beta: pd.Series) -> pd.DataFrame:
    """Central 95 % interval of a Beta distribution; very sharp ones are its mean +- 1e-6, invalid parameters give 0..1."""
    import numpy as np

    a, b = alpha.fillna(-1).to_numpy(float), beta.fillna(-1).to_numpy(float)
    good, sharp = (a > 0) & (b > 0), (a > 1e6) | (b > 1e6)
    sa, sb = np.where(good & ~sharp, a, 1.0), np.where(good & ~sharp, b, 1.0)
    low, high = numeric.beta_quantile(0.025, sa, sb), numeric.beta_quantile(0.975, sa, sb)
    mean = a / np.where(a + b == 0, 1, a + b)
    low, high = np.where(sharp, np.maximum(mean - 1e-6, 0), low), np.where(sharp, np.minimum(mean + 1e-6, 1), high)
    return pd.DataFrame({"low": np.where(good, low, 0.0), "high": np.where(good, high, 1.0)})


def confidence_tier(mean: Column) -> Column:
    return F.when(mean >= 0.85, "established").when(mean >= 0.70, "emerging").when(mean >= 0.50, "tentative").otherwise("uncertain")


def dirichlet(df: DataFrame, group: str, kind: str, count: str, gap: float = 0.15) -> DataFrame:
    """group, kind, posterior ((1 + n) / (K + N)), contested (the two greatest of the group differ by `gap` at most)."""
    w = Window.partitionBy(group)
    post = df.withColumn("posterior", (1.0 + F.col(count)) / (F.count(F.lit(1)).over(w) + F.sum(count).over(w)))
    ordered = Window.partitionBy(group).orderBy(F.desc("posterior"), kind)
    two = post.withColumns({"_r": F.row_number().over(ordered), "_next": F.lead("posterior").over(ordered)})
    lead = F.max(F.when((F.col("_r") == 1) & (F.col("posterior") - F.col("_next") <= gap), True)).over(w)
    return two.select(group, kind, "posterior", F.coalesce(lead, F.lit(False)).alias("contested"))


def momentum(df: DataFrame, key: str, order: str, value: str, steep: float = 0.1) -> DataFrame:
    """key, slope (per step, relative to the mean), direction: rising or falling beyond `steep`, else stable."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w))
    g = x.groupBy(key).agg((F.regr_slope(value, "_i") / F.when(F.avg(value) != 0, F.avg(value))).alias("slope"))
    return g.select(key, "slope", F.when(F.col("slope") > steep, "rising").when(F.col("slope") < -steep, "falling").otherwise("stable").alias("direction"))


def forecast(df: DataFrame, key: str, order: str, value: str, ahead: tuple[int, ...] = (7, 30), least: int = 5) -> DataFrame:
    """key, n, slope, r2 and value_in_k: least squares over the position, carried on, kept within 0..100; `least` points are needed."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w) - 1)
    g = x.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(value, "_i").alias("slope"), F.regr_intercept(value, "_i").alias("_b"), F.regr_r2(value, "_i").alias("r2")).where(F.col("n") >= least)
    return g.select(key, "n", "slope", "r2", *[F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_b") + F.col("slope") * (F.col("n") - 1 + k))).alias(f"value_in_{k}") for k in ahead])


def moving_trend(df: DataFrame, key: str, order: str, value: str, span: int = 7, step: float = 2.0) -> DataFrame:
    """df with recent and previous (means of the last and the `span` values before) and trend."""
    w = Window.partitionBy(key).orderBy(order)
    recent, previous = F.avg(value).over(w.rowsBetween(-span + 1, 0)), F.avg(value).over(w.rowsBetween(-2 * span + 1, -span))
    change = F.col("recent") - F.col("previous")
    return df.withColumns({"recent": recent, "previous": previous}).withColumn("trend", F.when(change > step, "improving").when(change < -step, "declining").otherwise("stable"))


def last_point_anomalies(df: DataFrame, key: str, order: str, value: str, threshold: float = 2.0) -> DataFrame:
    """key, value, z of the last value of each key that is off the mean of all by more than `threshold` population deviations."""
    g = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return g.where("_s > 0").select(key, value, ((F.col(value) - F.col("_m")) / F.col("_s")).alias("z")).where(F.abs("z") > threshold)


def drops(df: DataFrame, key: str, order: str, value: str, warn: float = 5.0, critical: float = 15.0) -> DataFrame:
    """df with change against the row before and alert, where it fell by warn or critical at least."""
    change = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    out = df.withColumn("change", change)
    return out.withColumn("alert", F.when(F.col("change") <= -critical, "critical").when(F.col("change") <= -warn, "warning")).where(F.col("alert").isNotNull())


def bursts(df: DataFrame, key: str, at: str, seconds: int, times: int) -> DataFrame:
    """key, at of each event that is the `times`-th within `seconds` for its key."""
    first = F.lag(at, times - 1).over(Window.partitionBy(key).orderBy(at))
    return df.withColumn("_first", first).where(F.col(at) - F.col("_first") <= seconds).drop("_first")


def sustained_worsening(df: DataFrame, key: str, order: str, value: str, runs: int = 3) -> DataFrame:
    """key, order of each row that ends `runs` increases in a row."""
    w = Window.partitionBy(key).orderBy(order)
    up = F.when(F.col(value) > F.lag(value).over(w), 1).otherwise(0)
    x = df.withColumn("_up", up)
    return x.withColumn("_ups", F.sum("_up").over(w.rowsBetween(-runs + 1, 0))).where(F.col("_ups") == runs).drop("_up", "_ups")


def scaling_exponent(df: DataFrame, key: str, size: str, cost: str) -> DataFrame:
    """key, exponent, r2: slope of log cost over log size."""
    return df.where((F.col(size) > 0) & (F.col(cost) > 0)).groupBy(key).agg(F.regr_slope(F.log(cost), F.log(size)).alias("exponent"), F.regr_r2(F.log(cost), F.log(size)).alias("r2"))


def monte_carlo(cases: DataFrame, key: str, mean: str, deviation: str, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """key, p10, p50, p90 of a positive normal effort, simulated `rounds` times with draws that depend on key and seed alone."""
    draws = cases.select(key, mean, deviation, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("_i"))
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), F.col(key), F.col("_i")), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * 3.141592653589793 * unit(1))
    effort = F.greatest(F.col(mean) + F.col(deviation) * normal, F.lit(0.0))
    return draws.groupBy(key).agg(*[F.percentile(effort, p).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)])

