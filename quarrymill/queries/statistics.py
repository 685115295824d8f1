"""Statistical queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import statistics as S
from quarrymill.queries.registry import Tables, collection
from quarrymill.queries.relational import held

QUERIES, SQL, query = collection()

_PL = "pl AS (SELECT DISTINCT location_id, pattern_id, confidence FROM pattern_locations WHERE confidence IS NOT NULL)"
_HELD = "h AS (SELECT * FROM aggregated_patterns QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC) = 1)"
_DAILY = """s AS (SELECT DISTINCT id, lower(trim(metric_name)) AS metric, metric_value AS v, (CASE WHEN recorded_at >= 100000000000 THEN recorded_at // 1000 ELSE recorded_at END) // 86400 AS day FROM bridge_metrics WHERE metric_value >= 0),
d AS (SELECT metric, day, sum(v) / count(*) AS v FROM s GROUP BY 1, 2)"""


def places(t: Tables) -> DataFrame:
    return t.pattern_locations.select("location_id", "pattern_id", "confidence").where("confidence IS NOT NULL").distinct()


def daily(t: Tables) -> DataFrame:
    """metric, day, v: the mean reading of each metric and day."""
    from quarrymill.operators.trailing import metric_readings

    return metric_readings(t.bridge_metrics).groupBy(F.col("key").alias("metric"), "day").agg((F.sum("value") / F.count(F.lit(1))).alias("v"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_Z = "WITH " + _PL + """, a0 AS (SELECT *, false AS o0 FROM pl),
s1 AS (SELECT pattern_id, avg(confidence) m, stddev_samp(confidence) s, count(*) n FROM a0 GROUP BY 1),
a1 AS (SELECT a0.*, coalesce(n >= 3 AND s > 0 AND abs(confidence - m) / s > 2.5, false) AS o1 FROM a0 JOIN s1 USING (pattern_id)),
s2 AS (SELECT pattern_id, avg(confidence) m, stddev_samp(confidence) s, count(*) n FROM a1 WHERE NOT o1 GROUP BY 1),
a2 AS (SELECT a1.*, o1 OR coalesce(n >= 3 AND s > 0 AND abs(confidence - m) / s > 2.5, false) AS o2 FROM a1 LEFT JOIN s2 USING (pattern_id)),
s3 AS (SELECT pattern_id, avg(confidence) m, stddev_samp(confidence) s, count(*) n FROM a2 WHERE NOT o2 GROUP BY 1),
a3 AS (SELECT a2.*, o2 OR coalesce(n >= 3 AND s > 0 AND abs(confidence - m) / s > 2.5, false) AS o3 FROM a2 LEFT JOIN s3 USING (pattern_id))
SELECT location_id, pattern_id FROM a3 WHERE o3"""


@query(_Z)
def zscore_outliers(t: Tables) -> DataFrame:
    return S.zscore_outliers(places(t), "pattern_id", "confidence").where("outlier").select("location_id", "pattern_id")


@query("WITH " + _PL + """, q AS (SELECT pattern_id, quantile_cont(confidence, 0.25) a, quantile_cont(confidence, 0.5) b, quantile_cont(confidence, 0.75) c FROM pl GROUP BY 1)
SELECT location_id, pattern_id FROM pl JOIN q USING (pattern_id) WHERE CASE WHEN a = c THEN abs(confidence - b) > 1e-12 ELSE greatest(a - 1.5 * (c - a) - confidence, confidence - c - 1.5 * (c - a)) > 0 END""")
def iqr_outliers(t: Tables) -> DataFrame:
    return S.iqr_outliers(places(t), "pattern_id", "confidence").where("outlier").select("location_id", "pattern_id")


@query("WITH " + _PL + """, m AS (SELECT pattern_id, median(confidence) m FROM pl GROUP BY 1), d AS (SELECT pl.*, abs(confidence - m) d FROM pl JOIN m USING (pattern_id)), x AS (SELECT pattern_id, median(d) mad FROM d GROUP BY 1)
SELECT location_id, pattern_id FROM d JOIN x USING (pattern_id) WHERE CASE WHEN mad > 0 THEN 0.6745 * d / mad > 3.5 ELSE d > 1e-12 END""")
def mad_outliers(t: Tables) -> DataFrame:
    return S.mad_outliers(places(t), "pattern_id", "confidence").where("outlier").select("location_id", "pattern_id")


def _critical_sql() -> str:
    from quarrymill.functions.numeric import grubbs_criticals

    return ", ".join(f"({n}, {c!r})" for n, c in enumerate(grubbs_criticals(S.MOST_TABULATED), 3))


@query("WITH " + _PL + f""", c(n, critical) AS (VALUES {_critical_sql()}), s AS (SELECT pattern_id, avg(confidence) m, stddev_samp(confidence) s, count(*) n FROM pl GROUP BY 1 HAVING count(*) BETWEEN 3 AND {S.MOST_TABULATED} AND stddev_samp(confidence) > 0),
d AS (SELECT pattern_id, location_id, abs(confidence - m) / s AS g, n FROM pl JOIN s USING (pattern_id) QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY round(abs(confidence - m) / s, 9) DESC, location_id) = 1)
SELECT pattern_id, round(g, 6) AS g, round(critical, 6) AS critical, g > critical AS outlier FROM d JOIN c USING (n)""")
def grubbs_outlier(t: Tables) -> DataFrame:
    return rounded(S.grubbs_outlier(places(t), "pattern_id", "location_id", "confidence").drop("location_id"), "g", "critical")


@query()
def esd_outliers(t: Tables) -> DataFrame:
    return S.esd_outliers(places(t), "pattern_id", "location_id", "confidence")


@query("WITH " + _PL + """, s AS (SELECT pattern_id, count(*) n, avg(confidence) m FROM pl GROUP BY 1), g AS (SELECT pattern_id, any_value(n) n, avg((confidence - m) ** 2) m2, avg((confidence - m) ** 3) m3, avg((confidence - m) ** 4) m4 FROM pl JOIN s USING (pattern_id) GROUP BY 1),
k AS (SELECT pattern_id, n, coalesce(m2 > 1e-18 AND abs(m3 / m2 ** 1.5) <= 2 AND abs(m4 / m2 ** 2 - 3) <= 7, false) AS normal FROM g)
SELECT pattern_id, n, CASE WHEN n < 10 THEN 'rules' WHEN n >= 30 THEN CASE WHEN normal THEN 'zscore' ELSE 'iqr' END WHEN n >= 25 THEN CASE WHEN normal THEN 'esd' ELSE 'mad' END WHEN normal THEN 'grubbs' ELSE 'mad' END AS method FROM k WHERE n >= 10""")
def normality_select(t: Tables) -> DataFrame:
    return S.normality(places(t), "pattern_id", "confidence").where("n >= 10").select("pattern_id", "n", "method")


@query("WITH " + _HELD + """, b AS (SELECT pattern_id, location_count - outlier_count + 1.0 AS a, outlier_count + 1.0 AS b FROM h)
SELECT pattern_id, CAST(a AS DOUBLE) AS alpha, CAST(b AS DOUBLE) AS beta, round(a / (a + b), 6) AS mean, round(a * b / ((a + b) * (a + b) * (a + b + 1)), 9) AS variance,
CASE WHEN a / (a + b) >= 0.85 THEN 'established' WHEN a / (a + b) >= 0.70 THEN 'emerging' WHEN a / (a + b) >= 0.50 THEN 'tentative' ELSE 'uncertain' END AS tier FROM b""")
def beta_posterior(t: Tables) -> DataFrame:
    n = F.col("location_count").cast("double")
    p = S.beta_posterior(n - F.col("outlier_count"), n)
    return held(t).select("pattern_id", p["alpha"].alias("alpha"), p["beta"].alias("beta"), F.round(p["mean"], 6).alias("mean"), F.round(p["variance"], 9).alias("variance"), S.confidence_tier(p["mean"]).alias("tier"))


@query()
def credible_intervals(t: Tables) -> DataFrame:
    n = F.col("location_count").cast("double")
    p = S.beta_posterior(n - F.col("outlier_count"), n)
    i = S.credible_interval(p["alpha"], p["beta"])
    return held(t).select("pattern_id", F.round(i["low"], 6).alias("low"), F.round(i["high"], 6).alias("high"))


@query("""WITH c AS (SELECT rule_id, severity, count(*) AS n FROM (SELECT DISTINCT id, rule_id, severity FROM violations) GROUP BY 1, 2), p AS (SELECT rule_id, severity, (1.0 + n) / (count(*) OVER w + sum(n) OVER w) AS p FROM c WINDOW w AS (PARTITION BY rule_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY p DESC, severity) AS r, lead(p) OVER (PARTITION BY rule_id ORDER BY p DESC, severity) AS nx FROM p)
SELECT rule_id, severity, round(p, 6) AS posterior, coalesce(max(CASE WHEN r = 1 AND p - nx <= 0.15 THEN true END) OVER (PARTITION BY rule_id), false) AS contested FROM r""")
def dirichlet_contested(t: Tables) -> DataFrame:
    counts = t.violations.select("id", "rule_id", "severity").distinct().groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    return rounded(S.dirichlet(counts, "rule_id", "severity", "n"), "posterior")


@query("WITH " + _DAILY + """, i AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY day) AS i FROM d), g AS (SELECT metric, regr_slope(v, i) / nullif(avg(v), 0) AS s FROM i GROUP BY 1)
SELECT metric, round(s, 6) AS slope, CASE WHEN s > 0.1 THEN 'rising' WHEN s < -0.1 THEN 'falling' ELSE 'stable' END AS direction FROM g""")
def momentum_slope(t: Tables) -> DataFrame:
    return rounded(S.momentum(daily(t), "metric", "day", "v"), "slope")


@query("WITH " + _DAILY + """, i AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY day) - 1 AS i FROM d), g AS (SELECT metric, count(*) AS n, regr_slope(v, i) AS s, regr_intercept(v, i) AS b FROM i GROUP BY 1 HAVING count(*) >= 5)
SELECT metric, n, round(s, 6) AS slope, round(greatest(0, least(100, b + s * (n + 6))), 4) AS value_in_7, round(greatest(0, least(100, b + s * (n + 29))), 4) AS value_in_30 FROM g""")
def trend_forecast(t: Tables) -> DataFrame:
    f = S.forecast(daily(t), "metric", "day", "v").drop("r2")
    return rounded(rounded(f, "slope"), "value_in_7", "value_in_30", digits=4)


@query("WITH " + _DAILY + """, w AS (SELECT metric, day, avg(v) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r, avg(v) OVER (PARTITION BY metric ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS p FROM d)
SELECT metric, CAST(day AS BIGINT) AS day, round(r, 6) AS recent, round(p, 6) AS previous, CASE WHEN round(r - p, 6) > 2 THEN 'improving' WHEN round(r - p, 6) < -2 THEN 'declining' ELSE 'stable' END AS trend FROM w""")
def moving_avg_trend(t: Tables) -> DataFrame:
    return rounded(S.moving_trend(daily(t), "metric", "day", "v"), "recent", "previous").drop("v")


@query("WITH " + _DAILY + """, g AS (SELECT metric, arg_max(v, day) AS v, avg(v) AS m, stddev_pop(v) AS s FROM d GROUP BY 1) SELECT metric, round(v, 6) AS v, round((v - m) / s, 6) AS z FROM g WHERE s > 0 AND abs((v - m) / s) > 2""")
def anomaly_zscore_last(t: Tables) -> DataFrame:
    return rounded(S.last_point_anomalies(daily(t), "metric", "day", "v"), "v", "z")


@query("WITH " + _DAILY + """, c AS (SELECT metric, CAST(day AS BIGINT) AS day, v - lag(v) OVER (PARTITION BY metric ORDER BY day) AS change FROM d) SELECT metric, day, round(change, 6) AS change, CASE WHEN round(change, 6) <= -15 THEN 'critical' ELSE 'warning' END AS alert FROM c WHERE round(change, 6) <= -5""")
def degradation_lag(t: Tables) -> DataFrame:
    d = daily(t).withColumn("v", F.round("v", 9))
    return rounded(S.drops(d, "metric", "day", "v"), "change").drop("v")


@query("""WITH f AS (SELECT DISTINCT id, author, created_at FROM feedback WHERE action = 'dismiss'), l AS (SELECT *, lag(created_at, 2) OVER (PARTITION BY author ORDER BY created_at) AS a FROM f) SELECT author, created_at FROM l WHERE created_at - a <= 86400 * 3""")
def dismissal_bursts(t: Tables) -> DataFrame:
    f = t.feedback.where("action = 'dismiss'").select("id", "author", "created_at").distinct()
    return S.bursts(f, "author", "created_at", 86400 * 3, 3).select("author", "created_at")


@query("WITH " + _DAILY + """, u AS (SELECT *, CASE WHEN v > lag(v) OVER (PARTITION BY metric ORDER BY day) THEN 1 ELSE 0 END AS up FROM d), r AS (SELECT metric, day, sum(up) OVER (PARTITION BY metric ORDER BY day ROWS 2 PRECEDING) AS n FROM u) SELECT metric, CAST(day AS BIGINT) AS day FROM r WHERE n = 3""")
def sustained_regression(t: Tables) -> DataFrame:
    return S.sustained_worsening(daily(t), "metric", "day", "v").select("metric", "day")


@query("""WITH s AS (SELECT DISTINCT id, rtrim(root_path, '/') AS root, total_files AS n, duration_ms AS d FROM scan_history WHERE total_files > 0 AND duration_ms > 0), g AS (SELECT root, regr_slope(ln(d), ln(n)) AS e FROM s GROUP BY 1) SELECT root, CASE WHEN isfinite(e) THEN round(e, 4) END AS exponent FROM g""")
def scaling_exponent(t: Tables) -> DataFrame:
    s = t.scan_history.select("id", F.rtrim("root_path", F.lit("/")).alias("root"), "total_files", "duration_ms").distinct()
    return rounded(S.scaling_exponent(s, "root", "total_files", "duration_ms").drop("r2"), "exponent", digits=4)


@query()
def monte_carlo(t: Tables) -> DataFrame:
    cases = places(t).groupBy("pattern_id").agg(F.avg("confidence").alias("mean"), F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("deviation"))
    return rounded(S.monte_carlo(cases, "pattern_id", "mean", "deviation", rounds=200), "p10", "p50", "p90")


@query("WITH " + _DAILY + """, c AS (SELECT metric, count(*) / (max(day) - min(day) + 1.0) AS r FROM s GROUP BY 1) SELECT metric, round(r, 6) AS per_day, CASE WHEN r > 5 THEN 'rapid' WHEN r < 0.5 THEN 'stagnant' ELSE 'steady' END AS growth FROM c""")
def pattern_growth(t: Tables) -> DataFrame:
    from quarrymill.operators.trailing import metric_readings

    r = metric_readings(t.bridge_metrics).groupBy(F.col("key").alias("metric")).agg((F.count(F.lit(1)) / (F.max("day") - F.min("day") + 1)).alias("r"))
    return r.select("metric", F.round("r", 6).alias("per_day"), F.when(F.col("r") > 5, "rapid").when(F.col("r") < 0.5, "stagnant").otherwise("steady").alias("growth"))
