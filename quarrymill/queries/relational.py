"""Relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import relational as R
from quarrymill.queries.registry import Tables, collection

QUERIES, SQL, query = collection()

_HELD = "h AS (SELECT * FROM aggregated_patterns QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC) = 1)"
_PL = "pl AS (SELECT DISTINCT * FROM pattern_locations)"
_V = "v AS (SELECT DISTINCT * FROM violations)"
_F = "f AS (SELECT DISTINCT * FROM feedback)"


def held(t: Tables) -> DataFrame:
    """The version of each pattern that holds."""
    return R.latest_per_key(t.aggregated_patterns, ["pattern_id"], F.desc("updated_at"))


@query(f"""WITH {_HELD}, {_PL}, {_V}, {_F},
top AS (SELECT pattern_id, severity FROM (SELECT pattern_id, severity, count(*) AS n FROM v GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, severity) = 1)
SELECT h.pattern_id, h.category, coalesce(top.severity, 'none') AS top_severity, coalesce(d.n, 0) AS detections, coalesce(o.n, 0) AS outliers, coalesce(e.n, 0) AS errors, coalesce(x.n, 0) AS reactions
FROM h LEFT JOIN top USING (pattern_id) LEFT JOIN (SELECT pattern_id, count(*) AS n FROM pl GROUP BY 1) d USING (pattern_id)
LEFT JOIN (SELECT pattern_id, count(*) AS n FROM pl WHERE is_outlier GROUP BY 1) o USING (pattern_id)
LEFT JOIN (SELECT pattern_id, count(*) AS n FROM v WHERE severity = 'error' GROUP BY 1) e USING (pattern_id)
LEFT JOIN (SELECT pattern_id, count(*) AS n FROM f GROUP BY 1) x USING (pattern_id)""")
def audit_join(t: Tables) -> DataFrame:
    """Five pre-aggregated left joins onto the patterns."""
    pl, v, f = t.once("pattern_locations", "location_id", "pattern_id", "is_outlier"), t.once("violations", "id", "pattern_id", "severity"), t.once("feedback", "id", "pattern_id")
    places = pl.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("detections"), F.count_if("is_outlier").alias("outliers"))
    errors = v.where("severity = 'error'").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("errors"))
    return R.fan_in(
        held(t).select("pattern_id", "category"),
        "pattern_id",
        [
            (R.top_value(v, ["pattern_id"], "severity").withColumnRenamed("severity", "top_severity"), {"top_severity": "none"}),
            (places, {"detections": 0, "outliers": 0}),
            (errors, {"errors": 0}),
            (f.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("reactions")), {"reactions": 0}),
        ],
    )


@query("SELECT * EXCLUDE (child_ids, aliases, merged_from) FROM aggregated_patterns QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC) = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return held(t).drop("child_ids", "aliases", "merged_from")


@query(f"WITH {_V} SELECT pattern_id, severity FROM (SELECT pattern_id, severity, count(*) AS n FROM v GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, severity) = 1")
def top_category(t: Tables) -> DataFrame:
    return R.top_value(t.once("violations", "id", "pattern_id", "severity"), ["pattern_id"], "severity")


@query(f"WITH {_HELD} SELECT pattern_id FROM h WHERE NOT EXISTS (SELECT 1 FROM merge_candidates m WHERE m.pattern_b = h.pattern_id)")
def entry_points_antijoin(t: Tables) -> DataFrame:
    """Patterns that no edge leads to; null ends do not hide any."""
    return held(t).select("pattern_id").join(t.merge_candidates.select(F.col("pattern_b").alias("pattern_id")), "pattern_id", "left_anti")


@query(f"WITH {_V}, {_F} SELECT v.id, v.severity FROM v WHERE NOT suppressed AND NOT EXISTS (SELECT 1 FROM f WHERE lower(trim(f.violation_id)) = lower(trim(v.id)) AND f.action IN ('dismiss', 'fix'))")
def needs_review_antijoin(t: Tables) -> DataFrame:
    from quarrymill.functions.keys import loose_key

    done = t.feedback.where(F.col("action").isin("dismiss", "fix")).select(loose_key(F.col("violation_id")).alias("_key")).distinct()
    open_ = t.once("violations", "id", "severity", "suppressed").where("NOT suppressed").withColumn("_key", loose_key(F.col("id")))
    return open_.join(done, "_key", "left_anti").select("id", "severity")


@query(f"WITH {_PL} SELECT file, count(*) AS n FROM pl WHERE file IN (SELECT file FROM violations WHERE is_new) GROUP BY 1")
def changed_files_semijoin(t: Tables) -> DataFrame:
    """Matches in changed files."""
    changed = t.violations.where("is_new").select("file").distinct()
    return t.once("pattern_locations", "location_id", "file").join(changed, "file", "left_semi").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pattern_a, pattern_b, similarity FROM merge_candidates m WHERE pattern_a IS NOT NULL AND pattern_b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM aggregated_patterns p WHERE p.is_dirty AND p.pattern_id IN (m.pattern_a, m.pattern_b))")
def edges_without_dirty(t: Tables) -> DataFrame:
    """Edges neither of whose ends is to be deleted."""
    edges = t.merge_candidates.where("pattern_a IS NOT NULL AND pattern_b IS NOT NULL").select("pattern_a", "pattern_b", "similarity")
    return R.referencing_neither(edges, ["pattern_a", "pattern_b"], t.aggregated_patterns.where("is_dirty"), "pattern_id")


@query("SELECT id, severity, file FROM (SELECT DISTINCT id, severity, file FROM violations) WHERE id > 'vio-8' ORDER BY id LIMIT 50")
def keyset_page(t: Tables) -> DataFrame:
    return R.page(t.violations.select("id", "severity", "file").distinct(), "id", "vio-8", 50)


@query("SELECT DISTINCT id AS id, id AS decoded FROM violations")
def cursor_roundtrip(t: Tables) -> DataFrame:
    ids = t.violations.select("id").distinct()
    return ids.select("id", R.cursor_key(R.cursor(F.col("id"))).alias("decoded"))


@query("SELECT DISTINCT x AS node FROM (SELECT pattern_a AS x FROM merge_candidates UNION SELECT pattern_b FROM merge_candidates) WHERE x IS NOT NULL")
def distinct_union_nodes(t: Tables) -> DataFrame:
    m = t.merge_candidates
    return m.select(F.explode(F.array("pattern_a", "pattern_b")).alias("node")).where("node IS NOT NULL").distinct()


@query(f"""WITH {_HELD} SELECT coalesce(category, 'all') AS category, count(*) AS patterns, CAST(sum(location_count) AS BIGINT) AS locations, round(CAST(sum(CAST(confidence_mean AS DECIMAL(18, 9))) AS DOUBLE) / count(confidence_mean), 6) AS confidence,
round(count(*) FILTER (WHERE is_dirty) / count(*), 6) AS dirty FROM h GROUP BY ROLLUP (category)""")
def health_rollup(t: Tables) -> DataFrame:
    """Each category and all together, in one pass."""
    return held(t).rollup("category").agg(
        F.count(F.lit(1)).alias("patterns"), F.sum("location_count").alias("locations"), F.round(F.sum(F.col("confidence_mean").cast("decimal(18,9)")).cast("double") / F.count("confidence_mean"), 6).alias("confidence"), F.round(F.count_if("is_dirty") / F.count(F.lit(1)), 6).alias("dirty")
    ).withColumn("category", F.coalesce("category", F.lit("all")))


@query(f"""WITH {_V}, s AS (SELECT DISTINCT * FROM scan_history), r AS (SELECT rtrim(root_path, '/') AS root, count(*) AS scans, count(*) FILTER (WHERE status = 'completed') AS completed, max(completed_at) AS last_done FROM s GROUP BY 1),
w AS (SELECT split_part(file, '/', 2) || '/' || split_part(file, '/', 3) AS project, * FROM v),
x AS (SELECT project, count(*) AS violations, count(*) FILTER (WHERE severity = 'error') AS errors, count(DISTINCT file) AS files FROM w GROUP BY 1)
SELECT r.root, r.scans, r.completed, CAST(r.last_done AS BIGINT) AS last_done, coalesce(x.violations, 0) AS violations, coalesce(x.errors, 0) AS errors, coalesce(x.files, 0) AS files FROM r LEFT JOIN x ON x.project = substr(r.root, 2)""")
def dashboard_project_health(t: Tables) -> DataFrame:
    roots = t.once("scan_history", "id", "root_path", "status", "completed_at").groupBy(F.rtrim("root_path", F.lit("/")).alias("root")).agg(
        F.count(F.lit(1)).alias("scans"), F.count_if(F.col("status") == "completed").alias("completed"), F.max("completed_at").cast("bigint").alias("last_done")
    )
    per_project = (
        t.once("violations", "id", "file", "severity").groupBy(F.concat(F.lit("/"), F.split_part("file", F.lit("/"), F.lit(2)), F.lit("/"), F.split_part("file", F.lit("/"), F.lit(3))).alias("root"))
        .agg(F.count(F.lit(1)).alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"), F.countDistinct("file").alias("files"))
    )
    return R.fan_in(roots, "root", [(per_project, {"violations": 0, "errors": 0, "files": 0})])


@query(f"WITH {_V} SELECT pattern_id, count(*) AS n, count(*) FILTER (WHERE NOT suppressed) AS active FROM v GROUP BY 1 ORDER BY n DESC, pattern_id LIMIT 20")
def top_violations(t: Tables) -> DataFrame:
    g = t.once("violations", "id", "pattern_id", "suppressed").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("suppressed")).alias("active"))
    return g.orderBy(F.desc("n"), "pattern_id").limit(20)


@query(f"WITH {_V} SELECT strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d') AS day, severity, count(*) AS n FROM v GROUP BY 1, 2")
def daily_trend(t: Tables) -> DataFrame:
    day = F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd")
    return t.once("violations", "id", "created_at", "severity").groupBy(day.alias("day"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id, date_trunc('month', ts))")
def monthly_keep_latest(t: Tables) -> DataFrame:
    return R.kept_snapshots(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "user_id")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events")
def version_numbers(t: Tables) -> DataFrame:
    return R.numbered_versions(t.events.select("event_id", "user_id", "ts"), "user_id", F.col("ts"), F.col("event_id")).drop("ts")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def version_retention(t: Tables) -> DataFrame:
    return R.latest_per_key(t.events.select("event_id", "user_id", "ts"), ["user_id"], F.desc("ts"), F.desc("event_id"), keep=3).drop("ts")


@query("""WITH a AS (SELECT file, arg_max(matched_text, location_id) AS h FROM pattern_locations WHERE location_id % 3 <> 0 GROUP BY 1), b AS (SELECT file, arg_max(matched_text, location_id) AS h FROM pattern_locations WHERE location_id % 3 <> 1 GROUP BY 1)
SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.file IS NULL THEN 'added' WHEN a.file IS NULL THEN 'removed' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.file = b.file""")
def scan_diff(t: Tables) -> DataFrame:
    """Two states of the files, made of the two thirds of the places that each has; compared by content hash."""
    pl = t.pattern_locations.select("file", "matched_text", "location_id").where("matched_text IS NOT NULL")

    def state(rest: int) -> DataFrame:
        rows = pl.where(F.col("location_id") % 3 != rest)
        return rows.groupBy("file").agg(F.xxhash64(F.max_by("matched_text", "location_id")).alias("h"))

    return R.table_diff(state(0), state(1), "file", "h")


SQL["scan_diff"] = SQL["scan_diff"].replace("WHERE location_id", "WHERE matched_text IS NOT NULL AND location_id")


@query(f"""WITH {_PL}, l AS (SELECT pattern_id, file, line, column_num, max(confidence) AS c FROM pl GROUP BY ALL)
SELECT pattern_id, count(*) AS locations, count(DISTINCT file) AS file_spread, round(CAST(sum(CAST(c AS DECIMAL(18, 9))) AS DOUBLE) / count(c), 6) AS mean, round(coalesce(stddev_samp(c), 0), 6) AS stddev FROM l GROUP BY 1""")
def pattern_grouping(t: Tables) -> DataFrame:
    g = R.pattern_groups(t.pattern_locations.select("pattern_id", "file", "line", "column_num", "confidence"))
    return g.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query(f"""WITH {_PL}, {_HELD}, n AS (SELECT pattern_id, count(*) AS n FROM (SELECT DISTINCT pattern_id, file, line, column_num FROM pl) GROUP BY 1)
SELECT h.pattern_id, h.location_count AS cached, coalesce(n.n, 0) AS counted FROM h LEFT JOIN n USING (pattern_id) WHERE h.location_count <> coalesce(n.n, 0)""")
def counter_reconcile(t: Tables) -> DataFrame:
    counted = t.pattern_locations.select("pattern_id", "file", "line", "column_num").distinct().groupBy("pattern_id").agg(F.count(F.lit(1)).alias("counted"))
    both = R.fan_in(held(t).select("pattern_id", F.col("location_count").alias("cached")), "pattern_id", [(counted, {"counted": 0})])
    return both.where("cached <> counted")


@query(f"""WITH {_HELD}, m AS (SELECT DISTINCT least(pattern_a, pattern_b) AS a, greatest(pattern_a, pattern_b) AS b FROM merge_candidates WHERE decision = 'auto_merge' AND pattern_a <> pattern_b),
x AS (SELECT CASE WHEN p.location_count > q.location_count OR (p.location_count = q.location_count AND a < b) THEN a ELSE b END AS p, CASE WHEN p.location_count > q.location_count OR (p.location_count = q.location_count AND a < b) THEN b ELSE a END AS c
  FROM m JOIN h p ON p.pattern_id = a JOIN h q ON q.pattern_id = b),
w AS (SELECT p, c AS pattern_id FROM x UNION SELECT p, p FROM x)
SELECT p AS parent_id, count(DISTINCT (file, coalesce(line, -1), coalesce(column_num, -1))) AS locations, count(DISTINCT file) AS file_spread FROM w JOIN pattern_locations USING (pattern_id) GROUP BY 1""")
def hierarchy_merge(t: Tables) -> DataFrame:
    m = t.merge_candidates.where("decision = 'auto_merge' AND pattern_a <> pattern_b").select(F.least("pattern_a", "pattern_b").alias("a"), F.greatest("pattern_a", "pattern_b").alias("b")).distinct()
    return R.merge_children(held(t), t.pattern_locations, m)


@query(f"WITH {_HELD} SELECT category, count(*) FILTER (WHERE is_dirty) AS upserts, count(*) FILTER (WHERE parent_id IS NOT NULL) AS removals, CAST(coalesce(sum(location_count) FILTER (WHERE parent_id IS NULL), 0) AS BIGINT) AS root_locations FROM h GROUP BY 1")
def gold_layer(t: Tables) -> DataFrame:
    root = F.col("parent_id").isNull()
    return held(t).groupBy("category").agg(
        F.count_if("is_dirty").alias("upserts"), F.count_if(~root).alias("removals"), F.coalesce(F.sum(F.when(root, F.col("location_count"))), F.lit(0)).alias("root_locations")
    )


@query("""SELECT 'exact' AS kind, count(*) AS n FROM violations WHERE owasp_category = 'A03' UNION ALL SELECT 'prefixed', count(*) FROM violations WHERE starts_with(owasp_category, 'A0') UNION ALL SELECT 'none', count(*) FROM violations WHERE owasp_category IS NULL""")
def conjunctive_filters(t: Tables) -> DataFrame:
    o = F.col("owasp_category")
    kinds = {"exact": o == "A03", "prefixed": o.startswith("A0"), "none": o.isNull()}
    counts = t.violations.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    return counts.unpivot([], list(kinds), "kind", "n")


@query("""SELECT id, root_path, started_at, lag(started_at) OVER (PARTITION BY root_path ORDER BY started_at, id) AS before FROM (SELECT DISTINCT id, rtrim(root_path, '/') AS root_path, started_at FROM scan_history)""")
def previous_scan(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    s = t.scan_history.select("id", F.rtrim("root_path", F.lit("/")).alias("root_path"), "started_at").distinct()
    return s.withColumn("before", F.lag("started_at").over(Window.partitionBy("root_path").orderBy("started_at", "id")))
