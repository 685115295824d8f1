"""Queries of sources, reports, matching and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import matching
from quarrymill.queries.registry import Tables, collection
from quarrymill.sources import readers, reports
from quarrymill.streaming import flows

QUERIES, SQL, query = collection()

_V = "v AS (SELECT DISTINCT * FROM violations WHERE line IS NOT NULL AND file IS NOT NULL AND message IS NOT NULL AND rule_id IS NOT NULL)"


def findings(t: Tables) -> DataFrame:
    v = t.once("violations", "id", "file", "line", "message", "rule_id", "severity", "suppressed")
    return v.where("line IS NOT NULL AND file IS NOT NULL AND message IS NOT NULL AND rule_id IS NOT NULL")


@query(f"""WITH {_V} SELECT id, to_json({{'ruleId': rule_id, 'level': CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' WHEN 'quality' THEN 'note' WHEN 'info' THEN 'note' ELSE 'none' END, 'message': {{'text': message}}, 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': file}}, 'region': {{'startLine': CAST(line AS BIGINT)}}}}}}]}})::VARCHAR AS result FROM v""")
def sarif_json(t: Tables) -> DataFrame:
    return reports.sarif_results(findings(t))


@query(f"""WITH {_V} SELECT id, to_json({{'description': message, 'check_name': rule_id, 'fingerprint': md5(file || ':' || CAST(line AS BIGINT) || ':' || rule_id), 'severity': CASE severity WHEN 'error' THEN 'critical' WHEN 'warning' THEN 'major' WHEN 'quality' THEN 'minor' ELSE 'info' END, 'location': {{'path': file, 'lines': {{'begin': CAST(line AS BIGINT)}}}}}})::VARCHAR AS issue FROM v""")
def code_quality_json(t: Tables) -> DataFrame:
    return reports.code_quality(findings(t))


@query(f"WITH {_V} SELECT id, '::' || CASE severity WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'notice' END || ' file=' || file || ',line=' || CAST(line AS BIGINT) || '::' || message AS line FROM v")
def annotation_lines(t: Tables) -> DataFrame:
    return reports.annotations(findings(t))


@query(f"""WITH {_V}, g AS (SELECT rule_id AS suite, count(*) AS tests, count(*) FILTER (WHERE NOT suppressed) AS failures FROM v GROUP BY 1) SELECT *, '<testsuite name="' || suite || '" tests="' || tests || '" failures="' || failures || '">' AS element FROM g""")
def junit_suites(t: Tables) -> DataFrame:
    return reports.junit_cases(findings(t))


@query("SELECT event_id, to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type})::VARCHAR AS row FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 200")
def cloud_row_export(t: Tables) -> DataFrame:
    return readers.rows_after(t.events.select("event_id", "user_id", "event_type"), "event_id", 100, 200)


@query("""WITH l AS (SELECT DISTINCT location_id, matched_text FROM pattern_locations), n AS (SELECT location_id, unnest(list_distinct(regexp_extract_all(matched_text, '(?:process\\.env\\.|process\\.env\\[["'']|os\\.environ\\[["'']|os\\.environ\\.get\\(["'']|os\\.getenv\\(["'']|ENV\\[["'']|ENV\\.fetch\\(["'']|System\\.getenv\\("|env::var\\("|os\\.Getenv\\("|getenv\\(["''])([A-Za-z_][A-Za-z0-9_]*)', 1))) AS name FROM l) SELECT * FROM n""")
def env_references(t: Tables) -> DataFrame:
    return readers.env_references(t.pattern_locations.select("location_id", "matched_text").distinct(), "location_id", "matched_text")


@query("""SELECT doc_id, trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1)) AS title FROM documents WHERE source = 'adr' AND trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1)) <> ''""")
def decision_titles(t: Tables) -> DataFrame:
    return readers.decision_records(t.documents.where("source = 'adr'"), "doc_id", "text").select("doc_id", "title")


@query("""WITH f AS (SELECT DISTINCT file FROM pattern_locations), d AS (SELECT regexp_extract(file, '([^/]+)$', 1) AS name, min(file) AS target, count(*) AS n FROM f GROUP BY 1), v AS (SELECT DISTINCT id, file, pattern_id FROM violations),
s AS (SELECT v.id, 0 AS r, f.file AS target FROM v JOIN f ON f.file = v.file UNION ALL SELECT v.id, 1, min(p.file) FROM v JOIN pattern_locations p ON p.pattern_id = v.pattern_id GROUP BY 1 UNION ALL SELECT v.id, 2, d.target FROM v JOIN d ON d.n = 1 AND d.name = regexp_extract(v.file, '([^/]+)$', 1))
SELECT id, target, ['same_file', 'pattern', 'fuzzy'][r + 1] AS strategy, CAST([0.95, 0.6, 0.4][r + 1] AS DOUBLE) AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY r, target) = 1""")
def call_resolution(t: Tables) -> DataFrame:
    """A finding's file by three strategies: the same file, one with its pattern, the only one of its name."""
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    files = t.pattern_locations.select("file").distinct()
    v = t.violations.select("id", "file", "pattern_id").distinct()
    same = v.join(files, "file").select("id", F.col("file").alias("target"))
    by_pattern = v.join(t.pattern_locations.groupBy("pattern_id").agg(F.min("file").alias("target")), "pattern_id").select("id", "target")
    unique = files.groupBy(name("file").alias("_n")).agg(F.min("file").alias("target"), F.count(F.lit(1)).alias("_c")).where("_c = 1")
    fuzzy = v.withColumn("_n", name("file")).join(unique, "_n").select("id", "target")
    return matching.first_strategy(v, "id", [("same_file", 0.95, same), ("pattern", 0.6, by_pattern), ("fuzzy", 0.4, fuzzy)])


@query("SELECT DISTINCT user_id, event_type FROM events")
def ttl_dedup(t: Tables) -> DataFrame:
    """A stream of events, repeats of a user's event type dropped within the watermark."""
    s = flows.stream_of(t.spark, f"{t.sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.run_once(flows.without_repeats(s, ["user_id", "event_type"], "ts", "4000 days")).select("user_id", "event_type")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def session_state(t: Tables) -> DataFrame:
    s = flows.stream_of(t.spark, f"{t.sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.run_once(flows.sessions(s, "ts", "user_id"), "complete")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def incremental_aggregate(t: Tables) -> DataFrame:
    return flows.merged_totals(t.spark, flows.stream_of(t.spark, f"{t.sf}/events.parquet"), "event_type", "value").withColumn("total", F.round("total", 4))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(t: Tables) -> DataFrame:
    s = flows.stream_of(t.spark, f"{t.sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return flows.run_once(flows.counts_by_window(s, "ts", "event_type", "1 day", "1 day"), "complete")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nr FROM events")
def causal_delivery(t: Tables) -> DataFrame:
    """Numbered changes of each user, streamed and delivered without gaps."""
    from pyspark.sql import Window

    from quarrymill.plans.session import cut

    e = cut(t.events.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("nr")))
    return flows.run_once(flows.delivered_in_order(flows.stream_of(t.spark, e._quarrymill_path), "user_id", "nr"))
