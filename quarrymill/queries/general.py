"""Queries of the general problems 1, 2, 3 and 6, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import changefeed, hierarchy, references, trailing
from quarrymill.functions.keys import day_text
from quarrymill.plans.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return trailing.silences_and_surges(table(spark, sf, "bridge_metrics"))


def p1_trailing(spark: SparkSession, sf: str) -> DataFrame:
    t = trailing.metric_trailing(table(spark, sf, "bridge_metrics"))
    return t.select("metric_name", day_text(F.col("day")).alias("day"), "total_7", "average_7", "total_30", "average_30")


def _sides(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, t) for t in ("feedback", "violations", "bridge_grounding_results", "memory_events")]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_references(*_sides(spark, sf)).select("source_table", "row_id", "reason")


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_counts(*_sides(spark, sf))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.pattern_links(table(spark, sf, "aggregated_patterns"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.solve_forest(_links(spark, sf)).select(F.col("id").alias("pattern_id"), "root_id", "depth")


def p3_paths(spark: SparkSession, sf: str) -> DataFrame:
    solved = hierarchy.solve_forest(_links(spark, sf), with_path=True)
    return solved.select(F.col("id").alias("pattern_id"), "root_id", "depth", F.concat_ws("/", "path").alias("path"))


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.solve_forest(_links(spark, sf), with_path=True)).select("ancestor", F.col("id").alias("descendant"), F.col("steps").cast("bigint").alias("steps"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return changefeed.live_memories(table(spark, sf, "memory_events"))


def p6_state(spark: SparkSession, sf: str) -> DataFrame:
    return changefeed.apply_changes(table(spark, sf, "memory_events"))


_SERIES = """
WITH s AS (SELECT DISTINCT id, lower(trim(metric_name)) AS metric_name, metric_value AS v,
    (CASE WHEN recorded_at >= 100000000000 THEN recorded_at // 1000 ELSE recorded_at END) // 86400 AS day FROM bridge_metrics WHERE metric_value >= 0),
d AS (SELECT metric_name, day, sum(v) AS v, count(*) AS n FROM s GROUP BY 1, 2),
b AS (SELECT metric_name, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
f AS (SELECT metric_name, lo, unnest(generate_series(lo, hi)) AS day FROM b),
t AS (SELECT f.metric_name, f.lo, f.day, coalesce(d.v, 0) AS v, coalesce(d.n, 0) AS n FROM f LEFT JOIN d USING (metric_name, day)),
w AS (SELECT *, sum(v) OVER s7 AS t7, sum(v) OVER s30 AS t30, sum(n) OVER s7 AS n7 FROM t WINDOW
    s7 AS (PARTITION BY metric_name ORDER BY day ROWS 6 PRECEDING), s30 AS (PARTITION BY metric_name ORDER BY day ROWS 29 PRECEDING)),
x AS (SELECT *, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS d FROM w)
"""
_LIFE = """
WITH e AS (SELECT event_id, min(recorded_at) AS ts, min(lower(trim(memory_id))) AS k, min(replace(lower(event_type), '_', '')) AS kind FROM memory_events GROUP BY 1),
c AS (SELECT k, min(ts) AS ts FROM e WHERE kind = 'created' GROUP BY 1),
v AS (SELECT lower(trim(id)) AS k, min(created_at) AS ts FROM violations GROUP BY 1),
f AS (SELECT DISTINCT id, nullif(lower(trim(violation_id)), '') AS k, created_at FROM feedback),
g AS (SELECT DISTINCT id, nullif(lower(trim(memory_id)), '') AS k, created_at FROM bridge_grounding_results),
gl AS (SELECT g.*, c.ts AS first_at, (SELECT arg_max(kind, (e.ts, e.event_id)) FROM e WHERE e.k = g.k AND kind IN ('created', 'archived', 'restored') AND e.ts <= make_timestamp(g.created_at * 1000000)) AS last FROM g LEFT JOIN c USING (k) WHERE g.k IS NOT NULL),
r AS (SELECT 'feedback' AS source_table, f.id AS row_id, f.created_at, CASE WHEN v.ts IS NULL THEN 'missing' WHEN v.ts > f.created_at THEN 'late' END AS reason FROM f LEFT JOIN v USING (k) WHERE f.k IS NOT NULL
  UNION ALL SELECT 'bridge_grounding_results', id, created_at, CASE WHEN first_at IS NULL THEN 'missing' WHEN first_at > make_timestamp(created_at * 1000000) THEN 'late' WHEN last = 'archived' THEN 'deleted' END FROM gl)
"""
_TREE = """
WITH RECURSIVE h AS (SELECT * FROM aggregated_patterns QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC) = 1),
c AS (SELECT child AS pattern_id, min(pattern_id) AS by_id FROM (SELECT pattern_id, unnest(child_ids) AS child FROM h) GROUP BY 1),
l AS (SELECT h.pattern_id AS id, CASE WHEN h.parent_id IN (SELECT pattern_id FROM h) THEN h.parent_id ELSE c.by_id END AS parent FROM h LEFT JOIN c USING (pattern_id)),
u AS (SELECT id, id AS ts, [id] AS way, false AS looped FROM l
  UNION ALL SELECT u.id, l.parent, list_append(u.way, l.parent), list_contains(u.way, l.parent) FROM u JOIN l ON u.ts = l.id WHERE NOT u.looped AND l.parent IS NOT NULL),
e AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(way) DESC) = 1),
p AS (SELECT id AS pattern_id, CASE WHEN looped THEN list_min(way[list_position(way, ts):]) ELSE ts END AS root_id,
  CASE WHEN looped THEN -1 ELSE len(way) - 1 END AS depth, CASE WHEN looped THEN '' ELSE array_to_string(list_reverse(way), '/') END AS path, way FROM e)
"""
_STATE = """
WITH e AS (SELECT event_id, min(recorded_at) AS ts, min(memory_id) AS memory_id, min(replace(lower(event_type), '_', '')) AS kind, min(delta) AS delta, min(schema_version) AS sv FROM memory_events GROUP BY 1),
o AS (SELECT *, CASE WHEN json_valid(delta) THEN delta END AS d FROM e),
k AS (SELECT *, CASE WHEN kind = 'created' THEN d->>'$.content_hash' WHEN sv = 1 THEN d->>'$.new_content_hash' ELSE d->>'$.content_hash.new' END AS h FROM o WHERE d IS NOT NULL),
b AS (SELECT memory_id, max((ts, event_id)) AS born FROM k WHERE kind = 'created' GROUP BY 1),
s AS (SELECT b.memory_id,
  arg_max(struct_pack(h := h), (ts, event_id)) FILTER (WHERE kind = 'created' OR (kind = 'contentupdated' AND h IS NOT NULL)) AS hash,
  arg_max(kind, (ts, event_id)) FILTER (WHERE kind IN ('created', 'archived', 'restored')) AS last, bool_or(kind IN ('superseded', 'consolidated')) AS superseded
  FROM k JOIN b ON k.memory_id = b.memory_id AND (k.ts, k.event_id) >= b.born GROUP BY 1)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_trailing, p2_found, p2_counts, p3_found, p3_paths, p3_descendants, p6_found, p6_state)}

SQL = {
    "p1_found": _SERIES + "SELECT metric_name, d AS day, 'silent' AS kind FROM x WHERE n7 = 0 UNION ALL SELECT metric_name, d, 'surge' FROM x WHERE day >= lo + 29 AND t7 / 7 > 2 * (t30 / 30)",
    "p1_trailing": _SERIES + "SELECT metric_name, d AS day, t7 AS total_7, t7 / 7 AS average_7, t30 AS total_30, t30 / 30 AS average_30 FROM x",
    "p2_found": _LIFE + "SELECT source_table, row_id, reason FROM r WHERE reason IS NOT NULL",
    "p2_counts": _LIFE + "SELECT source_table, strftime(make_timestamp(created_at * 1000000), '%Y-%m') AS period, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_found": _TREE + "SELECT pattern_id, root_id, depth FROM p",
    "p3_paths": _TREE + "SELECT pattern_id, root_id, depth, path FROM p",
    "p3_descendants": _TREE + "SELECT ancestor, pattern_id AS descendant, steps FROM (SELECT pattern_id, unnest(way[2:]) AS ancestor, unnest(generate_series(1, len(way) - 1)) AS steps FROM p WHERE depth > 0)",
    "p6_found": _STATE + "SELECT memory_id, hash.h AS content_hash FROM s WHERE last <> 'archived' AND NOT superseded",
    "p6_state": _STATE + "SELECT memory_id, hash.h AS content_hash, last = 'archived' AS archived, superseded FROM s",
}
