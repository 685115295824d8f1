"""Queries of upkeep, conventions and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import matching, upkeep
from quarrymill.operators.relational import latest_per_key
from quarrymill.operators.text import convention, pattern_counts
from quarrymill.queries.registry import Tables, collection
from quarrymill.queries.relational import held
from quarrymill.queries.states import once

QUERIES, SQL, query = collection()

_EV = "e AS (SELECT event_id, min(recorded_at) AS ts, min(memory_id) AS memory_id, min(replace(lower(event_type), '_', '')) AS kind, min(delta) AS delta, min(actor_id) AS actor, min(actor_type) AS actor_type FROM memory_events GROUP BY 1)"
_L = "l AS (SELECT DISTINCT location_id, file, pattern_id, matched_text FROM pattern_locations)"
NOW = 1760000000


def texts(t: Tables) -> DataFrame:
    return t.pattern_locations.select("location_id", "file", "pattern_id", "matched_text").distinct()


@query(f"WITH v AS (SELECT DISTINCT * FROM violations) SELECT id FROM v WHERE created_at >= {NOW} - (CASE WHEN severity = 'error' THEN 365 WHEN severity = 'warning' THEN 180 ELSE 120 END) * 86400")
def tiered_retention(t: Tables) -> DataFrame:
    return upkeep.retained(t.once("violations", "id", "created_at", "severity"), "created_at", F.lit(NOW), {"error": 365, "warning": 180}, "severity", 120).select("id")


@query(f"WITH {_L} SELECT location_id FROM l WHERE pattern_id NOT IN (SELECT pattern_id FROM aggregated_patterns)")
def orphan_cleanup(t: Tables) -> DataFrame:
    return texts(t).join(t.aggregated_patterns.select("pattern_id"), "pattern_id", "left_anti").select("location_id")


@query(f"WITH {_EV}, s AS (SELECT memory_id, max(event_id) AS upto FROM e WHERE ts < TIMESTAMP '2025-05-01' GROUP BY 1) SELECT event_id FROM e JOIN s USING (memory_id) WHERE event_id <= upto")
def event_compaction(t: Tables) -> DataFrame:
    e = once(t).select("event_id", "memory_id", "ts")
    s = e.where("ts < TIMESTAMP '2025-05-01'").groupBy("memory_id").agg(F.max("event_id").alias("upto"))
    return upkeep.compactable(e, "memory_id", "event_id", s).select("event_id")


@query(f"WITH {_EV}, s AS (SELECT memory_id, max(event_id) AS upto FROM e WHERE ts < TIMESTAMP '2025-05-01' GROUP BY 1) SELECT memory_id, count(*) AS pending FROM e LEFT JOIN s USING (memory_id) WHERE upto IS NULL OR event_id > upto GROUP BY 1 HAVING count(*) >= 10")
def snapshot_triggers(t: Tables) -> DataFrame:
    e = once(t).select("event_id", "memory_id", "ts")
    s = e.where("ts < TIMESTAMP '2025-05-01'").groupBy("memory_id").agg(F.max("event_id").alias("upto"))
    return upkeep.snapshot_due(e, "memory_id", "event_id", s, 10)


_NAMES = """n AS (SELECT file, unnest(list_distinct(regexp_extract_all(matched_text, '[A-Za-z_][A-Za-z0-9_]*'))) AS name FROM l), c AS (SELECT regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) AS ext, file, name, CASE WHEN regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)+') THEN 'snake'
WHEN regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)+') THEN 'upper_snake' WHEN regexp_full_match(name, '[a-z][a-z0-9]*([A-Z][a-z0-9]*)+') THEN 'camel' WHEN regexp_full_match(name, '([A-Z][a-z0-9]+)+') THEN 'pascal' WHEN regexp_full_match(name, '[a-z0-9]+') THEN 'lower' ELSE 'other' END AS style FROM n)"""


def styles(t: Tables) -> DataFrame:
    names = texts(t).select("file", F.explode(F.array_distinct(F.regexp_extract_all("matched_text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("name"))
    return names.select(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1).alias("ext"), "file", "name", convention(F.col("name")).alias("style"))


@query(f"""WITH {_L}, {_NAMES}, k AS (SELECT ext, style, count(*) AS n FROM c WHERE style <> 'lower' GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY ext) AS share FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY n DESC, style) AS r, coalesce(lead(share) OVER (PARTITION BY ext ORDER BY n DESC, style), 0) AS nx FROM s)
SELECT ext, style, n, round(share, 6) AS share, round(share - nx, 6) AS consistency, share >= 0.3 AS dominant FROM r WHERE r = 1""")
def gene_build(t: Tables) -> DataFrame:
    """The naming style that prevails for each kind of file."""
    d = upkeep.dominant(styles(t).where("style <> 'lower'"), "ext", "style")
    return d.withColumns({"share": F.round("share", 6), "consistency": F.round("consistency", 6)})


@query(f"""WITH {_L}, {_NAMES}, k AS (SELECT ext, style, count(*) AS n FROM c WHERE style <> 'lower' GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY ext) AS share FROM k), b AS (SELECT ext, style FROM s WHERE share >= 0.6 QUALIFY row_number() OVER (PARTITION BY ext ORDER BY n DESC, style) = 1)
SELECT c.file, c.style, count(*) AS names FROM c JOIN b USING (ext) WHERE c.style <> 'lower' AND c.style <> b.style GROUP BY 1, 2""")
def convention_deviants(t: Tables) -> DataFrame:
    d = upkeep.deviants(styles(t).where("style <> 'lower'"), "ext", "style", 0.6)
    return d.groupBy("file", "style").agg(F.count(F.lit(1)).alias("names"))


@query("""WITH c AS (SELECT pattern_a AS id, CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END AS s FROM merge_candidates UNION ALL SELECT pattern_b, CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END FROM merge_candidates) SELECT id, count(*) AS sources, round(least(1, max(s) + 0.05 * (count(*) - 1)), 6) AS score FROM c WHERE id IS NOT NULL AND s >= 0 GROUP BY 1""")
def candidate_merge(t: Tables) -> DataFrame:
    s = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    c = t.merge_candidates.select(F.explode(F.array("pattern_a", "pattern_b")).alias("id"), s.alias("s")).where("id IS NOT NULL AND s >= 0")
    return upkeep.merged_candidates(c, "id", "s").withColumn("score", F.round("score", 6))


@query(f"""WITH {_EV}, k AS (SELECT delta->>'$.memory_type' AS kind, list_sort(list_distinct(CAST(json_extract(delta, '$.tags') AS VARCHAR[]))) AS tags, actor FROM e WHERE kind = 'created' AND json_valid(delta)) SELECT kind, array_to_string(tags, ',') AS tags, count(DISTINCT actor) AS agents, count(*) AS n FROM k WHERE kind IS NOT NULL AND len(tags) > 0 GROUP BY 1, 2 HAVING count(DISTINCT actor) >= 2""")
def consensus_by_tags(t: Tables) -> DataFrame:
    d = F.from_json("delta", "memory_type string, tags array<string>")
    k = once(t).where("kind = 'created'").select(d["memory_type"].alias("kind"), d["tags"].alias("tags"), "actor").where("kind IS NOT NULL AND size(tags) > 0")
    return upkeep.consensus(k, "kind", "tags", "actor", 2).withColumn("tags", F.array_join("tags", ","))


@query("""WITH h AS (SELECT * FROM aggregated_patterns QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC) = 1), x AS (SELECT pattern_id, unnest([CASE WHEN NOT coalesce(starts_with(pattern_id, category || '-'), false) THEN 'naming' END, CASE WHEN NOT coalesce(file_spread <= location_count, false) THEN 'spread' END, CASE WHEN NOT coalesce(outlier_count <= location_count, false) THEN 'outliers' END, CASE WHEN NOT coalesce(len(child_ids) <= 5, false) THEN 'size' END]) AS broken FROM h) SELECT pattern_id, broken FROM x WHERE broken IS NOT NULL""")
def constraint_verification(t: Tables) -> DataFrame:
    p = F.col
    checks = {"naming": F.startswith("pattern_id", F.concat("category", F.lit("-"))), "spread": p("file_spread") <= p("location_count"), "outliers": p("outlier_count") <= p("location_count"), "size": F.when(p("child_ids").isNotNull(), F.size("child_ids") <= 5)}
    return upkeep.invariants(held(t), "pattern_id", checks)


@query("""WITH f AS (SELECT DISTINCT * FROM feedback), g AS (SELECT detector_id, count(*) AS n, count(*) FILTER (WHERE coalesce(action = 'dismiss', false)) AS bad FROM f GROUP BY 1) SELECT detector_id, round(CASE WHEN n < 5 THEN 1 ELSE least(2, 1 + bad / n * 0.5) END, 6) AS weight FROM g""")
def adaptive_weights(t: Tables) -> DataFrame:
    f = t.once("feedback", "id", "detector_id", "action").withColumn("bad", F.coalesce(F.col("action") == "dismiss", F.lit(False)))
    return upkeep.adaptive_weights(f, "detector_id", "bad").withColumn("weight", F.round("weight", 6))


@query("""SELECT doc_id, CASE WHEN b > 0 AND b >= f AND b >= d THEN 'fix' WHEN f > 0 AND f >= d THEN 'feature' WHEN d > 0 THEN 'upkeep' ELSE 'other' END AS kind FROM (SELECT doc_id, contains(x, 'fix')::INT + contains(x, 'bug')::INT + contains(x, 'revert')::INT AS b, contains(x, 'add')::INT + contains(x, 'new')::INT + contains(x, 'feature')::INT AS f, contains(x, 'test')::INT + contains(x, 'doc')::INT + contains(x, 'refactor')::INT AS d
FROM (SELECT doc_id, lower(text) AS x FROM documents WHERE source = 'commit_log' AND text IS NOT NULL))""")
def commit_categories(t: Tables) -> DataFrame:
    c = t.documents.where("source = 'commit_log' AND text IS NOT NULL")
    return c.select("doc_id", upkeep.keyword_class(F.col("text"), [("fix", ("fix", "bug", "revert")), ("feature", ("add", "new", "feature")), ("upkeep", ("test", "doc", "refactor"))], "other").alias("kind"))


@query("SELECT v.id, NOT EXISTS (SELECT 1 FROM feedback f WHERE f.pattern_id = v.pattern_id AND f.action = 'suppress') AS is_new FROM (SELECT DISTINCT id, pattern_id FROM violations) v")
def baseline_difference(t: Tables) -> DataFrame:
    """Findings whose pattern is not in the frozen set."""
    frozen = t.feedback.where("action = 'suppress'").select("pattern_id").distinct().withColumn("_in", F.lit(True))
    return t.violations.select("id", "pattern_id").distinct().join(frozen, "pattern_id", "left").select("id", F.col("_in").isNull().alias("is_new"))


_CRYPTO = {"weak_hash": "(?i)\\b(?:md5|sha1)\\b", "weak_cipher": "(?i)\\b(?:des|rc4|ecb)\\b", "random": "(?i)\\bmath\\.random\\b|\\brand\\(", "plain_http": "http://[a-z0-9.-]+"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM documents WHERE regexp_matches(text, '{p}')" for k, p in _CRYPTO.items()))
def crypto_scan(t: Tables) -> DataFrame:
    return pattern_counts(t.documents, "doc_id", "text", _CRYPTO).withColumn("n", F.col("n").cast("bigint"))


@query(f"""WITH {_L}, c AS (SELECT location_id, unnest(regexp_extract_all(matched_text, '\\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\\b *= *')) AS d FROM l) SELECT location_id, trim(split_part(d, '=', 1)) AS name FROM c""")
def constant_extraction(t: Tables) -> DataFrame:
    c = texts(t).select("location_id", F.explode(F.regexp_extract_all("matched_text", F.lit(r"(\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b *= *)"), F.lit(1))).alias("d"))
    return c.select("location_id", F.trim(F.split_part("d", F.lit("="), F.lit(1))).alias("name"))


@query(f"""WITH {_L}, c AS (SELECT location_id, pattern_id, len(string_split(matched_text, chr(10))) AS lines, regexp_matches(matched_text, '(?:for|while|each)\\b') AS loop, regexp_matches(matched_text, '\\.(?:query|find|select|fetch)[A-Za-z]*\\(') AS asks FROM l WHERE matched_text <> '') SELECT location_id, lines FROM c WHERE loop AND asks""")
def n_plus_one(t: Tables) -> DataFrame:
    """Places with a query inside a loop."""
    c = texts(t).where("matched_text <> ''")
    hit = F.col("matched_text").rlike(r"(?:for|while|each)\b") & F.col("matched_text").rlike(r"\.(?:query|find|select|fetch)[A-Za-z]*\(")
    return c.where(hit).select("location_id", F.size(F.split("matched_text", "\n")).cast("bigint").alias("lines"))


@query("""WITH g AS (SELECT rule_id, count(*) AS n, count(*) FILTER (WHERE severity = 'error' AND NOT suppressed) AS errors FROM (SELECT DISTINCT * FROM violations) GROUP BY 1) SELECT rule_id, CASE WHEN split_part(rule_id, '/', 1) IN ('security', 'auth') AND errors > 0 THEN 'failed' WHEN errors / n > 0.5 THEN 'failed' ELSE 'passed' END AS state FROM g""")
def gate_results(t: Tables) -> DataFrame:
    g = t.once("violations", "id", "rule_id", "severity", "suppressed").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("severity") == "error") & ~F.col("suppressed")).alias("errors"))
    strict = F.split_part("rule_id", F.lit("/"), F.lit(1)).isin("security", "auth") & (F.col("errors") > 0)
    return g.select("rule_id", F.when(strict | (F.col("errors") / F.col("n") > 0.5), "failed").otherwise("passed").alias("state"))


@query()
def gate_order(t: Tables) -> DataFrame:
    """Gates of a small fixed graph in the order in which they run, with what each came to."""
    depends = {"patterns": [], "constraints": ["patterns"], "security": [], "tests": ["constraints"], "errors": ["security"], "regression": ["tests", "errors"]}
    states = matching.run_gates(depends, {g: g != "security" for g in depends})
    return t.spark.createDataFrame([(k, g, s) for k, (g, s) in enumerate(states)], "place int, gate string, state string")


@query(f"""WITH v AS (SELECT DISTINCT id, severity, created_at, is_new FROM violations), a AS (SELECT *, ({NOW} - created_at) / 86400.0 / 400 AS r FROM v) SELECT id, CASE WHEN is_new THEN severity WHEN r < 0.25 THEN 'info' WHEN r < 0.5 AND severity = 'error' THEN 'warning' ELSE severity END AS effective FROM a""")
def progressive_severity(t: Tables) -> DataFrame:
    """Findings in old files are weighed up only as they age."""
    r, s = (F.lit(NOW) - F.col("created_at")) / 86400.0 / 400, F.col("severity")
    v = t.violations.select("id", "severity", "created_at", "is_new").distinct()
    return v.select("id", F.when(F.col("is_new"), s).when(r < 0.25, "info").when((r < 0.5) & (s == "error"), "warning").otherwise(s).alias("effective"))


@query("""WITH f AS (SELECT DISTINCT * FROM feedback) SELECT detector_id, count(*) AS n, round(count(*) FILTER (WHERE dismissal_reason = 'false_positive') / count(*), 6) AS false_positive, round(count(*) FILTER (WHERE action = 'fix') / count(*), 6) AS acted, count(*) >= 10 AND count(*) FILTER (WHERE dismissal_reason = 'false_positive') / count(*) > 0.2 AS disabled FROM f GROUP BY 1""")
def feedback_tracker(t: Tables) -> DataFrame:
    g = t.once("feedback", "id", "detector_id", "dismissal_reason", "action").groupBy("detector_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dismissal_reason") == "false_positive").alias("fp"), F.count_if(F.col("action") == "fix").alias("fix"))
    fp = F.col("fp") / F.col("n")
    return g.select("detector_id", "n", F.round(fp, 6).alias("false_positive"), F.round(F.col("fix") / F.col("n"), 6).alias("acted"), ((F.col("n") >= 10) & (fp > 0.2)).alias("disabled"))


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC) AS r FROM (SELECT DISTINCT pattern_id, updated_at, location_count, confidence_mean FROM aggregated_patterns)) SELECT a.pattern_id, a.location_count - b.location_count AS grown, a.confidence_mean IS DISTINCT FROM b.confidence_mean AS moved FROM p a JOIN p b ON a.pattern_id = b.pattern_id AND a.r = 1 AND b.r = 2")
def version_difference(t: Tables) -> DataFrame:
    """The holding version of a pattern against the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("pattern_id").orderBy("updated_at")
    p = t.aggregated_patterns.select("pattern_id", "updated_at", "location_count", "confidence_mean").distinct().select("*", F.lag(F.struct("location_count", "confidence_mean")).over(w).alias("_p"))
    last = latest_per_key(p, ["pattern_id"], F.desc("updated_at")).where("_p IS NOT NULL")
    return last.select("pattern_id", (F.col("location_count") - F.col("_p.location_count")).alias("grown"), (~F.col("confidence_mean").eqNullSafe(F.col("_p.confidence_mean"))).alias("moved"))


@query("""WITH h AS (SELECT * FROM aggregated_patterns QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC) = 1) SELECT category, count(*) FILTER (WHERE outlier_count / location_count <= 0.5 AND confidence_mean >= 0.8 AND location_count >= 3) AS approve, count(*) FILTER (WHERE confidence_mean < 0.5) AS review, count(*) AS n FROM h WHERE location_count > 0 GROUP BY 1""")
def auto_approve(t: Tables) -> DataFrame:
    h = held(t).where("location_count > 0")
    return h.groupBy("category").agg(F.count_if((F.col("outlier_count") / F.col("location_count") <= 0.5) & (F.col("confidence_mean") >= 0.8) & (F.col("location_count") >= 3)).alias("approve"), F.count_if(F.col("confidence_mean") < 0.5).alias("review"), F.count(F.lit(1)).alias("n"))
