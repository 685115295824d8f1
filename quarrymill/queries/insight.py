"""Queries over histories of memories, evidence, agents and alerts, upkeep of stores, and ranked and reported results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.keys import loose_key
from quarrymill.operators import graph, hierarchy, insight, matching, merges, retrieval, statistics, text, vectors
from quarrymill.plans.session import scratch
from quarrymill.queries.flows import _V, findings
from quarrymill.queries.registry import Tables, collection
from quarrymill.queries.relational import held
from quarrymill.queries.states import _EV, _H, once
from quarrymill.queries.statistics import _DAILY, daily
from quarrymill.streaming import flows

QUERIES, SQL, query = collection()

_CAUSED = f"{_EV}, cb AS (SELECT event_id, min(try_cast(nullif(regexp_extract(caused_by, '^evt:([0-9]+)$', 1), '') AS BIGINT)) AS parent FROM memory_events GROUP BY 1), l AS (SELECT CAST(cb.event_id AS VARCHAR) AS id, CAST(p.event_id AS VARCHAR) AS parent FROM cb LEFT JOIN cb p ON p.event_id = cb.parent)"


def _causes(t: Tables) -> DataFrame:
    number = F.expr("try_cast(nullif(regexp_extract(caused_by, '^evt:([0-9]+)$', 1), '') AS BIGINT)")
    own = t.memory_events.groupBy("event_id").agg(F.min(number).alias("parent"))
    known = own.select(F.col("event_id").alias("parent"), F.lit(True).alias("_known"))
    return own.join(known, "parent", "left").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("_known"), F.col("parent").cast("string")).alias("parent"))


@query(f"""WITH RECURSIVE {_CAUSED}, u AS (SELECT id, id AS at_, [id] AS way, false AS looped FROM l UNION ALL SELECT u.id, l.parent, list_append(u.way, l.parent), list_contains(u.way, l.parent) FROM u JOIN l ON u.at_ = l.id WHERE NOT u.looped AND l.parent IS NOT NULL),
x AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(way) DESC) = 1) SELECT id, CASE WHEN looped THEN list_min(way[list_position(way, at_):]) ELSE at_ END AS root_id, CASE WHEN looped THEN -1 ELSE len(way) - 1 END AS depth FROM x""")
def provenance_chain(t: Tables) -> DataFrame:
    """From each event through what caused it to the first cause."""
    return hierarchy.solve_forest(_causes(t))


@query(f"WITH {_CAUSED} SELECT p.actor_type AS by_type, e.actor_type AS of_type, count(*) AS n, count(*) FILTER (WHERE p.actor <> e.actor) AS across FROM l JOIN e ON e.event_id = CAST(l.id AS BIGINT) JOIN e p ON p.event_id = CAST(l.parent AS BIGINT) GROUP BY 1, 2")
def cross_agent_trace(t: Tables) -> DataFrame:
    e = once(t).select("event_id", "actor_type", "actor")
    links = _causes(t).where("parent IS NOT NULL").select(F.col("id").cast("bigint").alias("event_id"), F.col("parent").cast("bigint").alias("by"))
    j = links.join(e, "event_id").join(e.select(F.col("event_id").alias("by"), F.col("actor_type").alias("by_type"), F.col("actor").alias("by_actor")), "by")
    return j.groupBy("by_type", F.col("actor_type").alias("of_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("by_actor") != F.col("actor")).alias("across"))


_ITEMS = "g AS (SELECT DISTINCT id, lower(trim(memory_id)) AS k, evidence, created_at FROM bridge_grounding_results), i AS (SELECT id, k, created_at, unnest(from_json(evidence, '[{\"type\":\"VARCHAR\",\"value\":\"DOUBLE\",\"weight\":\"DOUBLE\"}]')) AS x FROM g WHERE json_valid(evidence)), v AS (SELECT id, k, created_at, x.type AS type, x.value AS value, x.weight AS weight FROM i WHERE x.value IS NOT NULL AND x.weight IS NOT NULL)"


def _evidence(t: Tables) -> DataFrame:
    g = t.bridge_grounding_results.select("id", loose_key(F.col("memory_id")).alias("k"), "evidence", "created_at").distinct()
    items = insight.evidence_items(g.select(F.struct("id", "k", "created_at").alias("r"), "evidence"), "r", "evidence")
    return items.select("r.*", "type", "value", "weight")


@query(f"WITH {_ITEMS} SELECT type, count(*) AS n, count(DISTINCT k) AS memories, round(sum(value * weight) / sum(weight), 6) AS mean FROM v GROUP BY 1")
def evidence_types(t: Tables) -> DataFrame:
    return _evidence(t).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("memories"), F.round(F.sum(F.col("value") * F.col("weight")) / F.sum("weight"), 6).alias("mean"))


@query(f"WITH {_ITEMS}, n AS (SELECT max(created_at) AS now FROM bridge_grounding_results) SELECT k AS memory_id, count(*) AS items, round(sum(weight * pow(0.5, (now - created_at) / 86400.0 / 30)) / sum(weight), 6) AS freshness FROM v, n WHERE k <> '' AND weight > 0 GROUP BY 1")
def evidence_freshness(t: Tables) -> DataFrame:
    """How fresh a memory's evidence is, weighted, at the time of the last result."""
    now = t.bridge_grounding_results.agg(F.max("created_at").alias("now"))  # one row
    v = _evidence(t).where("k IS NOT NULL AND weight > 0").join(F.broadcast(now))
    f = insight.freshness((F.col("now") - F.col("created_at")) / 86400.0)
    return v.groupBy(F.col("k").alias("memory_id")).agg(F.count(F.lit(1)).alias("items"), F.round(F.sum(F.col("weight") * f) / F.sum("weight"), 6).alias("freshness"))


@query(f"WITH {_EV}, m AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS events, count(DISTINCT memory_id) AS memories, count(*) FILTER (WHERE kind = 'superseded') AS superseded, count(*) FILTER (WHERE kind = 'consolidated') AS consolidated, count(*) FILTER (WHERE kind = 'created') AS created FROM e GROUP BY 1) SELECT *, round(superseded / memories, 6) AS contradiction_density, round(consolidated / greatest(1, created), 6) AS consolidation_efficiency FROM m")
def monthly_drift(t: Tables) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("superseded", "consolidated", "created")]
    m = once(t).groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("memory_id").alias("memories"), *kinds)
    return m.withColumns({"contradiction_density": F.round(F.col("superseded") / F.col("memories"), 6), "consolidation_efficiency": F.round(F.col("consolidated") / F.greatest(F.lit(1), "created"), 6)})


@query(f"WITH {_EV}, c AS (SELECT memory_id, min(ts) AS born FROM e WHERE kind = 'created' GROUP BY 1), j AS (SELECT e.memory_id, count(*) FILTER (WHERE born IS NULL) AS unborn, count(*) FILTER (WHERE ts < born) AS early, count(*) FILTER (WHERE delta IS NULL OR NOT json_valid(delta)) AS broken FROM e LEFT JOIN c USING (memory_id) GROUP BY 1) SELECT * FROM j WHERE unborn + early + broken > 0")
def temporal_integrity(t: Tables) -> DataFrame:
    """Memories whose history does not hold: events without or before a creation, broken deltas."""
    e = once(t)
    born = e.where("kind = 'created'").groupBy("memory_id").agg(F.min("ts").alias("born"))
    broken = F.col("delta").isNull() | F.try_parse_json("delta").isNull()
    j = e.join(born, "memory_id", "left").groupBy("memory_id").agg(F.count_if(F.col("born").isNull()).alias("unborn"), F.count_if(F.col("ts") < F.col("born")).alias("early"), F.count_if(broken).alias("broken"))
    return j.where("unborn + early + broken > 0")


@query("WITH a AS (SELECT DISTINCT event_id FROM memory_events WHERE schema_version = 1), b AS (SELECT DISTINCT event_id FROM memory_events WHERE event_id NOT IN (SELECT event_id FROM a)) SELECT event_id, false AS appended FROM a UNION ALL SELECT event_id, true FROM b")
def event_append(t: Tables) -> DataFrame:
    """The events of the first schema version and those of a later batch that are not among them."""
    m = t.memory_events
    return insight.appended(m.where("schema_version = 1").select("event_id").distinct(), m, "event_id", [])


@query(f"""WITH {_EV}, x AS (SELECT *, CASE WHEN json_valid(delta) THEN delta END AS d FROM e), z AS (SELECT *, CASE kind WHEN 'created' THEN d->>'$.content_hash' WHEN 'contentupdated' THEN coalesce(d->>'$.new_content_hash', d->>'$.content_hash.new') END AS h, CASE WHEN kind IN ('created', 'decayed') THEN coalesce(try_cast(d->>'$.confidence' AS DOUBLE), try_cast(d->>'$.new_confidence' AS DOUBLE)) END AS c, actor_type = 'agent' AS a FROM x),
r AS (SELECT memory_id, a, arg_max(h, (ts, event_id)) FILTER (WHERE h IS NOT NULL) AS hash, max((ts, event_id)) FILTER (WHERE h IS NOT NULL) AS at_, max(c) AS c, count(*) AS n FROM z WHERE a IS NOT NULL GROUP BY 1, 2)
SELECT memory_id, arg_max(CASE WHEN a THEN 'a' ELSE 'b' END, at_) AS winner, arg_max(hash, at_) AS hash, max(c) AS confidence, CAST(sum(n) AS BIGINT) AS touched FROM r GROUP BY 1""")
def memory_merge(t: Tables) -> DataFrame:
    """The states that agents and all others wrote apart, merged."""
    e = once(t).where("actor_type IS NOT NULL")
    return insight.merged_replicas(insight.replica_state(e.where("actor_type = 'agent'")), insight.replica_state(e.where("actor_type <> 'agent'")))


@query("WITH e AS (SELECT pattern_a AS src, pattern_b AS dst, max(similarity) AS weight FROM merge_candidates WHERE pattern_a <> pattern_b AND similarity >= 0 GROUP BY 1, 2) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY weight DESC, src, dst) = 1")
def dag_merge(t: Tables) -> DataFrame:
    """Edges of several replicas merged (the larger weight), the weaker of two that point at each other left out."""
    m = t.merge_candidates.where("pattern_a <> pattern_b AND similarity >= 0").groupBy(F.col("pattern_a").alias("src"), F.col("pattern_b").alias("dst")).agg(F.max("similarity").alias("weight"))
    return merges.without_cycles(m, "src", "dst", "weight")


@query(f"WITH {_EV}, s AS (SELECT lag(memory_id) OVER w AS cause, memory_id AS effect, ts - lag(ts) OVER w AS gap FROM e WHERE actor IS NOT NULL WINDOW w AS (PARTITION BY actor ORDER BY ts, event_id)) SELECT cause, effect, count(*) AS n FROM s WHERE gap <= INTERVAL 1 DAY AND cause <> effect GROUP BY 1, 2")
def causal_inference(t: Tables) -> DataFrame:
    return insight.followed_by(once(t), "actor", "memory_id", "ts", "event_id", 86400)


_STORES = {"violations": "id", "feedback": "id", "bridge_metrics": "id", "memory_events": "event_id", "pattern_locations": "location_id", "scan_history": "id", "documents": "doc_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, count(*) FILTER (WHERE {k} IS NULL) AS without_key, count({k}) - count(DISTINCT {k}) AS repeated FROM {t}" for t, k in _STORES.items()))
def storage_health(t: Tables) -> DataFrame:
    return insight.table_health({n: getattr(t, n).select(k) for n, k in _STORES.items()}, _STORES)


@query("SELECT event_id, user_id, recent FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE INTERVAL 1 DAY PRECEDING) AS recent FROM events) WHERE recent > 3")
def rate_limited(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return insight.over_limit(e, "user_id", "ts", 86400, 3).select("event_id", "user_id", "recent")


@query(f"WITH {_EV}, k AS (SELECT memory_id, event_id, kind, ts, lag(kind) OVER w AS before_, lag(ts) OVER w AS then_ FROM e WHERE kind IN ('archived', 'restored') WINDOW w AS (PARTITION BY memory_id ORDER BY ts, event_id)) SELECT memory_id, event_id, CAST(floor(epoch(ts - then_)) AS BIGINT) AS seconds FROM k WHERE kind = 'restored' AND before_ = 'archived' AND ts - then_ <= INTERVAL 30 DAY")
def reversals(t: Tables) -> DataFrame:
    """Archivings that were taken back within 30 days."""
    w = Window.partitionBy("memory_id").orderBy("ts", "event_id")
    k = once(t).where("kind IN ('archived', 'restored')").withColumns({"before": F.lag("kind").over(w), "gap": F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))})
    return k.where("kind = 'restored' AND before = 'archived'").where(F.col("gap") <= 30 * 86400 * 1_000_000).select("memory_id", "event_id", F.floor(F.col("gap") / 1_000_000).alias("seconds"))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT d.doc_id, d.source, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v), 6) AS cosine FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, q ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v), 9) DESC, doc_id LIMIT 20""")
def vector_link(t: Tables) -> DataFrame:
    """Documents linked with their vectors, the twenty nearest to the first vector."""
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    q = F.broadcast(e.orderBy("doc_id").limit(1).select(F.col("v").alias("q")))
    c = vectors.cosine(F.col("v"), F.col("q"))
    return t.documents.select("doc_id", "source").join(e, "doc_id").join(q).orderBy(F.desc(F.round(c, 9)), "doc_id").limit(20).select("doc_id", "source", F.round(c, 6).alias("cosine"))


@query(f"""WITH {_H}, s AS (SELECT pattern_id FROM h WHERE category = 'security'), e AS (SELECT pattern_a AS a, pattern_b AS b, similarity AS w FROM merge_candidates WHERE similarity BETWEEN 0.5 AND 1 UNION ALL SELECT pattern_b, pattern_a, similarity FROM merge_candidates WHERE similarity BETWEEN 0.5 AND 1)
SELECT b AS pattern_id, count(DISTINCT a) AS seeds, round(max(w), 6) AS strength FROM e JOIN s ON s.pattern_id = e.a WHERE b NOT IN (SELECT pattern_id FROM s) GROUP BY 1""")
def entity_expansion(t: Tables) -> DataFrame:
    """Neighbours of all security patterns that are none themselves."""
    seeds = held(t).where("category = 'security'").select("pattern_id")
    m = t.merge_candidates.where("similarity BETWEEN 0.5 AND 1")
    e = m.select(F.col("pattern_a").alias("a"), F.col("pattern_b").alias("b"), "similarity").unionByName(m.select(F.col("pattern_b").alias("a"), F.col("pattern_a").alias("b"), "similarity"))
    near = e.join(seeds.withColumnRenamed("pattern_id", "a"), "a", "left_semi").where("b IS NOT NULL").withColumnRenamed("b", "pattern_id").join(seeds, "pattern_id", "left_anti")
    return near.groupBy("pattern_id").agg(F.countDistinct("a").alias("seeds"), F.round(F.max("similarity"), 6).alias("strength"))


_SIX = {"frequency": 0.2, "consistency": 0.25, "spread": 0.15, "age": 0.1, "steadiness": 0.15, "feedback": 0.15}


@query(f"""WITH {_H}, n AS (SELECT max(updated_at) AS now FROM h), b AS (SELECT pattern_id, count(*) FILTER (WHERE action = 'fix') AS fixed, count(*) AS given FROM (SELECT DISTINCT id, pattern_id, action FROM feedback) GROUP BY 1),
f AS (SELECT h.pattern_id, least(1, location_count / 20) AS frequency, CASE WHEN location_count > 0 THEN 1 - outlier_count / location_count END AS consistency, least(1, file_spread / 10) AS spread, 1 - pow(0.5, (now - updated_at) / 86400 / 30) AS age, 1 / (1 + confidence_stddev) AS steadiness, fixed / given AS feedback FROM h LEFT JOIN b USING (pattern_id), n)
SELECT pattern_id, round({' + '.join(f'{w} * coalesce({k}, 0.5)' for k, w in _SIX.items())}, 6) AS confidence FROM f""")
def confidence_factors(t: Tables) -> DataFrame:
    """Confidence of a pattern from six factors; what is not known counts as one half."""
    h = held(t)
    now = h.agg(F.max("updated_at").alias("now"))  # one row
    b = t.once("feedback", "id", "pattern_id", "action").groupBy("pattern_id").agg(F.count_if(F.col("action") == "fix").alias("fixed"), F.count(F.lit(1)).alias("given"))
    one = F.lit(1.0)
    values = {
        "frequency": F.least(one, F.col("location_count") / 20), "consistency": F.when(F.col("location_count") > 0, 1 - F.col("outlier_count") / F.col("location_count")), "spread": F.least(one, F.col("file_spread") / 10),
        "age": 1 - insight.freshness((F.col("now") - F.col("updated_at")) / 86400), "steadiness": 1 / (1 + F.col("confidence_stddev")), "feedback": F.col("fixed") / F.col("given"),
    }
    return h.join(b, "pattern_id", "left").join(F.broadcast(now)).select("pattern_id", F.round(insight.weighted({k: (w, values[k]) for k, w in _SIX.items()}), 6).alias("confidence"))


@query("SELECT DISTINCT location_id, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' WHEN line <= 0 THEN 'line_not_positive' WHEN file IS NULL OR trim(file) = '' THEN 'no_file' WHEN matched_text IS NULL OR trim(matched_text) = '' THEN 'no_text' END AS rule FROM pattern_locations WHERE confidence < 0 OR confidence > 1 OR line <= 0 OR file IS NULL OR trim(file) = '' OR matched_text IS NULL OR trim(matched_text) = ''")
def rule_outliers(t: Tables) -> DataFrame:
    """Places that break a rule, by the first one broken."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rule = F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence_out_of_range").when(F.col("line") <= 0, "line_not_positive").when(blank("file"), "no_file").when(blank("matched_text"), "no_text")
    return t.pattern_locations.select("location_id", rule.alias("rule")).where("rule IS NOT NULL").distinct()


@query("WITH p AS (SELECT DISTINCT location_id, pattern_id, file, line, confidence FROM pattern_locations WHERE is_outlier), m AS (SELECT pattern_id, avg(confidence) AS m FROM (SELECT DISTINCT location_id, pattern_id, confidence FROM pattern_locations) GROUP BY 1) SELECT md5(p.pattern_id || ':' || location_id) AS id, p.file, p.line, 'outlier/' || p.pattern_id AS rule_id, CASE WHEN abs(confidence - m) >= 0.5 THEN 'error' WHEN abs(confidence - m) >= 0.25 THEN 'warning' ELSE 'info' END AS severity FROM p JOIN m USING (pattern_id)")
def outlier_violations(t: Tables) -> DataFrame:
    p = t.pattern_locations.select("location_id", "pattern_id", "file", "line", "confidence", "is_outlier").distinct()
    mean = p.select("location_id", "pattern_id", "confidence").distinct().groupBy("pattern_id").agg(F.avg("confidence").alias("m"))
    far = F.abs(F.col("confidence") - F.col("m"))
    out = p.where("is_outlier").join(mean, "pattern_id")
    return out.select(F.md5(F.concat_ws(":", "pattern_id", F.col("location_id").cast("string"))).alias("id"), "file", "line", F.concat(F.lit("outlier/"), "pattern_id").alias("rule_id"), F.when(far >= 0.5, "error").when(far >= 0.25, "warning").otherwise("info").alias("severity"))


@query("WITH p AS (SELECT DISTINCT location_id, confidence FROM pattern_locations WHERE confidence IS NOT NULL) SELECT CASE WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'moderate' ELSE 'low' END AS tier, count(*) AS n FROM p GROUP BY 1")
def significance_tiers(t: Tables) -> DataFrame:
    p = t.pattern_locations.where("confidence IS NOT NULL").select("location_id", "confidence").distinct()
    return p.groupBy(statistics.significance(F.col("confidence")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_V}, m AS (SELECT file, line, string_split_regex(regexp_extract(matched_text, '(?:noqa|nolint|lint-ignore|eslint-disable(?:-next-line|-line)?)(?:[: ]+([A-Za-z0-9_/,\\- ]+))?', 1), '[, ]+') AS rules FROM pattern_locations WHERE regexp_matches(matched_text, '(?:noqa|nolint|lint-ignore|eslint-disable)')),
r AS (SELECT file, line, rules FROM m UNION ALL SELECT file, line + 1, rules FROM m) SELECT id, EXISTS (SELECT 1 FROM r WHERE r.file = v.file AND r.line = v.line AND (len(list_filter(rules, lambda x: x <> '')) = 0 OR list_contains(rules, v.rule_id))) AS suppressed_inline FROM v""")
def inline_suppressions(t: Tables) -> DataFrame:
    lines = t.pattern_locations.select("file", "line", F.col("matched_text").alias("text"))
    return matching.suppressed(findings(t).select("id", "file", "line", "rule_id").distinct(), lines).select("id", "suppressed_inline")


@query(f"WITH {_EV}, n AS (SELECT max(ts) AS now FROM e) SELECT actor, count(*) AS events, round(0.5 + 0.5 * (1 - pow(0.5, count(*) / 10)) * pow(0.5, floor(epoch(any_value(now) - max(ts))) / 86400 / 90), 6) AS trust FROM e, n WHERE actor IS NOT NULL GROUP BY 1")
def trust_decay(t: Tables) -> DataFrame:
    """Trust in an actor: grown with its events, halved every 90 days without one, towards one half."""
    e = once(t)
    days = F.floor((F.unix_micros("now") - F.unix_micros("last")) / 1_000_000) / 86400
    now = e.agg(F.max("ts").alias("now"))  # one row
    g = e.where("actor IS NOT NULL").groupBy("actor").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last")).join(F.broadcast(now))
    return g.select("actor", "events", F.round(0.5 + 0.5 * (1 - F.pow(F.lit(0.5), F.col("events") / 10)) * insight.freshness(days, 90.0), 6).alias("trust"))


@query(f"""WITH {_EV}, n AS (SELECT max(ts) AS now FROM e), c AS (SELECT caused_id, count(*) AS cited FROM (SELECT e.memory_id AS caused_id FROM (SELECT DISTINCT event_id, try_cast(nullif(regexp_extract(caused_by, '^evt:([0-9]+)$', 1), '') AS BIGINT) AS p FROM memory_events) x JOIN e ON e.event_id = x.p) GROUP BY 1),
g AS (SELECT memory_id, max(ts) AS last, count(*) AS used FROM e GROUP BY 1) SELECT memory_id, round(pow(0.5, floor(epoch(now - last)) / 86400 / 60), 6) AS temporal, round(least(1, ln(1 + used) / ln(21)), 6) AS usage, round(least(1, coalesce(cited, 0) / 5), 6) AS citation FROM g LEFT JOIN c ON c.caused_id = g.memory_id, n""")
def decay_factors(t: Tables) -> DataFrame:
    """Factors by which a memory decays: time since its last event, how often it was used, how often it caused others."""
    e = once(t)
    number = F.expr("try_cast(nullif(regexp_extract(caused_by, '^evt:([0-9]+)$', 1), '') AS BIGINT)")
    causes = t.memory_events.select(F.col("event_id").alias("_of"), number.alias("event_id")).where("event_id IS NOT NULL").distinct()
    cited = causes.join(e.select("event_id", "memory_id"), "event_id").groupBy("memory_id").agg(F.count(F.lit(1)).alias("cited"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    g = e.groupBy("memory_id").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("used")).join(cited, "memory_id", "left").join(F.broadcast(now))
    days = F.floor((F.unix_micros("now") - F.unix_micros("last")) / 1_000_000) / 86400
    one = F.lit(1.0)
    return g.select("memory_id", F.round(insight.freshness(days, 60.0), 6).alias("temporal"), F.round(F.least(one, F.log1p("used") / F.log(F.lit(21.0))), 6).alias("usage"), F.round(F.least(one, F.coalesce("cited", F.lit(0)) / 5), 6).alias("citation"))


@query(f"WITH {_DAILY}, w AS (SELECT metric, day, v, avg(v) OVER p AS m, stddev_samp(v) OVER p AS s, count(*) OVER p AS n FROM d WINDOW p AS (PARTITION BY metric ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)), a AS (SELECT metric, day FROM w WHERE n >= 5 AND s > 0 AND abs(v - m) / s > 2), b AS (SELECT *, lag(day) OVER (PARTITION BY metric ORDER BY day) AS last FROM a) SELECT metric, day FROM b WHERE last IS NULL OR day - last >= 7")
def drift_alerts(t: Tables) -> DataFrame:
    """Days on which a metric leaves its last 30 days' range, the first after a week without such a day."""
    w = Window.partitionBy("metric").orderBy("day").rangeBetween(-30, -1)
    m, s, n = F.avg("v").over(w), F.stddev_samp("v").over(w), F.count("v").over(w)
    d = daily(t).withColumns({"m": m, "s": s, "n": n})
    return insight.damped(d.where("n >= 5 AND s > 0 AND abs(v - m) / s > 2").select("metric", "day"), "metric", "day", 7)


@query(f"WITH {_V} SELECT id, file || ':' || CAST(line AS BIGINT) || ' ' || upper(coalesce(severity, 'none')) || ' ' || message || ' [' || rule_id || ']' AS text FROM v")
def console_report(t: Tables) -> DataFrame:
    return insight.console_lines(findings(t).select("id", "file", "line", "severity", "message", "rule_id").distinct())


def _cell(c: str) -> str:
    return f"'<td>' || replace(replace(replace(replace(coalesce(CAST({c} AS VARCHAR), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</td>'"


@query(f"WITH {_V} SELECT id, '<tr>' || {' || '.join(map(_cell, ('severity', 'file', 'CAST(line AS BIGINT)', 'rule_id', 'message')))} || '</tr>' AS html FROM v")
def html_report(t: Tables) -> DataFrame:
    return insight.html_rows(findings(t).select("id", "severity", "file", "line", "rule_id", "message").distinct())


@query("SELECT severity, count(*) AS n, count(DISTINCT id) AS ids FROM violations GROUP BY 1")
def backup_restore(t: Tables) -> DataFrame:
    """A table written as a backup, read again and summed up."""
    path = scratch(t.spark, "backup")
    t.violations.write.parquet(path)
    return t.spark.read.parquet(path).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("SELECT v.severity, count(*) AS n FROM violations v JOIN feedback f ON lower(trim(f.violation_id)) = lower(trim(v.id)) GROUP BY 1")
def attached_scan(t: Tables) -> DataFrame:
    """Two stores under names of their own in one statement."""
    return t.spark.sql("SELECT v.severity, count(*) AS n FROM {analysis} v JOIN {memory} f ON lower(trim(f.violation_id)) = lower(trim(v.id)) GROUP BY 1", analysis=t.violations, memory=t.feedback)


@query(f"WITH {_H} SELECT pattern_id, len(list_distinct(coalesce(aliases, []))) AS aliases, len(list_intersect(coalesce(aliases, []), coalesce(merged_from, []))) AS both_, len(list_distinct(coalesce(child_ids, []))) AS children, list_contains(coalesce(child_ids, []), pattern_id) AS own_child FROM h")
def array_helpers(t: Tables) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    size = lambda c: F.size(c).cast("bigint")
    distinct = lambda c: size(F.array_distinct(F.array_compact(some(c))))
    return held(t).select("pattern_id", distinct("aliases").alias("aliases"), size(F.array_intersect(some("aliases"), some("merged_from"))).alias("both_"), distinct("child_ids").alias("children"), F.exists(some("child_ids"), lambda x: x.eqNullSafe(F.col("pattern_id"))).alias("own_child"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?:^|\\n)commit [0-9a-f]{7,40}')) AS commits FROM documents WHERE source = 'commit_log' AND text IS NOT NULL")
def commit_counts(t: Tables) -> DataFrame:
    return t.documents.where("source = 'commit_log' AND text IS NOT NULL").select("doc_id", F.regexp_count("text", F.lit(r"(?:^|\n)commit [0-9a-f]{7,40}")).cast("bigint").alias("commits"))


_INTENTS = {"why": "because|since|reason", "how": "usually|always|steps|first", "what_if": "if |unless|in case", "when": "when|once|after|before"}


@query("SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{k}' END" for k, p in _INTENTS.items()) + ", 'other') AS intent FROM documents WHERE source = 'memory_note' AND text IS NOT NULL")
def note_intents(t: Tables) -> DataFrame:
    low = F.lower("text")
    intent = F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in _INTENTS.items()], F.lit("other"))
    return t.documents.where("source = 'memory_note' AND text IS NOT NULL").select("doc_id", intent.alias("intent"))


@query("SELECT doc_id, level, substr(text, 1, size) AS text FROM documents, (VALUES ('L0', 0), ('L1', 80), ('L2', 240), ('L3', 1000000)) l(level, size) WHERE source = 'adr' AND text IS NOT NULL")
def compression_levels(t: Tables) -> DataFrame:
    """Records at four levels of detail, the last the whole."""
    cuts = F.array(*[F.struct(F.lit(k).alias("level"), F.substring("text", 1, n).alias("text")) for k, n in (("L0", 0), ("L1", 80), ("L2", 240), ("L3", 1_000_000))])
    return t.documents.where("source = 'adr' AND text IS NOT NULL").select("doc_id", F.explode(cuts).alias("c")).select("doc_id", "c.*")


@query(f"WITH {_H}, b AS (SELECT pattern_id, location_count - outlier_count + 1.0 AS a, outlier_count + 1.0 AS b FROM h WHERE location_count >= outlier_count) SELECT pattern_id, round(a * b / ((a + b) * (a + b) * (a + b + 1)), 9) AS variance FROM b ORDER BY round(a * b / ((a + b) * (a + b) * (a + b + 1)), 9) DESC, pattern_id LIMIT 25")
def active_learning(t: Tables) -> DataFrame:
    """The 25 patterns of which least is known."""
    h = held(t).where("location_count >= outlier_count")
    v = F.round(statistics.beta_posterior(F.col("location_count") - F.col("outlier_count"), F.col("location_count"))["variance"], 9)
    return h.select("pattern_id", v.alias("variance")).orderBy(F.desc("variance"), "pattern_id").limit(25)


@query("""SELECT 'retrieval' AS metric, count(*) FILTER (WHERE grounding_score >= 0.5) / count(*) AS value FROM bridge_grounding_results UNION ALL SELECT 'storage', count(DISTINCT event_id) / count(*) FROM memory_events UNION ALL SELECT 'session', count(DISTINCT user_id) FROM events
UNION ALL SELECT 'embedding', avg(CASE WHEN embedding IS NULL THEN 0.0 ELSE 1.0 END) FROM embeddings UNION ALL SELECT 'consolidation', count(*) FILTER (WHERE similarity >= 0.95) / count(*) FROM merge_candidates""")
def observability(t: Tables) -> DataFrame:
    share = lambda df, name, c: df.agg(c.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    parts = [
        share(t.bridge_grounding_results, "retrieval", F.count_if(F.col("grounding_score") >= 0.5) / F.count(F.lit(1))), share(t.memory_events, "storage", F.countDistinct("event_id") / F.count(F.lit(1))), share(t.events, "session", F.countDistinct("user_id")),
        share(t.embeddings, "embedding", F.avg(F.when(F.col("embedding").isNull(), 0.0).otherwise(1.0))), share(t.merge_candidates, "consolidation", F.count_if(F.col("similarity") >= 0.95) / F.count(F.lit(1))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_EV} SELECT actor_type, kind, count(*) AS n FROM e WHERE actor_type IN ('agent', 'user') AND ts >= TIMESTAMP '2025-02-01' AND json_valid(delta) AND (delta->>'$.tags' IS NOT NULL OR delta->>'$.importance' IN ('high', 'critical')) GROUP BY 1, 2")
def projection_view(t: Tables) -> DataFrame:
    """What a view of other agents lets through: by type of actor, age, tags and importance."""
    d = F.try_parse_json("delta")
    wanted = F.try_variant_get(d, "$.tags", "variant").isNotNull() | F.try_variant_get(d, "$.importance", "string").isin("high", "critical")
    e = once(t).where("actor_type IN ('agent', 'user') AND ts >= TIMESTAMP '2025-02-01'").where(d.isNotNull() & wanted)
    return e.groupBy("actor_type", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def micro_batch_append(t: Tables) -> DataFrame:
    """A stream written batch by batch into a table, which is then summed up."""
    s = flows.stream_of(t.spark, f"{t.sf}/events.parquet").select("event_id", "event_type")
    return flows.run_once(s).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@query("WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(message), '[a-z0-9]{3,}')) AS w FROM (SELECT DISTINCT id, message FROM violations)), q AS (SELECT ['detector', 'token', 'unsafe', 'missing', 'deprecated', 'insecure'] AS q) SELECT id, len(list_intersect(w, q)) AS matched FROM w, q WHERE len(list_intersect(w, q)) > 0")
def query_expansion(t: Tables) -> DataFrame:
    """Messages that have a word of a query or one of its synonyms."""
    synonyms = {"detector": ["detector", "token"], "unsafe": ["unsafe", "insecure"], "missing": ["missing", "deprecated"]}
    terms = F.array(*[F.lit(x) for v in synonyms.values() for x in v])
    w = t.violations.select("id", "message").distinct().select("id", F.array_distinct(text.words(F.col("message"))).alias("w"))
    return w.select("id", F.size(F.array_intersect("w", terms)).cast("bigint").alias("matched")).where("matched > 0")


@query(f"""WITH RECURSIVE {_H}, n AS (SELECT DISTINCT pattern_a AS src, pattern_b AS dst FROM merge_candidates WHERE similarity >= 0.97 AND similarity <= 1 AND pattern_a <> pattern_b), s AS (SELECT DISTINCT pattern_id AS node FROM h WHERE category = 'security'), b AS (SELECT DISTINCT pattern_id AS node FROM h WHERE is_dirty),
w AS (SELECT node FROM s UNION SELECT n.dst FROM w JOIN n ON n.src = w.node), k AS (SELECT node FROM s WHERE node NOT IN (SELECT node FROM b) UNION SELECT n.dst FROM k JOIN n ON n.src = k.node WHERE n.dst NOT IN (SELECT node FROM b)) SELECT node FROM w WHERE node NOT IN (SELECT node FROM k)""")
def counterfactual(t: Tables) -> DataFrame:
    """What security patterns would no longer lead to, were all dirty patterns taken away."""
    h = held(t)
    e = t.merge_candidates.where("similarity >= 0.97 AND similarity <= 1 AND pattern_a <> pattern_b").select(F.col("pattern_a").alias("src"), F.col("pattern_b").alias("dst")).distinct()
    starts, gone = h.where("category = 'security'").select(F.col("pattern_id").alias("node")), h.where("is_dirty").select(F.col("pattern_id").alias("node"))
    without = e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    now, then = graph.reached(e, starts).select("node"), graph.reached(without, starts.join(gone, "node", "left_anti")).select("node")
    return now.join(then, "node", "left_anti")


@query("""WITH b AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), l1 AS (SELECT doc_id, row_number() OVER (ORDER BY n DESC, doc_id) - 1 AS r FROM b ORDER BY n DESC, doc_id LIMIT 100),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1), c AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 9) AS s FROM embeddings, q), l2 AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) - 1 AS r FROM c ORDER BY s DESC, doc_id LIMIT 100),
l3 AS (SELECT doc_id, row_number() OVER (ORDER BY collected_at DESC, doc_id) - 1 AS r FROM documents WHERE collected_at IS NOT NULL ORDER BY collected_at DESC, doc_id LIMIT 100), f AS (SELECT doc_id, sum(1.0 / (60 + r)) AS fused FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY 1)
SELECT doc_id, round(fused, 9) AS fused FROM f JOIN b USING (doc_id)""")
def hybrid_search(t: Tables) -> DataFrame:
    """The hundred longest texts, the hundred nearest vectors and the hundred latest documents, fused by reciprocal ranks; documents without a text left out."""
    top = lambda df: df.orderBy(F.desc("s"), "doc_id").limit(100)
    texts = t.documents.where("text IS NOT NULL").select("doc_id", F.length("text").cast("double").alias("s"))
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    q = F.broadcast(e.orderBy("doc_id").limit(1).select(F.col("v").alias("q")))
    near = e.join(q).select("doc_id", F.round(vectors.cosine(F.col("v"), F.col("q")), 9).alias("s"))
    late = t.documents.where("collected_at IS NOT NULL").select("doc_id", F.col("collected_at").cast("double").alias("s"))
    fused = retrieval.fuse([top(texts), top(near), top(late)], "doc_id", "s")
    return fused.join(texts.select("doc_id"), "doc_id", "left_semi").withColumn("fused", F.round("fused", 9))
