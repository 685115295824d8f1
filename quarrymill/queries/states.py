"""Temporal, replicated-state and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.keys import event_kind
from quarrymill.operators import merges as M
from quarrymill.operators import scoring as C
from quarrymill.operators import temporal as T
from quarrymill.queries.registry import Tables, collection
from quarrymill.queries.relational import held

QUERIES, SQL, query = collection()

_H = "h AS (SELECT * FROM aggregated_patterns QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC) = 1)"
_P = "p AS (SELECT o_orderkey, o_custkey, o_orderdate AS vf, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS vu, o_totalprice FROM orders)"
_EV = "e AS (SELECT event_id, min(recorded_at) AS ts, min(memory_id) AS memory_id, min(replace(lower(event_type), '_', '')) AS kind, min(delta) AS delta, min(actor_id) AS actor, min(actor_type) AS actor_type FROM memory_events GROUP BY 1)"
LO, HI = "TIMESTAMP '1995-01-01'", "TIMESTAMP '1995-06-30'"


def periods(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("vf"), "o_totalprice")
    return T.valid_periods(o, "o_custkey", "vf", "o_orderkey").withColumnRenamed("valid_until", "vu")


def once(t: Tables) -> DataFrame:
    """Memory events, each event_id once, at its earliest time."""
    m = t.memory_events.select("event_id", F.struct(F.col("recorded_at").cast("timestamp").alias("ts"), "memory_id", event_kind(F.col("event_type")).alias("kind"), "delta", F.col("actor_id").alias("actor"), "actor_type").alias("r"))
    return m.groupBy("event_id").agg(F.min("r").alias("r")).select("event_id", "r.*")


@query(f"WITH {_P} SELECT o_orderkey, o_custkey FROM p WHERE vf <= {LO} AND (vu IS NULL OR {LO} < vu)")
def as_of(t: Tables) -> DataFrame:
    return T.as_of(periods(t), F.expr(LO), "vf", "vu").select("o_orderkey", "o_custkey")


def _range(t: Tables, mode: str) -> DataFrame:
    return T.in_range(periods(t), "vf", "vu", F.expr(LO), F.expr(HI), mode).select("o_orderkey")


@query(f"WITH {_P} SELECT o_orderkey FROM p WHERE vf <= {HI} AND (vu IS NULL OR vu > {LO})")
def range_overlaps(t: Tables) -> DataFrame:
    return _range(t, "overlaps")


@query(f"WITH {_P} SELECT o_orderkey FROM p WHERE vf <= {LO} AND (vu IS NULL OR vu >= {HI})")
def range_contains(t: Tables) -> DataFrame:
    return _range(t, "contains")


@query(f"WITH {_P} SELECT o_orderkey FROM p WHERE vf BETWEEN {LO} AND {HI}")
def started_during(t: Tables) -> DataFrame:
    return _range(t, "started_during")


@query(f"WITH {_P} SELECT o_orderkey FROM p WHERE vu BETWEEN {LO} AND {HI}")
def ended_during(t: Tables) -> DataFrame:
    return _range(t, "ended_during")


@query("""WITH a AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 3 FROM events) GROUP BY 1), b AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'created' WHEN b.user_id IS NULL THEN 'removed' ELSE 'shifted' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL OR abs(b.v - a.v) > 0.2""")
def temporal_diff(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    lo, hi = e.agg(F.min("at"), F.max("at")).first()
    third = F.lit(lo + (hi - lo) // 3)
    before, after = T.latest_at(e, "user_id", "at", "event_id", "value", third), T.latest_at(e, "user_id", "at", "event_id", "value", F.lit(hi))
    return T.difference(before, after, "user_id", "value", 0.2)


@query(f"""WITH {_EV}, c AS (SELECT memory_id, count(*) AS events, count(*) FILTER (WHERE kind = 'archived') - count(*) FILTER (WHERE kind = 'restored') AS balance, arg_max(kind, (ts, event_id)) AS last_kind, count(DISTINCT actor) AS actors FROM e GROUP BY 1) SELECT * FROM c""")
def event_replay(t: Tables) -> DataFrame:
    e = once(t)
    return e.groupBy("memory_id").agg(
        F.count(F.lit(1)).alias("events"), (F.count_if(F.col("kind") == "archived") - F.count_if(F.col("kind") == "restored")).alias("balance"), F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind"), F.countDistinct("actor").alias("actors")
    )


@query("""WITH s AS (SELECT user_id, ts, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) = 1) SELECT q.event_id, s.value FROM events q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ts >= s.ts""")
def asof_snapshot(t: Tables) -> DataFrame:
    """The first event of a user and month is its snapshot; every event looks up the nearest one at or before it."""
    e = t.events.select("event_id", "user_id", "ts", "value")
    first = e.where("value IS NOT NULL").groupBy("user_id", F.trunc("ts", "month").alias("month")).agg(F.min(F.struct("ts", "event_id", "value")).alias("s")).select("user_id", "s.*")
    return T.as_of_join(e.select("user_id", "ts", F.col("event_id").alias("asked")), first, "user_id", "ts", "value", "event_id").select(F.col("asked").alias("event_id"), "value")


_CH = ("contentupdated", "reclassified", "importancechanged", "confidencechanged")


@query(f"WITH {_EV}, n AS (SELECT count(DISTINCT memory_id) AS population, count(*) FILTER (WHERE ts >= TIMESTAMP '2025-04-01' AND kind IN {_CH}) AS changes FROM e WHERE ts < TIMESTAMP '2025-05-01') SELECT population, changes, round(greatest(0, least(1, 1 - changes / (2 * population))), 6) AS ksi FROM n")
def ksi(t: Tables) -> DataFrame:
    s = T.stability(once(t), "memory_id", "kind", "ts", list(_CH), F.expr("TIMESTAMP '2025-04-01'"), F.expr("TIMESTAMP '2025-05-01'"))
    return s.withColumn("ksi", F.round("ksi", 6))


_CONF = "CAST(coalesce(delta->>'$.new', delta->>'$.confidence') AS DOUBLE)"


@query(f"""WITH {_EV}, k AS (SELECT event_id, ts, memory_id, {_CONF} AS v FROM e WHERE kind IN ('created', 'confidencechanged') AND json_valid(delta)), g AS (SELECT DISTINCT make_timestamp(2025, m, 1, 0, 0, 0) AS at_ FROM range(2, 11) r(m)),
l AS (SELECT at_, memory_id, arg_max(v, (ts, event_id)) AS v FROM g JOIN k ON ts <= at_ AND v IS NOT NULL GROUP BY 1, 2) SELECT strftime(at_, '%Y-%m') AS month, round(avg(v), 6) AS mean FROM l GROUP BY 1""")
def confidence_trajectory(t: Tables) -> DataFrame:
    d = F.try_parse_json("delta")
    v = F.coalesce(F.try_variant_get(d, "$.new", "double"), F.try_variant_get(d, "$.confidence", "double"))
    k = once(t).where(F.col("kind").isin("created", "confidencechanged")).select("event_id", "memory_id", "ts", v.alias("v"))
    points = t.spark.range(2, 11).select(F.expr("make_timestamp(2025, CAST(id AS INT), 1, 0, 0, 0)").alias("at"))
    return T.trajectory(k, "memory_id", "ts", "event_id", "v", points).select(F.date_format("at", "yyyy-MM").alias("month"), F.round("mean", 6).alias("mean"))


@query(f"WITH {_EV}, k AS (SELECT memory_id, CAST(delta->>'$.old' AS DOUBLE) AS o, CAST(delta->>'$.new' AS DOUBLE) AS n FROM e WHERE kind = 'confidencechanged' AND json_valid(delta)) SELECT memory_id, count(*) AS declines, round(sum(o - n), 6) AS lost FROM k WHERE n < o GROUP BY 1 HAVING count(*) >= 2")
def erosion_having(t: Tables) -> DataFrame:
    """Memories whose confidence fell twice or more."""
    d = F.try_parse_json("delta")
    k = once(t).where("kind = 'confidencechanged'").select("memory_id", F.try_variant_get(d, "$.old", "double").alias("o"), F.try_variant_get(d, "$.new", "double").alias("n"))
    return k.where("n < o").groupBy("memory_id").agg(F.count(F.lit(1)).alias("declines"), F.round(F.sum(F.col("o") - F.col("n")), 6).alias("lost")).where("declines >= 2")


@query(f"""WITH {_EV}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM e WHERE kind = 'created' GROUP BY 1), b AS (SELECT avg(n) AS base FROM d) SELECT strftime(day, '%Y-%m-%d') AS day, n, round((n - base) / greatest(0.5 * base, 0.1), 6) AS excess FROM d, b WHERE (n - base) / greatest(0.5 * base, 0.1) > 2""")
def explosion_rate(t: Tables) -> DataFrame:
    """Days with far more new memories than usual."""
    from pyspark.sql import Window

    d = once(t).where("kind = 'created'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    x = d.withColumn("base", F.avg("n").over(Window.partitionBy("_all")))  # one row a day
    excess = (F.col("n") - F.col("base")) / F.greatest(0.5 * F.col("base"), F.lit(0.1))
    return x.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round(excess, 6).alias("excess"), excess.alias("_e")).where("_e > 2").drop("_e")


@query(f"""WITH {_EV}, a AS (SELECT event_id, memory_id, ts FROM e WHERE kind = 'archived'), b AS (SELECT event_id, memory_id, ts FROM e WHERE kind = 'restored') SELECT a.event_id AS archived, b.event_id AS restored FROM a JOIN b ON a.memory_id = b.memory_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 7 DAY""")
def decision_change_range_join(t: Tables) -> DataFrame:
    """Restorations within seven days after an archival."""
    e = once(t).withColumn("us", F.unix_micros("ts"))
    a = e.where("kind = 'archived'").select("memory_id", F.col("event_id").alias("archived"), F.col("us").alias("ua"))
    b = e.where("kind = 'restored'").select("memory_id", F.col("event_id").alias("restored"), F.col("us").alias("ub"))
    return T.within_after(a, b, ["memory_id"], "ua", "ub", 7 * 86_400_000_000).select("archived", "restored")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders), p AS (SELECT o_custkey AS k, o_orderdate AS vf, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS vu, o_totalprice AS v FROM o),
c AS (SELECT o_custkey AS k, max(o_orderdate) + INTERVAL 1 DAY AS vf, 0.0 AS v FROM o GROUP BY 1), l AS (SELECT p.k, p.vf, CASE WHEN p.vu IS NULL THEN c.vf ELSE p.vu END AS vu, p.v FROM p JOIN c USING (k)) SELECT k, vf, vu, v FROM l UNION ALL SELECT k, vf, NULL, v FROM c""")
def late_correction(t: Tables) -> DataFrame:
    """A correction one day after each customer's last version closes that one and opens another."""
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("vf"), F.col("o_totalprice").alias("v"))
    h = T.valid_periods(o, "k", "vf", "o_orderkey").withColumnRenamed("valid_until", "vu")
    fix = o.groupBy("k").agg((F.max("vf") + F.expr("INTERVAL 1 DAY")).alias("vf")).withColumn("v", F.lit(0.0))
    return T.corrected(h, fix, "k", "vf", "vu", "v")


@query(f"WITH {_EV} SELECT kind, actor_type, count(*) AS n, count(DISTINCT memory_id) AS memories FROM e GROUP BY ROLLUP (kind, actor_type)")
def all_metrics_rollup(t: Tables) -> DataFrame:
    return once(t).rollup("kind", "actor_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("memory_id").alias("memories"))


@query(f"WITH {_EV}, a AS (SELECT memory_id, actor, count(*) AS n FROM e GROUP BY 1, 2) SELECT memory_id, CAST(sum(n) AS BIGINT) AS value FROM a GROUP BY 1")
def gcounter_merge(t: Tables) -> DataFrame:
    """Each agent's events so far as its replicas know them: the greatest count holds."""
    from pyspark.sql import Window

    e = once(t)
    states = e.select("memory_id", "actor", F.row_number().over(Window.partitionBy("memory_id", "actor").orderBy("ts", "event_id")).alias("c"))
    return M.counter(states, "memory_id", "actor", "c")


@query("SELECT user_id, arg_max(event_type, (ts, event_id, event_type)) AS event_type FROM events GROUP BY 1")
def lww_merge(t: Tables) -> DataFrame:
    return M.last_writer(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", "event_type")


@query("""WITH e AS (SELECT user_id, event_type AS agent, date_trunc('month', ts) AS m, value FROM events), w AS (SELECT user_id, agent, max(m) AS m, arg_max(value, (m, value)) AS value FROM e GROUP BY 1, 2), t AS (SELECT user_id, max(m) AS m FROM w GROUP BY 1)
SELECT user_id, count(DISTINCT value) AS n FROM w JOIN t USING (user_id, m) GROUP BY 1""")
def mv_register(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.col("event_type").alias("agent"), F.trunc("ts", "month").alias("m"), "value")
    return M.concurrent_values(e, "user_id", "agent", "m", "value").select("user_id", F.size("values").cast("bigint").alias("n"))


@query(f"""WITH {_EV}, a AS (SELECT memory_id, json_extract_string(delta, '$.added[0]') AS tag, event_id % 7 AS t FROM e WHERE kind = 'tagsmodified' AND json_valid(delta)), r AS (SELECT memory_id, json_extract_string(delta, '$.removed[0]') AS tag, event_id % 7 AS t FROM e WHERE kind = 'tagsmodified' AND json_valid(delta))
SELECT DISTINCT memory_id, tag FROM a WHERE tag IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.memory_id = a.memory_id AND r.tag = a.tag AND r.t = a.t)""")
def orset_merge(t: Tables) -> DataFrame:
    d = F.try_parse_json("delta")
    e = once(t).where("kind = 'tagsmodified'").withColumn("t", F.col("event_id") % 7)
    side = lambda name: e.select("memory_id", F.try_variant_get(d, f"$.{name}[0]", "string").alias("tag"), "t").where("tag IS NOT NULL")
    return M.observed_remove_set(side("added"), side("removed"), "memory_id", "tag", "t")


@query(f"""WITH {_EV}, c AS (SELECT actor_type, actor, count(*) AS n, count(*) FILTER (WHERE ts < TIMESTAMP '2025-06-01') AS m FROM e GROUP BY 1, 2), x AS (SELECT actor_type, max(CASE WHEN n < m * 2 THEN 1 ELSE 0 END) AS less, max(CASE WHEN n > m * 2 THEN 1 ELSE 0 END) AS more FROM c GROUP BY 1)
SELECT actor_type, CASE WHEN less = 1 AND more = 1 THEN 'concurrent' WHEN less = 1 THEN 'before' WHEN more = 1 THEN 'after' ELSE 'equal' END AS standing FROM x""")
def vector_clock_order(t: Tables) -> DataFrame:
    """The clock of all events against twice that of the events before June."""
    n = once(t).groupBy("actor_type", "actor").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.expr("ts < TIMESTAMP '2025-06-01'")) * 2).alias("m"))
    a, b = M.clock(n, "actor_type", "actor", "n"), M.clock(n, "actor_type", "actor", "m").withColumnRenamed("clock", "other")
    return a.join(b, "actor_type").select("actor_type", M.clock_order(F.col("clock"), F.col("other")).alias("standing"))


@query(f"""WITH {_H}, l AS (SELECT pattern_id, location_hash AS h, updated_at AS ts FROM h WHERE NOT is_dirty), r AS (SELECT pattern_id, location_hash AS h, updated_at AS ts FROM aggregated_patterns QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at) = 1),
j AS (SELECT coalesce(l.pattern_id, r.pattern_id) AS pattern_id, CASE WHEN r.pattern_id IS NULL THEN 'push' WHEN l.pattern_id IS NULL THEN 'pull' WHEN l.h IS NOT DISTINCT FROM r.h THEN NULL WHEN r.ts > l.ts THEN 'take_remote' ELSE 'keep_local' END AS action FROM l FULL JOIN r ON l.pattern_id = r.pattern_id) SELECT * FROM j WHERE action IS NOT NULL""")
def cloud_delta(t: Tables) -> DataFrame:
    from quarrymill.operators.relational import latest_per_key

    first = latest_per_key(t.aggregated_patterns, ["pattern_id"], F.asc("updated_at"))
    return M.sync_delta(held(t).where("NOT is_dirty"), first, "pattern_id", "location_hash", "updated_at")


@query(f"""WITH {_H}, d AS (SELECT pattern_id, confidence_mean AS c, (1760000000 - updated_at) / 86400.0 AS days FROM h)
SELECT pattern_id, round(c * exp(-days / 90), 6) AS natural, round(c * 0.5 ** (days / 90), 6) AS halved, round(c * CASE WHEN days <= 7 THEN 1 WHEN days >= 90 THEN 0.1 ELSE 1 - 0.9 * (days - 7) / 83 END, 6) AS ramped, c * exp(-days / 90) < 0.15 AS archive FROM d""")
def memory_decay(t: Tables) -> DataFrame:
    days, c = (F.lit(1760000000) - F.col("updated_at")) / 86400.0, F.col("confidence_mean")
    natural = c * C.exponential_decay(days, 90)
    return held(t).select("pattern_id", F.round(natural, 6).alias("natural"), F.round(c * C.half_life_decay(days, 90), 6).alias("halved"), F.round(c * C.ramp_decay(days), 6).alias("ramped"), (natural < 0.15).alias("archive"))


@query(f"WITH {_H} SELECT pattern_id, round(0.30 * least(1, file_spread / 50.0) + 0.25 * least(1, outlier_count / 10.0) + 0.20 * (1 - confidence_mean) + 0.15 * least(1, confidence_stddev * 4) + 0.10 * least(1, location_count / 500.0), 6) AS risk FROM h WHERE confidence_mean IS NOT NULL AND confidence_stddev IS NOT NULL")
def risk_score(t: Tables) -> DataFrame:
    share = lambda c, most: F.least(F.lit(1.0), F.col(c) / float(most))
    parts = {"blast": (share("file_spread", 50), 0.30), "sensitive": (share("outlier_count", 10), 0.25), "uncovered": (1 - F.col("confidence_mean"), 0.20), "complex": (F.least(F.lit(1.0), F.col("confidence_stddev") * 4), 0.15), "change": (share("location_count", 500), 0.10)}
    return held(t).where("confidence_mean IS NOT NULL AND confidence_stddev IS NOT NULL").select("pattern_id", F.round(C.weighted(parts), 6).alias("risk"))


@query("WITH f AS (SELECT DISTINCT * FROM feedback), g AS (SELECT author, count(*) AS n, count(*) FILTER (WHERE action = 'fix') AS good, count(*) FILTER (WHERE action = 'dismiss') AS bad FROM f GROUP BY 1) SELECT author, n, round(good / (n + 1) * (1 - bad / (n + 1)), 6) AS trust FROM g")
def trust_score(t: Tables) -> DataFrame:
    g = t.once("feedback", "id", "author", "action").groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "fix").alias("good"), F.count_if(F.col("action") == "dismiss").alias("bad"))
    return g.select("author", "n", F.round(C.trust(F.col("good"), F.col("bad"), F.col("n")), 6).alias("trust"))


@query("""WITH g AS (SELECT DISTINCT id, evidence FROM bridge_grounding_results), j AS (SELECT id, json_extract(evidence, '$[*].value') AS vs, json_extract(evidence, '$[*].weight') AS ws FROM g WHERE json_valid(evidence)), x AS (SELECT id, CAST(unnest(vs) AS DOUBLE) AS v, CAST(unnest(ws) AS DOUBLE) AS w FROM j),
s AS (SELECT id, count(*) AS n, CASE WHEN sum(w) > 0 THEN sum(v * w) / sum(w) ELSE 0 END AS score FROM x WHERE v IS NOT NULL AND w IS NOT NULL GROUP BY 1)
SELECT id, n, round(score, 6) AS score, CASE WHEN score >= 0.7 THEN 'validated' WHEN score >= 0.4 THEN 'partial' WHEN score >= 0.2 THEN 'weak' ELSE 'invalidated' END AS verdict FROM s""")
def grounding_score(t: Tables) -> DataFrame:
    rows = t.bridge_grounding_results.select("id", "evidence").distinct()
    e = rows.select("id", F.explode(F.from_json("evidence", "array<struct<type:string,value:double,weight:double>>")).alias("e")).select("id", "e.value", "e.weight").where("value IS NOT NULL AND weight IS NOT NULL")
    s = C.weighted_mean(e, "id", "value", "weight")
    return s.withColumn("verdict", C.graded(F.col("score"), {"validated": 0.7, "partial": 0.4, "weak": 0.2}, "invalidated")).withColumn("score", F.round("score", 6))


@query("""WITH f AS (SELECT DISTINCT * FROM feedback), d AS (SELECT pattern_id, CASE WHEN action = 'fix' THEN 1.0 WHEN action = 'escalate' THEN 0.5 ELSE 0 END AS a, CASE WHEN action = 'dismiss' THEN CASE WHEN dismissal_reason = 'false_positive' THEN 0.5 WHEN dismissal_reason = 'wont_fix' THEN 0 ELSE 0.25 END WHEN action = 'suppress' THEN 0.1 ELSE 0 END AS b FROM f)
SELECT pattern_id, CAST(round(sum(a), 6) AS DOUBLE) AS alpha, CAST(round(sum(b), 6) AS DOUBLE) AS beta FROM d GROUP BY 1""")
def feedback_deltas(t: Tables) -> DataFrame:
    a, r = F.col("action"), F.col("dismissal_reason")
    up = F.when(a == "fix", 1.0).when(a == "escalate", 0.5).otherwise(0.0)
    down = F.when(a == "dismiss", F.when(r == "false_positive", 0.5).when(r == "wont_fix", 0.0).otherwise(0.25)).when(a == "suppress", 0.1).otherwise(0.0)
    return t.once("feedback", "id", "pattern_id", "action", "dismissal_reason").groupBy("pattern_id").agg(F.round(F.sum(up), 6).alias("alpha"), F.round(F.sum(down), 6).alias("beta"))


@query("""WITH v AS (SELECT DISTINCT * FROM violations), c AS (SELECT split_part(rule_id, '/', 1) AS area, CASE severity WHEN 'error' THEN 10 WHEN 'warning' THEN 5 WHEN 'quality' THEN 2 ELSE 0.5 END AS w FROM v WHERE NOT suppressed) SELECT area, CAST(greatest(0, least(100, 100 - sum(w))) AS DOUBLE) AS score FROM c GROUP BY 1""")
def security_posture(t: Tables) -> DataFrame:
    s = F.col("severity")
    rows = t.once("violations", "id", "rule_id", "severity", "suppressed").where("NOT suppressed").withColumn("area", F.split_part("rule_id", F.lit("/"), F.lit(1)))
    return C.penalty_score(rows, "area", F.when(s == "error", 10.0).when(s == "warning", 5.0).when(s == "quality", 2.0).otherwise(0.5))


@query("""WITH v AS (SELECT DISTINCT * FROM violations), g AS (SELECT split_part(rule_id, '/', 1) AS gate, count(*) AS n, count(*) FILTER (WHERE severity = 'error' AND NOT suppressed) AS errors FROM v GROUP BY 1), s AS (SELECT gate, 100 * (1 - errors / n) AS score, n AS w FROM g)
SELECT round(sum(score * w) / sum(w), 6) AS weighted, bool_and(score >= 50) AS all_pass, bool_or(score >= 50) AS any_pass, round(avg(CASE WHEN score >= 50 THEN 1 ELSE 0 END), 6) AS passed FROM s""")
def policy_weighted(t: Tables) -> DataFrame:
    g = t.once("violations", "id", "rule_id", "severity", "suppressed").groupBy(F.split_part("rule_id", F.lit("/"), F.lit(1)).alias("gate")).agg(F.count(F.lit(1)).alias("w"), F.count_if((F.col("severity") == "error") & ~F.col("suppressed")).alias("errors"))
    s = g.withColumn("score", 100 * (1 - F.col("errors") / F.col("w")))
    ok = F.col("score") >= 50
    return s.agg(F.round(F.sum(F.col("score") * F.col("w")) / F.sum("w"), 6).alias("weighted"), F.bool_and(ok).alias("all_pass"), F.bool_or(ok).alias("any_pass"), F.round(F.avg(F.when(ok, 1).otherwise(0)), 6).alias("passed"))
