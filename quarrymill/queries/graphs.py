"""Graph queries: merge candidates as directed, weighted edges between patterns; links of memories over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.keys import event_kind
from quarrymill.operators import graph as G
from quarrymill.queries.registry import Tables, collection
from quarrymill.queries.relational import held

QUERIES, SQL, query = collection()

_E = """e AS (SELECT src, dst, max(s) AS strength FROM (SELECT pattern_a AS src, pattern_b AS dst, CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END AS s FROM merge_candidates
WHERE pattern_a IS NOT NULL AND pattern_b IS NOT NULL AND pattern_a <> pattern_b AND similarity >= 0) GROUP BY 1, 2)"""
_H = "h AS (SELECT * FROM aggregated_patterns QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY updated_at DESC) = 1)"


def edges(t: Tables) -> DataFrame:
    s = F.col("similarity")
    return _candidates(t).groupBy("src", "dst").agg(F.max(F.when(s > 1, s / 100).otherwise(s)).alias("strength"))


def _candidates(t: Tables) -> DataFrame:
    """src, dst, similarity of the rows that stand for an edge, repeats among them."""
    m = t.merge_candidates.where("pattern_a IS NOT NULL AND pattern_b IS NOT NULL AND pattern_a <> pattern_b AND similarity >= 0")
    return m.select(F.col("pattern_a").alias("src"), F.col("pattern_b").alias("dst"), "similarity")


def of_category(t: Tables, *names: str) -> DataFrame:
    return held(t).where(F.col("category").isin(*names)).select(F.col("pattern_id").alias("node"))


@query(f"WITH RECURSIVE {_E}, {_H}, r AS (SELECT pattern_id AS node, 0 AS depth FROM h WHERE category = 'security' UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 5) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def bfs_reachability(t: Tables) -> DataFrame:
    return G.reached(edges(t), of_category(t, "security"), 5)


@query(f"WITH RECURSIVE {_E}, {_H}, r AS (SELECT pattern_id AS node, 0 AS depth FROM h WHERE category = 'logging' UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 5) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def inverse_reachability(t: Tables) -> DataFrame:
    return G.reached(edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst")), of_category(t, "logging"), 5)


@query(f"WITH {_E}, p AS (SELECT dst AS start, src AS node FROM e UNION SELECT a.dst, b.src FROM e a JOIN e b ON b.dst = a.src UNION SELECT a.dst, c.src FROM e a JOIN e b ON b.dst = a.src JOIN e c ON c.dst = b.src) SELECT start AS node, count(*) AS callers FROM p WHERE start <> node GROUP BY 1")
def blast_radius(t: Tables) -> DataFrame:
    """How many nodes lead to each within three steps."""
    back = edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reachable_pairs(back, back.select(F.col("src").alias("node")), 3).groupBy(F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("callers"))


@query(f"WITH RECURSIVE {_E}, r AS (SELECT dst AS node, src AS caller FROM e UNION SELECT r.node, e.src FROM r JOIN e ON e.dst = r.caller) SELECT node, count(*) AS callers FROM r WHERE node <> caller GROUP BY 1")
def blast_radius_transitive(t: Tables) -> DataFrame:
    """How many nodes lead to each by ways of any length."""
    return G.reach_counts(_candidates(t), name="callers")


@query(f"WITH {_E}, {_H} SELECT pattern_id AS node FROM h WHERE category <> 'testing' AND pattern_id NOT IN (SELECT dst FROM e)")
def dead_code(t: Tables) -> DataFrame:
    called = edges(t).select(F.col("dst").alias("node"))
    return held(t).where("category <> 'testing'").select(F.col("pattern_id").alias("node")).join(called, "node", "left_anti")


@query(f"WITH RECURSIVE {_E}, {_H}, r AS (SELECT pattern_id AS node FROM h WHERE category IN ('api', 'testing') UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT pattern_id AS node FROM h WHERE pattern_id NOT IN (SELECT node FROM r)")
def unreachable(t: Tables) -> DataFrame:
    """Patterns that no entry point leads to."""
    seen = G.reached(edges(t), of_category(t, "api", "testing")).select("node")
    return held(t).select(F.col("pattern_id").alias("node")).join(seen, "node", "left_anti")


@query(f"""WITH {_E}, {_H}, c AS (SELECT DISTINCT a.category AS src, b.category AS dst FROM e JOIN h a ON a.pattern_id = src JOIN h b ON b.pattern_id = dst WHERE a.category <> b.category),
m AS (SELECT category AS module, count(*) FILTER (WHERE len(child_ids) > 0) AS abstract, count(*) AS total FROM h GROUP BY 1),
x AS (SELECT module, (SELECT count(*) FROM c WHERE src = module) AS ce, (SELECT count(*) FROM c WHERE dst = module) AS ca, abstract / total AS a FROM m), y AS (SELECT *, CASE WHEN ce + ca > 0 THEN ce / (ce + ca) ELSE 0 END AS i FROM x)
SELECT module, ce, ca, round(i, 6) AS instability, round(a, 6) AS abstractness, round(abs(a + i - 1), 6) AS distance FROM y""")
def coupling_metrics(t: Tables) -> DataFrame:
    c = held(t).select("pattern_id", "category")
    between = edges(t).join(c.select(F.col("pattern_id").alias("src"), F.col("category").alias("cs")), "src").join(c.select(F.col("pattern_id").alias("dst"), F.col("category").alias("cd")), "dst")
    modules = held(t).groupBy(F.col("category").alias("module")).agg(F.count_if(F.size("child_ids") > 0).alias("abstract"), F.count(F.lit(1)).alias("total"))
    m = G.coupling(between.select(F.col("cs").alias("src"), F.col("cd").alias("dst")), modules).drop("zone")
    return m.withColumns({k: F.round(k, 6) for k in ("instability", "abstractness", "distance")})


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT src AS a, dst AS b FROM e WHERE strength >= 0.9 UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b WHERE e.strength >= 0.9),
s AS (SELECT x.a AS node, x.b AS other FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) SELECT node, min(other) AS component FROM s WHERE node IN (SELECT node FROM s WHERE node <> other) GROUP BY 1""")
def scc_cycles(t: Tables) -> DataFrame:
    return G.strong_components(edges(t).where("strength >= 0.9"))


_START = "(SELECT min(src) FROM e)"
_STEP = "d{k} AS (SELECT node, min(c) AS c FROM (SELECT * FROM d{j} UNION ALL SELECT e.dst, d{j}.c + 1 - e.strength FROM d{j} JOIN e ON e.src = d{j}.node) GROUP BY 1)"


@query(f"WITH {_E}, d0 AS (SELECT min(src) AS node, CAST(0 AS DOUBLE) AS c FROM e), " + ", ".join(_STEP.format(k=k, j=k - 1) for k in range(1, 5)) + " SELECT node, round(c, 6) AS cost FROM d4")
def shortest_path(t: Tables) -> DataFrame:
    """Cheapest ways of up to four edges from the smallest node, an edge costing 1 - strength."""
    e = edges(t)
    start = e.agg(F.min("src")).first()[0]
    return G.cheapest(e.withColumn("cost", 1 - F.col("strength")), start, 4).withColumn("cost", F.round("cost", 6))


@query(f"""WITH RECURSIVE {_E}, d(node, c) USING KEY (node) AS (SELECT min(src) AS node, CAST(0 AS DOUBLE) AS c FROM e
UNION SELECT x.node, x.c FROM (SELECT e.dst AS node, min(d.c + 1 - e.strength) AS c FROM d JOIN e ON e.src = d.node GROUP BY 1) x LEFT JOIN recurring.d o ON o.node = x.node WHERE o.node IS NULL OR x.c < o.c) SELECT node, round(c, 6) AS cost FROM d""")
def shortest_path_unbounded(t: Tables) -> DataFrame:
    """Cheapest ways of any length from the smallest node to all it leads to, an edge costing 1 - strength."""
    e = edges(t)
    start = e.agg(F.min("src")).first()[0]
    return G.cheapest(e.withColumn("cost", 1 - F.col("strength")), start).withColumn("cost", F.round("cost", 6))


@query(f"""WITH RECURSIVE {_E}, {_H}, k AS (SELECT pattern_id, category FROM h), r AS (SELECT pattern_id AS source, pattern_id AS at_, [pattern_id] AS path, false AS done FROM k WHERE category = 'api'
UNION ALL SELECT source, e.dst, list_append(path, e.dst), coalesce(k.category = 'data_access', false) FROM r JOIN e ON e.src = r.at_ LEFT JOIN k ON k.pattern_id = e.dst WHERE NOT done AND len(path) <= 3 AND NOT list_contains(path, e.dst) AND coalesce(k.category, '') <> 'auth')
SELECT source, at_ AS sink, array_to_string(path, '>') AS path FROM r WHERE done""")
def taint_paths(t: Tables) -> DataFrame:
    """Ways of up to three edges from sources to sinks that pass no sanitiser."""
    p = G.paths(edges(t), of_category(t, "api"), of_category(t, "data_access"), of_category(t, "auth"), 3)
    return p.select("source", "sink", F.array_join("path", ">").alias("path"))


@query(f"""WITH {_E}, {_H}, p AS (SELECT src AS s, dst AS n, 1 AS d FROM e UNION SELECT a.src, b.dst, 2 FROM e a JOIN e b ON b.src = a.dst), q AS (SELECT s, n, min(d) AS d FROM p WHERE s <> n GROUP BY 1, 2)
SELECT h.pattern_id AS node, count(*) AS tests, count(*) FILTER (WHERE d = 1) AS direct FROM q JOIN h x ON x.pattern_id = q.s AND x.category = 'testing' JOIN h ON h.pattern_id = q.n AND h.category <> 'testing' GROUP BY 1""")
def test_coverage_map(t: Tables) -> DataFrame:
    """How many tests lead to each pattern within two steps, and how many directly."""
    pairs = G.reachable_pairs(edges(t), of_category(t, "testing"), 2)
    code = held(t).where("category <> 'testing'").select(F.col("pattern_id").alias("node"))
    return pairs.join(code, "node").groupBy("node").agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("depth") == 1).alias("direct"))


@query(f"""WITH RECURSIVE {_E}, {_H}, r AS (SELECT src AS s, dst AS n FROM e JOIN h ON pattern_id = src AND category = 'testing' UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.n)
SELECT r.n AS node, count(*) AS tests, count(*) FILTER (WHERE (r.s, r.n) IN (SELECT (src, dst) FROM e)) AS direct FROM r JOIN h ON h.pattern_id = r.n AND h.category <> 'testing' GROUP BY 1""")
def test_coverage_transitive(t: Tables) -> DataFrame:
    """How many tests lead to each pattern by ways of any length, and how many directly."""
    e, tests = edges(t), of_category(t, "testing")
    code = held(t).where("category <> 'testing'").select(F.col("pattern_id").alias("node"))
    direct = e.join(tests.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("direct"))
    return G.reach_counts(e, tests, "tests").join(code, "node").join(direct, "node", "left").select("node", "tests", F.coalesce("direct", F.lit(0)).cast("bigint").alias("direct"))


@query()
def min_test_set(t: Tables) -> DataFrame:
    """A greedy cover of all that tests lead to by ways of any length."""
    chosen = G.reach_cover(edges(t), of_category(t, "testing"))
    return t.spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate(chosen)], "place int, node string, covered bigint")


def _trace_sql(depth: int) -> str:
    parts = ["f0 AS (SELECT pattern_id AS start, pattern_id AS node, CAST(1 AS DOUBLE) AS s FROM h WHERE category = 'performance')", "seen0 AS (SELECT start, node FROM f0)"]
    for k in range(1, depth + 1):
        parts.append(f"f{k} AS (SELECT start, e.dst AS node, max(s * strength) AS s FROM f{k - 1} JOIN e ON e.src = f{k - 1}.node AND strength >= 0.8 WHERE (start, e.dst) NOT IN (SELECT (start, node) FROM seen{k - 1}) GROUP BY 1, 2)")
        parts.append(f"seen{k} AS (SELECT * FROM seen{k - 1} UNION ALL SELECT start, node FROM f{k})")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT start, node, {k} AS depth, round(s, 9) AS strength FROM f{k}" for k in range(1, depth + 1))


@query(f"WITH {_E}, {_H}, " + _trace_sql(3))
def causal_trace(t: Tables) -> DataFrame:
    return G.strongest(edges(t), of_category(t, "performance"), 0.8, 3).withColumn("strength", F.round("strength", 9))


@query(f"WITH RECURSIVE {_E}, {_H}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT pattern_id AS node, 0 AS depth FROM h WHERE category = 'security' UNION SELECT u.dst, depth + 1 FROM r JOIN u ON u.src = r.node WHERE depth < 3), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT node, depth, -0.2 * 0.5 ** depth AS delta FROM m WHERE depth > 0")
def contradiction_propagation(t: Tables) -> DataFrame:
    """Halved with each step over undirected edges, first visit only."""
    e = edges(t).select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    r = G.reached(both, of_category(t, "security"), 3).where("depth > 0")
    return r.select("node", "depth", (F.lit(-0.2) * F.pow(F.lit(0.5), F.col("depth"))).alias("delta"))


@query(f"WITH {_E}, k AS (SELECT * FROM e WHERE strength >= 0.9), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node FROM n WHERE node NOT IN (SELECT src FROM k UNION SELECT dst FROM k)")
def prune_isolated(t: Tables) -> DataFrame:
    return G.pruned(edges(t), 0.9)[1]


@query(f"WITH {_E}, w AS (SELECT * FROM e WHERE strength < 0.6), k AS (SELECT * FROM e WHERE strength >= 0.6) SELECT src, dst FROM w WHERE EXISTS (SELECT 1 FROM k WHERE k.src = w.dst AND k.dst = w.src) OR EXISTS (SELECT 1 FROM k a JOIN k b ON b.src = a.dst WHERE a.src = w.dst AND b.dst = w.src)")
def cycle_check(t: Tables) -> DataFrame:
    """Weak edges that would close a cycle of at most three edges with strong ones."""
    e = edges(t)
    return G.closes_cycle(e.where("strength >= 0.6"), e.where("strength < 0.6"), 2)


@query(f"WITH RECURSIVE {_E}, k AS (SELECT * FROM e WHERE strength >= 0.6), r AS (SELECT DISTINCT dst AS s, dst AS n FROM e WHERE strength < 0.6 UNION SELECT r.s, k.dst FROM r JOIN k ON k.src = r.n) SELECT src, dst FROM e WHERE strength < 0.6 AND (dst, src) IN (SELECT (s, n) FROM r)")
def cycle_check_unbounded(t: Tables) -> DataFrame:
    """Weak edges that would close a cycle of any length with strong ones."""
    e = edges(t)
    return G.closes_cycle(e.where("strength >= 0.6"), e.where("strength < 0.6"))


@query("""WITH e AS (SELECT event_id, min(recorded_at) AS ts, min(memory_id) AS memory_id, min(replace(lower(event_type), '_', '')) AS kind, min(delta) AS delta FROM memory_events WHERE replace(lower(event_type), '_', '') IN ('linkadded', 'linkremoved') GROUP BY 1),
l AS (SELECT memory_id, delta->>'$.target' AS target, kind, ts, event_id FROM e WHERE ts <= TIMESTAMP '2025-06-01' AND json_valid(delta)) SELECT memory_id, target FROM (SELECT memory_id, target, arg_max(kind, (ts, event_id)) AS k FROM l WHERE target IS NOT NULL GROUP BY 1, 2) WHERE k = 'linkadded'""")
def graph_at(t: Tables) -> DataFrame:
    """The links of memories as they were on 2025-06-01: the last change of each decides."""
    e = t.memory_events.select("event_id", "recorded_at", "memory_id", event_kind(F.col("event_type")).alias("kind"), F.try_variant_get(F.try_parse_json("delta"), "$.target", "string").alias("target"))
    e = e.where(F.col("kind").isin("linkadded", "linkremoved") & F.col("target").isNotNull())
    once = e.groupBy("event_id").agg(F.min(F.struct("recorded_at", "memory_id", "kind", "target")).alias("e")).select("event_id", "e.*").where("recorded_at <= TIMESTAMP_NTZ '2025-06-01'")
    last = once.groupBy("memory_id", "target").agg(F.max_by("kind", F.struct("recorded_at", "event_id")).alias("k"))
    return last.where("k = 'linkadded'").drop("k")


@query(f"""WITH {_E}, {_H}, m AS (SELECT pattern_id, category FROM h), c AS (SELECT a.category AS module, a.category = b.category AS inside FROM e JOIN m a ON a.pattern_id = src JOIN m b ON b.pattern_id = dst) SELECT module, count(*) AS calls, round(count(*) FILTER (WHERE inside) / count(*), 6) AS cohesion FROM c GROUP BY 1""")
def module_cohesion(t: Tables) -> DataFrame:
    c = held(t).select("pattern_id", "category")
    e = edges(t).join(c.select(F.col("pattern_id").alias("src"), F.col("category").alias("module")), "src").join(c.select(F.col("pattern_id").alias("dst"), F.col("category").alias("_to")), "dst")
    return e.groupBy("module").agg(F.count(F.lit(1)).alias("calls"), F.round(F.count_if(F.col("module") == F.col("_to")) / F.count(F.lit(1)), 6).alias("cohesion"))
