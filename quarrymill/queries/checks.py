"""Queries that put facts, findings and histories together: classes of sensitivity, gates, signals, constraints, validation, upkeep, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import rules as R
from quarrymill.functions.keys import loose_key
from quarrymill.operators import facts, insight, retrieval
from quarrymill.queries.facts import _CALLS, _EDGES, _FILES, _symbols, _values, files
from quarrymill.queries.insight import _ITEMS
from quarrymill.queries.registry import Tables, collection
from quarrymill.queries.relational import held
from quarrymill.queries.states import _EV, _H, once

QUERIES, SQL, query = collection()

_q = R.quoted

#: Words by which text is of a class of sensitivity.
SENSITIVE = [
    R.Rule("credentials", r"(?:password|passwd|secret|api_?key|token|private_?key)"), R.Rule("personal", r"(?:email|phone|address|birth|first_?name|last_?name|ssn)"),
    R.Rule("financial", r"(?:credit_?card|iban|account_?number|salary|invoice|payment)"), R.Rule("health", r"(?:patient|diagnos|medical|prescription)"),
]


@query(f"WITH {_FILES}, r(class, p) AS (VALUES {_values((r.name, r.pattern) for r in SENSITIVE)}) SELECT doc_id, class, len(regexp_extract_all(text, p)) AS hits FROM s, r WHERE len(regexp_extract_all(text, p)) > 0")
def sensitivity_classes(t: Tables) -> DataFrame:
    return facts.detections(files(t), SENSITIVE).withColumnRenamed("detector", "class")


def _service(c: str) -> str:
    return f"regexp_extract({c}, '^/[^/]+/([^/]+)/', 1)"


@query(_CALLS + f", x AS (SELECT doc_id, {_service('file')} AS service FROM s) SELECT a.service AS caller, b.service AS callee, count(*) AS calls FROM z JOIN x a ON a.doc_id = z.doc_id JOIN x b ON b.doc_id = z.target WHERE a.service <> b.service AND strategy <> 'fuzzy' GROUP BY 1, 2")
def cross_service_calls(t: Tables) -> DataFrame:
    """Calls from one project folder into another."""
    f = files(t)
    at = f.select("doc_id", F.regexp_extract("file", "^/[^/]+/([^/]+)/", 1).alias("caller"))
    calls = facts.resolved_calls(f).where("target IS NOT NULL AND strategy <> 'fuzzy'").join(at, "doc_id").join(at.select(F.col("doc_id").alias("target"), F.col("caller").alias("callee_")), "target")
    return calls.where("caller <> callee_").groupBy("caller", F.col("callee_").alias("callee")).agg(F.count(F.lit(1)).alias("calls"))


#: Files by which a package manager is known.
MANAGERS = {"npm": "package.json|package-lock.json|.npmrc", "yarn": "yarn.lock", "pip": "requirements.txt|setup.py", "poetry": "pyproject.toml", "cargo": "Cargo.toml", "go": "go.mod", "maven": "pom.xml", "gradle": "build.gradle", "composer": "composer.json", "bundler": "Gemfile", "nuget": ".csproj"}


@query("SELECT root_path, manager, count(*) AS files FROM (SELECT rtrim(root_path, '/') AS root_path, CASE " + " ".join(f"WHEN regexp_matches(file, {_q('(?:' + p.replace('.', '[.]') + ')$')}) THEN '{m}'" for m, p in MANAGERS.items()) + " END AS manager FROM documents WHERE file IS NOT NULL) WHERE manager IS NOT NULL GROUP BY 1, 2")
def package_managers(t: Tables) -> DataFrame:
    manager = F.coalesce(*[F.when(F.col("file").rlike("(?:" + p.replace(".", "[.]") + ")$"), F.lit(m)) for m, p in MANAGERS.items()])
    d = t.documents.where("file IS NOT NULL").select(F.rtrim("root_path", F.lit("/")).alias("root_path"), manager.alias("manager"))
    return d.where("manager IS NOT NULL").groupBy("root_path", "manager").agg(F.count(F.lit(1)).alias("files"))


_HANDLED = f"SELECT count(*) FILTER (WHERE len({R.extracted_sql('handler')}) > 0) / greatest(1, count(*)) AS v FROM s WHERE len({R.extracted_sql('raise')}) > 0"


@query(f"""WITH {_H}, {_FILES}, g AS (SELECT 'pattern_compliance' AS gate, 1 - sum(outlier_count) / greatest(1, sum(location_count)) AS value, 0.8 AS least FROM h UNION ALL SELECT 'error_handling', v, 0.5 FROM ({_HANDLED}) UNION ALL SELECT 'security_boundaries', 1 - count(*) FILTER (WHERE severity = 'error') / greatest(1, count(*)), 0.9 FROM (SELECT DISTINCT id, severity FROM violations)
UNION ALL SELECT 'test_coverage', count(*) FILTER (WHERE regexp_matches(file, '(?:^|/)(?:tests?|spec)/')) / greatest(1, count(*)), 0.1 FROM s UNION ALL SELECT 'regression', 1 - count(*) FILTER (WHERE is_new) / greatest(1, count(*)), 0.7 FROM (SELECT DISTINCT id, is_new FROM violations)) SELECT gate, round(value, 6) AS value, value >= least AS passed FROM g""")
def quality_gates(t: Tables) -> DataFrame:
    """Measures of five gates and whether they pass; each is one aggregate."""
    f = files(t)
    raising = f.where(F.size(facts.names_of("raise")) > 0)
    v = t.violations.select("id", "severity", "is_new").distinct()
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    gates = [
        ("pattern_compliance", 0.8, held(t), 1 - F.sum("outlier_count") / F.greatest(F.lit(1), F.sum("location_count"))), ("error_handling", 0.5, raising, F.count_if(F.size(facts.names_of("handler")) > 0) / n),
        ("security_boundaries", 0.9, v, 1 - F.count_if(F.col("severity") == "error") / n), ("test_coverage", 0.1, f, F.count_if(F.col("file").rlike("(?:^|/)(?:tests?|spec)/")) / n), ("regression", 0.7, v, 1 - F.count_if("is_new") / n),
    ]
    out = None
    for name, least, df, value in gates:
        part = df.agg(value.alias("v")).select(F.lit(name).alias("gate"), F.round("v", 6).alias("value"), (F.col("v") >= least).alias("passed"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_H}, p AS (SELECT pattern_id, count(DISTINCT file) AS files, count(DISTINCT regexp_extract(file, '^(.*)/', 1)) AS folders FROM pattern_locations GROUP BY 1), f AS (SELECT pattern_id, count(DISTINCT id) AS given, count(DISTINCT author) AS authors, max(created_at) AS last FROM feedback GROUP BY 1), n AS (SELECT max(created_at) AS now FROM feedback)
SELECT h.pattern_id, round(0.4 * least(1, coalesce(files, 0) / 10) + 0.2 * least(1, coalesce(folders, 0) / 5) + 0.2 * least(1, coalesce(given, 0) / 10) + 0.2 * coalesce(pow(0.5, (now - last) / 86400.0 / 30), 0), 6) AS signal FROM h LEFT JOIN p USING (pattern_id) LEFT JOIN f USING (pattern_id), n""")
def prediction_signals(t: Tables) -> DataFrame:
    """How likely a pattern is asked for next: by its files, folders, feedback and how recent that is."""
    p = t.pattern_locations.groupBy("pattern_id").agg(F.countDistinct("file").alias("files"), F.countDistinct(F.regexp_extract("file", "^(.*)/", 1)).alias("folders"))
    f = t.feedback.groupBy("pattern_id").agg(F.countDistinct("id").alias("given"), F.max("created_at").alias("last"))
    now = t.feedback.agg(F.max("created_at").alias("now"))  # one row
    share = lambda c, n: F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0)) / n)
    signal = 0.4 * share("files", 10) + 0.2 * share("folders", 5) + 0.2 * share("given", 10) + 0.2 * F.coalesce(insight.freshness((F.col("now") - F.col("last")) / 86400.0), F.lit(0.0))
    return held(t).join(p, "pattern_id", "left").join(f, "pattern_id", "left").join(F.broadcast(now)).select("pattern_id", F.round(signal, 6).alias("signal"))


_TEN = {
    "length": (0.15, "least(1, length(text) / 4000)"), "code": (0.1, "CASE WHEN source = 'source_file' THEN 1.0 ELSE 0.0 END"), "decision": (0.15, "CASE WHEN source = 'adr' THEN 1.0 ELSE 0.0 END"), "note": (0.1, "CASE WHEN source = 'memory_note' THEN 1.0 ELSE 0.0 END"),
    "placed": (0.05, "CASE WHEN file IS NOT NULL THEN 1.0 ELSE 0.0 END"), "language": (0.05, "CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END"), "metric": (0.15, "CASE WHEN contains(lower(text), 'metric') THEN 1.0 ELSE 0.0 END"), "violation": (0.1, "CASE WHEN contains(lower(text), 'violation') THEN 1.0 ELSE 0.0 END"),
    "lines": (0.05, "least(1, (length(text) - length(replace(text, chr(10), ''))) / 100)"), "root": (0.1, "CASE WHEN root_path IS NOT NULL THEN 1.0 ELSE 0.0 END"),
}
_SUM = " + ".join(f"{w} * ({e})" for w, e in _TEN.values())


@query(f"SELECT doc_id, round({_SUM}, 6) AS score FROM documents WHERE text IS NOT NULL ORDER BY round({_SUM}, 6) DESC, doc_id LIMIT 50")
def factor_scores(t: Tables) -> DataFrame:
    """The fifty documents with the greatest weighted sum of ten factors."""
    d = t.documents.where("text IS NOT NULL")
    return d.select("doc_id", F.round(F.expr(_SUM.replace("chr(10)", "char(10)")).cast("double"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("WITH r AS (SELECT doc_id, collected_at, row_number() OVER (PARTITION BY md5(text) ORDER BY collected_at DESC, doc_id) AS k FROM documents WHERE text IS NOT NULL AND collected_at IS NOT NULL) SELECT doc_id, collected_at FROM r WHERE k = 1 ORDER BY collected_at DESC, doc_id LIMIT 50")
def rerank_without_copies(t: Tables) -> DataFrame:
    """The fifty latest documents, of equal texts the latest alone."""
    d = t.documents.where("text IS NOT NULL AND collected_at IS NOT NULL").groupBy(F.md5("text").alias("h")).agg(F.max(F.struct("collected_at", (-F.col("doc_id")).alias("n"))).alias("m"))
    return d.select((-F.col("m.n")).alias("doc_id"), "m.collected_at").orderBy(F.desc("collected_at"), "doc_id").limit(50)


@query(_EDGES + ", c AS (SELECT doc_id FROM s WHERE regexp_matches(text, 'import |require|using |use ') AND contains(file, '/src/')) SELECT src, dst, src IN (SELECT doc_id FROM c) AS renewed FROM e")
def graph_update(t: Tables) -> DataFrame:
    """An import graph after the files under src changed: their edges are taken out and read anew, the others kept."""
    f = files(t)
    changed = f.where(F.col("text").rlike("import |require|using |use ") & F.contains(F.col("file"), F.lit("/src/"))).select(F.col("doc_id").alias("src"))
    edges = facts.import_edges(f).select("src", "dst")
    kept = edges.join(changed, "src", "left_anti").withColumn("renewed", F.lit(False))
    return kept.unionByName(edges.join(changed, "src", "left_semi").withColumn("renewed", F.lit(True)))


_STYLES = {"snake": "^[a-z0-9]+(?:_[a-z0-9]+)+$", "camel": "^[a-z]+[a-z0-9]*(?:[A-Z][a-z0-9]*)+$", "pascal": "^(?:[A-Z][a-z0-9]*)+$", "lower": "^[a-z0-9]+$"}
_STYLE = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(name, '{p}') THEN '{k}' END" for k, p in _STYLES.items()) + ", 'other')"


@query(f"WITH {_FILES}, {_symbols('function')}, a AS (SELECT lang, {_STYLE} AS style, count(*) AS n FROM y GROUP BY 1, 2 HAVING {_STYLE} <> 'lower'), b AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS share FROM a) SELECT lang, style, n, round(share, 6) AS share, CASE WHEN share >= 0.8 THEN 'rule' WHEN share >= 0.3 THEN 'contested' ELSE 'rare' END AS status FROM b")
def constraint_synthesis(t: Tables) -> DataFrame:
    """How functions are named in each language: a style that four of five follow is a rule; two styles with much support contest it."""
    style = F.coalesce(*[F.when(F.col("name").rlike(p), F.lit(k)) for k, p in _STYLES.items()], F.lit("other"))
    a = facts.symbols(files(t), "function").groupBy("lang", style.alias("style")).agg(F.count(F.lit(1)).alias("n")).where("style <> 'lower'")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))  # five rows a language
    b = a.withColumn("_s", share)
    return b.select("lang", "style", "n", F.round("_s", 6).alias("share"), F.when(F.col("_s") >= 0.8, "rule").when(F.col("_s") >= 0.3, "contested").otherwise("rare").alias("status"))


@query(f"""WITH {_H}, r AS (SELECT category, pattern_id, length(pattern_id) + 20 * coalesce(len(aliases), 0) AS cost, coalesce(confidence_mean, 0) AS c FROM h WHERE category IS NOT NULL) SELECT category, pattern_id, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(cost) OVER (PARTITION BY category ORDER BY c DESC, pattern_id ROWS UNBOUNDED PRECEDING) AS used FROM r) WHERE used <= 400""")
def context_generation(t: Tables) -> DataFrame:
    """The surest patterns of each category that fit a context of 400 characters."""
    r = held(t).where("category IS NOT NULL").select("category", "pattern_id", (F.length("pattern_id") + 20 * F.coalesce(F.size(F.coalesce("aliases", F.array().cast("array<string>"))), F.lit(0))).alias("cost"), F.coalesce("confidence_mean", F.lit(0.0)).alias("c"))
    return retrieval.within_budget(r, "category", "cost", 400, F.desc("c"), F.col("pattern_id")).select("category", "pattern_id", F.col("used").cast("bigint").alias("used"))


@query(f"""WITH {_EV}, n AS (SELECT max(ts) AS now FROM e), l AS (SELECT memory_id, max(ts) AS last FROM e GROUP BY 1), f AS (SELECT DISTINCT file FROM documents WHERE file IS NOT NULL)
SELECT 'embedding_refresh' AS action, count(*) AS n FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) UNION ALL SELECT 'citation_update', count(DISTINCT location_id) FROM pattern_locations WHERE file IS NOT NULL AND file NOT IN (SELECT file FROM f)
UNION ALL SELECT 'flagging', count(DISTINCT id) FROM bridge_grounding_results WHERE grounding_score < 0.2 UNION ALL SELECT 'archival', count(*) FROM l, n WHERE floor(epoch(now - last)) > 90 * 86400 UNION ALL SELECT 'confidence_adjust', count(DISTINCT memory_id) FROM e WHERE kind = 'confidencechanged'""")
def healing_candidates(t: Tables) -> DataFrame:
    """How many rows each action of upkeep would concern."""
    e = once(t)
    now = e.agg(F.max("ts").alias("now"))  # one row
    old = e.groupBy("memory_id").agg(F.max("ts").alias("last")).join(F.broadcast(now)).where(F.floor((F.unix_micros("now") - F.unix_micros("last")) / 1_000_000) > 90 * 86400)
    embedded = t.embeddings.where("embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"))
    known = t.documents.where("file IS NOT NULL").select("file").distinct()
    parts = {
        "embedding_refresh": t.documents.where("text IS NOT NULL").select("doc_id").join(embedded, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n")),
        "citation_update": t.pattern_locations.where("file IS NOT NULL").select("location_id", "file").join(known, "file", "left_anti").agg(F.countDistinct("location_id").alias("n")),
        "flagging": t.bridge_grounding_results.where("grounding_score < 0.2").agg(F.countDistinct("id").alias("n")),
        "archival": old.agg(F.count(F.lit(1)).alias("n")),
        "confidence_adjust": e.where("kind = 'confidencechanged'").agg(F.countDistinct("memory_id").alias("n")),
    }
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("action"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_EV}, m AS (SELECT lower(trim(memory_id)) AS k, count(*) AS events, count(*) FILTER (WHERE kind = 'validated') AS validated, count(*) FILTER (WHERE kind IN ('superseded', 'consolidated')) AS replaced, count(*) FILTER (WHERE kind = 'linkadded') AS links FROM e GROUP BY 1), g AS (SELECT lower(trim(memory_id)) AS k, avg(grounding_score) AS score FROM (SELECT DISTINCT id, memory_id, grounding_score FROM bridge_grounding_results) WHERE trim(memory_id) <> '' GROUP BY 1)
SELECT k AS memory_id, round(coalesce(score, 0.5), 6) AS grounding, least(1, validated / 3) AS citation, CASE WHEN replaced > 0 THEN 0.0 ELSE 1.0 END AS consistency, least(1, links / 2) AS alignment FROM m LEFT JOIN g USING (k)""")
def memory_validation(t: Tables) -> DataFrame:
    """Four dimensions in which a memory is validated."""
    count = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    m = once(t).groupBy(loose_key(F.col("memory_id")).alias("k")).agg(count("validated").alias("validated"), count("superseded", "consolidated").alias("replaced"), count("linkadded").alias("links"))
    g = t.once("bridge_grounding_results", "id", "memory_id", "grounding_score").groupBy(loose_key(F.col("memory_id")).alias("k")).agg(F.avg("grounding_score").alias("score")).where("k IS NOT NULL")
    one = F.lit(1.0)
    return m.join(g, "k", "left").select(F.col("k").alias("memory_id"), F.round(F.coalesce("score", F.lit(0.5)), 6).alias("grounding"), F.least(one, F.col("validated") / 3).alias("citation"), F.when(F.col("replaced") > 0, 0.0).otherwise(1.0).alias("consistency"), F.least(one, F.col("links") / 2).alias("alignment"))


@query("WITH f AS (SELECT DISTINCT id, nullif(lower(trim(violation_id)), '') AS v, action, author FROM feedback) SELECT v AS violation_id, count(DISTINCT author) FILTER (WHERE action = 'fix') AS fixers, count(DISTINCT author) FILTER (WHERE action = 'dismiss') AS dismissers FROM f WHERE v IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE action = 'fix') > 0 AND count(*) FILTER (WHERE action = 'dismiss') > 0")
def feedback_contradictions(t: Tables) -> DataFrame:
    """Violations that some fixed and others dismissed."""
    f = t.once("feedback", "id", "violation_id", "action", "author").select(loose_key(F.col("violation_id")).alias("violation_id"), "action", "author").where("violation_id IS NOT NULL")
    who = lambda a: F.countDistinct(F.when(F.col("action") == a, F.col("author")))
    g = f.groupBy("violation_id").agg(who("fix").alias("fixers"), who("dismiss").alias("dismissers"), F.count_if(F.col("action") == "fix").alias("_f"), F.count_if(F.col("action") == "dismiss").alias("_d"))
    return g.where("_f > 0 AND _d > 0").select("violation_id", "fixers", "dismissers")


#: Where untrusted data enters and where it does harm.
TAINT_SOURCES = r"(?:req\.(?:query|body|params)|request\.(?:args|form|GET|POST)|os\.environ|process\.env|getenv\(|\$_(?:GET|POST)|params\[|input\(|Scanner\()"
TAINT_SINKS = r"(?:eval|exec|system|query|execute|innerHTML|popen|render_template_string|unserialize|debug)"
_ASSIGN = r"([A-Za-z_][A-Za-z0-9_]*)[ \t]*:?=[ \t]*[^=\n][^\n;]*" + TAINT_SOURCES
_SINK = TAINT_SINKS + r"\(([^()\n]*)\)"


@query(f"WITH x AS (SELECT DISTINCT location_id, list_distinct(regexp_extract_all(matched_text, {_q(_ASSIGN)}, 1)) AS v, list_distinct(regexp_extract_all(array_to_string(regexp_extract_all(matched_text, {_q(_SINK)}, 1), ' '), '[A-Za-z_][A-Za-z0-9_]*')) AS u FROM pattern_locations WHERE matched_text IS NOT NULL) SELECT location_id, len(v) AS tainted, len(u) AS used, len(list_intersect(v, u)) AS flows FROM x WHERE len(v) > 0 OR len(list_intersect(v, u)) > 0")
def taint_in_snippets(t: Tables) -> DataFrame:
    """Variables that are given untrusted data, and those of them that reach a sink in the same snippet."""
    p = t.pattern_locations.where("matched_text IS NOT NULL").select("location_id", "matched_text")
    v = F.array_distinct(F.regexp_extract_all("matched_text", F.lit(_ASSIGN), F.lit(1)))
    args = F.array_join(F.regexp_extract_all("matched_text", F.lit(_SINK), F.lit(1)), " ")
    u = F.array_distinct(F.regexp_extract_all(args, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    n = lambda c: F.size(c).cast("bigint")
    return p.select("location_id", n(v).alias("tainted"), n(u).alias("used"), n(F.array_intersect(v, u)).alias("flows")).where("tainted > 0 OR flows > 0").distinct()


_VALUE = r"(?:^|\n)[ \t]*(?:export[ \t]+|public[ \t]+|private[ \t]+|static[ \t]+|final[ \t]+|const[ \t]+|val[ \t]+|let[ \t]+|var[ \t]+)*[A-Z][A-Z0-9_]{2,}[ \t]*=[ \t]*([^\n;]{1,200})"


@query(f"WITH {_FILES}, v AS (SELECT lang, trim(unnest(regexp_extract_all(text, {_q(_VALUE)}, 1))) AS v FROM s) SELECT lang, CASE WHEN regexp_matches(v, '^-?[0-9]') THEN 'number' WHEN regexp_matches(v, '^[\"''`]') THEN 'text' WHEN regexp_matches(lower(v), '^(?:true|false)') THEN 'boolean' WHEN regexp_matches(v, '^[\\[({{]') THEN 'collection' ELSE 'expression' END AS type, count(*) AS n FROM v GROUP BY 1, 2")
def constant_types(t: Tables) -> DataFrame:
    """What kinds of values constants have."""
    v = files(t).select("lang", F.explode(F.regexp_extract_all("text", F.lit(_VALUE), F.lit(1))).alias("v")).withColumn("v", F.trim("v"))
    kind = F.when(F.col("v").rlike("^-?[0-9]"), "number").when(F.col("v").rlike("^[\"'`]"), "text").when(F.lower("v").rlike("^(?:true|false)"), "boolean").when(F.col("v").rlike(r"^[\[({]"), "collection").otherwise("expression")
    return v.groupBy("lang", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ITEMS}, c AS (SELECT k, type, count(*) AS n, sum(value * weight) / sum(weight) AS mean FROM v WHERE k <> '' AND weight > 0 GROUP BY 1, 2) SELECT k AS memory_id, count(*) AS types, round(avg(mean), 6) AS composite, CASE WHEN count(*) >= 3 THEN 'full' WHEN count(*) = 2 THEN 'partial' ELSE 'weak' END AS groundable FROM c GROUP BY 1")
def groundability(t: Tables) -> DataFrame:
    """How many types of evidence a memory has, and the mean over its types."""
    from quarrymill.queries.insight import _evidence

    c = _evidence(t).where("k IS NOT NULL AND weight > 0").groupBy("k", "type").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"))
    n = F.count(F.lit(1))
    return c.groupBy(F.col("k").alias("memory_id")).agg(n.alias("types"), F.round(F.avg("mean"), 6).alias("composite"), F.when(n >= 3, "full").when(n == 2, "partial").otherwise("weak").alias("groundable"))
