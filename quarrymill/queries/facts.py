"""Queries on facts read from source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import rules as R
from quarrymill.operators import facts
from quarrymill.plans.session import cut
from quarrymill.queries.registry import Tables, collection

QUERIES, SQL, query = collection()

_q = R.quoted
_LANG = "CASE lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in R.LANGUAGES.items()) + " END"
_FILES = f"s AS (SELECT doc_id, root_path, file, {_LANG} AS lang, text FROM documents WHERE source = 'source_file' AND text IS NOT NULL)"
_KINDS = ("function", "class", "import", "call", "decorator", "handler", "raise", "constant")


def _symbols(*kinds: str) -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS kind, unnest({R.extracted_sql(k)}) AS name FROM s" for k in kinds)
    no = ", ".join(map(_q, R.NO_CALLS))
    return f"y AS (SELECT doc_id, lang, kind, name, count(*) AS n FROM ({each}) WHERE name <> '' AND (kind <> 'call' OR name NOT IN ({no})) GROUP BY ALL)"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(x if x.endswith("::VARCHAR[]") else _q(x) for x in r) + ")" for r in rows)


def _languages(r) -> str:
    return "[" + ", ".join(map(_q, r.languages)) + "]::VARCHAR[]"


_PATH = "lower(regexp_replace(CASE WHEN lang IN ('python', 'java', 'kotlin', 'csharp') THEN replace(name, '.', '/') WHEN lang = 'php' THEN replace(name, '\\', '/') WHEN lang = 'rust' THEN replace(name, '::', '/') ELSE name END, '^[./]+', ''))"
_STEM = "lower(regexp_extract(file, '([^/]+?)(?:\\.[A-Za-z0-9]+)?$', 1))"


def files(t: Tables) -> DataFrame:
    return facts.source_files(t.documents)


@query(f"WITH {_FILES} SELECT doc_id, lang, {', '.join(f'len({R.extracted_sql(k)}) AS {k}s' for k in _KINDS)} FROM s")
def parse_results(t: Tables) -> DataFrame:
    """How many symbols of each kind a file has, each different text parsed once."""
    return facts.parsed(files(t), _KINDS)


@query(f"WITH {_FILES}, {_symbols('function', 'class', 'import', 'constant')} SELECT doc_id, lang, kind, name, n FROM y")
def symbol_index(t: Tables) -> DataFrame:
    return facts.symbols(files(t), "function", "class", "import", "constant")


@query(f"WITH {_FILES}, r(node, p) AS (VALUES {_values(R.GENERIC.items())}) SELECT doc_id, node, len(regexp_extract_all(text, p)) AS n FROM s, r WHERE len(regexp_extract_all(text, p)) > 0")
def generic_nodes(t: Tables) -> DataFrame:
    return facts.generic_nodes(files(t))


@query(f"WITH {_FILES}, r(detector, p) AS (VALUES {_values((r.name, r.pattern) for r in R.DETECTORS)}) SELECT doc_id, detector, len(regexp_extract_all(text, p)) AS hits FROM s, r WHERE len(regexp_extract_all(text, p)) > 0")
def detector_matches(t: Tables) -> DataFrame:
    return facts.detections(files(t), R.DETECTORS)


@query(f"WITH {_FILES}, r(detector, p) AS (VALUES {_values((r.name, r.pattern) for r in R.DETECTORS if r.name in ('security', 'errors'))}) SELECT detector, count(*) AS files, sum(len(regexp_extract_all(text, p))) AS hits FROM s, r WHERE len(regexp_extract_all(text, p)) > 0 GROUP BY 1")
def critical_detectors(t: Tables) -> DataFrame:
    """Only the detectors that are enabled run."""
    return facts.detections(files(t), R.DETECTORS, ("security", "errors")).groupBy("detector").agg(F.count(F.lit(1)).alias("files"), F.sum("hits").alias("hits"))


def _pack_sql() -> str:
    has = lambda s: f"contains(text, {_q(s)})"
    parts = []
    for p in R.load_packs():
        tests = ([f"lang IN ({', '.join(map(_q, p.languages))})"] if p.languages else []) + [has(x) for x in p.all] + (["(" + " OR ".join(map(has, p.any)) + ")"] if p.any else []) + [f"NOT {has(x)}" for x in p.none]
        parts.append(f"SELECT doc_id, {_q(p.name)} AS pack FROM s WHERE {' AND '.join(tests)}")
    return f"WITH {_FILES} " + " UNION ALL ".join(parts)


@query(_pack_sql())
def pack_matches(t: Tables) -> DataFrame:
    return facts.pack_matches(files(t), R.load_packs())


def _extracted_sql(rules, *groups: str) -> str:
    cols = ", ".join(f"unnest(regexp_extract_all(text, p, {k})) AS {g}" for k, g in enumerate(groups, 1))
    return f"WITH {_FILES}, r(rule, p, langs) AS (VALUES {_values((r.name, r.pattern, _languages(r)) for r in rules)}) SELECT DISTINCT doc_id, rule, {', '.join(groups)} FROM (SELECT doc_id, rule, {cols} FROM s, r WHERE len(langs) = 0 OR list_contains(langs, lang))"


@query(_extracted_sql(R.ENDPOINTS, "method", "path"))
def endpoints(t: Tables) -> DataFrame:
    return facts.extracted(files(t), R.ENDPOINTS, "method", "path")


@query(_extracted_sql(R.MODELS, "model"))
def stored_models(t: Tables) -> DataFrame:
    return facts.extracted(files(t), R.MODELS, "model")


_ALLELES = f"WITH {_FILES}, r(gene, allele, p) AS (VALUES {_values((g, a, p) for g, x in R.GENES.items() for a, p in x.items())}), a AS (SELECT gene, allele, count(*) AS files FROM s, r WHERE regexp_matches(text, p) GROUP BY 1, 2)"


@query(_ALLELES + " SELECT * FROM a")
def style_genes(t: Tables) -> DataFrame:
    return facts.gene_alleles(files(t), R.GENES)


@query(_ALLELES + ", p AS (SELECT *, files / sum(files) OVER (PARTITION BY gene) AS p FROM a) SELECT gene, count(*) AS alleles, arg_min(allele, (-files, allele)) AS dominant, round(max(p), 6) AS consistency, round(-sum(p * log2(p)) + 0.0, 6) AS diversity FROM p GROUP BY 1")
def gene_health(t: Tables) -> DataFrame:
    h = facts.gene_health(facts.gene_alleles(files(t), R.GENES))
    return h.withColumns({"consistency": F.round("consistency", 6), "diversity": F.round("diversity", 6) + 0.0})


@query(f"WITH {_FILES}, {_symbols('import')} SELECT lang, name AS target, {_PATH} AS path, sum(n) AS n FROM y GROUP BY ALL")
def module_paths(t: Tables) -> DataFrame:
    s = facts.symbols(files(t), "import")
    return s.groupBy("lang", F.col("name").alias("target")).agg(F.sum("n").alias("n")).withColumn("path", facts.module_path(F.col("target"), F.col("lang")))


_CALLS = f"""WITH {_FILES}, {_symbols('function', 'call', 'import')}, f AS (SELECT doc_id, regexp_extract(file, '^(.*)/', 1) AS folder, {_STEM} AS stem FROM s),
d AS (SELECT doc_id, lang, name AS callee, folder, stem FROM y JOIN f USING (doc_id) WHERE kind = 'function'), c AS (SELECT doc_id, lang, name AS callee, folder FROM y JOIN f USING (doc_id) WHERE kind = 'call'),
i AS (SELECT DISTINCT doc_id, regexp_extract({_PATH}, '([^/]+)$', 1) AS stem FROM y WHERE kind = 'import'), im AS (SELECT i.doc_id, d.callee, min(d.doc_id) AS x FROM i JOIN d USING (stem) WHERE stem <> '' GROUP BY 1, 2),
fo AS (SELECT folder, callee, min(doc_id) AS x FROM d GROUP BY 1, 2), la AS (SELECT lang, callee, min(doc_id) AS x FROM d GROUP BY 1, 2 HAVING min(doc_id) = max(doc_id)), un AS (SELECT callee, min(doc_id) AS x FROM d GROUP BY 1 HAVING min(doc_id) = max(doc_id)),
fu AS (SELECT lower(replace(callee, '_', '')) AS p, min(doc_id) AS x FROM d GROUP BY 1 HAVING min(doc_id) = max(doc_id)), o AS (SELECT DISTINCT doc_id, callee, doc_id AS x FROM d),
j AS (SELECT c.doc_id, c.callee, o.x AS a, im.x AS b, fo.x AS c, la.x AS d, un.x AS e, fu.x AS f FROM c LEFT JOIN o ON o.doc_id = c.doc_id AND o.callee = c.callee LEFT JOIN im ON im.doc_id = c.doc_id AND im.callee = c.callee LEFT JOIN fo ON fo.folder = c.folder AND fo.callee = c.callee
LEFT JOIN la ON la.lang = c.lang AND la.callee = c.callee LEFT JOIN un ON un.callee = c.callee LEFT JOIN fu ON fu.p = lower(replace(c.callee, '_', ''))),
z AS (SELECT doc_id, callee, CASE WHEN a IS NOT NULL THEN 'same_file' WHEN b IS NOT NULL THEN 'imported' WHEN c IS NOT NULL THEN 'same_folder' WHEN d IS NOT NULL THEN 'language' WHEN e IS NOT NULL THEN 'unique' WHEN f IS NOT NULL THEN 'fuzzy' ELSE 'unresolved' END AS strategy, coalesce(a, b, c, d, e, f) AS target FROM j)"""


@query(_CALLS + " SELECT * FROM z")
def call_graph(t: Tables) -> DataFrame:
    """Each called name of a file with the file that defines it, by six ways."""
    return facts.resolved_calls(files(t))


@query(_CALLS + " SELECT strategy, count(*) AS calls, count(DISTINCT target) AS targets FROM z GROUP BY 1")
def call_graph_strategies(t: Tables) -> DataFrame:
    return facts.resolved_calls(files(t)).groupBy("strategy").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("target").alias("targets"))


_EDGES = f"WITH {_FILES}, {_symbols('import')}, w AS (SELECT {_STEM} AS stem, min(doc_id) AS dst FROM s GROUP BY 1), e AS (SELECT doc_id AS src, dst, sum(n) AS n FROM (SELECT doc_id, n, regexp_extract({_PATH}, '([^/]+)$', 1) AS stem FROM y) i JOIN w USING (stem) WHERE stem <> '' AND doc_id <> dst GROUP BY 1, 2)"


@query(_EDGES + " SELECT * FROM e")
def import_graph(t: Tables) -> DataFrame:
    return facts.import_edges(files(t))


@query(f"""WITH {_FILES}, {_symbols('constant')}, u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][A-Z0-9_]{{2,}}')) AS name FROM s), n AS (SELECT name, count(*) AS uses FROM u GROUP BY 1)
SELECT y.doc_id, y.name FROM y JOIN n USING (name) JOIN (SELECT name, sum(n) AS defined FROM y GROUP BY 1) USING (name) WHERE uses <= defined""")
def dead_constants(t: Tables) -> DataFrame:
    """Constants whose name stands nowhere but where they are defined: names are counted, definitions joined with the counts."""
    f = files(t)
    made = facts.symbols(f, "constant")
    uses = f.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][A-Z0-9_]{2,}"), F.lit(0))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    defined = made.groupBy("name").agg(F.sum("n").alias("defined"))
    return made.join(uses.join(defined, "name").where("uses <= defined"), "name").select("doc_id", "name")


_ENV = r"(?:process\.env\.|process\.env\[['\"]|os\.environ\[['\"]|os\.environ\.get\(['\"]|getenv\(['\"]|ENV\[['\"]|ENV\.fetch\(['\"]|env\(['\"])([A-Z][A-Z0-9_]*)"


@query(f"""WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(matched_text, {_q(_ENV)}, 1)) AS name, location_id FROM pattern_locations), d AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '(?:^|\\n)[ \\t]*([A-Za-z_][A-Za-z0-9_]*)[ \\t]*[=:]', 1))) AS name FROM documents WHERE source = 'config_file')
SELECT name, count(DISTINCT location_id) AS places FROM u WHERE name NOT IN (SELECT name FROM d) GROUP BY 1""")
def missing_env(t: Tables) -> DataFrame:
    """Variables of the environment that code reads and no configuration file sets."""
    read = t.pattern_locations.select("location_id", F.explode(F.regexp_extract_all("matched_text", F.lit(_ENV), F.lit(1))).alias("name")).distinct()
    settings = t.documents.where("source = 'config_file'").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|\n)[ \t]*([A-Za-z_][A-Za-z0-9_]*)[ \t]*[=:]"), F.lit(1))).alias("name")).select(F.upper("name").alias("name")).distinct()
    return read.join(settings, "name", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("places"))


_PROFILE = f"WITH {_FILES}, {_symbols('handler', 'raise', 'function')}"


@query(_PROFILE + """, k AS (SELECT doc_id, lang, sum(n) FILTER (WHERE kind = 'handler') AS h, sum(n) FILTER (WHERE kind = 'raise') AS r, sum(n) FILTER (WHERE kind = 'function') AS f FROM y GROUP BY 1, 2)
SELECT lang, count(*) AS files, CAST(sum(coalesce(h, 0)) AS BIGINT) AS handlers, CAST(sum(coalesce(r, 0)) AS BIGINT) AS raised, count(*) FILTER (WHERE r > 0 AND h IS NULL) AS unhandled, round(sum(coalesce(h, 0)) / greatest(1, sum(coalesce(f, 0))), 6) AS handlers_a_function FROM k GROUP BY 1""")
def error_profile(t: Tables) -> DataFrame:
    """How languages raise and handle errors; files that raise and handle none."""
    s = facts.symbols(files(t), "handler", "raise", "function")
    k = s.groupBy("doc_id", "lang").agg(*[F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(a) for kind, a in (("handler", "h"), ("raise", "r"), ("function", "f"))])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return k.groupBy("lang").agg(
        F.count(F.lit(1)).alias("files"), F.sum(zero("h")).alias("handlers"), F.sum(zero("r")).alias("raised"), F.count_if((F.col("r") > 0) & F.col("h").isNull()).alias("unhandled"), F.round(F.sum(zero("h")) / F.greatest(F.lit(1), F.sum(zero("f"))), 6).alias("handlers_a_function")
    )


_HANDLES = _CALLS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", h AS (SELECT DISTINCT doc_id FROM s WHERE len({R.extracted_sql('handler')}) > 0), r AS (SELECT DISTINCT doc_id FROM s WHERE len({R.extracted_sql('raise')}) > 0),
g AS (SELECT DISTINCT target AS src, doc_id AS dst FROM z WHERE target IS NOT NULL AND target <> doc_id AND strategy <> 'fuzzy')"""


@query(_HANDLES + ", u AS (SELECT doc_id AS node FROM r UNION SELECT g.dst FROM u JOIN g ON g.src = u.node WHERE u.node NOT IN (SELECT doc_id FROM h)) SELECT node AS doc_id, node IN (SELECT doc_id FROM h) AS handled FROM u")
def error_chains(t: Tables) -> DataFrame:
    """The files that an error reaches on its way up the calls: from files that raise, through callers, up to those that handle."""
    from quarrymill.operators import graph

    f = files(t)
    marked = f.select("doc_id", (F.size(facts.names_of("handler")) > 0).alias("handled"), (F.size(facts.names_of("raise")) > 0).alias("raises"))
    calls = facts.resolved_calls(f).where("target IS NOT NULL AND target <> doc_id AND strategy <> 'fuzzy'").select(F.col("target").alias("src"), F.col("doc_id").alias("dst")).distinct()
    open_ = cut(calls.join(marked.where("NOT handled").select(F.col("doc_id").alias("src")), "src", "left_semi"))
    met = graph.reached(open_, marked.where("raises").select(F.col("doc_id").alias("node")))
    return met.select(F.col("node").alias("doc_id")).join(marked.select("doc_id", "handled"), "doc_id")


@query(f"""WITH {_FILES}, f AS (SELECT doc_id, len(regexp_extract_all(text, '(?:assert|expect\\()')) AS asserts, len(regexp_extract_all(text, '(?:sleep\\(|setTimeout\\()')) AS waits, len(regexp_extract_all(text, '(?:mock|stub|spy)')) AS doubles FROM s WHERE regexp_matches(file, '(?:^|/)(?:tests?|spec)/|[._-](?:test|spec)\\.'))
SELECT doc_id, asserts, waits, doubles, list_filter(['no_assertion', 'sleeps', 'over_mocked'], lambda x: (x = 'no_assertion' AND asserts = 0) OR (x = 'sleeps' AND waits > 0) OR (x = 'over_mocked' AND doubles > greatest(3, 2 * asserts))) AS smells FROM f""")
def test_smells(t: Tables) -> DataFrame:
    n = lambda p, a: F.regexp_count("text", F.lit(p)).cast("bigint").alias(a)
    f = files(t).where(F.col("file").rlike(r"(?:^|/)(?:tests?|spec)/|[._-](?:test|spec)\.")).select("doc_id", n(r"(?:assert|expect\()", "asserts"), n(r"(?:sleep\(|setTimeout\()", "waits"), n("(?:mock|stub|spy)", "doubles"))
    smells = F.array_compact(F.array(F.when(F.col("asserts") == 0, "no_assertion"), F.when(F.col("waits") > 0, "sleeps"), F.when(F.col("doubles") > F.greatest(F.lit(3), 2 * F.col("asserts")), "over_mocked")))
    return f.withColumn("smells", smells)


@query(f"""WITH {_FILES}, {_symbols('function', 'call')}, c AS (SELECT name AS primitive, count(DISTINCT doc_id) AS callers FROM y WHERE kind = 'call' GROUP BY 1), w AS (SELECT DISTINCT f.name AS wrapper, c.primitive FROM y f JOIN y x ON x.doc_id = f.doc_id AND x.kind = 'call' JOIN c ON c.primitive = x.name
WHERE f.kind = 'function' AND length(x.name) >= 4 AND f.name <> x.name AND contains(lower(replace(f.name, '_', '')), lower(replace(x.name, '_', ''))))
SELECT primitive, count(*) AS wrappers, min(wrapper) AS first FROM w GROUP BY 1""")
def wrapper_clusters(t: Tables) -> DataFrame:
    """Functions named after a function that their file calls, grouped by what they wrap."""
    s = facts.symbols(files(t), "function", "call")
    plain = lambda c: F.lower(F.regexp_replace(c, "_", ""))
    made, used = s.where("kind = 'function'").select("doc_id", F.col("name").alias("wrapper")), s.where("kind = 'call'").select("doc_id", F.col("name").alias("primitive"))
    named = made.join(used, "doc_id").where((F.length("primitive") >= 4) & (F.col("wrapper") != F.col("primitive")) & F.contains(plain("wrapper"), plain("primitive"))).select("wrapper", "primitive").distinct()
    return named.groupBy("primitive").agg(F.count(F.lit(1)).alias("wrappers"), F.min("wrapper").alias("first"))


@query(f"WITH {_FILES}, l AS (SELECT doc_id, unnest({R.extracted_sql('literal')}) AS v FROM s) SELECT lower(trim(v)) AS literal, count(*) AS n, count(DISTINCT doc_id) AS files FROM l GROUP BY 1 HAVING count(*) > 1")
def string_literals(t: Tables) -> DataFrame:
    """Cleaned string literals that come more than once."""
    each = files(t).select("doc_id", F.explode(facts.names_of("literal")).alias("v")).select("doc_id", F.lower(F.trim("v")).alias("literal"))
    return each.groupBy("literal").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("files")).where("n > 1")


@query("""WITH w AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 64 AS pos FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE source = 'memory_note')), c AS (SELECT doc_id, pos, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, pos, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def hashed_embedding(t: Tables) -> DataFrame:
    """Memory notes as vectors of hashed word counts."""
    return facts.hashed_embedding(t.documents.where("source = 'memory_note'"), "doc_id", "text").withColumn("value", F.round("value", 6))


_CERTAIN = r"(?:^|[^a-z])(always|never|usually|rarely)[ ]+([a-z]+)"


@query(f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {_q(_CERTAIN)}, 1)) AS word, unnest(regexp_extract_all(lower(text), {_q(_CERTAIN)}, 2)) AS subject FROM documents WHERE source = 'memory_note'),
g AS (SELECT subject, count(DISTINCT doc_id) FILTER (WHERE word IN ('always', 'usually')) AS positive, count(DISTINCT doc_id) FILTER (WHERE word IN ('never', 'rarely')) AS negative FROM c GROUP BY 1) SELECT * FROM g WHERE positive > 0 AND negative > 0""")
def absolute_conflicts(t: Tables) -> DataFrame:
    """What some notes say happens and others that it does not: statements keyed by what they say, never compared two by two."""
    low = F.lower("text")
    said = t.documents.where("source = 'memory_note'").select("doc_id", F.explode(F.arrays_zip(F.regexp_extract_all(low, F.lit(_CERTAIN), F.lit(1)).alias("word"), F.regexp_extract_all(low, F.lit(_CERTAIN), F.lit(2)).alias("subject"))).alias("c")).select("doc_id", "c.*")
    count = lambda words, a: F.count_distinct(F.when(F.col("word").isin(*words), F.col("doc_id"))).alias(a)
    return said.groupBy("subject").agg(count(("always", "usually"), "positive"), count(("never", "rarely"), "negative")).where("positive > 0 AND negative > 0")


@query("SELECT regexp_extract(text, '(?:^|\\n)(ERROR|WARN|INFO)[ ]', 1) AS level, regexp_extract(text, '\\[([a-z_]+)/', 1) AS category, count(*) AS reports FROM documents WHERE source = 'violation_report' AND text IS NOT NULL GROUP BY 1, 2")
def report_heads(t: Tables) -> DataFrame:
    d = t.documents.where("source = 'violation_report' AND text IS NOT NULL")
    return d.groupBy(F.regexp_extract("text", r"(?:^|\n)(ERROR|WARN|INFO)[ ]", 1).alias("level"), F.regexp_extract("text", r"\[([a-z_]+)/", 1).alias("category")).agg(F.count(F.lit(1)).alias("reports"))


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 197) || '...' END AS short, CASE WHEN text IS NULL THEN 0 ELSE CAST(ceil(length(text) / 4) AS BIGINT) END AS estimated_tokens FROM documents""")
def text_truncation(t: Tables) -> DataFrame:
    n = F.length("text")
    return t.documents.select("doc_id", F.when(n <= 200, F.col("text")).otherwise(F.concat(F.substring("text", 1, 197), F.lit("..."))).alias("short"), F.coalesce(F.ceil(n / 4), F.lit(0)).cast("bigint").alias("estimated_tokens"))


_CWE = {"security": 79, "auth": 287, "errors": 703, "data_access": 89, "config": 15}


@query(f"WITH {_FILES}, r(detector, p, cwe) AS (VALUES {', '.join(f'({_q(r.name)}, {_q(r.pattern)}, {_CWE[r.name]})' for r in R.DETECTORS if r.name in _CWE)}) SELECT cwe, count(*) AS files, sum(len(regexp_extract_all(text, p))) AS hits FROM s, r WHERE len(regexp_extract_all(text, p)) > 0 GROUP BY 1")
def cwe_findings(t: Tables) -> DataFrame:
    """Detections by weakness."""
    number = F.create_map(*[F.lit(x) for kv in _CWE.items() for x in kv])
    d = facts.detections(files(t), R.DETECTORS, tuple(_CWE))
    return d.groupBy(number[F.col("detector")].alias("cwe")).agg(F.count(F.lit(1)).alias("files"), F.sum("hits").alias("hits"))
