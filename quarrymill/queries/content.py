"""Queries on text, sets, names and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import retrieval, similarity, text, vectors
from quarrymill.plans.session import spread
from quarrymill.queries.registry import Tables, collection

QUERIES, SQL, query = collection()

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]{3,}')"
_QUERY = ("metric", "violation", "namespace")


def messages(t: Tables) -> DataFrame:
    return t.violations.select("id", text.words(F.col("message")).alias("words")).distinct()


_SETS = """WITH RECURSIVE w AS (SELECT DISTINCT id, list_sort(list_distinct(regexp_extract_all(lower(message), '[a-z0-9]{3,}'))) AS s FROM violations), r AS (SELECT s, min(id) AS rep FROM w WHERE len(s) > 0 GROUP BY 1),
p AS (SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.s, y.s)) / len(list_distinct(x.s || y.s)) AS similarity FROM r x JOIN r y ON x.rep < y.rep AND least(len(x.s), len(y.s)) >= 0.6 * greatest(len(x.s), len(y.s)) - 0.000001)"""


@query(_SETS + " SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.6")
def jaccard_pairs(t: Tables) -> DataFrame:
    """Messages whose words agree by 0.6, each different set of words by its smallest id; jaccard_members says whom that stands for."""
    pairs, _ = similarity.similar_sets(messages(t), "id", "words", 0.6)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query(_SETS + " SELECT id, rep FROM w JOIN r USING (s)")
def jaccard_members(t: Tables) -> DataFrame:
    return similarity.similar_sets(messages(t), "id", "words", 0.6)[1]


@query(_SETS + """, e AS (SELECT a, b FROM p WHERE similarity >= 0.9 UNION ALL SELECT b, a FROM p WHERE similarity >= 0.9), c AS (SELECT rep AS id, rep AS reached FROM r UNION SELECT c.id, e.b FROM c JOIN e ON c.reached = e.a),
g AS (SELECT id AS rep, min(reached) AS class FROM c GROUP BY 1), n AS (SELECT a AS rep, count(*) AS links FROM e GROUP BY 1) SELECT w.id, g.class, coalesce(n.links, 0) AS links FROM w JOIN r USING (s) JOIN g USING (rep) LEFT JOIN n USING (rep)""")
def word_overlap_members(t: Tables) -> DataFrame:
    """Each message with the class of messages that agree by 0.9 with it, directly or through others, and how many different ones do so directly."""
    return similarity.similar_classes(messages(t), "id", "words", 0.9)


@query()
def minhash_lsh_candidates(t: Tables) -> DataFrame:
    """Pairs of different sets of words that meet in a band and agree by 0.8, verified; their recall is measured against the exact pairs in the tests."""
    return similarity.minhash_pairs(messages(t), "id", "words", 0.8)


@query("SELECT sha256(text) AS hash, min(doc_id) AS rep, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_dedup(t: Tables) -> DataFrame:
    return similarity.copies(t.documents, "doc_id", F.col("text"))


@query("SELECT normal, list_sort(list(DISTINCT metric_name)) AS spellings, count(*) AS n FROM (SELECT *, lower(replace(replace(trim(metric_name), '_', ''), '-', '')) AS normal FROM bridge_metrics) GROUP BY 1 HAVING count(DISTINCT metric_name) > 1")
def naming_inconsistency(t: Tables) -> DataFrame:
    return similarity.spellings(t.bridge_metrics, "metric_name")


@query("""WITH n AS (SELECT DISTINCT regexp_extract(file, '^(.*)/', 1) AS dir, regexp_extract(file, '([^/]+)$', 1) AS name FROM pattern_locations) SELECT x.dir, x.name AS a, y.name AS b, levenshtein(x.name, y.name) AS distance FROM n x JOIN n y ON x.dir = y.dir AND x.name < y.name WHERE levenshtein(x.name, y.name) <= 3""")
def levenshtein_renames(t: Tables) -> DataFrame:
    """Files of one folder whose names are within three edits."""
    names = t.pattern_locations.select(F.regexp_extract("file", "^(.*)/", 1).alias("dir"), F.regexp_extract("file", "([^/]+)$", 1).alias("name"))
    return similarity.near_names(names, "dir", "name", 3).withColumn("distance", F.col("distance").cast("bigint"))


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), n AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM w GROUP BY 1), t AS (SELECT (SELECT count(*) FROM w) AS al, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS docs)
SELECT term, df, round(n / al * (ln(docs / df) + 1), 9) AS score FROM n, t ORDER BY score DESC, term LIMIT 50""")
def tfidf_top(t: Tables) -> DataFrame:
    return text.tfidf(t.documents, "doc_id", "text")


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, len(w) AS n FROM w WHERE len(w) > 0), g AS (SELECT count(*) AS docs, avg(n) AS mean FROM s), q(term) AS (VALUES {", ".join(f"('{w}')" for w in _QUERY)}),
h AS (SELECT doc_id, n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM s, q), f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1)
SELECT doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM h JOIN f USING (term), g WHERE tf > 0 GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_search(t: Tables) -> DataFrame:
    return text.bm25(t.documents, "doc_id", "text", _QUERY)


_PII_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM documents WHERE regexp_matches(text, '{p}')" for k, (p, _) in text.PERSONAL.items())


@query(_PII_SQL)
def pii_scan(t: Tables) -> DataFrame:
    return text.pattern_counts(t.documents, "doc_id", "text", {k: p for k, (p, _) in text.PERSONAL.items()}).withColumn("n", F.col("n").cast("bigint"))


def _redact_sql() -> str:
    out = "text"
    for p, by in text.PERSONAL.values():
        out = f"regexp_replace({out}, '{p}', '{by}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_redact_sql()}) AS digest FROM documents WHERE text IS NOT NULL")
def pii_redact(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.md5(text.redact_personal(F.col("text"))).alias("digest"))


@query("""WITH l AS (SELECT DISTINCT location_id, matched_text FROM pattern_locations) SELECT location_id, 'loop' AS kind, len(regexp_extract_all(matched_text, '\\b(?:for|while)\\b')) AS n FROM l WHERE regexp_matches(matched_text, '\\b(?:for|while)\\b')
UNION ALL SELECT location_id, 'url', len(regexp_extract_all(matched_text, '[a-z]+://[^ "'']+')) FROM l WHERE regexp_matches(matched_text, '[a-z]+://[^ "'']+') UNION ALL SELECT location_id, 'call', len(regexp_extract_all(matched_text, '[A-Za-z_]+\\(')) FROM l WHERE regexp_matches(matched_text, '[A-Za-z_]+\\(')""")
def regex_set_match(t: Tables) -> DataFrame:
    rows = t.pattern_locations.select("location_id", "matched_text").distinct()
    return text.pattern_counts(rows, "location_id", "matched_text", {"loop": r"\b(?:for|while)\b", "url": r"[a-z]+://[^ \"']+", "call": r"[A-Za-z_]+\("}).withColumn("n", F.col("n").cast("bigint"))


@query("""WITH c AS (SELECT location_id, unnest(regexp_extract_all(hex(encode(matched_text)), '..')) AS b FROM (SELECT DISTINCT location_id, matched_text FROM pattern_locations WHERE matched_text <> '')), n AS (SELECT location_id, b, count(*) AS n FROM c GROUP BY 1, 2),
p AS (SELECT location_id, n / sum(n) OVER (PARTITION BY location_id) AS p FROM n) SELECT location_id, round(-sum(p * log2(p)) + 0.0, 5) AS bits FROM p GROUP BY 1""")
def shannon_entropy(t: Tables) -> DataFrame:
    rows = t.pattern_locations.select("location_id", "matched_text").where("matched_text <> ''").distinct()
    return rows.select("location_id", F.round(text.byte_entropy("matched_text"), 5).alias("bits"))


@query("""WITH n AS (SELECT DISTINCT location_id, regexp_extract(matched_text, '([A-Za-z_][A-Za-z0-9_]*) ?[:=]', 1) AS name FROM pattern_locations WHERE matched_text IS NOT NULL), k AS (SELECT *, CASE
WHEN regexp_matches(lower(name), 'password|passwd|pwd|secret|token|apikey|api_key') THEN 'credential' WHEN regexp_matches(lower(name), 'email|phone|address') THEN 'contact' WHEN regexp_matches(lower(name), 'card|iban|account') THEN 'financial' WHEN regexp_matches(lower(name), 'ssn|birth|passport') THEN 'identity' END AS kind FROM n)
SELECT location_id, name, kind FROM k WHERE kind IS NOT NULL""")
def sensitive_fields(t: Tables) -> DataFrame:
    names = t.pattern_locations.where("matched_text IS NOT NULL").select("location_id", F.regexp_extract("matched_text", "([A-Za-z_][A-Za-z0-9_]*) ?[:=]", 1).alias("name")).distinct()
    return names.withColumn("kind", text.sensitivity(F.col("name"))).where("kind IS NOT NULL")


@query("""WITH l AS (SELECT DISTINCT location_id, matched_text FROM pattern_locations), n AS (SELECT location_id, unnest(regexp_extract_all(matched_text, '\\b[0-9]{2,9}\\b')) AS v FROM l) SELECT CAST(v AS BIGINT) AS number, count(*) AS uses, count(DISTINCT location_id) AS places FROM n WHERE CAST(v AS BIGINT) NOT IN (0, 1, 2, 10, 100, 1000) GROUP BY 1""")
def magic_numbers(t: Tables) -> DataFrame:
    rows = t.pattern_locations.select("location_id", "matched_text").distinct()
    found = rows.select("location_id", F.explode(F.regexp_extract_all("matched_text", F.lit(r"(\b[0-9]{2,9}\b)"), F.lit(1))).alias("_v")).select("location_id", F.col("_v").cast("bigint").alias("number"))
    return found.where(~F.col("number").isin(0, 1, 2, 10, 100, 1000)).groupBy("number").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("location_id").alias("places"))


@query("""WITH n AS (SELECT unnest(regexp_extract_all(matched_text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM (SELECT DISTINCT location_id, matched_text FROM pattern_locations)) SELECT CASE WHEN regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)+') THEN 'snake' WHEN regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)+') THEN 'upper_snake'
WHEN regexp_full_match(name, '[a-z][a-z0-9]*([A-Z][a-z0-9]*)+') THEN 'camel' WHEN regexp_full_match(name, '([A-Z][a-z0-9]+)+') THEN 'pascal' WHEN regexp_full_match(name, '[a-z0-9]+') THEN 'lower' ELSE 'other' END AS convention, count(*) AS uses, count(DISTINCT name) AS names FROM n GROUP BY 1""")
def naming_conventions(t: Tables) -> DataFrame:
    rows = t.pattern_locations.select("location_id", "matched_text").distinct()
    names = rows.select(F.explode(F.regexp_extract_all("matched_text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("name"))
    return names.groupBy(text.convention(F.col("name")).alias("convention")).agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("name").alias("names"))


@query("""WITH f AS (SELECT DISTINCT file FROM pattern_locations), e AS (SELECT file, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM f) SELECT CASE WHEN x IN ('ts', 'tsx') THEN 'typescript' WHEN x IN ('js', 'jsx') THEN 'javascript' WHEN x = 'py' THEN 'python' WHEN x = 'go' THEN 'go' WHEN x = 'rs' THEN 'rust' WHEN x = 'java' THEN 'java' WHEN x = 'kt' THEN 'kotlin'
WHEN x = 'cs' THEN 'csharp' WHEN x = 'rb' THEN 'ruby' WHEN x = 'php' THEN 'php' END AS language, count(*) AS files FROM e GROUP BY 1""")
def language_by_extension(t: Tables) -> DataFrame:
    return t.pattern_locations.select("file").distinct().groupBy(text.language_of(F.col("file")).alias("language")).agg(F.count(F.lit(1)).alias("files"))


@query()
def textrank(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text")).select("doc_id", text.summary("text").alias("summary"))


_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"""WITH {_E}, p AS (SELECT q.vec_id AS query, e.vec_id, greatest(-1, least(1, list_cosine_similarity(q.v, e.v))) AS c FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query, vec_id, round(c, 6) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, vec_id) <= 10""")
def cosine_topk(t: Tables) -> DataFrame:
    """The ten most similar vectors to each whose id is divisible by 100."""
    e = t.embeddings
    return vectors.nearest(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), 10).withColumn("cosine", F.round("cosine", 6))


@query()
def indexed_topk(t: Tables) -> DataFrame:
    """As cosine_topk, by an index over all vectors; its recall is measured in the tests."""
    e = t.embeddings
    return vectors.indexed_nearest(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), 10).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_E}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS value FROM x GROUP BY 1, 2")
def centroids(t: Tables) -> DataFrame:
    return vectors.centroids(t.embeddings, "label", "embedding").withColumn("value", F.round("value", 6))


@query(f"""WITH {_E}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1),
p AS (SELECT c.label AS g, e.label, e.vec_id FROM c, e QUALIFY row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(c.v, e.v), 9) DESC, e.vec_id) <= 10), h AS (SELECT g, count(*) FILTER (WHERE label = g) AS n FROM p GROUP BY 1)
SELECT label, count(*) AS members, any_value(n) AS recalled, any_value(n) / least(10, count(*)) >= 0.3 AS passed FROM e JOIN h ON h.g = label GROUP BY 1""")
def centroid_recall_gate(t: Tables) -> DataFrame:
    return vectors.recall_gate(t.embeddings, "vec_id", "label", "embedding")


@query(f"WITH {_E}, h AS (SELECT vec_id, v[1:16] AS h FROM e), n AS (SELECT vec_id, h, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS n FROM h) SELECT vec_id, list_transform(h, lambda x: round(CASE WHEN n > 0 THEN x / n ELSE 0 END, 6)) AS head FROM n")
def matryoshka_truncate(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.transform(vectors.truncated(F.col("embedding"), 16), lambda x: F.round(x, 6)).alias("head"))


@query(f"WITH {_E} SELECT x.vec_id, round(list_cosine_similarity(x.v, y.v), 6) AS cosine FROM e x JOIN e y ON y.vec_id = x.vec_id + 1")
def cosine_neighbours(t: Tables) -> DataFrame:
    e = t.embeddings
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def _lists(t: Tables) -> list[DataFrame]:
    by_text = text.bm25(t.documents, "doc_id", "text", _QUERY)
    recent = t.documents.where("text IS NOT NULL").select("doc_id", F.col("collected_at").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
    return [by_text, recent]




@query(f"""WITH b AS ({SQL["bm25_search"]}), c AS (SELECT doc_id, collected_at AS score FROM documents WHERE text IS NOT NULL ORDER BY score DESC, doc_id LIMIT 20),
r AS (SELECT doc_id, 1.0 / (59 + row_number() OVER (ORDER BY score DESC, doc_id)) AS s FROM b UNION ALL SELECT doc_id, 1.0 / (59 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM c) SELECT doc_id, round(sum(s), 9) AS fused FROM r GROUP BY 1""")
def rrf_fusion(t: Tables) -> DataFrame:
    return retrieval.fuse(_lists(t), "doc_id", "score").withColumn("fused", F.round("fused", 9))


@query("""SELECT location_id, pattern_id, CAST(used AS BIGINT) AS used FROM (SELECT location_id, pattern_id, sum(length(matched_text)) OVER (PARTITION BY pattern_id ORDER BY confidence DESC, location_id ROWS UNBOUNDED PRECEDING) AS used
FROM (SELECT DISTINCT location_id, pattern_id, matched_text, confidence FROM pattern_locations WHERE matched_text IS NOT NULL AND confidence IS NOT NULL)) WHERE used <= 1000""")
def budget_pack(t: Tables) -> DataFrame:
    rows = t.pattern_locations.where("matched_text IS NOT NULL AND confidence IS NOT NULL").select("location_id", "pattern_id", F.length("matched_text").alias("cost"), "confidence", F.xxhash64("matched_text").alias("_h")).distinct()
    return retrieval.within_budget(rows, "pattern_id", "cost", 1000, F.desc("confidence"), F.col("location_id")).select("location_id", "pattern_id", F.col("used").cast("bigint").alias("used"))


@query("""WITH p AS (SELECT DISTINCT location_id, pattern_id, confidence FROM pattern_locations WHERE confidence IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY confidence DESC, location_id) AS r, count(*) OVER (PARTITION BY pattern_id) AS n FROM p)
SELECT location_id, pattern_id, CASE WHEN r % 2 = 1 THEN (r + 1) // 2 ELSE n + 1 - r // 2 END AS place FROM r""")
def primacy_order(t: Tables) -> DataFrame:
    rows = t.pattern_locations.where("confidence IS NOT NULL").select("location_id", "pattern_id", "confidence").distinct()
    return retrieval.first_and_last(rows, "pattern_id", "confidence", "location_id").drop("confidence")
