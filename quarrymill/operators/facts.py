"""Facts read from source text by rules: symbols, generic nodes, detections, packs, endpoints, models, genes; and graphs built from them.

All reading is done by built-in expressions, one pass over a text for each rule that applies to its language; nothing is gathered
by text. Null texts give no facts, empty ones none either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import rules as R


def language(file: Column) -> Column:
    """The language of a file by its ending; null for others."""
    ending = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in R.LANGUAGES.items() for x in kv])[ending]


def source_files(documents: DataFrame) -> DataFrame:
    """doc_id, root_path, file, lang, text of the source files with a text."""
    return documents.where((F.col("source") == "source_file") & F.col("text").isNotNull()).select("doc_id", "root_path", "file", language(F.col("file")).alias("lang"), "text")


def names_of(kind: str) -> Column:
    """All names of one kind of symbol in `text` of `lang`, in order."""
    by = R.SYMBOLS[kind]
    none = F.array().cast("array<string>")
    return reduce(lambda rest, kv: F.when(F.col("lang") == kv[0], F.regexp_extract_all("text", F.lit(kv[1]), F.lit(1))).otherwise(rest), by.items(), none)


def symbols(files: DataFrame, *kinds: str) -> DataFrame:
    """doc_id, lang, kind, name, n: how often each symbol of these kinds stands in a file. Words that call nothing are no calls."""
    named = lambda k: F.transform(names_of(k), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("name")))
    pairs = F.flatten(F.array(*map(named, kinds)))
    rows = files.select("doc_id", "lang", F.explode(pairs).alias("s")).select("doc_id", "lang", "s.*").where(F.col("name") != "")
    return rows.where((F.col("kind") != "call") | ~F.col("name").isin(*R.NO_CALLS)).groupBy("doc_id", "lang", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


def parsed(files: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """doc_id, lang and the number of symbols of each kind. Each different text is parsed once, whatever number of files has it (a parse cache by hash)."""
    keyed = files.withColumn("_hash", F.xxhash64("text", F.coalesce("lang", F.lit(""))))
    once = keyed.groupBy("_hash").agg(F.min(F.struct("lang", "text")).alias("f")).select("_hash", "f.*")
    counts = once.select("_hash", *[F.size(names_of(k)).alias(f"{k}s") for k in kinds])
    return keyed.select("doc_id", "lang", "_hash").join(counts, "_hash").drop("_hash")


def generic_nodes(files: DataFrame) -> DataFrame:
    """doc_id, node, n: how many nodes of each generic kind a file has, kinds it lacks left out."""
    counted = F.array(*[F.struct(F.lit(k).alias("node"), F.regexp_count("text", F.lit(p)).cast("bigint").alias("n")) for k, p in R.GENERIC.items()])
    return files.select("doc_id", F.explode(counted).alias("g")).select("doc_id", "g.*").where("n > 0")


def _applies(rule: R.Rule) -> Column:
    return F.col("lang").isin(*rule.languages) if rule.languages else F.lit(True)


def detections(files: DataFrame, rules: Sequence[R.Rule], enabled: Sequence[str] | None = None) -> DataFrame:
    """doc_id, detector, hits of each rule that hits; `enabled` names those that run."""
    run = [r for r in rules if enabled is None or r.name in enabled]
    counted = F.array(*[F.struct(F.lit(r.name).alias("detector"), F.when(_applies(r), F.regexp_count("text", F.lit(r.pattern))).otherwise(0).cast("bigint").alias("hits")) for r in run])
    return files.select("doc_id", F.explode(counted).alias("d")).select("doc_id", "d.*").where("hits > 0")


def pack_matches(files: DataFrame, packs: Sequence[R.Pack]) -> DataFrame:
    """doc_id, pack of the files in which all of a pack's `all`, one of its `any` and none of its `none` stand."""

    def holds(p: R.Pack) -> Column:
        has = lambda s: F.contains(F.col("text"), F.lit(s))
        parts = [F.col("lang").isin(*p.languages)] if p.languages else []
        parts += [has(s) for s in p.all] + ([reduce(lambda a, b: a | b, map(has, p.any))] if p.any else []) + [~has(s) for s in p.none]
        return reduce(lambda a, b: a & b, parts)

    found = F.array_compact(F.array(*[F.when(holds(p), F.lit(p.name)) for p in packs]))
    return files.select("doc_id", F.explode(found).alias("pack"))


def extracted(files: DataFrame, rules: Sequence[R.Rule], *groups: str) -> DataFrame:
    """doc_id, rule and the groups of each match of each rule, in the order of the text; equal ones once."""
    none = F.array().cast(f"array<struct<rule:string,{','.join(f'{g}:string' for g in groups)}>>")

    def matches(r: R.Rule) -> Column:
        cols = [F.regexp_extract_all("text", F.lit(r.pattern), F.lit(k)).alias(g) for k, g in enumerate(groups, 1)]
        return F.when(_applies(r), F.transform(F.arrays_zip(*cols), lambda x: F.struct(F.lit(r.name).alias("rule"), *[x[g].alias(g) for g in groups]))).otherwise(none)

    return files.select("doc_id", F.explode(F.flatten(F.array(*map(matches, rules)))).alias("m")).select("doc_id", "m.*").distinct()


def gene_alleles(files: DataFrame, genes: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """gene, allele, files: in how many files each allele of a gene stands."""
    marked = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(g).alias("gene"), F.lit(a).alias("allele"))) for g, alleles in genes.items() for a, p in alleles.items()]))
    return files.select(F.explode(marked).alias("m")).groupBy("m.gene", "m.allele").agg(F.count(F.lit(1)).alias("files"))


def gene_health(alleles: DataFrame) -> DataFrame:
    """gene, alleles, dominant, consistency (share of the most frequent allele), diversity (Shannon, in bits)."""
    total = alleles.groupBy("gene").agg(F.sum("files").alias("_all"))
    share = alleles.join(total, "gene").withColumn("_p", F.col("files") / F.col("_all"))
    return share.groupBy("gene").agg(
        F.count(F.lit(1)).alias("alleles"), F.min(F.struct((-F.col("files")).alias("n"), "allele"))["allele"].alias("dominant"), F.max("_p").alias("consistency"), (-F.sum(F.col("_p") * F.log2("_p")) + 0.0).alias("diversity")
    )


def module_path(target: Column, lang: Column) -> Column:
    """An import's target as a path: separators of the language become '/', leading dots and slashes go, lower case."""
    dotted = lang.isin("python", "java", "kotlin", "csharp")
    parts = F.when(dotted, F.regexp_replace(target, r"\.", "/")).when(lang == "php", F.regexp_replace(target, r"\\", "/")).when(lang == "rust", F.regexp_replace(target, "::", "/")).otherwise(target)
    return F.lower(F.regexp_replace(parts, r"^[./]+", ""))


def stem(file: Column) -> Column:
    """A file's name without folder and ending, lower case."""
    return F.lower(F.regexp_extract(file, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1))


def resolved_calls(files: DataFrame) -> DataFrame:
    """doc_id, callee, strategy, target: where each called name is defined, by the first of six ways that finds it:

    same_file; imported (a file whose name an import ends with); same_folder; language (the only file of that language);
    unique (the only file); fuzzy (the only file, without case and '_'). Others are unresolved. Definitions are reduced to
    one row a name and place before they meet the calls, so a name that is defined everywhere costs no more than any other.
    """
    s = symbols(files, "function", "call", "import")
    at = files.select("doc_id", F.regexp_extract("file", "^(.*)/", 1).alias("folder"), stem(F.col("file")).alias("stem"))
    defined = s.where("kind = 'function'").select("doc_id", "lang", F.col("name").alias("callee")).join(at, "doc_id")
    calls = s.where("kind = 'call'").select("doc_id", "lang", F.col("name").alias("callee")).join(at.select("doc_id", "folder"), "doc_id")
    imports = s.where("kind = 'import'").select("doc_id", F.regexp_extract(module_path(F.col("name"), F.col("lang")), "([^/]+)$", 1).alias("stem")).where("stem <> ''").distinct()
    only = lambda name, *keys: defined.groupBy(*keys).agg(F.min("doc_id").alias(name), F.max("doc_id").alias("_max")).where(F.col(name) == F.col("_max")).drop("_max")
    plain = lambda c: F.lower(F.regexp_replace(c, "_", ""))
    own = defined.select("doc_id", "callee", F.col("doc_id").alias("_same")).distinct()
    by_stem = defined.groupBy("stem", "callee").agg(F.min("doc_id").alias("_by"))
    through = imports.join(by_stem, "stem").groupBy("doc_id", "callee").agg(F.min("_by").alias("_imported"))
    folder = defined.groupBy("folder", "callee").agg(F.min("doc_id").alias("_folder"))
    fuzzy = defined.groupBy(plain(F.col("callee")).alias("_plain")).agg(F.min("doc_id").alias("_fuzzy"), F.max("doc_id").alias("_m")).where("_fuzzy = _m").drop("_m")
    out = calls.join(own, ["doc_id", "callee"], "left").join(through, ["doc_id", "callee"], "left").join(folder, ["folder", "callee"], "left")
    out = out.join(only("_lang", "lang", "callee"), ["lang", "callee"], "left").join(only("_unique", "callee"), "callee", "left")
    out = out.withColumn("_plain", plain(F.col("callee"))).join(fuzzy, "_plain", "left")
    ways = {"same_file": "_same", "imported": "_imported", "same_folder": "_folder", "language": "_lang", "unique": "_unique", "fuzzy": "_fuzzy"}
    strategy = reduce(lambda rest, kv: F.when(F.col(kv[1]).isNotNull(), F.lit(kv[0])).otherwise(rest), reversed(list(ways.items())), F.lit("unresolved"))
    return out.select("doc_id", "callee", strategy.alias("strategy"), F.coalesce(*ways.values()).alias("target"))


def import_edges(files: DataFrame) -> DataFrame:
    """src, dst, n: files that import a file by its name (the smallest doc_id of several), itself left out."""
    s = symbols(files, "import")
    ends = s.select(F.col("doc_id").alias("src"), F.regexp_extract(module_path(F.col("name"), F.col("lang")), "([^/]+)$", 1).alias("stem"), "n").where("stem <> ''")
    where = files.select("doc_id", stem(F.col("file")).alias("stem")).groupBy("stem").agg(F.min("doc_id").alias("dst"))
    return ends.join(where, "stem").where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def hashed_embedding(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """key, pos, value: word counts hashed into `size` places (first 6 hex digits of md5), of length 1; a sparse vector, a row for each place that is not 0."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    counts = words.groupBy(key, "w").agg(F.count(F.lit(1)).alias("n")).select(key, F.pmod(F.conv(F.substring(F.md5("w"), 1, 6), 16, 10).cast("bigint"), F.lit(size)).alias("pos"), "n")
    sums = counts.groupBy(key, "pos").agg(F.sum("n").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))  # at most `size` rows a key
    return sums.select(key, "pos", (F.col("n") / norm).alias("value"))
