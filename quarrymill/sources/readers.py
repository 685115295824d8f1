"""Sources: folders of files, settings, decision records, schemas, commit logs, tables after a cursor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def scan_folder(spark: SparkSession, root: str, pattern: str = "*", most_bytes: int = 1 << 20, skip: Sequence[str] = ("node_modules", ".git")) -> DataFrame:
    """path, size, modified, hash of the files below root; larger ones and those in skipped folders are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    kept = files.where(F.col("length") <= most_bytes)
    for s in skip:
        kept = kept.where(~F.contains(F.col("path"), F.lit(f"/{s}/")))
    return kept.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.xxhash64("content").alias("hash"))


def classify_files(now: DataFrame, known: DataFrame) -> DataFrame:
    """path, status of scan_folder rows against known(path, modified, hash): an unchanged time needs no look at the content."""
    k = known.select("path", F.col("modified").alias("_m"), F.col("hash").alias("_h"), F.lit(True).alias("_was"))
    n = now.select("path", "modified", "hash", F.lit(True).alias("_is"))
    same = (F.col("modified") == F.col("_m")) | (F.col("hash") == F.col("_h"))
    status = F.when(F.col("_is").isNull(), "removed").when(F.col("_was").isNull(), "added").when(same, "unchanged").otherwise("modified")
    return n.join(k, "path", "full_outer").select("path", status.alias("status"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """path, name, value of KEY=VALUE files; comments and blank lines are skipped, quotes and `export` dropped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    m = r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"
    return lines.select("path", F.regexp_extract("line", m, 1).alias("name"), F.regexp_replace(F.regexp_extract("line", m, 2), "^[\"']|[\"']$", "").alias("value")).where("name <> ''")


def sections(text: Column, *names: str) -> list[Column]:
    """The title of a Markdown text and the body of each named section."""
    title = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)).alias("title")
    return [title, *[F.trim(F.regexp_extract(text, rf"(?ims)^##\s+{n}\s*$(.*?)(?=^##\s|\z)", 1)).alias(n.lower()) for n in names]]


def decision_records(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, title, status, context, decision of Markdown decision records that have a title."""
    return documents.select(key, *sections(F.col(text), "Status", "Context", "Decision")).where("title <> ''")


def openapi_endpoints(specs: DataFrame, key: str, text: str) -> DataFrame:
    """key, method, path of the operations of OpenAPI documents in JSON; broken ones give none."""
    paths = F.from_json(F.get_json_object(text, "$.paths"), "map<string,map<string,string>>")
    verbs = ("get", "put", "post", "delete", "patch", "head", "options", "trace")
    rows = specs.select(key, F.explode(paths).alias("path", "_ops")).select(key, "path", F.explode(F.map_keys("_ops")).alias("method"))
    return rows.where(F.lower("method").isin(*verbs)).select(key, F.upper("method").alias("method"), "path")


def asyncapi_operations(specs: DataFrame, key: str, text: str) -> DataFrame:
    """key, channel, operation (publish or subscribe), message of the channels of AsyncAPI documents in JSON; broken ones give none."""
    operation = "struct<message:struct<name:string>>"
    channels = F.from_json(F.get_json_object(text, "$.channels"), f"map<string,struct<publish:{operation},subscribe:{operation}>>")
    rows = specs.select(key, F.explode(channels).alias("channel", "_c"))
    each = F.array_compact(F.array(*[F.when(F.col(f"_c.{o}").isNotNull(), F.struct(F.lit(o).alias("operation"), F.col(f"_c.{o}.message.name").alias("message"))) for o in ("publish", "subscribe")]))
    return rows.select(key, "channel", F.explode(each).alias("_o")).select(key, "channel", "_o.*")


def blocks(specs: DataFrame, key: str, text: str, keyword: str) -> DataFrame:
    """key, name, body of each `keyword name { body }` of a schema text (GraphQL type, Protobuf message or service)."""
    found = specs.select(key, F.explode(F.regexp_extract_all(text, F.lit(rf"(?m)^\s*({keyword}\s+\w+[^{{}}]*\{{[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}})"), F.lit(1))).alias("_b"))
    return found.select(key, F.regexp_extract("_b", rf"{keyword}\s+(\w+)", 1).alias("name"), F.regexp_extract("_b", r"(?s)\{(.*)\}", 1).alias("body"))


def graphql_fields(specs: DataFrame, key: str, text: str) -> DataFrame:
    rows = blocks(specs, key, text, "type").select(key, "name", F.explode(F.regexp_extract_all("body", F.lit(r"(\w+(?:\([^)]*\))?\s*:\s*[\w!\[\]]+)"), F.lit(1))).alias("_f"))
    return rows.select(key, F.col("name").alias("type"), F.regexp_extract("_f", r"^(\w+)", 1).alias("field"), F.regexp_extract("_f", r":\s*([\w!\[\]]+)$", 1).alias("kind"))


def protobuf_fields(specs: DataFrame, key: str, text: str) -> DataFrame:
    rows = blocks(specs, key, text, "message").select(key, "name", F.explode(F.regexp_extract_all("body", F.lit(r"((?:repeated |optional )?[\w.]+\s+\w+\s*=\s*\d+)"), F.lit(1))).alias("_f"))
    m = r"^((?:repeated |optional )?[\w.]+)\s+(\w+)\s*=\s*(\d+)"
    return rows.select(key, F.col("name").alias("message"), F.regexp_extract("_f", m, 2).alias("field"), F.regexp_extract("_f", m, 1).alias("kind"), F.regexp_extract("_f", m, 3).cast("int").alias("number"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """hash, author, at, files, added, removed from the text of `git log --numstat --format=commit%x09%H%x09%an%x09%at`, one commit a record."""
    raw = spark.read.option("lineSep", "commit\t").text(path).where("trim(value) <> ''")
    head, rest = F.split(F.substring_index("value", "\n", 1), "\t"), F.regexp_extract_all("value", F.lit(r"(?m)^(\d+)\t\d+\t"), F.lit(1))
    gone = F.regexp_extract_all("value", F.lit(r"(?m)^\d+\t(\d+)\t"), F.lit(1))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))
    return raw.select(head[0].alias("hash"), head[1].alias("author"), head[2].cast("bigint").alias("at"), F.size(rest).alias("files"), total(rest).alias("added"), total(gone).alias("removed"))


def rules_from_toml(spark: SparkSession, text: str) -> DataFrame:
    """id, pattern, category, confidence of [[rules]] tables: configuration, read by the driver."""
    import tomllib

    rules = [(str(r.get("id")), str(r.get("pattern", "")), str(r.get("category", "")), float(r.get("confidence", 0.5))) for r in tomllib.loads(text).get("rules", [])]
    return spark.createDataFrame(rules, "id string, pattern string, category string, confidence double")


def rows_after(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """key, row (JSON) of the `size` rows after a cursor."""
    return df.where(F.col(key) > after).orderBy(key).limit(size).select(key, F.to_json(F.struct(*df.columns)).alias("row"))


def env_references(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, name of each environment variable a text reads, in the accessors of several languages."""
    accessor = r"(?:process\.env\.|process\.env\[[\"']|os\.environ\[[\"']|os\.environ\.get\([\"']|os\.getenv\([\"']|ENV\[[\"']|ENV\.fetch\([\"']|System\.getenv\(\"|env::var\(\"|os\.Getenv\(\"|getenv\([\"'])([A-Za-z_][A-Za-z0-9_]*)"
    return rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(accessor), F.lit(1)))).alias("name"))
