"""Reports of findings, one JSON or XML element a row, so that a report of any size is written in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities in the words of each format.
SARIF = {"error": "error", "warning": "warning", "quality": "note", "info": "note"}
QUALITY = {"error": "critical", "warning": "major", "quality": "minor", "info": "info"}


def _word(words: dict[str, str], other: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[F.col("severity")], F.lit(other))


def fingerprint() -> Column:
    return F.md5(F.concat_ws(":", "file", F.col("line").cast("string"), "rule_id"))


def sarif_results(v: DataFrame) -> DataFrame:
    """id, result: a SARIF 2.1.0 result object of each finding."""
    place = F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    return v.select("id", F.to_json(F.struct(F.col("rule_id").alias("ruleId"), _word(SARIF, "none").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))).alias("result"))


def code_quality(v: DataFrame) -> DataFrame:
    """id, issue: an issue of the code quality format, with a fingerprint."""
    issue = F.struct(F.col("message").alias("description"), F.col("rule_id").alias("check_name"), fingerprint().alias("fingerprint"), _word(QUALITY, "info").alias("severity"), F.struct(F.col("file").alias("path"), F.struct(F.col("line").alias("begin")).alias("lines")).alias("location"))
    return v.select("id", F.to_json(issue).alias("issue"))


def annotations(v: DataFrame) -> DataFrame:
    """id, line: a workflow annotation."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    return v.select("id", F.format_string("::%s file=%s,line=%d::%s", level, "file", F.coalesce("line", F.lit(1)), "message").alias("line"))


def junit_cases(v: DataFrame) -> DataFrame:
    """suite, tests, failures of each rule, and its opening element."""
    g = v.groupBy(F.col("rule_id").alias("suite")).agg(F.count(F.lit(1)).alias("tests"), F.count_if(~F.col("suppressed")).alias("failures"))
    return g.withColumn("element", F.format_string('<testsuite name="%s" tests="%d" failures="%d">', "suite", "tests", "failures"))


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A backup: each table as Parquet in its own subfolder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
