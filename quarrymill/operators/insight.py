"""Operators over histories of memories, evidence, agents and alerts; upkeep of stores; ranked and reported results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evidence_items(rows: DataFrame, key: str, evidence: str) -> DataFrame:
    """key, type, value, weight: the items of a JSON array of evidence; a null or broken one has none."""
    parsed = F.from_json(evidence, "array<struct<type:string,value:double,weight:double>>")
    return rows.select(key, F.explode(parsed).alias("e")).select(key, "e.*").where(F.col("value").isNotNull() & F.col("weight").isNotNull())


def freshness(age_days: Column, half: float = 30.0) -> Column:
    """1 now, and half of it after `half` days; a negative age counts as none, a null one gives null."""
    return F.when(age_days.isNotNull(), F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half))


def replica_state(events: DataFrame) -> DataFrame:
    """memory_id, hash, hash_at, hash_nr, confidence, touched: one replica's registers, by the latest write of each; partial aggregation bears hot memories."""
    d = F.try_parse_json("delta")
    get = lambda *paths, kind="string": F.coalesce(*[F.try_variant_get(d, p, kind) for p in paths])
    h = F.when(F.col("kind") == "created", get("$.content_hash")).when(F.col("kind") == "contentupdated", get("$.new_content_hash", "$.content_hash.new"))
    c = get("$.confidence", "$.new_confidence", kind="double")
    rows = events.withColumns({"_h": h, "_c": F.when(F.col("kind").isin("created", "decayed"), c)})
    return rows.groupBy("memory_id").agg(F.max(F.when(F.col("_h").isNotNull(), F.struct("ts", "event_id", "_h"))).alias("h"), F.max("_c").alias("confidence"), F.count(F.lit(1)).alias("touched")).select(
        "memory_id", F.col("h._h").alias("hash"), F.col("h.ts").alias("hash_at"), F.col("h.event_id").alias("hash_nr"), "confidence", "touched"
    )


def merged_replicas(a: DataFrame, b: DataFrame) -> DataFrame:
    """memory_id, winner, hash, confidence, touched of two replicas' states: the later write of the hash (tie: the larger number), the larger confidence, the sum of counters."""
    r = lambda df, s: df.select("memory_id", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c != "memory_id"])
    both = r(a, "a").join(r(b, "b"), "memory_id", "full_outer")
    later = F.col("a_hash_at").isNotNull() & (F.col("b_hash_at").isNull() | (F.struct("a_hash_at", "a_hash_nr") > F.struct(F.col("b_hash_at").alias("a_hash_at"), F.col("b_hash_nr").alias("a_hash_nr"))))
    winner = F.when(later, "a").when(F.col("b_hash_at").isNotNull(), "b")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("memory_id", winner.alias("winner"), F.when(later, F.col("a_hash")).otherwise(F.col("b_hash")).alias("hash"), F.greatest("a_confidence", "b_confidence").alias("confidence"), (zero("a_touched") + zero("b_touched")).alias("touched"))


def followed_by(events: DataFrame, agent: str, entity: str, at: str, nr: str, seconds: int) -> DataFrame:
    """cause, effect, n: how often an agent's change of one entity was followed by its next change, of another entity, within so many seconds."""
    w = Window.partitionBy(agent).orderBy(at, nr)
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    steps = events.where(F.col(agent).isNotNull()).select(F.lag(entity).over(w).alias("cause"), F.col(entity).alias("effect"), gap.alias("_gap"))
    return steps.where((F.col("_gap") <= seconds * 1_000_000) & (F.col("cause") != F.col("effect"))).groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("n"))


def table_health(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """table, rows, without_key, repeated: rows, null keys, and rows beyond the first of each key, of several tables."""
    parts = []
    for name, df in tables.items():
        k = F.col(keys[name])
        each = df.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(each.agg(F.lit(name).alias("table"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("without_key"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("repeated")))
    return reduce(DataFrame.unionByName, parts)


def over_limit(events: DataFrame, key: str, at: str, seconds: int, most: int) -> DataFrame:
    """events with `recent`, of which a key had more than `most` within the last `seconds`, itself included: those a rate limit refuses."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(at)).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w)).where(F.col("recent") > most)


def damped(alerts: DataFrame, key: str, day: str, quiet: int) -> DataFrame:
    """The alerts that come after `quiet` days or more without one of the same key: runs of alerts give one."""
    w = Window.partitionBy(key).orderBy(day)
    return alerts.withColumn("_last", F.lag(day).over(w)).where(F.col("_last").isNull() | (F.col(day) - F.col("_last") >= quiet)).drop("_last")


def weighted(factors: dict[str, tuple[float, Column]]) -> Column:
    """Sum of weight times value, a null value counting as 0.5 (nothing known)."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(c, F.lit(0.5)) for w, c in factors.values()])


def console_lines(findings: DataFrame) -> DataFrame:
    """id, line: one line for a terminal."""
    return findings.select("id", F.format_string("%s:%d %s %s [%s]", "file", "line", F.upper(F.coalesce("severity", F.lit("none"))), "message", "rule_id").alias("text"))


def escaped(c: Column) -> Column:
    """Text for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_rows(findings: DataFrame) -> DataFrame:
    """id, html: one row of a table, to be written between the head and the foot of a page."""
    cell = lambda c: F.concat(F.lit("<td>"), escaped(c.cast("string")), F.lit("</td>"))
    return findings.select("id", F.concat(F.lit("<tr>"), *[cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("severity", "file", "line", "rule_id", "message")], F.lit("</tr>")).alias("html"))


def appended(table: DataFrame, batch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """table and the rows of batch whose key it does not have, each key once: appending a batch again changes nothing."""
    new = batch.select(key, *columns).where(F.col(key).isNotNull()).dropDuplicates([key]).join(table.select(key), key, "left_anti")
    return table.select(key, *columns, F.lit(False).alias("appended")).unionByName(new.withColumn("appended", F.lit(True)))
