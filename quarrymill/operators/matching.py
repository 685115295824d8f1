"""Matching of calls, contracts and constraints by keyed joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_strategy(calls: DataFrame, key: str, strategies: Sequence[tuple[str, float, DataFrame]]) -> DataFrame:
    """key, target, strategy, confidence: for each call the target by the first strategy that has one.

    Each strategy is a frame (key, target) from an equi-join; several targets of one strategy are resolved to the smallest.
    """
    found = None
    for rank, (name, confidence, rows) in enumerate(strategies):
        r = rows.select(key, F.struct(F.lit(rank).alias("rank"), F.col("target"), F.lit(name).alias("strategy"), F.lit(confidence).alias("confidence")).alias("_m"))
        found = r if found is None else found.unionByName(r)
    best = found.groupBy(key).agg(F.min("_m").alias("_m"))
    return calls.select(key).join(best, key).select(key, "_m.target", "_m.strategy", "_m.confidence")


def normal_path(path: Column) -> Column:
    """A path in lower case, its parameters (:id, {id}, <id>, numbers) made ':x', without a slash at its end."""
    p = F.regexp_replace(F.lower(path), r"/(?::[^/]+|\{[^/]*\}|<[^/]*>|[0-9]+)(?=/|$)", "/:x")
    return F.regexp_replace(p, "(.)/$", "$1")


def path_similarity(a: Column, b: Column) -> Column:
    """Share of equal segments of two paths with as many; 0 otherwise."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.size(F.filter(F.zip_with(x, y, lambda i, j: i == j), lambda e: e))
    return F.when(F.size(x) == F.size(y), same / F.size(x)).otherwise(0.0)


def contract_matches(backend: DataFrame, frontend: DataFrame, least: float = 0.5) -> DataFrame:
    """b, f, score of endpoints (id, method, path) whose paths have as many segments and agree on the first or the last one; score = .75 path + .25 method."""
    def sides(df: DataFrame, name: str) -> DataFrame:
        p = normal_path(F.col("path"))
        s = F.split(p, "/")
        keys = F.array(F.concat(F.lit("a"), F.size(s).cast("string"), s[1]), F.concat(F.lit("z"), F.size(s).cast("string"), F.element_at(s, -1)))
        return df.select(F.col("id").alias(name), F.col("method").alias(f"m{name}"), p.alias(f"p{name}"), F.explode(F.array_distinct(keys)).alias("_k"))

    pairs = sides(backend, "b").join(sides(frontend, "f"), "_k").drop("_k").distinct()
    score = 0.75 * path_similarity(F.col("pb"), F.col("pf")) + F.when(F.col("mb") == F.col("mf"), 0.25).otherwise(0.0)
    return pairs.select("b", "f", score.alias("score")).where(F.col("score") >= least)


def field_mismatches(pairs: DataFrame, backend: DataFrame, frontend: DataFrame) -> DataFrame:
    """b, f, field, problem of matched endpoints (b, f) by their fields(id, field, kind): missing in the back end, not asked for by the front end, or of another kind."""
    x = pairs.select("b", "f").join(backend.select(F.col("id").alias("b"), "field", F.col("kind").alias("kb")), "b")
    y = pairs.select("b", "f").join(frontend.select(F.col("id").alias("f"), "field", F.col("kind").alias("kf")), "f")
    both = x.join(y, ["b", "f", "field"], "full_outer")
    problem = F.when(F.col("kb").isNull(), "missing").when(F.col("kf").isNull(), "unused").when(F.col("kb") != F.col("kf"), "kind")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("b", "f", "field", "problem")


def endpoint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """method, path, change of two versions' endpoints(method, path, fields): removed ones and lost fields break callers, the rest does not."""
    side = lambda df, c: df.groupBy(F.upper("method").alias("method"), normal_path(F.col("path")).alias("path")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias(c))
    both = side(before, "_x").join(side(after, "_y"), ["method", "path"], "full_outer")
    lost, new = F.size(F.array_except("_x", "_y")) > 0, F.size(F.array_except("_y", "_x")) > 0
    change = F.when(F.col("_y").isNull(), "removed").when(F.col("_x").isNull(), "added").when(lost, "fields_lost").when(new, "fields_added")
    return both.withColumn("change", change).where("change IS NOT NULL").select("method", "path", "change", F.col("change").isin("removed", "fields_lost").alias("breaking"))


def suppressed(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """findings with suppressed_inline: a directive on the same line or the one before it, for all rules or a list with its own.

    lines: file, line, text. Directives are found first, so the join is with those few lines.
    """
    d = r"(?:noqa|nolint|lint-ignore|eslint-disable(?:-next-line|-line)?)(?:[: ]+([\w/,\- ]+))?"
    marks = lines.where(F.col("text").rlike(d)).select("file", "line", F.split(F.regexp_extract("text", d, 1), r"[, ]+").alias("_rules"))
    reach = marks.select("file", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"), F.filter("_rules", lambda r: r != "").alias("_rules"))
    hit = findings.select("id", "file", "line", "rule_id").join(reach, ["file", "line"]).where((F.size("_rules") == 0) | F.array_contains("_rules", F.col("rule_id"))).select("id").distinct()
    return findings.join(hit.withColumn("suppressed_inline", F.lit(True)), "id", "left").withColumn("suppressed_inline", F.coalesce("suppressed_inline", F.lit(False)))


def ordered_gates(depends: dict[str, Sequence[str]]) -> list[str]:
    """Gates in an order that respects what they depend on; a cycle raises."""
    from graphlib import TopologicalSorter

    return list(TopologicalSorter({k: sorted(v) for k, v in sorted(depends.items())}).static_order())


def run_gates(depends: dict[str, Sequence[str]], passed: dict[str, bool]) -> list[tuple[str, str]]:
    """(gate, passed | failed | skipped) in order: a gate is skipped if one it depends on did not pass."""
    state: dict[str, str] = {}
    for g in ordered_gates(depends):
        state[g] = "skipped" if any(state.get(d) != "passed" for d in depends.get(g, ())) else ("passed" if passed.get(g) else "failed")
    return list(state.items())
