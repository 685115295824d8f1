"""Parent-child links to full hierarchies.

Contraction: nodes are spread over partitions of bounded size and every partition follows its own parent chains as
far as they stay inside (fragments). What leaves a partition is one edge for each fragment, to the node at which it
enters another. Those entry nodes, with their own fragment's exit as parent, form the quotient, in which every step
stands for a whole chain; it is solved in the same way, until it fits one partition. Going back, each node adds its
fragment's depth and path to those of its exit. A loop is either inside a partition, or it becomes one of the quotient.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.plans.session import cut, discard

#: Nodes of one partition, and of the last quotient.
CAPACITY = 50_000
#: Nodes and steps of their ways that are written out at once.
EMITTED = 200_000
#: More nodes than this are spread over all cores in the first round, so that it never is one task's.
ALONE = 1000
#: Parents with the most children are kept from drawing their children into their own partition; at most so many.
HEAVY_PARENTS = 1024

_FRAGMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("hops", T.LongType()),
        T.StructField("least", T.StringType()),
        T.StructField("way", T.ArrayType(T.StringType())),
    ]
)


def _fragments(with_path: bool):
    """Follow the chains of one partition. kind: 'root' (target is the root), 'loop' (target its smallest id), 'exit' (target is outside).

    hops, least and way describe the chain from a node, itself included, up to its target, that one excluded for exits.
    """

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[str, str | None] = {}
        step: dict[str, tuple[int, str, list[str]]] = {}
        # The way of a node is its own step, then its parent's way: links shared by all below it, written out only when emitted.
        done: dict[str, tuple[str, str, int, str, tuple | None]] = {}
        for b in batches:
            for i, kind, target, hops, least, way in zip(b.id, b.kind, b.target, b.hops, b.least, b.way):
                way = list(way) if way is not None else []
                if kind == "exit":
                    parent[i], step[i] = target, (int(hops), least, way)
                else:
                    done[i] = (kind, target, int(hops), least, (way, None))
        for start in parent:
            trail: list[str] = []
            at: dict[str, int] = {}
            node: str | None = start
            while node not in done and node in parent and node not in at:
                at[node] = len(trail)
                trail.append(node)
                node = parent[node]
            if node in at and node not in done:
                loop = trail[at[node] :]
                smallest = min(step[x][1] for x in loop)
                for x in loop:
                    done[x] = ("loop", smallest, -1, smallest, None)
                trail = trail[: at[node]]
                nxt = done[node]
            elif node in done:
                nxt = done[node]
            else:
                nxt = ("exit", node, 0, "", None)
            for x in reversed(trail):
                kind, target, hops, least, links = nxt
                if kind == "loop":
                    nxt = ("loop", target, -1, target, None)
                else:
                    h, l, w = step[x]
                    nxt = (kind, target, hops + h, min(least, l) if least else l, (w, links) if with_path else None)
                done[x] = nxt
        rows: list[tuple] = []
        size = 0
        for i, (kind, target, hops, least, links) in done.items():
            way: list[str] = []
            while links is not None:
                way += links[0]
                links = links[1]
            rows.append((i, kind, target, hops, least, way))
            size += 1 + len(way)
            if size >= EMITTED:
                yield pd.DataFrame(rows, columns=_FRAGMENT.names)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_FRAGMENT.names)

    return follow


def _spread(nodes: DataFrame, parts: int) -> DataFrame:
    """Partition nodes so that chains stay together more often than by chance, without a partition growing with a popular parent.

    Nodes are heads or tails by a hash; a tail joins its parent's partition if that is a head and not among the
    most popular parents. A quarter of all steps is then inside a partition, also in long chains.
    """
    children = nodes.where("kind = 'exit'").groupBy(F.col("target").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    popular = children.where("n > 1000").orderBy(F.desc("n"), "p").limit(HEAVY_PARENTS).select("p", F.lit(True).alias("popular"))
    head = lambda c: F.pmod(F.xxhash64(F.lit("side"), F.col(c)), F.lit(2)) == 0
    home = F.when((F.col("kind") == "exit") & ~head("id") & head("target") & F.col("popular").isNull(), F.col("target")).otherwise(F.col("id"))
    marked = nodes.join(F.broadcast(popular), nodes["target"] == F.col("p"), "left")
    return marked.select(*nodes.columns, home.alias("_home")).repartition(parts, "_home").drop("_home")


def solve_forest(links: DataFrame, with_path: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """id, root_id, depth and, with_path, path (ids from the root down to the node) for links(id, parent).

    Each id comes once; parent is null or an id of links. On a loop, or below one: depth -1, root_id the loop's smallest
    id, path null. Ids are strings and not null.
    """
    isroot = F.col("parent").isNull()
    cur = links.select(
        "id",
        F.when(isroot, "root").otherwise("exit").alias("kind"),
        F.when(isroot, F.col("id")).otherwise(F.col("parent")).alias("target"),
        F.when(isroot, 0).otherwise(1).cast("bigint").alias("hops"),
        F.col("id").alias("least"),
        (F.array("id") if with_path else F.array().cast("array<string>")).alias("way"),
    )
    cur = cut(cur)
    levels: list[DataFrame] = []
    while True:
        n = cur.count()
        parts = -(-n // capacity)
        if not levels and n > min(ALONE, capacity):
            parts = max(parts, cur.sparkSession.sparkContext.defaultParallelism)
        spread = cur.repartition(1) if parts <= 1 else _spread(cur, parts)
        done = cut(spread.mapInPandas(_fragments(with_path), _FRAGMENT))
        discard(cur)
        levels.append(done)
        if parts <= 1:
            break
        entries = done.where("kind = 'exit'").select(F.col("target").alias("id")).distinct()
        cur = cut(done.join(entries, "id", "left_semi"))

    def finished(df: DataFrame) -> DataFrame:
        return df.where("kind <> 'exit'").select("id", F.col("target").alias("root_id"), F.col("hops").alias("depth"), F.when(F.col("kind") == "root", F.col("way")).alias("way"))

    solved = finished(levels.pop())
    while levels:
        level = levels.pop()
        up = solved.select(F.col("id").alias("target"), "root_id", F.col("depth").alias("_depth"), F.col("way").alias("_way"))
        below = (
            level.where("kind = 'exit'")
            .select("id", "target", "hops", F.col("way").alias("_own"))
            .join(up, "target")
            .select("id", "root_id", F.when(F.col("_depth") < 0, F.lit(-1).cast("bigint")).otherwise(F.col("_depth") + F.col("hops")).alias("depth"), F.when(F.col("_depth") >= 0, F.concat("_own", "_way")).alias("way"))
        )
        last, solved = solved, cut(finished(level).unionByName(below))
        discard(last, level)
    out = solved.select("id", "root_id", "depth", *([F.when(F.col("depth") >= 0, F.reverse("way")).alias("path")] if with_path else []))
    return out


def pattern_links(patterns: DataFrame) -> DataFrame:
    """id, parent of each pattern_id of aggregated_patterns, by its version with the greatest updated_at.

    The parent is parent_id if a pattern has that id, else the smallest pattern_id whose holding version lists the pattern
    in child_ids, else null. Rows without a pattern_id are ignored; versions with equal updated_at are told apart by
    their parent_id and child_ids, so that the result is fixed.
    """
    rows = patterns.where(F.col("pattern_id").isNotNull()).select(
        F.col("pattern_id").alias("id"), F.struct(F.col("updated_at"), F.col("parent_id"), F.col("child_ids")).alias("v")
    )
    held = cut(rows.groupBy("id").agg(F.max("v").alias("v")).select("id", F.col("v.parent_id").alias("said"), F.col("v.child_ids").alias("children")))
    ids = held.select(F.col("id").alias("said"), F.lit(True).alias("exists"))
    claims = held.select(F.explode("children").alias("id"), F.col("id").alias("by")).where(F.col("id").isNotNull()).groupBy("id").agg(F.min("by").alias("by"))
    return held.join(ids, "said", "left").join(claims, "id", "left").select("id", F.when(F.col("exists"), F.col("said")).otherwise(F.col("by")).alias("parent"))


def descendants(solved: DataFrame) -> DataFrame:
    """ancestor, id, steps for each node and each of its ancestors (paths from solve_forest with_path); loops have none."""
    pairs = solved.where("depth > 0").select("id", "depth", F.posexplode("path").alias("at", "ancestor"))
    return pairs.where(F.col("at") < F.col("depth")).select("ancestor", "id", (F.col("depth") - F.col("at")).alias("steps"))
