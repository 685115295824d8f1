"""Consolidating pairwise matches into groups.

Deterministic Boruvka hooking: in each round every component takes its smallest outgoing edge (edges ordered by their two
ends), which hooks it to another component; the trees so formed collapse by pointer doubling; edges are relabelled
with the roots and deduplicated. A round at least halves the components that still have edges, until none has.

Every round keeps only (component, root) of the components that were still alive in it. The rounds' tables, each at most half
of the one before, are composed backwards in the end, so that finished components are never written again. The first round is
always distributed; once the edges left are few (a count), the remaining rounds are run by one task over arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.plans.session import cut, cut_counting, discard

#: Edges that one task finishes: two ids each, some tens of MB.
LOCAL_EDGES = 200_000
#: Pointer steps of one written table.
STEPS = 5


def _named(hooks: DataFrame, id_: str, to: str) -> DataFrame:
    return hooks.select(F.col("id").alias(id_), F.col("parent").alias(to))


def _collapse(hooks: DataFrame) -> DataFrame:
    """id, parent (the root) of hooks(id, parent), in which the only cycles are pairs that hook to each other.

    Pointer doubling: each table holds the pointers of the one before followed STEPS + 1 times, so the depth shrinks by that factor.
    """
    # Of two that chose the same edge the smaller is the root.
    root = (F.col("above") == F.col("id")) & (F.col("id") < F.col("parent"))
    tree = cut(hooks.join(_named(hooks, "parent", "above"), "parent").select("id", F.when(root, F.col("id")).otherwise(F.col("parent")).alias("parent")))
    while True:
        ahead = tree
        for _ in range(STEPS):
            ahead = ahead.join(_named(tree, "parent", "above"), "parent").select("id", F.col("parent").alias("was"), F.col("above").alias("parent"))
        # Where the last step moved no pointer, all have arrived.
        doubled, n = cut_counting(ahead, moved=F.col("was") != F.col("parent"))
        discard(tree)
        tree = doubled.select("id", "parent")
        tree._quarrymill_path = doubled._quarrymill_path
        if not n["moved"]:
            return tree


def _rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, parent (the smallest id of its component) of the edges of one task, by the same rounds over arrays."""
    import numpy as np

    parts = [b for b in batches if len(b)]
    if not parts:
        return
    names, codes = np.unique(np.concatenate([x for b in parts for x in (b.u.to_numpy(object), b.v.to_numpy(object))]), return_inverse=True)
    cut_at = np.cumsum([0] + [len(b) for b in parts for _ in (0, 1)])
    u = np.concatenate([codes[cut_at[2 * k] : cut_at[2 * k + 1]] for k in range(len(parts))])
    v = np.concatenate([codes[cut_at[2 * k + 1] : cut_at[2 * k + 2]] for k in range(len(parts))])
    label = np.arange(len(names))
    while len(u):
        hook = np.full(len(names), len(names))
        np.minimum.at(hook, u, v)
        np.minimum.at(hook, v, u)
        hook = np.where(hook == len(names), np.arange(len(names)), hook)
        own = np.arange(len(names))
        hook = np.where((hook[hook] == own) & (own < hook), own, hook)
        while True:
            up = hook[hook]
            if (up == hook).all():
                break
            hook = up
        label = hook[label]
        u, v = hook[u], hook[v]
        keep = u != v
        both = np.unique(np.stack([np.minimum(u, v)[keep], np.maximum(u, v)[keep]]), axis=1)
        u, v = both[0], both[1]
    least = np.full(len(names), len(names))
    np.minimum.at(least, label, np.arange(len(names)))
    found = names[least[label]]
    for lo in range(0, len(names), 50_000):
        yield pd.DataFrame({"id": names[lo : lo + 50_000], "parent": found[lo : lo + 50_000]})


def connected_groups(pairs: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """id, group_id (the smallest id of the group) for each id linked to another one; ids are strings.

    Rows with a null end and self pairs link nothing; repeats and mirrored repeats count once. No rows give no groups.
    """
    links = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    some: Column = F.lit(True)
    edges, n = cut_counting(links.select(F.least(a, b).cast("string").alias("u"), F.greatest(a, b).cast("string").alias("v")).distinct(), left=some)
    rounds: list[DataFrame] = []
    while n["left"] and (n["left"] > local_edges or not rounds):
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Edges are ordered by (smaller end, larger end): the smallest edge of a component leads to its smallest neighbour.
        hooks = ends.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("parent"))
        roots = _collapse(hooks)
        rounds.append(roots)
        moved = edges.join(_named(roots, "u", "ru"), "u").join(_named(roots, "v", "rv"), "v").where("ru <> rv")
        fewer, n = cut_counting(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), left=some)
        discard(edges)
        edges = fewer
    if n["left"]:
        rounds.append(cut(edges.coalesce(1).mapInPandas(_rest, "id string, parent string")))
    if not rounds:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    # Backwards: what a round hooked to a root belongs where that root went later.
    final = rounds.pop()
    while rounds:
        later = final.select(F.col("id").alias("parent"), F.col("parent").alias("_to"))
        final = rounds.pop().join(later, "parent", "left").select("id", F.coalesce("_to", "parent").alias("parent"))
    # Roots are components' ids, not always their smallest: the smallest member names the group.
    names = final.groupBy("parent").agg(F.min("id").alias("group_id"))
    return final.join(names, "parent").select("id", "group_id")


def similar_pairs(candidates: DataFrame, least: float = 0.95) -> DataFrame:
    """a, b of the merge candidates whose similarity, as a share of 1, is at least `least`.

    A similarity above 1 is a percentage; null, NaN or negative is unknown and links nothing.
    """
    s = F.col("similarity")
    enough = F.when(s > 1, s >= least * 100).otherwise(s >= least) & ~F.isnan(s)
    return candidates.where(enough).select(F.col("pattern_a").alias("a"), F.col("pattern_b").alias("b"))
