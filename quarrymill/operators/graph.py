"""Graph operators on edges (src, dst, ...): frontier loops of joins, each step written to the shared folder."""

from __future__ import annotations

import heapq
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import ways
from quarrymill.plans.session import cut, cut_counting, discard


def reached(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """node, depth of everything reached from any of starts(node), these at depth 0; `most` bounds the depth."""
    steps = edges.select("src", "dst").distinct()
    seen = front = cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    parts, depth = [seen], 0
    while most is None or depth < most:
        depth += 1
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        new = steps.join(front, steps["src"] == front["node"]).select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti")
        front = cut(new.withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            discard(front)
            break
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reachable_pairs(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """start, node, depth of what each start reaches in 1..most steps, itself left out."""
    steps = edges.select("src", "dst").distinct()
    front = starts.select(F.col("node").alias("start"), "node").distinct()
    found: DataFrame | None = None
    for depth in range(1, most + 1):
        new = front.join(steps, front["node"] == steps["src"]).select("start", F.col("dst").alias("node")).where("start <> node").distinct()
        if found is not None:
            new = new.join(found.select("start", "node"), ["start", "node"], "left_anti")
        front = cut(new)
        if not front.limit(1).count():
            break
        layer = front.withColumn("depth", F.lit(depth))
        found = layer if found is None else found.unionByName(layer)
    return found if found is not None else front.withColumn("depth", F.lit(0))


def _edges(rows: DataFrame) -> DataFrame:
    """The edges of ways.gathered()."""
    return rows.where(F.col("kind") == ways.EDGE).select("src", "dst")


def _led_to(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """node of starts and of all they lead to: one table a round, however long the ways are."""
    seen = cut(starts.select("node", F.lit(True).alias("_new")))
    while seen.where("_new").limit(1).count():
        front = seen.where("_new").select(F.col("node").alias("src"))
        met = steps.join(front, "src").select(F.col("dst").alias("node"), F.lit(True).alias("_new"))
        more = cut(seen.select("node", F.lit(False).alias("_new")).unionByName(met).groupBy("node").agg(F.min("_new").alias("_new")))
        discard(seen)
        seen = more
    return seen.select("node")


class Reach(NamedTuple):
    """What of starts leads to what: every node of `into` to every node of `out`, itself left out, and besides the pairs `rest`(start, node)."""

    into: DataFrame
    out: DataFrame
    rest: DataFrame


def reach(edges: DataFrame, starts: DataFrame) -> Reach:
    """What starts(node) lead to by ways of any length, without writing down the pairs that meet in the largest knot. For graphs beyond ways.LOCAL_EDGES.

    The node with the most ways through it stands for its strong component: all that leads to it leads to all it leads to.
    Other pairs have ways outside of that component; these are doubled in length until no pair is new. A graph without a large
    component, but with long ways, has as many `rest` pairs as it has pairs.
    """
    steps = cut(edges.where("src <> dst").select("src", "dst").distinct())
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pivot = degrees(steps).orderBy(F.desc(F.col("out_degree") * F.col("in_degree")), "node").limit(1).select("node")
    out, before = _led_to(steps, pivot), _led_to(back, pivot)
    begin = cut(starts.select("node").distinct())
    into = cut(begin.join(before, "node", "left_semi"))
    knot = out.join(before, "node", "left_semi")
    ways = steps.join(knot.withColumnRenamed("node", "src"), "src", "left_anti").join(knot.withColumnRenamed("node", "dst"), "dst", "left_anti")
    known = ways.join(before.select(F.col("node").alias("src"), F.lit(True).alias("_a")), "src", "left").join(out.select(F.col("node").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    rest = cut(known.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.coalesce("_a", F.lit(False)).alias("_a"), F.coalesce("_d", F.lit(False)).alias("_d")).where("NOT (_a AND _d)"))
    many = rest.count()
    while many:
        left, right = rest.select("start", F.col("node").alias("_via"), "_a"), rest.select(F.col("start").alias("_via"), "node", "_d")
        longer = left.join(right, "_via").where("start <> node AND NOT (_a AND _d)").select("start", "node", "_a", "_d")
        more = cut(rest.unionByName(longer).distinct())
        discard(rest)
        rest, last, many = more, many, more.count()
        if many == last:
            break
    rest = rest.join(begin.withColumnRenamed("node", "start"), "start", "left_semi")
    return Reach(into, out, rest.select("start", "node"))


def reach_counts(edges: DataFrame, starts: DataFrame | None = None, name: str = "n") -> DataFrame:
    """node, n: how many of starts(node) lead to each node by ways of any length, itself left out; nodes that none leads to are left out. Without starts, all nodes count.

    One task counts up to ways.LOCAL_EDGES edges and starts; beyond, pairs are written (reach). Without starts that task reads the edges
    where they lie, repeated ones too: nothing is moved or written, but if there are more of them than one task holds."""
    kind = edges.schema["src"].dataType.simpleString()
    if starts is None:
        steps = edges.select(F.lit(ways.EDGE).alias("kind"), "src", "dst").where("src <> dst")
        many = steps.count()
        if many > ways.LOCAL_EDGES:
            rows, many = ways.gathered(edges)
            steps, starts = rows, _edges(rows).select(F.col("src").alias("node"))
        if many <= ways.LOCAL_EDGES:
            return steps.coalesce(1).mapInArrow(ways.callers, f"node {kind}, n bigint").withColumnRenamed("n", name)
    else:
        rows, many = ways.gathered(edges, starts)
        if many <= ways.LOCAL_EDGES:
            return ways.in_one_task(ways.counts, f"node {kind}, n bigint", rows).withColumnRenamed("n", name)
    into, out, rest = reach(_edges(rows), starts)
    through = out.join(into.withColumn("_self", F.lit(1)), "node", "left").select("node", (F.lit(into.count()) - F.coalesce("_self", F.lit(0))).cast("bigint").alias("n"))
    both = through.unionByName(rest.select("node", F.lit(1).cast("bigint").alias("n")))
    return both.groupBy("node").agg(F.sum("n").alias(name)).where(F.col(name) > 0)


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree over different edges."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def coupling(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """module, ce, ca, instability, abstractness, distance, zone: from edges between modules and modules(module, abstract, total)."""
    d = degrees(edges.where("src <> dst")).select(F.col("node").alias("module"), F.col("out_degree").alias("ce"), F.col("in_degree").alias("ca"))
    m = modules.join(d, "module", "left").fillna({"ce": 0, "ca": 0})
    both = F.col("ce") + F.col("ca")
    m = m.withColumns({"instability": F.when(both > 0, F.col("ce") / both).otherwise(0.0), "abstractness": F.when(F.col("total") > 0, F.col("abstract") / F.col("total")).otherwise(0.0)})
    far = F.abs(F.col("abstractness") + F.col("instability") - 1)
    zone = F.when(far <= 0.3, "balanced").when((F.col("abstractness") < 0.5) & (F.col("instability") < 0.5), "pain").when((F.col("abstractness") > 0.5) & (F.col("instability") > 0.5), "uselessness").otherwise("off")
    return m.withColumns({"distance": far}).withColumn("zone", zone).drop("abstract", "total")


def _spread_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(node, label) after each node took the least label of what leads to it, until none changes."""
    labels = cut(labels)
    while True:
        offers = edges.join(labels, edges["src"] == labels["node"]).select(F.col("dst").alias("node"), "label")
        better = cut(labels.withColumn("_own", F.col("label")).unionByName(offers.withColumn("_own", F.lit(None).cast("string"))).groupBy("node").agg(F.min("label").alias("label"), F.max("_own").alias("_own")))
        changed = better.where("label <> _own").limit(1).count()
        discard(labels)
        labels = better.drop("_own")
        labels._quarrymill_path = better._quarrymill_path
        if not changed:
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every strongly connected component of two nodes or more, by colouring.

    One task finishes up to ways.LOCAL_EDGES edges. Beyond, nodes without an edge in or out are trimmed, round by round while a tenth of the
    edges goes; each node is coloured by the least node that leads to it; a colour's own node and what of the colour leads back to it
    is a component; the rest goes on.
    """
    rows, many = ways.gathered(edges)
    left, trim = _edges(rows), True
    left._quarrymill_path = rows._quarrymill_path
    found: list[DataFrame] = []
    while many:
        if many <= ways.LOCAL_EDGES:
            kind = edges.schema["src"].dataType.simpleString()
            found.append(ways.in_one_task(ways.components, f"node {kind}, component {kind}", left.withColumn("kind", F.lit(ways.EDGE))))
            break
        if trim:
            ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            kept, n = cut_counting(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"), rows=F.lit(True))
            discard(left)
            left, trim, many = kept, n["rows"] < 0.9 * many, n["rows"]
            continue
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = _spread_labels(left, nodes.withColumn("label", F.col("node")))
        s, d = colour.select(F.col("node").alias("src"), F.col("label").alias("_ls")), colour.select(F.col("node").alias("dst"), F.col("label").alias("_ld"))
        inside = cut(left.join(s, "src").join(d, "dst").where("_ls = _ld").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("_ls").alias("c")))
        back = reached(inside.select("src", "dst"), colour.where("node = label").select("node")).select("node")
        part = cut(back.join(colour, "node").select("node", F.col("label").alias("component")))
        found.append(part)
        gone = part.select("node")
        rest, n = cut_counting(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), rows=F.lit(True))
        discard(left)
        left, trim, many = rest, True, n["rows"]
    if not found:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    out = found[0]
    for p in found[1:]:
        out = out.unionByName(p)
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("component")
    return out.join(sizes, "component", "left_semi").select("node", "component")


def cheapest(edges: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """node, cost of the cheapest way from start to each node over edges (src, dst, cost >= 0): relaxation by rounds, until none changes a cost; `most` bounds the edges.

    Only nodes that the last round made cheaper are followed further.
    """
    steps = edges.groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    if most is None:
        steps = cut(steps)
        if steps.where("cost < 0").limit(1).count():
            raise ValueError("cheapest: a cost is below 0")
    best = edges.sparkSession.createDataFrame([(start, 0.0, True)], "node string, best double, _new boolean")
    done = 0
    while most is None or done < most:
        front = best.where("_new")
        further = front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node"), (F.col("best") + F.col("cost")).alias("best"), F.lit(None).cast("double").alias("_own"))
        least = best.select("node", "best", F.col("best").alias("_own")).unionByName(further).groupBy("node").agg(F.min("best").alias("best"), F.min("_own").alias("_own"))
        last, best = best, cut(least.select("node", "best", (F.col("_own").isNull() | (F.col("best") < F.col("_own"))).alias("_new")))
        discard(last)
        done += 1
        if most is None and not best.where("_new").limit(1).count():
            discard(steps)
            break
    return best.select("node", F.col("best").alias("cost"))


def paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, blocked: DataFrame, most: int) -> DataFrame:
    """source, sink, path of every simple way of 1..most edges from a source to a sink that enters no blocked node and ends at its first sink."""
    steps = edges.select("src", "dst").distinct().join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")
    ends = sinks.select(F.col("node").alias("sink")).distinct()
    open_ = sources.select(F.col("node").alias("source"), F.col("node").alias("at"), F.array("node").alias("path")).distinct()
    out: DataFrame | None = None
    for _ in range(most):
        moved = open_.join(steps, open_["at"] == steps["src"]).where(~F.array_contains("path", F.col("dst"))).select("source", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        moved = cut(moved.join(ends.withColumn("_end", F.lit(True)), moved["at"] == F.col("sink"), "left").select("source", "at", "path", F.coalesce("_end", F.lit(False)).alias("_end")))
        done = moved.where("_end").select("source", F.col("at").alias("sink"), "path")
        out = done if out is None else out.unionByName(done)
        open_ = moved.where("NOT _end").select("source", "at", "path")
    return out


def strongest(edges: DataFrame, starts: DataFrame, least: float, most: int) -> DataFrame:
    """start, node, depth, strength: breadth-first along edges (src, dst, strength >= least); a node is taken at its least depth, with the strongest product of strengths among its ways of that depth."""
    steps = edges.where(F.col("strength") >= least).groupBy("src", "dst").agg(F.max("strength").alias("strength"))
    front = starts.select(F.col("node").alias("start"), "node", F.lit(1.0).alias("strength"))
    seen = front.select("start", "node")
    out: DataFrame | None = None
    for depth in range(1, most + 1):
        moved = front.select("start", F.col("node").alias("src"), F.col("strength").alias("_s")).join(steps, "src").groupBy("start", F.col("dst").alias("node")).agg(F.max(F.col("_s") * F.col("strength")).alias("strength"))
        front = cut(moved.join(seen, ["start", "node"], "left_anti"))
        seen = seen.unionByName(front.select("start", "node"))
        layer = front.withColumn("depth", F.lit(depth))
        out = layer if out is None else out.unionByName(layer)
    return out.select("start", "node", "depth", "strength")


def weak_parts(pairs: DataFrame) -> DataFrame:
    """id, group_id (its smallest id) of the connected parts of pairs(a, b), by alternating stars: larger neighbours go to the least
    neighbour, then each node and its smaller neighbours to the least of them, until no link changes."""
    links = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while True:
        ends = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ends.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        below = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(below, large["hi"] == below["u"]).select(F.explode(F.array(F.col("lo"), F.col("u"))).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        marked = small.withColumn("_new", F.lit(1)).unionByName(links.withColumn("_new", F.lit(-1))).groupBy("hi", "lo").agg(F.sum("_new").alias("_new"))
        both, n = cut_counting(marked, changed=F.col("_new") != 0)
        discard(links)
        links = both.where("_new >= 0").select("hi", "lo")
        links._quarrymill_path = both._quarrymill_path
        if not n["changed"]:
            return links.select(F.col("hi").alias("id"), F.col("lo").alias("group_id")).unionByName(links.select(F.col("lo").alias("id"), F.col("lo").alias("group_id")).distinct())


def cover(pairs: DataFrame, taker: str, item: str) -> list[tuple[str, int]]:
    """A greedy cover: (taker, newly covered) in order, until every item is covered; ties go to the smaller taker. One pass over what is left a step."""
    left = cut(pairs.select(taker, item).distinct())
    chosen: list[tuple[str, int]] = []
    while True:
        best = left.groupBy(taker).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), taker).limit(1).collect()
        if not best:
            return chosen
        chosen.append((best[0][0], best[0][1]))
        rest = cut(left.join(left.where(F.col(taker) == best[0][0]).select(item), item, "left_anti").select(taker, item))
        discard(left)
        left = rest


def cover_apart(pairs: DataFrame, taker: str, item: str) -> list[tuple[str, int]]:
    """As cover(), but each connected part of the pairs is covered in one task; for pairs that fall into many small parts.

    In a part the gains never grow, and takers of equal gain come in order, so the parts' steps sorted are those of the whole.
    """
    p = cut(pairs.select(F.col(taker).alias("taker"), F.col(item).alias("item")).distinct())
    parts = weak_parts(p.select(F.concat(F.lit("t"), "taker").alias("a"), F.concat(F.lit("i"), "item").alias("b")))
    placed = p.join(parts.select(F.col("id").alias("_id"), "group_id"), F.concat(F.lit("t"), "taker") == F.col("_id")).select("group_id", "taker", "item")

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {k: set(v) for k, v in pdf.groupby("taker")["item"]}
        by = {k: list(v) for k, v in pdf.groupby("item")["taker"]}
        heap = [(-len(v), k) for k, v in left.items()]
        heapq.heapify(heap)
        chosen = []
        while heap:
            n, k = heapq.heappop(heap)
            if len(left[k]) != -n:
                if left[k]:
                    heapq.heappush(heap, (-len(left[k]), k))
                continue
            chosen.append((k, -n))
            for x in list(left[k]):
                for other in by[x]:
                    left[other].discard(x)
        return pd.DataFrame(chosen, columns=["taker", "n"])

    found = placed.groupBy("group_id").applyInPandas(steps, "taker string, n bigint").orderBy(F.desc("n"), "taker").collect()
    discard(p)
    return [(r.taker, r.n) for r in found]


def reach_cover(edges: DataFrame, starts: DataFrame) -> list[tuple[str, int]]:
    """cover() of all that starts(node) lead to by ways of any length, themselves left out; by one task for up to ways.LOCAL_EDGES edges and starts."""
    rows, many = ways.gathered(edges, starts)
    if many <= ways.LOCAL_EDGES:
        kind = edges.schema["src"].dataType.simpleString()
        steps = ways.in_one_task(ways.cover, f"place int, node {kind}, n bigint", rows).collect()
        discard(rows)
        return [(r.node, r.n) for r in sorted(steps, key=lambda r: r.place)]
    into, out, rest = reach(_edges(rows), starts)
    rest = cut(rest)
    chosen: list[tuple[str, int]] = []
    while many := out.count():  # what the large component leads to and is not covered
        own = into.join(out.withColumn("_self", F.lit(1)), "node", "left").select(F.col("node").alias("start"), (F.lit(many) - F.coalesce("_self", F.lit(0))).cast("bigint").alias("n"), F.lit(True).alias("_in"))
        gains = own.unionByName(rest.select("start", F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("_in"))).groupBy("start").agg(F.sum("n").alias("n"), F.max("_in").alias("_in"))
        best = gains.where("n > 0").orderBy(F.desc("n"), "start").limit(1).collect()
        if not best:
            return chosen
        name, n, central = best[0]
        chosen.append((name, n))
        taken = rest.where(F.col("start") == name).select("node")
        if central:
            taken = taken.unionByName(out.where(F.col("node") != name))
        taken = cut(taken)
        rest, out = cut(rest.join(taken, "node", "left_anti").select("start", "node")), cut(out.join(taken, "node", "left_anti"))
    return chosen + cover_apart(rest, "start", "node")


def pruned(edges: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The edges of strength `least` at least, and the nodes that lost all of theirs."""
    kept = edges.where(F.col("strength") >= least)
    ends = lambda e: e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return kept, ends(edges).join(ends(kept), "node", "left_anti")


def closes_cycle(edges: DataFrame, new: DataFrame, most: int | None = None) -> DataFrame:
    """src, dst of the new edges whose dst already leads to their src (within `most` steps, if given), or that are loops."""
    asked = new.select(F.col("dst").alias("node"))
    loops = new.where("src = dst").select("src", "dst")
    if most is None:
        rows, many = ways.gathered(edges, asked=new)
        if many <= ways.LOCAL_EDGES:
            kind = edges.schema["src"].dataType.simpleString()
            return ways.in_one_task(ways.closing, f"src {kind}, dst {kind}", rows)
        into, out, rest = reach(_edges(rows), asked)
        through = new.join(into.withColumnRenamed("node", "dst"), "dst", "left_semi").join(out.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")
        loops, back = loops.unionByName(through), rest.select(F.col("start").alias("dst"), F.col("node").alias("src"))
    else:
        back = reachable_pairs(edges, asked, most).select(F.col("start").alias("dst"), F.col("node").alias("src"))
    return new.join(back, ["src", "dst"], "left_semi").select("src", "dst").unionByName(loops).distinct()
