"""Filling containers of fixed capacity with texts, measured in tokens.

Bulk-synchronous best fit over size classes. Texts of one size are interchangeable, and so are containers with one gap, so the
sorted sequences of texts and of gaps are swept as classes of which there are at most as many as the capacity, however large
the corpus. A superstep takes the next smaller size: all its texts go, class by class, to the smallest gap that takes them (the
successor), the conflict for a class's containers is settled by rank, the gaps are updated, and what found no gap opens new
containers. The supersteps of a capacity yield rank intervals; which text has which rank within its size is worked out
distributedly, in salted buckets with running offsets, and each text finds its interval by a join.

A text larger than the capacity is cut into full pieces, each alone in a container, and a rest that is packed as any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.plans.session import cut, cut_counting

#: Rows of one bucket in which a size is ranked: buckets grow with the rows, so that none does.
BUCKET_ROWS = 50_000
#: Most capacities, and most rank intervals that are broadcast; more are joined by a shuffle.
MOST_CAPACITIES = 1000
MOST_BROADCAST = 200_000

_INTERVALS = "capacity bigint, size bigint, rank_from bigint, rank_to bigint, container_from bigint, per_container bigint, start bigint, place bigint"


def best_fit(capacity: int, sizes: Mapping[int, int]) -> tuple[list[tuple[int, ...]], int]:
    """Rank intervals (size, rank_from, rank_to, container_from, per_container, start, place) and the number of containers.

    sizes: how many items there are of each size from 1 to capacity. Items rank_from..rank_to-1 of a size go to the containers from
    container_from on, per_container to each, the first at token `start` and as item number `place` (from 0) of its container.
    """
    groups: dict[int, deque[tuple[int, int, int]]] = defaultdict(deque)  # gap -> (first container, containers, items in each)
    gaps: list[int] = []
    out: list[tuple[int, ...]] = []
    opened = 0

    def put(gap: int, group: tuple[int, int, int], front: bool = False) -> None:
        if gap > 0 and group[1] > 0:
            if not groups[gap]:
                insort(gaps, gap)
            (groups[gap].appendleft if front else groups[gap].append)(group)

    for size in sorted(sizes, reverse=True):
        left, rank = sizes[size], 0

        def fill(first: int, containers: int, items: int, gap: int) -> int:
            """Fill containers of one gap with what is left; the containers that were not touched."""
            nonlocal left, rank
            each = gap // size
            full = min(containers, left // each)
            if full:
                out.append((size, rank, rank + full * each, first, each, capacity - gap, items))
                put(gap - each * size, (first, full, items + each))
                left, rank = left - full * each, rank + full * each
            if left and full < containers:
                out.append((size, rank, rank + left, first + full, left, capacity - gap, items))
                put(gap - left * size, (first + full, 1, items + left))
                rank, left, full = rank + left, 0, full + 1
            return containers - full

        while left:
            k = bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                first, containers, items = groups[gap].popleft()
                if not groups[gap]:
                    gaps.pop(k)
                rest = fill(first, containers, items, gap)
                put(gap, (first + containers - rest, rest, items), front=True)
            else:
                new = -(-left // (capacity // size))
                fill(opened, new, 0, capacity)
                opened += new
    return out, opened


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    intervals, opened = best_fit(capacity, {int(s): int(n) for s, n in zip(pdf["size"], pdf["n"]) if s > 0})
    rows = [(capacity, *i) for i in intervals] + [(capacity, 0, 0, 0, opened, 0, 0, 0)]  # size 0: how many were opened
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _INTERVALS.split(", ")])


def _ranked(rows: DataFrame, keys: list[str], count: int, weight: str | None = None) -> DataFrame:
    """rows with `rank` (from 0) within keys: of rows, or of the running sum of weight. Hot keys are spread over buckets, as many as `count` rows need."""
    buckets = max(8, -(-count // BUCKET_ROWS))
    w = F.col(weight) if weight else F.lit(1)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(w).cast("bigint").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_offset"))  # as many rows a key as there are buckets
    inside = Window.partitionBy(*keys, "_bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    return local.join(offsets, [*keys, "_bucket"]).withColumn("rank", F.col("_offset") + F.col("_local")).drop("_bucket", "_offset", "_local")


def pack(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """capacity_name, doc_id, piece, container_id, place, start_token, tokens: where every text, or piece of one, lies.

    sizes(doc_id, size >= 0; null counts as 0), capacities(capacity_name, capacity_tokens > 0). container_id counts from 0 for each
    capacity, place and start_token from 0 in each container; piece is 0 but for texts larger than the capacity. A text
    without tokens takes no room: it lies at the beginning of one of the containers, in which it has place -1.
    """
    spark = sizes.sparkSession
    caps = [(r[0], int(r[1])) for r in capacities.where("capacity_tokens > 0").select("capacity_name", "capacity_tokens").distinct().limit(MOST_CAPACITIES + 1).collect()]
    if len(caps) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    schema = "capacity_name string, doc_id bigint, piece bigint, container_id bigint, place bigint, start_token bigint, tokens bigint"
    if not caps:
        return spark.createDataFrame([], schema)
    levels = F.array(*[F.lit(c).cast("bigint") for c in sorted({c for _, c in caps})])
    items, many = cut_counting(
        sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("size", F.lit(0)).cast("bigint").alias("whole"), F.explode(levels).alias("capacity"))
        .withColumn("pieces", F.when(F.col("whole") > F.col("capacity"), F.floor(F.col("whole") / F.col("capacity"))).otherwise(0).cast("bigint"))
        .withColumn("size", F.col("whole") - F.col("pieces") * F.col("capacity")),
        rows=F.lit(True),
    )
    counts = items.groupBy("capacity", "size").agg(F.count(F.lit(1)).alias("n"))  # at most capacity + 1 rows each
    swept = cut(counts.groupBy("capacity").applyInPandas(_sweep, _INTERVALS))
    opened = F.broadcast(swept.where("size = 0").select("capacity", F.col("container_from").alias("opened")))  # one row a capacity
    intervals = swept.where("size > 0")
    if intervals.count() <= MOST_BROADCAST:
        intervals = F.broadcast(intervals)

    ranked = _ranked(items.select("doc_id", "capacity", "size", "pieces"), ["capacity", "size"], many["rows"])
    found = ranked.where("size > 0").join(intervals, ["capacity", "size"]).where("rank >= rank_from AND rank < rank_to")
    slot = (F.col("rank") - F.col("rank_from")) % F.col("per_container")
    packed = found.select(
        "capacity",
        "doc_id",
        F.col("pieces").alias("piece"),
        (F.col("container_from") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per_container"))).cast("bigint").alias("container_id"),
        (F.col("place") + slot).alias("place"),
        (F.col("start") + slot * F.col("size")).alias("start_token"),
        F.col("size").alias("tokens"),
    )
    large = _ranked(items.where("pieces > 0").select("doc_id", "capacity", "pieces"), ["capacity"], many["rows"], "pieces").join(opened, "capacity")
    full = large.select("capacity", "doc_id", "opened", "rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece")).select(
        "capacity", "doc_id", "piece", (F.col("opened") + F.col("rank") + F.col("piece")).alias("container_id"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("start_token"), F.col("capacity").alias("tokens")
    )
    nothing = ranked.where("size = 0 AND pieces = 0").join(opened, "capacity").select(
        "capacity", "doc_id", F.lit(0).cast("bigint").alias("piece"), (F.col("rank") % F.greatest(F.col("opened"), F.lit(1))).alias("container_id"), F.lit(-1).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("tokens")
    )
    names = F.create_map(*[x for level in sorted({c for _, c in caps}) for x in (F.lit(level).cast("bigint"), F.array(*[F.lit(n) for n, c in caps if c == level]))])
    both = packed.unionByName(full).unionByName(nothing)
    return both.select(F.explode(names[F.col("capacity")]).alias("capacity_name"), "doc_id", "piece", "container_id", "place", "start_token", "tokens")


def fill_levels(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """capacity_name, containers, tokens, fill: how many containers are used and which share of their room is."""
    by = packed.where("tokens > 0").groupBy("capacity_name", "container_id").agg(F.sum("tokens").alias("t"))
    sums = by.groupBy("capacity_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").cast("bigint").alias("tokens"))
    return sums.join(capacities.select("capacity_name", "capacity_tokens").distinct(), "capacity_name").select(
        "capacity_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill")
    )
