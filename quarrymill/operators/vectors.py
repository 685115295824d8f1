"""Vectors as array<float>: similarity, search in query blocks, centroids, truncation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.plans.session import cut

#: Queries of one block: what is broadcast at once.
QUERY_BLOCK = 2048


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine within -1..1; 0 for a zero vector or different lengths."""
    n = norm(a) * norm(b)
    good = (F.size(a) == F.size(b)) & (n > 0)
    return F.when(good, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def truncated(v: Column, dims: int) -> Column:
    """The first `dims` elements, at unit length."""
    head = F.slice(v, 1, dims)
    n = norm(head)
    return F.transform(head, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, pos, value: the mean of each element, one row each, so that no group is gathered."""
    return df.select(group, F.posexplode(vector).alias("pos", "_x")).groupBy(group, "pos").agg(F.avg(F.col("_x").cast("double")).alias("value"))


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, key, cosine of the k most similar other rows for each row of `queries` (key, vector): exact, by blocks of queries.

    Each block of at most QUERY_BLOCK queries is broadcast; every partition keeps k rows a query. Vectors of another length
    and zero vectors have cosine 0.
    """
    ordered = queries.select(key, vector).where(F.col(vector).isNotNull()).orderBy(key)
    schema = f"query bigint, {key} bigint, cosine double"

    def search(names: np.ndarray, block: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [np.asarray(v, float) if v is not None and len(v) == block.shape[1] else np.zeros(block.shape[1]) for v in b[vector]]
                m = np.stack(rows) if rows else np.zeros((0, block.shape[1]))
                n = np.linalg.norm(m, axis=1, keepdims=True)
                sims = np.clip(block @ (m / np.where(n == 0, 1, n)).T, -1, 1)
                ids = b[key].to_numpy()
                sims[names[:, None] == ids[None, :]] = -2
                take = min(k, sims.shape[1])
                if not take:
                    continue
                near = np.round(sims, 9)
                edge = -np.partition(-near, take - 1, axis=1)[:, take - 1]  # ties with the last one are kept for the ranking
                q, r = np.nonzero((near >= edge[:, None]) & (sims > -2))
                yield pd.DataFrame({"query": names[q], key: ids[r], "cosine": sims[q, r]})

        return run

    parts: DataFrame | None = None
    rows = ordered.toLocalIterator()
    while True:
        names, block = [], []
        for r in rows:
            names.append(r[0])
            block.append(np.asarray(r[1], float))
            if len(names) == QUERY_BLOCK:
                break
        if not names:
            break
        width = max(len(v) for v in block)
        m = np.stack([v if len(v) == width else np.zeros(width) for v in block])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        found = df.select(key, vector).mapInPandas(search(np.array(names), m / np.where(n == 0, 1, n)), schema)
        parts = found if parts is None else parts.unionByName(found)
        if len(names) < QUERY_BLOCK:
            break
    if parts is None:
        return df.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), key)
    return parts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def recall_gate(df: DataFrame, key: str, group: str, vector: str, top: int = 10, share: float = 0.3) -> DataFrame:
    """group, members, recalled, passed: whether the `top` rows nearest to a group's centroid hold `share` of min(top, members) of its members.

    Groups are as few as the labels; their centroids are searched as queries.
    """
    c = centroids(df, group, vector).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias(vector))
    found = nearest(df, key, vector, c.select((-F.col(group).cast("bigint") - 1).alias(key), vector), top)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    hits = found.select((-F.col("query") - 1).alias("_g"), key).join(df.select(key, F.col(group).cast("bigint").alias("_of")), key).groupBy("_g").agg(F.count_if(F.col("_g") == F.col("_of")).alias("recalled"))
    j = sizes.join(hits, sizes[group].cast("bigint") == F.col("_g"), "left")
    return j.select(group, "members", F.coalesce("recalled", F.lit(0)).alias("recalled"), (F.coalesce("recalled", F.lit(0)) / F.least(F.lit(top), F.col("members")) >= share).alias("passed"))


#: Vectors on which the centroids of an index are fitted, chosen by a hash of their keys; every vector is indexed.
INDEX_SAMPLE = 20_000
#: Rows of a list that meet its queries in one task.
LIST_BLOCK = 20_000


def _unit(rows, width: int) -> np.ndarray:
    """Rows as unit vectors; null ones and those of another length are 0."""
    m = np.stack([np.asarray(v, float) if v is not None and len(v) == width else np.zeros(width) for v in rows]) if len(rows) else np.zeros((0, width))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def fit_centroids(df: DataFrame, key: str, vector: str, lists: int = 64, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of at most `lists` lists by spherical k-means over INDEX_SAMPLE vectors at most (what the driver sees), and that sample; none for an empty table."""
    rows = [r[0] for r in df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(INDEX_SAMPLE).select(vector).collect()]
    if not rows:
        return np.zeros((0, 0)), np.zeros((0, 0))
    width = max(map(len, rows))
    x = _unit(rows, width)
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size == 0, 1, size), c)
    return c, x


def probes_for(centroids: np.ndarray, sample: np.ndarray, k: int, recall: float) -> int:
    """The least number of lists in which vectors of the sample find `recall` of their k nearest among the sample."""
    asked = sample[: min(256, len(sample))]
    sims = asked @ sample.T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -2
    best = np.argsort(-sims, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # rank of each list for each query
    of = np.argmax(sample @ centroids.T, axis=1)
    needed = np.sort(np.take_along_axis(place, of[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def _listed(df: DataFrame, key: str, vector: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """key, vector, list: each row in the lists of its `probes` nearest centroids."""
    width = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = np.argsort(-(_unit(b["vector"].tolist(), width) @ centroids.T), axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"key": np.repeat(b["key"].to_numpy(), near.shape[1]), "vector": np.repeat(b["vector"].to_numpy(), near.shape[1]), "list": near.ravel().astype("int32")})

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInPandas(run, "key bigint, vector array<double>, list int")


def indexed_nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, lists: int = 64, recall: float = 0.95) -> DataFrame:
    """query, key, cosine as nearest(), by an inverted index: every row lies in the list of its nearest centroid, a query looks into the nearest lists.

    The centroids are fitted on a bounded sample, from which it is measured, too, how many lists give `recall`: few where vectors
    cluster, most of them where they do not. All rows are indexed. A list is searched in blocks of LIST_BLOCK rows, over as many
    tasks, so that no list needs to fit one; neither rows nor queries pass through the driver. Recall against nearest() is measured in the tests.
    """
    centroids, sample = fit_centroids(df, key, vector, lists)
    schema = f"query bigint, {key} bigint, cosine double"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], schema)
    width, probes = centroids.shape[1], probes_for(centroids, sample, k, recall)
    rows = cut(_listed(df, key, vector, centroids, 1))
    blocks = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("_blocks"))  # one row a list
    placed = rows.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")).drop("_blocks")
    asked = _listed(queries, key, vector, centroids, probes).join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        x, ids = _unit(right["vector"].tolist(), width), right["key"].to_numpy()
        for lo in range(0, len(left) if len(right) else 0, 256):
            part = left.iloc[lo : lo + 256]
            sims = np.clip(_unit(part["vector"].tolist(), width) @ x.T, -1, 1)
            sims[part["key"].to_numpy()[:, None] == ids[None, :]] = -2
            take = min(k, sims.shape[1])
            # All that may be among the first k, ties included, then in order.
            edge = -np.partition(-np.round(sims, 9), take - 1, axis=1)[:, take - 1]
            q, r = np.nonzero(np.round(sims, 9) >= edge[:, None])
            found = pd.DataFrame({"query": part["key"].to_numpy()[q], key: ids[r], "cosine": sims[q, r]})
            found = found[found["cosine"] > -2]
            found = found.assign(_c=-found["cosine"].round(9)).sort_values(["query", "_c", key]).groupby("query").head(k).drop(columns="_c")
            out.append(found)
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), key: pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})

    met = asked.groupBy("list", "block").cogroup(placed.groupBy("list", "block")).applyInPandas(search, schema)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), key)
    return met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
