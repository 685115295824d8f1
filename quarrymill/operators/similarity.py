"""Similar sets, names and copies, without comparing all pairs of a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import overlap
from quarrymill.operators.graph import weak_parts
from quarrymill.plans.session import cut


def copies(df: DataFrame, key: str, content: Column) -> DataFrame:
    """hash, rep (smallest key), copies of each different content."""
    return df.select(F.sha2(content.cast("string"), 256).alias("hash"), F.col(key).alias("_k")).where("hash IS NOT NULL").groupBy("hash").agg(F.min("_k").alias("rep"), F.count(F.lit(1)).alias("copies"))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays taken as sets; of two empty ones it is `empty`."""
    both = F.size(F.array_intersect(a, b))
    any_ = F.size(F.array_union(a, b))
    return F.when(any_ == 0, F.lit(empty)).otherwise(both / any_)


#: Sets of a bucket, about.
BUCKET_SETS = 100_000


def _representatives(sets: DataFrame, key: str, items: str, block: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """rep (smallest key), block columns, _items of each different set that is not empty, and members(key, rep)."""
    clean = sets.select(key, *block, F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("_items")).where(F.size("_items") > 0)
    hashed = clean.withColumn("_h", F.sha2(F.to_json(F.struct("_items", *block)), 256))
    reps = hashed.groupBy("_h").agg(F.min(F.struct(F.col(key).alias("rep"), *block, "_items")).alias("r")).select("_h", "r.*")
    members = hashed.select("_h", key).join(reps.select("_h", "rep"), "_h").select(key, "rep")
    return reps, members


def _similar(reps: DataFrame, threshold: float, block: Sequence[str] = ()) -> DataFrame:
    """a, b, similarity of the sets reps(rep, block columns, _items) that are similar enough.

    Items are numbered by how rare they are. A set goes, as numbers, to the buckets of the items of its prefix (overlap.py); pairs are made and
    verified inside a bucket and are never moved before they are found to be similar.
    """
    known = reps.dropna(subset=list(block)) if block else reps
    reps = cut(known.select("rep", *block, "_items", F.monotonically_increasing_id().alias("_s"), (F.xxhash64(*block) if block else F.lit(0).cast("bigint")).alias("_g")))
    exploded = reps.select("_s", "_g", F.explode("_items").alias("_i"))
    # Written, so that the numbers stay the same: the order of (_f, _i).
    numbers = cut(exploded.groupBy("_i").agg(F.count(F.lit(1)).alias("_f")).orderBy("_f", "_i").select("_i", F.monotonically_increasing_id().alias("_k")))
    sized = cut(exploded.join(numbers, "_i").groupBy("_s", "_g").agg(F.sort_array(F.collect_list("_k")).alias("items")))
    n = F.size("items")
    first = n - F.ceil(n * threshold - 1e-9) + 1
    total = sized.agg(F.sum(first)).first()[0] or 0
    buckets = max(2 * reps.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET_SETS))
    placed = sized.select(F.explode(F.array_distinct(F.transform(F.slice("items", F.lit(1), first.cast("int")), lambda x: F.pmod(x, F.lit(buckets)).cast("int")))).alias("bucket"), F.col("_s").alias("s"), F.col("_g").alias("g"), "items")
    found = placed.repartitionById(buckets, F.col("bucket")).mapInArrow(partial(overlap.similar, threshold=threshold, buckets=buckets), overlap.FOUND)
    end = lambda at, name: reps.select(F.col("_s").alias(at), F.col("rep").alias(name), F.struct(F.lit(0), *block).alias(f"_{name}"))
    named = found.join(end("x", "u"), "x").join(end("y", "v"), "y").where("_u = _v")
    return named.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "similarity").where("a < b")


def similar_sets(sets: DataFrame, key: str, items: str, threshold: float, block: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets with a Jaccard similarity of `threshold` at least, and the members of equal sets.

    sets: key, items (array), block columns (only sets of one block are compared). Returns pairs(a, b, similarity) between the
    representatives (smallest key) of equal sets, and members(key, rep). Exact, by prefix filtering: items are ordered by how
    rare they are, and two sets that are similar enough share some among the first of each; they meet by combinations of up to three of these.
    Empty sets are similar to none.
    """
    reps, members = _representatives(sets, key, items, block)
    return _similar(reps, threshold, block), members


def similar_classes(sets: DataFrame, key: str, items: str, threshold: float) -> DataFrame:
    """key, class, links: the smallest key of all sets linked to a set by pairs of similar ones, and how many different sets are similar to it. Empty sets have no row."""
    pairs, members = similar_sets(sets, key, items, threshold)
    pairs = cut(pairs.select("a", "b"))
    classes = weak_parts(pairs).select(F.col("id").alias("rep"), F.col("group_id").alias("class"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(classes, "rep", "left").join(links, "rep", "left").select(key, F.coalesce("class", "rep").alias("class"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def minhash_pairs(sets: DataFrame, key: str, items: str, threshold: float = 0.8, bands: int = 32, rows: int = 4) -> DataFrame:
    """a, b, similarity of different sets (each by its smallest key) that agree in a band of `rows` hashes and whose Jaccard similarity is `threshold` at least.

    Sets of similarity s meet with probability 1 - (1 - s^rows)^bands. Sets that agree in a band by chance are far more than the similar ones, so
    the similar pairs are found first (_similar), and the bands of their sets alone are compared: the same rows.
    """
    reps, _ = _representatives(sets, key, items)
    reps = cut(reps.select("rep", "_items"))
    pairs = cut(_similar(reps, threshold))
    least = lambda seed: F.array_min(F.transform(F.col("_items"), lambda x: F.xxhash64(F.lit(seed), x)))
    banded = reps.join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi").select("rep", F.array(*[F.xxhash64(*[least(b * rows + r) for r in range(rows)]) for b in range(bands)]).alias("_bands"))
    met = pairs.join(banded.select(F.col("rep").alias("a"), F.col("_bands").alias("_x")), "a").join(banded.select(F.col("rep").alias("b"), F.col("_bands").alias("_y")), "b")
    return met.where(F.exists(F.zip_with("_x", "_y", lambda x, y: x == y), lambda z: z)).select("a", "b", "similarity")


def spellings(df: DataFrame, name: str) -> DataFrame:
    """normal, spellings (sorted), n of names that are the same without case, '_' and '-' but written differently."""
    normal = F.lower(F.regexp_replace(F.trim(name), "[_-]", ""))
    g = df.groupBy(normal.alias("normal")).agg(F.array_sort(F.collect_set(name)).alias("spellings"), F.count(F.lit(1)).alias("n"))
    return g.where(F.size("spellings") > 1)


def near_names(df: DataFrame, block: str, name: str, most: int = 2) -> DataFrame:
    """block, a, b, distance of different names of one block within `most` edits of each other.

    Names are cut into most + 1 pieces; names that near share one piece at nearly the same place, so only those are compared.
    """
    names = df.select(block, name).distinct().withColumn("_len", F.length(name))
    width = F.greatest(F.floor(F.col("_len") / (most + 1)), F.lit(1)).cast("int")
    pieces = F.array(*[F.struct(F.lit(k).alias("k"), F.substring(F.col(name), k * width + 1, width).alias("p"), F.col("_len").alias("n")) for k in range(most + 1)])
    pieced = names.select(block, F.col(name).alias("a"), F.explode(pieces).alias("_c")).select(block, "a", "_c.*")
    # Every substring that one of those pieces could be, at a place moved by at most `most`.
    shifts = [d for d in range(-most, most + 1)]
    probes = names.select(block, F.col(name).alias("b"), "_len", F.explode(F.sequence(F.greatest(F.col("_len") - most, F.lit(1)), F.col("_len") + most)).alias("n"))
    w = F.greatest(F.floor(F.col("n") / (most + 1)), F.lit(1)).cast("int")
    places = F.array_distinct(F.flatten(F.array(*[F.array(*[F.struct(F.lit(k).alias("k"), F.when(k * w + 1 + d >= 1, F.substring(F.col("b"), k * w + 1 + d, w)).alias("p")) for d in shifts]) for k in range(most + 1)])))
    probe = probes.select(block, "b", "n", F.explode(places).alias("_c")).select(block, "b", "n", "_c.*").where("p IS NOT NULL")
    found = pieced.join(probe, [block, "k", "p", "n"]).where("a < b").select(block, "a", "b").distinct()
    return found.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= most)
