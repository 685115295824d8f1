"""Current state of records from a feed of changes.

A change is a patch: a function from state to state. Patches compose, and the composition of any stretch of the feed is
again a patch of fixed size, so the feed is reduced as a tree: first every range chunk (a record's changes of one day),
then the chunks of a record, then the record's base. As each register of a patch carries the order key of the change that
wrote it, chunks may be composed in any grouping, and a hot record costs each task one patch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.keys import event_kind, micros

#: Event kinds that change the state, in one word and lower case.
CREATED, UPDATED, ARCHIVED, RESTORED = "created", "contentupdated", "archived", "restored"
REPLACED = ("superseded", "consolidated")
DAY = 86_400_000_000


def memory_changes(events: DataFrame) -> DataFrame:
    """nr, memory_id, at, kind, content_hash, gives_hash of the changes that have an effect, each event_id once at its earliest time.

    A null or broken delta (anything but a JSON object) has none, nor has a row without event_id, memory_id, time or a
    known event_type. The hash of an update is new_content_hash (schema_version 1) or content_hash.new (2); with another
    or no schema_version, whichever is there.
    """
    delta = F.try_parse_json("delta")
    get = lambda path: F.try_variant_get(delta, path, "string")
    old, new = get("$.new_content_hash"), get("$.content_hash.new")
    update = F.when(F.col("schema_version") == 1, old).when(F.col("schema_version") == 2, new).otherwise(F.coalesce(old, new))
    kind = event_kind(F.col("event_type"))
    rows = (
        events.select(
            F.col("event_id").alias("nr"),
            "memory_id",
            micros(F.col("recorded_at")).alias("at"),
            kind.alias("kind"),
            F.when(kind == CREATED, get("$.content_hash")).when(kind == UPDATED, update).alias("content_hash"),
            (F.substring(F.ltrim("delta"), 1, 1) == "{").alias("_object"),
            delta.isNotNull().alias("_valid"),
        )
        .where(F.col("kind").isin(CREATED, UPDATED, ARCHIVED, RESTORED, *REPLACED))
        .where("_object AND _valid AND nr IS NOT NULL AND memory_id IS NOT NULL AND at IS NOT NULL")
        .where((F.col("kind") != UPDATED) | F.col("content_hash").isNotNull())
    )
    return rows.groupBy("nr").agg(F.min(F.struct("at", "memory_id", "kind", "content_hash")).alias("c")).select("nr", "c.*")


def as_patches(changes: DataFrame) -> DataFrame:
    """memory_id, chunk and the registers of each change: born, hash, archived, replaced, each with its order key or null."""
    k = F.col("kind")

    def register(applies: Column, value: Column) -> Column:
        return F.when(applies, F.struct("at", "nr", value.alias("value")))

    return changes.select(
        "memory_id",
        F.floor(F.col("at") / DAY).alias("chunk"),
        register(k == CREATED, F.lit(True)).alias("born"),
        register(k.isin(CREATED, UPDATED), F.col("content_hash")).alias("hash"),
        register(k.isin(CREATED, ARCHIVED, RESTORED), k == ARCHIVED).alias("archived"),
        register(k.isin(CREATED, *REPLACED), k.isin(*REPLACED)).alias("replaced"),
    )


def compose(patches: DataFrame, *keys: str) -> DataFrame:
    """One patch for each combination of keys: every register keeps its latest write. A creation writes them all."""
    return patches.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("born", "hash", "archived", "replaced")])


def apply_changes(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """memory_id, content_hash, archived, superseded of each memory that exists after all changes.

    base(memory_id, content_hash, archived, superseded), if given, is the state before the first change. What precedes
    a memory's first creation has no effect, for the creation overwrites every register.
    """
    patches = as_patches(memory_changes(events))
    if base is not None:
        nr = F.lit(-(2**63)).cast("bigint")
        first = lambda v: F.struct(nr.alias("at"), nr.alias("nr"), v.alias("value"))
        patches = patches.unionByName(
            base.where(F.col("memory_id").isNotNull()).select(
                "memory_id",
                F.lit(None).cast("bigint").alias("chunk"),
                first(F.lit(True)).alias("born"),
                first(F.col("content_hash")).alias("hash"),
                first(F.coalesce("archived", F.lit(False))).alias("archived"),
                first(F.coalesce("superseded", F.lit(False))).alias("replaced"),
            )
        )
    by_chunk = compose(patches, "memory_id", "chunk")
    whole = compose(by_chunk, "memory_id")
    return whole.where(F.col("born").isNotNull()).select(
        "memory_id", F.col("hash.value").alias("content_hash"), F.col("archived.value").alias("archived"), F.col("replaced.value").alias("superseded")
    )


def live_memories(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """memory_id, content_hash of each memory that exists, is not archived and not superseded."""
    return apply_changes(events, base).where("NOT archived AND NOT superseded").select("memory_id", "content_hash")
