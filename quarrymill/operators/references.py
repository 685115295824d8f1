"""References to records that do not exist, or not yet, or no longer.

Skew-aware split: references are counted per key and period first. The keys with the most references (at most
HEAVY_KEYS of them, whatever the size of the data) are checked against a broadcast of as many target rows; all
others go through a shuffled join, in which no key can be large. Both halves are put together again: no reference
is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.keys import event_kind, loose_key, micros
from quarrymill.plans.session import cut

#: Bound of the broadcast: so many keys at most are handled as heavy.
HEAVY_KEYS = 1024
#: A key with fewer references is never heavy.
HEAVY_ROWS = 1000
MICROS = 1_000_000


def heavy_keys(counts: DataFrame, keys: list[str], most: int = HEAVY_KEYS, least: int = HEAVY_ROWS) -> DataFrame:
    """keys: the most-referred ones of counts(keys, period, n), at most `most` rows."""
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return totals.orderBy(F.desc("n"), *keys).limit(most).select(*keys)


def split_join(refs: DataFrame, targets: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """refs with the columns of targets (one row for each combination of keys) where there is one, else nulls, and `known`.

    hot(keys) has a bounded number of rows: refs to them meet a broadcast of as many targets, all others a shuffled join.
    """
    hot = F.broadcast(hot)
    targets = targets.withColumn("known", F.lit(True))
    marked = refs.join(hot.withColumn("heavy", F.lit(True)), keys, "left")
    few = targets.join(hot, keys, "left_semi")  # at most one row for each heavy key
    heavy = marked.where("heavy").drop("heavy").join(F.broadcast(few), keys, "left")
    rest = marked.where(F.col("heavy").isNull()).drop("heavy").join(targets, keys, "left")
    return heavy.unionByName(rest).withColumn("known", F.coalesce("known", F.lit(False)))


def with_target(refs: DataFrame, targets: DataFrame, most: int = HEAVY_KEYS, least: int = HEAVY_ROWS) -> DataFrame:
    """split_join() by key, the heavy ones counted. refs: key, period and others; targets: key and others, no common names but key."""
    counts = refs.where(F.col("key").isNotNull()).groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"))
    return split_join(refs, targets, heavy_keys(counts, ["key"], most, least), ["key"])


def state_at(refs: DataFrame, changes: DataFrame, value: str) -> DataFrame:
    """refs(key, at, ...) with `value` of the last change(key, at, nr, value) of the key at or before at; null without one.

    An as-of join without a window over a whole key: the changes are reduced to the last one of each key and hour, a
    running last over the hours (at most one row an hour) gives what each hour begins with, and only rows of one key and
    one hour are ordered together, however many a hot key has.
    """
    day = F.floor(F.col("at") / (3600 * MICROS))
    names = [c for c in refs.columns if c not in ("key", "at")]
    both = (
        refs.select("key", "at", F.lit(None).cast("bigint").alias("nr"), F.lit(None).cast(changes.schema[value].dataType).alias("_value"), F.struct(*names).alias("_ref"), F.lit(1).alias("_side"))
        .unionByName(
            changes.select("key", "at", "nr", F.col(value).alias("_value"), F.lit(None).cast(refs.select(F.struct(*names).alias("x")).schema["x"].dataType).alias("_ref"), F.lit(0).alias("_side"))
        )
        .withColumn("_day", day)
    )
    per_day = both.groupBy("key", "_day").agg(F.max(F.when(F.col("_side") == 0, F.struct("at", "nr", "_value"))).alias("_last"))
    before = Window.partitionBy("key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_day.select("key", "_day", F.last("_last", ignorenulls=True).over(before)["_value"].alias("_carried"))
    inside = Window.partitionBy("key", "_day").orderBy("at", "_side", "nr").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.join(begins, ["key", "_day"]).withColumn("_now", F.coalesce(F.last("_value", ignorenulls=True).over(inside), "_carried"))
    return seen.where("_side = 1").select("key", "at", "_ref.*", F.col("_now").alias(value))


def _references(rows: DataFrame, table: str, key: str) -> DataFrame:
    """source_table, row_id, key, at (microseconds), period (YYYY-MM, UTC): each row once, rows that refer to nothing left out."""
    at = F.col("created_at").cast("bigint") * MICROS
    return (
        rows.select(F.lit(table).alias("source_table"), F.col("id").alias("row_id"), loose_key(F.col(key)).alias("key"), at.alias("at"))
        .where(F.col("key").isNotNull())
        .groupBy("source_table", "row_id")
        .agg(F.min(F.struct("key", "at")).alias("r"))
        .select("source_table", "row_id", "r.*", F.date_format(F.timestamp_micros("r.at"), "yyyy-MM").alias("period"))
    )


def lifecycle(events: DataFrame) -> DataFrame:
    """key, at, nr, kind of the created, archived and restored events, each event_id once, at its earliest time."""
    e = events.select(
        F.col("event_id").alias("nr"), loose_key(F.col("memory_id")).alias("key"), micros(F.col("recorded_at")).alias("at"), event_kind(F.col("event_type")).alias("kind")
    ).where(F.col("kind").isin("created", "archived", "restored") & F.col("key").isNotNull())
    return e.groupBy("nr").agg(F.min(F.struct("at", "key", "kind")).alias("e")).select("nr", "e.*")


KEYS = ["source_table", "key"]


class _Sides:
    """The references of both tables, their counts per key and period, and what they refer to, each read once."""

    def __init__(self, feedback: DataFrame, violations: DataFrame, grounding: DataFrame, events: DataFrame, most: int, least: int):
        self.refs = cut(_references(feedback, "feedback", "violation_id").unionByName(_references(grounding, "bridge_grounding_results", "memory_id")))
        self.counts = self.refs.groupBy(*KEYS, "period").agg(F.count(F.lit(1)).alias("n"))
        self.hot = heavy_keys(self.counts, KEYS, most, least)
        self.life = cut(lifecycle(events))
        found = violations.select(F.lit("feedback").alias("source_table"), loose_key(F.col("id")).alias("key"), (F.col("created_at").cast("bigint") * MICROS).alias("t"))
        created = self.life.where("kind = 'created'").select(F.lit("bridge_grounding_results").alias("source_table"), "key", F.col("at").alias("t"))
        self.targets = found.unionByName(created).where(F.col("key").isNotNull()).groupBy(*KEYS).agg(F.min("t").alias("first_at"))

    def known(self) -> DataFrame:
        """source_table, key, row_id, at, period, first_at of the references whose target exists, sooner or later."""
        return split_join(self.refs, self.targets, self.hot, KEYS)

    def not_yet_or_no_longer(self, known: DataFrame) -> DataFrame:
        """source_table, row_id, period, reason (late or deleted) of rows of known."""
        late = F.coalesce(F.col("first_at") > F.col("at"), F.lit(False))
        archived = self.life.select("key", "at", "nr", (F.col("kind") == "archived").alias("archived"))
        alive = known.where(~late & F.col("at").isNotNull() & (F.col("source_table") == "bridge_grounding_results")).select("key", "at", "source_table", "row_id", "period")
        gone = state_at(alive, archived, "archived").where("archived")
        out = lambda df, reason: df.select("source_table", "row_id", "period", F.lit(reason).alias("reason"))
        return out(known.where(late), "late").unionByName(out(gone, "deleted"))


def orphan_references(feedback: DataFrame, violations: DataFrame, grounding: DataFrame, events: DataFrame, most: int = HEAVY_KEYS, least: int = HEAVY_ROWS) -> DataFrame:
    """source_table, row_id, period, reason of each row whose reference is missing, late or deleted.

    A null or blank reference refers to nothing and gives no row. A row without created_at can only be missing. Keys
    are compared without case and surrounding blanks on either side. Repeated rows count once. Clashing extra columns
    are ignored; empty tables make every reference to them missing.
    """
    sides = _Sides(feedback, violations, grounding, events, most, least)
    joined = cut(sides.known())
    missing = joined.where("NOT known").select("source_table", "row_id", "period", F.lit("missing").alias("reason"))
    return missing.unionByName(sides.not_yet_or_no_longer(joined.where("known")))


def orphan_counts(feedback: DataFrame, violations: DataFrame, grounding: DataFrame, events: DataFrame, most: int = HEAVY_KEYS, least: int = HEAVY_ROWS) -> DataFrame:
    """source_table, period, reason, n of orphan_references().

    Missing ones are counted without their rows: the counts per key and period are checked, the heavy keys' against a broadcast,
    the others' by a shuffled join, and those of keys that no target has are added up.
    """
    sides = _Sides(feedback, violations, grounding, events, most, least)
    checked = split_join(sides.counts, sides.targets.select(*KEYS), sides.hot, KEYS).where("NOT known")
    missing = checked.groupBy("source_table", "period").agg(F.sum("n").alias("n")).select("source_table", "period", F.lit("missing").alias("reason"), "n")
    rows = sides.not_yet_or_no_longer(cut(sides.known().where("known")))
    return missing.unionByName(rows.groupBy("source_table", "period", "reason").agg(F.count(F.lit(1)).alias("n")))
