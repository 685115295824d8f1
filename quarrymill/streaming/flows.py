"""Structured Streaming forms: deduplication, windows, sessions, incremental aggregates, causal delivery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.plans.session import scratch


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a path (a folder or one file), with the schema they have."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def without_repeats(stream: DataFrame, keys: list[str], at: str, ttl: str = "60 seconds") -> DataFrame:
    """The first row of each key within ttl of event time; state older than that is dropped."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, at: str, key: str, size: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """key, start, end, n of runs of events with gaps below `gap`."""
    g = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def delivered_in_order(stream: DataFrame, key: str, nr: str) -> DataFrame:
    """key, nr in causal order: a row is delivered once all with smaller numbers (from 1) of its key were; others wait in state."""

    def deliver(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, waiting = state.get if state.exists else (0, [])
        waiting = set(waiting)
        for f in frames:
            waiting |= {int(x) for x in f[nr] if x > done}
        out = []
        while done + 1 in waiting:
            done += 1
            waiting.discard(done)
            out.append(done)
        state.update((done, sorted(waiting)))
        yield pd.DataFrame({key: [group[0]] * len(out), nr: out})

    return stream.groupBy(key).applyInPandasWithState(deliver, f"{key} bigint, {nr} bigint", "done bigint, waiting array<bigint>", "append", "NoTimeout")


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and give what it wrote."""
    spark = stream.sparkSession
    folder = scratch(spark, "flow")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def merged_totals(spark: SparkSession, stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total kept up to date batch by batch: each batch is aggregated and merged with the table so far (two versions, written in turn)."""
    folder = scratch(spark, "totals")

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        if number:
            new = new.unionByName(batch.sparkSession.read.parquet(f"{folder}/v{number - 1}")).groupBy(key).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        new.write.mode("overwrite").parquet(f"{folder}/v{number}")
        last[0] = number

    last = [0]
    q = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/v{last[0]}")
