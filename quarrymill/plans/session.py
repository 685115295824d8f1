"""Session settings, table access and lineage cutting."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrymill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: UTC, and that Python workers find this package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where master is one local process (tests) may it be unset; a temporary folder then serves."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is unset: master {master or 'unknown'} needs a folder that all executors share")
    where = getattr(spark, "_quarrymill_folder", None)
    if not where:
        where = spark._quarrymill_folder = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        _LEFT[where] = spark
    return where


_LEFT: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder, deleted with all below it when the session's Python process ends, if not before."""
    path = f"{shared_folder(spark)}/quarrymill-{kind}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there, without its lineage.

    A written table survives the loss of executors, has known sizes and, unlike a checkpoint, hands none of the
    constraints of its plan on, which grow without bound in loops.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrymill_path = path
    return out


def cut_counting(df: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut(df), and how many rows meet each condition, counted while they are written: loops need no job of their own to see whether they are done."""
    seen = Observation()
    out = cut(df.observe(seen, *[F.count_if(c).alias(k) for k, c in conditions.items()]))
    return out, {k: int(seen.get[k] or 0) for k in conditions}


def forget(path: str, spark: SparkSession) -> None:
    """Delete a scratch path now."""
    if _LEFT.pop(path, None) is not None:
        _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing needs any more."""
    for t in tables:
        path = getattr(t, "_quarrymill_path", None)
        if path and _LEFT.pop(path, None) is not None:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_left() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for steps that compute much for each byte read.

    Few large row groups otherwise leave cores idle. Where a scan is split finely enough already, nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
