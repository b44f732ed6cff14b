"""Session defaults and the two pieces of cluster plumbing the operators need."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: int | str = 8, app: str = "wireloom") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def _shared_folder(spark: SparkSession) -> None:
    """Point the context at the cluster's checkpoint folder; only a local run may fall back to a scratch one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: iteration results survive the loss of any executor."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager)


@contextmanager
def short_methods(spark: SparkSession) -> Iterator[None]:
    """For the eager cut of a long chain of nested array expressions: fused into one stage its generated methods are too long for the JIT
    compiler and run interpreted, while each step alone is split into methods that are compiled. Rows are the same."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that is dealt by key, never broadcast. A table that was cut keeps the planner's first guess of its size, which
    counts arrays and explodes far too low, so without this a large one would be gathered on the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one task, for functions over whole partitions. Plain ``repartition`` by the keys of a join before it is dropped as
    done already, and when the join then turns out small enough to be broadcast, its inputs are no longer dealt by key; a hash of the keys stays."""
    return df.repartition(F.xxhash64(*keys))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    _shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions whose executors do not have it installed. Once per context."""
    sc = spark.sparkContext
    if not getattr(sc, "_wireloom_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "wireloom"), "zip", os.path.dirname(root), os.path.basename(root))
        sc.addPyFile(archive)
        sc._wireloom_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """A table of few row groups is dealt out to all cores. On a cluster a scan that has work for all of them stays as it is."""
    if df.isStreaming:
        return df
    sc = df.sparkSession.sparkContext
    cores = sc.defaultParallelism
    return df if not sc.master.startswith("local[") and df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores)
