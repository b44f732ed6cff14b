"""Written intermediates and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: the plan restarts there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if a count proves it has at most ``max_rows`` rows; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
