"""Window and eligibility predicates over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vocab as V

PUBLISH_FLAGS = {"vip_telegram": "is_published", "x": "is_published_x"}


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def in_window(df: DataFrame, col: str, start, end) -> DataFrame:
    """Half-open: ``start <= col < end``."""
    return df.filter((F.col(col) >= start) & (F.col(col) < end))


def in_event_window(df: DataFrame, start, end, event: str = "event_time", fallback: str = "last_updated_at") -> DataFrame:
    """Half-open on event time, or on the fallback where there is none."""
    when = F.coalesce(event, fallback)
    return df.filter((when >= start) & (when < end))


def event_base(df: DataFrame, start, end, min_impact: float | None = None) -> DataFrame:
    """Closed window on a present event time; a null impact fails a minimum."""
    out = df.filter((F.col("event_time") >= start) & (F.col("event_time") <= end))
    return out if min_impact is None else out.filter(F.col("impact_score") >= min_impact)


def min_impact_exclusive(df: DataFrame, floor: float = 35.0) -> DataFrame:
    return df.filter(F.col("impact_score") > floor)


def unpublished(df: DataFrame, destination: str) -> DataFrame:
    flag = PUBLISH_FLAGS.get(destination)
    return df if flag is None else df.filter(~F.coalesce(flag, F.lit(False)))


def assign_windows(df: DataFrame, col: str, length: str, every: str | None = None, shift: str = "0 seconds") -> DataFrame:
    """Every ``[start, end)`` window a row falls in, one row per window: columns window_start, window_end."""
    w = F.window(F.col(col), length, every or length, shift)
    return df.withColumn("_w", w).withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")


def feed_rows(df: DataFrame, topic: str | None = None) -> DataFrame:
    out = df.filter(F.col("event_time").isNotNull() & F.col("topic").isin(*V.TOPICS) & (F.length(F.trim("summary")) > 0))
    return out if topic is None else out.filter(F.col("topic") == topic)


def after(df: DataFrame, time, event_id: int) -> DataFrame:
    """Rows behind a page key in (time desc, id desc) order."""
    t, i = F.col("event_time"), F.col("event_id")
    return df.filter((t < time) | ((t == time) & (i < event_id)))


def entity_mentions(df: DataFrame, kind: str, value: str, start=None, end=None) -> DataFrame:
    """Exact type and value; a null time fails a bound; newest first."""
    out = df.filter((F.col("entity_type") == kind) & (F.col("entity_value") == value))
    if start is not None:
        out = out.filter(F.col("event_time") >= start)
    if end is not None:
        out = out.filter(F.col("event_time") <= end)
    return out.orderBy(F.desc_nulls_last("event_time"), F.desc("raw_message_id"))
