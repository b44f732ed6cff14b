"""Digest windows over a stream; late events reopen the windows they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..operators.asof import micros
from ..operators.digest import WINDOW, covered_events, digest_clusters, digest_groups, digest_layout, merge_clusters, windowed_source
from ..operators.filters import assign_windows
from ..session import cut_lineage
from .batches import BatchTable, slots_of


def touched_windows(late: DataFrame, length: str, every: str | None = None, col: str = "last_updated_at") -> DataFrame:
    """Distinct windows that late rows fall in."""
    return assign_windows(late.select(col), col, length, every).select(*WINDOW).distinct()


def recompute_digest(events: DataFrame, windows: DataFrame, length: str = "4 hours", destination: str | None = "vip_telegram") -> DataFrame:
    """Layout of the given windows only."""
    source = windowed_source(events, length, None, destination).join(windows, WINDOW, "left_semi")
    return digest_layout(digest_groups(source))


def stream_digest(stream: DataFrame, store: str, out: str, checkpoint: str, length: str = "4 hours", buckets: int = 256) -> StreamingQuery:
    """An incremental view: each batch lays out again the windows that its events enter or leave, and no others. Nothing is dropped as late.

    Events are stored by window (``store/events``); ``store/places`` holds, by bucket of the event id, the window an event was last put
    in. A batch looks up the places of its own events, takes those that moved out of their old window (a row marked ``gone``), and
    reads only the windows it touched, so what a batch costs does not depend on the age of the store. Of the rows of an event
    the latest batch counts, and in a batch the latest update. Below ``out``, ``layout`` has the bullets, ``covered`` the events of each
    bullet and ``windows`` the manifest of snapshots: the windows each batch laid out, of which the latest holds (:func:`current`).
    All writes overwrite a folder of their batch.
    """
    fields = [f for f in stream.schema.fields if f.name != "event_id"]
    window = F.window(F.col("last_updated_at"), length)
    slot_of = lambda start: micros(start)
    events = BatchTable(f"{store}/events", StructType([StructField("event_id", LongType()), *fields, StructField("gone", BooleanType()), StructField("batch", LongType())]))
    places = BatchTable(f"{store}/places", StructType([StructField("event_id", LongType()), StructField("at", LongType()), StructField("batch", LongType())]))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("event_id"), F.lit(buckets))
        names = [f.name for f in fields]
        rows = batch.groupBy("event_id").agg(F.max_by(F.struct(*names), micros("last_updated_at")).alias("x")).select("event_id", "x.*")
        rows = cut_lineage(rows.withColumn("slot", slot_of(window["start"])))
        asked = rows.select("event_id", bucket.alias("slot"))
        known = places.read(spark, batch_id, slots_of(asked)).join(rows.select("event_id"), "event_id", "left_semi")
        old = known.groupBy("event_id").agg(F.max_by("at", "batch").alias("was"))
        left = rows.join(old, "event_id").filter("was <> slot").withColumn("slot", F.col("was"))
        stamp = lambda df, gone: df.withColumns({"gone": F.lit(gone), "batch": F.lit(batch_id).cast("long")})
        changed = cut_lineage(stamp(rows, False).unionByName(stamp(left.drop("was"), True)))
        events.add(changed, batch_id)
        places.add(rows.select("event_id", F.col("slot").alias("at"), F.lit(batch_id).cast("long").alias("batch"), bucket.alias("slot")), batch_id)
        touched = slots_of(changed)
        inside = events.read(spark, batch_id + 1, touched)
        cols = [c for c in inside.columns if c not in ("event_id", "slot", "batch")]
        latest = inside.groupBy("slot", "event_id").agg(F.max_by(F.struct(*cols), F.struct("batch", ~F.col("gone"))).alias("x")).select("event_id", "x.*").filter("not gone").drop("gone")
        clusters = cut_lineage(digest_clusters(windowed_source(latest, length)))
        layout = cut_lineage(digest_layout(merge_clusters(clusters)))
        where = f"batch={batch_id}"
        layout.write.mode("overwrite").parquet(f"{out}/layout/{where}")
        covered_events(clusters, layout).write.mode("overwrite").parquet(f"{out}/covered/{where}")
        starts = changed.select("slot").distinct().withColumn("window_start", F.expr("timestampadd(MICROSECOND, slot, TIMESTAMP_NTZ '1970-01-01 00:00:00')"))
        starts.select("window_start").write.mode("overwrite").parquet(f"{out}/windows/{where}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, kind: str = "layout") -> DataFrame:
    """Rows (``layout`` or ``covered``) of the latest snapshot of every window; a window that was emptied has none."""
    last = spark.read.parquet(f"{out}/windows").groupBy("window_start").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/{kind}").join(last, ["window_start", "batch"], "left_semi").drop("batch")
