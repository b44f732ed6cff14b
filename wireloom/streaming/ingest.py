"""Continuous ingest: every source key is stored exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.messages import KEY, ingest, to_envelope
from .batches import BatchTable, slots_of

BUCKETS = 256  # of the key table; fixed for the life of a table


def key_table(path: str) -> BatchTable:
    """The keys stored so far, by bucket of their hash."""
    return BatchTable(path, StructType([StructField(k, StringType()) for k in KEY]))


def stream_ingest(stream: DataFrame, table: str, checkpoint: str, arrival: str = "arrival_id", buckets: int = BUCKETS) -> StreamingQuery:
    """Append unseen keys batch by batch. A batch owns the folder ``batch_id=…`` and overwrites it, so a replay after a
    failure leaves the table as it was. Known keys lie in a table of their own beside it (``<table>-keys``), of which a batch reads
    only the buckets that its own keys fall in."""
    known_keys = key_table(f"{table}-keys")
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("slot", bucket)
        known = known_keys.read(batch.sparkSession, batch_id, slots_of(batch)).select(*KEY)
        fresh, _ = ingest(batch.drop("slot"), known, arrival)
        fresh.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        stored = batch.sparkSession.read.schema(fresh.schema).parquet(f"{table}/batch_id={batch_id}")
        known_keys.add(stored.select(*KEY, bucket.alias("slot")), batch_id)

    return to_envelope(stream).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
