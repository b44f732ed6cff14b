"""Burst state (15 minutes per topic) and novelty state (three hours per cluster key)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.asof import micros, slice_of
from ..operators.enrich import NOVELTY
from ..operators.triage import BURST, burst_counts
from .batches import BatchTable, slots_of

HELD = 100_000       # rows of a key in one batch that a task holds
SLOT = NOVELTY // 16  # time slot of rows beyond that


def stream_burst(stream: DataFrame, recent: str, out: str, checkpoint: str) -> StreamingQuery:
    """Burst counts per claim as it arrives, in whatever order.

    Claims are stored by 15-minute slot. A batch opens only the slots around its own claims, whatever the age of the store, and counts
    again for every claim a new one can change: those of its slot and the next. Outputs carry the batch, the latest batch of a claim holds (see
    :func:`current_burst`). All writes overwrite a folder of their batch, so a replay gives the same files, and a
    repeated claim changes nothing.
    """
    store = BatchTable(recent, stream.schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("slot", slice_of(micros("created_at"), BURST))
        own = set(slots_of(batch))
        store.add(batch, batch_id)
        around = lambda lo, hi: {s + k for s in own for k in range(lo, hi + 1)}
        seen = store.read(spark, batch_id + 1, around(-1, 1)).dropDuplicates(["claim_id"])
        asked = batch.select(F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot")).distinct()
        asked = seen.join(asked, "slot", "left_semi").select("claim_id")
        burst_counts(seen.drop("slot")).join(asked, "claim_id", "left_semi").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_burst(df: DataFrame) -> DataFrame:
    """The latest counts of every claim."""
    cols = [c for c in df.columns if c not in ("claim_id", "batch")]
    return df.groupBy("claim_id").agg(F.max_by(F.struct(*cols), "batch").alias("x")).select("claim_id", "x.*")


class _Novelty(StatefulProcessor):
    """State of a cluster key: the time of its last selected event, forgotten after ``keep_ms``, and, only while a batch has more rows
    of the key than a task should hold, these rows by time slot."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long", self.keep_ms)
        self.waiting = handle.getMapState("waiting", "slot long", "us array<long>, id array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        start, held, spilled = last, [], False
        for part in rows:
            open_ = part["eligible"].astype(bool)
            yield self._answers(key, part["event_id"][~open_], False)
            held += zip(part["us"][open_].tolist(), part["event_id"][open_].tolist())
            if len(held) > HELD:
                self._spill(held)
                held, spilled = [], True
        if spilled:
            self._spill(held)
            slots = sorted(k[0] for k in self.waiting.keys())
            parts = ((slot, zip(*self.waiting.getValue((slot,)))) for slot in slots)
        else:
            parts = ((None, held),)
        for slot, part in parts:
            chosen, other = [], []
            for us, event_id in sorted(part):
                if last is not None and last >= us - NOVELTY:
                    other.append(event_id)
                else:
                    chosen.append(event_id)
                    last = us
            if slot is not None:
                self.waiting.removeKey((slot,))
            yield self._answers(key, chosen, True)
            yield self._answers(key, other, False)
        if last != start:
            self.last.update((last,))

    def _spill(self, held: list[tuple[int, int]]) -> None:
        by_slot: dict[int, list] = {}
        for us, event_id in held:
            by_slot.setdefault(us // SLOT, []).append((us, event_id))
        for slot, rows in by_slot.items():
            us, ids = self.waiting.getValue((slot,)) if self.waiting.containsKey((slot,)) else ([], [])
            self.waiting.updateValue((slot,), ([*us, *(r[0] for r in rows)], [*ids, *(r[1] for r in rows)]))

    @staticmethod
    def _answers(key, ids, selected: bool) -> pd.DataFrame:
        return pd.DataFrame({"event_id": pd.Series(list(ids), dtype="int64"), "cluster_key": key[0], "selected": selected})

    def close(self) -> None:
        pass


def stream_novelty(stream: DataFrame, keep_hours: float = 3 + 24) -> DataFrame:
    """Selection with three-hour suppression per cluster key, one answer for every row however late it comes.

    State lives in RocksDB (the session is set so, and to run batches only when rows come): one time stamp per key. A row is held against the last selection of its key; ``keep_hours``
    of processing time after that selection the key is forgotten, by default three hours, in which it can block rows that come in time,
    and a day for late ones. There is no watermark, so nothing is dropped: a row that comes later still is answered as if its
    key were new. A batch's rows of a key are read as a stream; beyond ``HELD`` of them they wait in the state store by time slot and
    are taken slot by slot. Needs event_id, cluster_key, scored_at, eligible.
    """
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch writes what it changed, not a snapshot
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a run over what is available ends; expired keys go when rows come
    slim = stream.select("cluster_key", F.unix_micros(F.col("scored_at").cast("timestamp")).alias("us"), "event_id", "eligible")
    return slim.groupBy("cluster_key").transformWithStateInPandas(
        _Novelty(int(keep_hours * 3_600_000)), "event_id long, cluster_key string, selected boolean", "Append", "ProcessingTime")
