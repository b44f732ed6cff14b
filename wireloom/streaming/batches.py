"""Tables that a stream extends batch by batch and looks up by slot, at a cost that does not grow with their age."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

TIER = 8  # parts of a tier that are put together to one of the next


def _folders(spark: SparkSession, path: str) -> set[str]:
    """Names below a folder of whatever file system; none if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()


class BatchTable:
    """Parquet below ``path/part=…/slot=…``. ``slot`` is a bucket of a key or a slot of time.

    Batch n adds part ``0-n``. Each time ``TIER`` parts of a tier are complete they are written once more as one part of the next
    tier, so the table is read from at most ``TIER`` parts a tier and a row is rewritten once a tier. Which parts hold the table after n
    batches follows from n alone, so there is no list to keep, and a replayed batch overwrites what its first try wrote and
    reads what that read. Batch numbers count from 0 without gaps, as those of ``foreachBatch`` do.
    """

    def __init__(self, path: str, schema: StructType) -> None:
        self.path = path
        self.schema = StructType([*schema.fields, StructField("slot", LongType()), StructField("part", StringType())])
        self.columns = [f.name for f in schema.fields]

    @staticmethod
    def parts(batches: int) -> list[str]:
        """Parts that hold the first ``batches`` batches."""
        out, at, tier = [], 0, 0
        while TIER ** (tier + 1) <= batches:
            tier += 1
        while tier >= 0:
            size = TIER ** tier
            while at + size <= batches:
                out.append(f"{tier}-{at}")
                at += size
            tier -= 1
        return out

    def _read(self, spark: SparkSession, parts: Iterable[str], slots: set[int] | None) -> DataFrame:
        paths = []
        for part in parts:
            there = {x for x in _folders(spark, f"{self.path}/part={part}") if x.startswith("slot=")}
            wanted = there if slots is None else there & {f"slot={s}" for s in slots}
            paths += [f"{self.path}/part={part}/{x}" for x in sorted(wanted)]
        if not paths:
            return spark.createDataFrame([], self.schema).drop("part")
        return spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths).drop("part")

    def read(self, spark: SparkSession, batches: int, slots: Iterable[int] | None = None) -> DataFrame:
        """Rows of the first ``batches`` batches; only the folders of the given slots are opened."""
        return self._read(spark, self.parts(batches), None if slots is None else set(slots))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Store a batch (the schema's columns and ``slot``) and put full tiers together."""
        spark = rows.sparkSession
        rows.select(*self.columns, "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/part=0-{batch}")
        tier, done = 1, batch + 1
        while done % TIER ** tier == 0:
            first, step = done - TIER ** tier, TIER ** (tier - 1)
            whole = self._read(spark, [f"{tier - 1}-{first + k * step}" for k in range(TIER)], None)
            # one file a slot, or several if a slot is large: rows of a slot are dealt by a second column
            whole.repartition("slot", F.pmod(F.xxhash64(*self.columns[:1]), F.lit(4))).write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/part={tier}-{first}")
            tier += 1


def slots_of(rows: DataFrame, col: str = "slot") -> list[int]:
    """The distinct slots of a batch: at most as many as there are buckets, or slots in the batch's span of time."""
    return [r[0] for r in rows.select(col).distinct().collect()]
