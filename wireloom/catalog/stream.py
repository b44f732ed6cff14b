"""Streaming queries: the provided files are read as a stream to the end and the stored result is returned."""

from pyspark.sql import functions as F

from . import register
from .base_sql import CLAIMS, with_
from .digest import COVERED, CTES as DIGEST_CTES
from .ingest import ENVELOPES, MESSAGES, _KIND
from .scoring import BURST, FEATURE_CTES
from ..functions import text as T
from ..session import scratch_path
from ..sources import fixture as X
from ..streaming import digest as SD, ingest as SI, state as SS


class _AsStream:
    """Session stand-in: ``read.parquet(path)`` opens the table as a stream of four parts, cut by ``order``, in the sequence ``parts``.

    A part may come late or twice; rows without an order belong to the last part. Every part is written by as many tasks as the table
    has partitions (two at least), one file each, and a batch takes that many files.
    """

    def __init__(self, spark, parts=(0, 2, 1, 3, 0), order="ts"):
        self._spark, self._parts, self._order = spark, parts, order

    @property
    def read(self):
        return self

    def parquet(self, path):
        df = self._spark.read.parquet(path)
        folder, order = scratch_path(self._spark, "parts"), F.col(self._order)
        lo, hi = df.agg(F.min(order), F.max(order)).first()
        files = max(2, df.rdd.getNumPartitions())
        cuts = [] if lo is None else [lo + (hi - lo) / 4 * k for k in (1, 2, 3)]
        part_of = F.lit(3)
        for k, cut in reversed(list(enumerate(cuts))):
            part_of = F.when(order < F.lit(cut), k).otherwise(part_of)
        for k in self._parts:
            df.filter(part_of == k).repartition(files).write.mode("append").parquet(folder)
        return self._spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _finish(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@register("stream_ingest", f"WITH {MESSAGES}, {ENVELOPES} SELECT source_stream_id, source_message_id, min(arrival_id) AS arrival_id FROM envelopes GROUP BY 1, 2")
def stream_ingest(spark, sf):
    d = _AsStream(spark, (0, 1, 2, 3, 0), "doc_id").parquet(f"{sf}/documents.parquet")
    msgs = d.select(F.col("doc_id").alias("arrival_id"), T.lookup(F.col("lang"), _KIND).alias("source_type"), F.col("source").alias("source_stream_id"),
                    (F.col("doc_id") % 37).cast("string").alias("source_message_id"))
    table = scratch_path(spark, "ingest")
    _finish(SI.stream_ingest(msgs, table, scratch_path(spark, "ck")))
    return spark.read.parquet(table).select("source_stream_id", "source_message_id", "arrival_id")


@register("stream_burst", with_(*FEATURE_CTES, BURST) + "SELECT * FROM burst")
def stream_burst(spark, sf):
    cols = ["claim_id", "topic", "created_at", "fingerprint", "source_claimed", "impact_score", "countries", "orgs", "people", "keywords"]
    out = scratch_path(spark, "burst")
    _finish(SS.stream_burst(X.raw_claims(_AsStream(spark, (0, 2, 1, 3)), sf).select(*cols), scratch_path(spark, "recent"), out, scratch_path(spark, "ck")))
    return SS.current_burst(spark.read.parquet(out))


@register("stream_novelty", with_(CLAIMS, """rows_ AS (SELECT claim_id, fingerprint, created_at, coalesce(impact_score >= 40, false) AS ok, row_number() OVER (PARTITION BY fingerprint ORDER BY created_at, claim_id) AS rn FROM claims),
greedy AS (SELECT claim_id, fingerprint, rn, ok AS selected, CASE WHEN ok THEN created_at END AS last FROM rows_ WHERE rn = 1
  UNION ALL SELECT claim_id, fingerprint, rn, s, CASE WHEN s THEN created_at ELSE last END FROM (
    SELECT r.*, g.last, r.ok AND NOT coalesce(g.last >= r.created_at - INTERVAL '3' HOUR, false) AS s FROM greedy g JOIN rows_ r ON r.fingerprint = g.fingerprint AND r.rn = g.rn + 1) z)""")
          + "SELECT claim_id AS event_id, fingerprint AS cluster_key, selected FROM greedy")
def stream_novelty(spark, sf):
    """Stateful suppression over several batches in order; equal to the greedy reading of the whole table."""
    c = X.claims(_AsStream(spark, (0, 1, 2, 3)), sf).select(F.col("claim_id").alias("event_id"), F.col("fingerprint").alias("cluster_key"), F.col("created_at").alias("scored_at"),
                                              F.coalesce(F.col("impact_score") >= 40, F.lit(False)).alias("eligible"))
    out = scratch_path(spark, "novelty")
    _finish(SS.stream_novelty(c).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start())
    return spark.read.parquet(out)


def _digest_view(spark, sf, kind):
    out = scratch_path(spark, "digest")
    _finish(SD.stream_digest(X.claims(_AsStream(spark), sf).withColumnRenamed("claim_id", "event_id"), scratch_path(spark, "events"), out, scratch_path(spark, "ck")))
    return SD.current(spark, out, kind)


@register("stream_digest", with_(*DIGEST_CTES) + "SELECT * FROM layout")
def stream_digest(spark, sf):
    return _digest_view(spark, sf, "layout")


@register("stream_digest_covered", with_(*DIGEST_CTES).rstrip("\n") + COVERED + "SELECT * FROM told")
def stream_digest_covered(spark, sf):
    """Covered events of every window's latest snapshot after five batches, one of them late and one repeated."""
    return _digest_view(spark, sf, "covered")


@register("touched_windows", with_(CLAIMS) + """SELECT DISTINCT time_bucket(INTERVAL '4' HOUR, last_updated_at) AS window_start, time_bucket(INTERVAL '4' HOUR, last_updated_at) + INTERVAL '4' HOUR AS window_end
FROM claims WHERE event_time IS NULL OR event_time < last_updated_at - INTERVAL '3' HOUR""")
def touched_windows(spark, sf):
    late = X.claims(spark, sf).filter(F.col("event_time").isNull() | (F.col("event_time") < F.col("last_updated_at") - F.expr("INTERVAL 3 HOURS")))
    return SD.touched_windows(late, "4 hours")
