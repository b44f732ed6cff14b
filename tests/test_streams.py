"""Tables and states of the streams: late rows, replays, moved events, and what a batch reads."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from wireloom.operators import digest as D
from wireloom.streaming import batches as B, digest as SD, ingest as SI, state as SS

T0 = dt.datetime(2024, 1, 1)


def run(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_parts_cover_batches(monkeypatch):
    monkeypatch.setattr(B, "TIER", 3)
    for n in range(60):
        spans = [(int(p.split("-")[1]), 3 ** int(p.split("-")[0])) for p in B.BatchTable.parts(n)]
        assert [x for at, size in spans for x in range(at, at + size)] == list(range(n))
        assert len(spans) <= 2 * 5


def test_batch_table_reads_slots_and_survives_replay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "TIER", 2)
    rows = lambda n: spark.range(n * 10, n * 10 + 10).select("id", (F.col("id") % 3).alias("slot"))
    table = B.BatchTable(str(tmp_path / "t"), rows(0).select("id").schema)
    assert table.read(spark, 0, [0]).count() == 0
    for n in (0, 1, 2, 2, 3, 4, 4):  # two batches are replayed
        table.add(rows(n), n)
    assert sorted(r.id for r in table.read(spark, 5).collect()) == list(range(50))
    assert sorted(r.id for r in table.read(spark, 3).collect()) == list(range(30))  # what a replay of batch 3 sees
    one = table.read(spark, 5, [1])
    assert sorted(r.id for r in one.collect()) == [i for i in range(50) if i % 3 == 1]
    assert all("slot=1" in f for f in one.inputFiles()) and len(B.BatchTable.parts(5)) == 2


def test_ingest_reads_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    read, seen = B.BatchTable.read, []
    monkeypatch.setattr(B.BatchTable, "read", lambda self, s, n, slots=None: seen.append((n, sorted(slots))) or read(self, s, n, slots))
    src, schema = str(tmp_path / "in"), "arrival_id long, source_type string, source_stream_id string, source_message_id string"
    for n, keys in enumerate((["a", "b", "a"], ["b", "c"], ["a"])):
        spark.createDataFrame([(10 * n + i, "rss", "s", k) for i, k in enumerate(keys)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    run(SI.stream_ingest(stream, str(tmp_path / "t"), str(tmp_path / "ck"), buckets=64))
    assert sorted(r.source_message_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b", "c"]
    assert [n for n, _ in seen] == [0, 1, 2] and [len(s) for _, s in seen] == [2, 2, 1]


def _event(i, hours, impact=60.0, text=None):
    return (i, "fx", text or f"Summary {i}.", impact, T0 + dt.timedelta(hours=hours), f"f{i}", None, False)


EVENT = "event_id long, topic string, summary string, impact_score double, last_updated_at timestamp_ntz, fingerprint string, claim_hash string, is_published boolean"


def test_digest_view_moves_events_and_empties_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    for rows in ([_event(1, 1), _event(2, 1), _event(3, 9)], [_event(3, 2)], [_event(1, 30, text="Moved."), _event(2, 31), _event(2, 29)], [_event(4, 5, impact=10.0)]):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    run(SD.stream_digest(stream, str(tmp_path / "store"), out, str(tmp_path / "ck")))
    now = [_event(1, 30, text="Moved."), _event(2, 31), _event(3, 2), _event(4, 5, impact=10.0)]
    want = D.digest_windows(spark.createDataFrame(now, EVENT))
    rows = lambda df: sorted(map(repr, (tuple(r[c] for c in want.columns) for r in df.collect())))
    assert rows(SD.current(spark, out)) == rows(want)
    assert {(r.window_start.hour, r.event_id) for r in SD.current(spark, out, "covered").collect()} == {(4, 1), (4, 2), (0, 3)}
    windows = {(r.batch, r.window_start) for r in spark.read.parquet(f"{out}/windows").collect()}
    assert {(b, s.hour + 24 * (s.day - 1)) for b, s in windows} == {(0, 0), (0, 8), (1, 0), (1, 8), (2, 0), (2, 28), (3, 4)}


def test_published_events_leave_the_next_digest(spark):
    ev = spark.createDataFrame([_event(1, 1, text="Same text"), _event(2, 1, text="same text!"), _event(3, 2, impact=20.0), _event(4, 3)], EVENT)
    clusters = D.digest_clusters(D.windowed_source(ev))
    layout = D.digest_layout(D.merge_clusters(clusters), top=1, per_section=0)
    covered = D.covered_events(clusters, layout.filter("position = 1 and section = 'top'"))
    assert {(r.representative_id, r.event_id) for r in covered.collect()} in ({(1, 1), (1, 2)}, {(4, 4)})
    marked = D.mark_published(ev, covered, "vip_telegram")
    left = {r.event_id for r in D.windowed_source(marked).collect()}
    assert left == {1, 2, 4} - {r.event_id for r in covered.collect()}
    assert D.mark_published(ev, covered, "elsewhere").collect() == ev.collect()


@pytest.mark.parametrize("held", [100_000, 3])
def test_novelty_over_batches_with_late_rows(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(SS, "HELD", held)
    src, schema = str(tmp_path / "in"), "event_id long, cluster_key string, scored_at timestamp_ntz, eligible boolean"
    at = lambda i, k, minutes, ok=True: (i, k, T0 + dt.timedelta(minutes=minutes), ok)
    parts = ([at(5, "a", 400), at(1, "a", 0), at(2, "a", 100), at(3, "a", 181), at(4, "a", 350), at(6, "b", 0, False), at(7, "b", 1)], [at(8, "a", 450), at(9, "a", 600), at(10, "b", 181)], [at(11, "a", 500), at(12, "b", 182)])
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = SS.stream_novelty(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run(query)
    got = {r.event_id: r.selected for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 11 is late: it is held against the last selection of its key (9)
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: False, 9: True, 10: False, 11: False, 12: True}


def test_novelty_forgets_keys(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "event_id long, cluster_key string, scored_at timestamp_ntz, eligible boolean"
    sizes, got = [], {}
    for n in range(3):
        spark.createDataFrame([(100 * n + i, f"k{i if n == 0 else 0}", T0, True) for i in range(20 if n == 0 else 1)], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        query = run(SS.stream_novelty(stream, keep_hours=2 / 3600).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        time.sleep(3)
    got = {r.event_id: r.selected for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 22 and got[100] and got[200]  # late rows of forgotten keys are answered
    assert sizes[-1] < sizes[0]
