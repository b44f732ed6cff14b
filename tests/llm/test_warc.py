"""Round trip of pages through archives."""

import glob
import gzip
import hashlib
from collections import Counter

import checker
from pyspark.sql import functions as F

from wireloom.llm import ORACLES, QUERIES, load
from wireloom.llm.warc import read_records, write_archives

load()


def test_query_equals_oracle(spark):
    ok, msg = checker.compare(spark, "op5", QUERIES["op5_warc"], ORACLES["op5_warc"], checker.connect())
    assert ok, msg


def test_round_trip_and_selection(spark, tmp_path):
    big, other = "ä" * 600, "b" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/ 4\r\nX: y", "small"), (5, "", "small"), (6, "http://a/6", None), (None, "http://a/n", other), (7, "http://a/7", other),
            (8, "http://a/8", "x" * 9_000_000), (9, "http://a/9", "a\r\n\r\nb\x00"), (9, "http://a/9", "a\r\n\r\nb\x00")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1))
    index = write_archives(pages, str(tmp_path / "w"))
    got = read_records(index, str(tmp_path / "w")).collect()
    whole = lambda h: (h or "").encode()
    want = Counter()
    for i, _, h in rows:
        owner = {big: 3, other: 7}.get(h)
        refers = owner if owner is not None and i != owner else None
        want[i, len(whole(h)), hashlib.sha1(whole(h)).hexdigest(), "revisit" if refers else "response", refers, None if refers else h or ""] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got) == want
    some = index.filter("page_id in (2, 9)")
    assert sorted(r.page_id for r in read_records(some, str(tmp_path / "w")).collect()) == [2, 9, 9]
    for f in glob.glob(str(tmp_path / "w" / "*.warc.gz")):
        assert gzip.open(f).read().count(b"WARC/1.1\r\n") == index.filter(F.col("file") == f.split("/")[-1]).count()
    assert write_archives(pages.limit(0), str(tmp_path / "e")).collect() == []


def test_given_texts_come_back_whole(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    index = write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r.payload for r in read_records(index, str(tmp_path / "w")).collect()}
    assert all(got[r.page_id] in (r.html, None) for r in pages.collect())
