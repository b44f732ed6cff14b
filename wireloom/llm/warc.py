"""WARC archives with an index: records are located first and then read as coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import register
from .store import stored
from ..session import scratch_path

REVISIT_BYTES = 1000     # smaller payloads are always stored in full
FILE_BYTES = 128 << 20   # a task starts another archive beyond this
GAP = 64 << 10           # bytes between two wanted records that are read along rather than skipped
SPAN = 4 << 20           # bytes of one read

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def _uri(page: int | None, url: str | None) -> str:
    """The address in a header: control characters and blanks are percent-encoded; a missing one is named by its page."""
    return f"urn:page:{page}" if not url else "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)


def _name(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page}')}>"


def pack(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member with a response record, or a revisit record without the payload if ``refers_to`` is given."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(page, url)}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def unpack(member: bytes) -> dict:
    """The record of one gzip member; a response whose payload does not have the digest it names is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(h["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if h["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of {h['WARC-Target-URI']}")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("WARC-Page-ID"), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"),
            "payload_bytes": size, "payload_digest": digest, "payload": payload.decode() if h["WARC-Type"] == "response" else None}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every page as a WARC record below ``folder`` and return the stored index: file, offset, length, URL and digest of each record.

    Of pages with equal payloads (by SHA-1 and at least REVISIT_BYTES long) the one with the largest id is the response and the others are
    revisits of it; null html is an empty payload. Null ids get a record without one, and never are what others refer to. Rows that repeat the largest id are all
    responses. An archive belongs to one attempt of one task and has a name of its own; only archives of attempts
    whose index rows were committed are ever read, so a lost executor costs a file and no record.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    owner = p.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").select("digest", "owner")
    known = p.join(owner, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, file, at = None, None, 0
        for batch in batches:
            rows = []
            for page, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{file}", compression=None)
                member = pack(page, url, payload.encode("utf-8", "replace"), digest, refers_to, date)
                out.write(member)
                rows.append((page, file, at, len(member), url, digest, "response" if refers_to is None else "revisit", refers_to))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                                                 names=["page_id", "file", "offset", "length", "url", "digest", "record_type", "refers_to"])
        if out is not None:
            out.close()

    return stored(known.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` (any selection of its rows) names, whole and checked.

    Rows are dealt by ranges of file and offset, so that a task reads one stretch of an archive: wanted records that lie at most GAP bytes
    apart are fetched in one read of up to SPAN bytes.
    """
    wanted = index.select("file", "offset", "length")
    wanted = wanted.repartitionByRange(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)

        def fetch(file: str, spans: list[tuple[int, int]]) -> pa.RecordBatch:
            first, last = spans[0][0], max(o + n for o, n in spans)
            with fs.open_input_file(f"{base}/{file}") as f:
                data = f.read_at(last - first, first)
            rows = [unpack(data[o - first:o - first + n]) for o, n in spans]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(rows[0], kinds)], names=list(rows[0]))

        file, spans = None, []
        for batch in batches:
            for f, o, n in zip(*[c.to_pylist() for c in batch.columns]):
                end = spans[-1][0] + spans[-1][1] if spans else 0
                if spans and (f != file or o > end + GAP or o + n - spans[0][0] > SPAN):
                    yield fetch(file, spans)
                    spans = []
                file = f
                spans.append((o, n))
        if spans:
            yield fetch(file, spans)

    return wanted.mapInArrow(run, RECORD)


ORACLE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> owner THEN owner END AS refers_to FROM d"""


@register("op5_warc", ORACLE)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
