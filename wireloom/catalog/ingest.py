"""Sources, ingest, text keys, reuse and work selection over the documents table."""

from pyspark.sql import functions as F

from . import register
from .base_sql import case_map, first_family, q
from ..functions import text as T, vocab as V
from ..session import spread
from ..sources import adhoc, messages as M

_KIND = {"en": "telegram", "fr": " RSS ", "de": "", "es": "Web"}
MESSAGES = f"""messages AS (
  SELECT doc_id AS arrival_id, {case_map("lang", _KIND)} AS source_type, source AS source_stream_id,
    CAST(doc_id % 37 AS VARCHAR) AS source_message_id, text AS raw_text,
    CASE WHEN n_chars % 50 <> 0 THEN TIMESTAMP '2024-01-01' + doc_id * INTERVAL '7' MINUTE END AS message_timestamp_utc
  FROM documents)"""
ENVELOPES = """envelopes AS (
  SELECT * REPLACE (CASE WHEN trim(lower(source_type)) NOT IN ('', 'telegram')
                    THEN trim(lower(source_type)) || ':' || source_stream_id ELSE source_stream_id END AS source_stream_id,
                    CASE WHEN trim(source_type) = '' THEN source_type ELSE trim(lower(source_type)) END AS source_type)
  FROM messages)"""
EXISTING = """existing AS (
  SELECT DISTINCT 'src' || (page_id % 20) AS source_stream_id, CAST(page_id % 37 AS VARCHAR) AS source_message_id FROM pages)"""
_FIRST = """firsts AS (
  SELECT source_stream_id, source_message_id, min(arrival_id) AS arrival_id FROM {src} e
  WHERE NOT EXISTS (SELECT 1 FROM existing x WHERE x.source_stream_id = e.source_stream_id AND x.source_message_id = e.source_message_id)
  GROUP BY 1, 2)"""


def _docs(spark, sf):
    return spread(spark.read.parquet(f"{sf}/documents.parquet"))


def _messages(spark, sf):
    d = _docs(spark, sf)
    return d.select(
        F.col("doc_id").alias("arrival_id"), T.lookup(F.col("lang"), _KIND).alias("source_type"),
        F.col("source").alias("source_stream_id"), (F.col("doc_id") % 37).cast("string").alias("source_message_id"),
        F.col("text").alias("raw_text"),
        F.when(F.col("n_chars") % 50 != 0, F.timestamp_add("MINUTE", (F.col("doc_id") * 7).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))).alias("message_timestamp_utc"))


def _existing(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select(F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("source_stream_id"),
                    (F.col("page_id") % 37).cast("string").alias("source_message_id")).distinct()


@register("to_envelope", f"WITH {MESSAGES}, {ENVELOPES} SELECT arrival_id, source_type, source_stream_id, source_message_id FROM envelopes")
def to_envelope(spark, sf):
    return M.to_envelope(_messages(spark, sf)).select("arrival_id", "source_type", "source_stream_id", "source_message_id")


@register("ingest_status", f"WITH {MESSAGES}, {ENVELOPES}, {EXISTING}, {_FIRST.format(src='envelopes')} " + """
SELECT e.arrival_id, e.source_stream_id, e.source_message_id,
  CASE WHEN f.arrival_id IS NULL THEN 'duplicate' ELSE 'created' END AS status
FROM envelopes e LEFT JOIN firsts f ON f.arrival_id = e.arrival_id""")
def ingest_status(spark, sf):
    return M.ingest(M.to_envelope(_messages(spark, sf)), _existing(spark, sf))[1]


@register("ingest_new_rows", f"WITH {MESSAGES}, {ENVELOPES}, {EXISTING}, {_FIRST.format(src='envelopes')} " + """
SELECT e.arrival_id, e.source_type, length(e.raw_text) AS n FROM envelopes e JOIN firsts f USING (arrival_id)""")
def ingest_new_rows(spark, sf):
    rows = M.ingest(M.to_envelope(_messages(spark, sf)), _existing(spark, sf))[0]
    return rows.select("arrival_id", "source_type", F.length("raw_text").cast("long").alias("n"))


@register("backfill_counts", f"WITH {MESSAGES}, dated AS (SELECT * FROM messages WHERE message_timestamp_utc IS NOT NULL), {EXISTING}, "
          f"{_FIRST.format(src='dated')} " + """
SELECT CASE WHEN m.message_timestamp_utc IS NULL THEN 'failed' WHEN f.arrival_id IS NULL THEN 'duplicate' ELSE 'created' END AS status,
  count(*) AS n_messages FROM messages m LEFT JOIN firsts f ON f.arrival_id = m.arrival_id GROUP BY 1""")
def backfill_counts(spark, sf):
    return M.backfill(_messages(spark, sf), _existing(spark, sf), "arrival_id")[1]


_QUERY = "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang ORDER BY n DESC, source, lang"


@register("capped_sql", f"SELECT * FROM ({_QUERY} LIMIT 40)")
def capped_sql(spark, sf):
    _docs(spark, sf).createOrReplaceTempView("documents")
    return adhoc.capped_sql(spark, _QUERY, 40)[0]


@register("capped_sql_report", f"SELECT least(count(*), 40) AS row_count, count(*) > 40 AS truncated FROM (SELECT * FROM ({_QUERY}) LIMIT 41)")
def capped_sql_report(spark, sf):
    _docs(spark, sf).createOrReplaceTempView("documents")
    return adhoc.capped_sql(spark, _QUERY, 40)[1]


@register("merge_artifacts", """WITH RECURSIVE new AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id + 1000000 AS artifact_id, CASE WHEN doc_id % 10 <> 0 THEN sha256(source || '|' || n_chars // 1000) END AS i, sha256(text) AS c FROM documents),
stored AS (SELECT min(doc_id) AS artifact_id, CASE WHEN min(l.quality) = 1 THEN sha256(min(d.source || '|' || n_chars)) END AS input_hash, sha256(text) AS canonical_hash
  FROM documents d JOIN labels l USING (doc_id) GROUP BY text),
run AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS artifact_id, NULL::VARCHAR AS i, NULL::VARCHAR AS c, 'start' AS act, (SELECT list(input_hash) FILTER (input_hash IS NOT NULL) FROM stored) AS inputs,
    (SELECT list(canonical_hash) FROM stored) AS texts, (SELECT list(canonical_hash) FILTER (input_hash IS NULL) FROM stored) AS bare
  UNION ALL SELECT rn, artifact_id, i, c, act, CASE WHEN act <> 'reuse' AND i IS NOT NULL THEN list_append(inputs, i) ELSE inputs END, CASE WHEN act = 'insert' THEN list_append(texts, c) ELSE texts END,
    CASE WHEN act = 'fill' THEN list_filter(bare, lambda x: x <> c) WHEN act = 'insert' AND i IS NULL THEN list_append(bare, c) ELSE bare END FROM (
    SELECT n.*, inputs, texts, bare, CASE WHEN i2 IS NOT NULL AND list_contains(inputs, i2) THEN 'reuse' WHEN NOT list_contains(texts, c2) THEN 'insert' WHEN i2 IS NOT NULL AND list_contains(bare, c2) THEN 'fill' ELSE 'reuse' END AS act
    FROM (SELECT r.rn AS at, r.inputs, r.texts, coalesce(r.bare, []) AS bare FROM run r) r JOIN (SELECT *, i AS i2, c AS c2 FROM new) n ON n.rn = r.at + 1) z),
al AS (SELECT artifact_id, input_hash, canonical_hash, 'stored' AS origin FROM stored UNION ALL SELECT artifact_id, i, c, 'inserted' FROM run WHERE act = 'insert')
SELECT artifact_id, coalesce(input_hash, f.i) AS input_hash, canonical_hash, origin FROM al LEFT JOIN (SELECT c, i FROM run WHERE act = 'fill') f ON f.c = al.canonical_hash""")
def merge_artifacts(spark, sf):
    d = _docs(spark, sf)
    ident = F.concat_ws("|", "source", F.col("n_chars").cast("string"))
    shared = F.sha2(F.concat_ws("|", "source", F.floor(F.col("n_chars") / 1000).cast("string")), 256)  # inputs repeat with other texts
    new = d.select((F.col("doc_id") + 1_000_000).alias("artifact_id"), F.when(F.col("doc_id") % 10 != 0, shared).alias("input_hash"), F.sha2("text", 256).alias("canonical_hash"))
    stored = d.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy(F.sha2("text", 256).alias("canonical_hash")).agg(
        F.min("doc_id").alias("artifact_id"), F.when(F.min("quality") == 1, F.sha2(F.min(ident), 256)).alias("input_hash"))
    return M.merge_artifacts(new, stored.select("artifact_id", "input_hash", "canonical_hash"))


@register("due_publications", """SELECT d.doc_id AS artifact_id, destination FROM documents d CROSS JOIN (VALUES ('vip_telegram'), ('x')) v(destination)
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND CASE WHEN l.toxic = 0 THEN 'vip_telegram' ELSE 'x' END = destination)""")
def due_publications(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ledger = labels.select(F.col("doc_id").alias("artifact_id"), F.when(F.col("toxic") == 0, "vip_telegram").otherwise("x").alias("destination"),
                           F.when(F.col("quality") == 1, "published").otherwise("failed").alias("status"))
    return M.due_publications(_docs(spark, sf).select(F.col("doc_id").alias("artifact_id")), ledger, ["vip_telegram", "x"])


@register("eligible_messages", """WITH state AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'completed' ELSE 'in_progress' END AS status,
  TIMESTAMP '2024-01-01' + doc_id * INTERVAL '9' MINUTE AS lease FROM labels)
SELECT d.doc_id AS raw_message_id, s.status FROM documents d LEFT JOIN state s USING (doc_id)
WHERE s.status IS NULL OR s.status IN ('pending', 'failed') OR (s.status = 'in_progress' AND s.lease <= TIMESTAMP '2024-01-04')
ORDER BY n_chars DESC, d.doc_id DESC LIMIT 50""")
def eligible_messages(spark, sf):
    origin = F.lit("2024-01-01").cast("timestamp_ntz")
    state = spark.read.parquet(f"{sf}/labels.parquet").select(
        F.col("doc_id").alias("raw_message_id"),
        F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "completed").otherwise("in_progress").alias("status"),
        F.timestamp_add("MINUTE", (F.col("doc_id") * 9).cast("int"), origin).alias("lease_expires_at"))
    raw = _docs(spark, sf).select(F.col("doc_id").alias("raw_message_id"), F.col("n_chars").alias("message_timestamp_utc"))
    return M.eligible(raw, state, F.lit("2024-01-04").cast("timestamp_ntz"), 50).select("raw_message_id", "status")


@register("normalize_text", r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  trim(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g')),
  '^(?:(?:\*+\s*)?(?:⚠️|🚨|BREAKING:?|ALERT:?|URGENT:?|\[BREAKING\])\s*)+', '', 'i'),
  '^[A-Z][A-Z .''-]{1,40}\s*\((?:AP|REUTERS|AFP|BLOOMBERG)\)\s*[—:-]\s*', '', 'i'),
  '\s*[-–—]\s*(?:AP|REUTERS|AFP|AXIOS|BLOOMBERG)\s*$', '', 'i'),
  '(!)!+|(\?)\?+|(\.)\.+|(,),+|(:):+|(;);+', '\1\2\3\4\5\6', 'g'), '\s+', ' ', 'g'))) AS text_hash FROM documents""")
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(T.normalize_message(F.col("text")), 256).alias("text_hash"))


@register("content_keys", f"""SELECT doc_id AS raw_message_id, sha256(text) AS text_hash,
  sha256('raw_message_id=' || doc_id || '|normalized_text_hash=' || sha256(text) || '|extractor_name=rules|prompt_version=p1|schema_version=1|canonicalizer_version={V.CANONICALISER_VERSION}') AS replay_key
FROM documents""")
def content_keys(spark, sf):
    d = _docs(spark, sf).select(F.col("doc_id").alias("raw_message_id"), F.col("text").alias("normalized_text"))
    return M.content_keys(d, "rules", "p1").drop("normalized_text")


_TIMED = "c AS (SELECT doc_id, sha256(text) AS h, TIMESTAMP '2024-01-01' + doc_id * INTERVAL '30' SECOND AS t FROM documents)"


def _timed_claims(spark, sf):
    return _docs(spark, sf).select(
        F.col("doc_id").alias("claim_id"), F.sha2("text", 256).alias("text_hash"), F.lit("rules").alias("extractor_name"),
        F.lit("p1").alias("prompt_version"), F.lit(1).alias("schema_version"), F.lit("canon").alias("canonicaliser_version"),
        F.timestamp_add("SECOND", (F.col("doc_id") * 30).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"))


@register("reusable_claims", f"""WITH {_TIMED}
SELECT a.doc_id AS claim_id, (SELECT b.doc_id FROM c b WHERE b.h = a.h AND b.doc_id <> a.doc_id AND (b.t, b.doc_id) < (a.t, a.doc_id) AND b.t >= a.t - INTERVAL '6' HOUR
  ORDER BY b.t DESC, b.doc_id DESC LIMIT 1) AS reused_claim_id FROM c a""")
def reusable_claims(spark, sf):
    return M.reusable_claims(_timed_claims(spark, sf)).select("claim_id", "reused_claim_id")


@register("reuse_payloads", f"""WITH {_TIMED},
near AS (SELECT *, CASE WHEN lag(t) OVER w >= t - INTERVAL '72' HOUR THEN lag(doc_id) OVER w END AS prev FROM c WINDOW w AS (PARTITION BY h ORDER BY t, doc_id)),
runs AS (SELECT *, count(*) FILTER (prev IS NULL) OVER (PARTITION BY h ORDER BY t, doc_id) AS run FROM near)
SELECT doc_id AS claim_id, prev AS reused_claim_id, min(doc_id) OVER (PARTITION BY h, run) AS payload_claim_id, 'payload of ' || min(doc_id) OVER (PARTITION BY h, run) AS summary FROM runs""")
def reuse_payloads(spark, sf):
    """Every claim with the payload of the first claim of its run of equal texts."""
    claims = _timed_claims(spark, sf).withColumn("summary", F.concat(F.lit("payload of "), F.col("claim_id").cast("string")))
    return M.reuse_payloads(claims, ["summary"], 72).select("claim_id", "reused_claim_id", "payload_claim_id", "summary")


@register("text_preview", """SELECT doc_id, CASE WHEN length(text) > 320 THEN left(text, 317) || '...' ELSE text END AS preview, length(text) AS text_length FROM documents""")
def text_preview(spark, sf):
    return _docs(spark, sf).select("doc_id", T.preview(F.col("text")).alias("preview"), F.length("text").cast("long").alias("text_length"))


@register("extract_claims", rf"""WITH t AS (SELECT doc_id, text, source, lower(text) AS low,
  list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g'), '\b[A-Z]{{1,5}}\b')))[1:20] AS tickers FROM documents)
SELECT doc_id, {first_family("low", V.TOPIC_HINTS, "other")} AS topic, array_to_string(tickers, ',') AS tickers,
  CASE WHEN text = '' THEN 0.1 ELSE 0.4 END::DOUBLE AS confidence FROM t""")
def extract_claims(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", F.lit(None).cast("timestamp_ntz").alias("message_time"), F.col("source").alias("channel"))
    return M.extract_claims(d).select("doc_id", "topic", F.array_join("tickers", ",").alias("tickers"), "confidence")


@register("extract_claims_fields")
def extract_claims_fields(spark, sf):
    """All fields of the rule-based claim (numbers need look-behind, which the oracle engine lacks)."""
    d = _docs(spark, sf).select("doc_id", "text", F.lit(None).cast("timestamp_ntz").alias("message_time"), F.col("source").alias("channel"))
    return M.extract_claims(d).select("doc_id", "topic", "summary", "impact_score", "is_breaking", "breaking_window", "fingerprint",
                                      F.array_join("keywords", ",").alias("keywords"), F.size("market_stats").alias("n_stats"))
