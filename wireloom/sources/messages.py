"""Reading source payloads, idempotent ingest, history backfill, text keys and the rule-based claim builder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X, vocab as V
from ..session import cut_lineage
from ..operators.asof import HOUR, PARTS, latest_per_key, micros, next_from, previous_within

PAYLOAD = T.StructType([
    T.StructField("source_type", T.StringType()), T.StructField("source_stream_id", T.StringType()),
    T.StructField("source_stream_name", T.StringType()), T.StructField("source_message_id", T.StringType()),
    T.StructField("message_timestamp_utc", T.TimestampNTZType()), T.StructField("raw_text", T.StringType()),
    T.StructField("raw_entities", T.StringType()), T.StructField("forwarded_from", T.StringType()),
])
KEY = ["source_stream_id", "source_message_id"]
REUSE_KEYS = ["text_hash", "extractor_name", "prompt_version", "schema_version", "canonicaliser_version"]
SALTS = 16  # parts into which the claims that take one payload are dealt


def read_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Source payloads with the declared schema; nothing is inferred."""
    return spark.read.schema(PAYLOAD).format(fmt).load(path)


def to_envelope(df: DataFrame) -> DataFrame:
    """One envelope for every source: the stream id is prefixed by its type unless the type is empty or telegram."""
    kind = F.lower(X.strip(F.coalesce("source_type", F.lit(""))))
    return df.withColumn(
        "source_stream_id",
        F.when((kind != "") & (kind != "telegram"), F.concat(kind, F.lit(":"), "source_stream_id")).otherwise(F.col("source_stream_id")),
    ).withColumn("source_type", F.when(kind != "", kind).otherwise(F.col("source_type")))


def ingest(batch: DataFrame, existing: DataFrame, arrival: str = "arrival_id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, status per arrival). First arrival of an unknown key is created, all others are duplicates.

    ``arrival`` is unique and grows with arrival order. The winner per key is a partial minimum, and the status joins
    back on the arrival id, so a key that repeats a billion times never meets in one task.
    """
    first = batch.groupBy(*KEY).agg(F.min(arrival).alias(arrival)).join(existing.select(*KEY), KEY, "left_anti").select(arrival)
    fresh = batch.join(first, arrival, "left_semi")
    status = batch.select(arrival, *KEY).join(first.withColumn("_c", F.lit(True)), arrival, "left").select(
        arrival, *KEY, F.when(F.col("_c"), "created").otherwise("duplicate").alias("status"))
    return fresh, status


def backfill(history: DataFrame, existing: DataFrame, order: str = "message_no") -> tuple[DataFrame, DataFrame]:
    """History load in message order: rows without a date fail, the rest go through :func:`ingest`."""
    dated = history.filter(F.col("message_timestamp_utc").isNotNull())
    fresh, status = ingest(dated, existing, order)
    failed = history.filter(F.col("message_timestamp_utc").isNull()).select(F.lit("failed").alias("status"))
    counts = status.select("status").unionByName(failed).groupBy("status").agg(F.count(F.lit(1)).alias("n_messages"))
    return fresh, counts


def content_keys(df: DataFrame, extractor: str, prompt: str, schema_version: int = 1) -> DataFrame:
    """Text hash and replay key of each message (columns ``raw_message_id``, ``normalized_text``)."""
    text_hash = F.sha2(F.col("normalized_text"), 256)
    key = F.concat_ws(
        "|",
        F.concat(F.lit("raw_message_id="), F.col("raw_message_id").cast("string")),
        F.concat(F.lit("normalized_text_hash="), text_hash),
        F.lit(f"extractor_name={extractor}"), F.lit(f"prompt_version={prompt}"),
        F.lit(f"schema_version={schema_version}"), F.lit(f"canonicalizer_version={V.CANONICALISER_VERSION}"))
    return df.withColumn("text_hash", text_hash).withColumn("replay_key", F.sha2(key, 256))


def reusable_claims(claims: DataFrame, hours: int = 6) -> DataFrame:
    """Earlier claim that can be reused: equal text hash and versions, at most ``hours`` before, the latest one."""
    timed = claims.withColumn("_us", micros("created_at"))
    out = previous_within(timed, REUSE_KEYS, "_us", "claim_id", hours * HOUR, [])
    return out.withColumn("reused_claim_id", F.col("prev.tie")).drop("prev", "_us")


def reuse_payloads(claims: DataFrame, payload: list[str], hours: int = 6) -> DataFrame:
    """Claims whose ``payload`` columns come from the claim they reuse; adds ``reused_claim_id`` and ``payload_claim_id``.

    A reused claim may itself reuse an earlier one, so a payload is that of the first claim of a run: claims of equal keys, each at most
    ``hours`` after the one before. The first of a run is the last claim without a predecessor, looked up by time slices, so a text that a
    third of all claims repeats is sorted by many tasks; its payload goes out to ``SALTS`` parts of them. Claims with a null key reuse nothing.
    """
    known = F.lit(True)
    for key in REUSE_KEYS:
        known = known & F.col(key).isNotNull()
    linked = cut_lineage(reusable_claims(claims.filter(known).select("claim_id", "created_at", *REUSE_KEYS), hours).withColumn("_back", -micros("created_at")))
    starts, later = linked.filter("reused_claim_id IS NULL"), linked.filter("reused_claim_id IS NOT NULL")
    found = next_from(later.select(*REUSE_KEYS, "claim_id", "reused_claim_id", "_back"), starts, REUSE_KEYS, "_back", "_back", "claim_id", max(hours * HOUR // PARTS, 1))
    links = cut_lineage(found.select("claim_id", "reused_claim_id", F.col("next.tie").alias("payload_claim_id")))
    rows = claims.join(links, "claim_id", "left").withColumns({
        "payload_claim_id": F.coalesce("payload_claim_id", F.col("claim_id").cast("long")), "_salt": F.pmod(F.col("claim_id").cast("long"), F.lit(SALTS))})
    roots = claims.select(F.col("claim_id").cast("long").alias("payload_claim_id"), F.struct(*payload).alias("_root")).join(links.select("payload_claim_id").distinct(), "payload_claim_id", "left_semi")
    roots = roots.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    taken = F.col("reused_claim_id").isNotNull()
    out = rows.join(roots, ["payload_claim_id", "_salt"], "left")
    return out.withColumns({c: F.when(taken, F.col("_root")[c]).otherwise(F.col(c)) for c in payload}).select(*claims.columns, "reused_claim_id", "payload_claim_id")


def extract_claims(messages: DataFrame) -> DataFrame:
    """Deterministic claim builder over ``text``, ``message_time`` and ``channel`` (any column may be null)."""
    text, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    num = V.NUMBER_PATTERN
    df = messages.withColumns({
        "topic": X.first_family(low, V.TOPIC_HINTS, "other"),
        "tickers": F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(V.TICKER_PATTERN), F.lit(0)))), 1, 20),
        "numbers": F.transform(F.regexp_extract_all(text, F.lit(num), F.lit(0)), lambda x: F.replace(F.lower(x), F.lit(" "), F.lit(""))),
    })
    head = X.strip(F.substring(text, 1, 240))
    summary = F.when(F.length(text) > 240, F.concat(F.regexp_replace(head, r"\.+$", ""), F.lit("…"))).otherwise(head)
    channel = F.col("channel")
    impact = F.least(F.lit(100.0), (F.size("numbers") * 8 + F.size("tickers") * 3).cast("double"))
    stats = F.transform(F.slice("numbers", 1, 3), lambda n: F.struct(
        F.lit("reported").alias("label"), F.regexp_extract(n, num, 1).cast("double").alias("value"),
        F.when(F.regexp_extract(n, num, 2) == "", "value").otherwise(F.regexp_extract(n, num, 2)).alias("unit"),
        F.lit(None).cast("string").alias("context")))
    named = F.when(F.coalesce(channel, F.lit("")) != "", F.array(channel)).otherwise(F.array().cast("array<string>"))
    return df.withColumns({
        "keywords": F.concat(named, F.slice("tickers", 1, 10), F.slice("numbers", 1, 10)),
        "summary": F.when(summary == "", "No text content.").otherwise(summary),
        "event_time": F.col("message_time"),
        "market_stats": stats,
        "impact_score": impact,
        "confidence": F.when(text != "", 0.4).otherwise(0.1),
        "is_breaking": impact >= 60.0,
        "breaking_window": F.when(impact >= 60.0, "1h").otherwise("none"),
        "fingerprint": F.substring(F.sha2(F.concat_ws(
            "|", "topic", F.lower(F.coalesce(channel, F.lit(""))), F.lower(F.array_join("tickers", ",")),
            F.array_join("numbers", ",")), 256), 1, 48),
    })


def eligible(raw: DataFrame, state: DataFrame, as_of, n: int) -> DataFrame:
    """Messages due for work: no state, pending or failed, or a lease that ran out; newest first, at most n."""
    joined = raw.join(state, "raw_message_id", "left")
    due = (
        F.col("status").isNull() | F.col("status").isin("pending", "failed")
        | ((F.col("status") == "in_progress") & (F.col("lease_expires_at") <= as_of))
    )
    return joined.filter(due).orderBy(F.desc("message_timestamp_utc"), F.desc("raw_message_id")).limit(n)


def merge_artifacts(new: DataFrame, existing: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Artifact table after a batch, as if its rows came one by one in id order.

    A row whose input hash is known returns that artifact. Otherwise a row whose text is known returns the artifact of the text, and fills its
    input hash if that is missing. Anything else is inserted. A missing (null or empty) input hash is never known.
    Columns: artifact_id, input_hash, canonical_hash, origin.

    Each round decides all rows that come first both for their text and for their input; rows that meet something known need no turn. So the
    rounds follow the longest chain of rows that hinge on each other, not the number of rows.
    """
    inp = F.when(F.col("input_hash") != "", F.col("input_hash")).alias("input_hash")
    stored = existing.select("artifact_id", inp, "canonical_hash")
    open_rows = cut_lineage(new.select("artifact_id", inp, "canonical_hash"))
    inputs = stored.filter("input_hash is not null").select("input_hash").distinct()
    texts = stored.groupBy("canonical_hash").agg(F.max(F.col("input_hash").isNotNull()).alias("full"))
    inserted = open_rows.limit(0)
    fills = open_rows.limit(0).select("canonical_hash", F.col("input_hash").alias("fill"))
    for _ in range(max_rounds):
        rest = open_rows.join(inputs, "input_hash", "left_anti").select("artifact_id", "input_hash", "canonical_hash").join(texts, "canonical_hash", "left")
        rest = cut_lineage(rest.filter("full is null or (not full and input_hash is not null)"))
        if rest.isEmpty():
            break
        by_text = rest.groupBy("canonical_hash").agg(F.min("artifact_id").alias("t"))
        by_input = rest.filter("input_hash is not null").groupBy("input_hash").agg(F.min("artifact_id").alias("i"))
        ranked = rest.join(by_text, "canonical_hash").join(by_input, "input_hash", "left")
        first = (F.col("artifact_id") == F.col("t")) & (F.col("i").isNull() | (F.col("artifact_id") == F.col("i")))
        ranked = cut_lineage(ranked.select("artifact_id", "input_hash", "canonical_hash", "full", first.alias("now")))
        now = ranked.filter("now")
        inserted = inserted.unionByName(now.filter("full is null").select("artifact_id", "input_hash", "canonical_hash"))
        fills = fills.unionByName(now.filter("full is not null").select("canonical_hash", F.col("input_hash").alias("fill")))
        inputs = cut_lineage(inputs.unionByName(now.filter("input_hash is not null").select("input_hash")).distinct())
        told = now.select("canonical_hash", F.col("input_hash").isNotNull().alias("full"))
        texts = cut_lineage(texts.unionByName(told).groupBy("canonical_hash").agg(F.max("full").alias("full")))
        open_rows = ranked.filter("not now").select("artifact_id", "input_hash", "canonical_hash")
    else:
        raise RuntimeError(f"artifacts did not settle in {max_rounds} rounds")
    both = stored.withColumn("origin", F.lit("stored")).unionByName(inserted.withColumn("origin", F.lit("inserted")))
    return both.join(fills, "canonical_hash", "left").select("artifact_id", F.coalesce("input_hash", "fill").alias("input_hash"), "canonical_hash", "origin")


def due_publications(artifacts: DataFrame, ledger: DataFrame, destinations: list[str]) -> DataFrame:
    """(artifact, destination) rows still to publish; any ledger status but published is due again."""
    wanted = artifacts.select("artifact_id", F.explode(X.lit_array(destinations)).alias("destination"))
    done = ledger.filter("status = 'published'").select("artifact_id", "destination")
    return wanted.join(done, ["artifact_id", "destination"], "left_anti")
