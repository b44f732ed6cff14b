"""Claim rows derived from the provided ``events`` table.

The provided text hardly contains a rule word, so this view gives every rule
something to fire on. It is plain projection: one claim per event row, nested
fields included, at whatever size the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import vocab as V
from ..session import spread

# fixed values: fixture word lists
PHRASES = ("oil supply disruption widens", "lng terminal outage extends", "policy rate hike surprise",
           "pipeline shutdown halts flows", "missile strike reported", "police injured in city incident",
           "fertilizer cost jump", "freight route repricing", "export ban on wheat", "power grid storm damage",
           "bank failure fears", "sanctions expanded", "ceasefire talks resume", "inventory draw deepens",
           "demand growth slows", "carbon allowance price spike", "gas storage builds", "crude output expands",
           "warns of retaliation", "gdp surprise upside", "capacity curtailment at ammonia plant",
           "port transit resumes", "analyst opinion on yields", "credit spread widens")
COUNTRIES = ("us", "United Kingdom", "u.k.", "qatar", "Iran")
ORGS = ("OPEC", "ECB", "central bank of x", "Amazon", "NATO", "Terminal Operator", "unknown", "ACME HOLDINGS")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar claim columns."""
    e = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value"))
    i, u = F.col("event_id"), F.col("user_id")
    base = e.select(
        i.alias("claim_id"), F.col("ts").alias("created_at"), F.col("ts").alias("last_updated_at"), u.alias("user_id"),
        F.when(i % 17 != 0, F.col("ts") - F.make_dt_interval(F.lit(0), (i % 5).cast("int"))).alias("event_time"),
        _pick(V.TOPICS, F.floor(i / 6) % 12).alias("topic"),
        F.when(i % 29 != 0, F.least(F.lit(100.0), F.col("value"))).alias("impact_score"),
        ((i % 10) / 10.0).alias("confidence"),
        (i % 6 == 0).alias("is_breaking"),
        F.when(i % 6 != 0, "none").otherwise(_pick(("15m", "1h", "4h"), u % 3)).alias("breaking_window"),
        _pick(PHRASES, u % 24).alias("phrase"), _pick(COUNTRIES, u % 5).alias("country"),
        _pick(ORGS, i % 8).alias("org"),
        F.concat(F.lit("wire "), (u % 7).cast("string")).alias("source_claimed"),
        F.concat(F.lit("fp-"), (u % 60).cast("string")).alias("fingerprint"),
        F.when(i % 3 != 0, F.concat(F.lit("c-"), (i % 701).cast("string"))).alias("claim_hash"),
        F.when(i % 11 == 0, True).when(i % 11 == 1, F.lit(None).cast("boolean")).otherwise(False).alias("is_published"),
    )
    return base.withColumn(
        "summary",
        F.concat("phrase", F.lit(" in "), "country", F.when(F.col("claim_id") % 4 == 0, ", 3% move").otherwise("")),
    ).withColumn("identity", F.concat_ws("|", "fingerprint", "topic", F.date_format("created_at", "yyyy-MM-dd")))


def _tag(family, value, source, confidence=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(family).alias("tag_type"), as_col(value).alias("tag_value"), as_col(source).alias("tag_source"),
                    F.lit(confidence).cast("double").alias("confidence"))


def _relation(st, sv, rt, ot, ov, source, confidence=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(st).alias("subject_type"), as_col(sv).alias("subject_value"),
                    as_col(rt).alias("relation_type"), as_col(ot).alias("object_type"), as_col(ov).alias("object_value"),
                    as_col(source).alias("relation_source"), F.lit(confidence).cast("double").alias("confidence"))


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with nested fields as a model would emit them: aliases, blanks, bad items, duplicates."""
    i = F.col("claim_id")
    some = lambda *items: F.array_compact(F.array(*items))
    word = F.split("phrase", " ")[0]
    stat = F.struct(F.lit("move").alias("label"), F.lit(3.0).alias("value"), F.lit("%").alias("unit"),
                    F.lit(None).cast("string").alias("context"))
    none = F.array().cast("array<string>")
    return claims(spark, sf_dir).select(
        "*",
        some(F.col("country"), F.when(i % 7 == 0, " uae "), F.when(i % 9 == 0, "QATAR")).alias("countries"),
        some(F.col("org"), F.when(i % 10 == 0, "opec "), F.when(i % 13 == 0, "MINISTRY OF ENERGY")).alias("orgs"),
        some(F.when(i % 12 == 0, "JOHN  SMITH")).alias("people"),
        some(F.when(i % 5 == 0, "xom "), F.when(i % 5 == 0, "BP.L"), F.when(i % 10 == 0, "XOM")).alias("tickers"),
        some(F.when(i % 7 == 0, "uae")).alias("affected_countries"),
        F.split("phrase", " ").alias("keywords"),
        F.when(i % 4 == 0, F.array(stat)).otherwise(F.array().cast(
            "array<struct<label:string,value:double,unit:string,context:string>>")).alias("market_stats"),
        some(
            _tag("commodities", word, "observed", 0.7),
            F.when(i % 4 == 0, _tag("Event-Mechanism", "SUPPLY SHOCK", "Inferred", 1.5)),
            F.when(i % 6 == 0, _tag("directionality", "stress", "observed")),
            F.when(i % 10 == 0, _tag("bogus", "x", "observed")),
            F.when(i % 15 == 0, _tag("strategic", "Energy Security", "observed", 0.9)),
            F.when(i % 20 == 0, _tag("commodity", F.upper(word), "observed")),
        ).alias("tags"),
        some(
            F.when(i % 3 == 0, _relation("country", F.col("country"), "curtails", "commodity", word, "observed", 0.5)),
            F.when(i % 4 == 0, _relation("Org", F.col("org"), "supports", "sector", "shipping", "inferred")),
            F.when(i % 6 == 0, _relation("country", F.upper("country"), "curtails", "commodity", word, "observed")),
            F.when(i % 8 == 0, _relation("state", "texas", "expands-production-of", "commodity", "natural gas", "observed")),
            F.when(i % 12 == 0, _relation("sector", "grains", "input_to", "sector", "food", "observed")),
            F.when(i % 24 == 0, _relation("sector", "coal", "contradicts", "sector", "power", "inferred", 2.0)),
        ).alias("relations"),
        F.struct(
            F.when(i % 5 == 0, F.array(F.lit("b  cue"), F.lit("a cue"), F.lit("A CUE"))).otherwise(none).alias("severity"),
            F.when(i % 6 == 0, F.array(F.lit("x"))).otherwise(none).alias("economic"),
            F.when(i % 7 == 0, F.array(F.lit("y"), F.lit("z"))).otherwise(none).alias("propagation"),
            F.when(i % 8 == 0, F.array(F.lit("s"))).otherwise(none).alias("specificity"),
            F.when(i % 9 == 0, F.array(F.lit("n"))).otherwise(none).alias("novelty"),
            F.when(i % 30 == 0, F.array(F.lit("chokepoint"))).otherwise(none).alias("strategic"),
        ).alias("cues"),
        _pick(("Policy", "market", "bogus", None, "SPENDING"), i % 5).alias("event_type_raw"),
        _pick(("Stress", "easing", "bad", None), i % 4).alias("direction_raw"),
        F.lit(None).cast("string").alias("event_core"),
    )


EVENT_FIELDS = ("topic", "fingerprint", "summary", "impact_score", "confidence", "is_breaking", "breaking_window", "event_time",
                "claim_hash", "is_published", "country", "org", "phrase", "source_claimed")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per identity; the latest claim gives its fields, the smallest claim id is its id."""
    latest = F.max(F.struct("created_at", "claim_id", *EVENT_FIELDS)).alias("x")
    return (
        claims(spark, sf_dir).groupBy("identity").agg(F.min("claim_id").alias("event_id"), latest)
        .select("event_id", "identity", F.col("x.created_at").alias("last_updated_at"), F.col("x.claim_id").alias("latest_claim_id"),
                *[F.col(f"x.{c}").alias(c) for c in EVENT_FIELDS])
        .withColumn("payload_hash", F.concat(F.lit("p-"), F.sha2("summary", 256)))
        .withColumn("time_bucket", F.coalesce(F.date_format("event_time", "yyyy-MM-dd"), F.lit("unknown")))
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, raw_message_id, linked_at): every claim belongs to the event of its identity."""
    c = claims(spark, sf_dir).select("identity", F.col("claim_id").alias("raw_message_id"), F.col("created_at").alias("linked_at"))
    return c.join(events(spark, sf_dir).select("identity", "event_id"), "identity").drop("identity")


def event_tags(ev: DataFrame) -> DataFrame:
    i = F.col("event_id")
    tag = lambda family, value: F.struct(F.lit(family).alias("tag_type"), value.alias("tag_value"))
    return ev.select("event_id", F.explode(F.array(
        tag("commodities", F.split("phrase", " ")[0]), tag("countries", F.initcap("country")),
        tag("directionality", _pick(V.DIRECTIONS, i % 3)))).alias("t")).select(
        "event_id", "t.*", F.lit("observed").alias("tag_source"), F.lit(0.7).alias("confidence"))


def event_relations(ev: DataFrame) -> DataFrame:
    return ev.filter("latest_claim_id % 3 = 0").select(
        "event_id", F.lit("country").alias("subject_type"), F.col("country").alias("subject_value"),
        _pick(("curtails", "supports", "contradicts"), F.col("event_id") % 3).alias("relation_type"), F.lit("commodity").alias("object_type"),
        F.split("phrase", " ")[0].alias("object_value"), F.lit("observed").alias("relation_source"))


def candidates(ev: DataFrame) -> DataFrame:
    """Enrichment candidates of the events that have a score."""
    s = F.col("impact_score")
    return ev.filter(s.isNotNull()).select(
        "event_id", F.when(s >= 80, "deep_enrich").when(s >= 45, "index_only").otherwise("store_only").alias("route"),
        (s >= 60).alias("selected"), s.alias("calibrated_score"), F.col("last_updated_at").alias("scored_at"), F.col("fingerprint").alias("cluster_key"))
