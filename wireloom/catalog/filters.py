from . import register
from .base_sql import CLAIMS, RAW, with_
from ..sources import fixture as X
from pyspark.sql import functions as F

BASE = ("claim_id", "created_at", "event_time", "topic", "impact_score", "confidence", "is_breaking", "breaking_window",
        "summary", "source_claimed", "fingerprint", "identity", "claim_hash", "is_published")


@register("claim_view", with_(CLAIMS) + f"SELECT {', '.join(BASE)} FROM claims")
def claim_view(spark, sf):
    return X.claims(spark, sf).select(*BASE)


@register("raw_claim_view", with_(CLAIMS, RAW) + """
SELECT claim_id, array_to_string(countries, '|') AS countries, array_to_string(orgs, '|') AS orgs,
  array_to_string(people, '|') AS people, array_to_string(tickers, '|') AS tickers,
  array_to_string(keywords, '|') AS keywords, len(tags) AS n_tags, len(relations) AS n_relations,
  array_to_string(list_transform(tags, lambda t: t.tag_type || '=' || t.tag_value || '=' || t.tag_source), '|') AS tags,
  array_to_string(severity, '|') AS severity, event_type_raw, direction_raw FROM raw_claims""")
def raw_claim_view(spark, sf):
    j = lambda c: F.array_join(c, "|").alias(c)
    return X.raw_claims(spark, sf).select(
        "claim_id", j("countries"), j("orgs"), j("people"), j("tickers"), j("keywords"),
        F.size("tags").alias("n_tags"), F.size("relations").alias("n_relations"),
        F.array_join(F.transform("tags", lambda t: F.concat_ws("=", t["tag_type"], t["tag_value"], t["tag_source"])), "|").alias("tags"),
        F.array_join("cues.severity", "|").alias("severity"), "event_type_raw", "direction_raw")


from ..operators import filters as P, search as Q  # noqa: E402
from ..operators.asof import micros  # noqa: E402
from ..functions import text as T, vocab as V  # noqa: E402
from .base_sql import CANDIDATES, EVENTS, EVENT_RELATIONS, EVENT_TAGS, LINKS, in_list, sql_list  # noqa: E402

S0, S1 = "2024-01-10 00:00:00", "2024-01-12 00:00:00"
_T = lambda s: f"TIMESTAMP '{s}'"


@register("in_window", with_(CLAIMS) + f"SELECT claim_id FROM claims WHERE last_updated_at >= {_T(S0)} AND last_updated_at < {_T(S1)}")
def in_window(spark, sf):
    return P.in_window(X.claims(spark, sf), "last_updated_at", P.ts(S0), P.ts(S1)).select("claim_id")


@register("in_event_window", with_(CLAIMS) + f"""SELECT claim_id, event_time FROM claims WHERE (event_time IS NOT NULL AND event_time >= {_T(S0)} AND event_time < {_T(S1)})
  OR (event_time IS NULL AND last_updated_at >= {_T(S0)} AND last_updated_at < {_T(S1)})""")
def in_event_window(spark, sf):
    return P.in_event_window(X.claims(spark, sf), P.ts(S0), P.ts(S1)).select("claim_id", "event_time")


@register("event_base", with_(CLAIMS) + f"SELECT claim_id FROM claims WHERE event_time BETWEEN {_T(S0)} AND {_T(S1)} AND impact_score >= 40")
def event_base(spark, sf):
    return P.event_base(X.claims(spark, sf), P.ts(S0), P.ts(S1), 40.0).select("claim_id")


@register("min_impact_unpublished", with_(CLAIMS) + "SELECT claim_id FROM claims WHERE impact_score > 35 AND (is_published IS NULL OR NOT is_published)")
def min_impact_unpublished(spark, sf):
    return P.unpublished(P.min_impact_exclusive(X.claims(spark, sf)), "vip_telegram").select("claim_id")


@register("assign_windows", with_(CLAIMS) + """SELECT window_start, window_start + INTERVAL '1' DAY AS window_end, count(*) AS n FROM (
  SELECT time_bucket(INTERVAL '6' HOUR, created_at) - k * INTERVAL '6' HOUR AS window_start FROM claims, range(4) r(k)) GROUP BY ALL""")
def assign_windows(spark, sf):
    w = P.assign_windows(X.claims(spark, sf).select("created_at"), "created_at", "1 day", "6 hours")
    return w.groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("n"))


@register("feed_rows", with_(CLAIMS, EVENTS) + f"SELECT event_id FROM evs WHERE event_time IS NOT NULL AND topic IN {in_list(V.TOPICS)} AND length(trim(summary)) > 0 AND topic = 'rates'")
def feed_rows(spark, sf):
    return P.feed_rows(X.events(spark, sf), "rates").select("event_id")


@register("after_key", with_(CLAIMS, EVENTS) + f"SELECT event_id FROM evs WHERE event_time < {_T(S0)} OR (event_time = {_T(S0)} AND event_id < 100)")
def after_key(spark, sf):
    return P.after(X.events(spark, sf), P.ts(S0), 100).select("event_id")


@register("entity_mentions", with_(CLAIMS) + f"SELECT claim_id AS raw_message_id, event_time FROM claims WHERE country = 'qatar' AND event_time BETWEEN {_T(S0)} AND {_T(S1)}")
def entity_mentions(spark, sf):
    m = X.claims(spark, sf).select(F.lit("country").alias("entity_type"), F.col("country").alias("entity_value"), F.col("claim_id").alias("raw_message_id"), "event_time")
    return P.entity_mentions(m, "country", "qatar", P.ts(S0), P.ts(S1)).select("raw_message_id", "event_time")
