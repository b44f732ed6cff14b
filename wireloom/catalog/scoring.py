"""Calibration, distribution, relatedness, triage and routing queries."""

from pyspark.sql import functions as F

from . import register
from .base_sql import CLAIMS, RAW, any_of, case_map, entity_sig, in_list, q, with_
from ..functions import text as T, vocab as V
from ..operators import scoring as S, triage as R
from ..operators.asof import HOUR, micros, previous_within
from ..sources import fixture as X

LOCAL = (f"({any_of('norm', V.LOCAL_AUTHORITY_WORDS)} AND {any_of('norm', V.LOCAL_HARM_WORDS)} AND (regexp_matches(summary, '\\b[A-Z][a-z]+,\\s*[A-Z]{{2}}\\b') "
         f"OR {any_of('norm', V.LOCAL_AREA_WORDS)} OR contains(norm, 'police')) AND NOT {any_of('norm', V.CONFLICT_PLACES)})").replace("{{2}}", "{2}")
_PCT = "regexp_matches(norm, '\\b\\d+(\\.\\d+)?\\s*(%|bp|bps)\\b')"
SHOCK_LIST = "list_filter([" + ", ".join(f"CASE WHEN {any_of('norm', w)} THEN {q(n)} END" for n, w in sorted(V.SHOCKS)) + "], lambda s: s IS NOT NULL)"
DIMS = f"""dims AS (SELECT *, CASE WHEN local_incident THEN 5 ELSE {case_map('topic', V.TOPIC_RELEVANCE, '8')} END AS market_relevance,
  least(30, 4 * n_stats + 6 * {_PCT}::INT + 8 * {any_of('norm', V.MAGNITUDE_WORDS)}::INT
    + 4 * (CASE WHEN len(affected_countries) > 0 THEN len(affected_countries) ELSE len(countries) END >= 2)::INT) AS magnitude,
  least(25, 10 * trans::INT + 8 * n_stats + 4 * (len(tickers) > 0)::INT + 5 * (topic IN {in_list(V.TRANSMISSION_TOPICS)})::INT) AS transmission,
  {case_map('breaking_window', V.URGENCY, '1')} + CASE WHEN is_breaking AND breaking_window = 'none' THEN 2 ELSE 0 END AS urgency
  FROM (SELECT *, {LOCAL} AS local_incident, {SHOCK_LIST} AS shocks, {any_of('norm', V.TRANSMISSION_WORDS)} AS trans
    FROM (SELECT *, lower(summary || ' ' || source_claimed || ' ' || array_to_string(keywords, ' ')) AS norm FROM raw_claims) a) b)"""
COMPS = f"""comps AS (SELECT *, least(25, magnitude + 6 * (len(shocks) > 0)::INT + least(6, 2 * len(severity))) AS c_sev,
  least(20, CAST(round_even(market_relevance * 0.6, 0) AS INT) + least(6, 2 * len(economic))) AS c_eco,
  least(20, CAST(round_even(transmission * 0.6, 0) AS INT) + least(6, 2 * len(propagation))) AS c_pro,
  least(15, 2 * n_stats + least(3, len(tickers)) + 3 * (len(keywords) >= 3)::INT + 2 * (event_time IS NOT NULL)::INT + 2 * {_PCT}::INT + least(4, 2 * len(specificity))) AS c_spe,
  least(10, 4 * is_breaking::INT + 2 * (breaking_window IN ('15m', '1h'))::INT + (event_time IS NOT NULL)::INT + 2 * (len(shocks) > 0)::INT + least(4, 2 * len(novelty))) AS c_nov,
  least(10, least(8, 3 * len(hits)) + 2 * (topic IN {in_list(V.STRATEGIC_TOPICS)})::INT) AS c_str
  FROM (SELECT *, list_distinct(list_transform(list_filter(tags, lambda t: t.tag_type = 'strategic'), lambda t: lower(t.tag_value)) || strategic) AS hits FROM dims) d)"""
CALIB = """calib AS (SELECT *, CASE WHEN local_incident THEN 'store_only' WHEN calibrated_score >= 80 OR c_str >= 8 OR len(hits) >= 2 THEN 'deep_enrich'
    WHEN calibrated_score >= 45 THEN 'index_only' ELSE 'store_only' END AS route FROM (
  SELECT *, round_even(greatest(0.0, least(100.0, least(pre, cap))), 0)::DOUBLE AS calibrated_score FROM (
    SELECT *, c_sev + c_eco + c_pro + c_spe + c_nov + c_str + urgency * 0.4 + 8 * (len(shocks) > 0 AND met AND magnitude >= 12)::INT
        + 4 * (len(shocks) >= 2)::INT + 3 * (breaking_window IN ('15m', '1h') AND len(shocks) > 0)::INT AS pre,
      least(CASE WHEN local_incident THEN 40 ELSE 100 END, CASE WHEN market_relevance < 12 AND n_stats = 0 AND len(tickers) = 0 THEN 45 ELSE 100 END,
        CASE WHEN transmission < 10 THEN 60 ELSE 100 END, CASE WHEN len(shocks) = 0 OR NOT met THEN 79 ELSE 100 END) AS cap
    FROM (SELECT *, transmission >= 15 AND (n_stats > 0 OR len(tickers) > 0 OR trans) AS met FROM comps) a) b) c)"""
SCORE_CTES = (CLAIMS, RAW, DIMS, COMPS, CALIB)


def calibrated(spark, sf):
    return S.calibrate_impact(X.raw_claims(spark, sf))


@register("local_incident", with_(CLAIMS, RAW, DIMS) + "SELECT claim_id FROM dims WHERE local_incident")
def local_incident(spark, sf):
    return X.raw_claims(spark, sf).filter(S.is_local_incident()).select("claim_id")


@register("impact_dimensions", with_(CLAIMS, RAW, DIMS) + """SELECT claim_id, market_relevance::BIGINT AS market_relevance, magnitude::BIGINT AS magnitude,
  transmission::BIGINT AS transmission, urgency::BIGINT AS urgency, array_to_string(shocks, '|') AS shocks FROM dims""")
def impact_dimensions(spark, sf):
    as_long = [F.col(c).cast("long").alias(c) for c in ("market_relevance", "magnitude", "transmission", "urgency")]
    return S.impact_dimensions(X.raw_claims(spark, sf)).select("claim_id", *as_long, F.array_join("shocks", "|").alias("shocks"))


@register("impact_components", with_(*SCORE_CTES[:4]) + """SELECT claim_id, c_sev::BIGINT AS severity, c_eco::BIGINT AS economic_relevance, c_pro::BIGINT AS propagation,
  c_spe::BIGINT AS specificity, c_nov::BIGINT AS novelty, c_str::BIGINT AS strategic FROM comps""")
def impact_components(spark, sf):
    cols = ("severity", "economic_relevance", "propagation", "specificity", "novelty", "strategic")
    df = S.impact_components(S.impact_dimensions(X.raw_claims(spark, sf)))
    return df.select("claim_id", *[F.col(c).cast("long").alias(c) for c in cols])


@register("calibrate_impact", with_(*SCORE_CTES) + """SELECT claim_id, calibrated_score, route, CASE WHEN calibrated_score >= 80 THEN 'top' WHEN calibrated_score >= 60 THEN 'high'
  WHEN calibrated_score >= 40 THEN 'medium' ELSE 'low' END AS score_band, concat_ws('|',
  CASE WHEN len(shocks) > 0 AND met AND magnitude >= 12 THEN 'impact:shock_transmission_confirmed_boost' END, CASE WHEN len(shocks) >= 2 THEN 'impact:multi_shock_boost' END,
  CASE WHEN breaking_window IN ('15m', '1h') AND len(shocks) > 0 THEN 'impact:breaking_shock_boost' END, CASE WHEN local_incident THEN 'impact:local_incident_cap_40' END,
  CASE WHEN market_relevance < 12 AND n_stats = 0 AND len(tickers) = 0 THEN 'impact:non_market_cap_45' END, CASE WHEN transmission < 10 THEN 'impact:low_transmission_cap_60' END,
  CASE WHEN len(shocks) = 0 THEN 'impact:no_shock_top_band_block' END, CASE WHEN NOT met THEN 'impact:transmission_top_band_block' END,
  CASE WHEN len(hits) > 0 THEN 'impact:strategic_relevance_signal' END, 'impact:route:' || route) AS rules FROM calib""")
def calibrate_impact(spark, sf):
    return calibrated(spark, sf).select("claim_id", "calibrated_score", "route", "score_band", F.array_join("impact_rules", "|").alias("rules"))


_SHARES = "round(100.0 * avg((calibrated_score > 40)::INT), {0}) AS pct_gt_40, round(100.0 * avg((calibrated_score > 60)::INT), {0}) AS pct_gt_60, round(100.0 * avg((calibrated_score >= 80)::INT), {0}) AS pct_gte_80"


@register("score_distribution", with_(*SCORE_CTES) + f"""SELECT topic, count(*) AS n, percentile_disc(0.95) WITHIN GROUP (ORDER BY calibrated_score) AS p95,
  percentile_disc(0.99) WITHIN GROUP (ORDER BY calibrated_score) AS p99, {_SHARES.format(2)} FROM calib GROUP BY topic""")
def score_distribution(spark, sf):
    return S.score_distribution(calibrated(spark, sf), by=["topic"])


@register("score_percentiles_cont", with_(*SCORE_CTES) + f"""SELECT round(percentile_cont(0.95) WITHIN GROUP (ORDER BY calibrated_score), 4) AS p95,
  round(percentile_cont(0.99) WITHIN GROUP (ORDER BY calibrated_score), 4) AS p99, {_SHARES.format(4)} FROM calib""")
def score_percentiles_cont(spark, sf):
    return S.score_percentiles_cont(calibrated(spark, sf))


def _stags(s):
    return (f"list_filter([CASE WHEN {any_of(s, V.LOCAL_WORDS)} THEN 'local_incident' END, CASE WHEN {any_of(s, V.OPERATIONAL_WORDS)} THEN 'operational' END, "
            f"CASE WHEN {any_of(s, V.REACTION_WORDS)} THEN 'reaction' END], lambda t: t IS NOT NULL)")


FEATURES = f"""features AS (SELECT *, CASE WHEN impact_score >= 85 THEN 'critical' WHEN impact_score >= 70 THEN 'high' WHEN impact_score >= 55 THEN 'medium' ELSE 'low' END AS impact_band,
  CASE WHEN impact_score >= 85 THEN 3 WHEN impact_score >= 70 THEN 2 WHEN impact_score >= 55 THEN 1 ELSE 0 END AS band,
  CASE WHEN confidence >= 0.85 THEN 'strong' WHEN confidence >= 0.75 THEN 'usable' ELSE 'weak' END AS confidence_band, {_stags('lower(summary)')} AS stags,
  CASE WHEN {any_of('lower(source_claimed)', V.AUTHORITY_WORDS)} OR contains(lower(summary), 'according to') THEN 'authority'
       WHEN {any_of("lower(source_claimed || ' ' || summary)", V.COMMENTARY_WORDS)} THEN 'commentary' ELSE 'unknown' END AS source_class,
  {entity_sig()} AS ents, list_sort(list_distinct(list_transform(keywords, lambda k: lower(k)))) AS words FROM dims)"""
FEATURE_CTES = (CLAIMS, RAW, DIMS, FEATURES)


@register("triage_features", with_(*FEATURE_CTES) + """SELECT claim_id, impact_band, confidence_band, array_to_string(stags, ',') AS summary_tags, source_class, local_incident,
  array_to_string(ents, ',') AS entities, topic || '|' || array_to_string(words, ',') || '|' || lower(source_claimed) || '|' || array_to_string(stags, ',') AS claim_signature FROM features""")
def triage_features(spark, sf):
    return R.triage_features(X.raw_claims(spark, sf)).select(
        "claim_id", "impact_band", "confidence_band", F.array_join("summary_tags", ",").alias("summary_tags"), "source_class", "local_incident",
        F.array_join("entities", ",").alias("entities"), "claim_signature")


@register("recent_related", with_(CLAIMS) + """SELECT a.claim_id, count(b.claim_id) AS n_recent FROM claims a LEFT JOIN claims b ON a.topic = b.topic AND b.claim_id <> a.claim_id
  AND b.created_at BETWEEN a.created_at - INTERVAL '15' MINUTE AND a.created_at GROUP BY 1""")
def recent_related(spark, sf):
    return R.recent_related(X.claims(spark, sf))


BURST = """burst_pairs AS (SELECT a.claim_id, a.band, a.ents, b.band AS o_band, b.ents AS o_ents, b.created_at AS t, b.claim_id AS o_id,
    a.source_claimed = b.source_claimed AND len(list_intersect(a.words, b.words)) >= 2 AS same_source
  FROM features a JOIN features b ON a.topic = b.topic AND b.created_at >= a.created_at - INTERVAL '15' MINUTE AND (b.created_at, b.claim_id) < (a.created_at, a.claim_id)
  WHERE a.fingerprint = b.fingerprint OR len(list_intersect(a.ents, b.ents)) >= 2 OR (a.source_claimed = b.source_claimed AND len(list_intersect(a.words, b.words)) >= 2)),
burst_scan AS (SELECT *, flatten(list(o_ents) OVER (PARTITION BY claim_id ORDER BY t, o_id)) AS seen FROM burst_pairs),
burst AS (SELECT c.claim_id, count(s.claim_id) > 0 AS soft_related, count(*) FILTER (s.band <= s.o_band AND (s.same_source OR list_has_all(s.seen, s.ents))) AS burst_count
  FROM claims c LEFT JOIN burst_scan s USING (claim_id) GROUP BY 1)"""


@register("burst_counts", with_(*FEATURE_CTES, BURST) + "SELECT * FROM burst")
def burst_counts(spark, sf):
    return R.burst_counts(X.raw_claims(spark, sf))


CANDIDATE = """cand AS (SELECT f.*, p.claim_id AS existing_event_id, p.ents AS c_ents, p.band AS c_band, p.stags AS c_tags, p.source_class AS c_class FROM features f
  LEFT JOIN features p ON p.claim_id = (SELECT x.claim_id FROM claims x WHERE x.fingerprint = f.fingerprint AND (x.created_at, x.claim_id) < (f.created_at, f.claim_id)
    AND x.created_at >= f.created_at - INTERVAL '1' HOUR ORDER BY x.created_at DESC, x.claim_id DESC LIMIT 1)),
novel AS (SELECT *, existing_event_id IS NULL OR len(list_filter(ents, lambda e: NOT list_contains(c_ents, e))) > 0 OR band > c_band
    OR (list_contains(stags, 'operational') AND NOT list_contains(c_tags, 'operational') AND list_contains(c_tags, 'reaction'))
    OR (c_class = 'commentary' AND source_class = 'authority') AS materially_new FROM cand)"""


def with_candidate(spark, sf):
    """Features plus the previous claim of the same fingerprint (one hour) as the candidate."""
    f = R.triage_features(X.raw_claims(spark, sf)).withColumn("_us", micros("created_at"))
    out = previous_within(f, ["fingerprint"], "_us", "claim_id", HOUR, ["entities", "impact_score", "summary_tags", "source_class"])
    return out.withColumns({
        "existing_event_id": F.col("prev.tie"), "cand_entities": F.col("prev.entities"), "cand_impact": F.col("prev.impact_score"),
        "cand_tags": F.col("prev.summary_tags"), "cand_source_class": F.col("prev.source_class")}).drop("prev", "_us")


@register("materially_new", with_(*FEATURE_CTES, CANDIDATE) + "SELECT claim_id, existing_event_id, materially_new FROM novel")
def materially_new(spark, sf):
    return R.materially_new(with_candidate(spark, sf)).select("claim_id", "existing_event_id", "materially_new")


TRIAGE = """triaged AS (SELECT *, CASE WHEN local_incident AND act IN ('promote', 'update') THEN 'monitor' ELSE act END AS triage_action FROM (
  SELECT *, CASE WHEN state = 'repeat_low_delta' AND burst_count >= 2 THEN 'monitor' WHEN state = 'repeat_low_delta' AND burst_count >= 1 THEN 'update'
    WHEN rule = 'triage:low_signal_archive' THEN 'archive' WHEN rule = 'triage:new_event_promote' THEN 'promote' WHEN rule = 'triage:related_material_update' THEN 'update' ELSE 'monitor' END AS act
  FROM (SELECT *, CASE WHEN confidence_band = 'weak' AND impact_band = 'low' THEN 'triage:low_signal_archive'
      WHEN state = 'new_event' AND impact_band IN ('high', 'critical') AND confidence_band <> 'weak' THEN 'triage:new_event_promote'
      WHEN state = 'related_update' AND materially_new THEN 'triage:related_material_update' END AS rule
    FROM (SELECT n.*, soft_related, burst_count, CASE WHEN existing_event_id IS NULL THEN CASE WHEN soft_related AND burst_count >= 1 THEN 'repeat_low_delta' ELSE 'new_event' END
      WHEN materially_new THEN 'related_update' ELSE 'repeat_low_delta' END AS state FROM novel n JOIN burst USING (claim_id)) a) b) c)"""
TRIAGE_CTES = (*FEATURE_CTES, BURST, CANDIDATE, TRIAGE)


def triaged(spark, sf):
    df = R.materially_new(with_candidate(spark, sf))
    return R.triage(df.join(R.burst_counts(X.raw_claims(spark, sf)), "claim_id"))


@register("triage", with_(*TRIAGE_CTES) + """SELECT claim_id, state AS novelty_state, triage_action, concat_ws('|', 'triage:score_band:' || impact_band, 'triage:confidence_band:' || confidence_band,
  CASE WHEN local_incident THEN 'triage:local_incident_downgrade' END, CASE WHEN existing_event_id IS NOT NULL AND NOT materially_new THEN 'triage:repeat_downgrade' END,
  CASE WHEN soft_related THEN 'triage:soft_related_match' END, CASE WHEN existing_event_id IS NULL AND soft_related AND burst_count >= 1 THEN 'triage:soft_related_downgrade' END, rule,
  CASE WHEN state = 'repeat_low_delta' AND burst_count >= 2 THEN 'triage:burst_cap_monitor' WHEN state = 'repeat_low_delta' AND burst_count >= 1 THEN 'triage:burst_cap_update' END) AS reasons FROM triaged""")
def triage(spark, sf):
    return triaged(spark, sf).select("claim_id", "novelty_state", "triage_action", F.array_join("triage_reasons", "|").alias("reasons"))


ROUTED = f"""routed AS (SELECT *, (['none', 'low', 'medium', 'high'])[least(r, cap) + 1] AS publish_priority, (['none', 'low', 'medium', 'high'])[r + 1] AS base FROM (
  SELECT *, CASE WHEN impact_score >= 80 THEN 3 WHEN impact_score >= 60 THEN 2 WHEN impact_score >= 30 THEN 1 ELSE 0 END AS r,
    least(CASE triage_action WHEN 'update' THEN 2 WHEN 'monitor' THEN 1 WHEN 'archive' THEN 0 ELSE 3 END, CASE WHEN local_incident THEN 1 ELSE 3 END) AS cap,
    {case_map('topic', V.DESTINATIONS, q('other_events'))} AS destination FROM triaged) z)"""
_FLAGS = """concat_ws('|', CASE WHEN local_incident THEN 'unconfirmed' END, CASE WHEN impact_score >= 60 THEN 'high_impact' END, CASE WHEN is_breaking THEN 'breaking' END, CASE WHEN local_incident THEN 'local_incident' END)"""


@register("route", with_(*TRIAGE_CTES, ROUTED) + f"""SELECT claim_id, destination AS store_to, publish_priority, local_incident AS requires_evidence,
  CASE WHEN triage_action = 'archive' THEN 'ignore' WHEN triage_action = 'update' AND existing_event_id IS NOT NULL THEN 'update' ELSE 'create' END AS event_action, {_FLAGS} AS flags,
  concat_ws('|', 'topic_to_dest:' || topic, 'impact_to_priority:' || base, CASE WHEN base <> publish_priority THEN 'triage_priority_cap:' || base || '->' || publish_priority END,
   CASE WHEN local_incident THEN 'requires_evidence:local_incident_override' END, 'event_action:create') AS rules FROM routed""")
def route(spark, sf):
    return R.route(triaged(spark, sf)).select("claim_id", F.array_join("store_to", "|").alias("store_to"), "publish_priority", "requires_evidence", "event_action",
                                              F.array_join("flags", "|").alias("flags"), F.array_join("routing_rules", "|").alias("rules"))


@register("fan_out", with_(*TRIAGE_CTES, ROUTED) + "SELECT destination, publish_priority, count(*) AS n FROM routed GROUP BY 1, 2")
def fan_out(spark, sf):
    return R.fan_out(R.route(triaged(spark, sf))).groupBy("destination", "publish_priority").agg(F.count(F.lit(1)).alias("n"))


@register("apply_conflicts", with_(*TRIAGE_CTES, ROUTED) + f"""SELECT claim_id, CASE WHEN hit THEN 'monitor' ELSE triage_action END AS triage_action, CASE WHEN hit THEN 'none' ELSE publish_priority END AS publish_priority,
  CASE WHEN hit THEN array_to_string(list_sort(list_filter(string_split(f, '|'), lambda v: v <> '') || ['identity_conflict_review']), '|') ELSE f END AS flags
FROM (SELECT *, {_FLAGS} AS f, claim_hash = 'c-1' OR confidence = 0.3 AS hit FROM (SELECT * REPLACE (coalesce(claim_hash, '') AS claim_hash) FROM routed) y) z""")
def apply_conflicts(spark, sf):
    routed = R.route(triaged(spark, sf))
    upserts = X.claims(spark, sf).filter("claim_hash = 'c-1' OR confidence = 0.3").select("claim_id", F.lit("conflicting_action_class").alias("review_reason"))
    return R.apply_conflicts(routed, upserts).select("claim_id", "triage_action", "publish_priority", F.array_join("flags", "|").alias("flags"))
