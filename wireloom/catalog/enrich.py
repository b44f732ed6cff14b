"""Enrichment queries over the event view."""

from pyspark.sql import functions as F

from . import register
from .base_sql import CANDIDATES, CLAIMS, EVENTS, RAW, entity_sig, with_
from ..functions import text as T
from ..operators import enrich as N
from ..sources import fixture as X

KEY_SQL = """CASE WHEN claim_id % 3 = 0 THEN fingerprint ELSE topic || '|' || lower(source_claimed) || '|' || coalesce(strftime(event_time, '%Y-%m-%dT%H'), 'none') || '|' || array_to_string(list_sort(list_distinct(keywords))[1:3], ',') END"""


@register("cluster_key", with_(CLAIMS, RAW) + f"SELECT claim_id, {KEY_SQL} AS cluster_key FROM raw_claims")
def cluster_key(spark, sf):
    c = X.raw_claims(spark, sf).withColumn("fingerprint", F.when(F.col("claim_id") % 3 == 0, F.col("fingerprint")))
    return c.select("claim_id", N.cluster_key(c).alias("cluster_key"))


@register("cluster_repeat", with_(CLAIMS, EVENTS, CANDIDATES) + """SELECT event_id FROM cands a WHERE EXISTS (SELECT 1 FROM cands b WHERE b.cluster_key = a.cluster_key AND b.selected AND b.event_id <> a.event_id
  AND b.scored_at >= a.scored_at - INTERVAL '3' HOUR AND (b.scored_at, b.event_id) < (a.scored_at, a.event_id))""")
def cluster_repeat(spark, sf):
    return N.cluster_repeat(X.candidates(X.events(spark, sf))).select("event_id")


def _titled(spark, sf):
    sig = T.entity_signature(F.array("country"), F.array("org"), F.array().cast("array<string>"))
    return X.events(spark, sf).withColumn("ents", sig)


OVERLAP = """tok AS (SELECT event_id, topic, last_updated_at, event_time, country, lower(org) AS org, list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]+')) AS t FROM evs),
look AS (SELECT a.event_id, a.t AS ta, b.t AS tb, a.country = b.country OR a.org = b.org AS shared, coalesce(abs(epoch_us(a.event_time) - epoch_us(b.event_time)) <= 14400000000, true) AS close
  FROM tok a JOIN tok b ON a.topic = b.topic AND b.last_updated_at >= a.last_updated_at - INTERVAL '3' HOUR AND (b.last_updated_at, b.event_id) < (a.last_updated_at, a.event_id)
  QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.last_updated_at DESC, b.event_id DESC) <= 20),
blocked AS (SELECT DISTINCT event_id FROM look WHERE shared AND close AND len(list_intersect(ta, tb)) / len(list_distinct(ta || tb))::DOUBLE >= 0.82)"""


@register("title_entity_overlap", with_(CLAIMS, EVENTS, OVERLAP) + "SELECT e.event_id, b.event_id IS NOT NULL AS blocked FROM evs e LEFT JOIN blocked b USING (event_id)")
def title_entity_overlap(spark, sf):
    return N.title_entity_overlap(_titled(spark, sf)).select("event_id", "blocked")


# each cluster key is read once in time order; the last selected time goes along
_GREEDY = f"""cand AS (SELECT e.event_id, e.fingerprint AS cluster_key, e.last_updated_at AS scored_at, e.is_published AS known, e.confidence < 0.2 AS archived, e.confidence = 0.5 AS marked, b.event_id IS NOT NULL AS blocked,
    CASE WHEN e.impact_score >= 40 THEN 'deep_enrich' ELSE 'index_only' END AS route FROM evs e LEFT JOIN blocked b USING (event_id)),
line AS (SELECT *, route = 'deep_enrich' AND NOT coalesce(archived, false) AND NOT coalesce(known, false) AND NOT coalesce(marked, false) AND NOT blocked AS eligible, row_number() OVER (PARTITION BY cluster_key ORDER BY scored_at, event_id) AS rn FROM cand),
greedy AS (SELECT event_id, cluster_key, rn, false AS hit, CASE WHEN eligible THEN scored_at END AS last FROM line WHERE rn = 1
  UNION ALL SELECT event_id, cluster_key, rn, hit, CASE WHEN eligible AND NOT hit THEN scored_at ELSE last END FROM (
    SELECT l.*, g.last, coalesce(g.last >= l.scored_at - INTERVAL '3' HOUR, false) AS hit FROM greedy g JOIN line l ON l.cluster_key = g.cluster_key AND l.rn = g.rn + 1) z)"""


@register("select_enrichment", with_(CLAIMS, EVENTS, OVERLAP, _GREEDY) + """SELECT event_id, l.cluster_key, scored_at, eligible AND NOT hit AS selected,
  CASE WHEN blocked THEN 'blocked_title_entity_overlap' WHEN hit THEN 'blocked_cluster_repeat' WHEN marked THEN 'blocked_duplicate_marker' WHEN known THEN 'blocked_event_lineage' ELSE 'novel' END AS novelty_state,
  array_to_string(list_sort(list_filter(['enrichment:route:' || route, CASE WHEN route <> 'deep_enrich' THEN 'enrichment:not_eligible_route' END, CASE WHEN archived THEN 'enrichment:triage_archive_block' END,
    CASE WHEN known THEN 'enrichment:novelty_block_event_lineage' END, CASE WHEN marked THEN 'enrichment:novelty_block_duplicate_marker' END, CASE WHEN hit THEN 'enrichment:novelty_block_cluster_repeat' END,
    CASE WHEN blocked THEN 'enrichment:novelty_block_title_entity_overlap' END, CASE WHEN eligible AND NOT hit THEN 'enrichment:selected' END], lambda r: r IS NOT NULL)), '|') AS reasons
FROM line l JOIN greedy g USING (event_id)""")
def select_enrichment(spark, sf):
    """Selection depends on what was selected before, cluster by cluster."""
    ev = N.title_entity_overlap(_titled(spark, sf)).withColumns({
        "cluster_key": F.col("fingerprint"), "scored_at": F.col("last_updated_at"), "existing_event_id": F.when(F.col("is_published"), F.col("event_id")),
        "triage_action": F.when(F.col("confidence") < 0.2, "archive").otherwise("monitor"), "triage_reasons": F.when(F.col("confidence") == 0.5, F.array(F.lit("triage:repeat_downgrade"))).otherwise(F.array().cast("array<string>")),
        "route": F.when(F.col("impact_score") >= 40, "deep_enrich").otherwise("index_only")})
    return N.select_enrichment(ev).select("event_id", "cluster_key", "scored_at", "selected", "novelty_state", F.array_join("reason_codes", "|").alias("reasons"))


_C = "array_to_string(list_sort(list_distinct({0})), '|')"
_FT = "list_transform(list_filter(tags, lambda t: t.tag_type {0}), lambda t: {1})"


@register("deep_enrichment", with_(CLAIMS, RAW) + f"""SELECT claim_id AS event_id,
  array_to_string(CASE WHEN len(relations) > 0 THEN list_transform(relations, lambda r: trim(r.subject_value) || ' ' || r.relation_type || ' ' || r.object_value)[1:6] ELSE [summary] END, '|') AS mechanism_notes,
  {_C.format(_FT.format("IN ('commodities', 'sectors', 'companies', 'organizations')", "'Monitor downstream exposure to ' || t.tag_value || '.'"))} AS exposure_hints,
  {_C.format("CASE WHEN direction_raw = 'easing' THEN ['Directionality indicates easing pressure; compare against stress narratives.'] ELSE [] END || list_transform(list_filter(relations, lambda r: r.relation_type = 'contradicts'), lambda r: 'Explicit contradictory relation detected.') || list_transform(list_filter(relations, lambda r: r.relation_source = 'inferred'), lambda r: 'Contains inferred relation(s); verify against observed updates.')")} AS contradiction_cues,
  {_C.format("CASE WHEN direction_raw = 'easing' THEN ['Potential offset from easing directionality.'] ELSE [] END || list_transform(list_filter(relations, lambda r: r.relation_type = 'supports'), lambda r: 'Offset signal: supports.')")} AS offset_cues,
  {_C.format(_FT.format("= 'strategic'", "t.tag_value"))} AS theme_hints FROM raw_claims""")
def deep_enrichment(spark, sf):
    j = lambda c: F.array_join(c, "|").alias(c)
    df = N.deep_enrichment(X.raw_claims(spark, sf).withColumn("direction", F.col("direction_raw")))
    return df.select(F.col("claim_id").alias("event_id"), j("mechanism_notes"), j("exposure_hints"), j("contradiction_cues"), j("offset_cues"), j("theme_hints"))


_TOP = "top AS (SELECT event_id FROM cands WHERE selected AND route = 'deep_enrich' ORDER BY scored_at DESC, event_id DESC LIMIT 50), done AS (SELECT event_id FROM evs WHERE is_published)"


@register("deep_enrichment_due", with_(CLAIMS, EVENTS, CANDIDATES, _TOP) + "SELECT event_id FROM top WHERE event_id NOT IN (SELECT event_id FROM done)")
def deep_enrichment_due(spark, sf):
    ev = X.events(spark, sf)
    return N.deep_enrichment_due(X.candidates(ev), ev.filter("is_published"), 50)[0].select("event_id")


@register("deep_enrichment_summary", with_(CLAIMS, EVENTS, CANDIDATES, _TOP) + "SELECT count(*) AS selected, count(*) FILTER (d.event_id IS NULL) AS created, count(d.event_id) AS skipped_existing FROM top t LEFT JOIN done d USING (event_id)")
def deep_enrichment_summary(spark, sf):
    ev = X.events(spark, sf)
    return N.deep_enrichment_due(X.candidates(ev), ev.filter("is_published"), 50)[1]
