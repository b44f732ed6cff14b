"""Theme queries over daily and weekly windows of the event view."""

from pyspark.sql import functions as F

from . import register
from .base_sql import CLAIMS, EVENTS, RAW, any_of, case_map, in_list, q, sql_list, with_
from ..functions import vocab as V
from ..operators import themes as H
from ..plans import read_models
from ..session import cut_lineage
from ..sources import fixture as X


def inputs(spark, sf):
    """Events with the payload of their latest claim and a calibrated score."""
    payload = X.raw_claims(spark, sf).select("claim_id", "keywords", "countries", "orgs", "people", "tickers", "market_stats")
    ev = X.events(spark, sf).withColumnRenamed("latest_claim_id", "claim_id").withColumn("created_at", F.col("last_updated_at"))
    return ev.join(payload, "claim_id", "left").withColumn("calibrated_score", F.bround(F.col("impact_score") * 0.9))


_HIT = lambda words: "list_filter([" + ", ".join(f"CASE WHEN contains(txt, {q(w)}) THEN {q(w)} END" for w in sorted(words)) + "], lambda v: v IS NOT NULL)"
_ARCH = "list_filter([" + ", ".join(f"CASE WHEN {any_of('txt', w)} THEN {q(n)} END" for n, w in V.ARCHETYPES) + "], lambda v: v IS NOT NULL)"
def match_sql(theme):
    return f"""tin AS (SELECT e.event_id, e.latest_claim_id AS claim_id, e.topic, e.event_time, e.last_updated_at AS created_at, e.impact_score, e.claim_hash, r.orgs, r.tickers, r.countries, e.fingerprint,
    round_even(e.impact_score * 0.9::DOUBLE, 0)::DOUBLE AS cal,
    lower(e.summary || ' ' || e.source_claimed || ' ' || array_to_string(r.keywords, ' ') || CASE WHEN n_stats > 0 THEN ' move' ELSE '' END) AS txt FROM evs e JOIN raw_claims r ON r.claim_id = e.latest_claim_id),
arch AS (SELECT *, CASE WHEN st AND NOT ea THEN 'stress' WHEN ea AND NOT st THEN 'easing' ELSE 'neutral' END AS direction,
    topic = 'commodities' AND NOT list_contains(a0, 'input_price_shock') AND contains(txt, 'price') AS bias
  FROM (SELECT *, {_ARCH} AS a0, {any_of('txt', V.STRESS_WORDS)} AS st, {any_of('txt', V.EASING_WORDS)} AS ea FROM tin) z),
arch2 AS (SELECT *, list_sort(a0 || CASE WHEN bias THEN ['input_price_shock'] ELSE [] END) AS archetypes,
    list_sort(list_transform(a0, lambda v: 'archetype:' || v) || CASE WHEN bias THEN ['archetype:input_price_shock_topic_bias'] ELSE [] END) AS a_reasons,
    {_HIT(theme.energy_markers)} AS eh, {_HIT(theme.supply_markers)} AS sh, {_HIT(theme.downstream_markers)} AS dh FROM arch),
matched AS (SELECT * FROM (SELECT *, len(sh) > 0 OR list_has_any(archetypes, {sql_list(V.SUPPLY_SHAPE_ARCHETYPES)}) AS supply, len(dh) > 0 OR list_contains(archetypes, 'input_price_shock') AS down FROM arch2) z
  WHERE len(eh) > 0 AND (supply OR down))"""


_LOW = lambda c: f"list_transform({c}, lambda v: lower(trim(v)))"

def evid_sql(theme):
    return f"""evid AS (SELECT *, ('0x' || substr(sha256(concat_ws('|', theme_key, event_id, claim_id)), 1, 15))::BIGINT AS evidence_id FROM (
  SELECT {q(theme.key)} AS theme_key, event_id, claim_id, event_time, created_at, coalesce(impact_score, 0) AS impact_score, coalesce(nullif(cal, 0), impact_score, 0) AS calibrated_score,
  archetypes, direction, coalesce(claim_hash, 'event:' || event_id) AS dedupe_key, list_sort(list_distinct({_LOW('orgs')} || {_LOW('tickers')})) AS entity_refs, list_sort(list_distinct({_LOW('countries')})) AS geography_refs FROM matched) z)"""



def items_sql(theme):
    return f"""spans AS (SELECT *, 'daily' AS cadence, date_trunc('day', coalesce(event_time, created_at))::TIMESTAMP AS window_start, date_trunc('day', coalesce(event_time, created_at))::TIMESTAMP + INTERVAL '1' DAY AS window_end FROM evid
  UNION ALL SELECT evid.*, 'weekly', date_trunc('day', coalesce(event_time, created_at))::TIMESTAMP - k * INTERVAL '1' DAY, date_trunc('day', coalesce(event_time, created_at))::TIMESTAMP + (7 - k) * INTERVAL '1' DAY FROM evid, range(7) r(k)),
items AS (SELECT *, count(*) OVER (PARTITION BY cadence, window_start, dedupe_key) AS n_raw,
    row_number() OVER (PARTITION BY cadence, window_start, dedupe_key ORDER BY calibrated_score DESC, coalesce(epoch_us(event_time), 0) DESC, event_id DESC, claim_id DESC) AS rn FROM spans WHERE cadence IN {in_list(theme.cadences)} QUALIFY rn = 1)"""


_K = "theme_key, cadence, window_start, window_end"
_TOPIDS = lambda name, cond, k: (f"{name} AS (SELECT {_K}, list(evidence_id ORDER BY p) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY cadence, window_start ORDER BY calibrated_score DESC, "
                                 f"coalesce(epoch_us(event_time), 0) DESC, event_id DESC, claim_id DESC) AS p FROM items WHERE {cond}) z WHERE p <= {k} GROUP BY ALL)")
BUNDLES = ",\n".join([_TOPIDS("sup", "direction <> 'easing'", 5), _TOPIDS("con", "direction = 'easing'", 3), f"""bund AS (
  SELECT *, CASE WHEN n < 3 THEN 'sparse' WHEN recent / n::DOUBLE >= 0.6 THEN 'recent_spike' WHEN fh / n::DOUBLE >= 0.3 AND sh / n::DOUBLE >= 0.3 THEN 'persistent_buildup' ELSE 'distributed_accumulation' END AS freshness,
    round((total_raw - n) / total_raw::DOUBLE, 4) AS repeat_ratio, round(n / total_raw::DOUBLE, 4) AS novelty_ratio, round(contradictory / n::DOUBLE, 4) AS contradiction_ratio,
    CASE WHEN len(ts) > 0 AND len(tc) = 0 THEN 'stress_accumulation' WHEN len(ts) > len(tc) THEN 'stress_dominant' WHEN len(tc) > len(ts) THEN 'easing_dominant' ELSE 'mixed' END AS directionality
  FROM (SELECT g.*, coalesce(s.ids, []) AS ts, coalesce(c.ids, []) AS tc, coalesce(archetypes, []) AS archetypes FROM (
      SELECT {_K}, count(*) AS n, sum(n_raw)::BIGINT AS total_raw, count(*) FILTER (direction <> 'easing') AS supporting, count(*) FILTER (direction = 'easing') AS contradictory,
        sum(calibrated_score::DECIMAL(28,10))::DOUBLE / count(*) AS avg_score, count(*) FILTER (event_time >= window_end - INTERVAL '6' HOUR) AS recent,
        count(*) FILTER (event_time < window_start + (window_end - window_start) / 2) AS fh, count(*) FILTER (event_time >= window_start + (window_end - window_start) / 2) AS sh, count(*) FILTER (calibrated_score >= 80) AS n_high FROM items GROUP BY ALL) g
    LEFT JOIN sup s USING ({_K}) LEFT JOIN con c USING ({_K})
    LEFT JOIN (SELECT {_K}, list(DISTINCT a ORDER BY a) AS archetypes FROM (SELECT {_K}, unnest(archetypes) AS a FROM items) u GROUP BY ALL) m USING ({_K})) z)"""])
_HAS = lambda *n: f"list_has_any(archetypes, {sql_list(n)})"
_CL = lambda x: f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {x}))"
_STRONG = f"""(SELECT *, {_CL("n * 7.0::DOUBLE + avg_score * 0.45::DOUBLE + len(ts) * 2.0::DOUBLE - len(tc) * 2.5::DOUBLE + " + case_map('freshness', {"recent_spike": 8, "persistent_buildup": 10, "distributed_accumulation": 5, "sparse": 0}) + " + novelty_ratio * 10.0::DOUBLE + CASE WHEN directionality IN ('stress_accumulation', 'stress_dominant') THEN 4 ELSE 0 END")} AS evidence_strength,
  list_filter([CASE WHEN {_HAS('input_price_shock')} OR n_high > 0 THEN 'energy_price_or_cost_stress' END, CASE WHEN {_HAS(*V.SUPPLY_SHAPE_ARCHETYPES)} THEN 'supply_side_friction' END,
    CASE WHEN {_HAS('capacity_expansion_closure', 'outage_restart')} THEN 'capacity_or_utilization_stress' END,
    CASE WHEN freshness IN ('persistent_buildup', 'distributed_accumulation') AND {_HAS('supply_disruption', 'capacity_expansion_closure')} THEN 'persistent_supply_tightening' END], lambda v: v IS NOT NULL) AS signals FROM bund)"""
STRENGTH = f"strong AS {_STRONG}"

def fits_sql(theme):
    lens = ", ".join(f"({q(x['key'])}, {q(x['pattern'])}, {sql_list(x['archetypes'])}, {sql_list(x['signals'])}, {x['recent_spike']}, {x['persistent_buildup']}, {x['contradiction']})" for x in theme.lenses)
    return f"""lenses(lens_key, lens_pattern, la, ls, rs, pb, cp) AS (VALUES {lens}),
fits AS (SELECT *, lens_fit >= 45 AS active FROM (SELECT *, {_CL("len(list_intersect(signals, ls)) / len(ls)::DOUBLE * 60.0::DOUBLE + len(list_intersect(archetypes, la)) / len(la)::DOUBLE * 35.0::DOUBLE + (CASE WHEN freshness = 'recent_spike' THEN rs ELSE 0 END + CASE WHEN freshness = 'persistent_buildup' THEN pb ELSE 0 END + CASE WHEN len(tc) > 0 THEN cp ELSE 0 END)::DOUBLE")} AS lens_fit FROM strong, lenses) z),
pat AS (SELECT {_K}, string_agg(DISTINCT p, '|' ORDER BY p) AS active_patterns, (SELECT 1) AS one FROM (
  SELECT {_K}, lens_pattern AS p FROM fits WHERE active UNION ALL SELECT {_K}, 'trade_flow_rerouting' FROM fits WHERE active AND {_HAS('logistics_disruption')}
  UNION ALL SELECT {_K}, 'supply_tightening' FROM fits WHERE active AND {_HAS('supply_disruption')} UNION ALL SELECT {_K}, 'margin_compression_expansion' FROM fits WHERE active AND {_HAS('input_price_shock')}) z GROUP BY {_K}),
assess AS (SELECT *, CASE WHEN confidence >= 75 AND freshness IN ('recent_spike', 'persistent_buildup') THEN 'high' WHEN confidence >= 55 THEN 'medium' ELSE 'low' END AS urgency,
    CASE freshness WHEN 'recent_spike' THEN 'short_term' WHEN 'persistent_buildup' THEN 'medium_term' ELSE 'medium_to_long_term' END AS time_horizon, CASE WHEN confidence >= 50 THEN 'active' ELSE 'watch' END AS assessment_status,
    sha256(concat_ws('|', theme_key, cadence, strftime(window_start, '%Y-%m-%dT%H:%M:%S'), strftime(window_end, '%Y-%m-%dT%H:%M:%S'), lens_key, array_to_string(ts[1:3], ','))) AS stable_key
  FROM (SELECT *, {_CL('evidence_strength * 0.45::DOUBLE + lens_fit * 0.45::DOUBLE - contradiction_ratio * 20.0::DOUBLE')} AS priority,
    {_CL("evidence_strength * 0.5::DOUBLE + lens_fit * 0.35::DOUBLE + " + case_map('freshness', {"recent_spike": 6, "persistent_buildup": 8, "distributed_accumulation": 4, "sparse": -4}) + " - contradiction_ratio * 15.0::DOUBLE")} AS confidence FROM fits WHERE active) z)"""


MATCH, EVID, ITEMS, FITS = (part(H.ENERGY_TO_AGRI) for part in (match_sql, evid_sql, items_sql, fits_sql))
M, E_, I_, B_ = (CLAIMS, RAW, EVENTS, MATCH), (CLAIMS, RAW, EVENTS, MATCH, EVID), (CLAIMS, RAW, EVENTS, MATCH, EVID, ITEMS), (CLAIMS, RAW, EVENTS, MATCH, EVID, ITEMS, BUNDLES)
S_, A_ = (*B_, STRENGTH), (*B_, STRENGTH, FITS)
j = lambda c, a=None: F.array_join(c, "|").alias(a or c)


@register("archetypes", with_(*M) + "SELECT event_id, array_to_string(archetypes, '|') AS archetypes, array_to_string(a_reasons, '|') AS reasons, direction FROM arch2")
def archetypes(spark, sf):
    return H.archetypes(inputs(spark, sf)).select("event_id", j("archetypes"), j("archetype_reasons", "reasons"), "direction")


@register("match_theme", with_(*M) + """SELECT event_id, array_to_string(eh, '|') AS energy_hits, array_to_string(sh, '|') AS supply_hits, array_to_string(dh, '|') AS downstream_hits,
  array_to_string(list_sort(a_reasons || ['theme_match:energy_signal'] || CASE WHEN supply THEN ['theme_match:supply_shape'] ELSE [] END || CASE WHEN down THEN ['theme_match:downstream_shape'] ELSE [] END), '|') AS reason_codes FROM matched""")
def match_theme(spark, sf):
    return H.match_theme(inputs(spark, sf)).select("event_id", j("energy_hits"), j("supply_hits"), j("downstream_hits"), j("reason_codes"))


def evidence(spark, sf):
    return H.theme_evidence(H.match_theme(inputs(spark, sf)))


@register("theme_evidence", with_(*E_) + "SELECT event_id, claim_id, impact_score, calibrated_score, dedupe_key, array_to_string(entity_refs, '|') AS entity_refs, array_to_string(geography_refs, '|') AS geography_refs FROM evid")
def theme_evidence(spark, sf):
    return evidence(spark, sf).select("event_id", "claim_id", "impact_score", "calibrated_score", "dedupe_key", j("entity_refs"), j("geography_refs"))


@register("missing_theme_evidence", with_(*E_) + "SELECT event_id FROM evs WHERE event_id NOT IN (SELECT event_id FROM evid)")
def missing_theme_evidence(spark, sf):
    return H.missing_theme_evidence(inputs(spark, sf), evidence(spark, sf)).select("event_id")


@register("theme_windows", with_(*I_) + "SELECT cadence, window_start, window_end, count(*) AS n FROM spans GROUP BY ALL")
def theme_windows(spark, sf):
    return H.windowed_evidence(evidence(spark, sf)).groupBy("cadence", "window_start", "window_end").agg(F.count(F.lit(1)).alias("n"))


def items(spark, sf):
    return cut_lineage(H.best_per_key(H.windowed_evidence(evidence(spark, sf))))


@register("best_per_key", with_(*I_) + "SELECT cadence, window_start, event_id, dedupe_key, n_raw FROM items")
def best_per_key(spark, sf):
    return items(spark, sf).select("cadence", "window_start", "event_id", "dedupe_key", "n_raw")


@register("evidence_mix", with_(*I_) + f"""SELECT {_K}, 'archetypes' AS mix, k AS key, count(*) AS n FROM (SELECT *, unnest(archetypes) AS k FROM items) z GROUP BY ALL
  UNION ALL SELECT {_K}, 'entity_refs', k, count(*) FROM (SELECT *, unnest(entity_refs) AS k FROM items) z GROUP BY ALL UNION ALL SELECT {_K}, 'geography_refs', k, count(*) FROM (SELECT *, unnest(geography_refs) AS k FROM items) z GROUP BY ALL""")
def evidence_mix(spark, sf):
    it = items(spark, sf)
    parts = [H.evidence_mix(it, k).withColumn("mix", F.lit(k)) for k in ("archetypes", "entity_refs", "geography_refs")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("severity_histogram", with_(*I_) + f"SELECT {_K}, CASE WHEN calibrated_score >= 80 THEN 'high' WHEN calibrated_score >= 60 THEN 'medium' WHEN calibrated_score >= 40 THEN 'low' ELSE 'very_low' END AS severity, count(*) AS n FROM items GROUP BY ALL")
def severity_histogram(spark, sf):
    return H.severity_histogram(items(spark, sf))


def bundles(spark, sf):
    return H.evidence_bundles(items(spark, sf))


@register("evidence_bundles", with_(*B_) + f"""SELECT {_K}, n, total_raw, supporting, contradictory, array_to_string(ts, '|') AS top_supporting, array_to_string(tc, '|') AS top_contradictory, array_to_string(archetypes, '|') AS archetypes,
  freshness, repeat_ratio, novelty_ratio, contradiction_ratio, directionality FROM bund""")
def evidence_bundles(spark, sf):
    return H.bundle_direction(bundles(spark, sf)).select(*H.KEYS, "n", "total_raw", "supporting", "contradictory", j("top_supporting"), j("top_contradictory"), j("archetypes"), "freshness",
                                                         "repeat_ratio", "novelty_ratio", "contradiction_ratio", "directionality")


@register("bundle_drivers", with_(*I_) + f"""SELECT {_K}, mix, key, n, position FROM (SELECT *, row_number() OVER (PARTITION BY cadence, window_start, mix ORDER BY n DESC, key) AS position FROM (
  SELECT {_K}, mix, key, count(*) AS n FROM (SELECT {_K}, 'archetypes' AS mix, unnest(archetypes) AS key FROM items UNION ALL SELECT {_K}, 'entity_refs', unnest(entity_refs) FROM items UNION ALL SELECT {_K}, 'geography_refs', unnest(geography_refs) FROM items) u GROUP BY ALL) c)
  WHERE position <= CASE mix WHEN 'archetypes' THEN 4 ELSE 5 END""")
def bundle_drivers(spark, sf):
    return H.bundle_drivers(items(spark, sf))


@register("evidence_strength", with_(*S_) + f"SELECT {_K}, round(evidence_strength, 6) AS evidence_strength, array_to_string(signals, '|') AS signals FROM strong")
def evidence_strength(spark, sf):
    return H.bundle_signals(H.evidence_strength(H.bundle_direction(bundles(spark, sf)))).select(*H.KEYS, F.round("evidence_strength", 6).alias("evidence_strength"), j("signals"))


def _fits(spark, sf):
    return H.lens_fit(H.bundle_signals(H.evidence_strength(H.bundle_direction(bundles(spark, sf)))))


@register("lens_fit", with_(*A_) + f"SELECT {_K}, lens_key, round(lens_fit, 6) AS lens_fit, active FROM fits")
def lens_fit(spark, sf):
    return _fits(spark, sf).select(*H.KEYS, "lens_key", F.round("lens_fit", 6).alias("lens_fit"), "active")


@register("transmission_patterns", with_(*A_) + f"SELECT {_K}, active_patterns FROM pat")
def transmission_patterns(spark, sf):
    return H.patterns(_fits(spark, sf)).select(*H.KEYS, j("active_patterns"))


@register("assessments", with_(*A_) + f"""SELECT {_K}, lens_key, stable_key, round(priority, 6) AS priority, round(confidence, 6) AS confidence, urgency, time_horizon, assessment_status FROM assess""")
def assessments(spark, sf):
    r = [F.round(c, 6).alias(c) for c in ("priority", "confidence")]
    return H.assessments(bundles(spark, sf)).select(*H.KEYS, "lens_key", "stable_key", *r, "urgency", "time_horizon", "assessment_status")


def cards_sql(theme):
    gate = f"""CASE WHEN evidence_strength < {theme.gates['strength']} THEN 'gate:evidence_strength_below_threshold' WHEN confidence < {theme.gates['confidence']} THEN 'gate:confidence_below_threshold' WHEN priority < {theme.gates['priority']} THEN 'gate:priority_below_threshold' END"""
    angle = case_map('lens_key', {k: v[0] for k, v in V.OPPORTUNITY_TEXT.items()})
    return f"""fresh AS (SELECT *, {gate} AS gate, window_end AS created_at, sha256(concat_ws('|', theme_key, lens_key, lens_pattern, lower({angle}))) AS narrative_signature FROM assess),
fresh_order AS (SELECT *, row_number() OVER (PARTITION BY theme_key, narrative_signature ORDER BY created_at, stable_key) AS rn FROM fresh),
chain AS (SELECT DISTINCT theme_key, narrative_signature, 0::BIGINT AS rn, [{{'us': created_at, 'id': stable_key, 'confidence': confidence, 'priority': priority, 'ts': ts, 'st': assessment_status}}][2:] AS live,
    NULL::VARCHAR AS stable_key, NULL::VARCHAR AS prior_key, NULL::VARCHAR AS change, NULL::VARCHAR AS card_status FROM fresh_order WHERE rn = 1
  UNION ALL SELECT theme_key, narrative_signature, rn, CASE WHEN card_status IN ('emitted', 'updated') THEN list_append(live, {{'us': created_at, 'id': stable_key, 'confidence': confidence, 'priority': priority, 'ts': ts, 'st': assessment_status}}) ELSE live END,
    stable_key, p.id, change, card_status FROM (
    SELECT *, CASE WHEN gate IS NOT NULL THEN 'draft_only' WHEN p IS NULL THEN 'emitted' WHEN change IS NOT NULL THEN 'updated' ELSE 'repeat_suppressed' END AS card_status FROM (
      SELECT *, CASE WHEN p IS NULL THEN NULL WHEN abs(confidence - p.confidence) >= 8 THEN 'material_change:confidence_delta' WHEN abs(priority - p.priority) >= 8 THEN 'material_change:priority_delta'
        WHEN CASE WHEN len(ts) = 0 AND len(p.ts) = 0 THEN 1.0 ELSE len(list_intersect(ts, p.ts)) / len(list_distinct(ts || p.ts))::DOUBLE END <= 0.75 THEN 'material_change:supporting_evidence_shift'
        WHEN assessment_status <> p.st THEN 'material_change:assessment_status_shift' END AS change FROM (
        SELECT o.*, c.live, list_reverse_sort(list_filter(c.live, lambda x: x.us < o.created_at AND x.us >= o.created_at - CASE o.cadence WHEN 'daily' THEN 7 ELSE 28 END * INTERVAL '1' DAY))[1] AS p
        FROM chain c JOIN fresh_order o ON o.theme_key = c.theme_key AND o.narrative_signature = c.narrative_signature AND o.rn = c.rn + 1) z1) z2) z3),
cards AS (SELECT f.*, c.prior_key, c.change, c.card_status FROM chain c JOIN fresh f USING (stable_key))"""


CARDS = cards_sql(H.ENERGY_TO_AGRI)


def cards(spark, sf):
    """Cards of every run, made at their window end, each seeing the emitted ones before it."""
    return cut_lineage(H.emit_cards(H.assessments(bundles(spark, sf)).withColumn("created_at", F.col("window_end"))))


@register("card_gates", with_(*A_, CARDS) + "SELECT stable_key, gate FROM fresh")
def card_gates(spark, sf):
    a = H.assessments(bundles(spark, sf))
    return a.select("stable_key", H.card_gates(a).alias("gate"))


@register("card_fields", with_(*A_, CARDS) + """SELECT stable_key, narrative_signature, 'energy_to_agri_inputs: ' || CASE lens_key WHEN 'input_cost_pass_through' THEN 'Input Cost Pass Through' ELSE 'Capacity Curtailment' END || ' signal' AS title,
  'Window evidence shows ' || len(ts) || ' supporting signals with ' || urgency || ' urgency and ' || time_horizon || ' horizon.' AS what_happened,
  CASE lens_key """ + " ".join(f"WHEN {q(k)} THEN {q('|'.join(v))}" for k, v in V.OPPORTUNITY_TEXT.items()) + """ END AS opportunity_angles, array_to_string(ts, '|') AS supporting_evidence_refs,
  'Track incremental supportive vs contradictory evidence in the next batch window. Key risk watch: ' || CASE lens_key """ + " ".join(f"WHEN {q(k)} THEN {q(v[0])}" for k, v in V.RISK_TEXT.items()) + """ END AS watch_next FROM fresh""")
def card_fields(spark, sf):
    return H.card_fields(H.assessments(bundles(spark, sf))).select("stable_key", "narrative_signature", "title", "what_happened", j("opportunity_angles"), j("supporting_evidence_refs"), "watch_next")


@register("similar_card", with_(*A_, CARDS) + "SELECT stable_key, prior_key AS prior_card_id, change FROM cards")
def similar_card(spark, sf):
    return cards(spark, sf).select("stable_key", "prior_card_id", "change")


@register("emit_cards", with_(*A_, CARDS) + """SELECT stable_key, card_status, CASE WHEN card_status = 'repeat_suppressed' THEN 'duplicate:materially_similar_recent_card' ELSE gate END AS suppression_reason,
  CASE WHEN gate IS NULL THEN change END AS material_update_reason FROM cards""")
def emit_cards(spark, sf):
    return cards(spark, sf).select("stable_key", "card_status", "suppression_reason", "material_update_reason")


_TITLE = "'energy_to_agri_inputs: ' || CASE lens_key WHEN 'input_cost_pass_through' THEN 'Input Cost Pass Through' ELSE 'Capacity Curtailment' END || ' signal'"
_LENS_RANK = "CASE lens_key " + " ".join(f"WHEN '{x['key']}' THEN {i}" for i, x in enumerate(V.LENSES)) + " ELSE 9 END"


@register("briefs", with_(*A_, CARDS) + f"""SELECT {_K}, coalesce(na, 0) AS n_assessments, coalesce(ne, 0) AS n_emitted, coalesce(array_to_string(titles[1:5], '|'), '') AS highlights FROM bund
  LEFT JOIN (SELECT {_K}, count(*) AS na, count(*) FILTER (card_status IN ('emitted', 'updated')) AS ne, list({_TITLE} ORDER BY {_LENS_RANK}) FILTER (card_status IN ('emitted', 'updated')) AS titles FROM cards GROUP BY ALL) c USING ({_K})""")
def briefs(spark, sf):
    return H.briefs(bundles(spark, sf), cards(spark, sf)).select(*H.KEYS, "n_assessments", "n_emitted", "highlights")


@register("run_metrics", with_(*A_, CARDS) + f"""SELECT {_K}, n AS evidence_count, coalesce(na, 0) AS assessment_count, coalesce(na, 0) AS card_count, coalesce(ne, 0) AS emitted_count, coalesce(ns, 0) AS suppressed_count FROM bund
  LEFT JOIN (SELECT {_K}, count(*) AS na, count(*) FILTER (card_status IN ('emitted', 'updated')) AS ne, count(*) FILTER (card_status = 'repeat_suppressed') AS ns FROM cards GROUP BY ALL) c USING ({_K})""")
def run_metrics(spark, sf):
    return H.run_metrics(bundles(spark, sf), cards(spark, sf))


SUPPLY_WATCH = H.Theme("energy_supply_watch", "Energy Supply Watch", energy_markers=("oil", "crude", "lng"), lenses=(V.LENSES[1],), cadences=("daily",),
                       gates={"strength": 20.0, "confidence": 30.0, "priority": 25.0})
THEMES = H.ThemeRegistry()
for _theme in (H.ENERGY_TO_AGRI, SUPPLY_WATCH):
    THEMES.register(_theme)


def _theme_cards(theme):
    ctes = with_(CLAIMS, RAW, EVENTS, match_sql(theme), evid_sql(theme), items_sql(theme), BUNDLES, STRENGTH, fits_sql(theme), cards_sql(theme))
    return f"""SELECT * FROM ({ctes} SELECT theme_key, cadence, window_start, lens_key, stable_key, card_status, prior_key AS prior_card_id, array_to_string(ts, '|') AS supporting_evidence_refs FROM cards)"""


@register("theme_batches", " UNION ALL ".join(_theme_cards(x) for x in THEMES.all()))
def theme_batches(spark, sf):
    """Cards of every registered theme in one run."""
    return read_models.theme_batches(inputs(spark, sf), THEMES.all())["cards"].select(
        "theme_key", "cadence", "window_start", "lens_key", "stable_key", "card_status", "prior_card_id", j("supporting_evidence_refs"))


def _few_bundles(df):
    """Provider hook: bundles of two items at least."""
    return H.bundle_direction(df.filter("n >= 2"))


def _count_scorer(df):
    """Scorer hook: strength by the number of items alone."""
    return df.withColumn("evidence_strength", F.least(F.lit(100.0), F.col("n") * 12.0))


HOOKED = H.Theme("energy_to_agri_inputs", "Scored by a hook", scorer=_count_scorer, provider=_few_bundles)
_HOOK_STRENGTH = f"strong AS (SELECT * REPLACE (least(100.0::DOUBLE, n * 12.0::DOUBLE) AS evidence_strength) FROM {_STRONG} z WHERE n >= 2)"


@register("theme_hooks", with_(*B_, _HOOK_STRENGTH, FITS) + f"SELECT {_K}, lens_key, evidence_strength, round(priority, 6) AS priority, round(confidence, 6) AS confidence FROM assess")
def theme_hooks(spark, sf):
    """Assessments of a theme with its own provider and scorer."""
    return H.assessments(bundles(spark, sf), HOOKED).select(*H.KEYS, "lens_key", "evidence_strength", F.round("priority", 6).alias("priority"), F.round("confidence", 6).alias("confidence"))
