"""Topic mapping, ranking and driver queries over daily windows of the event view."""

from pyspark.sql import functions as F

from . import register
from .base_sql import CLAIMS, EVENTS, EVENT_RELATIONS, EVENT_TAGS, RAW, any_of, case_map, first_family, in_list, q, sql_list, with_
from ..functions import vocab as V
from ..operators import topics as O
from ..sources import fixture as X

SNAPS = """snaps AS (SELECT e.event_id, e.event_time, e.last_updated_at, coalesce(e.event_time, e.last_updated_at) AS ts, e.summary, coalesce(e.impact_score, 0) AS impact_score,
    e.identity, e.claim_hash, e.topic, r.keywords, r.countries, r.orgs, r.people, r.tickers, r.n_stats
  FROM evs e LEFT JOIN raw_claims r ON r.claim_id = e.latest_claim_id)"""
_KW = ", ".join(f"({i}, {q(t)}, {q(k)})" for i, t in enumerate(V.MEMO_TOPICS) for k in V.TOPIC_KEYWORDS[t])
_P = "latest_extraction_payload."
MAPPED = f"""kw(o, topic, kw) AS (VALUES {_KW}),
texts AS (SELECT event_id, 1 AS layer, 'event_tags.' || tag_type AS field, lower(tag_value) AS txt FROM tags
  UNION ALL SELECT event_id, 2, 'event_relations.relation_type', relation_type FROM rels UNION ALL SELECT event_id, 2, 'event_relations.subject_value', lower(subject_value) FROM rels
  UNION ALL SELECT event_id, 2, 'event_relations.object_value', lower(object_value) FROM rels
  UNION ALL SELECT event_id, 3, '{_P}summary_1_sentence', lower(summary) FROM snaps UNION ALL SELECT event_id, 3, '{_P}topic', topic FROM snaps
  UNION ALL SELECT event_id, 3, '{_P}keywords', lower(unnest(keywords)) FROM snaps
  {' '.join(f"UNION ALL SELECT event_id, 3, '{_P}entities.{c}', lower(trim(unnest({c}))) FROM snaps" for c in ('countries', 'orgs', 'people', 'tickers'))}
  UNION ALL SELECT event_id, 3, '{_P}market_stats.label', 'move' FROM snaps WHERE n_stats > 0),
hits AS (SELECT event_id, layer, o, topic, field || ':' || kw AS entry FROM texts JOIN kw ON contains(txt, kw)),
best AS (SELECT event_id, layer, topic, string_agg(DISTINCT entry, '|' ORDER BY entry) AS fields FROM hits GROUP BY event_id, layer, topic, o
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY layer, count(*) DESC, o) = 1),
mapped AS (SELECT s.*, b.topic AS mapped_topic, coalesce((['event_tags', 'event_relations', 'latest_extraction_payload'])[b.layer], 'no_match') AS source_layer, coalesce(fields, '') AS fields
  FROM snaps s LEFT JOIN best b USING (event_id))"""
_DTEXT = "lower(concat_ws(' ', summary, array_to_string(keywords, ' '), CASE WHEN relation_type IS NOT NULL THEN relation_type || ' ' || subject_value || ' ' || object_value END))"
_DHITS = "list_filter([" + ", ".join(f"CASE WHEN {any_of(_DTEXT, w)} THEN {q(n)} END" for n, w in V.DRIVERS) + "], lambda d: d IS NOT NULL)"
_TOK = " || ".join(f"list_transform({c}, lambda v: '{c}:' || lower(trim(v)))" for c in ("countries", "orgs", "people", "tickers"))
WIN = f"""win AS (SELECT *, CASE WHEN len(dh) = 0 THEN ['input_cost_pressure'] ELSE dh END AS drivers, 0.5 + 0.5 * frac AS recency FROM (
  SELECT m.*, relation_type, date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL '1' DAY AS window_end, impact_score / 100.0 AS impact,
    (epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400000000.0::DOUBLE AS frac, {_DHITS} AS dh, {_TOK} AS toks,
    {first_family("lower(summary || ' ' || array_to_string(keywords, ' '))", V.DRIVER_HINTS, V.FALLBACK_DRIVER)} AS hint
  FROM mapped m LEFT JOIN rels USING (event_id) WHERE mapped_topic IS NOT NULL) a)"""
CTES = (CLAIMS, RAW, EVENTS, EVENT_TAGS, EVENT_RELATIONS, SNAPS, MAPPED, WIN)
_K = "window_start, window_end, mapped_topic"
_SUM = lambda x: f"sum(({x})::DECIMAL(28,10))::DOUBLE"


def snapshots(spark, sf):
    ev = X.events(spark, sf)
    payload = X.raw_claims(spark, sf).select(F.col("claim_id").alias("latest_claim_id"), "keywords", "countries", "orgs", "people", "tickers", "market_stats")
    return O.event_snapshots(ev, payload, X.event_tags(ev), X.event_relations(ev))


def windows(spark, sf):
    return O.windowed(O.map_topics(snapshots(spark, sf)))


@register("event_snapshots", with_(*CTES[:6]) + """SELECT s.event_id, ts, impact_score, array_to_string(keywords, ' ') AS keywords, n_tags, coalesce(n_rels, 0) AS n_rels FROM snaps s
  JOIN (SELECT event_id, count(*) AS n_tags FROM tags GROUP BY 1) USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS n_rels FROM rels GROUP BY 1) USING (event_id)""")
def event_snapshots(spark, sf):
    return snapshots(spark, sf).select("event_id", "ts", "impact_score", F.array_join("keywords", " ").alias("keywords"), F.size("tags").alias("n_tags"), F.size("relations").alias("n_rels"))


@register("map_topics", with_(*CTES[:7]) + "SELECT event_id, mapped_topic, source_layer, fields FROM mapped")
def map_topics(spark, sf):
    return O.map_topics(snapshots(spark, sf)).select("event_id", "mapped_topic", "source_layer", F.array_join("matched_fields", "|").alias("fields"))


@register("driver_hits", with_(*CTES) + "SELECT event_id, hint, unnest(drivers) AS driver FROM win")
def driver_hits(spark, sf):
    return windows(spark, sf).select("event_id", "hint", F.explode("drivers").alias("driver"))


VOLUME = f"""vol AS (SELECT *, event_count / max(event_count) OVER (PARTITION BY window_start)::DOUBLE AS count_share,
  CASE WHEN max(weighted_raw) OVER (PARTITION BY window_start) > 0 THEN weighted_raw / max(weighted_raw) OVER (PARTITION BY window_start) ELSE 0 END AS weighted_share
  FROM (SELECT {_K}, count(*) AS event_count, {_SUM('impact * recency')} AS weighted_raw FROM win GROUP BY ALL) v)"""


@register("topic_volume", with_(*CTES, VOLUME) + f"SELECT {_K}, event_count, round(weighted_raw, 6) AS weighted_raw, round(count_share, 6) AS count_share, round(weighted_share, 6) AS weighted_share FROM vol")
def topic_volume(spark, sf):
    r = [F.round(c, 6).alias(c) for c in ("weighted_raw", "count_share", "weighted_share")]
    return O.topic_volume(windows(spark, sf)).select(*O.KEYS, "event_count", *r)


_SHARE = lambda name, src, keys=_K: f"{name} AS (SELECT {keys}, max(c) / sum(c)::DOUBLE AS share FROM (SELECT {keys}, tok, count(*) AS c FROM ({src}) x GROUP BY ALL) y GROUP BY ALL)"
COHERENCE = ",\n".join([
    _SHARE("sh_e", f"SELECT {_K}, unnest(toks) AS tok FROM win UNION ALL SELECT {_K}, 'tag:' || lower(tag_value) FROM win JOIN tags USING (event_id)"),
    _SHARE("sh_r", f"SELECT {_K}, relation_type AS tok FROM win WHERE relation_type IS NOT NULL"), _SHARE("sh_d", f"SELECT {_K}, hint AS tok FROM win"),
    f"coh AS (SELECT {_K}, coalesce(e.share, 0) * 0.45::DOUBLE + coalesce(r.share, 0) * 0.35::DOUBLE + d.share * 0.20::DOUBLE AS coherence FROM sh_d d LEFT JOIN sh_e e USING ({_K}) LEFT JOIN sh_r r USING ({_K}))"])


@register("topic_coherence", with_(*CTES, COHERENCE) + f"SELECT {_K}, round(coherence, 6) AS coherence FROM coh")
def topic_coherence(spark, sf):
    return O.topic_coherence(windows(spark, sf)).withColumn("coherence", F.round("coherence", 6))


ACTION = f"""act AS (SELECT {_K}, CASE WHEN a >= 0.65 THEN 0.40 WHEN a >= 0.50 THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN n >= 3 THEN 0.25 WHEN n = 2 THEN 0.15 ELSE 0.05 END::DOUBLE
    + CASE WHEN has_act THEN 0.20 ELSE 0 END::DOUBLE + CASE WHEN late / n::DOUBLE >= 0.40 THEN 0.15 ELSE 0 END::DOUBLE AS actionability
  FROM (SELECT {_K}, count(*) AS n, {_SUM('impact')} / count(*) AS a, coalesce(bool_or(relation_type IN {in_list(V.ACTIONABLE_RELATIONS)}), false) AS has_act, count(*) FILTER (frac >= 0.75) AS late FROM win GROUP BY ALL) g)"""


@register("topic_actionability", with_(*CTES, ACTION) + f"SELECT {_K}, round(actionability, 6) AS actionability FROM act")
def topic_actionability(spark, sf):
    return O.topic_actionability(windows(spark, sf)).withColumn("actionability", F.round("actionability", 6))


RUNS = f"""runs AS (SELECT DISTINCT date_trunc('day', created_at)::TIMESTAMP + INTERVAL '12' HOUR AS completed_at, ({sql_list(V.MEMO_TOPICS)})[day(created_at) % 9 + 1] AS selected_topic FROM claims)"""
NOVELTY = f"""ikeys AS (SELECT DISTINCT {_K}, 'identity:' || identity AS k FROM win),
recent AS (SELECT DISTINCT w.window_start, selected_topic AS mapped_topic FROM (SELECT DISTINCT window_start, window_end FROM win) w JOIN runs ON completed_at >= w.window_start - INTERVAL '1' DAY AND completed_at < w.window_end),
nov AS (SELECT {_K}, greatest(0, 1 - count(p.k) / count(*)::DOUBLE - CASE WHEN bool_or(r.mapped_topic IS NOT NULL) THEN 0.15 ELSE 0 END::DOUBLE) AS novelty FROM ikeys i
  LEFT JOIN (SELECT window_end AS ws, mapped_topic AS mt, k FROM ikeys) p ON p.ws = i.window_start AND p.mt = i.mapped_topic AND p.k = i.k LEFT JOIN recent r USING (window_start, mapped_topic) GROUP BY {_K})"""


def _runs(spark, sf):
    day = F.to_date("created_at")
    return X.claims(spark, sf).select(day.alias("d")).distinct().select(
        F.timestamp_add("HOUR", F.lit(12), F.col("d").cast("timestamp_ntz")).alias("completed_at"), X._pick(V.MEMO_TOPICS, F.dayofmonth("d") % 9).alias("selected_topic"), F.lit("completed").alias("status"))


@register("topic_novelty", with_(*CTES, RUNS, NOVELTY) + f"SELECT {_K}, round(novelty, 6) AS novelty FROM nov")
def topic_novelty(spark, sf):
    w = windows(spark, sf)
    return O.topic_novelty(w, O.recent_memo_topics(w, _runs(spark, sf))).withColumn("novelty", F.round("novelty", 6))


RANKED = f"""topics(mapped_topic) AS (VALUES {', '.join(f'({q(t)})' for t in V.MEMO_TOPICS)}),
ids AS (SELECT {_K}, string_agg(event_id, ',' ORDER BY p) AS candidate_ids FROM (SELECT *, row_number() OVER (PARTITION BY window_start, mapped_topic ORDER BY impact_score DESC, ts DESC, event_id) AS p FROM win) z WHERE p <= 20 GROUP BY {_K}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY topic_score DESC, event_count DESC, mapped_topic) AS rank FROM (
  SELECT {_K}, round(coalesce(count_share, 0) * 0.30::DOUBLE + coalesce(weighted_share, 0) * 0.25::DOUBLE + coalesce(novelty, 0) * 0.20::DOUBLE + coalesce(coherence, 0) * 0.15::DOUBLE + coalesce(actionability, 0) * 0.10::DOUBLE, 6) AS topic_score,
    coalesce(event_count, 0) AS event_count, round(coalesce(novelty, 0), 6) AS novelty, round(coalesce(coherence, 0), 6) AS coherence, coalesce(candidate_ids, '') AS candidate_ids
  FROM (SELECT DISTINCT window_start, window_end FROM win) w CROSS JOIN topics LEFT JOIN vol USING ({_K}) LEFT JOIN nov USING ({_K}) LEFT JOIN coh USING ({_K}) LEFT JOIN act USING ({_K}) LEFT JOIN ids USING ({_K})) s)"""
RANK_CTES = (*CTES, RUNS, VOLUME, NOVELTY, COHERENCE, ACTION, RANKED)


def ranking(spark, sf, limit=20):
    w = windows(spark, sf)
    return O.rank_topics(w, O.recent_memo_topics(w, _runs(spark, sf)), limit)


@register("rank_topics", with_(*RANK_CTES) + f"SELECT {_K}, topic_score, event_count, novelty, coherence, candidate_ids, rank FROM ranked")
def rank_topics(spark, sf):
    return ranking(spark, sf).select(*O.KEYS, "topic_score", "event_count", "novelty", "coherence", F.array_join("candidate_ids", ",").alias("candidate_ids"), "rank")


@register("select_topic", with_(*RANK_CTES) + """SELECT window_start, window_end, CASE WHEN topic_score >= 0.58 THEN mapped_topic END AS selected_topic, CASE WHEN topic_score >= 0.58 THEN topic_score END AS topic_score,
  CASE WHEN topic_score >= 0.58 THEN 'auto_selection_threshold_passed' ELSE 'no_topic_found' END AS selection_reason FROM ranked WHERE rank = 1""")
def select_topic(spark, sf):
    return O.select_topic(ranking(spark, sf))


DRIVERS = ",\n".join([
    f"supp AS (SELECT *, unnest(drivers) AS driver FROM win)", _SHARE("sh_x", f"SELECT {_K}, driver, unnest(toks) AS tok FROM supp", f"{_K}, driver"),
    f"dnames(driver) AS (VALUES {', '.join(f'({q(d)})' for d, _ in V.DRIVERS)})",
    f"""dsc AS (SELECT {_K}, driver, n AS supporting_events, round(sw * 0.40::DOUBLE + td * 0.25::DOUBLE + ec * 0.20::DOUBLE + cf * 0.15::DOUBLE, 6) AS score, round(sw, 6) AS support_weight, round(td, 6) AS temporal_density,
      round(ec, 6) AS entity_consistency, round(cf, 6) AS confirmability FROM (
    SELECT {_K}, driver, coalesce(n, 0) AS n, CASE WHEN n > 0 AND total > 0 THEN least(1, s / total) ELSE 0 END::DOUBLE AS sw,
      CASE WHEN n IS NULL THEN 0 WHEN n = 1 THEN 0.35 ELSE least(1, n / greatest(1, greatest(1, spread / 3600000000.0::DOUBLE) / 12) / 2.5::DOUBLE) END::DOUBLE AS td,
      CASE WHEN n IS NULL THEN 0 ELSE coalesce(share, 0.30) END::DOUBLE AS ec,
      CASE WHEN n IS NULL THEN 0 ELSE CASE WHEN n >= 2 THEN 0.5 ELSE 0.3 END::DOUBLE + CASE WHEN conf THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN s / n >= 0.6 THEN 0.2 ELSE 0 END::DOUBLE END::DOUBLE AS cf
    FROM (SELECT {_K}, {_SUM('impact')} AS total FROM win GROUP BY ALL) t CROSS JOIN dnames
    LEFT JOIN (SELECT {_K}, driver, count(*) AS n, {_SUM('impact')} AS s, max(epoch_us(ts)) - min(epoch_us(ts)) AS spread, coalesce(bool_or(relation_type IN {in_list(V.CONFIRMABLE_RELATIONS)}), false) AS conf FROM supp GROUP BY ALL) g USING ({_K}, driver)
    LEFT JOIN sh_x USING ({_K}, driver)) z)""",
    f"prim AS (SELECT * FROM dsc QUALIFY row_number() OVER (PARTITION BY window_start, mapped_topic ORDER BY score DESC, supporting_events DESC, driver) = 1)"])


@register("driver_scores", with_(*CTES, DRIVERS) + "SELECT * FROM dsc")
def driver_scores(spark, sf):
    return O.driver_scores(windows(spark, sf))


@register("primary_driver", with_(*CTES, DRIVERS) + f"SELECT {_K}, driver, score, supporting_events FROM prim WHERE score > 0 AND supporting_events > 0")
def primary_driver(spark, sf):
    return O.primary_driver(O.driver_scores(windows(spark, sf))).select(*O.KEYS, "driver", "score", "supporting_events")


@register("driver_share", with_(*CTES, DRIVERS) + f"SELECT {_K}, driver, n AS selected_events, supporting_events, round(supporting_events / n::DOUBLE, 6) AS supporting_share FROM prim JOIN (SELECT {_K}, count(*) AS n FROM win GROUP BY ALL) USING ({_K})")
def driver_share(spark, sf):
    w = windows(spark, sf)
    return O.driver_share(w, O.primary_driver(O.driver_scores(w)))


@register("topic_stats", with_(*CTES) + f"""SELECT {_K}, count(*) AS event_count, round({_SUM('impact_score * recency')}, 4) AS weighted_impact_score, round({_SUM('impact_score')} / count(*), 4) AS average_impact_score,
  round(max(impact_score), 4) AS max_impact_score, count(*) FILTER (frac >= 2.0::DOUBLE / 3) AS recent_event_count FROM win GROUP BY ALL""")
def topic_stats(spark, sf):
    return O.topic_stats(windows(spark, sf))


@register("supporting_entities", with_(*CTES) + f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start, mapped_topic ORDER BY n DESC, kind, lower(value), value) AS position FROM (
  SELECT {_K}, kind, value, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT {_K}, '{k}' AS kind, trim(unnest({c})) AS value FROM win" for c, k in (('countries', 'countrie'), ('orgs', 'org'), ('people', 'people'), ('tickers', 'ticker')))}) a GROUP BY ALL) b) c WHERE position <= 10""")
def supporting_entities(spark, sf):
    return O.supporting_entities(windows(spark, sf))


@register("topic_timeline", with_(*CTES) + f"SELECT {_K}, position, event_id, ts, summary, impact_score FROM (SELECT *, row_number() OVER (PARTITION BY window_start, mapped_topic ORDER BY ts, event_id) AS position FROM win) z WHERE position <= 5")
def topic_timeline(spark, sf):
    return O.topic_timeline(windows(spark, sf), 5)


@register("memo_input_events", with_(*CTES, DRIVERS) + f"""SELECT {_K}, event_id, row_number() OVER (PARTITION BY window_start, mapped_topic ORDER BY impact_score DESC, ts, event_id) - 1 AS position_index,
  coalesce(list_contains(drivers, p.driver), false) AS driver_supporting FROM win LEFT JOIN (SELECT {_K}, driver FROM prim) p USING ({_K})""")
def memo_input_events(spark, sf):
    w = windows(spark, sf)
    return O.memo_input_events(w, O.primary_driver(O.driver_scores(w)))


@register("fact_candidates", with_(*CTES) + f"""SELECT {_K}, position, fact_key, fact_text, numeric_value, unit FROM (SELECT *, row_number() OVER (PARTITION BY window_start, mapped_topic ORDER BY fact_key) AS position FROM (
  SELECT {_K}, 'event_' || event_id || '_summary' AS fact_key, 'Event ' || event_id || ' impact score ' || round(impact_score::DECIMAL(18,6), 1)::DECIMAL(18,1) || ': ' || summary AS fact_text, round(impact_score, 2) AS numeric_value, 'impact_score' AS unit FROM win
  UNION ALL SELECT {_K}, 'event_' || event_id || '_market_stat_0', 'Event ' || event_id || ' market stat move: 3.000 %.', 3.0, '%' FROM win WHERE n_stats > 0) a) b WHERE position <= 12""")
def fact_candidates(spark, sf):
    return O.fact_candidates(windows(spark, sf))
