"""Candidate, fold, facet and entity-index queries."""

from pyspark.sql import functions as F

from . import register
from .base_sql import CLAIMS, EVENTS, LINKS, RAW, entity_sig, with_
from ..operators import canonical as C, events as E
from ..sources import fixture as X


def _incoming(spark, sf):
    """Claims whose fingerprint is known, versioned but new, unversioned but new, or missing."""
    c = E.claim_signature(X.raw_claims(spark, sf)).withColumns({"identity_own": F.col("identity"), "u": F.col("user_id") % 9})
    return c.withColumn("event_fingerprint", F.when(F.col("u") < 3, F.col("identity")).when(F.col("u") < 6, F.concat(F.lit("v2:"), F.col("claim_id").cast("string")))
                        .when(F.col("u") == 6, F.concat(F.lit("soft:"), F.col("claim_id").cast("string"))).otherwise(""))


def _stored(spark, sf):
    payload = E.claim_signature(X.raw_claims(spark, sf)).select(F.col("claim_id").alias("latest_claim_id"), "ents", "words", "src")
    return X.events(spark, sf).join(payload, "latest_claim_id")


_SIGS = f"""sigs AS (SELECT *, {entity_sig()} AS ents, list_distinct(list_transform(keywords, lambda k: lower(k))) AS words FROM raw_claims),
stored AS (SELECT e.event_id, e.identity, e.topic, e.event_time, e.last_updated_at, s.ents, s.words, s.source_claimed FROM evs e JOIN sigs s ON s.claim_id = e.latest_claim_id),
incoming AS (SELECT *, CASE WHEN user_id % 9 < 3 THEN identity WHEN user_id % 9 < 6 THEN 'v2:' || claim_id WHEN user_id % 9 = 6 THEN 'soft:' || claim_id ELSE '' END AS fp FROM sigs),
ctx AS (SELECT c.claim_id, e.event_id, e.topic = c.topic AS same_topic, e.last_updated_at FROM incoming c JOIN stored e
    ON e.event_time BETWEEN c.event_time - w.w * INTERVAL '1' HOUR AND c.event_time + w.w * INTERVAL '1' HOUR
  WHERE false)""".replace(""",
ctx AS (SELECT c.claim_id, e.event_id, e.topic = c.topic AS same_topic, e.last_updated_at FROM incoming c JOIN stored e
    ON e.event_time BETWEEN c.event_time - w.w * INTERVAL '1' HOUR AND c.event_time + w.w * INTERVAL '1' HOUR
  WHERE false)""", """,
wide AS (SELECT *, CASE WHEN topic = 'macro_econ' THEN 48 WHEN is_breaking THEN 6 ELSE 24 END AS w FROM incoming WHERE event_time IS NOT NULL AND (fp = '' OR fp LIKE 'v2:%')),
ctx AS (SELECT claim_id, event_id, same_topic, last_updated_at FROM (
  SELECT c.claim_id, e.event_id, e.topic = c.topic AS same_topic, e.last_updated_at, len(list_intersect(c.ents, e.ents)) AS eo, len(list_intersect(c.words, e.words)) AS wo, c.source_claimed = e.source_claimed AS ss
  FROM wide c JOIN stored e ON e.event_time >= c.event_time - c.w * INTERVAL '1' HOUR AND e.event_time <= c.event_time + c.w * INTERVAL '1' HOUR) z
  WHERE eo >= 2 OR (ss AND wo >= 2) OR (eo >= 1 AND wo >= 2)),
near AS (SELECT claim_id, event_id FROM ctx WHERE same_topic QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY last_updated_at DESC, event_id DESC) = 1),
far AS (SELECT claim_id, event_id FROM ctx QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY last_updated_at DESC, event_id DESC) = 1)""")


@register("contextual_match", with_(CLAIMS, RAW, EVENTS, _SIGS) + "SELECT claim_id, event_id FROM near")
def contextual_match(spark, sf):
    c = _incoming(spark, sf).filter((F.col("event_fingerprint") == "") | F.col("event_fingerprint").startswith("v2:"))
    return E.contextual_match(c, _stored(spark, sf), True)


@register("candidate_event", with_(CLAIMS, RAW, EVENTS, _SIGS) + """SELECT i.claim_id, coalesce(s.event_id, n.event_id, CASE WHEN fp LIKE 'v2:%' THEN f.event_id END) AS event_id,
  CASE WHEN s.event_id IS NOT NULL THEN 'identity' WHEN n.event_id IS NOT NULL THEN 'same_topic' WHEN fp LIKE 'v2:%' AND f.event_id IS NOT NULL THEN 'cross_topic' ELSE 'none' END AS match_kind
FROM incoming i LEFT JOIN evs s ON s.identity = i.fp LEFT JOIN near n ON n.claim_id = i.claim_id LEFT JOIN far f ON f.claim_id = i.claim_id""")
def candidate_event(spark, sf):
    return E.candidate_event(_incoming(spark, sf), _stored(spark, sf))


def _fold_input(spark, sf):
    c = X.raw_claims(spark, sf)
    return c.withColumns({"action_class": C.action_class(F.col("summary"), F.col("event_core"), F.col("keywords")), "time_bucket": C.time_bucket(F.col("event_time"))})


from .claims import ACTION_SQL  # noqa: E402

_STEP = """CASE WHEN o.claim_hash = f.claim_hash THEN 'noop' WHEN o.ac <> f.ac THEN 'conflict_action'
  WHEN o.tb <> 'unknown' AND f.tb <> 'unknown' AND abs(date_diff('day', o.tb::DATE, f.tb::DATE)) > 1 THEN 'conflict_bucket' ELSE 'update' END"""


@register("fold_by_identity", with_(CLAIMS, RAW, f"""ordered AS (SELECT claim_id, fingerprint || topic AS fingerprint, coalesce(claim_hash, '') AS claim_hash, {ACTION_SQL()} AS ac,
    CASE WHEN event_time IS NULL THEN 'unknown' ELSE strftime(event_time, '%Y-%m-%d') END AS tb, row_number() OVER (PARTITION BY fingerprint, topic ORDER BY created_at, claim_id) AS rn FROM raw_claims),
fold AS (SELECT claim_id, fingerprint, rn, 'create' AS action, claim_hash, ac, tb FROM ordered WHERE rn = 1
  UNION ALL SELECT claim_id, fingerprint, rn, action, CASE WHEN action = 'update' THEN nh ELSE claim_hash END, ac, CASE WHEN action = 'update' THEN nb ELSE tb END
  FROM (SELECT o.claim_id, o.fingerprint, o.rn, {_STEP} AS action, o.claim_hash AS nh, o.tb AS nb, f.claim_hash, f.ac, f.tb FROM fold f JOIN ordered o ON o.fingerprint = f.fingerprint AND o.rn = f.rn + 1) z)""")
          + "SELECT claim_id, fingerprint, action FROM fold")
def fold_by_identity(spark, sf):
    return E.fold_by_identity(_fold_input(spark, sf).withColumn("fingerprint", F.concat("fingerprint", "topic")))


def fold_claims(spark, sf):
    return E.claim_signature(_fold_input(spark, sf)).withColumns({
        "identity": F.when(F.col("user_id") % 9 < 6, F.concat(F.lit("v2:"), "identity")).otherwise(""), "payload_hash": F.sha2(F.concat_ws("|", "summary", "topic", F.col("impact_score").cast("string")), 256)})


# one claim a step, in order: the state is a keyed recursive table with a row per event, and each event logs its claims
_FOLD_IN = f"""inp AS (SELECT *, row_number() OVER (ORDER BY created_at, claim_id) AS n FROM (SELECT claim_id, created_at, event_time, topic, is_breaking, breaking_window, summary, impact_score, source_claimed, coalesce(claim_hash, '') AS claim_hash, {ACTION_SQL()} AS ac,
    CASE WHEN event_time IS NULL THEN 'unknown' ELSE strftime(event_time, '%Y-%m-%d') END AS tb, CASE WHEN user_id % 9 < 6 THEN 'v2:' || identity ELSE '' END AS fp, concat_ws('|', summary, topic, impact_score::VARCHAR) AS payload,
    {entity_sig()} AS ents, list_distinct(list_transform(keywords, lambda k: lower(k))) AS words, CASE WHEN topic = 'macro_econ' THEN 48 WHEN is_breaking THEN 6 ELSE 24 END * INTERVAL '1' HOUR AS w FROM raw_claims) z)"""
_FOLD = """fold(k, kind, n, event_id, identity, topic, t, last, claim_hash, payload, ac, tb, review, latest, ents, words, src, summary, impact_score, is_breaking, breaking_window, log) USING KEY (k) AS (
  SELECT -1::BIGINT, 0, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::TIMESTAMP, NULL::TIMESTAMP, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT,
    NULL::VARCHAR[], NULL::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, NULL::BOOLEAN, NULL::VARCHAR, NULL::VARCHAR[]
  UNION
  SELECT CASE r.kind WHEN 0 THEN -1 ELSE o.eid END, r.kind, o.n, o.eid, coalesce(o.e_identity, nullif(o.fp, ''), 'soft:' || o.claim_id),
    CASE WHEN takes THEN o.topic ELSE o.e_topic END, CASE WHEN o.action = 'create' THEN coalesce(o.event_time, o.created_at) WHEN takes THEN o.event_time ELSE o.e_t END, CASE WHEN takes THEN o.created_at ELSE o.e_last END,
    CASE WHEN takes THEN o.claim_hash ELSE o.e_claim_hash END, CASE WHEN takes THEN o.payload ELSE o.e_payload END, CASE WHEN takes THEN o.ac ELSE o.e_ac END, CASE WHEN takes THEN o.tb ELSE o.e_tb END,
    CASE WHEN o.action = 'update_conflict' THEN o.why WHEN takes THEN NULL ELSE o.e_review END, o.claim_id, o.ents, o.words, o.source_claimed, CASE WHEN takes THEN o.summary ELSE o.e_summary END,
    CASE WHEN takes THEN o.impact_score ELSE o.e_impact END, CASE WHEN takes THEN o.is_breaking ELSE o.e_brk END, CASE WHEN takes THEN o.breaking_window ELSE o.e_bw END, CASE WHEN r.kind = 1 THEN list_append(coalesce(o.e_log, []), concat_ws('|', o.claim_id, o.action, o.why)) END
  FROM (SELECT *, action = 'create' OR (action = 'update' AND payload <> e_payload) AS takes FROM (
    SELECT *, CASE WHEN action = 'update_conflict' THEN CASE WHEN e_ac <> ac THEN 'conflicting_action_class' ELSE 'material_time_bucket_shift' END END AS why FROM (
    SELECT c.*, b.*, coalesce(b.e_id, c.claim_id) AS eid, CASE WHEN b.e_id IS NULL THEN 'create' WHEN c.fp <> '' AND b.e_identity = c.fp THEN CASE WHEN b.e_claim_hash = c.claim_hash THEN 'noop'
        WHEN b.e_ac <> c.ac OR (b.e_tb <> 'unknown' AND c.tb <> 'unknown' AND abs(date_diff('day', b.e_tb::DATE, c.tb::DATE)) > 1) THEN 'update_conflict' ELSE 'update' END ELSE 'update' END AS action
    FROM (SELECT * FROM inp WHERE n = (SELECT f.n + 1 FROM fold f WHERE f.kind = 0)) c LEFT JOIN (
      SELECT * FROM (SELECT e.event_id AS e_id, e.identity AS e_identity, e.topic AS e_topic, e.t AS e_t, e.last AS e_last, e.claim_hash AS e_claim_hash, e.payload AS e_payload, e.ac AS e_ac, e.tb AS e_tb, e.review AS e_review,
          e.summary AS e_summary, e.impact_score AS e_impact, e.is_breaking AS e_brk, e.breaking_window AS e_bw, e.latest AS e_latest, e.log AS e_log,
          CASE WHEN e.identity = q.fp THEN 0 WHEN e.topic = q.topic THEN 1 WHEN q.fp <> '' THEN 2 END AS how, q.ents AS qe, q.words AS qw, q.source_claimed AS qs, e.ents AS ee, e.words AS ew, e.src AS es
        FROM (SELECT * FROM inp WHERE n = (SELECT f.n + 1 FROM fold f WHERE f.kind = 0)) q JOIN recurring.fold e ON e.kind = 1 AND (e.identity = q.fp OR (e.t BETWEEN q.event_time - q.w AND q.event_time + q.w AND (q.fp <> '' OR e.topic = q.topic)))) z
      WHERE how = 0 OR ((len(list_intersect(qe, ee)) >= 2 OR (len(list_intersect(qw, ew)) >= 2 AND (qs = es OR list_has_any(qe, ee)))))
      ORDER BY how, e_last DESC, e_latest DESC LIMIT 1) b ON true) x) y) o CROSS JOIN (VALUES (0), (1)) r(kind))"""


@register("fold_events_actions", with_(CLAIMS, RAW, _FOLD_IN, _FOLD) + """SELECT split_part(l, '|', 1)::BIGINT AS claim_id, event_id, split_part(l, '|', 2) AS action, nullif(split_part(l, '|', 3), '') AS action_reason
FROM (SELECT event_id, unnest(log) AS l FROM fold WHERE kind = 1) z""")
def fold_events_actions(spark, sf):
    """Order-dependent fold over all claims; also compared with a plain single-list fold in the tests."""
    return E.fold_events(fold_claims(spark, sf))[1]


@register("fold_events_state", with_(CLAIMS, RAW, _FOLD_IN, _FOLD) + """SELECT event_id, identity, topic, latest AS latest_claim_id, ac AS action_class, tb AS time_bucket, review AS review_reason, summary, impact_score, is_breaking, breaking_window FROM fold WHERE kind = 1""")
def fold_events_state(spark, sf):
    return E.fold_events(fold_claims(spark, sf))[0].select("event_id", "identity", "topic", "latest_claim_id", "action_class", "time_bucket", "review_reason", "summary", "impact_score", "is_breaking", "breaking_window")


@register("sync_tags", with_(CLAIMS, RAW, EVENTS) + """, tagrows AS (SELECT e.event_id, unnest(r.tags) AS t, generate_subscripts(r.tags, 1) AS pos FROM evs e JOIN raw_claims r ON r.claim_id = e.latest_claim_id WHERE e.impact_score >= 50)
SELECT event_id, t.tag_type AS tag_type, t.tag_value AS tag_value, t.tag_source AS tag_source FROM tagrows QUALIFY row_number() OVER (PARTITION BY event_id, t.tag_type, lower(t.tag_value), t.tag_source ORDER BY pos) = 1
UNION ALL SELECT event_id, 'commodities', 'Stale', 'observed' FROM evs WHERE NOT coalesce(impact_score >= 50, false)""".replace(")\n, tagrows", "),\ntagrows"))
def sync_tags(spark, sf):
    ev = X.events(spark, sf)
    stale = ev.select("event_id", F.lit("commodities").alias("tag_type"), F.lit("Stale").alias("tag_value"), F.lit("observed").alias("tag_source"))
    new = ev.filter("impact_score >= 50").join(X.raw_claims(spark, sf).select(F.col("claim_id").alias("latest_claim_id"), "tags"), "latest_claim_id").select("event_id", "tags")
    return E.sync_facets(stale, new)


@register("index_entities", with_(CLAIMS, RAW, EVENTS, LINKS, "flat AS (" + " UNION ALL ".join(
    f"SELECT claim_id, topic, is_breaking, event_time, '{k}' AS entity_type, unnest({c}) AS entity_value FROM raw_claims" for k, c in (("country", "countries"), ("org", "orgs"), ("person", "people"), ("ticker", "tickers"))) + ")")
          + "SELECT DISTINCT f.claim_id AS raw_message_id, l.event_id, topic, is_breaking, event_time, entity_type, entity_value FROM flat f JOIN links l ON l.raw_message_id = f.claim_id")
def index_entities(spark, sf):
    return E.index_entities(X.raw_claims(spark, sf).withColumn("raw_message_id", F.col("claim_id")), X.links(spark, sf))
