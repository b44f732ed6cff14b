"""Building blocks for the oracle SQL: the claim view and a few text fragments."""

from __future__ import annotations

from ..functions import vocab as V
from ..sources import fixture as X


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) if v is not None else "NULL" for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def case_map(expr: str, table, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def first_family(text: str, families, default: str) -> str:
    arms = " ".join(f"WHEN {any_of(text, words)} THEN {q(name)}" for name, words in families)
    return f"CASE {arms} ELSE {q(default)} END"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


CLAIMS = f"""claims AS (
  SELECT *, phrase || ' in ' || country || CASE WHEN claim_id % 4 = 0 THEN ', 3% move' ELSE '' END AS summary,
         fingerprint || '|' || topic || '|' || strftime(created_at, '%Y-%m-%d') AS identity
  FROM (SELECT event_id AS claim_id, ts AS created_at, ts AS last_updated_at, user_id,
    CASE WHEN event_id % 17 <> 0 THEN ts - (event_id % 5) * INTERVAL '1' HOUR END AS event_time,
    split_part('{",".join(V.TOPICS)}', ',', CAST(floor(event_id / 6) AS INT) % 12 + 1) AS topic,
    CASE WHEN event_id % 29 <> 0 THEN least(100.0::DOUBLE, value) END AS impact_score,
    CAST((event_id % 10) / 10.0 AS DOUBLE) AS confidence,
    event_id % 6 = 0 AS is_breaking,
    CASE WHEN event_id % 6 <> 0 THEN 'none' ELSE ({sql_list(("15m", "1h", "4h"))})[user_id % 3 + 1] END AS breaking_window,
    ({sql_list(X.PHRASES)})[user_id % 24 + 1] AS phrase,
    ({sql_list(X.COUNTRIES)})[user_id % 5 + 1] AS country,
    ({sql_list(X.ORGS)})[event_id % 8 + 1] AS org,
    'wire ' || (user_id % 7) AS source_claimed,
    'fp-' || (user_id % 60) AS fingerprint,
    CASE WHEN event_id % 3 <> 0 THEN 'c-' || (event_id % 701) END AS claim_hash,
    CASE WHEN event_id % 11 = 0 THEN true WHEN event_id % 11 = 1 THEN NULL ELSE false END AS is_published
  FROM events) b)"""

_TAG = "{{'tag_type': {0}, 'tag_value': {1}, 'tag_source': {2}, 'confidence': CAST({3} AS DOUBLE)}}"
_REL = ("{{'subject_type': {0}, 'subject_value': {1}, 'relation_type': {2}, 'object_type': {3}, "
        "'object_value': {4}, 'relation_source': {5}, 'confidence': CAST({6} AS DOUBLE)}}")


def _opt(cond: str, item: str) -> str:
    return f"CASE WHEN claim_id % {cond} = 0 THEN [{item}] ELSE [] END"


_W = "split_part(phrase, ' ', 1)"
RAW = f"""raw_claims AS (
  SELECT c.*,
    [country] || {_opt("7", "' uae '")} || {_opt("9", "'QATAR'")} AS countries,
    [org] || {_opt("10", "'opec '")} || {_opt("13", "'MINISTRY OF ENERGY'")} AS orgs,
    {_opt("12", "'JOHN  SMITH'")} AS people,
    {_opt("5", "'xom '")} || {_opt("5", "'BP.L'")} || {_opt("10", "'XOM'")} AS tickers,
    {_opt("7", "'uae'")} AS affected_countries,
    string_split(phrase, ' ') AS keywords,
    CASE WHEN claim_id % 4 = 0 THEN 1 ELSE 0 END AS n_stats,
    [{_TAG.format("'commodities'", _W, "'observed'", "0.7")}]
      || {_opt("4", _TAG.format("'Event-Mechanism'", "'SUPPLY SHOCK'", "'Inferred'", "1.5"))}
      || {_opt("6", _TAG.format("'directionality'", "'stress'", "'observed'", "NULL"))}
      || {_opt("10", _TAG.format("'bogus'", "'x'", "'observed'", "NULL"))}
      || {_opt("15", _TAG.format("'strategic'", "'Energy Security'", "'observed'", "0.9"))}
      || {_opt("20", _TAG.format("'commodity'", f"upper({_W})", "'observed'", "NULL"))} AS tags,
    {_opt("3", _REL.format("'country'", "country", "'curtails'", "'commodity'", _W, "'observed'", "0.5"))}
      || {_opt("4", _REL.format("'Org'", "org", "'supports'", "'sector'", "'shipping'", "'inferred'", "NULL"))}
      || {_opt("6", _REL.format("'country'", "upper(country)", "'curtails'", "'commodity'", _W, "'observed'", "NULL"))}
      || {_opt("8", _REL.format("'state'", "'texas'", "'expands-production-of'", "'commodity'", "'natural gas'", "'observed'", "NULL"))}
      || {_opt("12", _REL.format("'sector'", "'grains'", "'input_to'", "'sector'", "'food'", "'observed'", "NULL"))}
      || {_opt("24", _REL.format("'sector'", "'coal'", "'contradicts'", "'sector'", "'power'", "'inferred'", "2.0"))} AS relations,
    {_opt("5", "'b  cue', 'a cue', 'A CUE'")} AS severity,
    {_opt("6", "'x'")} AS economic, {_opt("7", "'y', 'z'")} AS propagation, {_opt("8", "'s'")} AS specificity,
    {_opt("9", "'n'")} AS novelty, {_opt("30", "'chokepoint'")} AS strategic,
    ({sql_list(("Policy", "market", "bogus", None, "SPENDING"))})[claim_id % 5 + 1] AS event_type_raw,
    ({sql_list(("Stress", "easing", "bad", None))})[claim_id % 4 + 1] AS direction_raw
  FROM claims c)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def entity_sig(countries="countries", orgs="orgs", people="people") -> str:
    """Typed entity tokens as a sorted distinct list."""
    part = lambda p, c: f"list_transform({c}, lambda v: '{p}:' || lower(trim(v)))"
    return (f"list_sort(list_distinct({part('country', countries)} || {part('org', orgs)} || {part('person', people)}))")

EVENTS = """evs AS (SELECT min(claim_id) OVER (PARTITION BY identity) AS event_id, identity, created_at AS last_updated_at, claim_id AS latest_claim_id,
    topic, fingerprint, summary, impact_score, confidence, is_breaking, breaking_window, event_time, claim_hash, is_published, country, org, phrase, source_claimed,
    'p-' || sha256(summary) AS payload_hash, coalesce(strftime(event_time, '%Y-%m-%d'), 'unknown') AS time_bucket
  FROM claims QUALIFY row_number() OVER (PARTITION BY identity ORDER BY created_at DESC, claim_id DESC) = 1)"""
LINKS = "links AS (SELECT e.event_id, c.claim_id AS raw_message_id, c.created_at AS linked_at FROM claims c JOIN evs e USING (identity))"
EVENT_TAGS = """tags AS (SELECT event_id, 'commodities' AS tag_type, split_part(phrase, ' ', 1) AS tag_value FROM evs
  UNION ALL SELECT event_id, 'countries', array_to_string(list_transform(string_split(country, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') FROM evs
  UNION ALL SELECT event_id, 'directionality', (['stress', 'easing', 'neutral'])[event_id % 3 + 1] FROM evs)"""
EVENT_RELATIONS = """rels AS (SELECT event_id, 'country' AS subject_type, country AS subject_value, (['curtails', 'supports', 'contradicts'])[event_id % 3 + 1] AS relation_type,
  'commodity' AS object_type, split_part(phrase, ' ', 1) AS object_value FROM evs WHERE latest_claim_id % 3 = 0)"""
CANDIDATES = """cands AS (SELECT event_id, CASE WHEN impact_score >= 80 THEN 'deep_enrich' WHEN impact_score >= 45 THEN 'index_only' ELSE 'store_only' END AS route,
  impact_score >= 60 AS selected, impact_score AS calibrated_score, last_updated_at AS scored_at, fingerprint AS cluster_key FROM evs WHERE impact_score IS NOT NULL)"""
