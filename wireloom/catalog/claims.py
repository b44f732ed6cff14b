"""Canonicalisation queries over the claim view."""

from pyspark.sql import functions as F

from . import register
from .base_sql import CLAIMS, RAW, any_of, case_map, first_family, in_list, q, sql_list, squeeze, with_
from ..functions import text as T, vocab as V
from ..operators import canonical as C
from ..sources import fixture as X


def country_sql(x):
    s = squeeze(x)
    return (f"CASE WHEN lower({s}) IN {in_list(V.COUNTRY_ALIASES)} THEN {case_map(f'lower({s})', V.COUNTRY_ALIASES)} "
            f"WHEN {s} = lower({s}) AND {s} <> upper({s}) THEN upper(left({s}, 1)) || substr({s}, 2) ELSE {s} END")


def name_sql(x):
    s = squeeze(x)
    word = (f"CASE WHEN w IN {in_list(V.ACRONYMS)} THEN w WHEN lower(w) IN {in_list(V.SMALL_WORDS)} THEN lower(w) "
            f"WHEN NOT contains({s}, ' ') AND length(w) <= 4 THEN w ELSE upper(left(w, 1)) || lower(substr(w, 2)) END")
    return (f"CASE WHEN lower({s}) IN {in_list(V.PLACEHOLDERS)} THEN '' WHEN {s} = upper({s}) AND {s} <> lower({s}) "
            f"THEN array_to_string(list_transform(string_split({s}, ' '), lambda w: {word}), ' ') ELSE {s} END")


def dedup_list(name, column, expr, order="lower(v)", fold="lower(v)"):
    """CTE: first spelling per folded value, sorted."""
    return f"""{name} AS (
  SELECT claim_id, list(v ORDER BY {order}) AS vals FROM (
    SELECT claim_id, v, row_number() OVER (PARTITION BY claim_id, {fold} ORDER BY pos) AS rn
    FROM (SELECT claim_id, {expr} AS v, pos FROM (SELECT claim_id, unnest({column}) AS x, generate_subscripts({column}, 1) AS pos FROM raw_claims) a) b
    WHERE v <> '') c WHERE rn = 1 GROUP BY claim_id)"""


COUNTRY_L = dedup_list("l_countries", "countries", country_sql("x"))
AFFECTED_L = dedup_list("l_affected", "affected_countries", country_sql("x"))
ORG_L = dedup_list("l_orgs", "orgs", name_sql("x"))
PEOPLE_L = dedup_list("l_people", "people", name_sql("x"))
TICKER_L = dedup_list("l_tickers", "tickers", f"regexp_replace(upper({squeeze('x')}), '[^A-Z0-9.\\-]', '', 'g')", "v", "v")
KEYWORD_L = dedup_list("l_keywords", "keywords", squeeze("x"))
NAMES = """names AS (SELECT r.*, coalesce(a.vals, []) AS c_countries, coalesce(f.vals, []) AS c_affected, coalesce(o.vals, []) AS c_orgs,
  coalesce(p.vals, []) AS c_people, coalesce(t.vals, []) AS c_tickers, coalesce(k.vals, []) AS c_keywords
  FROM raw_claims r LEFT JOIN l_countries a USING (claim_id) LEFT JOIN l_affected f USING (claim_id) LEFT JOIN l_orgs o USING (claim_id)
  LEFT JOIN l_people p USING (claim_id) LEFT JOIN l_tickers t USING (claim_id) LEFT JOIN l_keywords k USING (claim_id))"""
NAME_CTES = (CLAIMS, RAW, COUNTRY_L, AFFECTED_L, ORG_L, PEOPLE_L, TICKER_L, KEYWORD_L, NAMES)
_S = lambda c: f"array_to_string({c}, '|') AS {c}"


@register("canon_names", with_(*NAME_CTES) + f"SELECT claim_id, {_S('c_countries')}, {_S('c_affected')}, {_S('c_orgs')}, {_S('c_people')}, "
          f"{_S('c_tickers')}, {_S('c_keywords')} FROM names")
def canon_names(spark, sf):
    cols = ("c_countries", "c_affected", "c_orgs", "c_people", "c_tickers", "c_keywords")
    return C.canon_names(X.raw_claims(spark, sf)).select("claim_id", *[F.array_join(c, "|").alias(c) for c in cols])


def _vocab_sql(x, values, aliases=None):
    key = f"replace(replace(lower(trim({x})), '-', '_'), ' ', '_')"
    if aliases:
        key = f"coalesce({case_map(key, aliases)}, {key})"
    return f"CASE WHEN {key} IN {in_list(values)} THEN {key} END"


@register("normalize_vocab", with_(CLAIMS, RAW) + f"""SELECT claim_id, {_vocab_sql('event_type_raw', V.EVENT_TYPES)} AS event_type,
  {_vocab_sql('direction_raw', V.DIRECTIONS)} AS direction,
  array_to_string(list_transform(tags, lambda t: coalesce({_vocab_sql('t.tag_type', V.TAG_FAMILIES, V.TAG_FAMILY_ALIASES)}, '?')), '|') AS families,
  array_to_string(list_transform(relations, lambda t: coalesce({_vocab_sql('t.relation_type', V.RELATION_TYPES)}, '?')), '|') AS relation_types,
  array_to_string(list_transform(relations, lambda t: coalesce({_vocab_sql('t.subject_type', V.RELATION_ENTITIES, V.RELATION_ENTITY_ALIASES)}, '?')), '|') AS subject_types
FROM raw_claims""")
def normalize_vocab(spark, sf):
    each = lambda arr, fn: F.array_join(F.transform(arr, lambda t: F.coalesce(fn(t), F.lit("?"))), "|")
    return X.raw_claims(spark, sf).select(
        "claim_id", T.normalize_vocab(F.col("event_type_raw"), V.EVENT_TYPES).alias("event_type"),
        T.normalize_vocab(F.col("direction_raw"), V.DIRECTIONS).alias("direction"),
        each("tags", lambda t: T.normalize_vocab(t["tag_type"], V.TAG_FAMILIES, V.TAG_FAMILY_ALIASES)).alias("families"),
        each("relations", lambda t: T.normalize_vocab(t["relation_type"], V.RELATION_TYPES)).alias("relation_types"),
        each("relations", lambda t: T.normalize_vocab(t["subject_type"], V.RELATION_ENTITIES, V.RELATION_ENTITY_ALIASES)).alias("subject_types"))


ORG_FAMILY_SQL = lambda x: (f"CASE WHEN lower({x}) IN {in_list(V.KNOWN_COMPANIES)} THEN 'companies' "
                            f"WHEN {any_of(f'lower({x})', V.INSTITUTION_MARKERS)} THEN 'organizations' ELSE 'companies' END")


@register("org_family", with_(CLAIMS) + f"SELECT claim_id, org, {ORG_FAMILY_SQL(name_sql('org'))} AS family FROM claims")
def org_family(spark, sf):
    return X.claims(spark, sf).select("claim_id", "org", T.org_family(F.col("org")).alias("family"))


_TAGK = f"list_transform(tags, lambda t: {_vocab_sql('t.tag_type', V.TAG_FAMILIES, V.TAG_FAMILY_ALIASES)})"
_RELK = f"list_transform(relations, lambda t: {_vocab_sql('t.relation_type', V.RELATION_TYPES)})"
DIRECTION = f"""directed AS (
  SELECT *, CASE WHEN norm IS NULL OR NOT ok THEN 'neutral' ELSE norm END AS direction FROM (
    SELECT *, CASE WHEN norm = 'stress' THEN {any_of('lower(summary)', V.STRESS_SUMMARY_WORDS)} OR list_has_any({_TAGK}, {sql_list(V.DIRECTION_TAG_FAMILIES)}) OR list_has_any({_RELK}, {sql_list(V.STRESS_RELATIONS)})
      WHEN norm = 'easing' THEN {any_of('lower(summary)', V.EASING_SUMMARY_WORDS)} OR list_has_any({_TAGK}, {sql_list(V.DIRECTION_TAG_FAMILIES)}) OR list_has_any({_RELK}, {sql_list(V.EASING_RELATIONS)})
      ELSE true END AS ok
    FROM (SELECT *, {_vocab_sql('direction_raw', V.DIRECTIONS)} AS norm FROM names) a) b)"""
DIR_CTES = (*NAME_CTES, DIRECTION)


@register("resolve_direction", with_(*DIR_CTES) + """SELECT claim_id, direction, array_to_string(list_filter([
   CASE WHEN direction_raw IS NOT NULL AND norm IS NULL THEN 'directionality_invalid_dropped' WHEN direction_raw <> norm THEN 'directionality_normalization' END,
   CASE WHEN norm IN ('stress', 'easing') AND NOT ok THEN 'directionality_demoted_without_support' END,
   CASE WHEN norm IS NULL THEN 'directionality_defaulted_neutral' END], lambda r: r IS NOT NULL), '|') AS rules FROM directed""")
def resolve_direction(spark, sf):
    return C.resolve_direction(X.raw_claims(spark, sf)).select("claim_id", "direction", F.array_join("direction_rules", "|").alias("rules"))


_CONF = "CASE WHEN {0} BETWEEN 0 AND 1 THEN {0} END"
TAGS = f"""tag_items AS (
  SELECT claim_id, direction, pos, {_vocab_sql('t.tag_type', V.TAG_FAMILIES, V.TAG_FAMILY_ALIASES)} AS fam, {squeeze('t.tag_value')} AS val,
    {_vocab_sql('t.tag_source', V.ITEM_SOURCES)} AS src, t.confidence AS conf
  FROM (SELECT claim_id, direction, unnest(tags) AS t, generate_subscripts(tags, 1) AS pos FROM directed) a),
tag_settled AS (
  SELECT claim_id, pos, fam, CASE WHEN fam = 'directionality' THEN direction WHEN fam = 'countries' THEN {country_sql('val')} ELSE {name_sql('val')} END AS val,
    CASE WHEN fam = 'directionality' THEN 'inferred' ELSE src END AS src,
    CASE WHEN fam <> 'directionality' THEN {_CONF.format('conf')} END AS conf,
    CASE WHEN fam IS NULL THEN 'invalid_tag_type' WHEN val = '' OR lower(val) IN {in_list(V.PLACEHOLDERS)} THEN 'invalid_tag_value' WHEN src IS NULL THEN 'invalid_tag_source'
      WHEN fam = 'directionality' AND lower(val) NOT IN {in_list(V.DIRECTIONS)} THEN 'invalid_directionality_tag_value' END AS reason FROM tag_items),
tag_all AS (
  SELECT claim_id, 0 AS grp, pos, fam, val, src, conf FROM tag_settled WHERE reason IS NULL
  UNION ALL SELECT claim_id, 1, 0, 'directionality', direction, 'inferred', NULL FROM directed
  UNION ALL SELECT claim_id, 2, 0, 'countries', unnest(c_countries || c_affected), 'observed', NULL FROM directed
  UNION ALL SELECT claim_id, 3, 0, {ORG_FAMILY_SQL('o')}, o, 'observed', NULL FROM (SELECT claim_id, unnest(c_orgs) AS o FROM directed) z),
tag_final AS (
  SELECT * FROM tag_all QUALIFY row_number() OVER (PARTITION BY claim_id, fam, lower(val), src ORDER BY grp, pos, val) = 1)"""
TAG_CTES = (*DIR_CTES, TAGS)


@register("canon_tags", with_(*TAG_CTES) + "SELECT claim_id, fam AS tag_type, val AS tag_value, src AS tag_source, conf AS confidence FROM tag_final")
def canon_tags(spark, sf):
    df = C.canon_tags(C.resolve_direction(C.canon_names(X.raw_claims(spark, sf))))
    return df.select("claim_id", F.explode_outer("canon_tags").alias("t")).filter("t IS NOT NULL").select("claim_id", "t.*")


@register("tag_diagnostics", with_(*TAG_CTES) + """SELECT d.claim_id, len(d.tags) AS emitted, coalesce(v, 0) AS valid, len(d.tags) - coalesce(v, 0) AS dropped,
  coalesce(array_to_string(list_sort(list_distinct(r || CASE WHEN n > v THEN ['duplicate_tag'] ELSE [] END)), '|'), '') AS reasons
FROM directed d LEFT JOIN (SELECT claim_id, count(*) FILTER (reason IS NULL) AS n, count(DISTINCT (fam, lower(val), src)) FILTER (reason IS NULL) AS v,
  coalesce(list(reason) FILTER (reason IS NOT NULL), []) AS r FROM tag_settled GROUP BY 1) s USING (claim_id)""")
def tag_diagnostics(spark, sf):
    df = C.canon_tags(C.resolve_direction(C.canon_names(X.raw_claims(spark, sf))))
    d = F.col("tag_diagnostics")
    return df.select("claim_id", d["emitted"].alias("emitted"), d["valid"].alias("valid"), d["dropped"].alias("dropped"),
                     F.array_join(d["reasons"], "|").alias("reasons"))


_END = lambda kind, val: f"CASE WHEN {kind} IN ('country', 'state') THEN {country_sql(val)} ELSE {name_sql(val)} END"
RELATIONS = f"""rel_items AS (
  SELECT claim_id, pos, {_vocab_sql('r.subject_type', V.RELATION_ENTITIES, V.RELATION_ENTITY_ALIASES)} AS st, {squeeze('r.subject_value')} AS sv,
    {_vocab_sql('r.relation_type', V.RELATION_TYPES)} AS rt, {_vocab_sql('r.object_type', V.RELATION_ENTITIES, V.RELATION_ENTITY_ALIASES)} AS ot,
    {squeeze('r.object_value')} AS ov, {_vocab_sql('r.relation_source', V.ITEM_SOURCES)} AS rs, {_CONF.format('r.confidence')} AS conf
  FROM (SELECT claim_id, unnest(relations) AS r, generate_subscripts(relations, 1) AS pos FROM raw_claims) a),
rel_settled AS (SELECT claim_id, pos, st, {_END('st', 'sv')} AS sv, rt, ot, {_END('ot', 'ov')} AS ov, rs, conf,
  CASE WHEN lower(sv) IN {in_list(V.PLACEHOLDERS)} THEN 'invalid_subject_value' WHEN lower(ov) IN {in_list(V.PLACEHOLDERS)} THEN 'invalid_object_value' END AS reason FROM rel_items),
rel_distinct AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS k FROM (
  SELECT * FROM rel_settled WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY claim_id, st, lower(sv), rt, ot, lower(ov), rs ORDER BY pos) = 1) z)"""


@register("canon_relations", with_(CLAIMS, RAW, RELATIONS) + """SELECT claim_id, st AS subject_type, sv AS subject_value, rt AS relation_type, ot AS object_type,
  ov AS object_value, rs AS relation_source, CASE WHEN rs = 'inferred' THEN 1 ELSE 0 END AS inference_level, conf AS confidence FROM rel_distinct WHERE k <= 3""")
def canon_relations(spark, sf):
    return C.canon_relations(X.raw_claims(spark, sf)).select("claim_id", F.explode_outer("canon_relations").alias("r")).filter("r IS NOT NULL").select("claim_id", "r.*")


@register("relation_diagnostics", with_(CLAIMS, RAW, RELATIONS) + """SELECT c.claim_id, len(c.relations) AS emitted, coalesce(k, 0) AS valid, len(c.relations) - coalesce(k, 0) AS dropped,
  array_to_string(list_sort(coalesce(rs, []) || CASE WHEN hits > k THEN ['duplicate_relation'] ELSE [] END || CASE WHEN d > 3 THEN ['relation_limit_exceeded'] ELSE [] END), '|') AS reasons
FROM raw_claims c LEFT JOIN (SELECT claim_id, least(3, count(*)) AS k, count(*) AS d FROM rel_distinct GROUP BY 1) a USING (claim_id)
LEFT JOIN (SELECT s.claim_id, count(*) AS hits FROM rel_settled s JOIN rel_distinct t ON s.claim_id = t.claim_id AND t.k <= 3 AND s.reason IS NULL
   AND (s.st, lower(s.sv), s.rt, s.ot, lower(s.ov), s.rs) = (t.st, lower(t.sv), t.rt, t.ot, lower(t.ov), t.rs) GROUP BY 1) h USING (claim_id)
LEFT JOIN (SELECT claim_id, list(DISTINCT reason) AS rs FROM rel_settled WHERE reason IS NOT NULL GROUP BY 1) e USING (claim_id)""")
def relation_diagnostics(spark, sf):
    d = F.col("relation_diagnostics")
    return C.canon_relations(X.raw_claims(spark, sf)).select("claim_id", d["emitted"].alias("emitted"), d["valid"].alias("valid"),
                                                             d["dropped"].alias("dropped"), F.array_join(d["reasons"], "|").alias("reasons"))


# half of the sources are made generic and some summaries get a pronoun, so that every branch fires
_SRC = "CASE WHEN user_id % 2 = 0 THEN 'Market News Feed' ELSE source_claimed END"
_SUM = "CASE WHEN claim_id % 5 = 0 THEN 'Officials say they saw ' ELSE 'It was ' END || summary || '.'"
REWRITE = f"""pron AS (SELECT claim_id, {_SUM} AS s, CASE WHEN user_id % 2 = 1 THEN source_claimed END AS src,
    coalesce(CASE WHEN user_id % 2 = 1 THEN source_claimed END, c_orgs[1], c_people[1], c_countries[1]) AS actor FROM (SELECT *, {_SRC} AS z FROM names) a),
pron2 AS (SELECT *, regexp_replace(s, '\\b(it|they|he|she)\\b', actor, 'i') AS p FROM pron),
rewritten AS (SELECT *, {any_of('lower(p)', V.HIGH_RISK_WORDS)} AND NOT {any_of('lower(p)', V.ATTRIBUTION_WORDS)} AS risk FROM pron2)"""


@register("rewrite_summary", with_(*NAME_CTES, REWRITE) + """SELECT claim_id, CASE WHEN risk AND src IS NOT NULL THEN src || ' said ' || lower(rtrim(p, '.')) || '.'
  WHEN risk THEN 'Reportedly, ' || lower(rtrim(p, '.')) || '.' ELSE p END AS safe_summary,
  'summary_pronoun_disambiguated' || CASE WHEN risk THEN '|summary_high_risk_attribution_rewrite' ELSE '' END AS rules FROM rewritten""")
def rewrite_summary(spark, sf):
    df = C.canon_names(X.raw_claims(spark, sf)).withColumns({"source_claimed": F.expr(_SRC), "summary": F.expr(_SUM.replace("||", "||"))})
    return C.rewrite_summary(df).select("claim_id", "safe_summary", F.array_join("summary_rules", "|").alias("rules"))


ACTION_SQL = lambda: first_family("lower(summary || '  ' || array_to_string(keywords, ' '))", V.ACTION_CLASSES, "other")


@register("action_class_bucket", with_(CLAIMS, RAW) + f"SELECT claim_id, {ACTION_SQL()} AS action_class, coalesce(strftime(event_time, '%Y-%m-%d'), 'unknown') AS time_bucket FROM raw_claims")
def action_class_bucket(spark, sf):
    return X.raw_claims(spark, sf).select("claim_id", C.action_class(F.col("summary"), F.col("event_core"), F.col("keywords")).alias("action_class"),
                                          C.time_bucket(F.col("event_time")).alias("time_bucket"))


_TOK = lambda c: f"list_sort(list_distinct(list_transform({c}, lambda v: lower({squeeze('v')}))))"
_JOIN = lambda c: f"CASE WHEN len({c}) = 0 THEN '~' ELSE array_to_string({c}, ',') END"
IDENTITY = f"""ident AS (
  SELECT *, coalesce(list_filter(o || p || c, lambda v: v <> actor)[1], '~') AS target, coalesce(l[1], '~') AS place FROM (
    SELECT *, CASE WHEN src IS NOT NULL THEN lower(src) ELSE coalesce(o[1], p[1], c[1], '~') END AS actor FROM (
      SELECT claim_id, topic, summary, keywords, CASE WHEN claim_id % 3 = 0 THEN NULL ELSE source_claimed END AS src, {ACTION_SQL()} AS ac,
        coalesce(strftime(event_time, '%Y-%m-%d'), 'unknown') AS tb, {_TOK('orgs')} AS o, {_TOK('people')} AS p, {_TOK('countries')} AS c,
        {_TOK('CASE WHEN len(affected_countries) > 0 THEN affected_countries ELSE countries END')} AS l, {_TOK('keywords')}[1:8] AS k FROM raw_claims) a) b)"""


@register("identity_hashes", with_(CLAIMS, RAW, IDENTITY) + f"""SELECT claim_id, CASE WHEN ac <> 'other' OR tb <> 'unknown' THEN 'v2:' || sha256(concat_ws('|', 'v2',
  'event_type=' || CASE WHEN topic IN ('war_security', 'geopolitics') THEN 'conflict_geo' ELSE topic END, 'actor=' || actor, 'target=' || target,
  'action_class=' || ac, 'location_primary=' || place, 'time_bucket=' || tb)) END AS fingerprint_v2,
  sha256(concat_ws('|', 'claim_v1', 'topic=' || topic, 'action_class=' || ac, 'source=' || coalesce(lower(src), '~'), 'summary=' || lower(summary), 'keywords=' || {_JOIN('k')},
  'actors=' || array_to_string(list_sort(list_distinct(o || p))[1:6], ','), 'countries=' || {_JOIN('c[1:6]')}, 'time_bucket=' || tb)) AS claim_hash_v1 FROM ident""")
def identity_hashes(spark, sf):
    df = X.raw_claims(spark, sf).withColumn("source_claimed", F.when(F.col("claim_id") % 3 != 0, F.col("source_claimed")))
    return C.identity(df).select("claim_id", "fingerprint_v2", "claim_hash_v1")


@register("canon_claims")
def canon_claims(spark, sf):
    """Whole canonicalisation with fired rules and payload hash (the hash text is the package's own JSON form)."""
    return C.canon_claims(X.raw_claims(spark, sf)).select(
        "claim_id", "c_event_type", "direction", "safe_summary", "fingerprint_v2", "claim_hash_v1", "payload_hash",
        F.array_join("canon_rules", "|").alias("rules"), F.array_join("c_cues.strategic", "|").alias("strategic"))
