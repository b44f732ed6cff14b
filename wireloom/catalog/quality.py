"""Audit and maintenance queries; memos, bullets and sources are derived from the claim view and the pages table."""

from pyspark.sql import functions as F

from . import register
from .base_sql import CANDIDATES, CLAIMS, EVENTS, LINKS, RAW, any_of, case_map, in_list, q, sql_list, with_
from .digest import CTES as DIGEST_CTES, digest_layout, source as digest_source
from .claims import ACTION_SQL
from ..functions import vocab as V
from ..operators import quality as Q
from ..sources import fixture as X


def _as_events(spark, sf):
    return X.claims(spark, sf).withColumnRenamed("claim_id", "event_id")


GROUPS = """dup AS (SELECT identity, count(*) AS n_events, count(DISTINCT claim_hash) AS n_claims, min(claim_id) AS survivor_id, CASE WHEN count(DISTINCT claim_hash) = 1 THEN 'exact' ELSE 'conflict' END AS kind
  FROM claims GROUP BY 1 HAVING count(*) > 1),
move AS (SELECT claim_id AS event_id, survivor_id FROM claims JOIN dup USING (identity) WHERE kind = 'exact' AND claim_id <> survivor_id)"""


@register("duplicate_groups", with_(CLAIMS, GROUPS) + "SELECT * FROM dup")
def duplicate_groups(spark, sf):
    return Q.duplicate_groups(_as_events(spark, sf))


def _merged(spark, sf):
    ev = _as_events(spark, sf)
    links = ev.select("event_id", F.col("user_id").alias("raw_message_id"))
    posts = ev.filter("is_published").select("event_id", F.lit("x").alias("destination"))
    return Q.merge_duplicates(ev, links, posts, ev.select("event_id"))


@register("merge_duplicates_events", with_(CLAIMS, GROUPS) + "SELECT claim_id AS event_id, identity FROM claims WHERE claim_id NOT IN (SELECT event_id FROM move)")
def merge_duplicates_events(spark, sf):
    return _merged(spark, sf)[0].select("event_id", "identity")


@register("merge_duplicates_links", with_(CLAIMS, GROUPS) + "SELECT DISTINCT coalesce(survivor_id, claim_id) AS event_id, user_id AS raw_message_id FROM claims LEFT JOIN move ON event_id = claim_id")
def merge_duplicates_links(spark, sf):
    return _merged(spark, sf)[1].select("event_id", "raw_message_id")


@register("merge_duplicates_posts", with_(CLAIMS, GROUPS) + "SELECT coalesce(survivor_id, claim_id) AS event_id, 'x' AS destination FROM claims LEFT JOIN move ON event_id = claim_id WHERE is_published")
def merge_duplicates_posts(spark, sf):
    return _merged(spark, sf)[2].select("event_id", "destination")


@register("uniqueness_audit", with_(CLAIMS) + "SELECT claim_hash, count(*) AS n_rows FROM claims WHERE claim_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def uniqueness_audit(spark, sf):
    return Q.uniqueness_audit(X.claims(spark, sf), ["claim_hash"])


@register("rekey_claims")
def rekey_claims(spark, sf):
    """Full canonicaliser over the table (payload hash uses the package's own JSON form)."""
    c = X.raw_claims(spark, sf).withColumns({"raw_message_id": F.col("claim_id"), "normalized_text": F.col("summary")})
    return Q.rekey_claims(c, "rules", "p1").select("claim_id", "text_hash", "replay_key", "identity_v2", "claim_hash_v1", "payload_hash")


@register("rekey_events", with_(CLAIMS, RAW, EVENTS) + f"""SELECT event_id, identity, CASE WHEN event_id % 4 = 0 THEN identity ELSE fingerprint END AS fingerprint, claim_hash, ac AS action_class FROM (
  SELECT e.event_id, CASE WHEN e.is_breaking THEN CASE WHEN e.event_id % 4 <> 0 THEN e.fingerprint WHEN e.topic = 'fx' THEN 'v2:' || e.latest_claim_id ELSE 'soft:event:' || e.event_id END ELSE e.identity END AS identity, e.fingerprint,
    coalesce(e.claim_hash, 'h' || e.latest_claim_id) AS claim_hash, r.ac FROM evs e JOIN (SELECT claim_id, {ACTION_SQL()} AS ac FROM raw_claims) r ON r.claim_id = e.latest_claim_id) z""")
def rekey_events(spark, sf):
    from ..operators import canonical as C

    ev = X.events(spark, sf).withColumns({
        "identity": F.when(~F.col("is_breaking"), F.col("identity")).otherwise(""), "fingerprint": F.when(F.col("event_id") % 4 != 0, F.col("fingerprint")).otherwise(""), "action_class": F.lit("")})
    c = X.raw_claims(spark, sf).select(
        "claim_id", F.when(F.col("topic") == "fx", F.concat(F.lit("v2:"), F.col("claim_id").cast("string"))).alias("identity_v2"), F.concat(F.lit("h"), F.col("claim_id").cast("string")).alias("claim_hash_v1"),
        F.lit("p").alias("payload_hash"), C.action_class(F.col("summary"), F.col("event_core"), F.col("keywords")).alias("action_class"), F.lit("b").alias("time_bucket"))
    return Q.rekey_events(ev, c).select("event_id", "identity", "fingerprint", "claim_hash", "action_class")


# --- digest bullets with planted faults ------------------------------------------------------------------------------
# the bullets are the digest layout; faults are planted by rule so that every issue occurs
BULLETS = """, bul AS (SELECT window_start AS digest_id, representative_id AS bullet_id, CASE WHEN representative_id % 41 = 0 THEN 'Weather' WHEN representative_id % 43 = 0 THEN 'excluded' ELSE section END AS section,
    CASE WHEN representative_id % 37 = 0 THEN ' !' ELSE summary END AS text,
    CASE WHEN representative_id % 29 = 0 THEN [representative_id, representative_id + 1] WHEN representative_id % 31 = 0 THEN [] ELSE [representative_id] END AS ids FROM layout),
shown AS (SELECT *, trim(regexp_replace(lower(text), '[^\\w\\s]', '', 'g')) AS key FROM bul WHERE section <> 'excluded'),
ids AS (SELECT DISTINCT digest_id, bullet_id, section, unnest(ids) AS event_id FROM bul), used AS (SELECT * FROM ids WHERE section <> 'excluded'), outs AS (SELECT * FROM ids WHERE section = 'excluded'),
s AS (SELECT window_start AS digest_id, event_id FROM src)
"""


@register("audit_digest", (with_(*DIGEST_CTES) + BULLETS).replace(")\n, bul", "),\nbul") + f"""
SELECT DISTINCT digest_id, 'unknown_event' AS code, event_id::VARCHAR AS detail FROM used WHERE (digest_id, event_id) NOT IN (SELECT digest_id, event_id FROM s)
UNION ALL SELECT DISTINCT digest_id, 'excluded_unknown', event_id::VARCHAR FROM outs WHERE (digest_id, event_id) NOT IN (SELECT digest_id, event_id FROM s)
UNION ALL SELECT digest_id, 'event_in_two_bullets', event_id::VARCHAR FROM used GROUP BY digest_id, event_id HAVING count(DISTINCT bullet_id) > 1
UNION ALL SELECT digest_id, 'event_omitted', event_id::VARCHAR FROM s WHERE (digest_id, event_id) NOT IN (SELECT digest_id, event_id FROM ids)
UNION ALL SELECT DISTINCT digest_id, 'excluded_and_used', event_id::VARCHAR FROM used WHERE (digest_id, event_id) IN (SELECT digest_id, event_id FROM outs)
UNION ALL SELECT digest_id, 'text_in_two_places', key FROM shown WHERE key <> '' GROUP BY digest_id, key HAVING count(DISTINCT section) > 1
UNION ALL SELECT digest_id, 'unsupported_label', bullet_id::VARCHAR FROM shown WHERE section <> 'top' AND section NOT IN {in_list(V.TOPIC_LABELS.values())}
UNION ALL SELECT digest_id, 'empty_text', bullet_id::VARCHAR FROM shown WHERE key = '' UNION ALL SELECT digest_id, 'no_source', bullet_id::VARCHAR FROM shown WHERE len(ids) = 0""")
def audit_digest(spark, sf):
    r = F.col("representative_id")
    b = digest_layout(spark, sf).select(
        F.col("window_start").alias("digest_id"), r.alias("bullet_id"), F.when(r % 41 == 0, "Weather").when(r % 43 == 0, "excluded").otherwise(F.col("section")).alias("section"),
        F.when(r % 37 == 0, " !").otherwise(F.col("summary")).alias("text"),
        F.when(r % 29 == 0, F.array(r, r + 1)).when(r % 31 == 0, F.array().cast("array<bigint>")).otherwise(F.array(r)).alias("source_event_ids"))
    return Q.audit_digest(b, digest_source(spark, sf).select(F.col("window_start").alias("digest_id"), "event_id"))


# --- memos -------------------------------------------------------------------------------------------------------------
MEMO_TEXT = {
    "title": "CASE WHEN claim_id % 13 = 0 THEN ' ' ELSE phrase || ' memo' END",
    "core_thesis_one_liner": "CASE WHEN claim_id % 3 = 0 THEN 'Short view on ' || phrase ELSE 'Long ' || phrase || ' repricing in ' || country || ' is driven by supply disruption and by ' || org || ' because stocks stay tight' END",
    "opportunity_target": "CASE user_id % 5 WHEN 0 THEN 'Energy  Markets' WHEN 1 THEN phrase || ' spread' WHEN 2 THEN 'the shipping industry in general' WHEN 3 THEN phrase ELSE 'top 5 names of ' || country END",
    "market_setup": "'The market for ' || phrase || ' in ' || country",
    "background": "CASE WHEN user_id % 7 = 0 THEN 'coal and corn and wheat and urea shipping freight with brent and wti' ELSE 'Background on ' || summary END",
    "primary_driver": "'supply disruption'",
    "why_now": "CASE WHEN claim_id % 4 = 0 THEN 'It is the time' ELSE 'Within the recent window ' || phrase || ' moved across the market and buyers in ' || country || ' reacted' END",
    "why_this_is_an_opportunity": "CASE WHEN claim_id % 6 = 0 THEN 'It is good' ELSE 'The price is mispriced since ' || phrase || ' has not yet reached the valuation of names in ' || country || ' at all' END",
    "trade_expression": "CASE WHEN claim_id % 5 = 0 THEN 'Monitor developments and keep watching the ' || phrase || ' closely over the coming days and weeks' ELSE 'Use futures and options on ' || phrase || ' with a hedge or a benchmark pair and small size' END",
    "conclusion": "'In sum ' || phrase",
}
MEMO_LISTS = {
    "supporting_developments": ["phrase || ' was reported in ' || country || ' today'", "'buyers of ' || phrase || ' react quickly'"],
    "quantified_evidence_points": ["summary || ' on 12 of 30 days'", "CASE WHEN claim_id % 2 = 0 THEN phrase || ' rose 3.5 over the week' ELSE phrase || ' rose over the last week' END"],
    "risks": ["CASE WHEN user_id % 3 = 0 THEN 'stay informed about the ' || phrase ELSE 'demand for ' || phrase || ' may fade' END", "'rules may change in ' || country || ' soon'"],
    "invalidation_triggers": ["'flows of ' || phrase || ' return to normal'"],
    "watchpoints": ["'watch the next report on ' || phrase", "CASE WHEN claim_id % 10 = 0 THEN ' ' ELSE 'watch stocks of all ' || country || ' ports' END"],
}
MEMO_OTHER = {
    "confidence_level": "CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'sure' END",
    "driver_key": "CASE WHEN user_id % 6 = 0 THEN NULL ELSE 'supply_disruption' END", "n_events": "claim_id % 6", "n_sources": "user_id % 5", "n_publishers": "user_id % 3",
    "topic_score": "CAST((user_id % 10) / 10.0 AS DOUBLE)",
}


def memos(spark, sf):
    c = X.claims(spark, sf).withColumn("topic", X._pick(V.MEMO_TOPICS, F.col("user_id") % 9))
    return c.select(F.col("claim_id").alias("memo_id"), "user_id", "topic", *[F.expr(e).alias(n) for n, e in {**MEMO_TEXT, **MEMO_OTHER}.items()],
                    *[F.array(*[F.expr(e) for e in items]).alias(n) for n, items in MEMO_LISTS.items()])


_N = lambda e: f"lower(trim(regexp_replace({e}, '\\s+', ' ', 'g')))"
MEMOS = f"""memos AS (SELECT claim_id AS memo_id, ({sql_list(V.MEMO_TOPICS)})[user_id % 9 + 1] AS topic, {', '.join(f'{_N(e)} AS {n}' for n, e in MEMO_TEXT.items())},
  {', '.join(f'{e} AS {n}' for n, e in MEMO_OTHER.items())}, {', '.join(f"[{', '.join(_N(e) for e in items)}] AS {n}" for n, items in MEMO_LISTS.items())} FROM claims)"""
_WC = lambda c: f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END)"
_NUM = lambda c: f"regexp_matches({c}, '\\b\\d+(\\.\\d+)?\\b')"
_ANCH = lambda c: "CASE topic " + " ".join(f"WHEN {q(t)} THEN {any_of(c, w)}" for t, w in V.TOPIC_KEYWORDS.items()) + " END"
_TEXTS = [s for s in V.MEMO_TEXT_SECTIONS if s != "title"]
_WHOLE = lambda w: f"regexp_matches(alltext, '(^|\\W){w}(\\W|$)')::INT"
DRIFT = f"""memo_all AS (SELECT *, concat_ws(' ', {', '.join(_TEXTS)}, {', '.join(f"array_to_string({s}, ' ')" for s in MEMO_LISTS)}) AS alltext, len(list_filter(quantified_evidence_points, lambda v: {_NUM('v')})) AS points FROM memos),
memo_hits AS (SELECT memo_id, topic, t, n FROM (SELECT memo_id, topic, unnest([{', '.join("{'t': " + q(t) + ", 'n': " + ' + '.join(_WHOLE(w) for w in words) + "}" for t, words in V.TOPIC_KEYWORDS.items())}], recursive := true) FROM memo_all)),
drift AS (SELECT memo_id, CASE WHEN total = 0 THEN false WHEN own = 0 THEN top >= 2 WHEN own = 1 THEN top >= 3 AND total >= 3 ELSE (wide >= 2 AND total >= own + 3) OR (top >= 4 AND total >= own + 4) END AS drifted FROM (
  SELECT memo_id, sum(CASE WHEN t = topic THEN n ELSE 0 END) AS own, max(CASE WHEN t <> topic THEN n END) AS top, sum(CASE WHEN t <> topic THEN n ELSE 0 END) AS total, count(*) FILTER (t <> topic AND n >= 2) AS wide FROM memo_hits GROUP BY 1) z)"""


def _issues():
    t, th = "opportunity_target", "core_thesis_one_liner"
    spec = any_of(t, V.TARGET_WORDS)
    out = [("error", "insufficient_supporting_events", "", "n_events < 3"), ("error", "missing_primary_driver", "", "driver_key IS NULL"), ("error", "insufficient_external_sources", "", "n_sources < 3")]
    out += [("error", "missing_required_section", s, f"{s} = ''") for s in MEMO_TEXT]
    out += [("error", "invalid_confidence_level", "", "confidence_level NOT IN ('low', 'medium', 'high')")]
    for s, (lo, hi) in V.MEMO_LIST_SECTIONS.items():
        out += [("error", "insufficient_list_items", s, f"len({s}) < {lo}"), ("error", "excessive_list_items", s, f"len({s}) > {hi}"), ("error", "missing_required_section", s, f"list_contains({s}, '')"),
                ("error", "filler_list_content", s, f"len(list_filter({s}, lambda v: {_WC('v')} < 5 OR {any_of('v', V.FILLER_PHRASES)})) > 0")]
    out += [("error", "insufficient_quantified_evidence", "", "points < 2"),
            ("error", "generic_opportunity_target", "", f"{_WC(t)} < 3 OR {t} IN {in_list(V.GENERIC_TARGETS)} OR ({any_of(t, V.GENERIC_TARGETS)} AND NOT {spec}) OR (NOT {spec} AND NOT ({_ANCH(t)}) AND NOT {_NUM(t)})"),
            ("error", "weak_core_thesis", "", f"{_WC(th)} < 12 OR NOT ({any_of(th, V.THESIS_DIRECTION_WORDS)} AND {any_of(th, V.THESIS_REASON_WORDS)} AND (({_ANCH(th)}) OR coalesce(contains({th}, replace(driver_key, '_', ' ')), false)))"),
            ("error", "generic_why_now", "", f"{_WC('why_now')} < 12 OR NOT ({any_of('why_now', V.TIMING_WORDS)} OR {_NUM('why_now')})"),
            ("error", "vague_trade_expression", "", f"{_WC('trade_expression')} < 12 OR {any_of('trade_expression', V.VAGUE_TRADE_PHRASES)} OR NOT {any_of('trade_expression', V.TRADE_WORDS)}"),
            ("error", "generic_opportunity_framing", "", f"{_WC('why_this_is_an_opportunity')} < 14 OR NOT {any_of('why_this_is_an_opportunity', V.LOGIC_WORDS)}"),
            ("error", "topic_drift_detected", "", "drifted"), ("warning", "weak_source_diversity", "", "n_publishers < 2 AND n_sources >= 1"),
            ("warning", "novelty_or_selection_borderline", "", "topic_score <= 0.58::DOUBLE + 0.03::DOUBLE"), ("warning", "confidence_evidence_mismatch", "", "confidence_level = 'high' AND points < 3")]
    return " UNION ALL ".join(f"SELECT memo_id, '{sv}' AS severity, '{code}' AS code, '{sec}' AS section FROM memo_j WHERE {cond}" for sv, code, sec, cond in out)


@register("audit_memo_text", with_(CLAIMS, MEMOS, DRIFT, "memo_j AS MATERIALIZED (SELECT * FROM memo_all JOIN drift USING (memo_id))") + _issues())
def audit_memo_text(spark, sf):
    return Q.audit_memo_text(memos(spark, sf))


PARAS = f"""paras AS (SELECT claim_id AS memo_id, user_id, unnest({sql_list(V.MEMO_TRACED_SECTIONS)} || {sql_list(f'{n}[{i}]' for n, items in MEMO_LISTS.items() for i in range(len(items)))}) AS paragraph_key FROM claims),
refs AS (SELECT memo_id, paragraph_key, memo_id + CASE WHEN user_id % 17 = 0 THEN 1 ELSE 0 END AS event_id, NULL::VARCHAR AS source_id FROM paras WHERE NOT (paragraph_key = 'background' AND user_id % 5 = 0)
  UNION ALL SELECT memo_id, paragraph_key, NULL, CASE WHEN user_id % 19 = 0 THEN 'src_99' ELSE 'src_01' END FROM paras WHERE paragraph_key <> 'risks[1]'),
okp AS (SELECT memo_id, paragraph_key FROM refs GROUP BY ALL HAVING count(event_id) > 0 AND count(source_id) > 0)"""


@register("audit_traceability", with_(CLAIMS, PARAS) + """SELECT memo_id, 'missing_traceability' AS code, paragraph_key FROM paras WHERE (memo_id, paragraph_key) NOT IN (SELECT memo_id, paragraph_key FROM okp)
UNION ALL SELECT DISTINCT memo_id, 'invalid_traceability_internal_event_id', paragraph_key FROM refs JOIN okp USING (memo_id, paragraph_key) WHERE event_id <> memo_id
UNION ALL SELECT DISTINCT memo_id, 'invalid_traceability_external_source_id', paragraph_key FROM refs JOIN okp USING (memo_id, paragraph_key) WHERE source_id <> 'src_01'""")
def audit_traceability(spark, sf):
    m = memos(spark, sf)
    p = Q.required_paragraphs(m, "user_id")
    u, k = F.col("user_id"), F.col("paragraph_key")
    inner = p.filter(~((k == "background") & (u % 5 == 0))).select("memo_id", k, (F.col("memo_id") + F.when(u % 17 == 0, 1).otherwise(0)).alias("event_id"), F.lit(None).cast("string").alias("source_id"))
    outer = p.filter(k != "risks[1]").select("memo_id", k, F.lit(None).cast("long").alias("event_id"), F.when(u % 19 == 0, "src_99").otherwise("src_01").alias("source_id"))
    return Q.audit_traceability(m, inner.unionByName(outer), m.select("memo_id", F.col("memo_id").alias("event_id")), m.select("memo_id", F.lit("src_01").alias("source_id")))


@register("clean_sources", """WITH rows AS (SELECT page_id % 50 AS pack_id, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) - 1 AS pos, CASE WHEN page_id % 3 = 0 THEN ' ' ELSE 'p' || page_id END AS sid,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE ' title ' || page_id END AS title, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'about ' || url END AS summary, url FROM pages)
SELECT pack_id, CASE WHEN trim(sid) = '' THEN printf('src_%02d', pos + 1) ELSE sid END AS source_id, 'web' AS source_type, coalesce(trim(title), 'Untitled source') AS title, CASE pos WHEN 0 THEN 'q1' ELSE 'q2' END AS query, summary, 'a' AS tags FROM rows WHERE summary <> ''""")
def clean_sources(spark, sf):
    i = F.col("page_id")
    s = F.struct(F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("p"), i.cast("string"))).alias("source_id"), F.lit(None).cast("string").alias("source_type"),
                 F.when(i % 4 != 0, F.concat(F.lit(" title "), i.cast("string"))).alias("title"), F.lit(" ").alias("publisher"), F.lit("").alias("query"),
                 F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("about "), "url")).alias("summary"), F.array(F.lit(" a "), F.lit(" ")).alias("tags"), F.col("url").alias("url"))
    packs = spark.read.parquet(f"{sf}/pages.parquet").groupBy((i % 50).alias("pack_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", s.alias("s")))), lambda x: x["s"]).alias("sources"))
    return Q.clean_sources(packs, ["q1", "q2"]).select("pack_id", "source_id", "source_type", "title", "query", "summary", F.array_join("tags", "|").alias("tags"))
