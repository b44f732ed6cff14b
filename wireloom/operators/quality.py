"""Duplicate identity groups, merges, uniqueness and re-keying, and audits of digests and memos."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vocab as V
from ..session import shuffled
from ..sources.messages import content_keys
from .canonical import canon_claims
from .digest import topic_label


MEMOS = 10_000  # memos whose references one task sorts


def duplicate_groups(events: DataFrame) -> DataFrame:
    """Identities with more than one event: ``exact`` when they agree on one claim hash, else ``conflict``."""
    g = events.filter(F.col("identity").isNotNull()).groupBy("identity").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct(F.nullif("claim_hash", F.lit(""))).alias("n_claims"), F.min("event_id").alias("survivor_id"))
    return g.filter("n_events > 1").withColumn("kind", F.when(F.col("n_claims") == 1, "exact").otherwise("conflict"))


def merge_duplicates(events: DataFrame, links: DataFrame, posts: DataFrame, cands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Exact duplicates fold into the smallest id: (events, links, posts, candidates) afterwards."""
    exact = duplicate_groups(events).filter("kind = 'exact'").select("identity", "survivor_id")
    move = events.select("event_id", "identity").join(exact, "identity").filter("event_id <> survivor_id").select("event_id", "survivor_id")

    def repoint(df: DataFrame) -> DataFrame:
        return df.join(move, "event_id", "left").withColumn("event_id", F.coalesce("survivor_id", "event_id")).drop("survivor_id")

    return (events.join(move, "event_id", "left_anti"), repoint(links).dropDuplicates(["event_id", "raw_message_id"]), repoint(posts),
            cands.join(move, "event_id", "left_anti"))


def uniqueness_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def rekey_claims(claims: DataFrame, extractor: str, prompt: str) -> DataFrame:
    """Claims re-keyed by the current canonicaliser: text hash, replay key, payload and claim hash, identity."""
    df = content_keys(canon_claims(claims), extractor, prompt)
    return df.withColumn("identity_v2", F.coalesce("fingerprint_v2", F.nullif("fingerprint", F.lit("")), F.concat(F.lit("soft:"), F.col("raw_message_id").cast("string"))))


def rekey_events(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Event identity falls back along identity, fingerprint, latest claim, ``soft:event:{id}``; hashes are filled from the claim."""
    c = claims.select(F.col("claim_id").alias("latest_claim_id"), *[F.col(x).alias(f"_{x}") for x in ("identity_v2", "claim_hash_v1", "payload_hash", "action_class", "time_bucket")])
    df = events.join(c, "latest_claim_id", "left")
    full = lambda x: F.nullif(F.col(x), F.lit(""))
    ident = F.coalesce(full("identity"), full("fingerprint"), full("_identity_v2"), F.concat(F.lit("soft:event:"), F.col("event_id").cast("string")))
    return df.withColumns({
        "identity": ident, "fingerprint": F.coalesce(full("fingerprint"), ident), "claim_hash": F.coalesce(full("claim_hash"), "_claim_hash_v1"),
        "payload_hash": F.coalesce(full("payload_hash"), "_payload_hash"), "action_class": F.coalesce(full("action_class"), "_action_class"),
        "time_bucket": F.coalesce(full("time_bucket"), "_time_bucket")}).select(*events.columns)


def audit_digest(bullets: DataFrame, source: DataFrame) -> DataFrame:
    """Issues (digest_id, code, detail) of proposed bullets against their source events.

    ``bullets``: digest_id, bullet_id, section (``top``, a label, or ``excluded``), text, source_event_ids;
    ``source``: digest_id, event_id.
    """
    shown = bullets.filter("section <> 'excluded'").withColumn("key", T.compare_key(F.col("text")))
    ids = bullets.select("digest_id", "bullet_id", "section", F.explode(F.array_distinct("source_event_ids")).alias("event_id"))
    used, out = ids.filter("section <> 'excluded'"), ids.filter("section = 'excluded'").select("digest_id", "event_id").distinct()
    pair = ["digest_id", "event_id"]
    issue = lambda df, code, detail: df.select("digest_id", F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    eid = F.col("event_id")
    label = topic_label(F.col("section"))
    n_places = shown.filter("key <> ''").groupBy("digest_id", "key").agg(F.countDistinct("section").alias("n"))
    parts = [
        issue(used.join(source, pair, "left_anti").select(*pair).distinct(), "unknown_event", eid),
        issue(out.join(source, pair, "left_anti"), "excluded_unknown", eid),
        issue(used.groupBy(*pair).agg(F.countDistinct("bullet_id").alias("n")).filter("n > 1"), "event_in_two_bullets", eid),
        issue(source.join(used, pair, "left_anti").join(out, pair, "left_anti"), "event_omitted", eid),
        issue(used.join(out, pair, "left_semi").select(*pair).distinct(), "excluded_and_used", eid),
        issue(n_places.filter("n > 1"), "text_in_two_places", F.col("key")),
        issue(shown.filter((F.col("section") != "top") & ~label.isin(*V.TOPIC_LABELS.values())), "unsupported_label", F.col("bullet_id")),
        issue(shown.filter("key = ''"), "empty_text", F.col("bullet_id")),
        issue(shown.filter(F.size("source_event_ids") == 0), "no_source", F.col("bullet_id"))]
    return reduce(DataFrame.unionByName, parts)


def required_paragraphs(memos: DataFrame, *carry: str) -> DataFrame:
    """(memo_id, ``carry``, paragraph_key) that must be traced: fixed sections and every list item."""
    lists = [F.transform(F.col(name), _item_key(name)) for name in V.MEMO_LIST_SECTIONS]
    return memos.select("memo_id", *carry, F.explode(F.concat(T.lit_array(V.MEMO_TRACED_SECTIONS), *lists)).alias("paragraph_key"))


def _item_key(name: str):
    return lambda v, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))


def audit_traceability(memos: DataFrame, refs: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """Issues (memo_id, code, paragraph_key): each required paragraph needs an internal and an external reference, and
    references must exist. ``refs``: memo_id, paragraph_key, event_id, source_id in long form (one of the two set);
    ``events``/``sources``: memo_id with the allowed ids."""
    key = ["memo_id", "paragraph_key"]

    # internal and external references are one kind of row, so they are sorted for one join only
    inner, outer = (lambda c: F.concat(F.lit("e"), c.cast("string"))), (lambda c: F.concat(F.lit("s"), c))
    named = refs.select(*key, F.explode(F.array_compact(F.array(inner(F.col("event_id")), outer(F.col("source_id"))))).alias("ref"))
    allowed = events.select("memo_id", inner(F.col("event_id")).alias("ref")).unionByName(sources.select("memo_id", outer(F.col("source_id")).alias("ref")))
    # a memo names an id in many paragraphs; it is looked up once
    unknown = named.select("memo_id", "ref").distinct().join(shuffled(allowed), ["memo_id", "ref"], "left_anti")
    # such rows pack so well that partitions sized by their packed bytes would each hold millions of rows
    parts = max(refs.sparkSession.sparkContext.defaultParallelism, -(-memos.count() // MEMOS))
    deal = lambda df: df.repartition(parts, "memo_id", "ref")
    found = deal(named).join(shuffled(deal(unknown.withColumn("bad", F.lit(True)))), ["memo_id", "ref"], "left")
    internal = F.col("ref").startswith("e")
    found = found.select(*key, F.lit(False).alias("need"), internal.alias("in"), (~internal).alias("out"),
                         (internal & F.col("bad")).alias("no_in"), (~internal & F.col("bad")).alias("no_out"))
    need = required_paragraphs(memos).select(*key, F.lit(True).alias("need"), *[F.lit(False).alias(c) for c in ("in", "out", "no_in", "no_out")])
    has = lambda c: F.coalesce(F.max(c), F.lit(False)).alias(c)
    by = found.unionByName(need).groupBy(*key).agg(*[has(c) for c in ("need", "in", "out", "no_in", "no_out")]).filter("need").withColumn("complete", F.col("in") & F.col("out"))
    codes = F.array_compact(F.array(
        F.when(~F.col("complete"), "missing_traceability"), F.when(F.col("complete") & F.col("no_in"), "invalid_traceability_internal_event_id"),
        F.when(F.col("complete") & F.col("no_out"), "invalid_traceability_external_source_id")))
    return by.select("memo_id", F.explode(codes).alias("code"), "paragraph_key")


def _word_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def audit_memo_text(memos: DataFrame, min_events: int = 3, min_sources: int = 3, threshold: float = V.TOPIC_THRESHOLD) -> DataFrame:
    """Text rule issues (memo_id, severity, code, section) of a memo table.

    Needs memo_id, topic, driver_key, confidence_level, n_events, n_sources, n_publishers, topic_score, the text and the
    list sections.
    """
    low = {s: T.squeezed_lower(F.col(s)) for s in V.MEMO_TEXT_SECTIONS}
    df = memos.withColumns({f"_{s}": c for s, c in low.items()} | {f"_{s}": F.transform(F.coalesce(s, F.array().cast("array<string>")), T.squeezed_lower) for s in V.MEMO_LIST_SECTIONS})
    sec = lambda s: F.col(f"_{s}")
    number = r"\b\d+(?:\.\d+)?\b"
    any_topic_word = None
    for topic, words in V.TOPIC_KEYWORDS.items():
        arm = (F.col("topic") == topic)
        any_topic_word = F.when(arm, T.lit_array(words)) if any_topic_word is None else any_topic_word.when(arm, T.lit_array(words))
    df = df.withColumn("_words", any_topic_word)
    anchored = lambda c: F.coalesce(F.exists("_words", lambda w: F.contains(c, w)), F.lit(False))
    target, thesis = sec("opportunity_target"), sec("core_thesis_one_liner")
    exact = target.isin(*V.GENERIC_TARGETS)
    specific = T.has_any(target, V.TARGET_WORDS)
    generic = (_word_count(target) < 3) | exact | (T.has_any(target, V.GENERIC_TARGETS) & ~specific) | (~specific & ~anchored(target) & ~target.rlike(number))
    driver = F.replace(F.coalesce("driver_key", F.lit("")), F.lit("_"), F.lit(" "))
    weak = (_word_count(thesis) < 12) | ~(T.has_any(thesis, V.THESIS_DIRECTION_WORDS) & T.has_any(thesis, V.THESIS_REASON_WORDS)
                                         & (anchored(thesis) | ((driver != "") & F.contains(thesis, driver))))
    now, trade, why = sec("why_now"), sec("trade_expression"), sec("why_this_is_an_opportunity")
    points = F.size(F.filter(sec("quantified_evidence_points"), lambda v: v.rlike(number)))
    texts = [s for s in V.MEMO_TEXT_SECTIONS if s not in V.MEMO_UNTRACED_SECTIONS]
    df = df.withColumn("_all", F.concat_ws(" ", *[sec(s) for s in texts], *[F.array_join(sec(s), " ") for s in V.MEMO_LIST_SECTIONS]))
    # the plain search spares most rows the word border test
    whole = lambda w: F.contains("_all", F.lit(w)) & F.col("_all").rlike(rf"(?U)(?<!\w)\Q{w}\E(?!\w)")
    counts = {t: sum((whole(w).cast("int") for w in words), F.lit(0)) for t, words in V.TOPIC_KEYWORDS.items()}
    df = df.withColumn("_hits", F.array(*[F.struct(F.lit(t).alias("t"), c.alias("n")) for t, c in counts.items()]))
    own = F.coalesce(F.get(F.transform(F.filter("_hits", lambda h: h["t"] == F.col("topic")), lambda h: h["n"]), 0), F.lit(0))
    df = df.withColumns({"_own": own, "_other": F.transform(F.filter("_hits", lambda h: h["t"] != F.col("topic")), lambda h: h["n"])})
    top, total = F.array_max("_other"), F.aggregate("_other", F.lit(0), lambda a, x: a + x)
    wide = F.size(F.filter("_other", lambda n: n >= 2))
    drift = (F.when(total == 0, False).when(F.col("_own") == 0, top >= 2).when(F.col("_own") == 1, (top >= 3) & (total >= 3))
             .otherwise(((wide >= 2) & (total >= F.col("_own") + 3)) | ((top >= 4) & (total >= F.col("_own") + 4))))
    issue = lambda cond, code, section="", severity="error": F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(section).alias("section")))
    items = [
        issue(F.col("n_events") < max(1, min_events), "insufficient_supporting_events"), issue(F.col("driver_key").isNull(), "missing_primary_driver"),
        issue(F.col("n_sources") < max(1, min_sources), "insufficient_external_sources"),
        *[issue(sec(s) == "", "missing_required_section", s) for s in V.MEMO_TEXT_SECTIONS],
        issue(~F.coalesce(F.col("confidence_level").isin("low", "medium", "high"), F.lit(False)), "invalid_confidence_level")]
    for s, (least, most) in V.MEMO_LIST_SECTIONS.items():
        filler = F.exists(sec(s), lambda v: (_word_count(v) < 5) | T.has_any(v, V.FILLER_PHRASES))
        items += [issue(F.size(sec(s)) < least, "insufficient_list_items", s), issue(F.size(sec(s)) > most, "excessive_list_items", s),
                  issue(F.col(s).isNull() | F.exists(sec(s), lambda v: v == ""), "missing_required_section", s), issue(filler, "filler_list_content", s)]
    items += [
        issue(points < 2, "insufficient_quantified_evidence"), issue(generic, "generic_opportunity_target"), issue(weak, "weak_core_thesis"),
        issue((_word_count(now) < 12) | ~(T.has_any(now, V.TIMING_WORDS) | now.rlike(number)), "generic_why_now"),
        issue((_word_count(trade) < 12) | T.has_any(trade, V.VAGUE_TRADE_PHRASES) | ~T.has_any(trade, V.TRADE_WORDS), "vague_trade_expression"),
        issue((_word_count(why) < 14) | ~T.has_any(why, V.LOGIC_WORDS), "generic_opportunity_framing"), issue(drift, "topic_drift_detected"),
        issue((F.col("n_publishers") < 2) & (F.col("n_sources") >= 1), "weak_source_diversity", severity="warning"),
        issue(F.col("topic_score") <= threshold + 0.03, "novelty_or_selection_borderline", severity="warning"),
        issue((F.col("confidence_level") == "high") & (points < 3), "confidence_evidence_mismatch", severity="warning")]
    return df.select("memo_id", F.explode(F.array_compact(F.array(*items))).alias("i")).select("memo_id", "i.*")


def clean_sources(df: DataFrame, fallback_queries: list[str] | None = None) -> DataFrame:
    """External sources of ``pack_id, sources array<struct>`` with defaults; rows without a summary drop out."""
    txt = lambda c: T.strip(F.coalesce(c, F.lit("")))
    some = lambda c: F.nullif(txt(c), F.lit(""))
    s, pos = F.col("s"), F.col("pos")
    fallback = F.lit("unspecified") if not fallback_queries else F.element_at(T.lit_array(fallback_queries), F.least(pos, F.lit(len(fallback_queries) - 1)) + 1)
    out = df.select("pack_id", F.posexplode("sources").alias("pos", "s"))
    return out.filter(s.isNotNull() & (txt(s["summary"]) != "")).select(
        "pack_id", F.coalesce(some(s["source_id"]), F.format_string("src_%02d", pos + 1)).alias("source_id"),
        F.coalesce(some(s["source_type"]), F.lit("web")).alias("source_type"), F.coalesce(some(s["title"]), F.lit("Untitled source")).alias("title"),
        some(s["publisher"]).alias("publisher"), F.coalesce(some(s["query"]), fallback).alias("query"), txt(s["summary"]).alias("summary"),
        F.filter(F.transform(F.coalesce(s["tags"], F.array().cast("array<string>")), lambda t: T.strip(t)), lambda t: t != "").alias("tags"), some(s["url"]).alias("url"))
