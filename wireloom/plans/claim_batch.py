"""The claim batch: raw claims to scored, triaged, routed claims, folded events and side tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab as V
from ..operators import canonical, enrich, events, scoring, themes, triage
from ..operators.asof import latest_per_key
from ..session import cut_lineage, short_methods, shuffled
from ..sources.messages import REUSE_KEYS, extract_claims, reuse_payloads


_STORED = ("event_id", "identity", "topic", "event_time", "last_updated_at", "ents", "words", "src", "cand_entities", "cand_impact", "cand_tags", "cand_source_class")
# what enrichment candidates are judged by
_JUDGED = ("claim_id", "created_at", "topic", "event_time", "summary", "source_claimed", "countries", "orgs", "people", "keywords", "fingerprint", "existing_event_id", "route", "triage_action", "triage_reasons",
           "calibrated_score")
_TAGS = "event_id long, tag_type string, tag_value string, tag_source string, confidence double"
_RELATIONS = ("event_id long, subject_type string, subject_value string, relation_type string, object_type string, object_value string, relation_source string, "
              "inference_level int, confidence double")


def claims_from_messages(messages: DataFrame) -> DataFrame:
    """Rule-based claims in the raw-claim shape. Needs claim_id, text, message_time, channel, created_at."""
    none = F.array().cast("array<string>")
    tags = F.array().cast(f"array<{canonical.TAG_TYPE}>")
    rels = F.array().cast("array<struct<subject_type:string,subject_value:string,relation_type:string,object_type:string,object_value:string,relation_source:string,confidence:double>>")
    x = extract_claims(messages).withColumns({
        "text_hash": F.sha2("text", 256), "extractor_name": F.lit("rules"), "prompt_version": F.lit("none"), "schema_version": F.lit(1), "canonicaliser_version": F.lit(V.CANONICALISER_VERSION)})
    return x.select(
        "claim_id", "created_at", "topic", "event_time", "impact_score", "confidence", "is_breaking", "breaking_window", "summary", F.lit(None).cast("string").alias("source_claimed"),
        "fingerprint", none.alias("countries"), none.alias("orgs"), none.alias("people"), "tickers", none.alias("affected_countries"), "keywords", "market_stats",
        tags.alias("tags"), rels.alias("relations"), F.struct(*[none.alias(c) for c in canonical.CUES]).alias("cues"), F.lit(None).cast("string").alias("event_type_raw"),
        F.lit(None).cast("string").alias("direction_raw"), F.lit(None).cast("string").alias("event_core"), *REUSE_KEYS)


def canonical_claims(raw: DataFrame) -> DataFrame:
    """Canonical columns under their plain names."""
    c = canonical.canon_claims(raw)
    renamed = {"countries": "c_countries", "affected_countries": "c_affected", "tickers": "c_tickers", "orgs": "c_orgs", "people": "c_people", "keywords": "c_keywords",
               "source_claimed": "c_source", "summary": "safe_summary", "tags": "canon_tags", "relations": "canon_relations", "cues": "c_cues", "event_core": "c_core"}
    keep = ("claim_id", "created_at", "topic", "event_time", "impact_score", "confidence", "is_breaking", "breaking_window", "market_stats", "direction", "action_class", "time_bucket",
            "payload_hash", "canon_rules")
    return c.select(*keep, F.col("c_event_type").alias("event_type"), F.coalesce("fingerprint_v2", F.lit("")).alias("fingerprint"), F.col("claim_hash_v1").alias("claim_hash"),
                    *[F.col(v).alias(k) for k, v in renamed.items()])


def scored_claims(raw: DataFrame) -> DataFrame:
    """Canonical claims whose score is the calibrated one; the payload hash is taken after that."""
    c = scoring.calibrate_impact(canonical_claims(raw)).withColumn("impact_score", F.col("calibrated_score"))
    payload = F.struct("affected_countries", "breaking_window", "confidence", "countries", "cues", F.col("direction").alias("directionality"), "event_core", "event_time", "event_type", "fingerprint",
                       "impact_score", "is_breaking", "keywords", "market_stats", "orgs", "people", "relations", "source_claimed", "summary", "tags", "tickers", "topic")
    return c.withColumn("payload_hash", F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256))


def batch_evidence(claims: DataFrame, actions: DataFrame, registered: Iterable[themes.Theme]) -> DataFrame:
    """Theme evidence of a batch: a row per theme, event and claim for every claim that went into an event and matches the theme."""
    hits = cut_lineage(claims.join(actions.select("claim_id", "event_id"), "claim_id"))
    return reduce(DataFrame.unionByName, [themes.theme_evidence(themes.match_theme(hits, theme)) for theme in registered])


def batch_candidates(routed: DataFrame, actions: DataFrame, stored: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Enrichment candidates of a batch: one row per event that took a claim, judged by its latest claim.

    An event that stood before its latest claim, be it from earlier claims of the batch, is no novelty. ``stored`` events with a ``summary`` take part in the
    look-back by title, ``history`` (candidates of earlier batches) in that by cluster.
    """
    rows = routed.select(*_JUDGED).join(actions.select("claim_id", "event_id", "action"), "claim_id")
    rows = latest_per_key(rows, ["event_id"], [F.desc("created_at"), F.desc("claim_id")]).withColumns({
        "existing_event_id": F.coalesce("existing_event_id", F.when(F.col("action") != "create", F.col("event_id"))),
        "scored_at": F.col("created_at"), "last_updated_at": F.col("created_at"), "cluster_key": enrich.cluster_key(routed)})
    rows = cut_lineage(events.claim_signature(rows))
    titled = ["event_id", "topic", "last_updated_at", "event_time", "summary", "ents"]
    near = rows.select(*titled)
    if stored is not None and "summary" in stored.columns:
        near = near.unionByName(stored.select(*titled).join(rows.select("event_id"), "event_id", "left_anti"))
    blocked = enrich.title_entity_overlap(near).select("event_id", "blocked")
    chosen = enrich.select_enrichment(rows.join(blocked, "event_id"), history)
    return chosen.select("event_id", "claim_id", "cluster_key", "scored_at", "route", "triage_action", "calibrated_score", "selected", "novelty_state", "reason_codes")


def claim_batch(raw: DataFrame, stored: DataFrame | None = None, state: DataFrame | None = None, slice_rows: int | None = None,
                stored_tags: DataFrame | None = None, stored_relations: DataFrame | None = None, reuse_hours: int | None = None,
                stored_candidates: DataFrame | None = None, registered: Iterable[themes.Theme] | None = None) -> dict[str, DataFrame]:
    """One batch. ``stored``: events with event_id, identity, topic, event_time, last_updated_at, ents, words, src and the
    ``cand_`` columns of their latest claim; ``state``: the fold state of the same events. ``stored_tags`` and
    ``stored_relations``: facet rows of all events; those of events that the batch does not touch stay as they are.
    With ``reuse_hours`` claims of equal text take the payload of the first of their run (``raw`` then needs the columns
    REUSE_KEYS). Claims that went into events leave theme evidence (of ``registered`` themes, by default all) and enrichment candidates.

    Triage looks events up as they stand before the batch; the fold itself sees every earlier claim of the batch.
    """
    reuse = None
    if reuse_hours is not None:
        raw = cut_lineage(raw)  # read by several branches of the reuse; what extracts claims from texts costs more than all else
        raw = cut_lineage(reuse_payloads(raw, [c for c in raw.columns if c not in ("claim_id", "created_at", *REUSE_KEYS)], reuse_hours))
        reuse = raw.filter("reused_claim_id IS NOT NULL").select("claim_id", "reused_claim_id", "payload_claim_id")
    with short_methods(raw.sparkSession):
        c = cut_lineage(triage.triage_features(scored_claims(raw)).withColumn("event_fingerprint", F.col("fingerprint")))
    sig = events.claim_signature(c)
    if stored is None:
        seen = c.withColumns({"existing_event_id": F.lit(None).cast("long"), "cand_entities": F.lit(None).cast("array<string>"), "cand_impact": F.lit(None).cast("double"),
                              "cand_tags": F.lit(None).cast("array<string>"), "cand_source_class": F.lit(None).cast("string")})
    else:
        stored = cut_lineage(stored.select(*_STORED, *(["summary"] if "summary" in stored.columns else [])))  # read by the look-up, as context and by the candidates
        found = events.candidate_event(sig, stored).filter(F.col("event_id").isNotNull()).select("claim_id", F.col("event_id").alias("existing_event_id"))
        context = stored.select(F.col("event_id").alias("existing_event_id"), "cand_entities", "cand_impact", "cand_tags", "cand_source_class")
        # the wide claims are dealt once, by claim
        seen = c.join(shuffled(found.join(shuffled(context), "existing_event_id", "left")), "claim_id", "left")
    routed = triage.route(triage.triage(triage.materially_new(seen).join(shuffled(triage.burst_counts(c)), "claim_id")))
    routed = cut_lineage(routed)
    folded = events.claim_signature(routed.filter("event_action <> 'ignore'")).withColumn("identity", F.col("fingerprint"))
    new_state, actions = events.fold_events(folded, state, slice_rows)
    conflicts = actions.filter("action = 'update_conflict'").select("claim_id", F.col("action_reason").alias("review_reason"))
    final = triage.apply_conflicts(routed, conflicts)
    links = actions.join(c.select("claim_id", "created_at"), "claim_id").select("event_id", F.col("claim_id").alias("raw_message_id"), F.col("created_at").alias("linked_at")).dropDuplicates(["event_id", "raw_message_id"])
    mentions = events.index_entities(c.withColumn("raw_message_id", F.col("claim_id")), links)
    latest = new_state.select("event_id", F.col("latest_claim_id").alias("claim_id")).join(c.select("claim_id", "tags", "relations"), "claim_id")
    spark = raw.sparkSession
    tags = spark.createDataFrame([], _TAGS) if stored_tags is None else stored_tags
    relations = spark.createDataFrame([], _RELATIONS) if stored_relations is None else stored_relations
    registered = themes.REGISTRY.all() if registered is None else list(registered)
    extra = {} if reuse is None else {"reuse": reuse}
    if registered:
        extra["theme_evidence"] = batch_evidence(final, actions, registered)
    return extra | {"enrichment_candidates": batch_candidates(final, actions, stored, stored_candidates), "claims": final, "events": new_state, "actions": actions, "links": links, "entity_mentions": mentions,
            "event_tags": events.sync_facets(tags, latest, "tags"), "event_relations": events.sync_facets(relations, latest, "relations"),
            "score_distribution": scoring.score_distribution(c)}


def extraction_run_metrics(outcomes: DataFrame) -> DataFrame:
    """Selected, processed, completed, failed and skipped per run (columns processing_run_id, outcome)."""
    n = lambda *s: F.count(F.when(F.col("outcome").isin(*s), 1))
    return outcomes.groupBy("processing_run_id").agg(
        F.count(F.lit(1)).alias("selected"), n("completed", "failed").alias("processed"), n("completed").alias("completed"), n("failed").alias("failed"), n("skipped").alias("skipped"))


def rebuild(messages: DataFrame, out_dir: str, slice_rows: int | None = None, reuse_hours: int | None = 6) -> dict[str, DataFrame]:
    """Recompute every derived table from the immutable messages and replace it; the messages stay as they are. The tables as written."""
    tables = claim_batch(claims_from_messages(messages), slice_rows=slice_rows, reuse_hours=reuse_hours)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")
    return {name: messages.sparkSession.read.parquet(f"{out_dir}/{name}") for name in tables}
