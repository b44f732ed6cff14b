"""Tag and relation search, feed pages, lineage, message context, comparison and duplicate search."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T, vocab as V
from .asof import HOUR, latest_per_key, micros, position_in, top_per_key
from .filters import after, event_base, feed_rows

RANKING = (F.desc_nulls_last, "impact_score"), (F.desc_nulls_last, "event_time"), (F.desc, "event_id")


def order_events(df: DataFrame) -> DataFrame:
    return df.orderBy(*[fn(c) for fn, c in RANKING])


def _one(value: str, values, aliases=None) -> str:
    key = (value or "").strip().lower().replace("-", "_").replace(" ", "_")
    key = (aliases or {}).get(key, key)
    if key not in values:
        raise ValueError(f"{value!r} is not in the vocabulary")
    return key


def _value(value: str) -> str:
    clean = " ".join((value or "").split())
    if not clean or clean.lower() in V.PLACEHOLDERS:
        raise ValueError(f"{value!r} is not a usable value")
    return clean.lower()


def _with_direction(events: DataFrame, tags: DataFrame | None, direction: str | None) -> DataFrame:
    if direction is None:
        return events
    wanted = _one(direction, V.DIRECTIONS)
    hits = tags.filter((F.col("tag_type") == "directionality") & (F.lower("tag_value") == wanted)).select("event_id")
    return events.join(hits, "event_id", "left_semi")


def events_by_tag(events, tags, tag_type, tag_value, start, end, min_impact=None, direction=None, limit=100) -> DataFrame:
    family, value = _one(tag_type, V.TAG_FAMILIES, V.TAG_FAMILY_ALIASES), _value(tag_value)
    hits = tags.filter((F.col("tag_type") == family) & (F.lower("tag_value") == value)).select("event_id")
    found = event_base(events, start, end, min_impact).join(hits, "event_id", "left_semi")
    return order_events(_with_direction(found, tags, direction)).limit(max(1, min(limit, 500)))


def events_by_relation(events, relations, relation_type, start, end, min_impact=None, tags=None, direction=None, subject_type=None,
                       subject_value=None, object_type=None, object_value=None, limit=100) -> DataFrame:
    edges = relations.filter(F.col("relation_type") == _one(relation_type, V.RELATION_TYPES))
    for col, kind in (("subject_type", subject_type), ("object_type", object_type)):
        if kind is not None:
            edges = edges.filter(F.col(col) == _one(kind, V.RELATION_ENTITIES, V.RELATION_ENTITY_ALIASES))
    for col, val in (("subject_value", subject_value), ("object_value", object_value)):
        if val is not None:
            edges = edges.filter(F.lower(col) == _value(val))
    found = event_base(events, start, end, min_impact).join(edges.select("event_id"), "event_id", "left_semi")
    return order_events(_with_direction(found, tags, direction)).limit(max(1, min(limit, 500)))


def with_facets(events: DataFrame, tags: DataFrame, candidates: DataFrame) -> DataFrame:
    """Direction and enrichment route of each event, null where there is none."""
    direction = tags.filter("tag_type = 'directionality'").groupBy("event_id").agg(F.max("tag_value").alias("directionality"))
    return events.join(direction, "event_id", "left").join(candidates.select("event_id", F.col("route").alias("enrichment_route")), "event_id", "left")


def event_detail(events: DataFrame, claims: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event with latest claim and message count, linked messages in link order as rows).

    The id list of the report form is kept as rows with a position, so an event with very many messages stays
    spread over tasks.
    """
    latest = claims.select(F.col("claim_id").alias("latest_claim_id"), F.col("topic").alias("claim_topic"),
                           F.col("event_time").alias("claim_event_time"), F.col("claim_hash").alias("latest_claim_hash"))
    n = links.groupBy("event_id").agg(F.count(F.lit(1)).alias("message_count"))
    head = events.join(latest, "latest_claim_id", "left").join(n, "event_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    ordered = links.withColumn("_us", micros("linked_at"))
    rows = position_in(ordered, ["event_id"], ["_us", "raw_message_id"], "position")
    return head, rows.select("event_id", "raw_message_id", "position")


def event_lineage(links: DataFrame, raw: DataFrame, claims: DataFrame, routing: DataFrame, cap: int = 100) -> DataFrame:
    """Link, message, claim and routing rows, at most ``cap`` per event in link order, with total and truncated."""
    total = links.groupBy("event_id").agg(F.count(F.lit(1)).alias("total"))
    kept = top_per_key(links, ["event_id"], ["linked_at", "raw_message_id"], cap)
    return (
        kept.join(raw, "raw_message_id").join(claims, "raw_message_id", "left").join(routing, "raw_message_id", "left")
        .join(total, "event_id").withColumn("truncated", F.col("total") > cap))


def message_context(raw: DataFrame, claims: DataFrame, routing: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """One row per message and linked event (one row without event when there is no link)."""
    linked = links.join(events, "event_id", "left")
    return raw.join(claims, "raw_message_id", "left").join(routing, "raw_message_id", "left").join(linked, "raw_message_id", "left")


def pipeline_overview(raw, state, claims, routing, links, n: int, events: DataFrame | None = None) -> DataFrame:
    """Newest ``n`` messages with state, claim, routing and event; the n are cut before the wide joins."""
    top = raw.orderBy(F.desc("raw_message_id")).limit(n)
    out = top
    for side in (state, claims, routing, links):
        out = out.join(side, "raw_message_id", "left")
    if events is not None:
        out = out.join(events, "event_id", "left")
    return out.orderBy(F.desc("raw_message_id"), F.desc("event_id")).limit(n)


COMPARED = ("topic", "event_time", "impact_score", "is_breaking", "breaking_window", "summary", "identity", "claim_hash", "payload_hash",
            "action_class", "time_bucket")


def compare_claims_to_events(claims: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Eleven fields of each claim against its first linked event: counts, mismatching fields and a status."""
    first = latest_per_key(links, ["raw_message_id"], ["linked_at", "event_id"]).select("raw_message_id", "event_id")
    ev = events.select("event_id", *[F.col(c).alias(f"e_{c}") for c in COMPARED])
    df = claims.join(first, "raw_message_id", "left").join(ev, "event_id", "left")

    def same(c: str):
        a, b = F.col(c), F.col(f"e_{c}")
        return F.coalesce(F.abs(a - b) <= 0.01, a.isNull() & b.isNull()) if c == "impact_score" else a.eqNullSafe(b)

    bad = F.array_compact(F.array(*[F.when(~same(c), F.lit(c)) for c in COMPARED]))
    linked = F.col("event_id").isNotNull()
    return df.withColumn("mismatches", F.when(linked, bad).otherwise(F.array().cast("array<string>"))).select(
        "raw_message_id", "event_id", "mismatches",
        F.when(linked, len(COMPARED) - F.size("mismatches")).otherwise(0).alias("match_count"), F.size("mismatches").alias("mismatch_count"),
        F.when(~linked, "no_linked_event").when(F.size("mismatches") == 0, "consistent").otherwise("inconsistent").alias("status"))


def feed_page(events: DataFrame, n: int, after_key: tuple | None = None, topic: str | None = None) -> DataFrame:
    """One keyset page: up to n rows with ``has_more`` and the key of the next page on every row."""
    rows = feed_rows(events, topic)
    if after_key is not None:
        rows = after(rows, *after_key)
    order = [F.desc("event_time"), F.desc("event_id")]
    peek = rows.orderBy(*order).limit(n + 1)
    whole = W.partitionBy(F.lit(0))  # at most n + 1 rows are left here
    page = peek.withColumn("_rn", F.row_number().over(whole.orderBy(*order))).withColumns({
        "_n": F.count(F.lit(1)).over(whole), "_k": F.max(F.when(F.col("_rn") == n, F.struct("event_time", "event_id"))).over(whole)})
    more = F.col("_n") > n
    return page.filter(F.col("_rn") <= n).select(
        "event_id", F.trim("summary").alias("summary"), "topic", "event_time", T.half_even_int(F.coalesce("impact_score", F.lit(0.0))).alias("impact_score"),
        more.alias("has_more"), F.when(more, F.col("_k.event_time")).alias("next_time"), F.when(more, F.col("_k.event_id")).alias("next_id"))


def feed_pages(events: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(items with page and position, one row per page with its size, next key and has_more) for the whole feed."""
    rows = feed_rows(events).withColumn("_us", micros("event_time"))
    pos = position_in(rows, [], [F.desc("_us"), F.desc("event_id")], "position")
    items = pos.withColumn("page", F.floor((F.col("position") - 1) / n).cast("long")).drop("_us")
    key = F.struct("event_time", "event_id")
    peek = items.filter((F.col("position") % n == 1) & (F.col("page") > 0)).select((F.col("page") - 1).alias("page"), F.lit(True).alias("has_more"))
    pages = items.groupBy("page").agg(F.count(F.lit(1)).alias("n_items"), F.min(key).alias("_k")).join(peek, "page", "left")
    more = F.coalesce("has_more", F.lit(False))
    return items, pages.select("page", "n_items", more.alias("has_more"), F.when(more, F.col("_k.event_time")).alias("next_time"),
                               F.when(more, F.col("_k.event_id")).alias("next_id"))


def latest_runs(runs: DataFrame, theme: str | None, n: int) -> DataFrame:
    out = runs if theme is None else runs.filter(F.col("theme_key") == theme)
    return out.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)


def _ratio():
    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(a=a, b=b).ratio() if a and b else 0.0 for a, b in zip(left, right)])

    return ratio


NO_TOPIC = "\u0000"  # stands for the list over all topics


def duplicate_candidates(events: DataFrame, base: DataFrame | None = None, scan: int = 250, keep: int = 20, with_ratio: bool = True) -> DataFrame:
    """Likely duplicates of each base event among the ``scan`` latest other events of its topic, or of all if it has no topic.

    The candidate side is the top ``scan + 1`` of every topic and of the whole table, so it is at most 251 rows per topic whatever the table
    size, and the work is linear in the base rows. The string ratio is computed once per distinct pair of texts, and
    only where the length bound lets it reach 0.80.
    """
    cols = ["event_id", "topic", "summary", "event_time", "is_breaking", "identity", "claim_hash", "payload_hash", "entities", "words", "last_updated_at"]
    ev = events.select(*cols).withColumn("norm", T.squeezed_lower(F.col("summary")))
    order = [F.desc("last_updated_at"), F.desc("event_id")]
    newest = ev.orderBy(*order).limit(scan + 1).withColumn("topic", F.lit(NO_TOPIC))
    ev = ev.withColumn("topic", F.when(F.coalesce(F.trim("topic"), F.lit("")) == "", NO_TOPIC).otherwise(F.col("topic")))
    top = top_per_key(ev.filter(F.col("topic") != NO_TOPIC), ["topic"], order, scan + 1, "_rank")
    top = top.unionByName(top_per_key(newest, ["topic"], order, scan + 1, "_rank"))
    c = top.select("topic", *[F.col(x).alias(f"c_{x}") for x in ("event_id", "norm", "event_time", "identity", "claim_hash", "payload_hash", "entities", "words", "_rank")])
    # a base inside the top list sees scan others; a base outside sees only the first scan
    own = top.select("topic", "event_id", F.col("_rank").alias("_own"))
    b = (ev if base is None else ev.join(base.select("event_id"), "event_id", "left_semi")).join(own, ["topic", "event_id"], "left")
    pairs = b.join(c, "topic").filter((F.col("event_id") != F.col("c_event_id")) & ((F.col("c__rank") <= scan) | F.col("_own").isNotNull()))
    eq = lambda x: F.coalesce((F.col(x) != "") & (F.col(x) == F.col(f"c_{x}")), F.lit(False))
    hours = F.abs(micros("event_time") - micros("c_event_time")) / HOUR
    pairs = pairs.withColumns({
        "hours_apart": hours, "shared_entities": T.overlap(F.col("entities"), F.col("c_entities")), "shared_words": T.overlap(F.col("words"), F.col("c_words")),
        "same_identity": eq("identity"), "same_claim": eq("claim_hash"), "same_payload": eq("payload_hash")})
    pairs = pairs.withColumn("within", F.coalesce(F.col("hours_apart") <= F.when(F.col("is_breaking"), 6).otherwise(24), F.lit(False)))
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    pairs = pairs.withColumn("score", pts(F.col("same_identity"), 8) + pts(F.col("same_claim"), 5) + pts(F.col("same_payload"), 4)
                             + F.least(F.lit(2), "shared_entities") + pts(F.col("shared_words") >= 2, 1) + pts(F.col("within"), 1))
    # the ratio adds at most two, so a native score below one can never reach three
    pairs = pairs.filter(F.col("score") >= (1 if with_ratio else 3))
    if with_ratio:
        la, lb = F.length("norm"), F.length("c_norm")
        could = pairs.filter((2 * F.least(la, lb) / (la + lb) >= 0.8) & (F.col("norm") != F.col("c_norm")))
        texts = could.select("norm", "c_norm").distinct().withColumn("ratio", _ratio()("norm", "c_norm"))
        pairs = pairs.join(texts, ["norm", "c_norm"], "left").withColumn(
            "ratio", F.when((F.col("norm") == F.col("c_norm")) & (F.col("norm") != ""), 1.0).otherwise(F.coalesce("ratio", F.lit(0.0))))
        pairs = pairs.withColumn("score", F.col("score") + F.when(F.col("ratio") >= 0.9, 2).when(F.col("ratio") >= 0.8, 1).otherwise(0)).filter("score >= 3")
    ranked = top_per_key(pairs, ["event_id"], [F.desc("score"), F.coalesce("hours_apart", F.lit(9999.0)), "c_event_id"], keep)
    return ranked.select(
        "event_id", F.col("c_event_id").alias("candidate_id"), F.col("score").cast("long").alias("score"),
        F.when(F.col("score") >= 9, "high").when(F.col("score") >= 5, "medium").otherwise("low").alias("likelihood"), "position",
        "same_identity", "same_claim", "same_payload", "shared_entities", "shared_words", F.round("hours_apart", 3).alias("hours_apart"), "within",
        *(["ratio"] if with_ratio else []))
