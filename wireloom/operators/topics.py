"""Event snapshots, topic mapping, topic ranking and driver selection for every window at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T, vocab as V
from ..session import cut_lineage
from .asof import HOUR, micros, position_in, top_per_key
from .filters import assign_windows

WINDOW = ["window_start", "window_end"]
KEYS = [*WINDOW, "mapped_topic"]


def exact_sum(col: Column) -> Column:
    """Order-independent sum of doubles."""
    return F.sum(col.cast("decimal(28,10)")).cast("double")


def event_snapshots(events: DataFrame, claims: DataFrame, tags: DataFrame, relations: DataFrame) -> DataFrame:
    """Event with its claim payload, tags and relations nested (facets of one event are few: they come from one claim).

    ``claims`` carries latest_claim_id, keywords, countries, orgs, people, tickers, market_stats.
    """
    t = tags.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("tag_type", "tag_value"))).alias("tags"))
    r = relations.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("relation_type", "subject_value", "object_value"))).alias("relations"))
    df = events.join(claims, "latest_claim_id", "left").join(t, "event_id", "left").join(r, "event_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    return df.withColumns({c: empty(c) for c in ("tags", "relations", "keywords", "countries", "orgs", "people", "tickers", "market_stats")} | {
        "ts": F.coalesce("event_time", "last_updated_at"), "impact_score": F.coalesce("impact_score", F.lit(0.0))})


_KW = lambda: F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(k).alias("kw")) for t in V.MEMO_TOPICS for k in V.TOPIC_KEYWORDS[t]])


def _hits(items: Column) -> Column:
    """(topic, field:keyword) entries of every text of a layer."""
    return F.flatten(F.transform(items, lambda it: F.transform(
        F.filter(_KW(), lambda k: F.contains(it["text"], k["kw"])),
        lambda k: F.struct(k["topic"].alias("topic"), F.concat(it["field"], F.lit(":"), k["kw"]).alias("entry")))))


def _best(hits: Column, layer: str) -> Column:
    topics = T.lit_array(V.MEMO_TOPICS)
    count = lambda h: F.array_max(F.transform(topics, lambda t, i: F.struct(
        F.size(F.filter(h, lambda x: x["topic"] == t)).alias("n"), (-i).alias("o"), t.alias("topic"))))
    named = lambda h: T.let(count(h), lambda b: F.when(b["n"] > 0, F.struct(
        b["topic"].alias("topic"), F.lit(layer).alias("layer"),
        F.array_sort(F.array_distinct(F.transform(F.filter(h, lambda x: x["topic"] == b["topic"]), lambda x: x["entry"]))).alias("fields"))))
    return T.let(hits, named)


def map_topics(snaps: DataFrame) -> DataFrame:
    """Adds ``mapped_topic``, ``source_layer`` and ``matched_fields``: most keyword hits over tags, else relations, else payload."""
    low = T.squeezed_lower
    item = lambda field, text: F.struct((field if isinstance(field, Column) else F.lit(field)).alias("field"), low(text).alias("text"))
    tags = F.transform("tags", lambda t: item(F.concat(F.lit("event_tags."), F.coalesce(F.nullif(low(t["tag_type"]), F.lit("")), F.lit("unknown"))), t["tag_value"]))
    rels = F.flatten(F.transform("relations", lambda r: F.array(*[item(f"event_relations.{f}", r[f]) for f in ("relation_type", "subject_value", "object_value")])))
    p = "latest_extraction_payload."
    many = lambda col, field: F.transform(col, lambda v: item(p + field, v))
    payload = F.concat(
        F.array(item(p + "summary_1_sentence", F.col("summary")), item(p + "topic", F.col("topic"))), many("keywords", "keywords"),
        *[many(c, f"entities.{c}") for c in ("countries", "orgs", "people", "tickers")],
        F.transform("market_stats", lambda s: item(p + "market_stats.label", s["label"])),
        F.transform("market_stats", lambda s: item(p + "market_stats.context", s["context"])))
    df = snaps.withColumn("_m", F.coalesce(
        _best(_hits(tags), "event_tags"), _best(_hits(rels), "event_relations"), _best(_hits(payload), "latest_extraction_payload")))
    return df.withColumns({
        "mapped_topic": F.col("_m.topic"), "source_layer": F.coalesce("_m.layer", F.lit("no_match")),
        "matched_fields": F.coalesce("_m.fields", F.array().cast("array<string>"))}).drop("_m")


def driver_hint(df: DataFrame) -> Column:
    text = F.concat_ws(" ", F.lower("summary"), F.lower(F.array_join("keywords", " ")))
    return T.first_family(text, V.DRIVER_HINTS, V.FALLBACK_DRIVER)


def driver_hits(df: DataFrame) -> Column:
    rel = F.flatten(F.transform("relations", lambda r: F.array(r["relation_type"], r["subject_value"], r["object_value"])))
    text = F.lower(F.concat_ws(" ", "summary", F.array_join("keywords", " "), F.array_join(rel, " ")))
    found = T.families_found(text, V.DRIVERS)
    return F.when(F.size(found) == 0, F.array(F.lit(V.FALLBACK_DRIVER))).otherwise(found)


def entity_tokens() -> Column:
    return F.concat(*[F.transform(F.filter(c, lambda v: T.strip(v) != ""), _typed(c)) for c in ("countries", "orgs", "people", "tickers")])


def _typed(kind: str):
    return lambda v: F.concat(F.lit(kind + ":"), F.lower(T.strip(v)))


def windowed(snaps: DataFrame, length: str = "1 day", every: str | None = None) -> DataFrame:
    """Mapped snapshots per window with the derived columns every later step reads, computed once."""
    df = assign_windows(snaps.filter(F.col("mapped_topic").isNotNull()), "ts", length, every)
    span = (micros("window_end") - micros("window_start")).cast("double")
    frac = T.clamp((micros("ts") - micros("window_start")) / span, 0.0, 1.0)
    return df.withColumns({
        "impact": T.clamp(F.col("impact_score") / 100.0, 0.0, 1.0), "recency": 0.5 + 0.5 * frac, "frac": frac, "span_us": span,
        "hint": driver_hint(df), "drivers": driver_hits(df), "entity_tokens": entity_tokens(),
        "relation_types": F.filter(F.transform("relations", lambda r: F.lower(T.strip(r["relation_type"]))), lambda v: v != ""),
        "identity_key": F.coalesce(F.concat(F.lit("identity:"), F.nullif(T.strip("identity"), F.lit(""))),
                                   F.concat(F.lit("claim:"), F.nullif(T.strip("claim_hash"), F.lit(""))), F.concat(F.lit("event:"), F.col("event_id").cast("string")))})


def topic_volume(w: DataFrame) -> DataFrame:
    """Event count and recency-weighted impact, both over the window's largest topic."""
    g = w.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("event_count"), exact_sum(F.col("impact") * F.col("recency")).alias("weighted_raw"))
    per = W.partitionBy(*WINDOW)  # at most one row per topic
    top_n, top_w = F.max("event_count").over(per), F.max("weighted_raw").over(per)
    return g.withColumns({"count_share": F.col("event_count") / top_n, "weighted_share": F.when(top_w > 0, F.col("weighted_raw") / top_w).otherwise(0.0)})


def max_share(w: DataFrame, tokens: str, keys: list[str], out: str) -> DataFrame:
    """Largest token share per key; tokens are counted before they meet at the key."""
    c = w.select(*keys, F.explode(tokens).alias("tok")).groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(*keys).agg((F.max("c") / F.sum("c").cast("double")).alias(out))


def topic_coherence(w: DataFrame) -> DataFrame:
    tagged = w.withColumn("_t", F.concat("entity_tokens", F.transform(F.filter("tags", lambda t: T.strip(t["tag_value"]) != ""),
                                                                     lambda t: F.concat(F.lit("tag:"), F.lower(T.strip(t["tag_value"]))))))
    e = max_share(tagged, "_t", KEYS, "e")
    r = max_share(w, "relation_types", KEYS, "r")
    d = max_share(w.withColumn("_h", F.array("hint")), "_h", KEYS, "d")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return d.join(e, KEYS, "left").join(r, KEYS, "left").select(*KEYS, T.clamp(z("e") * 0.45 + z("r") * 0.35 + z("d") * 0.20, 0.0, 1.0).alias("coherence"))


def topic_actionability(w: DataFrame) -> DataFrame:
    g = w.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), (exact_sum(F.col("impact")) / F.count(F.lit(1))).alias("a"),
        F.max(F.arrays_overlap("relation_types", T.lit_array(V.ACTIONABLE_RELATIONS))).alias("act"), F.count(F.when(F.col("frac") >= 0.75, 1)).alias("late"))
    pts = lambda c, p: F.when(c, p).otherwise(0.0)
    score = (F.when(F.col("a") >= 0.65, 0.40).when(F.col("a") >= 0.50, 0.25).otherwise(0.0)
             + F.when(F.col("n") >= 3, 0.25).when(F.col("n") == 2, 0.15).otherwise(0.05) + pts(F.col("act"), 0.20) + pts(F.col("late") / F.col("n") >= 0.40, 0.15))
    return g.select(*KEYS, T.clamp(score, 0.0, 1.0).alias("actionability"))


def topic_novelty(w: DataFrame, recent_topics: DataFrame | None = None) -> DataFrame:
    """Share of identity keys not seen in the window before (of equal length), less 0.15 after a recent memo."""
    keys = w.select(*KEYS, "identity_key").distinct()
    prior = keys.select(F.col("window_end").alias("window_start"), "mapped_topic", "identity_key", F.lit(1).alias("seen"))
    g = keys.join(prior, ["window_start", "mapped_topic", "identity_key"], "left").groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count("seen").alias("s"))
    novelty = T.clamp(1.0 - F.col("s") / F.col("n"), 0.0, 1.0)
    if recent_topics is None:
        return g.select(*KEYS, novelty.alias("novelty"))
    g = g.join(recent_topics.select("window_start", "mapped_topic", F.lit(True).alias("_r")).distinct(), ["window_start", "mapped_topic"], "left")
    return g.select(*KEYS, F.when(F.col("_r"), T.clamp(novelty - 0.15, 0.0, 1.0)).otherwise(novelty).alias("novelty"))


def recent_memo_topics(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """(window_start, topic) with a finished memo between one look-back (a window, at least 24 hours) and the window end."""
    day = 24 * HOUR
    r = runs.filter(F.col("completed_at").isNotNull() & F.col("status").isin("completed", "delivery_failed") & F.col("selected_topic").isNotNull())
    r = r.select(F.col("selected_topic").alias("mapped_topic"), micros("completed_at").alias("us")).withColumn("d", F.floor(F.col("us") / day))
    w = windows.select(*WINDOW).distinct().withColumns({"a": micros("window_start"), "b": micros("window_end")})
    w = w.withColumn("lo", F.col("a") - F.greatest(F.col("b") - F.col("a"), F.lit(day)))
    w = w.withColumn("d", F.explode(F.sequence(F.floor(F.col("lo") / day), F.floor(F.col("b") / day))))
    return w.join(r, "d").filter((F.col("us") >= F.col("lo")) & (F.col("us") < F.col("b"))).select("window_start", "mapped_topic").distinct()


def rank_topics(w: DataFrame, recent_topics: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """All topics of every window with their components, score, rank and up to 20 candidate ids."""
    w = cut_lineage(w)  # six branches read it
    base = w.select(*WINDOW).distinct().withColumn("mapped_topic", F.explode(T.lit_array(V.MEMO_TOPICS)))
    best = top_per_key(w, KEYS, [F.desc("impact_score"), F.desc("ts"), "event_id"], 20)
    ids = best.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("position", "event_id"))).alias("c")).select(
        *KEYS, F.transform("c", lambda x: x["event_id"]).alias("candidate_ids"))
    df = base
    for part in (topic_volume(w), topic_novelty(w, recent_topics), topic_coherence(w), topic_actionability(w), ids):
        df = df.join(part, KEYS, "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    score = z("count_share") * 0.30 + z("weighted_share") * 0.25 + z("novelty") * 0.20 + z("coherence") * 0.15 + z("actionability") * 0.10
    df = df.select(*KEYS, F.round(score, 6).alias("topic_score"), F.coalesce("event_count", F.lit(0)).alias("event_count"),
                   *[F.round(z(c), 6).alias(c) for c in ("count_share", "weighted_share", "novelty", "coherence", "actionability")],
                   F.coalesce("candidate_ids", F.array().cast("array<bigint>")).alias("candidate_ids"))
    order = W.partitionBy(*WINDOW).orderBy(F.desc("topic_score"), F.desc("event_count"), "mapped_topic")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, min(limit, 20)))


def select_topic(ranked: DataFrame, threshold: float = V.TOPIC_THRESHOLD, topic: str | None = None) -> DataFrame:
    """Best topic per window, or ``no_topic_found`` below the threshold; a given topic bypasses the threshold."""
    if topic is not None:
        if topic not in V.MEMO_TOPICS:
            raise ValueError(f"unsupported topic {topic!r}")
        return ranked.filter(F.col("mapped_topic") == topic).select(*WINDOW, F.lit(topic).alias("selected_topic"), "topic_score", F.lit("manual_topic_override").alias("selection_reason"))
    ok = F.col("topic_score") >= threshold
    return ranked.filter("rank = 1").select(*WINDOW, F.when(ok, F.col("mapped_topic")).alias("selected_topic"), F.when(ok, F.col("topic_score")).alias("topic_score"),
                                            F.when(ok, "auto_selection_threshold_passed").otherwise("no_topic_found").alias("selection_reason"))


def driver_scores(w: DataFrame) -> DataFrame:
    """Seven drivers per (window, topic) with their four components and score."""
    dk = [*KEYS, "driver"]
    w = cut_lineage(w.select(*KEYS, "event_id", "ts", "impact", "span_us", "drivers", "relation_types", "entity_tokens"))
    s = w.withColumn("driver", F.explode("drivers"))
    total = w.groupBy(*KEYS).agg(exact_sum(F.col("impact")).alias("total"))
    n = F.count(F.lit(1))
    g = s.groupBy(*dk).agg(
        n.alias("n"), exact_sum(F.col("impact")).alias("supp"), (F.max(micros("ts")) - F.min(micros("ts"))).alias("spread"),
        F.max(F.arrays_overlap("relation_types", T.lit_array(V.CONFIRMABLE_RELATIONS))).alias("conf"), F.max("span_us").alias("span_us"))
    e = max_share(s, "entity_tokens", dk, "e")
    base = total.withColumn("driver", F.explode(T.lit_array([d for d, _ in V.DRIVERS])))
    df = base.join(g, dk, "left").join(e, dk, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    has, hour = F.col("n") > 0, float(HOUR)
    rate = F.col("n") / F.greatest(F.lit(1.0), F.greatest(F.lit(1.0), F.col("spread") / hour) / 12.0)
    scale = F.least(F.lit(1.0), 24.0 / F.greatest(F.lit(1.0), F.col("span_us") / hour))
    pts = lambda c, p: F.when(c, p).otherwise(0.0)
    df = df.withColumns({
        "support_weight": F.when(has & (F.col("total") > 0), T.clamp(F.col("supp") / F.col("total"), 0.0, 1.0)).otherwise(0.0),
        "temporal_density": F.when(~has, 0.0).when(F.col("n") == 1, 0.35).otherwise(T.clamp(rate / 2.5 * scale, 0.0, 1.0)),
        "entity_consistency": F.when(~has, 0.0).otherwise(F.coalesce("e", F.lit(0.30))),
        "confirmability": F.when(~has, 0.0).otherwise(T.clamp(
            F.when(F.col("n") >= 2, 0.50).otherwise(0.30) + pts(F.col("conf"), 0.30) + pts(F.col("supp") / F.col("n") >= 0.60, 0.20), 0.0, 1.0))})
    score = F.col("support_weight") * 0.40 + F.col("temporal_density") * 0.25 + F.col("entity_consistency") * 0.20 + F.col("confirmability") * 0.15
    return df.select(*dk, F.col("n").alias("supporting_events"), F.round(score, 6).alias("score"),
                     *[F.round(c, 6).alias(c) for c in ("support_weight", "temporal_density", "entity_consistency", "confirmability")])


def primary_driver(scores: DataFrame) -> DataFrame:
    """Best driver per (window, topic) when it has a score and support."""
    return top_per_key(scores, KEYS, [F.desc("score"), F.desc("supporting_events"), "driver"], 1).filter("score > 0 AND supporting_events > 0").drop("position")


def driver_share(w: DataFrame, drivers: DataFrame) -> DataFrame:
    n = w.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("selected_events"))
    return n.join(drivers, KEYS, "left").select(*KEYS, "driver", "selected_events", F.coalesce("supporting_events", F.lit(0)).alias("supporting_events"),
                                                F.round(F.coalesce("supporting_events", F.lit(0)) / F.col("selected_events"), 6).alias("supporting_share"))


def topic_stats(w: DataFrame) -> DataFrame:
    return w.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("event_count"), F.round(exact_sum(F.col("impact_score") * F.col("recency")), 4).alias("weighted_impact_score"),
        F.round(exact_sum(F.col("impact_score")) / F.count(F.lit(1)), 4).alias("average_impact_score"), F.round(F.max("impact_score"), 4).alias("max_impact_score"),
        F.count(F.when(F.col("frac") >= 2.0 / 3.0, 1)).alias("recent_event_count"))


def supporting_entities(w: DataFrame, limit: int = 10) -> DataFrame:
    named = {"countries": "countrie", "orgs": "org", "people": "people", "tickers": "ticker"}
    pairs = F.concat(*[F.transform(F.filter(c, lambda v: T.strip(v) != ""), _pair(kind)) for c, kind in named.items()])
    c = w.select(*KEYS, F.explode(pairs).alias("p")).groupBy(*KEYS, "p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(c, KEYS, [F.desc("n"), "kind", F.lower("value"), "value"], limit)


def _pair(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), T.strip(v).alias("value"))


def topic_timeline(w: DataFrame, n: int = 50) -> DataFrame:
    return top_per_key(w, KEYS, ["ts", "event_id"], max(1, min(n, 200))).select(*KEYS, "position", "event_id", "ts", "summary", "impact_score")


def memo_input_events(w: DataFrame, drivers: DataFrame) -> DataFrame:
    """Selected events with a zero-based position and whether they support the primary driver."""
    slim = w.select(*KEYS, "event_id", "impact_score", "ts", "drivers")
    pos = position_in(slim, KEYS, [F.desc("impact_score"), "ts", "event_id"], "p")
    return pos.join(drivers.select(*KEYS, "driver"), KEYS, "left").select(
        *KEYS, "event_id", (F.col("p") - 1).alias("position_index"), F.coalesce(F.array_contains("drivers", F.col("driver")), F.lit(False)).alias("driver_supporting"))


def fact_candidates(w: DataFrame, limit: int = 12) -> DataFrame:
    """Facts from summaries and market stats, the first ``limit`` by key. One decimal means half-up on the decimal value."""
    eid, impact = F.col("event_id").cast("string"), F.col("impact_score")
    one = lambda c, d: F.round(c.cast("decimal(18,6)"), d).cast(f"decimal(18,{d})").cast("string")
    summary = F.when(T.strip(F.col("summary")) != "", F.struct(
        F.concat(F.lit("event_"), eid, F.lit("_summary")).alias("fact_key"),
        F.concat(F.lit("Event "), eid, F.lit(" impact score "), one(impact, 1), F.lit(": "), T.strip(F.col("summary"))).alias("fact_text"),
        F.round(impact, 2).alias("numeric_value"), F.lit("impact_score").alias("unit")))
    stat = F.transform(F.col("market_stats"), lambda s, i: F.when((T.strip(s["label"]) != "") & s["value"].isNotNull(), F.struct(
        F.concat(F.lit("event_"), eid, F.lit("_market_stat_"), i.cast("string")).alias("fact_key"),
        F.concat(F.lit("Event "), eid, F.lit(" market stat "), T.strip(s["label"]), F.lit(": "), one(s["value"], 3),
                 F.when(T.strip(F.coalesce(s["unit"], F.lit(""))) != "", F.concat(F.lit(" "), T.strip(s["unit"]))).otherwise(""),
                 F.when(T.strip(F.coalesce(s["context"], F.lit(""))) != "", F.concat(F.lit(" ("), T.strip(s["context"]), F.lit(")"))).otherwise(""), F.lit(".")).alias("fact_text"),
        s["value"].alias("numeric_value"), F.nullif(T.strip(F.coalesce(s["unit"], F.lit(""))), F.lit("")).alias("unit"))))
    facts = w.select(*KEYS, F.explode(F.array_compact(F.concat(F.array(summary), stat))).alias("f")).select(*KEYS, "f.*")
    return top_per_key(facts, KEYS, ["fact_key"], limit)
