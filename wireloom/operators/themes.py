"""Theme matching, evidence bundles, assessments, cards and briefs for every theme and window at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vocab as V
from ..session import cut_lineage
from .asof import HOUR, latest_per_key, micros, top_per_key
from .filters import assign_windows
from .topics import exact_sum

WINDOW = ["window_start", "window_end"]
KEYS = ["theme_key", "cadence", *WINDOW]
CADENCES = {"daily": ("1 day", "1 day"), "weekly": ("7 days", "1 day")}


@dataclass(frozen=True)
class Theme:
    """A theme as configuration. ``matcher`` and ``scorer`` are DataFrame functions; None means the built-in ones."""

    key: str
    title: str
    energy_markers: tuple = V.ENERGY_MARKERS
    supply_markers: tuple = V.SUPPLY_MARKERS
    downstream_markers: tuple = V.DOWNSTREAM_MARKERS
    patterns: tuple = V.TRANSMISSION_PATTERNS
    lenses: tuple = V.LENSES
    cadences: tuple = ("daily", "weekly")
    gates: dict = field(default_factory=lambda: dict(V.CARD_GATES))
    matcher: Callable | None = None
    scorer: Callable[[DataFrame], DataFrame] | None = None
    provider: Callable[[DataFrame], DataFrame] | None = None


class ThemeRegistry:
    """Themes by key; checked when registered."""

    def __init__(self) -> None:
        self._themes: dict[str, Theme] = {}

    def register(self, theme: Theme) -> Theme:
        if not theme.key.strip():
            raise ValueError("a theme needs a key")
        if theme.key in self._themes:
            raise ValueError(f"theme {theme.key!r} is registered already")
        if not theme.lenses or not theme.cadences or not theme.patterns:
            raise ValueError("a theme needs lenses, cadences and patterns")
        if len({lens["key"] for lens in theme.lenses}) != len(theme.lenses):
            raise ValueError("lens keys repeat")
        if set(theme.cadences) - set(CADENCES):
            raise ValueError("unknown cadence")
        self._themes[theme.key] = theme
        return theme

    def get(self, key: str) -> Theme:
        if key not in self._themes:
            raise KeyError(f"unknown theme {key!r}")
        return self._themes[key]

    def all(self) -> list[Theme]:
        return [self._themes[k] for k in sorted(self._themes)]


REGISTRY = ThemeRegistry()
ENERGY_TO_AGRI = REGISTRY.register(Theme("energy_to_agri_inputs", "Energy to Agri Inputs"))


def payload_text() -> Column:
    low = lambda c: F.lower(T.strip(F.coalesce(c, F.lit(""))))
    words = lambda arr: F.array_join(F.filter(F.transform(arr, lambda v: F.lower(T.strip(v))), lambda v: v != ""), " ")
    labels = F.flatten(F.transform("market_stats", lambda s: F.array_compact(F.array(s["label"], s["context"]))))
    return T.strip(F.concat_ws(" ", low("summary"), low("source_claimed"), words(F.col("keywords")), words(labels)))


def archetypes(df: DataFrame) -> DataFrame:
    """Adds theme_text, archetypes (sorted), direction and archetype_reasons."""
    df = df.withColumn("theme_text", payload_text())
    text = F.col("theme_text")
    df = df.withColumn("_a", T.families_found(text, V.ARCHETYPES))
    bias = (F.col("topic") == "commodities") & ~F.array_contains("_a", "input_price_shock") & F.contains(text, F.lit("price"))
    stress, easing = T.has_any(text, V.STRESS_WORDS), T.has_any(text, V.EASING_WORDS)
    base = F.transform("_a", lambda a: F.concat(F.lit("archetype:"), a))
    return df.withColumns({
        "archetypes": F.array_sort(F.when(bias, F.array_append("_a", F.lit("input_price_shock"))).otherwise(F.col("_a"))),
        "archetype_reasons": F.array_sort(F.when(bias, F.array_append(base, F.lit("archetype:input_price_shock_topic_bias"))).otherwise(base)),
        "direction": F.when(stress & ~easing, "stress").when(easing & ~stress, "easing").otherwise("neutral"),
    }).drop("_a")


def match_theme(events: DataFrame, theme: Theme = ENERGY_TO_AGRI) -> DataFrame:
    """Matched events with hits, reasons and references. Needs the snapshot columns plus calibrated_score."""
    if theme.matcher is not None:
        return theme.matcher(events).withColumn("theme_key", F.lit(theme.key))
    # the predicate reads the text once; a filter does not share sub-expressions with its neighbours
    def shape(t: Column) -> Column:
        words = [w for name, family in V.ARCHETYPES if name in V.SUPPLY_SHAPE_ARCHETYPES or name == "input_price_shock" for w in family]
        bias = (F.col("topic") == "commodities") & F.contains(t, F.lit("price"))
        return T.has_any(t, theme.energy_markers) & (T.has_any(t, [*theme.supply_markers, *theme.downstream_markers, *words]) | F.coalesce(bias, F.lit(False)))

    df = archetypes(events.filter(T.let(payload_text(), shape)))
    text = F.col("theme_text")
    hit = lambda words: T.words_found(text, words)
    df = df.withColumns({"energy_hits": hit(theme.energy_markers), "supply_hits": hit(theme.supply_markers), "downstream_hits": hit(theme.downstream_markers)})
    supply = (F.size("supply_hits") > 0) | F.arrays_overlap("archetypes", T.lit_array(V.SUPPLY_SHAPE_ARCHETYPES))
    down = (F.size("downstream_hits") > 0) | F.array_contains("archetypes", "input_price_shock")
    energy = F.size("energy_hits") > 0
    low = lambda c: F.filter(F.transform(c, lambda v: F.lower(T.strip(v))), lambda v: v != "")
    reasons = F.concat(F.array_compact(F.array(
        F.when(energy, "theme_match:energy_signal"), F.when(supply, "theme_match:supply_shape"), F.when(down, "theme_match:downstream_shape"))), "archetype_reasons")
    return df.withColumns({
        "theme_key": F.lit(theme.key), "reason_codes": F.array_sort(F.array_distinct(reasons)),
        "entity_refs": F.array_sort(F.array_distinct(F.concat(low("orgs"), low("tickers")))), "geography_refs": F.array_sort(F.array_distinct(low("countries")))})


EVIDENCE = ["theme_key", "event_id", "claim_id", "event_time", "created_at", "impact_score", "calibrated_score", "archetypes", "direction", "entity_refs", "geography_refs",
            "reason_codes", "dedupe_key"]


def theme_evidence(matches: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Evidence rows keyed (theme, event, claim); a zero calibrated score falls back to the event impact; new rows win."""
    impact = F.coalesce("impact_score", F.lit(0.0))
    new = matches.withColumns({
        "impact_score": impact, "calibrated_score": F.coalesce(F.nullif("calibrated_score", F.lit(0.0)), impact),
        "dedupe_key": F.coalesce(F.nullif("claim_hash", F.lit("")), F.concat(F.lit("event:"), F.col("event_id").cast("string")))}).select(*EVIDENCE)
    both = new.withColumn("_v", F.lit(1))
    if existing is not None:
        both = both.unionByName(existing.select(*EVIDENCE).withColumn("_v", F.lit(0)))
    return latest_per_key(both, ["theme_key", "event_id", "claim_id"], [F.desc("_v"), F.desc("created_at")]).drop("_v")


def missing_theme_evidence(events: DataFrame, evidence: DataFrame, theme: Theme = ENERGY_TO_AGRI) -> DataFrame:
    """Events without a row for (theme, event, latest claim); the claim id compares null-safe."""
    have = evidence.filter(F.col("theme_key") == theme.key).select(F.col("event_id").alias("_e"), F.col("claim_id").alias("_c"))
    return events.join(have, (events["event_id"] == have["_e"]) & events["claim_id"].eqNullSafe(have["_c"]), "left_anti")


def theme_windows(df: DataFrame, cadence: str, col: str) -> DataFrame:
    length, every = CADENCES[cadence]
    return assign_windows(df, col, length, every).withColumn("cadence", F.lit(cadence))


def evidence_id() -> Column:
    """Id of an evidence row: 60 bits of the hash of theme, event and claim, so two claims of one event are two rows."""
    digest = F.sha2(F.concat_ws("|", "theme_key", F.col("event_id").cast("string"), F.col("claim_id").cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def windowed_evidence(evidence: DataFrame, cadences=("daily", "weekly")) -> DataFrame:
    """Each evidence row in every daily and weekly window it falls in (created_at stands in for a missing time)."""
    e = evidence.withColumns({"_t": F.coalesce("event_time", "created_at"), "evidence_id": evidence_id()})
    out = None
    for c in cadences:
        part = theme_windows(e, c, "_t")
        out = part if out is None else out.unionByName(part)
    return out.drop("_t")


ITEM_ORDER = lambda: [F.desc("score"), F.desc("time_us"), F.desc("event_id"), F.desc("claim_id")]


def best_per_key(items: DataFrame) -> DataFrame:
    """Best item per dedupe key and window with the number of repeats it stands for."""
    df = items.withColumns({"score": F.coalesce(F.nullif("calibrated_score", F.lit(0.0)), "impact_score"), "time_us": F.coalesce(micros("event_time"), F.lit(0).cast("long"))})
    n = df.groupBy(*KEYS, "dedupe_key").agg(F.count(F.lit(1)).alias("n_raw"))
    return latest_per_key(df, [*KEYS, "dedupe_key"], ITEM_ORDER()).join(n, [*KEYS, "dedupe_key"])


def evidence_mix(items: DataFrame, kind: str) -> DataFrame:
    """Counts of archetypes, entity_refs or geography_refs over unique items, long form."""
    return items.select(*KEYS, F.explode(kind).alias("key")).groupBy(*KEYS, "key").agg(F.count(F.lit(1)).alias("n"))


def severity(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").when(score >= 40, "low").otherwise("very_low")


def severity_histogram(items: DataFrame) -> DataFrame:
    return items.groupBy(*KEYS, severity(F.col("calibrated_score")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def freshness(df: DataFrame) -> Column:
    """Profile name from the counts n, recent, first_half and second_half."""
    share = lambda c: F.col(c) / F.col("n")
    return (F.when(F.col("n") < 3, "sparse").when(share("recent") >= 0.6, "recent_spike")
            .when((share("first_half") >= 0.3) & (share("second_half") >= 0.3), "persistent_buildup").otherwise("distributed_accumulation"))


def evidence_bundles(items: DataFrame) -> DataFrame:
    """One row per theme, cadence and window from :func:`best_per_key` items. Id lists hold five and three ids."""
    easing = F.col("direction") == "easing"
    t, a, b = micros("event_time"), micros("window_start"), micros("window_end")
    mid = a + F.greatest(b - a, F.lit(HOUR)) / 2
    n = lambda c: F.count(F.when(c, 1))
    g = items.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_raw").alias("total_raw"), n(~easing).alias("supporting"), n(easing).alias("contradictory"),
        (exact_sum(F.col("calibrated_score")) / F.count(F.lit(1))).alias("avg_score"), n(t >= b - 6 * HOUR).alias("recent"),
        n(t < mid).alias("first_half"), n(t >= mid).alias("second_half"), n(F.col("calibrated_score") >= 80).alias("n_high"))

    def ids(part: DataFrame, k: int, out: str) -> DataFrame:
        top = top_per_key(part, KEYS, ITEM_ORDER(), k)
        return top.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("position", "evidence_id"))).alias("x")).select(
            *KEYS, F.transform("x", lambda v: v["evidence_id"]).alias(out))

    mix = evidence_mix(items, "archetypes").groupBy(*KEYS).agg(F.array_sort(F.collect_list("key")).alias("archetypes"))
    df = g.join(ids(items.filter(~easing), 5, "top_supporting"), KEYS, "left").join(ids(items.filter(easing), 3, "top_contradictory"), KEYS, "left").join(mix, KEYS, "left")
    none = F.array().cast("array<bigint>")
    ratio = lambda x, y: F.round(x / y, 4)
    return df.withColumns({
        "top_supporting": F.coalesce("top_supporting", none), "top_contradictory": F.coalesce("top_contradictory", none),
        "archetypes": F.coalesce("archetypes", F.array().cast("array<string>")), "freshness": freshness(df),
        "repeat_ratio": ratio(F.col("total_raw") - F.col("n"), F.col("total_raw")), "novelty_ratio": ratio(F.col("n"), F.col("total_raw")),
        "contradiction_ratio": ratio(F.col("contradictory"), F.col("n"))})


def bundle_direction(df: DataFrame) -> DataFrame:
    """Adds ``directionality`` from the sizes of the top lists."""
    s, c = F.size("top_supporting"), F.size("top_contradictory")
    return df.withColumn("directionality", F.when((s > 0) & (c == 0), "stress_accumulation").when(s > c, "stress_dominant").when(c > s, "easing_dominant").otherwise("mixed"))


def bundle_drivers(items: DataFrame) -> DataFrame:
    """Top keys of the three mixes: four archetypes, five entities, five geographies."""
    out = None
    for kind, k in (("archetypes", 4), ("entity_refs", 5), ("geography_refs", 5)):
        part = top_per_key(evidence_mix(items, kind), KEYS, [F.desc("n"), "key"], k).withColumn("mix", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def evidence_strength(df: DataFrame) -> DataFrame:
    boost = T.lookup(F.col("freshness"), {"recent_spike": 8.0, "persistent_buildup": 10.0, "distributed_accumulation": 5.0, "sparse": 0.0})
    stress = F.when(F.col("directionality").isin("stress_accumulation", "stress_dominant"), 4.0).otherwise(0.0)
    raw = (F.col("n") * 7.0 + F.col("avg_score") * 0.45 + F.size("top_supporting") * 2.0 - F.size("top_contradictory") * 2.5
           + boost + F.col("novelty_ratio") * 10.0 + stress)
    return df.withColumn("evidence_strength", T.clamp(raw, 0.0, 100.0))


def bundle_signals(df: DataFrame) -> DataFrame:
    has = lambda *names: F.arrays_overlap("archetypes", T.lit_array(names))
    return df.withColumn("signals", F.array_compact(F.array(
        F.when(has("input_price_shock") | (F.col("n_high") > 0), "energy_price_or_cost_stress"),
        F.when(has(*V.SUPPLY_SHAPE_ARCHETYPES), "supply_side_friction"),
        F.when(has("capacity_expansion_closure", "outage_restart"), "capacity_or_utilization_stress"),
        F.when(F.col("freshness").isin("persistent_buildup", "distributed_accumulation") & has("supply_disruption", "capacity_expansion_closure"),
               "persistent_supply_tightening"))))


def _lens_array(theme: Theme) -> Column:
    return F.array(*[F.struct(
        F.lit(x["key"]).alias("key"), F.lit(x["pattern"]).alias("pattern"), T.lit_array(x["archetypes"]).alias("archetypes"), T.lit_array(x["signals"]).alias("signals"),
        *[F.lit(float(x[k])).alias(k) for k in ("recent_spike", "persistent_buildup", "contradiction")]) for x in theme.lenses])


def lens_fit(df: DataFrame, theme: Theme = ENERGY_TO_AGRI) -> DataFrame:
    """One row per bundle and lens with fit score; active at 45. Needs signals."""
    x = df.withColumn("lens", F.explode(_lens_array(theme)))
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(b))
    mod = (F.when(F.col("freshness") == "recent_spike", F.col("lens.recent_spike")).otherwise(0.0)
           + F.when(F.col("freshness") == "persistent_buildup", F.col("lens.persistent_buildup")).otherwise(0.0)
           + F.when(F.size("top_contradictory") > 0, F.col("lens.contradiction")).otherwise(0.0))
    fit = F.when(F.size("lens.signals") == 0, 0.0).otherwise(T.clamp(share("signals", F.col("lens.signals")) * 60.0 + share("archetypes", F.col("lens.archetypes")) * 35.0 + mod, 0.0, 100.0))
    return x.withColumns({"lens_key": F.col("lens.key"), "lens_pattern": F.col("lens.pattern"), "lens_fit": fit}).withColumn("active", F.col("lens_fit") >= 45.0).drop("lens")


def patterns(fits: DataFrame, theme: Theme = ENERGY_TO_AGRI) -> DataFrame:
    """Active lenses and allowed transmission patterns per bundle (bundle without an active lens drops out)."""
    active = fits.filter("active")
    g = active.groupBy(*KEYS).agg(F.array_sort(F.collect_set("lens_key")).alias("active_lenses"), F.collect_set("lens_pattern").alias("p"), F.first("archetypes").alias("a"))
    extra = [F.when(F.array_contains("a", a), p) for a, p in (
        ("logistics_disruption", "trade_flow_rerouting"), ("supply_disruption", "supply_tightening"), ("input_price_shock", "margin_compression_expansion"))]
    allowed = T.lit_array(theme.patterns)
    return g.select(*KEYS, "active_lenses", F.array_sort(F.array_intersect(F.array_union("p", F.array_compact(F.array(*extra))), allowed)).alias("active_patterns"))


def confidence_score(strength: Column, fit: Column) -> Column:
    bonus = T.lookup(F.col("freshness"), {"recent_spike": 6.0, "persistent_buildup": 8.0, "distributed_accumulation": 4.0, "sparse": -4.0})
    return T.clamp(strength * 0.5 + fit * 0.35 + bonus - F.col("contradiction_ratio") * 15.0, 0.0, 100.0)


def urgency(confidence: Column) -> Column:
    return (F.when((confidence >= 75) & F.col("freshness").isin("recent_spike", "persistent_buildup"), "high").when(confidence >= 55, "medium").otherwise("low"))


def horizon() -> Column:
    return F.when(F.col("freshness") == "recent_spike", "short_term").when(F.col("freshness") == "persistent_buildup", "medium_term").otherwise("medium_to_long_term")


def default_scorer(bundles: DataFrame) -> DataFrame:
    """Scoring strategy surface: evidence strength and confidence at a neutral lens fit of 50."""
    df = evidence_strength(bundle_direction(bundles))
    conf = confidence_score(F.col("evidence_strength"), F.lit(50.0))
    return df.withColumn("confidence", conf).withColumns({"urgency": urgency(F.col("confidence")), "time_horizon": horizon()})


def assessments(bundles: DataFrame, theme: Theme = ENERGY_TO_AGRI) -> DataFrame:
    """One row per bundle and active lens, keyed by ``stable_key``. Dates inside the key are ISO text."""
    prepared = theme.provider(bundles) if theme.provider else bundle_direction(bundles)
    scored = theme.scorer(prepared) if theme.scorer else evidence_strength(prepared)
    fits = lens_fit(bundle_signals(scored), theme)
    df = fits.filter("active").join(patterns(fits, theme), KEYS)
    s, l, c = F.col("evidence_strength"), F.col("lens_fit"), F.col("contradiction_ratio")
    df = df.withColumns({"priority": T.clamp(s * 0.45 + l * 0.45 - c * 20.0, 0.0, 100.0), "confidence": confidence_score(s, l)})
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    key = F.sha2(F.concat_ws("|", "theme_key", "cadence", iso("window_start"), iso("window_end"), "lens_key",
                             F.array_join(F.transform(F.slice("top_supporting", 1, 3), lambda v: v.cast("string")), ",")), 256)
    df = df.withColumns({
        "urgency": urgency(F.col("confidence")), "time_horizon": horizon(), "assessment_status": F.when(F.col("confidence") >= 50, "active").otherwise("watch"), "stable_key": key})
    return df.dropDuplicates(["stable_key"])


def card_gates(df: DataFrame, theme: Theme = ENERGY_TO_AGRI) -> Column:
    """Name of the first failing gate, or null."""
    g = theme.gates
    return (F.when(F.col("evidence_strength") < g["strength"], "gate:evidence_strength_below_threshold")
            .when(F.col("confidence") < g["confidence"], "gate:confidence_below_threshold").when(F.col("priority") < g["priority"], "gate:priority_below_threshold"))


def card_fields(df: DataFrame) -> DataFrame:
    """Card texts, opportunity angles, evidence references and narrative signature of each assessment."""
    lens, pattern = F.coalesce("lens_key", F.lit("theme_signal")), F.coalesce("lens_pattern", F.lit("input_cost_pass_through"))
    spaced = F.replace(pattern, F.lit("_"), F.lit(" "))
    angles = F.coalesce(T.lookup(lens, {k: list(v) for k, v in V.OPPORTUNITY_TEXT.items()}), F.array().cast("array<string>"))
    risk1 = T.lookup(lens, {k: v[0] for k, v in V.RISK_TEXT.items()})
    stop = T.lookup(lens, {k: "; ".join(v) for k, v in V.INVALIDATION_TEXT.items()})
    return df.withColumns({
        "title": F.concat("theme_key", F.lit(": "), F.initcap(F.replace(lens, F.lit("_"), F.lit(" "))), F.lit(" signal")),
        "what_happened": F.concat(F.lit("Window evidence shows "), F.size("top_supporting").cast("string"), F.lit(" supporting signals with "), "urgency",
                                  F.lit(" urgency and "), "time_horizon", F.lit(" horizon.")),
        "why_it_matters": F.concat(F.lit("Transmission via "), spaced, F.lit(" can affect downstream agri-input pricing or capacity dynamics.")),
        "transmission_path": F.concat(F.lit("Energy/supply stress -> "), spaced, F.lit(" -> agri-input pressure/capacity response")),
        "watch_next": F.concat(F.lit("Track incremental supportive vs contradictory evidence in the next batch window."), F.coalesce(F.concat(F.lit(" Key risk watch: "), risk1), F.lit(""))),
        "invalidation": F.coalesce(stop, F.lit("")), "opportunity_angles": angles, "supporting_evidence_refs": F.col("top_supporting"),
        "narrative_signature": F.sha2(F.concat_ws("|", "theme_key", lens, pattern, F.coalesce(F.lower(F.get(angles, F.lit(0))), F.lit("none"))), 256)})


def material_change(cur: str = "", prior: str = "p_") -> Column:
    """First rule by which a card differs from the prior similar one; null when nothing changed or there is none."""
    a, b = lambda c: F.col(cur + c), lambda c: F.col(prior + c)
    return (
        F.when(b("confidence").isNull(), None)
        .when(F.abs(a("confidence") - b("confidence")) >= V.CARD_CHANGE["confidence"], "material_change:confidence_delta")
        .when(F.abs(a("priority") - b("priority")) >= V.CARD_CHANGE["priority"], "material_change:priority_delta")
        .when(T.jaccard(a("top_supporting"), b("top_supporting"), 1.0) <= V.CARD_CHANGE["overlap"], "material_change:supporting_evidence_shift")
        .when(a("lens_pattern") != b("lens_pattern"), "material_change:transmission_pattern_shift")
        .when(a("assessment_status") != b("assessment_status"), "material_change:assessment_status_shift"))


PRIOR = ("confidence", "priority", "top_supporting", "lens_pattern", "assessment_status")


def similar_card(cards: DataFrame, history: DataFrame, at: str = "created_at") -> DataFrame:
    """Most recent emitted or updated card of the same theme and narrative inside the look-back, as ``p_`` columns.

    Candidates are cut to the latest per (signature, day) before the join, and the look-back spans at most 28 days,
    so a card meets a bounded number of rows. Several cards of one day are resolved by time.
    """
    day = 24 * HOUR
    days = T.lookup(F.col("cadence"), V.CARD_LOOKBACK_DAYS)
    h = history.filter(F.col("card_status").isin("emitted", "updated")).select(
        "theme_key", "narrative_signature", F.floor(micros("created_at") / day).alias("_d"), F.struct(micros("created_at").alias("us"), F.col("card_id").alias("id"), *PRIOR).alias("_h"))
    c = cards.withColumn("_now", micros(at)).withColumn("_lo", F.col("_now") - days * day)
    probe = c.select("stable_key", "theme_key", "narrative_signature", "_now", "_lo", F.explode(F.sequence(F.floor(F.col("_lo") / day), F.floor(F.col("_now") / day))).alias("_d"))
    hit = probe.join(h, ["theme_key", "narrative_signature", "_d"]).filter((F.col("_h.us") >= F.col("_lo")) & (F.col("_h.us") < F.col("_now")))
    best = hit.groupBy("stable_key").agg(F.max("_h").alias("_h"))
    return c.join(best, "stable_key", "left").withColumns({**{f"p_{x}": F.col(f"_h.{x}") for x in PRIOR}, "prior_card_id": F.col("_h.id")}).drop("_h", "_now", "_lo")


_CHAIN = ("theme_key", "narrative_signature", "stable_key", "confidence", "priority", "top_supporting", "lens_pattern", "assessment_status")
_CHAIN_OUT = "stable_key string, prior_card_id string, change string, card_status string"


def _differs(a, b) -> str | None:
    """The rule of :func:`material_change` for two rows."""
    if b.confidence is None or b.confidence != b.confidence:
        return None
    limit, one, two = V.CARD_CHANGE, set(a.top_supporting), set(b.top_supporting)
    if abs(a.confidence - b.confidence) >= limit["confidence"]:
        return "material_change:confidence_delta"
    if abs(a.priority - b.priority) >= limit["priority"]:
        return "material_change:priority_delta"
    if (len(one & two) / len(one | two) if one | two else 1.0) <= limit["overlap"]:
        return "material_change:supporting_evidence_shift"
    if a.lens_pattern is not None and b.lens_pattern is not None and a.lens_pattern != b.lens_pattern:
        return "material_change:transmission_pattern_shift"
    if a.assessment_status != b.assessment_status:
        return "material_change:assessment_status_shift"
    return None


def _chain_cards(dry_run: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        live, out = [], []  # cards that count as history, in time order
        for r in pdf.sort_values(["us", "stable_key"], kind="stable").itertuples(index=False):
            if r.known:
                live.append(r)
                continue
            near = [x for x in live if r.lo <= x.us < r.us]
            prior = max(near, key=lambda x: (x.us, x.stable_key)) if near else None
            change = _differs(r, prior) if prior is not None else None
            status = "draft_only" if r.gate else "emitted" if prior is None else "updated" if change else "repeat_suppressed"
            if status in ("emitted", "updated") and not dry_run:
                live.append(r)
            out.append((r.stable_key, prior.stable_key if prior is not None else None, change, status))
        return pd.DataFrame(out, columns=["stable_key", "prior_card_id", "change", "card_status"])

    return run


def emit_cards(assessed: DataFrame, history: DataFrame | None = None, at: str = "created_at", theme: Theme = ENERGY_TO_AGRI, dry_run: bool = False) -> DataFrame:
    """Card status, suppression and change reason of each assessment, in time order per theme and narrative.

    A card is compared with the most recent card of its narrative that was emitted or updated before it inside the look-back, be it from
    ``history`` or from the same batch, and of whatever cadence; suppressed cards and drafts never count, and cards of one moment do
    not see each other. A narrative has at most a few cards per window, so its chain (grown with the calendar, not with the events) is one group.
    """
    day = 24 * HOUR
    days = T.lookup(F.col("cadence"), V.CARD_LOOKBACK_DAYS)
    cards = card_fields(assessed).withColumn("_gate", card_gates(assessed, theme))
    rows = cards.select(*_CHAIN, micros(at).alias("us"), (micros(at) - days * day).alias("lo"), F.col("_gate").alias("gate"), F.lit(False).alias("known"))
    if history is not None:
        old = history.filter(F.col("card_status").isin("emitted", "updated")).withColumn("stable_key", F.col("card_id").cast("string"))
        rows = rows.unionByName(old.select(*_CHAIN, micros("created_at").alias("us"), F.lit(0).cast("long").alias("lo"), F.lit(None).cast("string").alias("gate"), F.lit(True).alias("known")))
    done = rows.groupBy("theme_key", "narrative_signature").applyInPandas(_chain_cards(dry_run), _CHAIN_OUT)
    df = cards.join(done, "stable_key")
    why = F.when(F.col("card_status") == "repeat_suppressed", "duplicate:materially_similar_recent_card").otherwise(F.col("_gate"))
    final = F.col("card_status")
    if dry_run:
        cut = F.col("card_status").isin("emitted", "updated")
        why, final = F.when(cut, "dry_run:no_emit").otherwise(why), F.when(cut, "draft_only").otherwise(final)
    return df.withColumns({"suppression_reason": why, "material_update_reason": F.when(F.col("_gate").isNull(), F.col("change")), "card_status": final}).drop("_gate")


def briefs(bundles: DataFrame, cards: DataFrame, theme: Theme = ENERGY_TO_AGRI) -> DataFrame:
    """Summary text per run: counts and the first three emitted cards in the order in which the theme defines its lenses (a run has one card per lens)."""
    rank = F.coalesce(T.lookup(F.col("lens_key"), {x["key"]: i for i, x in enumerate(theme.lenses)}), F.lit(len(theme.lenses)))
    live = F.col("card_status").isin("emitted", "updated")
    line = F.when(live, F.struct(rank.alias("rank"), "lens_key", F.concat(F.lit("- "), "title", F.lit(" (confidence="), F.round("confidence", 1).cast("string"), F.lit(")")).alias("t"), "title"))
    g = cards.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_assessments"), F.count(F.when(live, 1)).alias("n_emitted"), F.array_sort(F.collect_list(line)).alias("lines"))
    df = bundles.select(*KEYS).join(g, KEYS, "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    body = F.when(z("n_emitted") == 0, "- No thesis card met emit thresholds for this run.").otherwise(
        F.array_join(F.transform(F.slice("lines", 1, 3), lambda x: x["t"]), "\n"))
    return df.select(*KEYS, z("n_assessments").alias("n_assessments"), z("n_emitted").alias("n_emitted"), F.concat_ws(
        "\n", F.concat(F.lit("Theme: "), "theme_key"), F.concat(F.lit("Cadence: "), "cadence"),
        F.concat(F.lit("Window: "), iso("window_start"), F.lit(" -> "), iso("window_end"), F.lit(" (UTC, half-open)")),
        F.concat(F.lit("Assessments: "), z("n_assessments").cast("string")), F.concat(F.lit("Cards emitted/updated: "), z("n_emitted").cast("string")), body).alias("summary_text"),
        F.coalesce(F.array_join(F.transform(F.slice("lines", 1, 5), lambda x: x["title"]), "|"), F.lit("")).alias("highlights"))


def run_metrics(bundles: DataFrame, cards: DataFrame) -> DataFrame:
    """Evidence, assessment, card, emitted and suppressed counts per theme run."""
    n = lambda *s: F.count(F.when(F.col("card_status").isin(*s), 1))
    g = cards.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("assessment_count"), n("emitted", "updated").alias("emitted_count"), n("repeat_suppressed").alias("suppressed_count"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return bundles.select(*KEYS, F.col("n").alias("evidence_count")).join(g, KEYS, "left").select(
        *KEYS, "evidence_count", z("assessment_count"), F.coalesce("assessment_count", F.lit(0)).alias("card_count"), z("emitted_count"), z("suppressed_count"))
