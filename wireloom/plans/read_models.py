"""Read-model jobs composed from the operators: theme runs, topic memos, digest artifacts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import digest, themes, topics
from ..session import cut_lineage
from ..sources.messages import due_publications, merge_artifacts


def best_payload(df: DataFrame, canonical: str = "canonical_payload", raw: str = "payload") -> Column:
    """Canonical payload when there is one, else the raw one."""
    return F.coalesce(df[canonical], df[raw])


def evidence_events(evidence: DataFrame, events: DataFrame, start, end) -> DataFrame:
    """Evidence of a window (created time stands in for a missing one) with the summary of its event."""
    when = F.coalesce("event_time", "created_at")
    inside = evidence.filter((when >= start) & (when < end))
    return inside.join(events.select("event_id", F.trim("summary").alias("event_summary")), "event_id")


def theme_batch(events: DataFrame, evidence: DataFrame | None = None, history: DataFrame | None = None, theme: themes.Theme = themes.ENERGY_TO_AGRI,
                cadences=("daily", "weekly"), dry_run: bool = False) -> dict[str, DataFrame]:
    """Catch-up, bundles, assessments, cards, briefs and run counts for all windows of the cadences.

    ``history`` holds cards emitted before this batch; cards of the batch see each other in time order.
    """
    missing = events if evidence is None else themes.missing_theme_evidence(events, evidence, theme)
    full = themes.theme_evidence(themes.match_theme(missing, theme), evidence)
    items = cut_lineage(themes.best_per_key(themes.windowed_evidence(full, cadences)))
    bundles = cut_lineage(themes.evidence_bundles(items))
    assessed = cut_lineage(themes.assessments(bundles, theme).withColumn("created_at", F.col("window_end")))
    cards = cut_lineage(themes.emit_cards(assessed, history, theme=theme, dry_run=dry_run))
    return {"evidence": full, "bundles": bundles, "drivers": themes.bundle_drivers(items), "assessments": assessed, "cards": cards,
            "briefs": themes.briefs(bundles, cards, theme), "runs": themes.run_metrics(bundles, cards)}


def theme_batches(events: DataFrame, registered: Iterable[themes.Theme], evidence: DataFrame | None = None, history: DataFrame | None = None,
                  cadences=("daily", "weekly"), dry_run: bool = False) -> dict[str, DataFrame]:
    """:func:`theme_batch` of every theme in one run, the same tables of all themes put together.

    Themes are configuration, a few per deployment; events are read once. A theme runs in its own cadences only, and sees only its own
    evidence and cards. Columns that only the hooks of one theme add are null for the others.
    """
    registered = [(theme, tuple(c for c in cadences if c in theme.cadences)) for theme in registered]
    if not any(own for _, own in registered):
        raise ValueError("no theme runs in these cadences")
    events = cut_lineage(events)
    mine = lambda df, theme: None if df is None else df.filter(F.col("theme_key") == theme.key)
    runs = [theme_batch(events, mine(evidence, theme), mine(history, theme), theme, own, dry_run) for theme, own in registered if own]
    return {name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [run[name] for run in runs]) for name in runs[0]}


def memo_packs(snapshots: DataFrame, runs: DataFrame | None = None, length: str = "1 day", threshold: float = 0.58) -> dict[str, DataFrame]:
    """Ranking, selection and the input pack of the selected topic of every window."""
    w = cut_lineage(topics.windowed(topics.map_topics(snapshots), length))
    ranked = cut_lineage(topics.rank_topics(w, None if runs is None else topics.recent_memo_topics(w, runs)))
    chosen = topics.select_topic(ranked, threshold)
    mine = cut_lineage(w.join(chosen.filter(F.col("selected_topic").isNotNull()).select(*topics.WINDOW, F.col("selected_topic").alias("mapped_topic")), topics.KEYS, "left_semi"))
    scores = topics.driver_scores(mine)
    primary = topics.primary_driver(scores)
    return {"ranking": ranked, "selection": chosen, "drivers": scores, "primary_driver": primary, "driver_share": topics.driver_share(mine, primary),
            "stats": topics.topic_stats(mine), "timeline": topics.topic_timeline(mine), "input_events": topics.memo_input_events(mine, primary),
            "entities": topics.supporting_entities(mine), "facts": topics.fact_candidates(mine)}


def digest_run(events: DataFrame, stored_artifacts: DataFrame, ledger: DataFrame, destination: str = "vip_telegram", length: str = "4 hours") -> dict[str, DataFrame]:
    """Layout, texts, the artifact table and the publications that are due, for every window of one destination."""
    source = cut_lineage(digest.windowed_source(events, length, None, destination))
    layout = cut_lineage(digest.digest_layout(digest.digest_groups(source)))
    texts = digest.digest_text(layout, source).join(digest.input_hash(source, "3/6"), digest.WINDOW)
    new = texts.select(F.xxhash64("input_hash").alias("artifact_id"), "input_hash", "canonical_hash")
    artifacts = cut_lineage(merge_artifacts(new, stored_artifacts))
    return {"layout": layout, "texts": texts, "artifacts": artifacts, "due": due_publications(artifacts, ledger, [destination]), "coverage": digest.digest_coverage(layout)}
