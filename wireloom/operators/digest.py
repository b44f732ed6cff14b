"""Digest windows: source rows, duplicate clusters, layout, coverage, text and hashes for all windows at once.

Rows carry ``by`` columns (window_start, window_end); every function works on all windows in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T, vocab as V
from ..session import cut_lineage, shuffled
from .asof import micros, top_per_key
from .filters import PUBLISH_FLAGS, assign_windows, min_impact_exclusive, unpublished
from .graph import components

WINDOW = ["window_start", "window_end"]


def topic_label(topic: Column) -> Column:
    clean = T.strip(F.coalesce(topic, F.lit("")))
    return F.when(clean == "", "Other").otherwise(F.coalesce(T.lookup(clean, V.TOPIC_LABELS), clean))


def digest_source(events: DataFrame) -> DataFrame:
    """Label, clean summary and identity keys. Needs event_id, topic, summary, impact_score, last_updated_at,
    fingerprint, claim_hash."""
    blank = lambda c: F.when(T.strip(F.col(c)) != "", T.strip(F.col(c)))
    clean = T.squeeze(F.coalesce("summary", F.lit("")))
    df = events.withColumns({
        "topic_label": topic_label(F.col("topic")), "summary": F.when(clean == "", "(no summary)").otherwise(clean),
        "fingerprint": blank("fingerprint"), "claim_hash": blank("claim_hash")})
    return df.withColumn("summary_key", T.compare_key(F.col("summary")))


KEYS = ["_claim", "_fp", "summary_key"]


def _keyed(source: DataFrame) -> DataFrame:
    """``source`` with its identity keys, empty where there is none; ``_solo`` keeps an event without any key alone. ``_anchor`` is the first key there is."""
    low = {"_claim": F.coalesce(F.lower("claim_hash"), F.lit("")), "_fp": F.coalesce(F.lower("fingerprint"), F.lit("")), "summary_key": F.coalesce("summary_key", F.lit(""))}
    keyed = source.withColumns(low)
    some = lambda k, head: F.when(F.col(k) != "", F.concat(F.lit(head), F.col(k)))
    solo = F.when((F.col("_claim") == "") & (F.col("_fp") == "") & (F.col("summary_key") == ""), F.col("event_id")).otherwise(-1)
    return keyed.withColumn("_solo", solo).withColumn(
        "_anchor", F.coalesce(some("_fp", "f"), some("_claim", "c"), some("summary_key", "s"), F.concat(F.lit("e"), F.col("_solo").cast("string"))))


def _anchor_clusters(profiles: DataFrame, by: list[str]) -> DataFrame:
    """The cluster of every anchor (``by``, topic_label, _anchor, cluster_id). ``profiles``: the distinct keys with ``rep``, their smallest event id.

    Events of one anchor are one cluster from the start and thus one node, so the search runs over as many nodes as a window has
    anchors, however many events share them; the other keys tie anchors.
    """
    group = [*by, "topic_label"]
    reps = cut_lineage(profiles.groupBy(*group, "_anchor").agg(F.min("rep").alias("rep")))
    node = F.struct(*by, F.col("rep").alias("id"))
    kind = lambda k: F.when(F.col(k) != "", F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")))
    # a pair of keys comes from many events, so it is made single before it meets the node of its anchor
    ties = profiles.select(*group, "_anchor", F.explode(F.array_compact(F.array(*[kind(k) for k in KEYS if k != "_fp"]))).alias("key")).distinct()
    edges = ties.join(shuffled(reps), [*group, "_anchor"]).select(node.alias("node"), F.struct(*group, "key").alias("key"))
    labels = components(edges).select(*[F.col(f"node.{c}").alias(c) for c in by], F.col("node.id").alias("rep"), F.col("label.id").alias("_label"))
    return reps.join(shuffled(labels), [*by, "rep"], "left").select(*group, "_anchor", F.coalesce("_label", "rep").alias("cluster_id"))


def digest_clusters(source: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    """Adds ``cluster_id`` (smallest event id of the cluster): events of one label meet when they share claim hash,
    fingerprint or summary key, transitively."""
    group = [*by, "topic_label"]
    keyed = _keyed(source)
    profiles = cut_lineage(keyed.groupBy(*group, *KEYS, "_anchor").agg(F.min("event_id").alias("rep")))
    named = _anchor_clusters(profiles, by)
    return keyed.join(shuffled(named), [*group, "_anchor"]).drop("_claim", "_fp", "_solo", "_anchor")


_FIRST = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("event_id", c)))


def _merged() -> list[Column]:
    """What is kept of the events that are put together: the best one, best impact, last update, their number, first keys."""
    order = F.struct((-F.coalesce("impact_score", F.lit(-1.0))).alias("a"), (-micros("last_updated_at")).alias("b"), F.col("event_id").alias("c"),
                     "summary", "fingerprint", "claim_hash")
    return [F.min(order).alias("r"), F.max("impact_score").alias("impact_score"), F.max("last_updated_at").alias("last_updated_at"),
            F.count(F.lit(1)).alias("n_events"), _FIRST("fingerprint").alias("f"), _FIRST("claim_hash").alias("h")]


def _cluster_rows(g: DataFrame, by: list[str]) -> DataFrame:
    return g.select(
        *by, "topic_label", "cluster_id", F.col("r.c").alias("representative_id"), F.col("r.summary").alias("summary"), "impact_score",
        "last_updated_at", F.coalesce("r.fingerprint", "f.fingerprint").alias("fingerprint"), F.coalesce("r.claim_hash", "h.claim_hash").alias("claim_hash"), "n_events")


def merge_clusters(clustered: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    """One row per cluster: representative fields, best impact, last update, member count."""
    return _cluster_rows(clustered.groupBy(*by, "topic_label", "cluster_id").agg(*_merged()), by)


GROUP_ORDER = lambda: [F.desc(F.coalesce("impact_score", F.lit(-1.0))), F.desc("last_updated_at"), F.asc("representative_id")]


def digest_groups(source: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    """The clusters of :func:`digest_clusters`, merged; events are put together by anchor first, so the rows are read once and no event is joined."""
    group = [*by, "topic_label"]
    keyed = _keyed(source)
    profiles = cut_lineage(keyed.groupBy(*group, *KEYS, "_anchor").agg(F.min("event_id").alias("rep"), *_merged()))
    parts = [F.min("r").alias("r"), F.max("impact_score").alias("impact_score"), F.max("last_updated_at").alias("last_updated_at"), F.sum("n_events").alias("n_events"), F.min("f").alias("f"), F.min("h").alias("h")]
    anchors = profiles.groupBy(*group, "_anchor").agg(*parts)
    named = _anchor_clusters(profiles, by)
    return _cluster_rows(anchors.join(shuffled(named), [*group, "_anchor"]).groupBy(*group, "cluster_id").agg(*parts), by)


def digest_layout(groups: DataFrame, top: int = 3, per_section: int = 6, by: list[str] = WINDOW) -> DataFrame:
    """Bullets: the best ``top`` of a window, then up to ``per_section`` of the rest per label (0 = no section cap)."""
    marked = groups
    heads = top_per_key(marked, by, GROUP_ORDER(), top) if top > 0 else marked.limit(0).withColumn("position", F.lit(0))
    rest = marked.join(heads.select(*by, "representative_id"), [*by, "representative_id"], "left_anti")
    ranked = rest.withColumn("position", F.row_number().over(W.partitionBy(*by, "topic_label").orderBy(*GROUP_ORDER())))
    if per_section > 0:
        ranked = ranked.filter(F.col("position") <= per_section)
    cols = [*by, "section", "position", "topic_label", "representative_id", "summary", "impact_score", "n_events"]
    return heads.withColumn("section", F.lit("top")).select(*cols).unionByName(ranked.withColumn("section", F.col("topic_label")).select(*cols))


def digest_coverage(layout: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    """Covered events per section and in all (section ``*``); clusters of a window are disjoint, so counts add up."""
    both = layout.select(*by, F.explode(F.array(F.col("section"), F.lit("*"))).alias("section"), "n_events")
    return both.groupBy(*by, "section").agg(F.sum("n_events").alias("covered_events"), F.count(F.lit(1)).alias("n_bullets"))


def covered_events(clustered: DataFrame, layout: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    """The events that a digest covers: one row per event of each bullet, with the bullet's section, position and representative."""
    members = clustered.select(*by, "topic_label", "cluster_id", "event_id")
    heads = members.select(*by, F.col("event_id").alias("representative_id"), "cluster_id")
    told = layout.select(*by, "section", "position", "representative_id").join(heads, [*by, "representative_id"])
    return told.join(members.drop("topic_label"), [*by, "cluster_id"]).select(*by, "section", "position", "representative_id", "event_id")


def mark_published(events: DataFrame, covered: DataFrame, destination: str) -> DataFrame:
    """Events after a destination has taken a digest: those it covers carry the destination's flag, so the next digest leaves them out."""
    flag = PUBLISH_FLAGS.get(destination)
    if flag is None:
        return events
    hit = covered.select("event_id").distinct().withColumn("_covered", F.lit(True))
    return events.join(hit, "event_id", "left").withColumn(flag, F.coalesce("_covered", flag, F.lit(False))).drop("_covered")


def digest_text(layout: DataFrame, source: DataFrame, by: list[str] = WINDOW) -> DataFrame:
    """Text and hash of each window. A window's text holds a bounded number of bullets, never its source rows."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'")
    bullets = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "summary"))), lambda b: F.concat(F.lit("- "), b["summary"])), "\n")
    parts = layout.groupBy(*by, "section").agg(bullets.alias("body"), F.sum("n_events").alias("n"), F.count(F.lit(1)).alias("k"))
    is_top = F.col("section") == "top"
    block = F.concat(F.lit("== "), F.when(is_top, "Top developments").otherwise(F.col("section")), F.lit(" ==\n"), "body")
    rank = F.struct(F.when(is_top, 0).otherwise(1).alias("a"), F.lower("section").alias("b"), F.col("section").alias("c"))
    counts = F.when(~is_top, F.struct(rank.alias("r"), F.concat("section", F.lit(": "), F.col("n").cast("string")).alias("t")))
    win = parts.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), block.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"),
        F.array_join(F.transform(F.array_sort(F.collect_list(counts)), lambda x: x["t"]), ", ").alias("counts"),
        F.sum("n").alias("covered"), F.sum(F.when(is_top, F.col("k")).otherwise(0)).alias("tops"))
    n_source = source.groupBy(*by).agg(F.count(F.lit(1)).alias("n_source"))
    text = F.concat(
        F.lit("Window "), stamp("window_start"), F.lit(" to "), stamp("window_end"), F.lit("\nCovered events: "), F.col("covered").cast("string"),
        F.lit("\nSource events: "), F.col("n_source").cast("string"), F.lit("\nTop developments: "), F.col("tops").cast("string"),
        F.lit("\nCounts: "), F.when(F.col("counts") == "", "0").otherwise(F.col("counts")), F.lit("\n\n"), "body", F.lit("\n"))
    return win.join(n_source, by).select(*by, text.alias("canonical_text")).withColumn("canonical_hash", F.sha2("canonical_text", 256))


def input_hash(source: DataFrame, limits: str, by: list[str] = WINDOW, prompt_version: str = "v1") -> DataFrame:
    """Identity of a window's inputs: independent of row order and built by partial aggregation, so a window of any
    size never meets in one list. Every field the text depends on takes part, and the prompt version.

    Own definition: 32-bit words of the row digests are summed and xor-ed, so it tells honest changes apart but is no
    protection against rows made to collide.
    """
    row = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "topic_label", "summary", F.coalesce("fingerprint", F.lit("~")),
                             F.coalesce("claim_hash", F.lit("~")), micros("last_updated_at").cast("string"),
                             F.coalesce("topic", F.lit("~")), F.coalesce(F.round(F.col("impact_score") * 1_000_000).cast("long").cast("string"), F.lit("~"))), 256)
    word = lambda k: F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("long")
    g = source.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(word(k)).alias(f"s{k}") for k in range(4)], *[F.bit_xor(word(k)).alias(f"x{k}") for k in range(4)])
    text = F.concat_ws("|", F.lit(limits), F.lit(prompt_version), F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), F.date_format("window_end", "yyyy-MM-dd HH:mm:ss"),
                       *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3", "x0", "x1", "x2", "x3")])
    return g.select(*by, "n", F.sha2(text, 256).alias("input_hash"))


def windowed_source(events: DataFrame, length: str = "4 hours", every: str | None = None, destination: str | None = "vip_telegram", floor: float | None = 35.0) -> DataFrame:
    """Selected events of every window, ready for clustering."""
    df = events if floor is None else min_impact_exclusive(events, floor)
    df = df if destination is None else unpublished(df, destination)
    return digest_source(assign_windows(df, "last_updated_at", length, every))


def digest_windows(events: DataFrame, length: str = "4 hours", every: str | None = None, destination: str | None = "vip_telegram",
                   top: int = 3, per_section: int = 6) -> DataFrame:
    return digest_layout(digest_groups(windowed_source(events, length, every, destination)), top, per_section)
