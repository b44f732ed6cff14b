"""Relatedness of recent claims, triage actions and routing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T, vocab as V
from ..session import cut_lineage, shuffled
from .asof import MINUTE, micros, slice_of
from .scoring import is_local_incident

BURST = 15 * MINUTE
IN_ONE = 10_000  # claims of a topic and two slots (or a day) that one task compares directly
DAY = 96         # slots that are compared in one go where claims are few: each go costs milliseconds, however little it holds
ASKED = 256      # claims that are held against them at a time


def impact_band(c: Column) -> Column:
    return F.when(c >= 85, "critical").when(c >= 70, "high").when(c >= 55, "medium").otherwise("low")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.85, "strong").when(c >= 0.75, "usable").otherwise("weak")


def band_rank(c: Column) -> Column:
    return F.when(c >= 85, 3).when(c >= 70, 2).when(c >= 55, 1).otherwise(0)


def summary_tags(summary: Column) -> Column:
    low = T.squeezed_lower(summary)
    return F.array_compact(F.array(
        F.when(T.has_any(low, V.LOCAL_WORDS), "local_incident"), F.when(T.has_any(low, V.OPERATIONAL_WORDS), "operational"),
        F.when(T.has_any(low, V.REACTION_WORDS), "reaction")))


def source_class(source: Column, summary: Column) -> Column:
    src, low = T.squeezed_lower(source), T.squeezed_lower(summary)
    return (
        F.when(T.has_any(src, V.AUTHORITY_WORDS) | F.contains(low, F.lit("according to")), "authority")
        .when(T.has_any(F.concat_ws(" ", src, low), V.COMMENTARY_WORDS), "commentary").otherwise("unknown"))


def triage_features(df: DataFrame) -> DataFrame:
    """Adds bands, summary tags, source class, local flag, entity tokens and the claim signature."""
    df = df.withColumns({
        "impact_band": impact_band(F.col("impact_score")), "confidence_band": confidence_band(F.col("confidence")),
        "summary_tags": summary_tags(F.col("summary")), "source_class": source_class(F.col("source_claimed"), F.col("summary")),
        "local_incident": is_local_incident(), "entities": T.entity_signature(F.col("countries"), F.col("orgs"), F.col("people")),
    })
    words = F.array_sort(F.array_distinct(F.filter(F.transform("keywords", T.squeezed_lower), lambda w: w != "")))
    return df.withColumn("claim_signature", F.concat_ws(
        "|", "topic", F.array_join(words, ","), T.squeezed_lower(F.col("source_claimed")), F.array_join("summary_tags", ",")))


def _count_around(queries: DataFrame, facts: DataFrame, part: list[str], pos: str = "pos") -> DataFrame:
    """For each query: ``n_before`` facts of the partition below ``pos`` and ``n_after`` at or above it, and the
    first of the latter (``next_pos``). One sort per direction over facts and queries together."""
    qid = [c for c in queries.columns if c not in (*part, pos)]
    tag = F.struct(*[F.col(c) for c in qid])
    q = queries.select(*part, pos, tag.alias("_q"), F.lit(0).alias("_f"))
    f = facts.select(*part, pos, F.lit(None).cast(q.schema["_q"].dataType).alias("_q"), F.lit(1).alias("_f"))
    fact_pos = F.when(F.col("_f") == 1, F.col(pos))
    up = W.partitionBy(*part).orderBy(pos, "_f").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*part).orderBy(F.col(pos).desc(), F.col("_f").desc()).rowsBetween(W.unboundedPreceding, 0)
    return (
        f.unionByName(q)
        .withColumns({"n_before": F.sum("_f").over(up), "n_after": F.sum("_f").over(down), "next_pos": F.min(fact_pos).over(down)})
        .filter("_f = 0").select(*part, pos, "_q.*", "n_before", "n_after", "next_pos"))


def recent_related(claims: DataFrame) -> DataFrame:
    """Per claim: how many other claims of its topic were created in the 15 minutes before it."""
    c = claims.select("claim_id", "topic", micros("created_at").alias("us")).withColumn("slot", slice_of(F.col("us"), BURST))
    at = lambda us, cid: F.struct(us.alias("us"), cid.alias("id"))
    facts = c.select("topic", "slot", at(F.col("us"), F.col("claim_id")).alias("pos"))
    here = _count_around(c.select("topic", "slot", at(F.col("us"), F.col("claim_id")).alias("pos"), "claim_id"), facts, ["topic", "slot"])
    back = _count_around(c.select("topic", (F.col("slot") - 1).alias("slot"), at(F.col("us") - BURST, F.lit(-1).cast("long")).alias("pos"), "claim_id"),
                         facts, ["topic", "slot"])
    return (here.select("claim_id", F.col("n_before").alias("n")).unionByName(back.select("claim_id", F.col("n_after").alias("n")))
            .groupBy("claim_id").agg(F.sum("n").alias("n_recent")))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal strings have equal numbers; -1 for the empty string."""
    coded = pc.dictionary_encode(column.combine_chunks())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    return np.where(codes == empty, -1, codes) if empty >= 0 else codes


def _tokens(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, token number) of every item of a list column."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), _codes(pa.chunked_array([pc.list_flatten(lists)]))


def _marks(of: tuple[np.ndarray, np.ndarray], tokens: np.ndarray, first: int, rows: int) -> np.ndarray:
    """Rows ``first`` to ``first + rows`` by tokens: 1 where the row has the token."""
    row, token = of
    lo, hi = np.searchsorted(row, [first, first + rows])
    at = np.searchsorted(tokens, token[lo:hi])
    there = at < len(tokens)
    there[there] = tokens[at[there]] == token[lo:hi][there]
    out = np.zeros((rows, len(tokens)), np.float32)
    out[row[lo:hi][there] - first, at[there]] = 1
    return out


def _compare(table: pa.Table) -> pa.Table:
    """Counts of the asked claims of one topic and slot (or day) among these and the claims of the slot before, a block of claims at a time."""
    table = table.sort_by([("us", "ascending"), ("claim_id", "ascending")])
    us, ids = table["us"].to_numpy(), table["claim_id"].to_numpy()
    fp, src, band = _codes(table["fp"]), _codes(table["src"]), table["band"].to_numpy()
    ents, words = _tokens(table["ents"]), _tokens(table["words"])
    n = len(us)
    new = np.ones(n, bool)
    new[1:] = (us[1:] != us[:-1]) | (ids[1:] != ids[:-1])
    before = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # rows that stand before a row's place
    since = np.searchsorted(us, us - BURST, "left")
    asked = np.flatnonzero(table["asked"].to_numpy())
    soft, count = np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    for k in range(0, len(asked), ASKED):
        q = asked[k:k + ASKED]  # the slot's own claims stand together, behind those of the slot before
        lo, hi = since[q[0]], before[q[-1]]
        if lo == hi:
            continue
        place = np.arange(lo, hi)
        open_ = (place >= since[q][:, None]) & (place < before[q][:, None])
        shared = lambda of: (lambda t: (_marks(of, t, q[0], len(q)), _marks(of, t, lo, hi - lo)))(
            np.unique(of[1][slice(*np.searchsorted(of[0], [q[0], q[-1] + 1]))]))
        (own_ents, their_ents), (own_words, their_words) = shared(ents), shared(words)
        source = (src[q][:, None] == src[lo:hi]) & (src[q] >= 0)[:, None] & (own_words @ their_words.T >= 2)
        related = open_ & (source | (own_ents @ their_ents.T >= 2) | ((fp[q][:, None] == fp[lo:hi]) & (fp[q] >= 0)[:, None]))
        soft[k:k + ASKED] = related.any(axis=1)
        # place from which the related claims so far hold every entity of the claim
        covered = np.full(len(q), -1)
        has = their_ents.T > 0
        need = own_ents.sum(axis=1)
        which = np.argsort(-own_ents, axis=1, kind="stable")
        for j in range(int(need.max(initial=0))):
            r = np.flatnonzero(need > j)
            hit = related[r] & has[which[r, j]]
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), hi - lo)
            covered[r] = np.maximum(covered[r], first)
        counted = related & (band[lo:hi] >= band[q][:, None]) & (source | (np.arange(hi - lo) >= covered[:, None]))
        count[k:k + ASKED] = counted.sum(axis=1)
    return pa.table({"claim_id": table["claim_id"].combine_chunks().take(pa.array(asked)), "soft_related": soft, "burst_count": count})


def burst_counts(claims: DataFrame, in_one: int | None = None) -> DataFrame:
    """Related earlier claims of the 15 minutes before: ``soft_related`` and ``burst_count`` per claim.

    Needs claim_id, topic, created_at, fingerprint, source_claimed, impact_score, countries, orgs, people, keywords.
    Two claims are related when the fingerprint is equal, or two entities are shared, or the source and two keywords
    are shared. Claims of a topic meet by 15-minute slot: each slot and the one before are compared in one task, as bit matrices of
    a few hundred claims, so no pair leaves the task. A day of at most ``in_one`` claims is compared in one go. Where two slots
    hold more, the counts come from :func:`_counts_by_profile`, which is spread over tasks.
    """
    limit = in_one or IN_ONE
    src = T.let(F.lower(T.strip(F.coalesce("source_claimed", F.lit("")))), lambda s: s)
    none = F.array().cast("array<string>")
    rows = claims.select(
        "claim_id", "topic", micros("created_at").alias("us"), F.coalesce("fingerprint", F.lit("")).alias("fp"),
        F.coalesce(T.entity_signature(F.col("countries"), F.col("orgs"), F.col("people")), none).alias("ents"), src.alias("src"),
        F.coalesce(F.array_sort(T.lowered_set(F.col("keywords"))), none).alias("words"), band_rank(F.col("impact_score")).alias("band"))
    rows = cut_lineage(rows.withColumn("slot", slice_of(F.col("us"), BURST)))
    known = F.col("topic").isNotNull() & F.col("slot").isNotNull() & F.col("claim_id").isNotNull()
    at = lambda df: df.withColumn("at_slot", F.explode(F.array(F.col("slot"), F.col("slot") + 1)))
    day = lambda slot: F.floor(slot / F.lit(float(DAY))).cast("long")
    by_day = lambda df: df.withColumn("at", F.explode(F.array_distinct(F.array(day(F.col("slot")), day(F.col("slot") + 1)))))
    full = cut_lineage(by_day(rows.filter(known).groupBy("topic", "slot").agg(F.count(F.lit(1)).alias("n"))).groupBy("topic", "at").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).drop("n"))
    large = cut_lineage(at(rows.filter(known).groupBy("topic", "slot").agg(F.count(F.lit(1)).alias("n"))).groupBy("topic", "at_slot").agg(F.sum("n").alias("n")).filter(F.col("n") > limit).drop("n"))
    whole = by_day(rows.filter(known)).join(shuffled(full), ["topic", "at"], "left_anti").withColumns({"asked": F.col("at") == day(F.col("slot")), "whole": F.lit(True)})
    small = at(rows.filter(known)).withColumn("at", day(F.col("at_slot"))).join(shuffled(full), ["topic", "at"], "left_semi").join(shuffled(large), ["topic", "at_slot"], "left_anti")
    small = small.withColumns({"asked": F.col("at_slot") == F.col("slot"), "whole": F.lit(False), "at": F.col("at_slot")}).drop("at_slot")
    schema = f"claim_id {rows.schema['claim_id'].dataType.simpleString()}, soft_related boolean, burst_count long"
    direct = whole.unionByName(small).groupBy("topic", "whole", "at").applyInArrow(_compare, schema)
    asked = large.withColumnRenamed("at_slot", "slot")
    near = asked.unionByName(asked.withColumn("slot", F.col("slot") - 1)).distinct()
    many = rows.join(shuffled(asked.withColumn("asked", F.lit(True))), ["topic", "slot"], "left").join(shuffled(near), ["topic", "slot"], "left_semi")
    rest = _counts_by_profile(many).filter("asked").drop("asked")
    unknown = rows.filter(~known).select("claim_id", F.lit(False).alias("soft_related"), F.lit(0).cast("long").alias("burst_count"))
    return direct.unionByName(rest).unionByName(unknown)


def _counts_by_profile(rows: DataFrame) -> DataFrame:
    """The counts of :func:`burst_counts`, and ``asked``, for slots of many claims.

    Claims of one 15-minute slot with the same profile (fingerprint, entities, source, keywords, band)
    are one row when relations are looked up, through keys that each already prove a relation: a burst of copies is
    one profile, and no pair of claims is ever built. Counts come from positions inside a profile.
    """
    rows = rows.withColumns({
        "pos": F.struct("us", F.col("claim_id").alias("id")),
        "prof": F.md5(F.concat_ws("\u0001", "topic", "fp", F.array_join("ents", "\u0002"), "src", F.array_join("words", "\u0002"), F.col("band").cast("string")))})
    rows = cut_lineage(rows)
    pairs_of = lambda arr, head: F.flatten(F.transform(arr, lambda x, i: F.transform(
        F.slice(arr, i + 2, F.size(arr)), lambda y: F.concat_ws("\u0001", head, x, y))))
    none = F.array().cast("array<string>")
    profiles = rows.groupBy("topic", "slot", "prof").agg(
        *[F.first(c).alias(c) for c in ("fp", "ents", "src", "words", "band")], F.min("pos").alias("first_pos"))
    profiles = profiles.withColumn("keys", F.concat(
        F.when(F.col("fp") != "", F.array(F.concat(F.lit("f\u0001"), "fp"))).otherwise(none),
        pairs_of(F.col("ents"), F.lit("e")),
        F.when(F.col("src") != "", pairs_of(F.col("words"), F.concat(F.lit("s\u0001"), "src"))).otherwise(none)))
    profiles = cut_lineage(profiles)
    keyed = profiles.select("topic", "slot", "prof", F.explode("keys").alias("key"))
    seen_from = keyed.select("topic", F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("at_slot"), "key",
                             F.col("prof").alias("other"), F.col("slot").alias("other_slot"))
    links = keyed.withColumnRenamed("slot", "at_slot").join(shuffled(seen_from), ["topic", "at_slot", "key"]).select(
        "topic", "at_slot", "prof", "other", "other_slot").distinct()
    meta = profiles.select("topic", F.col("slot").alias("other_slot"), F.col("prof").alias("other"), F.col("ents").alias("o_ents"), F.col("src").alias("o_src"),
                           F.col("words").alias("o_words"), F.col("band").alias("o_band"), "first_pos")
    near = cut_lineage(
        rows.withColumnRenamed("slot", "at_slot").join(shuffled(links), ["topic", "at_slot", "prof"]).join(shuffled(meta), ["topic", "other_slot", "other"])
        .select("claim_id", "topic", "pos", "us", "at_slot", "other", "other_slot", "band", "o_band", "first_pos", "ents",
                F.array_intersect("ents", "o_ents").alias("shared"),
                ((F.col("src") != "") & (F.col("src") == F.col("o_src")) & (T.overlap(F.col("words"), F.col("o_words")) >= 2)).alias("same_source")))
    facts = rows.select("topic", "slot", "prof", "pos")
    part = ["topic", "slot", "prof"]
    low = F.struct((F.col("us") - BURST).alias("us"), F.lit(-1).cast("long").alias("id"))
    # first related position inside the window, per (claim, profile, slot)
    old = near.filter("other_slot < at_slot").select("topic", F.col("other_slot").alias("slot"), F.col("other").alias("prof"), low.alias("pos"), "claim_id")
    old = _count_around(old, facts, part).select("claim_id", F.col("prof").alias("other"), F.col("slot").alias("other_slot"), "next_pos")
    near = near.join(shuffled(old), ["claim_id", "other", "other_slot"], "left").withColumn(
        "start", F.when(F.col("other_slot") < F.col("at_slot"), F.col("next_pos")).otherwise(F.col("first_pos")))
    near = cut_lineage(near.filter(F.col("start").isNotNull() & (F.col("start") < F.col("pos"))).drop("next_pos", "first_pos"))
    # position from which the running union of related entities covers the claim's own entities
    cover = (
        near.select("claim_id", "ents", F.explode("shared").alias("e"), "start")
        .groupBy("claim_id", "e").agg(F.min("start").alias("start"), F.first(F.size("ents")).alias("need"))
        .groupBy("claim_id").agg(F.count("e").alias("got"), F.first("need").alias("need"), F.max("start").alias("covered"))
        .filter("got = need").select("claim_id", "covered"))
    near = near.join(shuffled(cover), "claim_id", "left")
    begin = F.when(F.col("same_source") | (F.size("ents") == 0), F.col("start")).otherwise(F.greatest("covered", "start"))
    counted = near.filter("band <= o_band").withColumn("begin", F.when(F.col("covered").isNotNull() | F.col("same_source") | (F.size("ents") == 0), begin))
    counted = counted.filter(F.col("begin").isNotNull())
    ends = counted.select("topic", F.col("other_slot").alias("slot"), F.col("other").alias("prof"), "claim_id",
                          F.explode(F.array(F.struct(F.col("begin").alias("pos"), F.lit(-1).alias("sign")), F.struct(F.col("pos").alias("pos"), F.lit(1).alias("sign")))).alias("x")
                          ).select("topic", "slot", "prof", "claim_id", "x.*")
    counts = _count_around(ends, facts, part).groupBy("claim_id", "prof", "slot").agg(F.sum(F.col("sign") * F.col("n_before")).alias("n"))
    counts = counts.groupBy("claim_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("burst_count"))
    related = near.select("claim_id").distinct().withColumn("soft_related", F.lit(True))
    return rows.select("claim_id", "asked").join(shuffled(related), "claim_id", "left").join(shuffled(counts), "claim_id", "left").select(
        "claim_id", "asked", F.coalesce("soft_related", F.lit(False)).alias("soft_related"), F.coalesce("burst_count", F.lit(0)).cast("long").alias("burst_count"))


def materially_new(df: DataFrame) -> DataFrame:
    """Adds ``materially_new`` against the candidate columns ``cand_entities``, ``cand_impact``, ``cand_tags`` and
    ``cand_source_class`` (``cand_entities`` null means there is no candidate)."""
    reaction_turns = (F.array_contains("summary_tags", "operational") & ~F.array_contains("cand_tags", "operational")
                      & F.array_contains("cand_tags", "reaction"))
    new = (
        (F.size(F.array_except("entities", "cand_entities")) > 0)
        | (band_rank(F.col("impact_score")) > band_rank(F.col("cand_impact"))) | reaction_turns
        | ((F.col("cand_source_class") == "commentary") & (F.col("source_class") == "authority")))
    return df.withColumn("materially_new", F.when(F.col("cand_entities").isNull(), True).otherwise(new))


def triage(df: DataFrame) -> DataFrame:
    """Action and ordered reasons. Needs triage features, ``materially_new``, ``existing_event_id``, ``soft_related``
    and ``burst_count``."""
    known, new = F.col("existing_event_id").isNotNull(), F.col("materially_new")
    burst, soft, local = F.col("burst_count"), F.col("soft_related"), F.col("local_incident")
    soft_down = ~known & soft & (burst >= 1)
    state = (
        F.when((known & ~new) | soft_down, "repeat_low_delta").when(known, "related_update").otherwise("new_event"))
    weak_low = (F.col("confidence_band") == "weak") & (F.col("impact_band") == "low")
    promote = (state == "new_event") & F.col("impact_band").isin("high", "critical") & F.col("confidence_band").isin("usable", "strong")
    update = (state == "related_update") & new
    repeat = state == "repeat_low_delta"
    base = F.when(weak_low, "archive").when(promote, "promote").when(update, "update").otherwise("monitor")
    capped = F.when(repeat & (burst >= 2), "monitor").when(repeat & (burst >= 1), "update").otherwise(base)
    reasons = F.array_compact(F.array(
        F.concat(F.lit("triage:score_band:"), "impact_band"), F.concat(F.lit("triage:confidence_band:"), "confidence_band"),
        F.when(local, "triage:local_incident_downgrade"), F.when(known & ~new, "triage:repeat_downgrade"),
        F.when(soft, "triage:soft_related_match"), F.when(soft_down, "triage:soft_related_downgrade"),
        F.when(weak_low, "triage:low_signal_archive").when(promote, "triage:new_event_promote").when(update, "triage:related_material_update"),
        F.when(repeat & (burst >= 2), "triage:burst_cap_monitor").when(repeat & (burst >= 1), "triage:burst_cap_update")))
    return df.withColumns({
        "novelty_state": state, "triage_action": F.when(local & capped.isin("promote", "update"), "monitor").otherwise(capped),
        "triage_reasons": reasons})


def route(df: DataFrame, destinations: dict[str, str] | None = None, evidence_enabled: bool = False) -> DataFrame:
    """Destination, capped priority, event action, flags and fired rules of triaged claims."""
    impact, local = F.col("impact_score"), F.col("local_incident")
    rank = F.when(impact >= 80, 3).when(impact >= 60, 2).when(impact >= 30, 1).otherwise(0)
    cap = T.lookup(F.col("triage_action"), {"promote": 3, "update": 2, "monitor": 1, "archive": 0})
    cap = F.least(F.coalesce(cap, F.lit(3)), F.when(local, 1).otherwise(3))
    name = lambda r: F.element_at(T.lit_array(V.PRIORITIES), r + 1)
    evidence = F.lit(evidence_enabled) & (
        F.col("is_breaking") | (impact >= 60) | (F.col("topic").isin(*V.EVIDENCE_TOPICS) & (F.col("confidence") >= 0.6)))
    evidence, empty = F.coalesce(evidence, F.lit(False)), F.coalesce("summary", F.lit("")) == ""
    first = F.when(empty, "ignore").otherwise("create")
    flag = lambda cond, text: F.when(cond, text)
    need = evidence | local
    df = df.withColumns({"_base": name(rank), "publish_priority": name(F.least(rank, cap)), "requires_evidence": need})
    return df.withColumns({
        "store_to": F.array(F.coalesce(T.lookup(F.col("topic"), destinations or V.DESTINATIONS), F.lit("other_events"))),
        "event_action": F.when(F.col("triage_action") == "archive", "ignore")
        .when((F.col("triage_action") == "update") & F.col("existing_event_id").isNotNull(), "update").otherwise(first),
        "flags": F.array_compact(F.array(flag(need, "unconfirmed"), flag(impact >= 60, "high_impact"),
                                         flag(F.col("is_breaking"), "breaking"), flag(local, "local_incident"))),
        "routing_rules": F.array_compact(F.array(
            F.concat(F.lit("topic_to_dest:"), "topic"), F.concat(F.lit("impact_to_priority:"), "_base"),
            F.when(F.col("_base") != F.col("publish_priority"), F.concat(F.lit("triage_priority_cap:"), "_base", F.lit("->"), "publish_priority")),
            flag(evidence, "requires_evidence:rule_default"), flag(local, "requires_evidence:local_incident_override"),
            F.concat(F.lit("event_action:"), first))),
    }).drop("_base")


def fan_out(routed: DataFrame) -> DataFrame:
    """One row per (claim, destination)."""
    return routed.withColumn("destination", F.explode("store_to"))


def apply_conflicts(routed: DataFrame, upserts: DataFrame) -> DataFrame:
    """Identity conflicts (claim_id, review_reason) demote the decision to monitor without priority."""
    df = routed.join(upserts.select("claim_id", F.col("review_reason").alias("_why")), "claim_id", "left")
    hit = F.col("_why").isNotNull()
    return df.withColumns({
        "triage_action": F.when(hit, "monitor").otherwise(F.col("triage_action")),
        "publish_priority": F.when(hit, "none").otherwise(F.col("publish_priority")),
        "flags": F.when(hit, F.array_sort(F.array_distinct(F.array_append("flags", F.lit("identity_conflict_review"))))).otherwise(F.col("flags")),
        "triage_reasons": F.when(hit, F.array_append("triage_reasons", F.concat(F.lit("identity:review_required:"), "_why"))).otherwise(F.col("triage_reasons")),
    }).drop("_why")
