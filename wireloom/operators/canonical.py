"""Claim canonicalisation: names, tags, relations, direction, summary, identity.

One claim per row in and out; everything is array and string expressions, so
the whole step runs without a shuffle. Input columns are those of
``sources.fixture.raw_claims``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vocab as V

TAG_TYPE = "struct<tag_type:string,tag_value:string,tag_source:string,confidence:double>"


def direction_support(direction: Column, summary: Column, tags: Column, relations: Column) -> Column:
    """A stress or easing label needs a summary word, a supporting tag family or a supporting relation."""
    low = T.squeezed_lower(summary)
    family = F.exists(tags, lambda t: T.normalize_vocab(t["tag_type"], V.TAG_FAMILIES, V.TAG_FAMILY_ALIASES).isin(*V.DIRECTION_TAG_FAMILIES))
    rel = lambda kinds: F.exists(relations, lambda r: T.normalize_vocab(r["relation_type"], V.RELATION_TYPES).isin(*kinds))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(direction == "stress", T.has_any(low, V.STRESS_SUMMARY_WORDS) | yes(family) | yes(rel(V.STRESS_RELATIONS)))
        .when(direction == "easing", T.has_any(low, V.EASING_SUMMARY_WORDS) | yes(family) | yes(rel(V.EASING_RELATIONS)))
        .otherwise(F.lit(True))
    )


def resolve_direction(df: DataFrame) -> DataFrame:
    """Adds ``direction`` and ``direction_rules`` (unsupported labels become neutral)."""
    raw = F.col("direction_raw")
    df = df.withColumn("_norm", T.normalize_vocab(raw, V.DIRECTIONS))
    norm = F.col("_norm")
    df = df.withColumn("_ok", direction_support(norm, F.col("summary"), F.col("tags"), F.col("relations")))
    demoted = norm.isin("stress", "easing") & ~F.col("_ok")
    rules = F.array_compact(F.array(
        F.when(raw.isNotNull() & norm.isNull(), "directionality_invalid_dropped")
        .when(raw.isNotNull() & (raw != norm), "directionality_normalization"),
        F.when(demoted, "directionality_demoted_without_support"),
        F.when(norm.isNull(), "directionality_defaulted_neutral"),
    ))
    return df.withColumns({
        "direction": F.when(demoted | norm.isNull(), "neutral").otherwise(norm), "direction_rules": rules,
    }).drop("_norm", "_ok")


def _tag_key(t: Column) -> Column:
    return F.concat_ws("\u0001", t["tag_type"], F.lower(t["tag_value"]), t["tag_source"])


def _valid_confidence(c: Column) -> Column:
    return F.when(c.between(0.0, 1.0), c)


def _tag_key(t: Column) -> Column:
    return F.concat_ws("\u0001", t["tag_type"], F.lower(t["tag_value"]), t["tag_source"])


def canon_tags(df: DataFrame) -> DataFrame:
    """Adds ``canon_tags`` and ``tag_diagnostics`` (needs ``direction`` and canonical countries/orgs columns
    ``c_countries``, ``c_affected``, ``c_orgs``)."""
    direction = F.col("direction")

    def check(t: Column) -> Column:
        family = T.normalize_vocab(t["tag_type"], V.TAG_FAMILIES, V.TAG_FAMILY_ALIASES)
        return F.struct(
            family.alias("tag_type"), T.normalize_value(t["tag_value"]).alias("tag_value"),
            T.normalize_vocab(t["tag_source"], V.ITEM_SOURCES).alias("tag_source"), t["confidence"].alias("confidence"))

    def settle(t: Column) -> Column:
        is_dir = t["tag_type"] == "directionality"
        value = (
            F.when(is_dir, direction).when(t["tag_type"] == "countries", T.canon_country(t["tag_value"]))
            .otherwise(T.canon_name(t["tag_value"])))
        return T.let(value, lambda v: F.struct(
            t["tag_type"].alias("tag_type"), v.alias("tag_value"),
            F.when(is_dir, "inferred").otherwise(t["tag_source"]).alias("tag_source"),
            F.when(~is_dir, _valid_confidence(t["confidence"])).alias("confidence"),
            F.when(t["tag_type"].isNull(), "invalid_tag_type")
            .when(t["tag_value"].isNull(), "invalid_tag_value")
            .when(t["tag_source"].isNull(), "invalid_tag_source")
            .when(is_dir & T.normalize_vocab(t["tag_value"], V.DIRECTIONS).isNull(), "invalid_directionality_tag_value")
            .when(v == "", "invalid_tag_value").alias("reason")))

    plain = lambda t: F.struct(t["tag_type"].alias("tag_type"), t["tag_value"].alias("tag_value"),
                               t["tag_source"].alias("tag_source"), t["confidence"].alias("confidence"))
    observed = lambda family: lambda v: F.struct(
        (F.lit(family) if family else T.org_family(v)).alias("tag_type"), v.alias("tag_value"),
        F.lit("observed").alias("tag_source"), F.lit(None).cast("double").alias("confidence"))
    forced = F.struct(F.lit("directionality").alias("tag_type"), direction.alias("tag_value"),
                      F.lit("inferred").alias("tag_source"), F.lit(None).cast("double").alias("confidence"))
    checked = F.transform(F.transform(F.coalesce("tags", F.array().cast(f"array<{TAG_TYPE}>")), check), settle)
    seen = T.sort_by_lower(F.array_distinct(F.concat("c_countries", "c_affected")))
    extra = F.concat(F.array(forced), F.transform(seen, observed("countries")), F.transform("c_orgs", observed(None)))

    def assemble(items: Column) -> Column:
        ok = F.transform(F.filter(items, lambda t: t["reason"].isNull()), plain)
        return T.let(T.distinct_by(ok, _tag_key), lambda kept: F.struct(
            F.transform(F.array_sort(F.transform(T.distinct_by(F.concat(kept, extra), _tag_key), lambda t: F.struct(
                t["tag_type"].alias("a"), F.lower(t["tag_value"]).alias("b"), t["tag_source"].alias("c"), t.alias("t")))),
                lambda s: s["t"]).alias("tags"),
            F.struct(
                F.size(items).alias("emitted"), F.size(kept).alias("valid"), (F.size(items) - F.size(kept)).alias("dropped"),
                F.array_sort(F.array_distinct(F.concat(
                    F.array_compact(F.transform(items, lambda t: t["reason"])),
                    F.when(F.size(F.filter(items, lambda t: t["reason"].isNull())) > F.size(kept), F.array(F.lit("duplicate_tag")))
                    .otherwise(F.array().cast("array<string>"))))).alias("reasons")).alias("diagnostics")))

    df = df.withColumn("_tags", T.let(checked, assemble))
    return df.withColumns({"canon_tags": F.col("_tags.tags"), "tag_diagnostics": F.col("_tags.diagnostics")}).drop("_tags")


def canon_relations(df: DataFrame) -> DataFrame:
    """Adds ``canon_relations`` (first three distinct valid ones, sorted) and ``relation_diagnostics``."""
    entity = lambda c: T.normalize_vocab(c, V.RELATION_ENTITIES, V.RELATION_ENTITY_ALIASES)

    def check(r: Column) -> Column:
        return F.struct(
            entity(r["subject_type"]).alias("subject_type"), T.normalize_value(r["subject_value"]).alias("subject_value"),
            T.normalize_vocab(r["relation_type"], V.RELATION_TYPES).alias("relation_type"),
            entity(r["object_type"]).alias("object_type"), T.normalize_value(r["object_value"]).alias("object_value"),
            T.normalize_vocab(r["relation_source"], V.ITEM_SOURCES).alias("relation_source"), r["confidence"].alias("confidence"))

    def end(kind: Column, value: Column) -> Column:
        return F.when(kind.isin("country", "state"), T.canon_country(value)).otherwise(T.canon_name(value))

    def settle(r: Column) -> Column:
        subj, obj = end(r["subject_type"], r["subject_value"]), end(r["object_type"], r["object_value"])
        reason = None
        for field in ("subject_type", "object_type", "relation_type", "subject_value", "object_value", "relation_source"):
            bad = r[field].isNull()
            reason = F.when(bad, f"invalid_{field}") if reason is None else reason.when(bad, f"invalid_{field}")
        return T.let(F.struct(subj.alias("s"), obj.alias("o")), lambda e: F.struct(
            r["subject_type"].alias("subject_type"), e["s"].alias("subject_value"), r["relation_type"].alias("relation_type"),
            r["object_type"].alias("object_type"), e["o"].alias("object_value"), r["relation_source"].alias("relation_source"),
            F.when(r["relation_source"] == "inferred", 1).otherwise(0).alias("inference_level"),
            _valid_confidence(r["confidence"]).alias("confidence"),
            reason.when((e["s"] == "") | (e["o"] == ""), "invalid_relation_value").alias("reason")))

    key = lambda r: F.concat_ws("\u0001", r["subject_type"], F.lower(r["subject_value"]), r["relation_type"], r["object_type"],
                                F.lower(r["object_value"]), r["relation_source"])
    def assemble(items: Column) -> Column:
        ok = F.filter(items, lambda r: r["reason"].isNull())
        return T.let(F.slice(T.distinct_by(ok, key), 1, V.MAX_RELATIONS), lambda kept: T.let(F.transform(kept, key), lambda keys: F.struct(
            F.transform(F.array_sort(F.transform(kept, lambda r: F.struct(
                r["subject_type"].alias("a"), F.lower(r["subject_value"]).alias("b"), r["relation_type"].alias("c"),
                r["object_type"].alias("d"), F.lower(r["object_value"]).alias("e"), r["relation_source"].alias("f"),
                r["inference_level"].alias("g"), r.alias("r")))), lambda s: s["r"].dropFields("reason")).alias("relations"),
            F.struct(
                F.size(items).alias("emitted"), F.size(kept).alias("valid"), (F.size(items) - F.size(kept)).alias("dropped"),
                F.array_sort(F.array_distinct(F.array_compact(F.concat(
                    F.transform(items, lambda r: r["reason"]),
                    F.transform(F.filter(items, lambda r: r["reason"].isNull()), lambda r: F.when(
                        ~F.array_contains(keys, key(r)), "relation_limit_exceeded")),
                    F.array(F.when(F.size(F.filter(items, lambda r: r["reason"].isNull() & F.array_contains(keys, key(r)))) > F.size(kept),
                                   "duplicate_relation")))))).alias("reasons")).alias("diagnostics"))))

    df = df.withColumn("_rels", T.let(F.transform(F.transform("relations", check), settle), assemble))
    return df.withColumns({"canon_relations": F.col("_rels.relations"), "relation_diagnostics": F.col("_rels.diagnostics")}).drop("_rels")


def usable_source(source: Column) -> Column:
    """Squeezed source name, or null when blank or a generic feed label."""
    clean = T.squeeze(source)
    low = F.lower(clean)
    generic = low.isin(*V.GENERIC_SOURCES) | low.endswith("news feed") | low.endswith("wire feed")
    return F.when((clean != "") & ~generic, clean)


def rewrite_summary(df: DataFrame, summary="summary", source="source_claimed", orgs="c_orgs", people="c_people",
                    countries="c_countries") -> DataFrame:
    """Adds ``safe_summary`` and ``summary_rules``."""
    first = lambda arr: F.get(F.filter(F.col(arr), lambda v: T.squeeze(v) != ""), 0)
    src = usable_source(F.col(source))
    pattern = r"(?isU)^(.*?)\b(it|they|he|she)\b(.*)$"
    df = df.withColumns({"_s": T.squeeze(F.coalesce(summary, F.lit(""))), "_src": src})
    df = df.withColumn("_actor", F.coalesce("_src", *[T.squeeze(first(a)) for a in (orgs, people, countries)]))
    df = df.withColumn("_pron", F.col("_s").rlike(pattern) & F.col("_actor").isNotNull())
    df = df.withColumn("_p", F.when(F.col("_pron"), F.concat(
        F.regexp_extract("_s", pattern, 1), "_actor", F.regexp_extract("_s", pattern, 3))).otherwise(F.col("_s")))
    low = F.lower("_p")
    df = df.withColumn("_risk", T.has_any(low, V.HIGH_RISK_WORDS) & ~T.has_any(low, V.ATTRIBUTION_WORDS))
    claim = F.lower(F.regexp_replace("_p", r"\.+$", ""))
    final = F.when(F.col("_risk") & F.col("_src").isNotNull(), F.concat("_src", F.lit(" said "), claim, F.lit("."))).when(
        F.col("_risk"), F.concat(F.lit("Reportedly, "), claim, F.lit("."))).otherwise(F.col("_p"))
    final = F.when(F.col("_s") == "", F.coalesce(summary, F.lit(""))).otherwise(final)
    rules = F.array_compact(F.array(
        F.when(F.col("_pron"), "summary_pronoun_disambiguated"), F.when(F.col("_risk"), "summary_high_risk_attribution_rewrite")))
    df = df.withColumn("safe_summary", final)
    changed = F.col("safe_summary") != F.coalesce(summary, F.lit(""))
    return df.withColumn("summary_rules", F.when(changed, rules).otherwise(F.array().cast("array<string>"))).drop(
        "_s", "_src", "_actor", "_pron", "_p", "_risk")


def action_class(summary: Column, core: Column, keywords: Column) -> Column:
    text = F.lower(T.squeeze(F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(core, F.lit("")), F.array_join(keywords, " "))))
    return T.first_family(text, V.ACTION_CLASSES, "other")


def time_bucket(event_time: Column) -> Column:
    return F.coalesce(F.date_format(event_time, "yyyy-MM-dd"), F.lit("unknown"))


def identity(df: DataFrame, summary="summary", countries="countries", orgs="orgs", people="people",
             affected="affected_countries", keywords="keywords") -> DataFrame:
    """Adds action_class, time_bucket, fingerprint_v2 (null when the identity is too thin) and claim_hash_v1."""
    some = lambda arr: F.when(F.size(arr) > 0, arr)
    df = df.withColumns({
        "action_class": action_class(F.col(summary), F.col("event_core"), F.col(keywords)),
        "time_bucket": time_bucket(F.col("event_time")),
        "_o": T.tokens(F.col(orgs)), "_p": T.tokens(F.col(people)), "_c": T.tokens(F.col(countries)),
        "_l": T.tokens(F.coalesce(some(F.col(affected)), F.col(countries))),
        "_k": T.tokens(F.col(keywords), 8),
    })
    src = T.safe_token(F.col("source_claimed"))
    df = df.withColumn("_actor", F.coalesce(
        F.when(src != V.MISSING, src), F.get("_o", 0), F.get("_p", 0), F.get("_c", 0), F.lit(V.MISSING)))
    df = df.withColumn("_target", F.coalesce(
        F.get(F.filter(F.concat("_o", "_p", "_c"), lambda x: x != F.col("_actor")), 0), F.lit(V.MISSING)))
    place = F.coalesce(F.get("_l", 0), F.lit(V.MISSING))
    topic = F.when(F.col("topic").isin("war_security", "geopolitics"), "conflict_geo").otherwise(T.safe_token(F.col("topic")))
    part = lambda name, col: F.concat(F.lit(f"{name}="), col)
    anchored = (F.col("_actor") != V.MISSING) | (F.col("_target") != V.MISSING) | (place != V.MISSING)
    shaped = (F.col("action_class") != "other") | (F.col("time_bucket") != "unknown")
    text = F.concat_ws("|", F.lit(V.FINGERPRINT_PREFIX), part("event_type", topic), part("actor", F.col("_actor")),
                       part("target", F.col("_target")), part("action_class", F.col("action_class")),
                       part("location_primary", place), part("time_bucket", F.col("time_bucket")))
    actors = F.slice(F.array_sort(F.array_union("_o", "_p")), 1, 6)
    claim = F.concat_ws("|", F.lit("claim_v1"), part("topic", T.safe_token(F.col("topic"))), part("action_class", F.col("action_class")),
                        part("source", src), part("summary", T.safe_token(F.col(summary))), part("keywords", T.joined(F.col("_k"))),
                        part("actors", T.joined(actors)), part("countries", T.joined(F.slice("_c", 1, 6))),
                        part("time_bucket", F.col("time_bucket")))
    return df.withColumns({
        "fingerprint_v2": F.when(anchored & shaped, F.concat(F.lit(f"{V.FINGERPRINT_PREFIX}:"), F.sha2(text, 256))),
        "claim_hash_v1": F.sha2(claim, 256),
    }).drop("_o", "_p", "_c", "_l", "_k", "_actor", "_target")


def canon_names(df: DataFrame) -> DataFrame:
    """Canonical name lists ``c_countries``, ``c_affected``, ``c_tickers``, ``c_orgs``, ``c_people``, ``c_keywords``."""
    return df.withColumns({
        "c_countries": T.canon_countries(F.col("countries")), "c_affected": T.canon_countries(F.col("affected_countries")),
        "c_tickers": T.canon_tickers(F.col("tickers")), "c_orgs": T.canon_names(F.col("orgs")),
        "c_people": T.canon_names(F.col("people")), "c_keywords": T.canon_list(F.col("keywords")),
    })


CUES = ("severity", "economic", "propagation", "specificity", "novelty", "strategic")


def canon_claims(df: DataFrame) -> DataFrame:
    """The whole step: canonical fields, identity, payload hash and the list of fired rules."""
    df = canon_relations(canon_tags(resolve_direction(canon_names(df))))
    df = rewrite_summary(df.withColumns({
        "c_source": F.when(T.squeeze("source_claimed") != "", T.squeeze("source_claimed")),
        "c_core": F.when(T.squeeze("event_core") != "", T.squeeze("event_core")),
        "_type": T.normalize_vocab(F.col("event_type_raw"), V.EVENT_TYPES),
        "_cues": F.struct(*[T.canon_list(F.col(f"cues.{c}")).alias(c) for c in CUES]),
    }), source="c_source")
    strategic = F.transform(F.filter("canon_tags", lambda t: t["tag_type"] == "strategic"), lambda t: t["tag_value"])
    df = df.withColumn("_merged", F.when(
        F.size(strategic) > 0, T.sort_by_lower(F.array_union("_cues.strategic", strategic))).otherwise(F.col("_cues.strategic")))
    df = df.withColumns({
        "c_event_type": F.coalesce("_type", T.lookup(F.col("topic"), V.TOPIC_EVENT_TYPE), F.lit("other")),
        "c_cues": F.col("_cues").withField("strategic", F.col("_merged")),
    })
    keyed = identity(df, "safe_summary", "c_countries", "c_orgs", "c_people", "c_affected", "c_keywords")
    raw_type, candidate = F.col("event_type_raw"), T.strip(F.coalesce("fingerprint", F.lit("")))
    differs = lambda a, b, rule: F.when(~F.col(a).eqNullSafe(F.col(b)), rule)
    one = lambda cond, rule: F.when(cond, rule)
    fp = F.col("fingerprint_v2")
    rules = F.array_compact(F.concat(
        F.array(
            differs("c_countries", "countries", "country_alias_normalization"),
            differs("c_affected", "affected_countries", "affected_country_alias_normalization"),
            differs("c_tickers", "tickers", "ticker_normalization"), differs("c_orgs", "orgs", "org_text_normalization"),
            differs("c_people", "people", "person_text_normalization"),
            differs("c_source", "source_claimed", "source_text_normalization"),
            differs("c_keywords", "keywords", "keyword_text_normalization"),
            differs("c_core", "event_core", "event_core_text_normalization"),
            one(F.col("_type").isNull() & (T.strip(raw_type) != ""), "event_type_invalid_dropped"),
            one(F.col("_type").isNull(), "event_type_defaulted_from_topic"),
            one(F.col("_type").isNotNull() & (raw_type != F.col("_type")), "event_type_normalization")),
        "direction_rules",
        F.array(
            differs("_cues", "cues", "impact_inputs_normalization"),
            one(F.col("tag_diagnostics.dropped") > 0, "structured_tags_invalid_dropped"),
            one(F.col("_merged") != F.col("_cues.strategic"), "impact_inputs_strategic_merge"),
            one(F.col("relation_diagnostics.dropped") > 0, "structured_relations_invalid_dropped")),
        "summary_rules",
        F.array(
            one(fp.isNotNull() & (candidate != "") & (candidate != fp), "event_fingerprint_backend_override"),
            one(fp.isNotNull() & (candidate == ""), "event_fingerprint_backend_generated"),
            one(fp.isNull(), "event_fingerprint_insufficient_identity"),
            one(fp.isNull() & (candidate != ""), "event_fingerprint_llm_candidate_ignored"))))
    payload = F.struct(
        F.col("c_affected").alias("affected_countries"), "breaking_window", "confidence", F.col("c_countries").alias("countries"),
        F.col("c_cues").alias("cues"), F.col("direction").alias("directionality"), F.col("c_core").alias("event_core"), "event_time",
        F.col("c_event_type").alias("event_type"), F.coalesce("fingerprint_v2", F.lit("")).alias("fingerprint"), "impact_score",
        "is_breaking", F.col("c_keywords").alias("keywords"), "market_stats", F.col("c_orgs").alias("orgs"),
        F.col("c_people").alias("people"), F.col("canon_relations").alias("relations"), F.col("c_source").alias("source_claimed"),
        F.col("safe_summary").alias("summary"), F.col("canon_tags").alias("tags"), F.col("c_tickers").alias("tickers"), "topic")
    return keyed.withColumns({
        "canon_rules": rules, "payload_hash": F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256),
    }).drop("_type", "_cues", "_merged")
