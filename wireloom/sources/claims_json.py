"""Validation of claim documents that arrive as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, vocab as V

# fixed values: the claim document contract
REQUIRED_KEYS = ("topic", "entities", "affected_countries_first_order", "market_stats", "sentiment", "confidence", "impact_score",
                 "is_breaking", "breaking_window", "event_time", "source_claimed", "summary_1_sentence", "keywords")
OPTIONAL_KEYS = ("event_type", "directionality", "tags", "relations", "impact_inputs", "event_core", "event_fingerprint")

PAYLOAD = (
    "topic string, event_type string, directionality string, entities struct<countries:array<string>,orgs:array<string>,people:array<string>,tickers:array<string>>, "
    "affected_countries_first_order array<string>, market_stats array<struct<label:string,value:double,unit:string,context:string>>, "
    "tags array<struct<tag_type:string,tag_value:string,tag_source:string,confidence:double>>, "
    "relations array<struct<subject_type:string,subject_value:string,relation_type:string,object_type:string,object_value:string,relation_source:string,confidence:double>>, "
    "impact_inputs struct<severity_cues:array<string>,economic_relevance_cues:array<string>,propagation_potential_cues:array<string>,specificity_cues:array<string>,"
    "novelty_cues:array<string>,strategic_tag_hits:array<string>>, sentiment string, confidence double, impact_score double, is_breaking boolean, breaking_window string, "
    "event_time string, source_claimed string, summary_1_sentence string, keywords array<string>, event_core string, event_fingerprint string")


def reject_reason(doc: Column) -> Column:
    """``invalid_json``, ``schema_error`` or null. Bad tag and relation items do not reject a document.

    The text is parsed once per row; every check reads the parsed value.
    """
    parsed = F.struct(F.try_parse_json(doc).alias("v"), F.json_object_keys(doc).alias("keys"))
    return T.let(parsed, lambda p: F.when(p["v"].isNull() | p["keys"].isNull(), "invalid_json").when(
        ~F.coalesce(_contract(p["v"], p["keys"]), F.lit(False)), "schema_error"))


def _contract(v: Column, keys: Column) -> Column:
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    text_list = lambda path: get(path, "array<string>").isNotNull()
    optional_list = lambda path: get(path, "variant").isNull() | text_list(path)
    word = lambda name, allowed: F.coalesce(get(f"$.{name}", "string").isin(*allowed), F.lit(False))
    ranged = lambda name, hi: F.coalesce(get(f"$.{name}", "double").between(0.0, hi), F.lit(False))
    maybe_text = lambda name: ~get(f"$.{name}", "string").rlike(r"^[\[{]") | get(f"$.{name}", "string").isNull()
    stat_ok = F.coalesce(F.forall(get("$.market_stats", "array<variant>"), lambda s: F.try_variant_get(s, "$.label", "string").isNotNull()
                                  & F.try_variant_get(s, "$.value", "double").isNotNull() & F.try_variant_get(s, "$.unit", "string").isNotNull()), F.lit(False))
    time_ok = get("$.event_time", "string").isNull() | F.try_to_timestamp(get("$.event_time", "string")).isNotNull()
    return (
        (F.size(F.array_except(keys, T.lit_array(REQUIRED_KEYS + OPTIONAL_KEYS))) == 0) & (F.size(F.array_except(T.lit_array(REQUIRED_KEYS), keys)) == 0)
        & word("topic", V.TOPICS) & word("sentiment", V.SENTIMENTS) & word("breaking_window", V.BREAKING_WINDOWS)
        & ranged("confidence", 1.0) & ranged("impact_score", 100.0) & get("$.is_breaking", "boolean").isNotNull() & get("$.summary_1_sentence", "string").isNotNull()
        & text_list("$.keywords") & text_list("$.affected_countries_first_order") & stat_ok & time_ok & maybe_text("source_claimed")
        & get("$.entities", "map<string,variant>").isNotNull()
        & optional_list("$.entities.countries") & optional_list("$.entities.orgs") & optional_list("$.entities.people") & optional_list("$.entities.tickers"))


def validate_claims(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows with the parsed ``payload``, rejected rows with ``reject_reason``)."""
    marked = df.withColumn("reject_reason", reject_reason(F.col(json_col)))
    bad = marked.filter(F.col("reject_reason").isNotNull())
    good = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason").withColumn("payload", F.from_json(json_col, PAYLOAD))
    clean = F.trim(F.coalesce("payload.event_fingerprint", F.lit("")))
    is_text = F.try_variant_get(F.try_parse_json(json_col), "$.event_fingerprint", "string").isNotNull() & F.get_json_object(json_col, "$.event_fingerprint").isNotNull()
    return good.withColumn("payload", F.col("payload").withField("event_fingerprint", F.when(is_text, clean).otherwise(""))), bad
