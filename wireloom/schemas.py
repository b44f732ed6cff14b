"""Declared schemas of the tables the jobs read and write."""

from __future__ import annotations

from .operators.events import STATE as EVENT_STATE
from .sources.claims_json import PAYLOAD as CLAIM_PAYLOAD
from .sources.messages import PAYLOAD as MESSAGE

__all__ = ["MESSAGE", "CLAIM_PAYLOAD", "EVENT_STATE", "RAW_CLAIM", "LINK", "ROUTING", "ENTITY_MENTION", "EVIDENCE"]

TAG = "struct<tag_type:string,tag_value:string,tag_source:string,confidence:double>"
RELATION = ("struct<subject_type:string,subject_value:string,relation_type:string,object_type:string,object_value:string,"
            "relation_source:string,confidence:double>")
STAT = "struct<label:string,value:double,unit:string,context:string>"
CUES = ("struct<severity:array<string>,economic:array<string>,propagation:array<string>,specificity:array<string>,novelty:array<string>,"
        "strategic:array<string>>")
RAW_CLAIM = (
    "claim_id bigint, created_at timestamp_ntz, topic string, event_time timestamp_ntz, impact_score double, confidence double, is_breaking boolean, "
    "breaking_window string, summary string, source_claimed string, fingerprint string, countries array<string>, orgs array<string>, people array<string>, "
    f"tickers array<string>, affected_countries array<string>, keywords array<string>, market_stats array<{STAT}>, tags array<{TAG}>, "
    f"relations array<{RELATION}>, cues {CUES}, event_type_raw string, direction_raw string, event_core string")
LINK = "event_id bigint, raw_message_id bigint, linked_at timestamp_ntz"
ROUTING = ("claim_id bigint, store_to array<string>, publish_priority string, requires_evidence boolean, event_action string, triage_action string, "
           "triage_reasons array<string>, flags array<string>, routing_rules array<string>")
ENTITY_MENTION = ("raw_message_id bigint, entity_type string, entity_value string, event_id bigint, topic string, is_breaking boolean, "
                  "event_time timestamp_ntz")
EVIDENCE = ("theme_key string, event_id bigint, claim_id bigint, event_time timestamp_ntz, created_at timestamp_ntz, impact_score double, "
            "calibrated_score double, archetypes array<string>, direction string, entity_refs array<string>, geography_refs array<string>, "
            "reason_codes array<string>, dedupe_key string")
