"""Every registered query runs; those with oracle SQL agree with it (a spread of them here, all with checker.py)."""

import pytest

import checker
from wireloom import catalog
from wireloom.operators.themes import Theme, ThemeRegistry

catalog.load()
SAMPLE = ["digest_layout", "burst_counts", "candidate_event", "fold_by_identity", "canon_tags", "calibrate_impact", "rank_topics", "emit_cards", "audit_digest", "feed_pages",
          "title_entity_overlap", "ingest_status", "stream_ingest", "validate_claims_rejected"]


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 130


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name, monkeypatch):
    monkeypatch.setattr(checker, "SF", "/root/testdata/sf0.001")
    ok, msg = checker.compare(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], checker.connect())
    assert ok, msg


def test_theme_registry_checks():
    reg = ThemeRegistry()
    reg.register(Theme("a", "A"))
    for bad in (Theme("a", "again"), Theme(" ", "blank"), Theme("b", "no lens", lenses=()), Theme("c", "cadence", cadences=("hourly",))):
        with pytest.raises(ValueError):
            reg.register(bad)
    with pytest.raises(KeyError):
        reg.get("nope")
