"""Artifacts of a batch as if its rows came one by one."""

from wireloom.sources.messages import merge_artifacts

SCHEMA = "artifact_id long, input_hash string, canonical_hash string"


def merged(spark, new, stored=()):
    out = merge_artifacts(spark.createDataFrame(list(new), SCHEMA), spark.createDataFrame(list(stored), SCHEMA))
    return sorted((r.artifact_id, r.input_hash, r.canonical_hash, r.origin) for r in out.collect())


def test_missing_inputs_never_group(spark):
    got = merged(spark, [(1, None, "x"), (2, None, "y"), (3, "", "z")])
    assert [(a, c, o) for a, _, c, o in got] == [(1, "x", "inserted"), (2, "y", "inserted"), (3, "z", "inserted")]


def test_a_text_that_was_never_stored_is_inserted(spark):
    got = merged(spark, [(1, "i1", "x"), (2, "i1", "y"), (3, "i2", "y")])
    assert [(a, i, c) for a, i, c, _ in got] == [(1, "i1", "x"), (3, "i2", "y")]


def test_a_missing_input_is_filled_once(spark):
    got = merged(spark, [(11, "i1", "x"), (12, "i2", "x"), (13, "i1", "z"), (14, "i2", "z")], [(1, None, "x")])
    assert got == [(1, "i1", "x", "stored"), (14, "i2", "z", "inserted")]
