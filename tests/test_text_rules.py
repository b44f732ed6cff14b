"""Rule examples on small rows."""

import pytest
from pyspark.sql import functions as F

from wireloom.functions import text as T
from wireloom.operators import canonical as C, scoring as S, triage as R
from wireloom.sources import adhoc, messages as M


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_normalize_message(spark):
    f = lambda s: one(spark, T.normalize_message(F.lit(s)))
    assert f("🚨 BREAKING: JERUSALEM (AP) - U.S. OFFICIAL SAYS STRIKE STARTED - REUTERS") == "U.S. OFFICIAL SAYS STRIKE STARTED"
    assert f("  a   b!!  c?? ") == "a b! c?"
    assert f("ALERT: URGENT: x") == "x"
    assert one(spark, T.normalize_message(F.lit(None).cast("string"))) == ""


def test_country_and_name_forms(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, T.canon_countries(arr(" u.s. ", "iran", "USA", "Qatar", "qatar"))) == ["Iran", "Qatar", "United States"]
    assert one(spark, T.canon_names(arr("MINISTRY OF ENERGY", "OPEC", "unknown", "Bank of X", "ministry of energy"))) == ["Bank of X", "Ministry of Energy", "OPEC"]
    assert one(spark, T.canon_tickers(arr("xom ", "$bp.l", "XOM"))) == ["BP.L", "XOM"]


def test_half_even_and_clamp(spark):
    assert one(spark, T.half_even_int(F.lit(12.5))) == 12
    assert one(spark, T.half_even_int(F.lit(13.5))) == 14
    assert one(spark, T.clamp(F.lit(120.0), 0.0, 100.0)) == 100.0


def test_score_distribution_examples(spark):
    df = spark.createDataFrame([(float(v),) for v in (10, 40, 61, 79, 80, 92)], "calibrated_score double")
    r = S.score_distribution(df).first()
    assert (r["n"], r["p95"], r["p99"], r["pct_gt_40"], r["pct_gt_60"], r["pct_gte_80"]) == (6, 92.0, 92.0, 66.67, 66.67, 33.33)
    empty = S.score_distribution(df.filter("false")).first()
    assert empty["n"] == 0 and empty["p95"] == 0.0 and empty["pct_gt_40"] == 0.0


def test_read_only_guard():
    assert adhoc.check_query(" select 1 ; ") == "select 1"
    for bad in ("", "drop table x", "select 1; select 2", "select * into t from x", "with a as (select 1) delete from a", "update x set a = 1"):
        with pytest.raises(ValueError):
            adhoc.check_query(bad)


def test_extracted_claim(spark):
    df = spark.createDataFrame([("Fed hikes 25 bps, UST 10y up 4.5%", None, "desk")], "text string, message_time timestamp_ntz, channel string")
    r = M.extract_claims(df).first()
    assert r["topic"] == "central_banks" and r["tickers"] == ["UST"]
    assert r["numbers"] == ["25bps", "4.5"] and r["impact_score"] == 19.0
    assert [s["unit"] for s in r["market_stats"]] == ["bps", "value"]
    assert r["keywords"][:2] == ["desk", "UST"] and len(r["fingerprint"]) == 48


def test_local_incident_is_never_above_monitor(spark):
    rows = [(1, "Police say two injured in city incident", [], "city desk", 90.0, 0.9), (2, "Missile strike injured police in Tehran", [], "wire", 90.0, 0.9)]
    df = spark.createDataFrame(rows, "claim_id long, summary string, keywords array<string>, source_claimed string, impact_score double, confidence double")
    none = F.array().cast("array<string>")
    df = df.withColumns({"countries": none, "orgs": none, "people": none, "topic": F.lit("other"), "is_breaking": F.lit(False)})
    f = R.triage_features(df).withColumns({"materially_new": F.lit(True), "existing_event_id": F.lit(None).cast("long"), "soft_related": F.lit(False), "burst_count": F.lit(0).cast("long")})
    got = {r["claim_id"]: (r["local_incident"], r["triage_action"], r["publish_priority"]) for r in R.route(R.triage(f)).collect()}
    assert got[1] == (True, "monitor", "low") and got[2] == (False, "promote", "high")


def test_burst_of_repeats(spark):
    """One earlier repeat is an update, two are capped to monitor."""
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "fx", t0 + dt.timedelta(minutes=4 * i), f"v{i}", "desk", 60.0, ["usa", "iran"], ["opec"], [], ["oil", "gas"]) for i in range(3)]
    rows.append((9, "fx", t0 + dt.timedelta(minutes=60), "v9", "desk", 60.0, ["usa", "iran"], ["opec"], [], ["oil", "gas"]))
    df = spark.createDataFrame(rows, "claim_id long, topic string, created_at timestamp_ntz, fingerprint string, source_claimed string, impact_score double, "
                                     "countries array<string>, orgs array<string>, people array<string>, keywords array<string>")
    got = {r["claim_id"]: (r["soft_related"], r["burst_count"]) for r in R.burst_counts(df).collect()}
    assert got == {0: (False, 0), 1: (True, 1), 2: (True, 2), 9: (False, 0)}


def test_summary_rewrite(spark):
    rows = [("It launched a missile.", "Market News Feed", ["NATO"]), ("They said talks go on.", "Agency X", []), ("Strike hits port", "Agency X", [])]
    df = spark.createDataFrame(rows, "summary string, source_claimed string, c_orgs array<string>")
    df = df.withColumns({"c_people": F.array().cast("array<string>"), "c_countries": F.array().cast("array<string>")})
    got = [r["safe_summary"] for r in C.rewrite_summary(df).collect()]
    assert got == ["Reportedly, nato launched a missile.", "Agency X said talks go on.", "Agency X said strike hits port."]
