"""Stored tables that take changes, observed counts, and duplicate uploads in the stream."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from ledgerline.functions import parsing
from ledgerline.operators import score, validate
from ledgerline.sources.files import UPLOAD_COLS
from ledgerline.sources.store import StoredTable, delete_user_ticker
from ledgerline.streaming import ingest as stream

SCHEMA = "ticker string, date string, user_id string, revenue double, load_seq int"


def table(spark, rows, buckets=8):
    t = StoredTable(spark, os.path.join(tempfile.mkdtemp(), "t"), buckets=buckets)
    assert t.reload(spark.createDataFrame(rows, SCHEMA))["rows"] == len(rows)
    return t


def rows_of(t):
    return sorted(tuple(r) for r in t.read().select("ticker", "date", "user_id", "revenue", "load_seq").collect())


BASE = [(f"T{i}", d, "u1", float(i), 1) for i in range(40) for d in ("2024-03-31", "2024-06-30")]


def untouched(before, after, t, tickers):
    own = {r[0] for r in t.spark.createDataFrame([(x,) for x in tickers], "ticker string").select(t._bucket()).collect()}
    assert own and len(own) < len(before)
    for b in set(before) - own:
        assert before[b] == after[b]
    return own


def test_upsert_replaces_adds_and_leaves_other_buckets_alone(spark):
    t = table(spark, BASE)
    before = t.files()
    new = [("T3", "2024-06-30", "u1", 99.0, 2), ("T3", "2024-06-30", "u1", 98.0, 3), ("T3", "2024-09-30", "u2", 7.0, 2)]
    got = t.upsert(spark.createDataFrame(new, SCHEMA))
    own = untouched(before, t.files(), t, ["T3"])
    assert got["buckets"] == len(own) == 1 and all(before[b] != t.files()[b] for b in own)
    want = [r for r in BASE if r[:3] != ("T3", "2024-06-30", "u1")] + [new[1], new[2]]
    assert rows_of(t) == sorted(want)
    assert t.upsert(spark.createDataFrame([], SCHEMA)) == {"rows": 0, "buckets": 0} and rows_of(t) == sorted(want)


def test_delete_over_several_tables_and_of_a_buckets_last_row(spark):
    one, two = table(spark, BASE), table(spark, [("t5", "2024-03-31", "u1", 1.0, 1)])
    before = one.files()
    delete_user_ticker({"panel": one, "uploads": two}, "u1", "T5")
    untouched(before, one.files(), one, ["T5"])
    assert rows_of(one) == sorted(r for r in BASE if r[0] != "T5")
    assert two.files() == {} and rows_of(two) == []
    two.upsert(spark.createDataFrame(BASE[:1], SCHEMA))
    assert rows_of(two) == BASE[:1]


def test_an_emptied_bucket_loses_its_files(spark):
    t = table(spark, [("A", "2024-03-31", "u1", 1.0, 1), ("B", "2024-03-31", "u1", 2.0, 1)], buckets=64)
    t.delete("u1", "a")
    assert rows_of(t) == [("B", "2024-03-31", "u1", 2.0, 1)] and len(t.files()) == 1


def test_replacement_is_case_insensitive(spark):
    t = table(spark, BASE)
    before = t.files()
    new = spark.createDataFrame([("T1", "2025-03-31", "u9", 5.0, 9)], SCHEMA)
    t.replace_tickers(new, spark.createDataFrame([("t1",), ("t2",)], "ticker string"))
    untouched(before, t.files(), t, ["T1", "T2"])
    assert rows_of(t) == sorted([r for r in BASE if r[0] not in ("T1", "T2")] + [("T1", "2025-03-31", "u9", 5.0, 9)])


def test_counts_are_observed_while_rows_are_written(spark):
    fields = validate.TRAINING_FIELDS
    rows = [tuple(None if k == i % 10 else f"{k}" for k in range(len(fields))) for i in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))
    path = os.path.join(tempfile.mkdtemp(), "p")
    got = validate.write_prepared(df, path)
    want = {r["field"]: r["rows"] for r in validate.prepare_training(df.withColumn("b", F.lit(1)), "b").collect()}
    assert {k: v for k, v in got.items() if v} == want and spark.read.parquet(path).count() == want["(kept)"]


def document(ticker, upload, values, shape="array"):
    recs = [{"upload_id": str(upload), "row_pos": str(k), "upload_ticker": ticker,
             **dict.fromkeys(UPLOAD_COLS, "1"), "Symbol": ticker, "Period": f"{2000 + k}", "Total Revenue": v}
            for k, v in enumerate(values)]
    return json.dumps(recs if shape == "array" else {"kind": "statement", "data": recs})


def land(root, shape, name, docs):
    os.makedirs(os.path.join(root, "json", shape), exist_ok=True)
    with open(os.path.join(root, "json", shape, name), "w") as f:
        f.write("".join(d + "\n" for d in docs))


def test_an_upload_that_lands_again_is_accepted_once_over_restarts(spark):
    root, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    land(root, "array", "a.txt", [document("AA", 1, ["10", "20"]), document("BB", 4, ["10", "20"])])
    land(root, "object", "a.txt", [document("CC", 7, ["1"], "object")])
    stream.append_unique(stream.document_stream(spark, root), out)
    first = sorted((r.upload_id, r.ticker) for r in stream.unique_uploads(spark, out).collect())
    assert first == [(1, "AA"), (4, "BB"), (7, "CC")]
    # again under other names and ids of the same user; one has a value changed; one takes the other shape
    land(root, "array", "b.txt", [document("AA", 10, ["10", "20"]), document("BB", 4, ["10", "21"])])
    land(root, "object", "b.txt", [document("AA", 1, ["10", "20"], "object"), document("CC", 7, ["1"], "object")])
    stream.append_unique(stream.document_stream(spark, root), out)
    got = sorted((r.upload_id, r.ticker) for r in stream.unique_uploads(spark, out).collect())
    assert got == [(1, "AA"), (4, "BB"), (4, "BB"), (7, "CC")]
    assert stream.unique_rows(spark, out).count() == 2 + 2 + 2 + 1


def test_money_is_whole_or_nothing(spark):
    cases = {"$(1,234.50)": -1234.5, "( 5 )": -5.0, "(5": None, "5)": None, "(-5)": None, "--5": None, "-5": -5.0,
             "+5": 5.0, "1.2.3": None, "5 m": 5e6, "-$3K": -3000.0, "12 %": 12.0, ".5": 0.5, "1e3": 1000.0, "K": None,
             "inf": None, "NaN": None, "5KM": None, "₹1,00,000": 100000.0, "5.": 5.0}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["v"] for r in df.select("s", parsing.parse_money("s").alias("v")).collect()}
    assert got == cases


def gate_input(spark, gated):
    base = spark.createDataFrame([{"ticker": "Q", "x": 1}]).select(
        "ticker", F.lit("Base summary").alias("executive_summary"), F.lit(8).alias("performance_score"),
        F.struct(F.lit("f").alias("forecast"), F.lit(11.0).alias("predicted_growth_rate")).alias("growth_outlook"),
        F.struct(F.lit("Low").alias("overall_risk"), F.array(F.lit("own warning")).alias("critical_warnings")).alias("risk_assessment"),
        F.array(score._record(score.OPPORTUNITY_FIELDS, ("Original opportunity", "r", "u"))).alias("opportunities"),
        F.array(*[score._record(score.ACTION_FIELDS, ("Low", f"action {k}", "r", "t")) for k in range(3)]).alias("action_items"),
        F.lit("BUY").alias("investment_verdict"))
    sig = spark.createDataFrame([dict(
        ticker="Q", predicted_period=3.0, target_period=10.0, gap_period=-7.0, periods_per_year=12.0, predicted_annual=38.0,
        target_annual=10.0, gap_annual=28.0, model_reliability="Low" if gated else "High", beats_naive=not gated,
        naive_mae=7.8, mae=8.5 if gated else 2.1, rmse=9.4 if gated else 2.9, r2=0.11 if gated else 0.67,
        residual_std=4.2 if gated else 1.0, test_size=6 if gated else 24)])
    return base, sig


def test_the_gate_rewrites_the_record(spark):
    base, sig = gate_input(spark, True)
    r = score.normalized_record(base, sig).first()
    assert r.performance_score <= 4 and r.investment_verdict == "HOLD" and r.growth_outlook.low_confidence_mode
    assert r.executive_summary.startswith("Low-confidence mode:") and r.executive_summary.endswith("Base summary")
    assert r.risk_assessment.overall_risk == "Medium" and r.growth_outlook.confidence == "Low"
    assert r.risk_assessment.critical_warnings == ["own warning", score.GATE_WARNING_2, score.GATE_WARNING]
    assert [o.title for o in r.opportunities] == ["Model validation before directional action"]
    assert [(a.priority, a.action) for a in r.action_items[:2]] == [("Medium", "action 0"), ("Medium", "action 1")]
    assert len(r.action_items) == 3 and r.action_items[2].priority == "High"
    assert set(r.reliability_gate.reasons) == {"model_reliability_low", "r2_below_threshold", "insufficient_holdout_samples",
                                               "does_not_beat_naive"}
    assert r.score_breakdown.cap_applied.type == "low_confidence_cap"
    again = score.normalized_record(score.normalized_record(base, sig).drop("reliability_gate", "model_reliability"), sig).first()
    assert again.risk_assessment.critical_warnings == r.risk_assessment.critical_warnings  # warnings and prefix come once
    assert again.executive_summary == r.executive_summary


def test_a_reliable_record_stays_as_it_is(spark):
    base, sig = gate_input(spark, False)
    r = score.normalized_record(base, sig).first()
    assert not r.reliability_gate.triggered and r.investment_verdict == "BUY" and r.executive_summary == "Base summary"
    assert r.performance_score >= 4 and r.growth_outlook.confidence == "Medium" and len(r.action_items) == 3
    assert r.opportunities[0].title == "Original opportunity" and r.score_breakdown.cap_applied is None
