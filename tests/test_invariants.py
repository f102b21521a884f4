"""Invariants for the rows-only queries (iterative learners, file sources,
nested outputs): the properties that must hold whatever the solver details."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ledgerline.operators import forecast as fc
from ledgerline.operators import learners as L
from ledgerline.operators.profile import FEATURE_COLS
from ledgerline.plans.registry import queries
from ledgerline.sources import files, variants
from ledgerline.sources.panel import panel, standard_table
from tests.conftest import SMALL

QS = queries()


def test_csv_scan_returns_every_landed_row(spark):
    m = variants.messy_upload(panel(spark, SMALL))
    expected = m.filter(F.pmod("upload_id", F.lit(2)) == 0).count()
    assert QS["scan_csv"](spark, SMALL).count() == expected


def test_every_landed_record_is_read_back(spark):
    m = variants.messy_upload(panel(spark, SMALL))
    root = files.land_uploads(spark, SMALL)
    assert files.ingest_dispatch(spark, root).count() == m.count()
    odd = m.filter(F.pmod("upload_id", F.lit(2)) == 1)
    assert files.scan_json_flex(spark, os.path.join(root, "json")).count() == odd.count()


def test_flex_json_document_shapes(spark):
    docs = ['[{"Symbol": "A"}, {"Symbol": "B"}]', '{"kind": "x", "data": [{"Symbol": "C"}], "more": [{"Symbol": "D"}]}',
            '{"Symbol": "E"}', "[]", '"text"', "not json"]
    got = files.flex_records(spark.createDataFrame([(d,) for d in docs], "value string"))
    assert sorted(r["Symbol"] for r in got.collect()) == ["A", "B", "C", "E"]


def test_dispatch_rejects_unknown_type(spark):
    import pytest
    with pytest.raises(ValueError):
        files.ingest_dispatch(spark, files.land_uploads(spark, SMALL), kinds=("xml",))


def test_forecast_uses_its_champion(spark):
    from ledgerline.plans.registry import queries
    out = queries()["forecast_all"](spark, SMALL).select(
        "selected_model", "overall_champion", "predicted_growth_rate_period_pct").distinct().collect()
    assert {r["selected_model"] for r in out} == {r["overall_champion"] for r in out}
    assert {r["selected_model"] for r in out} <= {"LinearRegression", "RandomForest", "NaiveMean"}


def test_folds_are_expanding_and_disjoint(spark):
    std = standard_table(spark, SMALL)
    sp = fc.time_split(fc.supervised_set(std, 1))
    folds = fc.ts_folds(sp).toPandas()
    tests = {}
    for f, g in folds.groupby("fold"):
        tr, te = g[g.role == "train"].date, g[g.role == "test"].date
        assert len(te) > 0 and len(tr) > 0 and tr.max() < te.min()
        tests[f] = set(te)
    ks = sorted(tests)
    for i in range(len(ks)):
        for j in range(i + 1, len(ks)):
            assert not (tests[ks[i]] & tests[ks[j]])


def test_split_is_chronological(spark):
    std = standard_table(spark, SMALL)
    sp = fc.time_split(fc.supervised_set(std, 1))
    r = sp.groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()
    d = {x["split"]: x for x in r}
    assert d["train"]["hi"] < d["test"]["lo"]


def test_scores_and_gate(spark):
    rec = QS["normalize_recommendation"](spark, SMALL).toPandas()
    assert rec.performance_score.between(1, 10).all()
    gated = rec[rec.low_confidence_mode]
    assert (gated.performance_score <= 4).all()
    assert (gated.investment_verdict == "HOLD").all()
    assert (gated.confidence == "Low").all()
    assert (gated.overall_risk != "Low").all()


def test_recommendation_json_round_trip(spark):
    ext = QS["recommendation_extract"](spark, SMALL).toPandas().set_index("ticker")
    rec = QS["normalize_recommendation"](spark, SMALL).toPandas().set_index("ticker")
    assert (ext.performance_score == rec.performance_score).all()
    assert (ext.overall_risk == rec.overall_risk).all()


def test_benchmark_contains_every_candidate(spark):
    models = {r["model"] for r in QS["benchmark_table"](spark, SMALL).collect()}
    assert models == {"NaiveLast", "NaiveMean", "LinearTrend", "LinearRegression", "RandomForest"}


def test_upload_listing_is_the_users_files(spark):
    lst = QS["upload_listing"](spark, SMALL).toPandas()
    assert len(lst) > 0 and (lst.upload_id % 3 == 1).all()


def test_report_sinks_round_trip(spark, tmp_path):
    from ledgerline.plans import reports
    out = str(tmp_path / "reports")
    paths = reports.write_reports(spark, SMALL, out, names=("historical_performance", "peer_rankings"))
    assert set(paths) == {"historical_performance", "peer_rankings"}
    back = reports.read_report(spark, out, "historical_performance", {"num_periods": "num_years"})
    assert "num_years" in back.columns
    assert back.count() == QS["historical_performance"](spark, SMALL).count()
    with __import__("pytest").raises(ValueError):
        reports.load_modeling_data(spark, SMALL).select("ticker").transform(
            lambda d: __import__("ledgerline.operators.ingest", fromlist=["x"]).require_columns(d))
