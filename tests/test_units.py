"""Golden values and hand-made edge rows for operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import finance, parsing
from ledgerline.operators import forecast as fc
from ledgerline.operators import ingest, tables
from ledgerline.operators.ordering import global_rank, global_row_number
from ledgerline.operators.profile import grouped_quantiles
from ledgerline.operators.timeseries import decompose
from tests.conftest import SMALL


def test_parse_money(spark):
    cases = {"$1,234": 1234.0, "(123)": -123.0, "12%": 12.0, "1.2B": 1.2e9, "450M": 4.5e8,
             "23K": 23000.0, " 7 ": 7.0, "none": None, "": None, "null": None, "abc": None,
             "€5": 5.0, "2t": 2e12}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["v"] for r in df.select("s", parsing.parse_money("s").alias("v")).collect()}
    for k, v in cases.items():
        assert (got[k] is None) if v is None else math.isclose(got[k], v), k


def test_parse_period_date(spark):
    cases = {"2024Q1": dt.date(2024, 3, 31), "2024-Q2": dt.date(2024, 6, 30),
             "Q3-2024": dt.date(2024, 9, 30), "2024 Q4": dt.date(2024, 12, 31),
             "2024": dt.date(2024, 12, 31), "2024-02-15": dt.date(2024, 2, 15),
             "02/15/2024": dt.date(2024, 2, 15), "garbage": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["d"] for r in df.select("s", parsing.parse_period_date("s").alias("d")).collect()}
    assert got == cases


def test_growth_category_zero_base(spark):
    rows = [(15.0, None, None), (5.0, None, None), (-3.0, None, None), (None, None, None),
            (None, 10.0, 0.0), (None, -5.0, 0.0), (None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g double, cur double, prev double")
    got = [r[0] for r in df.select(finance.growth_category("g", "cur", "prev")).collect()]
    assert got == ["High Growth", "Moderate Growth", "Stable", "Unknown", "High Growth",
                   "Stable", "Unknown"]


def test_reliability_golden(spark):
    # mae 9, r2 .32, n 10; naive mae 8 -> Low / does_not_beat_naive / False
    m = spark.createDataFrame([("X", 9.0, 1.0, 0.32, 0.0, 1.0, -1.0, 1.0, 10),
                               ("NaiveLast", 8.0, 1.0, 0.1, 0.0, 1.0, -1.0, 1.0, 10)],
                              "model string, mae double, rmse double, r2 double, residual_mean double,"
                              " residual_std double, residual_min double, residual_max double,"
                              " test_size long")
    r = fc.reliability(m).first()
    assert r["selected_model"] == "X"
    assert (r["model_reliability"], r["model_reliability_reason"], r["beats_naive"]) == \
        ("Low", "does_not_beat_naive", False)


def test_blend_and_gap_golden(spark):
    # preds 5 and 12, prior 8 for the first ticker, weight .5 -> 6.5; target 2 -> gap 4.5
    df = spark.createDataFrame([(5.0, 8.0), (12.0, None)], "pred double, prior double")
    w = 0.5
    p = F.when(F.col("prior").isNotNull(), w * F.col("pred") + (1 - w) * F.col("prior")) \
        .otherwise(F.col("pred"))
    got = [r[0] for r in df.select(p - 2.0).collect()]
    assert got == [4.5, 10.0]
    lab = spark.range(1).select(fc.period_label(F.lit(12.0))).first()[0]
    assert lab == "monthly"
    ann = spark.range(1).select(fc.period_to_annual(F.lit(6.5), F.lit(12.0))).first()[0]
    assert ann > 6.5


def test_blend_weight_null_r2(spark):
    got = spark.range(1).select(fc.blend_weight(F.lit(None).cast("double")),
                                fc.blend_weight(F.lit(0.9)), fc.blend_weight(F.lit(2.0)),
                                fc.blend_weight(F.lit(-1.0))).first()
    assert got[0] == 0.85 and math.isclose(got[1], 0.755) and got[2] == 0.85 and got[3] == 0.35


def test_global_rank_matches_pandas(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 50, 3000), np.full(2000, 17)]).astype(float)
    pdf = pd.DataFrame({"id": np.arange(len(vals)), "v": vals})
    df = spark.createDataFrame(pdf)
    got = global_rank(df, "v", "r", descending=True).toPandas().sort_values("id")
    exp = pdf["v"].rank(ascending=False, method="average").values
    assert np.allclose(got["r"].values, exp)


def test_global_row_number_is_a_permutation(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5003)
    out = global_row_number(df, [F.col("k"), F.col("id")], "rn").toPandas()
    out = out.sort_values(["k", "id"])
    assert list(out["rn"]) == list(range(1, 5001))


def test_grouped_quantiles_exact_with_hot_value(spark):
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(0, 1, 4000), np.full(3000, 0.25)])
    b = rng.exponential(2.0, 1500)
    pdf = pd.DataFrame({"k": ["a"] * len(a) + ["b"] * len(b), "v": np.concatenate([a, b])})
    q = grouped_quantiles(spark.createDataFrame(pdf), "k", "v", [0.05, 0.25, 0.5, 0.95]).toPandas()
    for (k, p), grp in q.groupby(["k", "p"]):
        exp = np.quantile(pdf[pdf.k == k].v.values, p)  # linear interpolation
        assert math.isclose(grp.q.iloc[0], exp, rel_tol=1e-12, abs_tol=1e-12)


def test_decomposition_adds_up(spark):
    from ledgerline.sources.panel import standard_table
    d = decompose(standard_table(spark, SMALL)).toPandas()
    assert np.allclose(d.value, d.trend + d.seasonal + d.residual, rtol=1e-9, atol=1e-6)


def test_dedupe_keep_last_with_hot_key(spark):
    rows = [("A", dt.date(2020, 3, 31), "u1", i, float(i)) for i in range(1, 500)] + \
           [("B", dt.date(2020, 3, 31), "u1", 1, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, date date, user_id string, load_seq int, v double")
    out = {r["ticker"]: r["v"] for r in tables.dedupe_keep_last(df).collect()}
    assert out == {"A": 499.0, "B": 1.0}


def test_alias_map_and_headers(spark):
    df = spark.createDataFrame([("x", "2024Q1", "$5", "1")],
                               ["Stock Symbol", "Fiscal-Date", "Net Sales", "Net Profit"])
    d = ingest.alias_map(ingest.normalize_headers(df))
    assert d.columns == ["ticker", "date", "revenue", "net_income"]


def test_infer_ticker_vote_and_fallback(spark):
    rows = [(1, "msft", None), (1, "MSFT ", None), (1, "AAPL", None), (2, None, None), (3, "TOO LONG TICKER", None)]
    df = spark.createDataFrame(rows, "upload_id int, ticker string, symbol string")
    df = df.withColumn("file", F.concat(F.lit("/up/acme_q"), F.col("upload_id").cast("string"), F.lit(".csv")))
    got = {r["upload_id"]: (r["ticker"], r["source"]) for r in ingest.infer_ticker(df, "upload_id", "file").collect()}
    assert got[1] == ("MSFT", "file data")
    assert got[2] == ("ACME", "filename")
    assert got[3] == ("ACME", "filename")


def test_linear_shapley_adds_up(spark):
    from ledgerline.operators import learners as L
    from ledgerline.operators.profile import FEATURE_COLS
    from ledgerline.sources.panel import standard_table
    std = standard_table(spark, SMALL)
    sp = fc.time_split(fc.supervised_set(std, 1))
    _, m = L.linear_forecast(sp, list(FEATURE_COLS))
    phi = L.shapley_linear(m, sp, fc.future_rows(std, FEATURE_COLS), list(FEATURE_COLS)).toPandas()
    g = phi.groupby("ticker").agg(s=("shap_value", "sum"), base=("base_value", "first"),
                                  pred=("predicted_growth_rate", "first"))
    assert np.allclose(g.s + g.base, g.pred, rtol=1e-9, atol=1e-6)


def test_stream_ingest_equals_batch(spark):
    import tempfile
    from ledgerline.sources import files
    from ledgerline.streaming import ingest as stream
    root = files.land_uploads(spark, SMALL)
    streamed = stream.run_upload_stream(spark, root, tempfile.mkdtemp(), files_per_trigger=1)
    batch = tables.dedupe_keep_last(stream.normalize_batch(files.ingest_dispatch(spark, root)))
    cols = sorted(batch.columns)
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0


def test_stream_keeps_the_last_loaded_row_over_three_triggers(spark):
    """Loads arrive out of order and in separate runs; the largest load_seq wins,
    a restarted stream goes on from its state, and compaction changes nothing."""
    import os
    import tempfile
    from ledgerline.sources import files
    from ledgerline.streaming import ingest as stream
    src, table = tempfile.mkdtemp(), tempfile.mkdtemp()
    schema = ", ".join(f"`{c}` string" for c in files.RECORD_COLS) + ", load_seq long"
    base = {c: None for c in files.RECORD_COLS} | {"upload_id": "1", "row_pos": "1", "upload_ticker": "ACME"}

    def load(seq, revenue, symbol):
        row = base | {"Symbol": symbol, "Period": "2020Q1", "Total Revenue": revenue}
        spark.createDataFrame([(*row.values(), seq)], schema).coalesce(1).write.mode("append").json(src)
        rows = spark.readStream.schema(schema).json(src)
        stream.append_stream(rows.withColumn("upload_id", F.col("upload_id").cast("long")), table)

    for seq, revenue, symbol in ((3, "$300", "acme"), (9, "$900", ""), (5, "$500", "nan")):
        load(seq, revenue, symbol)
    got = stream.read_table(spark, table).collect()
    assert [(r["ticker"], r["revenue"], r["load_seq"]) for r in got] == [("ACME", 900.0, 9)]
    stream.compact(spark, table, os.path.join(table, "compact"))
    assert spark.read.parquet(os.path.join(table, "compact")).count() == 1


def test_uploads_of_suppliers_far_apart_stay_apart(spark):
    rows = [(f"Supplier#{n:09d}", "ASIA", d, *[100.0 * n] * 6)
            for n in (7, 10_007) for d in ("2020-03-31", "2020-06-30")]
    p = spark.createDataFrame(rows, "ticker string, sector string, date string, revenue double, "
                              "operating_income double, net_income double, total_assets double, "
                              "total_liabilities double, operating_cashflow double") \
        .withColumn("date", F.col("date").cast("date"))
    from ledgerline.sources import variants
    m = variants.messy_upload(p)
    assert sorted(r[0] for r in m.select("upload_id").distinct().collect()) == [7, 10_007]
    assert m.groupBy("upload_id", "row_pos").count().where("count > 1").isEmpty()


def test_sampled_shapley_is_efficient_for_linear_model(spark):
    # For a linear model, permutation Shapley values are exact whatever the
    # permutations: Σφ = f(x) - mean_b f(b).
    from ledgerline.operators import learners as L
    rng = np.random.default_rng(1)
    feats = ["a", "b", "c"]
    pdf = pd.DataFrame(rng.normal(size=(60, 3)), columns=feats)
    pdf["target"] = 2 * pdf.a - pdf.b + 0.5 * pdf.c + 1
    pdf["ticker"] = [f"t{i}" for i in range(60)]
    pdf["date"] = pd.Timestamp("2020-01-01")
    df = spark.createDataFrame(pdf)
    from pyspark.ml.regression import LinearRegression
    m = LinearRegression(featuresCol="features", labelCol="target", solver="normal") \
        .fit(L.assemble(df, feats))
    phi = L.shapley_sampled(m, df, df.limit(5), feats, n_background=10, n_perm=3).toPandas()
    bg = L.seeded_sample(df.withColumn("_bk", F.concat_ws("|", "ticker", F.col("date").cast("string"))), 10, "_bk").toPandas()
    coef, icpt = m.coefficients.toArray(), m.intercept
    base = float(np.mean(bg[feats].to_numpy() @ coef + icpt))
    rows = pdf.set_index("ticker")
    for t, g in phi.groupby("ticker"):
        fx = float(rows.loc[t, feats].to_numpy() @ coef + icpt)
        assert math.isclose(g.shap_value.sum(), fx - base, rel_tol=1e-6, abs_tol=1e-6)


def test_global_rank_many_matches_pandas(spark):
    from ledgerline.operators.ordering import global_rank_many
    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n),
                        "a": np.where(rng.random(n) < 0.4, 3.0, rng.normal(size=n)),
                        "b": rng.integers(0, 20, n).astype(float)})
    pdf.loc[5, "b"] = np.nan
    got = global_rank_many(spark.createDataFrame(pdf), ["id"], ["a", "b"]).toPandas().sort_values("id")
    for c in ("a", "b"):
        exp = pdf[c].rank(ascending=False, method="average").values
        assert np.allclose(got[f"{c}_rank_avg"].values, exp, equal_nan=True)
