"""Exact forest attributions, champion's drivers, cross-validation by sums and strategies."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from ledgerline.operators import attribution
from ledgerline.operators import forecast as fc
from ledgerline.operators import learners as L
from ledgerline.plans import learner_queries as Q
from ledgerline.plans.forecast_queries import setup
from tests.conftest import SMALL

FEATS = ["a", "b", "c", "d"]


def small_forest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).round(2)
    y = x[:, 0] * 3 + np.where(x[:, 1] > 0, 5, -5) * x[:, 2] + rng.normal(size=300)
    df = spark.createDataFrame([(f"t{i}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))],
                               "ticker string, a double, b double, c double, d double, target double")
    est = RandomForestRegressor(featuresCol="features", labelCol="target", seed=1, numTrees=5, maxDepth=4)
    return est.fit(L.assemble(df, FEATS)), df


def brute_shapley(leaves, x):
    """Average over all orders of the change in expectation, from every subset's value."""
    d = leaves.n_features

    def value(known):
        total = 0.0
        for f, lo, hi, z, v in zip(leaves.feature, leaves.lo, leaves.hi, leaves.share, leaves.value, strict=True):
            p = v
            for k in range(len(f)):
                if f[k] >= 0:
                    p *= float(lo[k] < x[f[k]] <= hi[k]) if f[k] in known else z[k]
            total += p
        return total

    phi = np.zeros(d)
    for j in range(d):
        rest = [i for i in range(d) if i != j]
        for r in range(d):
            for s in itertools.combinations(rest, r):
                w = math.factorial(r) * math.factorial(d - r - 1) / math.factorial(d)
                phi[j] += w * (value({*s, j}) - value(set(s)))
    return phi, value(set())


def test_forest_attributions_equal_all_orders(spark):
    model, df = small_forest(spark)
    rows = df.limit(6)
    got = attribution.shapley_forest(model, rows, FEATS).toPandas()
    leaves = attribution.forest_leaves(spark, model, 4)
    for r in rows.collect():
        own = got[got.ticker == r.ticker].set_index("feature")
        phi, base = brute_shapley(leaves, np.array([r[c] for c in FEATS]))
        assert own.loc[FEATS, "shap_value"].to_numpy() == pytest.approx(phi, abs=1e-9)
        assert own.base_value.iloc[0] == pytest.approx(base, abs=1e-9)


def test_forest_attributions_add_up_to_the_models_prediction(spark):
    model, df = small_forest(spark)
    got = attribution.shapley_forest(model, df, FEATS).groupBy("ticker").agg(
        F.sum("shap_value").alias("s"), F.first("base_value").alias("base"), F.first("predicted_growth_rate").alias("p"))
    both = got.join(model.transform(L.assemble(df, FEATS)), "ticker").select("s", "base", "p", "prediction").toPandas()
    assert len(both) == 300
    assert (both.s + both.base).to_numpy() == pytest.approx(both.p.to_numpy(), abs=1e-9)
    assert both.p.to_numpy() == pytest.approx(both.prediction.to_numpy(), abs=1e-9)


def test_leaves_are_looked_up_in_groups(spark, monkeypatch):
    model, df = small_forest(spark)
    x = df.select(*FEATS).limit(40).toPandas().to_numpy()
    for table in (attribution.TABLE, 16, 2):  # the last one holds leaves of one feature only
        monkeypatch.setattr(attribution, "TABLE", table)
        leaves = attribution.forest_leaves(spark, model, 4)
        n = len(leaves.groups)
        assert list(leaves.groups[:, 0]) == [0, *leaves.groups[:-1, 1]] and leaves.groups[-1, 1] == len(leaves.value)
        assert table < 1024 or n * 3 < len(leaves.value)
        got = leaves.explain_block(x, 0, n // 2) + leaves.explain_block(x, n // 2, n)
        phi, pred = leaves.explain(x)
        assert got[:, :-1] == pytest.approx(phi, abs=1e-9) and got[:, -1] == pytest.approx(pred, abs=1e-9)


def test_equal_and_incomplete_rows_are_explained_each(spark):
    model, df = small_forest(spark)
    rows = df.limit(5).withColumn("ticker", F.when(F.col("ticker") != "t0", F.col("ticker"))) \
        .withColumn("b", F.when(F.col("ticker") != "t1", F.col("b")))
    got = attribution.shapley_forest(model, rows.unionAll(rows), FEATS).toPandas()
    assert len(got) == 2 * 5 * len(FEATS) and (got.ticker.isna()).sum() == 2 * len(FEATS)
    leaves = attribution.forest_leaves(spark, model, 4)
    for r in rows.filter("ticker = 't1'").collect():
        phi, pred = leaves.explain(np.array([[np.nan if r[c] is None else r[c] for c in FEATS]]))
        own = got[got.ticker == "t1"].groupby("feature").shap_value.mean()
        assert own[FEATS].to_numpy() == pytest.approx(phi[0], abs=1e-9)


def test_forests_are_fitted_on_few_partitions(spark):
    cores = max(8, spark.sparkContext.defaultParallelism)
    rows = spark.range(1000).repartition(4 * cores)
    assert L.fewer_parts(rows).rdd.getNumPartitions() == cores
    assert L.fewer_parts(rows.repartition(3)).rdd.getNumPartitions() == 3


def test_uploads_forest_is_fitted_on_even_partitions(spark, monkeypatch):
    cores = max(8, spark.sparkContext.defaultParallelism)

    def sizes(df):
        return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    uneven = spark.range(0, 4000, 1, 2 * cores).filter("id < 200 or id >= 3000")
    dealt = L.even_parts(uneven)
    assert len(sizes(dealt)) == cores and max(sizes(dealt)) <= 1.5 * 1200 / cores
    assert sorted(r["id"] for r in dealt.collect()) == [*range(200), *range(3000, 4000)]

    seen = []

    def fit(est, df):
        seen.extend(sizes(df))
        raise InterruptedError
    monkeypatch.setattr(RandomForestRegressor, "fit", fit)
    with pytest.raises(InterruptedError):
        Q.upload_analysis_q(spark, SMALL)
    assert len(seen) == cores and max(seen) <= 1.5 * sum(seen) / cores


def test_a_forest_champion_has_forest_drivers(spark):
    std, _, _, _, sp = setup(spark, SMALL)
    sp = sp.checkpoint()
    _, lin = L.linear_forecast(sp, Q.FEATS)
    _, rf = L.rf_forecast(sp, Q.FEATS, {"numTrees": 4, "minInstancesPerNode": 2})
    by = {n: Q.explain(n, std, sp, lin, rf).toPandas() for n in ("LinearRegression", "RandomForest", "NaiveMean")}
    for name, phi in by.items():
        assert set(phi.model) == {name} and len(phi) == len(Q.FEATS) * std.select("ticker").distinct().count()
        one = phi.groupby("ticker").agg(s=("shap_value", "sum"), b=("base_value", "first"), p=("predicted_growth_rate", "first"))
        assert (one.s + one.b).to_numpy() == pytest.approx(one.p.to_numpy(), rel=1e-9, abs=1e-6)
    want = attribution.shapley_forest(rf, fc.future_rows(std, Q.FEATS), Q.FEATS).toPandas()
    key = ["ticker", "feature"]
    assert by["RandomForest"].sort_values(key).shap_value.to_numpy() == pytest.approx(
        want.sort_values(key).shap_value.to_numpy(), abs=1e-9)
    assert (by["NaiveMean"].shap_value == 0).all()


def test_drivers_name_the_model_of_the_forecast(spark):
    best = Q.champion_name(Q.trained_forecast(spark, SMALL)[1])
    for q in (Q.shap_local_q, Q.drivers_sorted_q):
        assert {r[0] for r in q(spark, SMALL).select("model").distinct().collect()} == {best}


def test_fold_fits_equal_least_squares_on_each_folds_rows(spark):
    _, _, _, _, sp = setup(spark, SMALL)
    folds = fc.ts_folds(sp)
    pred = L.linear_fold_predictions(sp, folds, Q.FEATS).toPandas()
    rows, roles = sp.filter("split = 'train'").toPandas(), folds.toPandas()
    assert set(pred.fold) == set(roles.fold)
    for f, own in pred.groupby("fold"):
        dates = roles[roles.fold == f].groupby("role").date.apply(set)
        train, test = (rows[rows.date.isin(dates[r])] for r in ("train", "test"))
        x = train[Q.FEATS].to_numpy()
        m, s = x.mean(0), x.std(0)
        beta = np.linalg.lstsq(np.c_[np.ones(len(x)), (x - m) / s], train.target.to_numpy(), rcond=1e-9)[0]
        test = test.sort_values(["ticker", "date"])
        want = np.c_[np.ones(len(test)), (test[Q.FEATS].to_numpy() - m) / s] @ beta
        own = own.sort_values(["ticker", "date"])
        assert own.predicted.to_numpy() == pytest.approx(want, rel=1e-6, abs=1e-3)


def test_strategies_share_rows_and_scale(spark):
    _, _, _, _, sp = setup(spark, SMALL)
    p = L.strategy_predictions(sp, Q.FEATS).toPandas()
    n = sp.filter("split = 'test'").count()
    assert p.groupby("model").size().to_dict() == {"LinearGrowth": n, "LinearAbsolute": n, "LinearTop5": n}
    one = p[p.model == "LinearGrowth"].set_index(["ticker", "date"]).actual
    for _, g in p.groupby("model"):
        assert (g.set_index(["ticker", "date"]).actual.sort_index() == one.sort_index()).all()
    best = L.top_features(sp, Q.FEATS)
    train = sp.filter("split = 'train'").toPandas()
    corr = train[Q.FEATS].corrwith(train.target).abs().sort_values(ascending=False)
    assert best == list(corr.index[:5])
