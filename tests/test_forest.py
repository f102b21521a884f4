"""Forests grown from histograms: brute force, MLlib's results, and the tables that take them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from ledgerline.operators import forecast as fc
from ledgerline.operators import forest as G
from ledgerline.operators import learners as L
from ledgerline.session import shared_dir

FEATS = ["a", "b", "c", "few"]


def made(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 3, n)
    y = 100 + x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0.3, 2, 0) + x[:, 3] + 0.1 * rng.normal(size=n)
    shared_dir(spark)
    return L.assemble(spark.createDataFrame(pd.DataFrame(x, columns=FEATS).assign(target=y)), FEATS)


def test_splits_equal_brute_force():
    rng = np.random.default_rng(1)
    k, least = 3, 2
    for n in (1, 2, 9, 40):
        bins, y, w = rng.integers(0, G.BINS, (n, k)), rng.normal(size=n), rng.integers(1, 3, n).astype(float)
        sums = np.concatenate([*(np.bincount(bins[:, j], v, G.BINS) for v in (w, w * y) for j in range(k)), [(w * y * y).sum()]])
        best, whole = None, ((w * y * y).sum() - (w * y).sum() ** 2 / w.sum()) / w.sum()
        for j in range(k):
            for cut in range(G.BINS - 1):
                left = bins[:, j] <= cut
                if min(w[left].sum(), w[~left].sum()) >= least:
                    rest = sum(w[s] @ (y[s] - np.average(y[s], weights=w[s])) ** 2 for s in (left, ~left)) / w.sum()
                    if best is None or whole - rest > best[0] + 1e-12:
                        best = whole - rest, j, cut
        place, cut, gain, *_ = (v[0] for v in G.splits(sums[None], k, least))
        assert (place, cut) == (best[1:] if best else (-1, cut))
        assert best is None or gain == pytest.approx(best[0])


def test_a_grown_tree_holds_its_bootstrap_rows(spark, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 50)  # several chunks a partition
    seen, chunks_of = [], G.chunks_of
    monkeypatch.setattr(G, "chunks_of", lambda *a: seen.append((chunks_of(*a), *a[1:3])) or seen[0][0])
    df = made(spark, 900)
    model = G.grow(L.forest({"numTrees": 3, "minInstancesPerNode": 2}), df)
    table, cuts, mean = seen[0]
    chunks = [(r["chunk"], np.frombuffer(r["x"], np.uint8).reshape(-1, 4), np.frombuffer(r["y"])) for r in table.collect()]
    assert max(len(y) for _, _, y in chunks) <= 50 and len({c for c, _, _ in chunks}) == len(chunks)
    target = np.sort(np.concatenate([y for _, _, y in chunks]) + mean)
    assert target == pytest.approx(np.sort(df.toPandas().target))  # every row, once
    assert list(cuts[3]) == [0.5, 1.5] and all(len(c) == G.BINS - 1 for c in cuts[:3])

    path = f"{shared_dir(spark)}/grown-test"
    model.write().overwrite().save(path)
    level = G.Level(0, None, None, None, None, 42)
    nodes = {(r.treeID, r.nodeData.id): r.nodeData for r in spark.read.parquet(f"{path}/data").collect()}
    for t in range(3):
        rows = [(x, y, level.counts(t, c, len(y))) for c, x, y in chunks]
        x, y, w = (np.concatenate(v) for v in zip(*rows))
        assert 0.9 < w.mean() < 1.1 and len(np.unique(w)) > 3

        def holds(i, at, depth):
            node = nodes[t, i]
            assert node.rawCount == w[at].sum() and node.prediction == pytest.approx(np.average(y[at], weights=w[at]) + mean)
            if node.leftChild < 0:
                return depth
            f, value = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
            left = at & (x[:, f] <= np.searchsorted(cuts[f], value))
            assert min(w[left].sum(), w[at & ~left].sum()) >= 2 and node.gain > 0
            return max(holds(node.leftChild, left, depth + 1), holds(node.rightChild, at & ~left, depth + 1))
        assert 6 <= holds(0, np.ones(len(y), bool), 0) <= 10


def test_a_grown_forest_predicts_as_well_as_mllibs(spark):
    df, test = made(spark, 6000), made(spark, 2000, seed=5)
    est = L.forest({"numTrees": 30, "minInstancesPerNode": 2})

    def error(model):
        return model.transform(test).agg(F.sqrt(F.avg((F.col("target") - F.col("prediction")) ** 2))).first()[0]
    ours, again, theirs = G.grow(est, df), G.grow(est, df), est.fit(df)
    assert error(ours) <= 1.1 * error(theirs)
    assert error(again) == pytest.approx(error(ours))
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.05)
    assert (ours.getNumTrees, ours.numFeatures, ours.getMaxDepth()) == (30, 4, 10)
    assert max(t.depth for t in ours.trees) <= 10


def test_equal_targets_give_one_leaf_and_missing_ones_are_refused(spark):
    df = made(spark, 500)
    est = L.forest({"numTrees": 2, "minInstancesPerNode": 2})
    model = G.grow(est, df.withColumn("target", F.lit(0.1)))
    assert model.totalNumNodes == 2 and model.transform(df).first()["prediction"] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        G.grow(est, df.withColumn("target", F.when(F.col("a") < 0, F.col("target"))))


def dated(spark):
    """Rows of 30 tickers on 40 dates, split by date."""
    dates = spark.range(1).select(F.sequence(F.to_date(F.lit("2000-03-31")), F.to_date(F.lit("2009-12-31")),
                                             F.expr("interval 3 months")).alias("d"))
    return fc.time_split(made(spark, 1200).withColumn("n", F.monotonically_increasing_id()).crossJoin(dates).select(
        F.concat(F.lit("t"), (F.col("n") % 30).cast("string")).alias("ticker"),
        F.expr("d[int(n % size(d))]").alias("date"), *FEATS, "target").checkpoint())


def no_fit(est, df):
    raise AssertionError("MLlib's fit")


def test_large_tables_do_not_go_through_mllibs_fit(spark, monkeypatch):
    monkeypatch.setattr(RandomForestRegressor, "fit", no_fit)
    sp, params = dated(spark), {"numTrees": 3, "minInstancesPerNode": 2}
    with pytest.raises(AssertionError):
        L.rf_forecast(sp, FEATS, params)
    monkeypatch.setattr(L, "FEW_ROWS", 100)
    pred, model = L.rf_forecast(sp, FEATS, params)
    assert model.getNumTrees == 3 and pred.count() == sp.filter("split = 'test'").count() > 0


def test_all_folds_of_a_large_table_are_grown(spark, monkeypatch):
    monkeypatch.setattr(RandomForestRegressor, "fit", no_fit)
    sp = dated(spark)
    monkeypatch.setattr(L, "FEW_ROWS", 600)  # more than the first fold has
    folds = fc.ts_folds(sp)
    got = L.forest_fold_predictions(sp, folds, FEATS, {"numTrees": 3, "minInstancesPerNode": 2})
    want = sp.filter("split = 'train'").join(folds.filter("role = 'test'"), "date")
    assert got.select("fold").distinct().count() == 5 and got.count() == want.count()
