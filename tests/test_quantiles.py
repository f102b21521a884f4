"""Bracketed quantiles and correlation by null pattern against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from ledgerline.operators import profile

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def values():
    rng = np.random.default_rng(5)
    n = 20_000
    return {"normal": rng.normal(size=n), "hot": np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)),
            "few": rng.integers(0, 3, n).astype(float), "constant": np.full(n, 7.0), "one": np.array([3.5]),
            "two": np.array([1.0, 2.0]), "skewed": np.exp(rng.normal(size=n) * 4)}


def long_frame(spark, data):
    pdf = pd.concat([pd.DataFrame({"feature": k, "value": v}) for k, v in data.items()])
    return spark.createDataFrame(pdf).repartition(6)


def check(spark, data):
    got = {(r.feature, r.p): r.q for r in profile.grouped_quantiles(long_frame(spark, data), "feature", "value", PROBS).collect()}
    assert len(got) == len(data) * len(PROBS)
    for k, v in data.items():
        for p in PROBS:
            assert got[k, p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12), (k, p)


def test_quantiles_are_exact(spark):
    check(spark, values())


def test_wide_brackets_are_sketched_again(spark, monkeypatch):
    monkeypatch.setattr(profile, "HELD", 20)
    check(spark, values())


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(profile, "SKETCH_K", 8)
    monkeypatch.setattr(profile, "SLACK", 1e-6)
    check(spark, values())


def test_quantiles_of_nothing(spark):
    empty = long_frame(spark, {"x": np.array([1.0])}).limit(0)
    assert profile.grouped_quantiles(empty, "feature", "value", [0.5]).count() == 0


def test_correlation_is_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(500, 5)) * [1, 1e6, 1, 1, 1] + [0, 1e7, 5, 0, 0], columns=list("abcde"))
    pdf["b"] += pdf["a"] * 1e6
    pdf["d"] = 4.25  # no variance
    pdf.loc[rng.random(500) < 0.3, "a"] = np.nan
    pdf.loc[rng.random(500) < 0.4, "c"] = np.nan
    pdf["e"] = np.where(pdf["a"].isna(), pdf["e"], np.nan)  # never beside `a`
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, c double, d double, e double")
    got = {(r.feature_1, r.feature_2): r.correlation for r in profile.correlation_matrix(df, list("abcde")).collect()}
    assert len(got) == 25
    for (x, y), r in got.items():
        want = 1.0 if x == y else pdf[[x, y]].dropna()[x].corr(pdf[[x, y]].dropna()[y]) if x != y else 1.0
        if x != y and ("d" in (x, y) or {x, y} == {"a", "e"}):
            assert r is None
        else:
            assert r == pytest.approx(want, abs=1e-6)
