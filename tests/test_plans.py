"""Plan-shape guards: per-ticker work on the ticker-bucketed standard table
must not shuffle, filters must reach the scan, scans must prune columns."""

from __future__ import annotations

import re

import pytest

from ledgerline.plans.registry import queries
from tests.conftest import SMALL

QS = queries()


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()   # run, so AQE settles the plan
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _shuffles(plan: str) -> int:
    return len(re.findall(r"(?m)^\(\d+\) (?:Exchange|ShuffleQueryStage)", plan))


@pytest.mark.parametrize("name", ["historical_performance", "trend_class", "category_table",
                                  "growth_periods", "latest_row", "decompose_strength",
                                  "seasonality", "trend_slopes", "anomalies", "flagship", "growth"])
def test_per_ticker_queries_do_not_shuffle(spark, name):
    plan = _plan(QS[name](spark, SMALL))
    assert "Bucketed: true" in plan
    assert _shuffles(plan) == 0, plan


def test_year_filter_reaches_the_scan(spark):
    plan = _plan(QS["filter_years"](spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(date", plan)


def test_scans_prune_columns(spark):
    plan = _plan(QS["etl_panel"](spark, SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    lineitem = [s for s in schemas if "l_partkey" in s]
    assert lineitem and "l_orderkey" not in lineitem[0] and "l_linenumber" not in lineitem[0]
