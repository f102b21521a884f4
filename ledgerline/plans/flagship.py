"""Flagship query: historical performance ⋈ trend classes ⋈ latest risk level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.finance import risk_level
from ledgerline.operators import performance as perf
from ledgerline.operators import timeseries as ts
from ledgerline.sources.panel import standard_table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ticker.  All three sides are ticker-keyed aggregates of the
    same ticker-bucketed table, so the joins are co-partitioned."""
    std = standard_table(spark, sf_dir)
    hist = perf.historical_performance(std)
    trends = ts.trend_class(std).select("ticker", "revenue_trend", "profit_trend", "growth_trend")
    latest = std.groupBy("ticker").agg(
        F.max_by("debt_to_asset", "date").alias("latest_debt_to_asset"))
    latest = latest.select("ticker", risk_level("latest_debt_to_asset").alias("latest_risk_level"))
    return hist.join(trends, "ticker", "left").join(latest, "ticker", "left")


def _flagship_sql() -> str:
    from ledgerline.plans import report_queries, timeseries_queries  # noqa: F401  (register)
    from ledgerline.plans.registry import ORACLES
    from ledgerline.plans.sqlparts import with_std
    latest = with_std("""select ticker,
  case when d > 0.7 then 'High Risk' when d > 0.4 and d <= 0.7 then 'Medium Risk'
       when d is not null then 'Low Risk' else 'Unknown' end as latest_risk_level
from (select ticker, arg_max(debt_to_asset, date) as d from std group by ticker) x""")
    return f"""select h.*, t.revenue_trend, t.profit_trend, t.growth_trend, l.latest_risk_level
from ({ORACLES['historical_performance']}) h
left join (select ticker, revenue_trend, profit_trend, growth_trend from ({ORACLES['trend_class']}) tc) t
  on h.ticker = t.ticker
left join ({latest}) l on h.ticker = l.ticker"""


def _register() -> None:
    from ledgerline.plans.registry import query

    @query("flagship", _flagship_sql())
    def flagship_q(spark, sf_dir):
        """Flagship: historical performance ⋈ trend classes ⋈ latest risk
        (the entry() query), one row per ticker."""
        return flagship(spark, sf_dir)


_register()
