"""Time-series queries."""

from __future__ import annotations

from ledgerline.operators import timeseries as ts
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import R, with_std
from ledgerline.sources.panel import standard_table


def _long(metrics: tuple[str, ...]) -> str:
    exprs = {
        "revenue": "revenue", "net_income": "net_income", "profit_margin": "profit_margin",
        "operating_expenses": "greatest(revenue - operating_income, 0)",
    }
    parts = [f"select ticker, date, idx, '{m}' as metric, coalesce({exprs[m]}, 0) as value from ix"
             for m in metrics]
    return ("ix as (select *, row_number() over (partition by ticker order by date) - 1 as idx from std),\n"
            "lf as (" + "\n union all ".join(parts) + ")")


def _label(s, m, n):
    pct = f"({s}) / nullif({m}, 0) * 100"
    return f"""case when {n} < 2 then 'Insufficient Data' when {m} = 0 then 'Neutral'
      when {pct} > 5 then 'Strong Increase' when {pct} > 1 then 'Moderate Increase'
      when {pct} > -1 then 'Stable' when {pct} > -5 then 'Moderate Decrease'
      else 'Strong Decrease' end"""


@query("trend_class", with_std(f"""
select ticker, {_label('rs', 'rm', 'rn')} as revenue_trend, {_label('ps', 'pm', 'pn')} as profit_trend,
  {_label('gs', 'gm', 'gn')} as growth_trend, cast(year(latest_date) as bigint) as latest_year,
  revenue_latest, profit_latest
from (
  select ticker, count(*) as n, regr_slope(revenue, idx) as rs, avg(revenue) as rm, count(revenue) as rn,
    regr_slope(net_income, idx) as ps, avg(net_income) as pm, count(net_income) as pn,
    regr_slope(revenue_growth, gidx) as gs, avg(revenue_growth) as gm, count(revenue_growth) as gn,
    max(date) as latest_date, arg_max(revenue, date) as revenue_latest, arg_max(net_income, date) as profit_latest
  from (select *, row_number() over (partition by ticker order by date) - 1 as idx,
          count(revenue_growth) over (partition by ticker order by date rows between unbounded preceding and current row) - 1 as gidx
        from std) x
  group by ticker) g
where n >= 2"""))
def trend_class_q(spark, sf_dir):
    """Trend classes from OLS slope as % of mean."""
    return ts.trend_class(standard_table(spark, sf_dir))


def _decomp_sql(body: str) -> str:
    return with_std("", _long(ts.DECOMPOSE_METRICS), """
fit as (
  select *, count(*) over (partition by ticker, metric) as n,
    regr_slope(value, idx) over (partition by ticker, metric) as slope,
    regr_intercept(value, idx) over (partition by ticker, metric) as intercept
  from lf)""", """
tr as (
  select *, intercept + slope * idx as trend, least(4, cast(floor(n / 2) as integer)) as period
  from fit where n >= 3)""", """
se as (
  select *, case when period > 1 then avg(value - trend) over (partition by ticker, metric, idx % period)
                 else 0.0 end as seasonal
  from tr)""", """
dd as (select *, value - trend - seasonal as residual from se)""") + body


@query("decompose", _decomp_sql(f"""
select ticker, metric, date, cast(idx as bigint) as idx, value, {R('trend', 2)} as trend,
  {R('seasonal', 2)} as seasonal, {R('residual', 2)} as residual from dd"""))
def decompose_q(spark, sf_dir):
    """T2 + W10: trend / cyclic seasonal / residual per row."""
    return ts.decompose_rows(standard_table(spark, sf_dir))


@query("decompose_strength", _decomp_sql(f"""
select ticker, metric, cast(count(*) as bigint) as n,
  {R('case when var_pop(trend + residual) > 0 then 1 - var_pop(residual) / var_pop(trend + residual) else 0.0 end', 4)} as trend_strength,
  {R('case when var_pop(seasonal + residual) > 0 then 1 - var_pop(residual) / var_pop(seasonal + residual) else 0.0 end', 4)} as seasonal_strength
from dd group by ticker, metric"""))
def decompose_strength_q(spark, sf_dir):
    """Trend and seasonal strength per (ticker, metric)."""
    return ts.decompose_strength(standard_table(spark, sf_dir))


@query("seasonality", with_std(f"""
select ticker, metric,
  case when overall_std > 0 then coalesce(vol, 0) > overall_std * 0.5 else false end as is_seasonal,
  {R('coalesce(vol, 0)', 4)} as volatility, {R('overall_std', 4)} as overall_std,
  {R('coalesce(vol, 0) / (overall_std + 1e-10)', 6)} as pattern_strength
from (
  select ticker, metric, any_value(n) as n,
    avg(case when idx < n - 4 then roll_std end) as vol, stddev_pop(value) as overall_std
  from (select *, count(*) over (partition by ticker, metric) as n,
          stddev_pop(value) over (partition by ticker, metric order by idx rows between current row and 3 following) as roll_std
        from lf) x
  group by ticker, metric) g
where n >= 4""", _long(ts.SEASONALITY_METRICS)))
def seasonality_q(spark, sf_dir):
    """T3 + W9: rolling-σ seasonality check (period 4)."""
    return ts.seasonality(standard_table(spark, sf_dir))


@query("growth_periods", with_std(f"""
select ticker, date, prev_date, {R('(r - p) / (p + 1e-10) * 100')} as yoy_growth_pct,
  case when abs(r) < 1e-10 then 'No data' when (r - p) / (p + 1e-10) * 100 > 10 then 'Strong growth'
       when (r - p) / (p + 1e-10) * 100 > 0 then 'Moderate growth'
       when (r - p) / (p + 1e-10) * 100 > -5 then 'Stable/slight decline'
       else 'Significant decline' end as period_type
from (select ticker, date, coalesce(revenue, 0) as r,
        lag(date) over (partition by ticker order by date) as prev_date,
        lag(coalesce(revenue, 0)) over (partition by ticker order by date) as p from std) x
where prev_date is not null"""))
def growth_periods_q(spark, sf_dir):
    """Growth periods with labels."""
    return ts.growth_periods(standard_table(spark, sf_dir))


@query("trend_slopes", with_std(f"""
select ticker, metric, {R('regr_slope(value, idx)', 4)} as slope, {R('regr_intercept(value, idx)', 4)} as intercept,
  case when regr_slope(value, idx) > 0 then 'increasing' else 'decreasing' end as slope_interpretation,
  {R('regr_r2(value, idx)', 6)} as r_squared
from lf group by ticker, metric having count(*) >= 2""", _long(ts.SLOPE_METRICS)))
def trend_slopes_q(spark, sf_dir):
    """T5: slope / intercept / R² / direction per metric."""
    return ts.trend_slopes(standard_table(spark, sf_dir))
