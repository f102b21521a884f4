"""Phase-3 style reports over the standard table (A4-A10)."""

from __future__ import annotations

from ledgerline.operators import performance as perf
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import R, XAVG, XSUM, with_std
from ledgerline.sources.panel import standard_table

_HIST_SQL = with_std(f"""
select ticker, period_start, period_end, num_periods, revenue_start, revenue_end,
  {R('revenue_cagr')} as revenue_cagr, {R('revenue_total_growth')} as revenue_total_growth,
  net_income_start, net_income_end, {R('net_income_cagr')} as net_income_cagr,
  {R('profit_margin_avg')} as profit_margin_avg, {R('profit_margin_last')} as profit_margin_last,
  {R('operating_margin_avg')} as operating_margin_avg,
  {R('operating_margin_trend')} as operating_margin_trend,
  {R('total_cashflow', 6)} as total_cashflow, {R('avg_period_cashflow', 4)} as avg_period_cashflow,
  {R('debt_ratio_start')} as debt_ratio_start, {R('debt_ratio_end')} as debt_ratio_end,
  {R('debt_ratio_start - debt_ratio_end')} as debt_ratio_improvement,
  {R('asset_efficiency_avg')} as asset_efficiency_avg,
  {R('asset_efficiency_trend')} as asset_efficiency_trend,
  case when score >= 5 then 'Excellent' when score >= 2 then 'Good'
       when score >= 0 then 'Moderate' else 'Concerning' end as performance_class
from (
  select *,
    (case when revenue_total_growth > 50 then 3 when revenue_total_growth > 20 then 2
          when revenue_total_growth > 0 then 1 else -1 end)
    + (case when profit_margin_last > 20 then 2 when profit_margin_last > 10 then 1 else 0 end)
    + (case when debt_ratio_start - debt_ratio_end > 0 then 1 else 0 end) as score
  from (
    select *,
      case when revenue_start > 0 and revenue_end > 0
           then (pow(revenue_end / revenue_start, 1.0::double / num_periods) - 1) * 100 end as revenue_cagr,
      (revenue_end - revenue_start) / nullif(revenue_start, 0) * 100 as revenue_total_growth,
      case when net_income_start > 0 and net_income_end > 0
           then (pow(net_income_end / net_income_start, 1.0::double / num_periods) - 1) * 100 end as net_income_cagr
    from (
      select ticker, min(date) as period_start, max(date) as period_end, count(*) as num_periods,
        arg_min(revenue, date) as revenue_start, arg_max(revenue, date) as revenue_end,
        arg_min(net_income, date) as net_income_start, arg_max(net_income, date) as net_income_end,
        avg(profit_margin) as profit_margin_avg, arg_max(profit_margin, date) as profit_margin_last,
        avg(operating_margin) as operating_margin_avg,
        arg_max(operating_margin, date) - arg_min(operating_margin, date) as operating_margin_trend,
        {XSUM('operating_cashflow')} as total_cashflow, {XAVG('operating_cashflow')} as avg_period_cashflow,
        arg_min(debt_to_asset, date) as debt_ratio_start, arg_max(debt_to_asset, date) as debt_ratio_end,
        avg(asset_efficiency) as asset_efficiency_avg,
        arg_max(asset_efficiency, date) - arg_min(asset_efficiency, date) as asset_efficiency_trend
      from std group by ticker) a) b) c""")


@query("historical_performance", _HIST_SQL)
def historical_performance_q(spark, sf_dir):
    """Per-ticker history, CAGR and performance class."""
    return perf.historical_performance(standard_table(spark, sf_dir))


@query("ratio_report", with_std(f"""
select ticker, {R('profit_margin_avg')} as profit_margin_avg, {R('profit_margin_latest')} as profit_margin_latest,
  {R('operating_margin_avg')} as operating_margin_avg, {R('operating_margin_latest')} as operating_margin_latest,
  {R('asset_efficiency_avg')} as asset_efficiency_avg, {R('asset_efficiency_latest')} as asset_efficiency_latest,
  {R('asset_efficiency_latest - ae_first')} as asset_turnover_trend,
  {R('debt_to_asset_avg')} as debt_to_asset_avg, {R('debt_to_asset_latest')} as debt_to_asset_latest,
  {R('da_first - debt_to_asset_latest')} as debt_to_asset_improvement,
  {R('1 - debt_to_asset_latest')} as equity_to_asset_latest,
  {R('total_cashflow', 6)} as total_cashflow, {R('avg_period_cashflow', 4)} as avg_period_cashflow,
  {R('case when total_revenue > 0 then total_cashflow / total_revenue * 100 else 0.0 end')} as cashflow_to_revenue,
  latest_period_cashflow
from (
  select ticker, avg(profit_margin) as profit_margin_avg, arg_max(profit_margin, date) as profit_margin_latest,
    avg(operating_margin) as operating_margin_avg, arg_max(operating_margin, date) as operating_margin_latest,
    avg(asset_efficiency) as asset_efficiency_avg, arg_max(asset_efficiency, date) as asset_efficiency_latest,
    arg_min(asset_efficiency, date) as ae_first,
    avg(debt_to_asset) as debt_to_asset_avg, arg_max(debt_to_asset, date) as debt_to_asset_latest,
    arg_min(debt_to_asset, date) as da_first,
    {XSUM('operating_cashflow')} as total_cashflow, {XSUM('revenue')} as total_revenue,
    {XAVG('operating_cashflow')} as avg_period_cashflow,
    arg_max(operating_cashflow, date) as latest_period_cashflow
  from std group by ticker) a"""))
def ratio_report_q(spark, sf_dir):
    """Ratio report per ticker."""
    return perf.ratio_report(standard_table(spark, sf_dir))


@query("market_trends", with_std(f"""
select cast(count(*) as bigint) as num_companies,
  {R('sum(rev_first)', 4)} as earliest_total_revenue, {R('sum(rev_last)', 4)} as latest_total_revenue,
  {R('(sum(rev_last) - sum(rev_first)) / nullif(sum(rev_first), 0) * 100')} as market_growth_pct,
  {R('(select avg(profit_margin) from std)')} as avg_profit_margin,
  {R('avg(debt_first)')} as avg_debt_ratio_first, {R('avg(debt_last)')} as avg_debt_ratio_last
from (select ticker, cast(arg_min(revenue, date) as decimal(38,6)) as rev_first,
        cast(arg_max(revenue, date) as decimal(38,6)) as rev_last,
        arg_min(debt_to_asset, date) as debt_first, arg_max(debt_to_asset, date) as debt_last
      from std group by ticker) t"""))
def market_trends_q(spark, sf_dir):
    """Market-level growth, margin and leverage summary."""
    return perf.market_trends(standard_table(spark, sf_dir))


@query("company_trends", with_std(f"""
select ticker, revenue_first, revenue_last, {R('revenue_last / nullif(revenue_first, 0)')} as revenue_multiple,
  {R('profit_margin_first')} as profit_margin_first, {R('profit_margin_last')} as profit_margin_last,
  {R('case when debt_first > debt_last then (debt_first - debt_last) / debt_first * 100 end')} as debt_reduction_pct,
  {R('avg_revenue_growth')} as avg_revenue_growth, {R('revenue_growth_volatility')} as revenue_growth_volatility
from (select ticker, arg_min(revenue, date) as revenue_first, arg_max(revenue, date) as revenue_last,
        arg_min(profit_margin, date) as profit_margin_first, arg_max(profit_margin, date) as profit_margin_last,
        arg_min(debt_to_asset, date) as debt_first, arg_max(debt_to_asset, date) as debt_last,
        avg(revenue_growth) as avg_revenue_growth, stddev_pop(revenue_growth) as revenue_growth_volatility
      from std group by ticker) t"""))
def company_trends_q(spark, sf_dir):
    """A10: per-company insight measures."""
    return perf.company_trends(standard_table(spark, sf_dir))
