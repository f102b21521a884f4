"""Peer, latest-row and anomaly queries."""

from __future__ import annotations

from ledgerline.operators import insights, peers
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import R, with_std
from ledgerline.sources.panel import standard_table

LATEST = """
lt as (select * exclude (rn) from (
  select *, row_number() over (partition by ticker order by date desc) as rn from std) where rn = 1)"""


@query("latest_row", with_std("select * from lt", LATEST))
def latest_row_q(spark, sf_dir):
    """Latest row per ticker."""
    return peers.latest_row(standard_table(spark, sf_dir))


@query("first_last", with_std("""
select ticker, min(date) as first_date, max(date) as last_date,
  arg_min(revenue, date) as first_revenue, arg_max(revenue, date) as last_revenue,
  arg_min(net_income, date) as first_net_income, arg_max(net_income, date) as last_net_income
from std group by ticker"""))
def first_last_q(spark, sf_dir):
    """First / last values per ticker."""
    return peers.first_last(standard_table(spark, sf_dir))


@query("peer_comparison", with_std(f"""
select arg_max(ticker, (profit_margin, ticker)) filter (profit_margin is not null) as profitability_leader,
  {R('min(profit_margin)')} as profit_margin_min, {R('max(profit_margin)')} as profit_margin_max,
  {R('min(operating_margin)')} as operating_margin_min, {R('max(operating_margin)')} as operating_margin_max,
  arg_max(ticker, (avg_revenue_growth, ticker)) filter (avg_revenue_growth is not null) as growth_leader, {R('max(avg_revenue_growth)')} as growth_leader_rate,
  arg_max(ticker, (asset_efficiency, ticker)) filter (asset_efficiency is not null) as efficiency_leader,
  {R('min(asset_efficiency)')} as asset_efficiency_min, {R('max(asset_efficiency)')} as asset_efficiency_max,
  arg_min(ticker, (debt_to_asset, ticker)) filter (debt_to_asset is not null) as lowest_debt,
  {R('min(debt_to_asset)')} as debt_ratio_min, {R('max(debt_to_asset)')} as debt_ratio_max,
  count(*) as num_companies
from lt join (select ticker, avg(revenue_growth) as avg_revenue_growth from std group by ticker) g
  using (ticker)""", LATEST))
def peer_comparison_q(spark, sf_dir):
    """Leaders and ranges across companies."""
    return peers.peer_comparison(standard_table(spark, sf_dir))


def _rank(c):
    return (f"cast(floor(rank() over (order by {c} desc) + "
            f"(count(*) over (partition by {c}) - 1) / 2.0) as bigint) as {c}_rank")


@query("peer_rankings", with_std(f"""
select company, profit_margin, asset_efficiency, financial_health,
  {_rank('profit_margin')}, {_rank('asset_efficiency')}, {_rank('financial_health')}
from (select ticker as company, profit_margin, asset_efficiency, 1 - debt_to_asset as financial_health
      from lt) t""", LATEST))
def peer_rankings_q(spark, sf_dir):
    """Average-tie ranks over all tickers, truncated."""
    return peers.peer_rankings(standard_table(spark, sf_dir))


_DROPS = """
drops as (
  select ticker, from_date, to_date, change,
    printf('%s (FY %d): Profit margin dropped %.2f%% - investigate profitability decline',
           ticker, year(to_date), change) as message
  from (select ticker, lag(date) over w as from_date, date as to_date,
          profit_margin - lag(profit_margin) over w as change
        from std window w as (partition by ticker order by date)) x
  where change < -5)"""

_EFF = """
eff as (
  select ticker, date, asset_efficiency as recent_efficiency, historical_avg,
    printf('%s: Asset efficiency degraded to %.2fx (below historical avg %.2fx)',
           ticker, asset_efficiency, historical_avg) as message
  from (select ticker, date, asset_efficiency,
          avg(asset_efficiency) over (partition by ticker order by date
                                      rows between unbounded preceding and 1 preceding) as historical_avg,
          row_number() over (partition by ticker order by date desc) as rn
        from std) x
  where rn = 1 and asset_efficiency < historical_avg * 0.8)"""

_ANOM = """
per as (select ticker, count(*) filter (where net_income < 0) as neg, max(date) as last_date,
          arg_max(debt_to_asset, date) as latest_debt from std group by ticker),
anom as (
  select ticker, 'margin_drop' as kind, to_date as date, change as value, message from drops
  union all
  select ticker, 'negative_income', last_date, cast(neg as double),
    printf('%s showed negative net income in %d years', ticker, neg) from per where neg > 0
  union all
  select ticker, 'efficiency_degradation', date, recent_efficiency, message from eff
  union all
  select ticker, 'high_debt', last_date, latest_debt,
    printf('%s: High debt-to-assets ratio (%.2f) - potential financial risk', ticker, latest_debt)
  from per where latest_debt > 0.7)"""


@query("margin_drops", with_std("select * from drops", _DROPS))
def margin_drops_q(spark, sf_dir):
    """Profit-margin drops of more than 5 points."""
    return insights.margin_drops(standard_table(spark, sf_dir))


@query("efficiency_degradation", with_std("select * from eff", _EFF))
def efficiency_degradation_q(spark, sf_dir):
    """Latest efficiency under 80% of the earlier mean."""
    return insights.efficiency_degradation(standard_table(spark, sf_dir))


@query("anomalies", with_std("select * from anom", _DROPS, _EFF, _ANOM))
def anomalies_q(spark, sf_dir):
    """All anomaly kinds unioned."""
    return insights.anomalies(standard_table(spark, sf_dir))


_LINES = """
pt as (select ticker, arg_min(revenue, date) as rf, arg_max(revenue, date) as rl,
         arg_min(profit_margin, date) as pf, arg_max(profit_margin, date) as pl,
         arg_min(debt_to_asset, date) as df, arg_max(debt_to_asset, date) as dl,
         avg(revenue_growth) as ga, stddev_pop(revenue_growth) as gs,
         min(date) as d0, max(date) as d1 from std group by ticker),
mk as (select sum(rf) as rf, sum(rl) as rl, avg(df) as df, avg(dl) as dl, min(d0) as d0, max(d1) as d1,
         (select avg(profit_margin) from std) as pm from pt),
lines as (
  select 1 as section, '' as ticker, 1 as item,
    printf('Total market revenue grew %.1f%% from %d to %d', (rl - rf) / rf * 100, year(d0), year(d1)) as message from mk
  union all select 1, '', 2, printf('Average profit margin across all companies: %.2f%%', pm) from mk
  union all select 1, '', 3, printf('Average debt ratio moved from %.2f to %.2f', df, dl) from mk
  union all select 2, ticker, 1, printf('%s: Revenue grew %.1fx ($%.1fB → $%.1fB)', ticker, rl / rf, rf / 1e9, rl / 1e9) from pt
  union all select 2, ticker, 2, printf('%s: Profit margin at %.2f%% (from %.2f%%)', ticker, pl, pf) from pt
  union all select 2, ticker, 3, printf('%s: Reduced debt-to-assets by %.1f%% (stronger balance sheet)', ticker, (df - dl) / df * 100) from pt where df > dl
  union all select 2, ticker, 4, printf('%s: Average revenue growth %.1f%% (volatility: %.1f%%)', ticker, ga, gs) from pt where ga is not null
  union all select 3, ticker,
    (case kind when 'margin_drop' then 1 when 'negative_income' then 2 when 'efficiency_degradation' then 3 else 4 end) * 100000
      + coalesce(date_diff('day', date '1900-01-01', date), 0) % 100000, message from anom)"""


@query("insights_report", with_std("""
select section, ticker, item, message,
  row_number() over (order by section, ticker, item) as line_no from lines""",
                                  _DROPS, _EFF, _ANOM, _LINES))
def insights_report_q(spark, sf_dir):
    """Market ∪ company ∪ anomaly lines, numbered."""
    return insights.insights_report(standard_table(spark, sf_dir))
