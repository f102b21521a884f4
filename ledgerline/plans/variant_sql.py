"""DuckDB twins of ``sources.variants`` (same fixed rules, stated in SQL)."""

from __future__ import annotations

from ledgerline.sources.panel import MEASURES

TN = "cast(right(ticker, 9) as bigint)"
QN = "(year(date) * 4 + quarter(date))"


def _pm(expr: str, m: int) -> str:
    return f"((({expr}) % {m} + {m}) % {m})"


def nulls_cte(src: str = "panel", name: str = "pn") -> str:
    cols = ", ".join(
        f"case when {_pm(f'{TN} * 7 + {QN} + {3 * i}', 13)} = 0 then null else {m} end as {m}"
        for i, m in enumerate(MEASURES))
    return f"{name} as (select * replace ({cols}) from {src})"


def engineered_cte(src: str, name: str) -> str:
    return f"""{name} as (
  select *, net_income / (revenue + 1e-9) * 100 as profit_margin,
    operating_income / (revenue + 1e-9) * 100 as operating_margin,
    (revenue / nullif(lag(revenue) over (partition by ticker order by date), 0) - 1) * 100 as revenue_growth,
    (net_income / nullif(lag(net_income) over (partition by ticker order by date), 0) - 1) * 100 as net_income_growth,
    revenue / (total_assets + 1e-9) as asset_efficiency,
    total_liabilities / (total_assets + 1e-9) as debt_to_asset
  from {src})"""


def zero_base_cte(src: str = "panel", name: str = "pz") -> str:
    return f"""{name} as (select * replace (
    case when {_pm(TN, 10)} = 0 and row_number() over (partition by ticker order by date) = 7
         then 0.0 else net_income end as net_income) from {src})"""


def users_cte(src: str = "panel", name: str = "pu") -> str:
    return f"""{name} as (select *, case {_pm(TN, 3)} when 0 then 'predefined' when 1 then 'u1' else 'u2' end
    as user_id from {src})"""


def dup_cte(src: str = "panel", name: str = "pd2") -> str:
    return f"""{name} as (
  select *, 1 as load_seq from {src}
  union all
  select * replace (revenue * 1.01 as revenue), 2 as load_seq from {src} where {_pm(TN, 9)} = 0)"""


def messy_cte(src: str = "panel", name: str = "mu") -> str:
    k = "cast(floor(revenue / 1000) as bigint)"
    money = f"""case {_pm(TN, 4)}
      when 0 then '$' || format('{{:,}}', cast(floor(revenue) as bigint))
      when 1 then '(' || cast(cast(floor(revenue) as bigint) as varchar) || ')'
      when 2 then cast({k} as varchar) || 'K'
      else cast(cast({k} // 1000 as bigint) as varchar) || '.' || lpad(cast({_pm(k, 1000)} as varchar), 3, '0') || 'M' end"""
    period = f"""case {_pm(TN, 3)}
      when 0 then strftime(date, '%Y-%m-%d')
      when 1 then cast(year(date) as varchar) || 'Q' || cast(quarter(date) as varchar)
      else 'Q' || cast(quarter(date) as varchar) || '-' || cast(year(date) as varchar) end"""
    sym = f"""case when {_pm(TN, 7)} = 0 then '' when {_pm(TN, 11)} = 0 then 'nan'
      when {_pm(TN, 5)} = 0 then '  ' || lower(ticker) || ' ' else ticker end"""

    def i(c):
        return f"cast(cast(floor({c}) as bigint) as varchar)"
    return f"""{name} as (
  select {TN} as upload_id, cast(row_number() over (partition by ticker order by date) as bigint) as row_pos,
    ticker as true_ticker, {sym} as "Symbol", {period} as "Period", {money} as "Total Revenue",
    {i('net_income')} as "Net Profit", {i('operating_income')} as "Operating Profit",
    {i('total_assets')} as "Total Assets", {i('total_liabilities')} as "Total Liabilities",
    case when {_pm(f'{TN} * 7 + {QN}', 13)} = 0 then 'none' else {i('operating_cashflow')} end
      as "Cash From Operations"
  from {src})"""
