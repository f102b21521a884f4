"""DuckDB SQL fragments for the oracle side of every registered query.

The oracle must be an independent statement of the same semantics, so each
query's SQL is written by hand on top of these common table expressions
(the derived panel and the engineered standard table, exactly as specified
in FIXTURES.md).
"""

from __future__ import annotations


def R(expr: str, k: int = 6) -> str:
    """Engine-independent rounding, twin of functions.numeric.rnd (Spark's
    rounding never yields -0.0, so negative zero is normalised here too)."""
    r = f"(round(({expr}) * 1e{k}) / 1e{k})"
    return f"(case when {r} = 0 then 0.0 else {r} end)"


def XSUM(expr: str) -> str:
    return f"cast(sum(cast(({expr}) as decimal(38,6))) as double)"


def XAVG(expr: str) -> str:
    return f"({XSUM(expr)} / nullif(count({expr}), 0))"


PANEL = """
pg as (
  select s_name as ticker, r_name as sector,
    last_day(date_trunc('quarter', l_shipdate) + interval 2 month) as date,
    sum(cast(l_extendedprice as decimal(14,2))) as ext,
    sum(cast(l_extendedprice as decimal(14,2)) * (1 - cast(l_discount as decimal(4,2)))) as rev,
    sum(cast(l_extendedprice as decimal(14,2)) * cast(l_tax as decimal(4,2))) as tax,
    sum(cast(l_quantity as decimal(8,2)) * cast(p_retailprice as decimal(10,2))) as cost,
    sum(case when l_returnflag = 'R' then cast(l_extendedprice as decimal(14,2)) else 0 end) as ret
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey
  group by 1, 2, 3),
panel as (
  select ticker, sector, date, cast(rev as double) as revenue,
    cast(rev - cost * cast(1.7 as decimal(3,1)) as double) as operating_income,
    cast(rev - cost * cast(1.7 as decimal(3,1)) - tax as double) as net_income,
    cast(ext * 2 as double) as total_assets,
    cast(ext * cast(0.4 as decimal(2,1)) + ret * 3 as double) as total_liabilities,
    cast(rev - ret * 2 as double) as operating_cashflow
  from pg)"""

STD = """
std as (
  select date, ticker, revenue, operating_income, net_income, operating_cashflow,
    total_assets, total_liabilities,
    net_income / (revenue + 1e-9) * 100 as profit_margin,
    operating_income / (revenue + 1e-9) * 100 as operating_margin,
    (revenue / nullif(lag(revenue) over (partition by ticker order by date), 0) - 1) * 100 as revenue_growth,
    (net_income / nullif(lag(net_income) over (partition by ticker order by date), 0) - 1) * 100 as net_income_growth,
    revenue / (total_assets + 1e-9) as asset_efficiency,
    total_liabilities / (total_assets + 1e-9) as debt_to_asset,
    sector
  from panel)"""


def with_std(body: str, *extra_ctes: str) -> str:
    """``WITH pg, panel, std[, extra...] <body>``."""
    ctes = [PANEL.strip(), STD.strip(), *[c.strip() for c in extra_ctes]]
    return "with " + ",\n".join(ctes) + "\n" + body


def with_panel(body: str, *extra_ctes: str) -> str:
    ctes = [PANEL.strip(), *[c.strip() for c in extra_ctes]]
    return "with " + ",\n".join(ctes) + "\n" + body


def RS(expr: str, digits: int = 10) -> str:
    """Significant-digit rounding, twin of functions.numeric.rnd_sig."""
    x = f"({expr})"
    k = f"({digits - 1} - floor(log10(abs({x}))))"
    s = f"pow(10.0, abs({k}))"
    return (f"(case when {x} is null then {x} when {x} = 0 then 0.0 when {k} >= 0 then round({x} * {s}) / {s}"
            f" else round({x} / {s}) * {s} end)")
