"""Panel construction queries: ETL, standard/category tables, scalars on rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.finance import risk_level
from ledgerline.functions.numeric import rnd
from ledgerline.operators import clean
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import R, with_std
from ledgerline.sources.panel import (STANDARD_COLUMNS, derive_panel, engineer_features,
                                      standard_table)

_STD_COLS = ", ".join(STANDARD_COLUMNS)

_CATEGORY_SQL = """
  case when revenue_growth > 10 then 'High Growth'
       when revenue_growth > 0 and revenue_growth <= 10 then 'Moderate Growth'
       when revenue_growth is not null then 'Stable'
       when prev_revenue = 0 and revenue > 0 then 'High Growth'
       when prev_revenue = 0 and revenue < 0 then 'Stable'
       else 'Unknown' end"""

_RISK_SQL = """
  case when debt_to_asset > 0.7 then 'High Risk'
       when debt_to_asset > 0.4 and debt_to_asset <= 0.7 then 'Medium Risk'
       when debt_to_asset is not null then 'Low Risk' else 'Unknown' end"""


@query("etl_panel", with_std(f"select {_STD_COLS}, sector from std"))
def etl_panel(spark, sf_dir):
    """K2: line items -> cleaned, engineered standard table (lazy, from raw)."""
    return engineer_features(clean.clean_rows(derive_panel(spark, sf_dir))) \
        .select(*STANDARD_COLUMNS, "sector")


@query("standard_table", with_std(f"select {_STD_COLS} from std"))
def standard_table_q(spark, sf_dir):
    """C20: projection of the stored standard table."""
    return standard_table(spark, sf_dir).select(*STANDARD_COLUMNS)


@query("category_table", with_std(f"""
select ticker, date, sector, {_CATEGORY_SQL} as category, {_RISK_SQL} as risk_level,
  revenue, operating_income, net_income
from (select *, lag(revenue) over (partition by ticker order by date) as prev_revenue from std)"""))
def category_table_q(spark, sf_dir):
    """C20 + C18 + C19: category table over the stored standard table."""
    return clean.category_table(standard_table(spark, sf_dir))


@query("growth", with_std("select ticker, date, revenue_growth, net_income_growth from std"))
def growth_q(spark, sf_dir):
    """Period growth % per ticker (lag over ticker/date) on the
    ticker-bucketed raw panel (no exchange)."""
    from ledgerline.sources.panel import panel
    return engineer_features(panel(spark, sf_dir)).select("ticker", "date", "revenue_growth", "net_income_growth")


@query("ratios", with_std("""select ticker, date, profit_margin, operating_margin,
  asset_efficiency, debt_to_asset from std"""))
def ratios_q(spark, sf_dir):
    """C14: derived ratios with the +1e-9 denominator."""
    return standard_table(spark, sf_dir).select(
        "ticker", "date", "profit_margin", "operating_margin", "asset_efficiency",
        "debt_to_asset")


@query("ratios_null", with_std("""select ticker, date,
  net_income / nullif(revenue, 0) as profit_margin,
  total_liabilities / nullif(total_assets, 0) as debt_ratio,
  operating_income / nullif(revenue, 0) as operating_margin
from std"""))
def ratios_null_q(spark, sf_dir):
    """Dashboard ratios, fraction (not percent), zero denominator -> NULL."""
    return clean.ratios_null(standard_table(spark, sf_dir))


@query("growth_category", with_std(f"""select ticker, date, revenue_growth,
  {_CATEGORY_SQL} as category
from (select *, lag(revenue) over (partition by ticker order by date) as prev_revenue from std)"""))
def growth_category_q(spark, sf_dir):
    """Growth class, including the zero-base rule."""
    return clean.with_category(standard_table(spark, sf_dir)).select(
        "ticker", "date", "revenue_growth", "category")


@query("risk_level", with_std(f"select ticker, date, debt_to_asset, {_RISK_SQL} as risk_level from std"))
def risk_level_q(spark, sf_dir):
    """Risk class from the debt ratio."""
    return standard_table(spark, sf_dir).select(
        "ticker", "date", "debt_to_asset", risk_level("debt_to_asset").alias("risk_level"))


@query("derive_opex", with_std("""select ticker, date,
  greatest(revenue - operating_income, 0) as operating_expenses,
  cast(year(date) as bigint) as fiscal_year from std"""))
def derive_opex_q(spark, sf_dir):
    """Operating expenses floored at 0 and fiscal year."""
    return clean.derive_opex(standard_table(spark, sf_dir)).select(
        "ticker", "date", "operating_expenses", "fiscal_year")


@query("sector_lookup", with_std("""
select d.ticker, d.date, coalesce(m.sector, 'Unknown') as sector
from (select ticker, date from std) d
left join (select distinct s_name as ticker, r_name as sector
           from supplier join nation on s_nationkey = n_nationkey
           join region on n_regionkey = r_regionkey) m on d.ticker = m.ticker"""))
def sector_lookup_q(spark, sf_dir):
    """C17: ticker -> sector from a dimension, default Unknown."""
    from ledgerline.sources.panel import supplier_dim
    return clean.sector_lookup(standard_table(spark, sf_dir).select("ticker", "date"),
                               supplier_dim(spark, sf_dir).select("ticker", "sector"))


@query("filter_company", with_std("""select date, ticker, revenue, net_income from std
where ticker in ('Supplier#000000001', 'Supplier#000000007', 'Supplier#000000042')"""))
def filter_company_q(spark, sf_dir):
    """Company filter (pushed into the scan as an IN predicate)."""
    return clean.filter_companies(
        standard_table(spark, sf_dir),
        ["Supplier#000000001", "Supplier#000000007", "Supplier#000000042"],
    ).select("date", "ticker", "revenue", "net_income")


@query("filter_years", with_std("""select date, ticker, revenue from std
where date between date '1996-01-01' and date '1998-12-31'"""))
def filter_years_q(spark, sf_dir):
    """Year range as date bounds so parquet statistics can prune."""
    return clean.filter_years(standard_table(spark, sf_dir), 1996, 1998) \
        .select("date", "ticker", "revenue")


@query("overview_table", with_std("""select cast(year(date) as bigint) as year, ticker as company,
  revenue, net_income, operating_cashflow as cashflow, profit_margin, debt_to_asset as debt_ratio
from std"""))
def overview_table_q(spark, sf_dir):
    """Overview projection (ordering is presentation-only)."""
    return clean.overview(standard_table(spark, sf_dir))


@query("sanitize", with_std(f"""select ticker, strftime(date, '%Y-%m-%d') as date_text,
  {R('revenue_growth')} as revenue_growth, {R('net_income_growth')} as net_income_growth
from std"""))
def sanitize_q(spark, sf_dir):
    """Dates -> text, NaN/±inf -> NULL on every double column."""
    s = clean.sanitize(standard_table(spark, sf_dir))
    return s.select("ticker", "date_text", rnd("revenue_growth").alias("revenue_growth"),
                    rnd("net_income_growth").alias("net_income_growth"))


@query("clean_rows", with_std("select date, ticker, revenue, net_income from std"))
def clean_rows_q(spark, sf_dir):
    """Drop rows missing date/ticker/revenue/net_income."""
    return clean.clean_rows(standard_table(spark, sf_dir)).select(
        "date", "ticker", "revenue", "net_income")


@query("year_bounds", with_std("""select cast(min(year(date)) as bigint) as min_year,
  cast(max(year(date)) as bigint) as max_year, count(distinct ticker) as num_tickers from std"""))
def year_bounds_q(spark, sf_dir):
    """min/max year and number of tickers for the filter widgets."""
    s = standard_table(spark, sf_dir)
    return s.agg(F.min(F.year("date")).cast("bigint").alias("min_year"),
                 F.max(F.year("date")).cast("bigint").alias("max_year"),
                 F.count_distinct("ticker").alias("num_tickers"))


@query("distinct_companies", with_std("select distinct ticker from std"))
def distinct_companies_q(spark, sf_dir):
    """Distinct tickers."""
    return standard_table(spark, sf_dir).select("ticker").distinct()
