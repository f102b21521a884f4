"""Dashboard aggregates and upload-path builders (A1-A3, C4, C22, C23, C38,
S5, S10, F6, F7, W19)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import parsing as P
from ledgerline.functions.finance import growth_category, risk_level
from ledgerline.functions.numeric import exact_sum, rnd
from ledgerline.operators import clean, ingest
from ledgerline.operators import forecast as fc
from ledgerline.plans.ingest_queries import MU, _norm_cols_sql, normalized, sql_clean_ticker, sql_period
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import R, XSUM, with_panel, with_std
from ledgerline.sources import variants
from ledgerline.sources.panel import EPS, MEASURES, panel, standard_table

PAIRS = (("revenue", "operating_expenses"), ("total_assets", "total_liabilities"),
         ("operating_cashflow", "net_income"))


def dashboard(spark, sf_dir):
    """Filtered dashboard frame (all tickers, all years) with fractional
    ratios and operating expenses."""
    s = clean.derive_opex(standard_table(spark, sf_dir))
    return s.withColumns({
        "profit_margin": F.col("net_income") / F.nullif("revenue", F.lit(0.0)),
        "debt_ratio": F.col("total_liabilities") / F.nullif("total_assets", F.lit(0.0))})


@query("kpi_totals", with_std(f"""
select {R(XSUM('revenue'), 6)} as total_revenue, {R(XSUM('net_income'), 6)} as total_net_income,
  {R('avg(net_income / nullif(revenue, 0))', 8)} as avg_profit_margin,
  {R('avg(total_liabilities / nullif(total_assets, 0))', 8)} as avg_debt_ratio from std"""))
def kpi_totals_q(spark, sf_dir):
    """A1: Σ revenue, Σ net income, mean margin, mean debt ratio (NULLs skipped)."""
    d = dashboard(spark, sf_dir)
    return d.agg(rnd(exact_sum("revenue"), 6).alias("total_revenue"),
                 rnd(exact_sum("net_income"), 6).alias("total_net_income"),
                 rnd(F.avg("profit_margin"), 8).alias("avg_profit_margin"),
                 rnd(F.avg("debt_ratio"), 8).alias("avg_debt_ratio"))


def _sums(d):
    cols = sorted({c for p in PAIRS for c in p})
    return d.groupBy("ticker").agg(*[rnd(exact_sum(c), 6).alias(c) for c in cols])


_SUMS_SQL = ", ".join(f"{R(XSUM(e), 6)} as {c}" for c, e in sorted(
    {"revenue": "revenue", "operating_expenses": "greatest(revenue - operating_income, 0)",
     "total_assets": "total_assets", "total_liabilities": "total_liabilities",
     "operating_cashflow": "operating_cashflow", "net_income": "net_income"}.items()))


@query("sum_by_ticker", with_std(f"select ticker, {_SUMS_SQL} from std group by ticker"))
def sum_by_ticker_q(spark, sf_dir):
    """A2: per-ticker sums of the three metric pairs."""
    return _sums(dashboard(spark, sf_dir))


@query("unpivot_metrics", with_std(f"""
select ticker, metric, value from (select ticker, {_SUMS_SQL} from std group by ticker) s
unpivot (value for metric in (revenue, operating_expenses, total_assets, total_liabilities,
                              operating_cashflow, net_income))"""))
def unpivot_metrics_q(spark, sf_dir):
    """A3: melt the wide sums to (ticker, metric, value)."""
    s = _sums(dashboard(spark, sf_dir))
    cols = [c for c in s.columns if c != "ticker"]
    return s.unpivot(["ticker"], cols, "metric", "value")


@query("scan_panel", with_std("select ticker, date, revenue, net_income, total_assets from std"))
def scan_panel_q(spark, sf_dir):
    """Table scan with date coercion (order only where consumed)."""
    s = standard_table(spark, sf_dir)
    return s.select("ticker", F.to_date("date").alias("date"), "revenue", "net_income", "total_assets")


@query("metric_series", with_panel(f"""
select upper(true_ticker) as ticker, {sql_period('"Period"')} as date,
  try_cast(regexp_replace("Net Profit", '^\\s+|\\s+$', '', 'g') as double) as value
from mu where {sql_period('"Period"')} is not null""", MU))
def metric_series_q(spark, sf_dir):
    """An upload's metric over time — coerce dates, drop bad ones."""
    m = variants.messy_upload(panel(spark, sf_dir))
    d = m.select(F.upper("true_ticker").alias("ticker"), P.parse_period_date("Period").alias("date"),
                 P.strip_ws("Net Profit").try_cast("double").alias("value"))
    return d.filter(F.col("date").isNotNull())


_FREQ = """
g as (select ticker, date_diff('day', lag(date) over (partition by ticker order by date), date) as gap from std),
f as (select t.ticker, case when m.md is null then 1.0 when m.md <= 2 then 365.0 when m.md <= 8 then 52.0
              when m.md <= 16 then 24.0 when m.md <= 45 then 12.0 when m.md <= 120 then 4.0
              when m.md <= 240 then 2.0 else 1.0 end as ppy
      from (select distinct ticker from std) t
      left join (select ticker, quantile_cont(gap, 0.5) as md from g where gap is not null group by ticker) m
        on t.ticker = m.ticker)"""


@query("period_label", with_std("""select ticker, case when round(ppy) >= 300 then 'daily'
  when round(ppy) >= 48 then 'weekly' when round(ppy) >= 10 then 'monthly' when round(ppy) >= 3 then 'quarterly'
  else 'yearly' end as period_type from f""", _FREQ))
def period_label_q(spark, sf_dir):
    """period label from the inferred frequency."""
    return fc.infer_frequency(standard_table(spark, sf_dir)).select("ticker", "period_type")


@query("horizon", with_std("""select ticker, h as horizon, greatest(1.0, ppy / greatest(1, h)) as effective_periods_per_year
from (select *, case when ppy >= 300 then 30 when ppy >= 48 then 4 when ppy >= 10 then 3 else 1 end as h from f) x""",
                           _FREQ))
def horizon_q(spark, sf_dir):
    """forecast horizon and effective periods per year."""
    return fc.infer_frequency(standard_table(spark, sf_dir)) \
        .select("ticker", "horizon", "effective_periods_per_year")


@query("alias_map", with_panel("""select upload_id, row_pos, true_ticker, "Symbol" as ticker, "Period" as date,
  "Total Revenue" as revenue, "Net Profit" as net_income, "Operating Profit" as operating_income,
  "Total Assets" as total_assets, "Total Liabilities" as total_liabilities,
  "Cash From Operations" as operating_cashflow from mu""", MU))
def alias_map_q(spark, sf_dir):
    """C4: canonical names for header variants (first match wins, only when
    the canonical name is absent)."""
    m = variants.messy_upload(panel(spark, sf_dir))
    return ingest.alias_map(ingest.normalize_headers(m))


# ------------------------------------------------------------ direct build

def direct_upload(spark, sf_dir):
    """A tabular upload already in the direct schema (display values kept)."""
    m = variants.messy_upload(panel(spark, sf_dir))
    return m.select("upload_id", "row_pos", "true_ticker", F.col("Period").alias("date"),
                    F.col("Symbol").alias("ticker"), F.col("Total Revenue").alias("revenue"),
                    F.col("Operating Profit").alias("operating_income"),
                    F.col("Net Profit").alias("net_income"), F.col("Total Assets").alias("total_assets"),
                    F.col("Total Liabilities").alias("total_liabilities"),
                    F.col("Cash From Operations").alias("operating_cashflow"))


def direct_build(df):
    """Coerce (plain numeric parse), clean + fill ticker with the upload
    parameter, growth per ticker in date order (NULL dates last), labels;
    sector Unknown."""
    d = df.select(P.parse_period_date("date").alias("date"),
                  F.coalesce(P.clean_ticker("ticker"), F.col("true_ticker")).alias("ticker"),
                  *[P.strip_ws(m).try_cast("double").alias(m) for m in MEASURES])
    w = Window.partitionBy("ticker").orderBy(F.col("date").asc_nulls_last())
    prev = F.lag("revenue").over(w)
    d = d.withColumns({"revenue_growth": (F.col("revenue") / F.nullif(prev, F.lit(0.0)) - 1) * 100,
                       "debt_to_asset": F.col("total_liabilities") / (F.col("total_assets") + EPS),
                       "_prev": prev})
    return d.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"),
                    F.lit("Unknown").alias("sector"),
                    growth_category("revenue_growth", "revenue", "_prev").alias("category"),
                    risk_level("debt_to_asset").alias("risk_level"),
                    "revenue", "operating_income", "net_income")


@query("direct_build", with_panel(f"""
select ticker, strftime(date, '%Y-%m-%d') as date, 'Unknown' as sector,
  case when g > 10 then 'High Growth' when g > 0 and g <= 10 then 'Moderate Growth' when g is not null then 'Stable'
       when prev = 0 and revenue > 0 then 'High Growth' when prev = 0 and revenue < 0 then 'Stable' else 'Unknown' end as category,
  case when da > 0.7 then 'High Risk' when da > 0.4 and da <= 0.7 then 'Medium Risk' when da is not null then 'Low Risk'
       else 'Unknown' end as risk_level,
  revenue, operating_income, net_income
from (select *, (revenue / nullif(prev, 0) - 1) * 100 as g, total_liabilities / (total_assets + 1e-9) as da
      from (select *, lag(revenue) over (partition by ticker order by date asc nulls last) as prev
            from (select {sql_period('"Period"')} as date, coalesce({sql_clean_ticker('"Symbol"')}, true_ticker) as ticker,
                    try_cast(regexp_replace("Total Revenue", '^\\s+|\\s+$', '', 'g') as double) as revenue,
                    try_cast(regexp_replace("Operating Profit", '^\\s+|\\s+$', '', 'g') as double) as operating_income,
                    try_cast(regexp_replace("Net Profit", '^\\s+|\\s+$', '', 'g') as double) as net_income,
                    try_cast(regexp_replace("Total Assets", '^\\s+|\\s+$', '', 'g') as double) as total_assets,
                    try_cast(regexp_replace("Total Liabilities", '^\\s+|\\s+$', '', 'g') as double) as total_liabilities
                  from mu) a) b) c""", MU))
def direct_build_q(spark, sf_dir):
    """Deterministic category records from a direct-schema upload."""
    return direct_build(direct_upload(spark, sf_dir))


# ------------------------------------------------------------ transform_dynamic

@query("transform_dynamic", with_panel(f"""
select s.date, s.ticker, s.revenue, s.operating_income, s.net_income, s.operating_cashflow, s.total_assets,
  s.total_liabilities,
  s.net_income / (s.revenue + 1e-9) * 100 as profit_margin,
  s.operating_income / (s.revenue + 1e-9) * 100 as operating_margin,
  (s.revenue / nullif(lag(s.revenue) over w, 0) - 1) * 100 as revenue_growth,
  (s.net_income / nullif(lag(s.net_income) over w, 0) - 1) * 100 as net_income_growth,
  s.revenue / (s.total_assets + 1e-9) as asset_efficiency,
  s.total_liabilities / (s.total_assets + 1e-9) as debt_to_asset,
  case when s.upload_id % 3 = 1 then 'u1' else 'u2' end as user_id,
  'Unknown' as sector, 'Unknown' as category, 'Unknown' as risk_level
from (select n.* replace (coalesce({sql_clean_ticker('n.ticker')}, upper(n.true_ticker)) as ticker)
      from (select {_norm_cols_sql(True)}, true_ticker from mu) n) s
window w as (partition by s.upload_id order by s.date asc nulls last, s.row_pos)""", MU))
def transform_dynamic_q(spark, sf_dir):
    """Extracted standard records -> typed, tickers cleaned and filled from
    the upload, engineered within the upload (one company), user-tagged; the
    category side has no labels, so they default to 'Unknown'."""
    std = normalized(spark, sf_dir, "true_ticker")
    w = Window.partitionBy("upload_id").orderBy(F.col("date").asc_nulls_last(), "row_pos")
    rev, ni = F.col("revenue"), F.col("net_income")
    return std.select(
        "date", F.coalesce(P.clean_ticker("ticker"), F.upper("true_ticker")).alias("ticker"), *MEASURES,
        (ni / (rev + EPS) * 100).alias("profit_margin"),
        (F.col("operating_income") / (rev + EPS) * 100).alias("operating_margin"),
        ((rev / F.nullif(F.lag(rev).over(w), F.lit(0.0)) - 1) * 100).alias("revenue_growth"),
        ((ni / F.nullif(F.lag(ni).over(w), F.lit(0.0)) - 1) * 100).alias("net_income_growth"),
        (rev / (F.col("total_assets") + EPS)).alias("asset_efficiency"),
        (F.col("total_liabilities") / (F.col("total_assets") + EPS)).alias("debt_to_asset"),
        F.when(F.pmod("upload_id", F.lit(3)) == 1, "u1").otherwise("u2").alias("user_id"),
        *[F.lit("Unknown").alias(c) for c in ("sector", "category", "risk_level")])


def _training_sql() -> str:
    from ledgerline.plans.ingest_queries import PU
    from ledgerline.plans.source_queries import FALLBACK_BODY
    req = " and ".join(f"{c} is not null" for c in ("date", "ticker", "revenue", "net_income",
                                                     "operating_income", "total_assets",
                                                     "total_liabilities", "operating_cashflow"))
    return with_panel(f"""
select *, net_income / (revenue + 1e-9) * 100 as profit_margin,
  operating_income / (revenue + 1e-9) * 100 as operating_margin,
  (revenue / nullif(lag(revenue) over w, 0) - 1) * 100 as revenue_growth,
  (net_income / nullif(lag(net_income) over w, 0) - 1) * 100 as net_income_growth,
  revenue / (total_assets + 1e-9) as asset_efficiency,
  total_liabilities / (total_assets + 1e-9) as debt_to_asset
from ({FALLBACK_BODY}) t
where {req}
window w as (partition by ticker order by date)""", MU, PU)


@query("training_data", _training_sql())
def training_data_q(spark, sf_dir):
    """Training rows for a user — the source fallback (raw upload else
    panel), typed, engineered when features are missing, validated (rows with
    a missing required field removed)."""
    from ledgerline.plans.source_queries import source_fallback_q
    from ledgerline.sources.panel import engineer_features
    d = source_fallback_q(spark, sf_dir)
    d = d.dropna(subset=["date", "ticker", "revenue", "net_income", "operating_income",
                         "total_assets", "total_liabilities", "operating_cashflow"])
    return engineer_features(d)


@query("topk_drivers")
def topk_drivers_q(spark, sf_dir):
    """Top-8 drivers per ticker by |value|, of the model that made the forecast."""
    from ledgerline.operators import learners as L
    from ledgerline.plans.learner_queries import champion_attributions
    return L.shap_local(champion_attributions(spark, sf_dir), 8).select(
        "ticker", "model", "feature", "shap_value", "rank")
