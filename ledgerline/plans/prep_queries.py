"""Preprocessing queries (C28-C34) over NULL / zero-base variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.finance import growth_category, risk_level
from ledgerline.functions.numeric import rnd
from ledgerline.operators import clean, prep, profile
from ledgerline.plans import variant_sql as V
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import R, with_panel, with_std
from ledgerline.sources import variants
from ledgerline.sources.panel import EPS, MEASURES, engineer_features, panel, standard_table

NUMS = profile.FEATURE_COLS
FRAME_COLS = ("ticker", "date", "sector", *MEASURES, "profit_margin", "operating_margin",
              "revenue_growth", "net_income_growth", "asset_efficiency", "debt_to_asset",
              "category", "risk_level")


def raw_frame(spark, sf_dir):
    """NULL + zero-base variant with pandas-style growth (±inf at a zero
    base) and the category labels."""
    p = variants.with_zero_base(variants.with_nulls(panel(spark, sf_dir)))
    rev, ni = F.col("revenue"), F.col("net_income")
    d = p.select("ticker", "date", "sector", *MEASURES,
                 (ni / (rev + EPS) * 100).alias("profit_margin"),
                 (F.col("operating_income") / (rev + EPS) * 100).alias("operating_margin"),
                 prep.growth_raw("revenue").alias("revenue_growth"),
                 prep.growth_raw("net_income").alias("net_income_growth"),
                 (rev / (F.col("total_assets") + EPS)).alias("asset_efficiency"),
                 (F.col("total_liabilities") / (F.col("total_assets") + EPS)).alias("debt_to_asset"))
    return d.withColumns({"category": growth_category("revenue_growth"),
                          "risk_level": risk_level("debt_to_asset")}).select(*FRAME_COLS)


def null_frame(spark, sf_dir):
    """NULL variant, engineered (NULL growth at gaps), with labels."""
    d = engineer_features(variants.with_nulls(panel(spark, sf_dir)))
    return clean.with_category(d).withColumn("risk_level", risk_level("debt_to_asset")) \
        .select(*FRAME_COLS)


def base_frame(spark, sf_dir):
    std = standard_table(spark, sf_dir)
    return clean.with_category(std).withColumn("risk_level", risk_level("debt_to_asset")) \
        .select(*FRAME_COLS)


# ------------------------------------------------------------------ SQL frames

def _cat(g: str) -> str:
    return (f"case when {g} > 10 then 'High Growth' when {g} > 0 and {g} <= 10 then 'Moderate Growth' "
            f"when {g} is not null then 'Stable' else 'Unknown' end")


def _cat_std(g: str) -> str:
    return (f"case when {g} > 10 then 'High Growth' when {g} > 0 and {g} <= 10 then 'Moderate Growth' "
            f"when {g} is not null then 'Stable' when prev_revenue = 0 and revenue > 0 then 'High Growth' "
            f"when prev_revenue = 0 and revenue < 0 then 'Stable' else 'Unknown' end")


RISK = ("case when debt_to_asset > 0.7 then 'High Risk' when debt_to_asset > 0.4 and debt_to_asset <= 0.7 "
        "then 'Medium Risk' when debt_to_asset is not null then 'Low Risk' else 'Unknown' end")
_COLS = ", ".join(FRAME_COLS[:-2])


def _graw(x: str) -> str:
    return (f"case when lag({x}) over w = 0 then case when {x} > 0 then 'inf'::double "
            f"when {x} < 0 then '-inf'::double end else ({x} / lag({x}) over w - 1) * 100 end")


RAW = [V.nulls_cte(), V.zero_base_cte("pn", "pz"), f"""
pr as (select ticker, date, sector, {', '.join(MEASURES)},
         net_income / (revenue + 1e-9) * 100 as profit_margin,
         operating_income / (revenue + 1e-9) * 100 as operating_margin,
         {_graw('revenue')} as revenue_growth, {_graw('net_income')} as net_income_growth,
         revenue / (total_assets + 1e-9) as asset_efficiency,
         total_liabilities / (total_assets + 1e-9) as debt_to_asset
       from pz window w as (partition by ticker order by date)),
rf as (select {_COLS}, {_cat('revenue_growth')} as category, {RISK} as risk_level from pr)"""]

NULLF = [V.nulls_cte(), V.engineered_cte("pn", "pne"), f"""
nf as (select {_COLS}, {_cat_std('revenue_growth')} as category, {RISK} as risk_level
       from (select *, lag(revenue) over (partition by ticker order by date) as prev_revenue from pne) x)"""]

BASEF = [f"""
bf as (select {_COLS}, {_cat_std('revenue_growth')} as category, {RISK} as risk_level
       from (select *, lag(revenue) over (partition by ticker order by date) as prev_revenue from std) x)"""]


@query("fix_infinite", with_panel("""
select ticker, date,
  case when revenue_growth = 'inf'::double then (select max(revenue_growth) filter (where abs(revenue_growth) <> 'inf'::double) from rf)
       when revenue_growth = '-inf'::double then (select min(revenue_growth) filter (where abs(revenue_growth) <> 'inf'::double) from rf)
       else revenue_growth end as revenue_growth,
  case when net_income_growth = 'inf'::double then (select max(net_income_growth) filter (where abs(net_income_growth) <> 'inf'::double) from rf)
       when net_income_growth = '-inf'::double then (select min(net_income_growth) filter (where abs(net_income_growth) <> 'inf'::double) from rf)
       else net_income_growth end as net_income_growth
from rf""", *RAW))
def fix_infinite_q(spark, sf_dir):
    """±inf growth (zero bases) -> finite column max / min."""
    return prep.fix_infinite(raw_frame(spark, sf_dir)).select(
        "ticker", "date", "revenue_growth", "net_income_growth")


def _num_out(df):
    return df.select("ticker", "date", *[rnd(c, 4).alias(c) for c in NUMS],
                     "sector", "category", "risk_level")


def _fill_sql(src: str, stat: str) -> str:
    cols = ", ".join(f"{R(f'coalesce({c}, (select {stat}({c}) from {src}))', 4)} as {c}" for c in NUMS)
    return f"select ticker, date, {cols}, sector, category, risk_level from {src}"


@query("impute_mean", with_panel(_fill_sql("nf", "avg"), *NULLF))
def impute_mean_q(spark, sf_dir):
    """NULL -> column mean (categoricals -> mode)."""
    return _num_out(prep.impute_mean(null_frame(spark, sf_dir)))


@query("impute_median", with_panel(_fill_sql("nf", "median"), *NULLF))
def impute_median_q(spark, sf_dir):
    """NULL -> exact column median."""
    return _num_out(prep.impute_median(null_frame(spark, sf_dir)))


def _ffill_sql() -> str:
    cols = ", ".join(
        f"coalesce(last_value({c} ignore nulls) over (partition by ticker order by date rows between unbounded preceding and current row), "
        f"first_value({c} ignore nulls) over (partition by ticker order by date rows between current row and unbounded following)) as {c}"
        for c in FRAME_COLS if c not in ("ticker", "date"))
    return f"select ticker, date, {cols} from nf"


@query("impute_ffill", with_panel(_ffill_sql(), *NULLF))
def impute_ffill_q(spark, sf_dir):
    """Per-ticker forward then backward fill."""
    return prep.impute_ffill(null_frame(spark, sf_dir))


@query("impute_drop", with_panel("select * from nf where " + " and ".join(
    f"{c} is not null" for c in FRAME_COLS), *NULLF))
def impute_drop_q(spark, sf_dir):
    """Drop incomplete rows."""
    return prep.impute_drop(null_frame(spark, sf_dir))


def _onehot_sql() -> str:
    parts = []
    for c in ("sector", "category", "risk_level"):
        parts.append(f"""select b.ticker, b.date, '{c}_' || l.v as dummy, cast(b.{c} = l.v as integer) as value
  from bf b join (select distinct {c} as v from bf where {c} is not null
                  and {c} > (select min({c}) from bf)) l on true""")
    return "\nunion all ".join(parts)


@query("one_hot", with_std(_onehot_sql(), *BASEF))
def one_hot_q(spark, sf_dir):
    """Drop-first one-hot of the labels, sparse, then in long form."""
    f = base_frame(spark, sf_dir).select("ticker", "date", "sector", "category", "risk_level")
    cols = ["sector", "category", "risk_level"]
    return prep.one_hot_rows(prep.one_hot(f, cols), ["ticker", "date"], cols)


def _scale_sql(center: str, spread: str) -> str:
    cols = ", ".join(
        f"{R(f'({c} - (select {center.format(c=c)} from bf)) / coalesce(nullif((select {spread.format(c=c)} from bf), 0), 1.0)', 8)} as {c}"
        for c in NUMS)
    return f"select ticker, date, {cols} from bf"


def _scaled_out(df):
    return df.select("ticker", "date", *[rnd(c, 8).alias(c) for c in NUMS])


@query("scale_standard", with_std(_scale_sql("avg({c})", "stddev_pop({c})"), *BASEF))
def scale_standard_q(spark, sf_dir):
    """Z-score with population σ."""
    return _scaled_out(prep.scale(base_frame(spark, sf_dir), "standard"))


@query("scale_minmax", with_std(_scale_sql("min({c})", "max({c}) - min({c})"), *BASEF))
def scale_minmax_q(spark, sf_dir):
    """Min-max scaling."""
    return _scaled_out(prep.scale(base_frame(spark, sf_dir), "minmax"))


@query("scale_robust", with_std(_scale_sql(
    "quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"), *BASEF))
def scale_robust_q(spark, sf_dir):
    """Robust scaling (median / IQR, exact quantiles)."""
    return _scaled_out(prep.scale(base_frame(spark, sf_dir), "robust"))


@query("drop_constant", with_std("select * from bf", *BASEF))
def drop_constant_q(spark, sf_dir):
    """Drop zero-variance numeric columns (adds a constant column to
    show the drop)."""
    f = base_frame(spark, sf_dir).withColumn("const_one", F.lit(1.0))
    d, _ = prep.drop_constant(f)
    return d


@query("prepare_ml")
def prepare_ml_q(spark, sf_dir):
    """Full preprocessing chain on the raw (±inf, NULL) frame; returns
    the processed frame."""
    d, _ = prep.prepare_ml(raw_frame(spark, sf_dir))
    return d


@query("prepare_ml_log", with_panel("""
select 'Fix infinite values' as step, cast(count(*) filter (where abs(revenue) = 'inf'::double) + count(*) filter (where abs(operating_income) = 'inf'::double) + count(*) filter (where abs(net_income) = 'inf'::double) + count(*) filter (where abs(total_assets) = 'inf'::double) + count(*) filter (where abs(total_liabilities) = 'inf'::double) + count(*) filter (where abs(operating_cashflow) = 'inf'::double) + count(*) filter (where abs(profit_margin) = 'inf'::double) + count(*) filter (where abs(operating_margin) = 'inf'::double) + count(*) filter (where abs(revenue_growth) = 'inf'::double) + count(*) filter (where abs(net_income_growth) = 'inf'::double) + count(*) filter (where abs(asset_efficiency) = 'inf'::double) + count(*) filter (where abs(debt_to_asset) = 'inf'::double) as bigint) as value from rf
union all select 'Handle missing values', cast(count(*) filter (where ticker is null) + count(*) filter (where date is null) + count(*) filter (where sector is null) + count(*) filter (where revenue is null) + count(*) filter (where operating_income is null) + count(*) filter (where net_income is null) + count(*) filter (where total_assets is null) + count(*) filter (where total_liabilities is null) + count(*) filter (where operating_cashflow is null) + count(*) filter (where profit_margin is null) + count(*) filter (where operating_margin is null) + count(*) filter (where revenue_growth is null) + count(*) filter (where net_income_growth is null) + count(*) filter (where asset_efficiency is null) + count(*) filter (where debt_to_asset is null) + count(*) filter (where category is null) + count(*) filter (where risk_level is null) as bigint) from rf
union all select 'Encode categorical features', cast(3 as bigint)
union all select 'Remove constant features', cast((case when var_samp(case when abs(revenue) <> 'inf'::double then revenue end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(operating_income) <> 'inf'::double then operating_income end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(net_income) <> 'inf'::double then net_income end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(total_assets) <> 'inf'::double then total_assets end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(total_liabilities) <> 'inf'::double then total_liabilities end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(operating_cashflow) <> 'inf'::double then operating_cashflow end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(profit_margin) <> 'inf'::double then profit_margin end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(operating_margin) <> 'inf'::double then operating_margin end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(revenue_growth) <> 'inf'::double then revenue_growth end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(net_income_growth) <> 'inf'::double then net_income_growth end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(asset_efficiency) <> 'inf'::double then asset_efficiency end) <= 0 then 1 else 0 end) + (case when var_samp(case when abs(debt_to_asset) <> 'inf'::double then debt_to_asset end) <= 0 then 1 else 0 end) as bigint) from rf
union all select 'Scale features', cast(12 as bigint)""", *RAW))
def prepare_ml_log_q(spark, sf_dir):
    """The step log of the preprocessing chain."""
    _, log = prep.prepare_ml(raw_frame(spark, sf_dir))
    return log
