"""Profiling queries (J1, A11-A20, L5) over the analysis frame."""

from __future__ import annotations

from ledgerline.operators import clean, profile
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import R, RS, with_std
from ledgerline.sources.panel import standard_table

FEATS = profile.FEATURE_COLS

CAT = """
cat as (
  select ticker, date, sector,
    case when revenue_growth > 10 then 'High Growth'
         when revenue_growth > 0 and revenue_growth <= 10 then 'Moderate Growth'
         when revenue_growth is not null then 'Stable'
         when prev_revenue = 0 and revenue > 0 then 'High Growth'
         when prev_revenue = 0 and revenue < 0 then 'Stable' else 'Unknown' end as category,
    case when debt_to_asset > 0.7 then 'High Risk'
         when debt_to_asset > 0.4 and debt_to_asset <= 0.7 then 'Medium Risk'
         when debt_to_asset is not null then 'Low Risk' else 'Unknown' end as risk_level
  from (select *, lag(revenue) over (partition by ticker order by date) as prev_revenue from std) x)"""

AF = """
af as (select s.* exclude (sector), c.sector, c.category, c.risk_level
       from std s left join cat c on s.ticker = c.ticker and s.date = c.date)"""

LV = ("lv as (select ticker, date, feature, value from (unpivot (select ticker, date, "
      + ", ".join(f"cast({c} as double) as {c}" for c in FEATS)
      + " from af) on " + ", ".join(FEATS) + " into name feature value value))")


def frame(spark, sf_dir):
    std = standard_table(spark, sf_dir)
    return profile.analysis_frame(std, clean.category_table(std))


def corr_table(spark, sf_dir):
    """The correlation report as a phase artifact (checkpointed once per
    application, read by every report built on it)."""
    from ledgerline.plans.memo import remember
    return remember(spark, f"corr|{sf_dir}",
                    lambda: profile.correlation_matrix(frame(spark, sf_dir)))


def psql(body: str, *extra: str) -> str:
    return with_std(body, CAT, AF, LV, *extra)


@query("join_analysis", psql("select * from af"))
def join_analysis_q(spark, sf_dir):
    """Standard ⟕ category on (ticker, date)."""
    return frame(spark, sf_dir)


@query("feature_variance", psql(f"""
select feature, {RS('avg(value)')} as mean, {RS('stddev_samp(value)')} as std_dev,
  min(value) as min, max(value) as max,
  {RS('case when avg(value) = 0 then 0.0 else stddev_samp(value) / abs(avg(value)) end')} as coefficient_of_variation
from lv group by feature"""))
def feature_variance_q(spark, sf_dir):
    """Feature statistics sorted by σ (order is presentation)."""
    return profile.feature_variance(frame(spark, sf_dir))


@query("feature_statistics", psql(f"""
select feature, count(value) as count, {RS('avg(value)')} as mean, {RS('stddev_samp(value)')} as std,
  min(value) as min, {RS('quantile_cont(value, 0.25)')} as p25, {RS('quantile_cont(value, 0.5)')} as p50,
  {RS('quantile_cont(value, 0.75)')} as p75, max(value) as max,
  {RS('case when avg(value) = 0 then 0.0 else stddev_samp(value) / abs(avg(value)) end')} as cv,
  {RS('skewness(value)', 8)} as skewness, {RS('kurtosis(value)', 8)} as kurtosis
from lv group by feature"""))
def feature_statistics_q(spark, sf_dir):
    """Describe + bias-corrected skewness / kurtosis."""
    return profile.feature_statistics(frame(spark, sf_dir))


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(FEATS):
        for j, b in enumerate(FEATS):
            src = "" if i == j else " from af"
            v = "1.0" if i == j else f"corr({a}, {b})"
            parts.append(f"select '{a}' as feature_1, '{b}' as feature_2, {i} as i, {j} as j, "
                         f"{R(v, 6)} as correlation{src}")
    return "cm as (" + "\n union all ".join(parts) + ")"


CM = _corr_sql()


@query("correlation_matrix", psql("select * from cm", CM))
def correlation_matrix_q(spark, sf_dir):
    """Pairwise-complete correlation matrix, long form."""
    return corr_table(spark, sf_dir)


@query("high_corr_pairs", psql("""select feature_1, feature_2, correlation from cm
where i < j and abs(correlation) > 0.7""", CM))
def high_corr_pairs_q(spark, sf_dir):
    """|r| > 0.7, upper triangle."""
    return profile.high_corr_pairs(corr_table(spark, sf_dir))


@query("redundant_features", psql("""select feature_1, feature_2, correlation,
  printf('Consider removing %s (highly correlated with %s)', feature_2, feature_1) as recommendation
from cm where i < j and abs(correlation) > 0.8""", CM))
def redundant_features_q(spark, sf_dir):
    """|r| > 0.8 with a recommendation."""
    return profile.redundant_features(corr_table(spark, sf_dir))


@query("corr_importance", psql("""select feature_2 as feature, abs(correlation) as importance from cm
where feature_1 = 'net_income' and feature_2 <> 'net_income' and correlation is not null
order by importance desc, feature limit 8""", CM))
def corr_importance_q(spark, sf_dir):
    """Top-8 |corr| with net income."""
    return profile.corr_importance(corr_table(spark, sf_dir))


QB = """
qb as (select feature, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
       from lv group by feature),
bb as (select feature, q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_bound,
         q3 + 1.5 * (q3 - q1) as upper_bound from qb),
oi as (select feature, {rs_cols}, count(*) filter (where value < lower_bound or value > upper_bound) as outlier_count,
         {pct} as outlier_percentage
       from lv join bb using (feature) group by feature, q1, q3, iqr, lower_bound, upper_bound)""".format(
    rs_cols=", ".join(f"{RS(c)} as {c}" for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")),
    pct=R("count(*) filter (where value < lower_bound or value > upper_bound) / count(*) * 100", 6))


@query("outliers_iqr", psql("select * from oi", QB))
def outliers_iqr_q(spark, sf_dir):
    """IQR outlier counts, % and fences per feature (exact quantiles)."""
    return profile.outliers_iqr(frame(spark, sf_dir))


@query("outlier_rows", psql("""select ticker, date, feature, value from lv join bb using (feature)
where value < lower_bound or value > upper_bound""", QB))
def outlier_rows_q(spark, sf_dir):
    """The flagged rows."""
    return profile.outlier_rows(frame(spark, sf_dir))


@query("outliers_zscore", psql(f"""
select feature, count(*) filter (where abs(value - mu) / nullif(sd, 0) > 3) as outlier_count,
  {R('count(*) filter (where abs(value - mu) / nullif(sd, 0) > 3) / count(*) * 100', 6)} as outlier_percentage
from lv join (select feature, avg(value) as mu, stddev_pop(value) as sd from lv group by feature) s
  using (feature)
group by feature"""))
def outliers_zscore_q(spark, sf_dir):
    """Z-score (population σ) outliers, threshold 3."""
    return profile.outliers_zscore(frame(spark, sf_dir))


@query("extreme_values", psql(f"""
select feature, {RS('q_lo')} as lower_bound, {RS('q_hi')} as upper_bound,
  count(*) filter (where value < q_lo) as extreme_low_count,
  count(*) filter (where value > q_hi) as extreme_high_count,
  count(*) filter (where value < q_lo or value > q_hi) as extreme_values_total
from lv join (select feature, quantile_cont(value, 0.05) as q_lo, quantile_cont(value, 0.95) as q_hi
              from lv group by feature) b using (feature)
group by feature, q_lo, q_hi"""))
def extreme_values_q(spark, sf_dir):
    """Values outside the 5th / 95th percentiles."""
    return profile.extreme_values(frame(spark, sf_dir))


AF_TYPES = [("ticker", "s"), ("date", "t")] + [(c, "d") for c in FEATS] + \
    [("sector", "s"), ("category", "s"), ("risk_level", "s")]


def _anom_sql() -> str:
    parts = []
    for c, t in AF_TYPES:
        inf = f"count(*) filter (where abs({c}) = 'inf'::double)" if t == "d" else "0"
        zero = f"count(*) filter (where {c} = 0)" if t == "d" else "0"
        parts.append(f"select '{c}' as \"column\", count(*) filter (where {c} is null) as nan_count, "
                     f"cast({inf} as bigint) as inf_count, cast({zero} as bigint) as zero_count, "
                     f"count(*) as rows from af")
    return "fa0 as (" + "\n union all ".join(parts) + "),\n" + f"""fa as (
  select "column", nan_count, inf_count, zero_count, nan_count + inf_count + zero_count as total_anomalies,
    {R('case when rows > 0 then (nan_count + inf_count + zero_count) / rows * 100 else 0.0 end', 6)} as anomaly_percentage
  from fa0)"""


FA = _anom_sql()


@query("flag_anomalies", psql("select * from fa", FA))
def flag_anomalies_q(spark, sf_dir):
    """NULL / inf / zero counts per column."""
    return profile.flag_anomalies(frame(spark, sf_dir))


@query("outlier_recommendations", psql("""
select feature as "column",
  case when outlier_percentage > 10 then printf('High outlier percentage (%.1f%%)', outlier_percentage)
       when outlier_percentage > 5 then printf('Moderate outlier percentage (%.1f%%)', outlier_percentage)
       else printf('Low outlier count (%d)', outlier_count) end as issue,
  case when outlier_percentage > 10 then 'Investigate data quality; consider separate analysis for outlier subset'
       when outlier_percentage > 5 then 'Apply robust scaling or IOR transformation'
       else 'Safe to use; consider Winsorization if needed' end as treatment,
  case when outlier_percentage > 10 then 'high' when outlier_percentage > 5 then 'medium' else 'low' end as severity,
  1 as source
from oi where outlier_count > 0
union all
select "column", printf('Missing values (%d)', nan_count), 'Impute using median/mean or forward-fill for time-series',
  'medium', 2 from fa where nan_count > 0
union all
select "column", printf('Infinite values (%d)', inf_count), 'Replace with max/min finite values', 'high', 3
from fa where inf_count > 0""", QB, FA))
def outlier_recommendations_q(spark, sf_dir):
    """Treatment recommendations."""
    return profile.outlier_recommendations(frame(spark, sf_dir))
