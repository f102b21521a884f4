"""Forecast set-up / evaluation queries (M1, M6, M8-M11, M13, W13-W17, A25,
A27, A29-A30, F5-F8, C39, C41) and learner queries (M2-M5, M7, M12, M15-M19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.numeric import rnd
from ledgerline.operators import forecast as fc
from ledgerline.operators.profile import FEATURE_COLS
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import R, with_std
from ledgerline.sources.panel import standard_table

FEATS = ", ".join(FEATURE_COLS)
NOTNULL = " and ".join(f"{c} is not null" for c in FEATURE_COLS)


def setup(spark, sf_dir):
    """Shared set-up: standard table, base frequency, horizon, split."""
    from ledgerline.plans.memo import remember
    std = standard_table(spark, sf_dir)
    ppy = remember(spark, f"ppy|{sf_dir}", lambda: fc.base_periods_per_year(std))
    h = fc.horizon_py(ppy)
    eff = max(1.0, ppy / h)
    sp = fc.time_split(fc.supervised_set(std, h))
    return std, ppy, h, eff, sp


# SQL chain ---------------------------------------------------------------

GAPS = """
gaps as (select ticker, date_diff('day', lag(date) over (partition by ticker order by date), date) as gap from std),
freq as (select case when m <= 2 then 365.0 when m <= 8 then 52.0 when m <= 16 then 24.0 when m <= 45 then 12.0
                     when m <= 120 then 4.0 when m <= 240 then 2.0 else 1.0 end as ppy
         from (select quantile_cont(gap, 0.5) as m from gaps where gap is not null) q)"""

SUP = f"""
sup0 as (select ticker, date, {FEATS},
           lead(net_income, 1) over w as net_income_next,
           (lead(net_income, 1) over w - net_income) / nullif(net_income, 0) * 100 as target
         from std window w as (partition by ticker order by date)),
sup as (select * from sup0 where target is not null and {NOTNULL}),
dp as (select date, row_number() over (order by date) as k, count(*) over () as n_dates
       from (select distinct date from sup) d),
cut as (select date as cutoff from dp
        where k = least(greatest(1, cast(floor(n_dates * 0.8::double) as integer)), n_dates - 1)),
sp as (select *, case when date <= (select cutoff from cut) then 'train' else 'test' end as split from sup),
mt as (select avg(target) as mean_train from sp where split = 'train')"""

PREDS = """
nl as (select 'NaiveLast' as model, ticker, date, target as actual,
         coalesce(lag(target) over (partition by ticker order by date), (select mean_train from mt)) as predicted, split
       from sp),
ix as (select *, row_number() over (partition by ticker order by date) - 1 as idx from sp),
fit as (select ticker, regr_slope(target, idx) as slope, regr_intercept(target, idx) as intercept,
          count(*) as n_train from ix where split = 'train' group by ticker),
preds as (
  select model, ticker, date, actual, predicted from nl where split = 'test'
  union all select 'NaiveMean', ticker, date, target, (select mean_train from mt) from sp where split = 'test'
  union all select 'LinearTrend', ix.ticker, date, target,
    case when n_train >= 2 then intercept + slope * idx else (select mean_train from mt) end
  from ix left join fit on ix.ticker = fit.ticker where split = 'test')"""


def _met(src: str = "preds", by: str = "model") -> str:
    r = "(actual - predicted)"
    r2 = (f"case when count(*) < 2 then null when var_pop(actual) * count(*) = 0 then "
          f"case when sum({r} * {r}) = 0 then 1.0 else 0.0 end "
          f"else 1 - sum({r} * {r}) / (var_pop(actual) * count(*)) end")
    return f"""select {by}, {R(f'avg(abs({r}))')} as mae, {R(f'sqrt(avg({r} * {r}))')} as rmse,
    {R(r2)} as r2, {R(f'avg({r})')} as residual_mean, {R(f'stddev_pop({r})')} as residual_std,
    {R(f'min({r})')} as residual_min, {R(f'max({r})')} as residual_max, count(*) as test_size
  from {src} group by {by}"""


MET = f"met as ({_met()})"

REL = """
champ as (select model, r2, mae, rmse,
            row_number() over (order by r2 desc nulls last, mae asc, model) as rank from met where model <> 'NaiveLast'),
nv as (select mae as naive_mae from met where model = 'NaiveLast'),
rel as (
  select m.model as selected_model, m.r2, m.mae, m.test_size, m.residual_std,
    case when m.test_size < 8 then 'Low' when m.r2 is null then 'Low' when m.r2 < 0.2 then 'Low'
         when not coalesce(m.mae <= (select naive_mae from nv), false) then 'Low'
         when m.r2 >= 0.5 then 'High' else 'Medium' end as model_reliability,
    case when m.test_size < 8 then 'insufficient_holdout_samples' when m.r2 is null then 'invalid_r2'
         when m.r2 < 0.2 then 'r2_below_threshold'
         when not coalesce(m.mae <= (select naive_mae from nv), false) then 'does_not_beat_naive'
         when m.r2 >= 0.5 then 'strong_fit_and_beats_naive' else 'adequate_fit_and_beats_naive' end
      as model_reliability_reason,
    coalesce(m.mae <= (select naive_mae from nv), false) as beats_naive,
    (select naive_mae from nv) as naive_mae,
    (select arg_min(model, (mae, model)) from met) as best_benchmark_model
  from met m join champ c on m.model = c.model where c.rank = 1)"""

PRIORS = """
rp as (select upper(ticker) as ticker, quantile_cont(target, 0.5) as recent_prior
       from (select *, row_number() over (partition by ticker order by date desc) as rn
             from sp where split = 'train') t where rn <= 6 group by upper(ticker)),
lp0 as (select upper(ticker) as ticker, count(*) as n, arg_min(net_income, date) as first,
          arg_max(net_income, date) as last from std where net_income is not null group by upper(ticker)),
lp as (select ticker, (pow(1.0 + (pow(last / first, 1.0 / (n - 1)) - 1.0), 1.0) - 1.0) * 100.0 as level_prior
       from lp0 where n >= 3 and first > 0 and last > 0),
pri as (select coalesce(rp.ticker, lp.ticker) as ticker, recent_prior, level_prior,
          case when recent_prior is not null and level_prior is not null
               then 0.4 * recent_prior + (1.0 - 0.4) * level_prior
               when recent_prior is not null then recent_prior else level_prior end as prior
        from rp full outer join lp on rp.ticker = lp.ticker)"""


def fsql(body: str, *extra: str) -> str:
    return with_std(body, GAPS, SUP, PREDS, MET, REL, PRIORS, *extra)


@query("infer_frequency", with_std("""
select ticker, median_gap_days, cast(ppy as double) as periods_per_year,
  case when round(ppy) >= 300 then 'daily' when round(ppy) >= 48 then 'weekly' when round(ppy) >= 10 then 'monthly'
       when round(ppy) >= 3 then 'quarterly' else 'yearly' end as period_type,
  h as horizon, cast(greatest(1.0, ppy / greatest(1, h)) as double) as effective_periods_per_year
from (select *, case when ppy >= 300 then 30 when ppy >= 48 then 4 when ppy >= 10 then 3 else 1 end as h
      from (select t.ticker, m.median_gap_days,
              case when m.median_gap_days is null then 1.0 when m.median_gap_days <= 2 then 365.0
                   when m.median_gap_days <= 8 then 52.0 when m.median_gap_days <= 16 then 24.0
                   when m.median_gap_days <= 45 then 12.0 when m.median_gap_days <= 120 then 4.0
                   when m.median_gap_days <= 240 then 2.0 else 1.0 end as ppy
            from (select distinct ticker from std) t left join
                 (select ticker, quantile_cont(gap, 0.5) as median_gap_days from gaps where gap is not null
                  group by ticker) m on t.ticker = m.ticker) a) b""", GAPS))
def infer_frequency_q(spark, sf_dir):
    """A27 + F6 + F7: per-ticker frequency, label, horizon."""
    return fc.infer_frequency(standard_table(spark, sf_dir))


@query("infer_frequency_events", """
with g as (select user_id, date_diff('day', lag(d) over (partition by user_id order by d), d) as gap
           from (select distinct user_id, cast(ts as date) as d from events) e)
select t.user_id, m.median_gap_days,
  cast(case when m.median_gap_days is null then 1.0 when m.median_gap_days <= 2 then 365.0
       when m.median_gap_days <= 8 then 52.0 when m.median_gap_days <= 16 then 24.0
       when m.median_gap_days <= 45 then 12.0 when m.median_gap_days <= 120 then 4.0
       when m.median_gap_days <= 240 then 2.0 else 1.0 end as double) as periods_per_year
from (select distinct user_id from events) t
left join (select user_id, quantile_cont(gap, 0.5) as median_gap_days from g where gap is not null group by user_id) m
  on t.user_id = m.user_id""")
def infer_frequency_events_q(spark, sf_dir):
    """A27 on an irregular panel: per-user activity days from ``events``."""
    from ledgerline.sources.tables import read_table
    ev = read_table(spark, sf_dir, "events", "user_id", "ts") \
        .select("user_id", F.to_date("ts").alias("date")).distinct()
    out = fc.infer_frequency(ev, key="user_id")
    return out.select("user_id", "median_gap_days", "periods_per_year")


@query("supervised_set", fsql(f"""select ticker, date, {FEATS}, net_income_next, {R('target')} as target, split
from sp"""))
def supervised_set_q(spark, sf_dir):
    """M1 + W2 + W16: supervised rows with lead target and split label."""
    _, _, _, _, sp = setup(spark, sf_dir)
    return sp.select("ticker", "date", *FEATURE_COLS, "net_income_next",
                     rnd("target").alias("target"), "split")


@query("lead_target", with_std("""select ticker, date, net_income,
  lead(net_income, 1) over (partition by ticker order by date) as net_income_next from std"""))
def lead_target_q(spark, sf_dir):
    """Value one period ahead per ticker."""
    from pyspark.sql import Window
    std = standard_table(spark, sf_dir)
    w = Window.partitionBy("ticker").orderBy("date")
    return std.select("ticker", "date", "net_income",
                      F.lead("net_income", 1).over(w).alias("net_income_next"))


@query("time_split", fsql("""select (select cutoff from cut) as cutoff_date,
  count(*) filter (where split = 'train') as train_size, count(*) filter (where split = 'test') as test_size
from sp"""))
def time_split_q(spark, sf_dir):
    """Chronological cutoff on distinct dates and split sizes."""
    _, _, _, _, sp = setup(spark, sf_dir)
    cut = fc.cutoff_date(sp)
    return sp.agg(F.count_if(F.col("split") == "train").alias("train_size"),
                  F.count_if(F.col("split") == "test").alias("test_size")) \
        .select(cut.alias("cutoff_date"), "train_size", "test_size")


@query("ts_folds", fsql("""
, tdp as (select date, row_number() over (order by date) as k, count(*) over () as n_dates
          from (select distinct date from sp where split = 'train') d),
par as (select least(5, greatest(2, cast(floor((select count(*) from sp where split = 'train') / 6) as integer))) as ns),
fz as (select tdp.*, ns, cast(floor(n_dates / (ns + 1)) as integer) as size, unnest(range(0, ns)) as fold
       from tdp, par)
select cast(fold as bigint) as fold, date,
  case when k < n_dates - (ns - fold) * size + 1 then 'train' else 'test' end as role
from fz
where k < n_dates - (ns - fold) * size + 1 + size"""))
def ts_folds_q(spark, sf_dir):
    """Expanding-window folds over training dates."""
    _, _, _, _, sp = setup(spark, sf_dir)
    return fc.ts_folds(sp)


@query("naive_last", fsql("""select model, ticker, date, actual, predicted from nl where split = 'test'"""))
def naive_last_q(spark, sf_dir):
    """Naive-last forecast per ticker."""
    _, _, _, _, sp = setup(spark, sf_dir)
    return fc.naive_last(sp)


@query("naive_mean", fsql(f"""select 'NaiveMean' as model, ticker, date, target as actual,
  {R('(select mean_train from mt)')} as predicted from sp where split = 'test'"""))
def naive_mean_q(spark, sf_dir):
    """M6: training-mean baseline."""
    _, _, _, _, sp = setup(spark, sf_dir)
    return fc.naive_mean(sp).withColumn("predicted", rnd("predicted"))


@query("regression_metrics", fsql("select * from met"))
def regression_metrics_q(spark, sf_dir):
    """Holdout metrics per deterministic model."""
    _, _, _, _, sp = setup(spark, sf_dir)
    return fc.regression_metrics(fc.predictions(sp))


@query("champion", fsql("select * from champ"))
def champion_q(spark, sf_dir):
    """M8: model ranking, R² desc then MAE, over the models that SQL can state;
    `forecast_all` ranks the trained candidates by the same operator."""
    _, _, _, _, sp = setup(spark, sf_dir)
    return fc.champion(fc.regression_metrics(fc.predictions(sp)))


@query("reliability", fsql("select * from rel"))
def reliability_q(spark, sf_dir):
    """M9: reliability of the champion of the models that SQL can state."""
    _, _, _, _, sp = setup(spark, sf_dir)
    return fc.reliability(fc.regression_metrics(fc.predictions(sp)))


@query("prediction_bounds", fsql(f"""select model, {R('least(min(actual), min(predicted))')} as lower,
  {R('greatest(max(actual), max(predicted))')} as upper from preds group by model"""))
def prediction_bounds_q(spark, sf_dir):
    """Plot bounds per model."""
    _, _, _, _, sp = setup(spark, sf_dir)
    return fc.prediction_bounds(fc.predictions(sp))


@query("recent_prior", fsql(f"select ticker, {R('recent_prior')} as recent_prior from rp"))
def recent_prior_q(spark, sf_dir):
    """Median of the last 6 training targets per ticker."""
    _, _, _, _, sp = setup(spark, sf_dir)
    return fc.recent_prior(sp).select("ticker", rnd("recent_prior").alias("recent_prior"))


@query("level_prior", fsql(f"select ticker, {R('level_prior')} as level_prior from lp"))
def level_prior_q(spark, sf_dir):
    """Long-run level trend projected one horizon."""
    std, _, h, _, _ = setup(spark, sf_dir)
    return fc.level_prior(std, h).select("ticker", rnd("level_prior").alias("level_prior"))


@query("merge_priors", fsql(f"""select ticker, {R('recent_prior')} as recent_prior,
  {R('level_prior')} as level_prior, {R('prior')} as prior from pri"""))
def merge_priors_q(spark, sf_dir):
    """Full-outer merge of the two priors (0.4 / 0.6)."""
    std, _, h, _, sp = setup(spark, sf_dir)
    m = fc.merge_priors(fc.recent_prior(sp), fc.level_prior(std, h))
    return m.select("ticker", *[rnd(c).alias(c) for c in ("recent_prior", "level_prior", "prior")])


def _pta(g: str, p: str) -> str:
    return (f"(case when {p} <= 0 then {g} when {g} / 100.0 <= -0.9999 then -100.0 "
            f"else (pow(1.0 + {g} / 100.0, {p}) - 1.0) * 100.0 end)")


FGAP = f"""
fut as (select ticker, max(date) as date, arg_max(net_income, date) as net_income from std group by ticker),
eff as (select greatest(1.0, ppy / 1) as p from freq),
cp as (
  select f.ticker,
    case (select selected_model from rel)
      when 'NaiveMean' then (select mean_train from mt)
      when 'NaiveLast' then coalesce((select arg_max(target, date) from sp s where s.ticker = f.ticker), (select mean_train from mt))
      else coalesce((select case when n_train >= 2 then intercept + slope * (select count(*) from sp s where s.ticker = f.ticker)
                            else (select mean_train from mt) end from fit where fit.ticker = f.ticker), (select mean_train from mt))
    end as pred
  from fut f),
bw as (select case when r2 is null then 0.85 else greatest(0.35, least(0.85, 0.35 + 0.45 * r2)) end as w,
         residual_std as sigma from rel),
fg0 as (
  select f.ticker, f.date, f.net_income,
    case when pr.prior is not null then (select w from bw) * cp.pred + (1.0 - (select w from bw)) * pr.prior
         else cp.pred end as p,
    case when (select p from eff) <= 0 then 10.0 else (pow(1.0 + 10.0 / 100.0, 1.0 / (select p from eff)) - 1.0) * 100.0 end as t
  from fut f join cp on f.ticker = cp.ticker left join pri pr on upper(f.ticker) = pr.ticker)"""


@query("forecast_gap", fsql(f"""
select ticker, date, net_income as current_net_income, {R('p')} as predicted_growth_rate,
  {R('t')} as target_growth_rate, {R('p - t')} as gap_vs_target,
  {R('p')} as predicted_growth_rate_period_pct, {R('t')} as target_growth_rate_period_pct,
  {R('p - t')} as gap_vs_target_period_pct,
  case when p - t >= 0 then 'surplus' else 'shortfall' end as gap_status,
  {R('p - 1.96 * (select sigma from bw)')} as confidence_lower_95,
  {R('p + 1.96 * (select sigma from bw)')} as confidence_upper_95,
  {R('net_income * (1 + p / 100)', 4)} as predicted_next_net_income,
  {R('net_income * (1 + t / 100)', 4)} as target_next_net_income,
  case when round((select p from eff)) >= 300 then 'daily' when round((select p from eff)) >= 48 then 'weekly'
       when round((select p from eff)) >= 10 then 'monthly' when round((select p from eff)) >= 3 then 'quarterly'
       else 'yearly' end as period_type,
  (select p from eff) as periods_per_year,
  {R(_pta('p', '(select p from eff)'))} as predicted_growth_rate_annualized_pct,
  {R(_pta('t', '(select p from eff)'))} as target_growth_rate_annualized_pct,
  {R(_pta('p', '(select p from eff)') + ' - ' + _pta('t', '(select p from eff)'))} as gap_vs_target_annualized_pct,
  cast(1 as bigint) as forecast_horizon_periods,
  (select model_reliability from rel) as model_reliability,
  (select model_reliability_reason from rel) as model_reliability_reason,
  (select selected_model from rel) as selected_model, (select r2 from rel) as model_r2,
  (select naive_mae from rel) as benchmark_naive_mae, (select beats_naive from rel) as beats_naive
from fg0""", FGAP))
def forecast_gap_q(spark, sf_dir):
    """M10 (+ M11 blend, F5, F6): forecast vs target per ticker, by the champion of the
    models that SQL can state; `forecast_all` is the same with the trained candidates."""
    std, ppy, h, eff, sp = setup(spark, sf_dir)
    met = fc.regression_metrics(fc.predictions(sp))
    pri = fc.merge_priors(fc.recent_prior(sp), fc.level_prior(std, h))
    return fc.forecast_gap(std, sp, met, pri, eff, h=h)


@query("annualize", with_std(f"""
select ticker, date, revenue_growth as period_pct, {R(_pta('revenue_growth', '4.0'))} as annualized_pct,
  {R('case when 4.0 <= 0 then 10.0 else (pow(1.0 + 10.0 / 100.0, 1.0 / 4.0) - 1.0) * 100.0 end')} as period_target_pct
from std where revenue_growth is not null"""))
def annualize_q(spark, sf_dir):
    """period <-> annual growth conversions (quarterly panel)."""
    s = standard_table(spark, sf_dir).filter(F.col("revenue_growth").isNotNull())
    return s.select("ticker", "date", F.col("revenue_growth").alias("period_pct"),
                    rnd(fc.period_to_annual("revenue_growth", F.lit(4.0))).alias("annualized_pct"),
                    rnd(fc.annual_to_period(F.lit(10.0), F.lit(4.0))).alias("period_target_pct"))


@query("infer_periods_from_target", with_std(f"""
select ticker, date, {R(_pta('revenue_growth', '4.0'))} as annual_pct,
  {R('case when p > -1 and a > -1 and p <> 0 and ln(1 + a) / ln(1 + p) > 0 then least(365.0, greatest(1.0, ln(1 + a) / ln(1 + p))) end')} as implied_periods
from (select ticker, date, revenue_growth, revenue_growth / 100.0 as p,
        {_pta('revenue_growth', '4.0')} / 100.0 as a from std where revenue_growth is not null) x"""))
def infer_periods_from_target_q(spark, sf_dir):
    """F8: periods/year implied by period vs annualised growth (round trip)."""
    s = standard_table(spark, sf_dir).filter(F.col("revenue_growth").isNotNull())
    ann = fc.period_to_annual("revenue_growth", F.lit(4.0))
    return s.select("ticker", "date", rnd(ann).alias("annual_pct"),
                    rnd(fc.periods_from_targets("revenue_growth", ann)).alias("implied_periods"))


@query("basic_forecast", with_std(f"""
select ticker, date, last as current_net_income, {R('g')} as predicted_growth_rate, 10.0::double as target_growth_rate,
  {R('g - 10.0')} as gap_vs_target, case when g - 10.0 >= 0 then 'surplus' else 'shortfall' end as gap_status
from (select ticker, max(date) as date, arg_max(net_income, date) as last,
        case when count(*) < 2 then 5.0 when arg_min(net_income, date) = 0 then 0.0
             else (arg_max(net_income, date) - arg_min(net_income, date)) / abs(arg_min(net_income, date)) * 100 end as g
      from std group by ticker) x"""))
def basic_forecast_q(spark, sf_dir):
    """First -> last income growth fallback forecast."""
    return fc.basic_forecast(standard_table(spark, sf_dir))


@query("forecast_table", with_std(f"""
select ticker as "Ticker", date as "Date", {R('g')} as "Predicted Growth Rate", 10.0::double as "Target Growth Rate",
  {R('g - 10.0')} as "Gap Vs Target", case when g - 10.0 >= 0 then 'surplus' else 'shortfall' end as "Gap Status",
  {R(R('g') + ' - 10.0')} as "Lower", {R(R('g') + ' + 10.0')} as "Upper"
from (select ticker, max(date) as date,
        case when count(*) < 2 then 5.0 when arg_min(net_income, date) = 0 then 0.0
             else (arg_max(net_income, date) - arg_min(net_income, date)) / abs(arg_min(net_income, date)) * 100 end as g
      from std group by ticker) x"""))
def forecast_table_q(spark, sf_dir):
    """Display table with the ±10 default band (fallback forecasts have no bounds)."""
    b = fc.basic_forecast(standard_table(spark, sf_dir)).withColumns({
        "confidence_lower_95": F.lit(None).cast("double"),
        "confidence_upper_95": F.lit(None).cast("double")})
    return fc.forecast_table(b)


@query("has_predictions", with_std("""
select t.ticker, coalesce(h.hit, false) as has_predictions
from (select distinct ticker from std) t
left join (select distinct upper(ticker) as u, true as hit from std
           where cast(right(ticker, 4) as integer) % 2 = 0) h on upper(t.ticker) = h.u"""))
def has_predictions_q(spark, sf_dir):
    """Which tickers have forecast rows (forecasts for even ticker numbers)."""
    from ledgerline.sources.variants import ticker_no
    std = standard_table(spark, sf_dir)
    fcr = fc.basic_forecast(std.filter(F.pmod(ticker_no(), F.lit(2)) == 0))
    return fc.has_predictions(std.select("ticker").distinct(), fcr)
