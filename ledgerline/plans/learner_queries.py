"""Learner, explanation and importance queries (M2, M4, M5, M7, M12, M15-M19,
W12, W19, C40, L4, L7, A29).  MLlib fits are iterative, so most of these are
rows-only checked; invariants are unit-tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.numeric import rnd, rnd_sig
from ledgerline.operators import forecast as fc
from ledgerline.operators import learners as L
from ledgerline.operators.attribution import shapley_forest
from ledgerline.operators.profile import FEATURE_COLS
from ledgerline.plans.profile_queries import CM, corr_table, frame, psql
from ledgerline.plans.forecast_queries import setup
from ledgerline.plans.memo import remember
from ledgerline.plans.registry import query
from ledgerline.plans.sqlparts import R, RS, with_std
from ledgerline.sources.panel import STANDARD_COLUMNS, standard_table

FEATS = list(FEATURE_COLS)


def corr_imp(spark, sf_dir):
    c = corr_table(spark, sf_dir)
    return c.filter((F.col("feature_1") == "net_income") & (F.col("feature_2") != "net_income")
                    & F.col("correlation").isNotNull()) \
        .select(F.col("feature_2").alias("feature"), F.abs("correlation").alias("importance"))


CI = """
ci as (select feature_2 as feature, abs(correlation) as importance from cm
       where feature_1 = 'net_income' and feature_2 <> 'net_income' and correlation is not null)"""


@query("cumulative_importance", psql(f"""
select feature, {R('importance', 8)} as importance,
  {R('sum(importance) over (order by importance desc, feature rows between unbounded preceding and current row)', 8)} as cumulative_importance,
  {R('sum(importance) over (order by importance desc, feature rows between unbounded preceding and current row) / (select sum(importance) from ci) * 100', 6)} as cumulative_importance_pct
from ci""", CM, CI))
def cumulative_importance_q(spark, sf_dir):
    """Cumulative importance and % over |corr| importances."""
    return L.cumulative_importance(corr_imp(spark, sf_dir))


@query("topk_features", psql("select feature, importance from ci order by importance desc, feature limit 10",
                             CM, CI))
def topk_features_q(spark, sf_dir):
    """L4: top-10 features by importance."""
    return L.topk(corr_imp(spark, sf_dir), 10)


@query("rf_importance")
def rf_importance_q(spark, sf_dir):
    """M2: random-forest importances with target profit_margin (the default
    target resolves to it) and cumulative importance."""
    return L.rf_importance(frame(spark, sf_dir), "profit_margin", FEATS)


@query("linear_forecast")
def linear_forecast_q(spark, sf_dir):
    """M4: standardised linear regression, holdout predictions."""
    p, _ = linear_model(spark, sf_dir)
    return p


@query("rf_forecast")
def rf_forecast_q(spark, sf_dir):
    """M5: random forest (200 trees, min 2 per leaf), holdout predictions."""
    p, _ = rf_model(spark, sf_dir)
    return p


def linear_model(spark, sf_dir):
    """Phase artifact: fitted linear model + its holdout predictions."""
    def build():
        _, _, _, _, sp = setup(spark, sf_dir)
        return L.linear_forecast(sp, FEATS)
    return remember(spark, f"linear|{sf_dir}", build)


def rf_model(spark, sf_dir):
    """Phase artifact: fitted forest + its holdout predictions."""
    def build():
        _, _, _, _, sp = setup(spark, sf_dir)
        return L.rf_forecast(sp, FEATS)
    return remember(spark, f"rf|{sf_dir}", build)


def candidate_forest(spark, sf_dir):
    """Phase artifact: the champion's forest candidate (300 trees)."""
    def build():
        _, _, _, _, sp = setup(spark, sf_dir)
        return L.rf_forecast(sp, FEATS, L.RF_CANDIDATE)
    return remember(spark, f"rf300|{sf_dir}", build)


def all_predictions(spark, sf_dir):
    """Holdout predictions of every benchmark model (checkpointed once)."""
    def build():
        _, _, _, _, sp = setup(spark, sf_dir)
        lin, _ = linear_model(spark, sf_dir)
        rf, _ = rf_model(spark, sf_dir)
        return fc.predictions(sp).unionByName(lin).unionByName(rf)
    return remember(spark, f"allpred|{sf_dir}", build)


@query("benchmark_table")
def benchmark_table_q(spark, sf_dir):
    """M7: metrics of NaiveLast / NaiveMean / LinearTrend / Linear / RF."""
    return fc.regression_metrics(all_predictions(spark, sf_dir))


@query("ensemble_avg")
def ensemble_avg_q(spark, sf_dir):
    """Average of the linear and forest predictions as an extra benchmark row."""
    p = all_predictions(spark, sf_dir).filter(F.col("model").isin("LinearRegression", "RandomForest"))
    e = p.groupBy("ticker", "date").agg(F.first("actual").alias("actual"),
                                       F.avg("predicted").alias("predicted"))
    return fc.regression_metrics(e.withColumn("model", F.lit("LinearForestAverage")))


def _solved(name: str, source: str, z: str, size: int, by: str = "") -> str:
    """CTEs that solve least squares by elimination; `z`: a list (features, target) of `size`
    per row of `source`.  A feature that the ones before it determine gets weight 0.
    `name`: (by, b, mean), the weights and all means."""
    k, g = (f"{by}, " if by else ""), (f" group by {by}" if by else "")
    cov = ", ".join("[" + ", ".join(f"sum(z[{i}] * z[{j}]) - sum(z[{i}]) * sum(z[{j}]) / count(*)" for j in range(1, size + 1))
                    + "]" for i in range(1, size))
    mean = ", ".join(f"avg(z[{i}])" for i in range(1, size + 1))
    return f"""{name}_z as (select {k}{z} as z from {source}),
{name}_g as (select {k}[{cov}] as m, [{mean}] as mean from {name}_z{g}),
{name}_e as (select {k}1 as k, m, list_transform(m, lambda r, i: r[i]) as d, mean from {name}_g
  union all
  select {k}k + 1, list_transform(m, lambda r, i: case when i = k or m[k][k] <= 1e-9 * d[k] then r else
    list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) end), d, mean from {name}_e where k < {size}),
{name} as (select {k}list_transform(m, lambda r, i: case when r[i] <= 1e-9 * d[i] then 0.0 else r[{size}] / r[i] end) as b, mean
           from {name}_e where k = {size})"""


def _fitted_sql(x: str, size: int) -> str:
    """The prediction for a list of features under the weights b and means of `_solved`."""
    return f"(mean[{size}] + list_sum(list_transform({x}, lambda v, i: b[i] * (v - mean[i]))))"


#: Metrics of fits that two solvers reach by different roads, compared to seven digits.
SMOOTH = ("mae", "rmse", "r2", "residual_mean", "residual_std", "residual_min", "residual_max")


def _strategy_sql() -> str:
    from ledgerline.plans.forecast_queries import _met, fsql
    x = "[" + ", ".join(FEATS) + "]"
    corr = " union all ".join(f"select {i} as i, '{c}' as f, abs(corr({c}, target)) as r from trn" for i, c in enumerate(FEATS, 1))
    size, top = len(FEATS) + 1, f"list_transform(sel, lambda i: {x}[i])"
    return "with recursive" + fsql(f"""
, trn as (select * from sp where split = 'train'),
best as (select list(i order by r desc, f) as sel from (select * from ({corr}) q order by r desc nulls last, f limit 5) t),
{_solved('lg', 'trn', f'list_concat({x}, [target])', size)},
{_solved('la', 'trn', f'list_concat({x}, [net_income_next])', size)},
{_solved('lt', 'trn, best', f'list_concat({top}, [target])', 6)},
stp as (
  select 'LinearGrowth' as model, target as actual, {_fitted_sql(x, size)} as predicted from sp, lg where split = 'test'
  union all select 'LinearAbsolute', target, ({_fitted_sql(x, size)} - net_income) / nullif(net_income, 0) * 100
    from sp, la where split = 'test'
  union all select 'LinearTop5', target, {_fitted_sql(top, 6)} from sp, lt, best where split = 'test'),
smet as ({_met('stp')})
select model, {', '.join(f'{RS(c, 7)} as {c}' for c in SMOOTH)}, test_size from smet""").removeprefix("with")


@query("strategy_linear", _strategy_sql())
def strategy_linear_q(spark, sf_dir):
    """The linear strategies on one scale (growth in percent): growth target,
    absolute target, top-5 features."""
    _, _, _, _, sp = setup(spark, sf_dir)
    m = fc.regression_metrics(L.strategy_predictions(sp, FEATS))
    return m.select("model", *[rnd_sig(c, 7).alias(c) for c in SMOOTH], "test_size")


@query("strategy_comparison")
def strategy_comparison_q(spark, sf_dir):
    """All strategies ranked by R²: the linear ones, the forest, and the
    average of the linear and the forest predictions."""
    _, _, _, _, sp = setup(spark, sf_dir)
    p = all_predictions(spark, sf_dir).filter(F.col("model").isin("LinearRegression", "RandomForest"))
    mean = p.groupBy("ticker", "date").agg(F.first("actual").alias("actual"), F.avg("predicted").alias("predicted"))
    preds = L.strategy_predictions(sp, FEATS).unionByName(p.filter(F.col("model") == "RandomForest")) \
        .unionByName(mean.withColumn("model", F.lit("LinearForestAverage")))
    return fc.champion(fc.regression_metrics(preds))


def trained_metrics(sp, linear, forest):
    """Holdout metrics of the trained candidates, NaiveMean and the NaiveLast benchmark."""
    naive = fc.naive_last(sp).unionByName(fc.naive_mean(sp))
    return fc.one_row_each(fc.regression_metrics(naive.unionByName(linear).unionByName(forest)))


def trained_future(std, sp, linear_model, forest_model):
    """Predictions of a named candidate for every ticker's future row."""
    def predict(model):
        if model == "NaiveMean":
            return fc.model_future_predictions(sp, std.select("ticker").distinct(), model)
        future = fc.future_rows(std, FEATS).withColumn("split", F.lit("future"))
        if model == "LinearRegression":
            rows = L.standardized_split(future, FEATS, L.train_moments(sp, FEATS))
            return linear_model.transform(L.assemble(rows.dropna(subset=FEATS), FEATS)).select(
                "ticker", F.col("prediction").alias("pred"))
        return forest_model.transform(L.assemble(future.dropna(subset=FEATS), FEATS)).select(
            "ticker", F.col("prediction").alias("pred"))
    return predict


def trained_forecast(spark, sf_dir):
    """Phase artifact: forecast rows and metrics under the trained champion."""
    def build():
        std, ppy, h, eff, sp = setup(spark, sf_dir)
        (lin, lin_m), (rf, rf_m) = linear_model(spark, sf_dir), candidate_forest(spark, sf_dir)
        met = trained_metrics(sp, lin, rf)
        pri = fc.merge_priors(fc.recent_prior(sp), fc.level_prior(std, h))
        out = fc.forecast_gap(std, sp, met, pri, eff, h=h, future=trained_future(std, sp, lin_m, rf_m))
        return out.checkpoint(eager=True), met
    from ledgerline.session import shared_dir
    shared_dir(spark)
    return remember(spark, f"trained|{sf_dir}", build)


@query("forecast_all")
def forecast_all_q(spark, sf_dir):
    """The champion of LinearRegression, RandomForest and NaiveMean, its
    reliability, and every ticker's forecast by it, blended with the prior."""
    out, met = trained_forecast(spark, sf_dir)
    return out.withColumn("overall_champion", F.lit(champion_name(met)))


def champion_name(met) -> str:
    return fc.champion(met).filter(F.col("rank") == 1).select("model").first()["model"]


def _cv_sql() -> str:
    from ledgerline.plans.forecast_queries import _met, fsql
    x = "[" + ", ".join(FEATS) + "]"
    return "with recursive" + fsql(f"""
, tdp as (select date, row_number() over (order by date) as k, count(*) over () as n_dates
          from (select distinct date from sp where split = 'train') d),
par as (select least(5, greatest(2, cast(floor((select count(*) from sp where split = 'train') / 6) as integer))) as ns),
fz as (select tdp.*, ns, cast(floor(n_dates / (ns + 1)) as integer) as size, unnest(range(0, ns)) as fold
       from tdp, par),
fo as (select cast(fold as bigint) as fold, date,
         case when k < n_dates - (ns - fold) * size + 1 then 'train' else 'test' end as role
       from fz where k < n_dates - (ns - fold) * size + 1 + size),
cd as (select f.fold, s.ticker, s.date, s.target, {', '.join('s.' + c for c in FEATS)}, case when f.role = 'train' then 'train' else 'test' end as split
       from sp s join fo f on s.date = f.date where s.split = 'train'),
cmn as (select fold, avg(target) as mt from cd where split = 'train' group by fold),
cx as (select cd.*, cmn.mt, lag(target) over (partition by cd.fold, ticker order by date) as prev,
         row_number() over (partition by cd.fold, ticker order by date) - 1 as idx
       from cd left join cmn on cd.fold = cmn.fold),
cf as (select fold, ticker, regr_slope(target, idx) as slope, regr_intercept(target, idx) as icpt, count(*) as n
       from cx where split = 'train' group by fold, ticker),
cp as (select fold, 'NaiveLast' as model, ticker, date, target as actual, coalesce(prev, mt) as predicted
       from cx where split = 'test'
       union all select fold, 'NaiveMean', ticker, date, target, mt from cx where split = 'test'
       union all select x.fold, 'LinearTrend', x.ticker, x.date, x.target,
         case when cf.n >= 2 then cf.icpt + cf.slope * x.idx else x.mt end
       from cx x left join cf on x.fold = cf.fold and x.ticker = cf.ticker where x.split = 'test'),
{_solved('cl', "cd where split = 'train'", f'list_concat({x}, [target])', len(FEATS) + 1, 'fold')},
cpl as (select cd.fold, 'LinearRegression' as model, ticker, date, target as actual,
          {_fitted_sql(x, len(FEATS) + 1)} as predicted
        from cd join cl on cd.fold = cl.fold where cd.split = 'test'),
cpa as (select * from cp union all select * from cpl),
cmet as ({_met("cpa", "fold, model")})
select model, {RS('avg(mae)', 8)} as cv_mae_mean, {RS('stddev_pop(mae)', 8)} as cv_mae_std,
  {RS('avg(rmse)', 8)} as cv_rmse_mean, {RS('stddev_pop(rmse)', 8)} as cv_rmse_std,
  {RS('avg(r2)', 8)} as cv_r2_mean, {RS('stddev_pop(r2)', 8)} as cv_r2_std, count(*) as folds
from cmet group by model""").removeprefix("with")


@query("cv_summary", _cv_sql())
def cv_summary_q(spark, sf_dir):
    """Mean / population σ of fold metrics of the deterministic models and
    of LinearRegression, whose folds are fitted from one pass over the rows."""
    _, _, _, _, sp = setup(spark, sf_dir)
    folds = fc.ts_folds(sp)
    preds = fc.fold_predictions(fc.fold_rows(sp, folds))
    return fc.cv_summary(preds.unionByName(L.linear_fold_predictions(sp, folds, FEATS)))


@query("cv_forest")
def cv_forest_q(spark, sf_dir):
    """The same summary for RandomForest, fitted by MLlib in every fold."""
    from ledgerline.session import shared_dir
    shared_dir(spark)
    _, _, _, _, sp = setup(spark, sf_dir)
    return fc.cv_summary(L.forest_fold_predictions(sp, fc.ts_folds(sp), FEATS))


def linear_attributions(spark, sf_dir):
    """Phase artifact: exact linear attributions of every future row."""
    def build():
        std, _, _, _, sp = setup(spark, sf_dir)
        _, m = linear_model(spark, sf_dir)
        fut = fc.future_rows(std, FEATS)
        return L.shapley_linear(m, sp, fut, FEATS)
    return remember(spark, f"linshap|{sf_dir}", build)


@query("shapley_linear")
def shapley_linear_q(spark, sf_dir):
    """M15 (exact, linear model): φ per ticker and feature on future rows."""
    return linear_attributions(spark, sf_dir)


def forest_attributions(spark, sf_dir):
    """Phase artifact: exact attributions of every future row under the forest."""
    def build():
        std, _, _, _, sp = setup(spark, sf_dir)
        _, m = rf_model(spark, sf_dir)
        return shapley_forest(m, fc.future_rows(std, FEATS), FEATS)
    return remember(spark, f"rfshap|{sf_dir}", build)


def explain(model_name, std, sp, linear, forest):
    """Attributions of every future row under the named candidate, with its name:
    exact for both learners; NaiveMean has no drivers, so each value is 0."""
    fut = fc.future_rows(std, FEATS)
    if model_name == "LinearRegression":
        phi = L.shapley_linear(linear, sp, fut, FEATS).withColumnRenamed("feature_value_scaled", "feature_value")
    elif model_name == "RandomForest":
        phi = shapley_forest(forest, fut, FEATS)
    else:
        mean = F.lit(fc.fitted(sp.filter(F.col("split") == "train").agg(F.avg("target"))))
        phi = fut.select("ticker", mean.alias("predicted_growth_rate"), mean.alias("base_value"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).alias("feature_value"), F.lit(0.0).alias("shap_value"))
            for c in FEATS])))
    return phi.select("ticker", F.lit(model_name).alias("model"), "predicted_growth_rate", "base_value", "feature",
                      "feature_value", "shap_value")


def champion_attributions(spark, sf_dir):
    """Phase artifact: attributions of every future row under the model that made
    the forecast (the trained champion)."""
    def build():
        std, _, _, _, sp = setup(spark, sf_dir)
        (_, lin_m), (_, rf_m) = linear_model(spark, sf_dir), candidate_forest(spark, sf_dir)
        _, met = trained_forecast(spark, sf_dir)
        return explain(champion_name(met), std, sp, lin_m, rf_m)
    return remember(spark, f"champshap|{sf_dir}", build)


@query("shapley_sampled")
def shapley_sampled_q(spark, sf_dir):
    """M15 (forest): Shapley values of every future row, exact over the trees'
    leaves; the key keeps the survey's name, nothing is sampled any more."""
    return forest_attributions(spark, sf_dir).select("ticker", "feature", "shap_value")


@query("shapley_forest")
def shapley_forest_q(spark, sf_dir):
    """M15 (forest): the same with the base value and the prediction they add up to."""
    return forest_attributions(spark, sf_dir)


@query("shap_global")
def shap_global_q(spark, sf_dir):
    """Mean |φ| per feature over all explained rows."""
    return L.shap_global(forest_attributions(spark, sf_dir))


@query("shap_local")
def shap_local_q(spark, sf_dir):
    """Top-8 drivers per ticker with direction, of the champion."""
    return L.shap_local(champion_attributions(spark, sf_dir))


@query("drivers_sorted")
def drivers_sorted_q(spark, sf_dir):
    """Drivers of each ticker's forecast, by the model that made it."""
    phi = champion_attributions(spark, sf_dir)
    return phi.select("ticker", "model", "feature", rnd("shap_value", 8).alias("shap_value"))


@query("seeded_sample", with_std(f"""select {", ".join(STANDARD_COLUMNS)}, sector from std
order by md5(ticker || '|' || strftime(date, '%Y-%m-%d') || '|42'), ticker, date limit 30"""))
def seeded_sample_q(spark, sf_dir):
    """Deterministic sample of 30 rows of the standard table (a
    sampling operator: the size is the feature)."""
    std = standard_table(spark, sf_dir).withColumn(
        "_k", F.concat_ws("|", "ticker", F.col("date").cast("string")))
    return L.seeded_sample(std, 30, "_k").drop("_k")


@query("basic_importance", psql("""select feature_2 as feature, abs(correlation) as importance from cm
where feature_1 = 'net_income' and feature_2 <> 'net_income' and correlation is not null
order by importance desc, feature limit 8""", CM))
def basic_importance_q(spark, sf_dir):
    """Fallback importance = |corr| with net income, top 8."""
    return L.topk(corr_imp(spark, sf_dir), 8)


@query("upload_analysis")
def upload_analysis_q(spark, sf_dir):
    """Upload -> normalise -> validate -> train on all valid uploads,
    forecast and explain each or, where validation fails, the basic forecast
    fallback — chosen per ticker by a data predicate, not by an exception."""
    from ledgerline.functions.parsing import clean_ticker
    from ledgerline.operators import validate
    from ledgerline.plans.ingest_queries import normalized
    from ledgerline.session import shared_dir
    from ledgerline.sources.panel import MEASURES, engineer_features
    up = normalized(spark, sf_dir, "true_ticker").select(
        F.coalesce(clean_ticker("ticker"), F.upper("true_ticker")).alias("ticker"), "date", *MEASURES)
    up = up.filter(F.col("ticker").isNotNull() & F.col("date").isNotNull())
    # the validated upload table is a stored artifact (read by three branches)
    shared_dir(spark)
    eng = engineer_features(up).checkpoint()
    issues = validate.validate_features(eng)
    bad = issues.filter(F.col("severity") == "CRITICAL").select(F.col("batch").alias("ticker")).distinct()
    good = eng.join(bad, "ticker", "left_anti").checkpoint()
    sp = fc.time_split(fc.supervised_set(good, 1)).checkpoint()
    lin, lin_m = L.linear_forecast(sp, FEATS)
    rf, rf_m = L.rf_forecast(sp, FEATS, L.RF_CANDIDATE, parts=L.even_parts)
    met = trained_metrics(sp, lin, rf)
    pri = fc.merge_priors(fc.recent_prior(sp), fc.level_prior(good, 1))
    ppy = fc.base_periods_per_year(good)
    h = fc.horizon_py(ppy)
    fg = fc.forecast_gap(good, sp, met, pri, max(1.0, ppy / max(1, h)), h=h,
                         future=trained_future(good, sp, lin_m, rf_m))
    drivers = L.shap_local(explain(champion_name(met), good, sp, lin_m, rf_m), 3) \
        .groupBy("ticker").agg(F.first("model").alias("drivers_of"),
                               F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("d")) \
        .select("ticker", "drivers_of", F.expr("transform(d, x -> x.feature)").alias("top_drivers"))
    path = fg.join(drivers, "ticker", "left").select(
        "ticker", F.lit("model").alias("path"), "selected_model", "predicted_growth_rate",
        "model_reliability", "drivers_of", "top_drivers")
    fb = fc.basic_forecast(eng.join(bad, "ticker", "left_semi")) \
        .select("ticker", F.lit("basic_forecast").alias("path"), "predicted_growth_rate")
    return path.unionByName(fb, allowMissingColumns=True)
