"""Forecast set-up and evaluation (M1, M6, M8-M11, M13, W13-W17, A25, A27,
A29-A30, F5-F8, C39, C41).

Design
------
* frequency, priors, naive forecasts and the per-ticker trend model are
  per-ticker windows / aggregates (co-partitioned on a ticker-bucketed table);
* the chronological split works on the *distinct dates* (bounded by the
  calendar, so the one ordered window over them is small); the cutoff and
  the training mean are fitted scalars applied as literals — no join
  fan-out, no cross join, no repeated subquery;
* metrics are one ``groupBy(model)`` over the stacked predictions;
* model constants below are fixed values of the reference behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import as_long, col_, rnd, rnd_sig
from ledgerline.operators.profile import FEATURE_COLS, grouped_quantiles


def fitted(df: DataFrame):
    """First value of a one-row, one-column result (a fitted scalar such as
    a cutoff date or a training mean), applied downstream as a literal."""
    row = df.first()
    return None if row is None else row[0]


def one_row_each(metrics: DataFrame) -> DataFrame:
    """Metrics (one row per model by construction) as a local relation, so that
    their consumers do not run the models again."""
    return metrics.sparkSession.createDataFrame(metrics.collect(), metrics.schema)


# The benchmark that sees earlier test actuals; it is no candidate.
BENCHMARK_ONLY = ("NaiveLast",)

TARGET_COL = "net_income"
TEST_RATIO = 0.2
DEFAULT_TARGET_GROWTH = 10.0     # annual target growth, percent
RECENT_LOOKBACK = 6
RECENT_WEIGHT = 0.4
CI_Z = 1.96

# ------------------------------------------------------------ frequency


def periods_from_gap(days) -> Column:
    """A27 bins: median day gap -> periods per year."""
    d = col_(days)
    return (F.when(d <= 2, 365.0).when(d <= 8, 52.0).when(d <= 16, 24.0).when(d <= 45, 12.0)
            .when(d <= 120, 4.0).when(d <= 240, 2.0).otherwise(1.0))


def day_gaps(df: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    w = Window.partitionBy(key).orderBy(date)
    return df.select(key, F.datediff(F.col(date), F.lag(date).over(w)).alias("gap")) \
        .filter(F.col("gap").isNotNull())


def infer_frequency(df: DataFrame, key: str = "ticker", date: str = "date") -> DataFrame:
    """A27 per entity: median gap between consecutive dates (per-entity
    gaps, never pooled across entities) -> periods/year, label, horizon."""
    g = day_gaps(df, key, date)
    med = g.groupBy(key).agg(F.percentile("gap", 0.5).alias("median_gap_days"))
    allk = df.select(key).distinct()
    out = allk.join(med, key, "left")
    ppy = F.when(F.col("median_gap_days").isNull(), F.lit(1.0)) \
        .otherwise(periods_from_gap("median_gap_days"))
    out = out.withColumn("periods_per_year", ppy)
    h = horizon(F.col("periods_per_year"))
    return out.select(key, "median_gap_days", "periods_per_year",
                      period_label("periods_per_year").alias("period_type"),
                      h.alias("horizon"),
                      effective_periods("periods_per_year", h).alias("effective_periods_per_year"))


def base_periods_per_year(df: DataFrame, key: str = "ticker", date: str = "date") -> float:
    """One frequency for a pooled model: median of all per-entity gaps
    (exact distributed quantile; a single number reaches the driver)."""
    g = day_gaps(df, key, date).select(F.lit("all").alias("k"), F.col("gap").cast("double"))
    row = grouped_quantiles(g, "k", "gap", [0.5]).select("q").first()
    if row is None or row["q"] is None:
        return 1.0
    d = row["q"]
    for lim, p in ((2, 365.0), (8, 52.0), (16, 24.0), (45, 12.0), (120, 4.0), (240, 2.0)):
        if d <= lim:
            return p
    return 1.0


def horizon(ppy) -> Column:
    """forecast horizon 30 / 4 / 3 / 1 periods by frequency."""
    p = col_(ppy)
    return F.when(p >= 300, 30).when(p >= 48, 4).when(p >= 10, 3).otherwise(1)


def horizon_py(ppy: float) -> int:
    return 30 if ppy >= 300 else 4 if ppy >= 48 else 3 if ppy >= 10 else 1


def effective_periods(ppy, h) -> Column:
    """max(1, periods / horizon)."""
    return F.greatest(F.lit(1.0), col_(ppy) / F.greatest(F.lit(1), col_(h)))


def period_label(ppy) -> Column:
    """daily / weekly / monthly / quarterly / yearly from round(periods)."""
    r = F.round(col_(ppy))
    return (F.when(r >= 300, "daily").when(r >= 48, "weekly").when(r >= 10, "monthly")
            .when(r >= 3, "quarterly").otherwise("yearly"))


def annual_to_period(annual_pct, ppy) -> Column:
    """((1 + a)^(1/p) - 1) * 100; unchanged when p <= 0."""
    a, p = col_(annual_pct), col_(ppy)
    return F.when(p <= 0, a).otherwise((F.pow(1.0 + a / 100.0, 1.0 / p) - 1.0) * 100.0)


def period_to_annual(period_pct, ppy) -> Column:
    """((1 + g)^p - 1) * 100, floored at -100 when g <= -99.99 %."""
    g, p = col_(period_pct), col_(ppy)
    return (F.when(p <= 0, g).when(g / 100.0 <= -0.9999, F.lit(-100.0))
            .otherwise((F.pow(1.0 + g / 100.0, p) - 1.0) * 100.0))


def periods_from_targets(period_pct, annual_pct) -> Column:
    """F8: periods/year implied by a period and an annual growth,
    log1p(a)/log1p(p) clamped to [1, 365]; NULL when not defined."""
    p, a = col_(period_pct) / 100.0, col_(annual_pct) / 100.0
    ok = (p > -1) & (a > -1) & (p != 0)
    val = F.log1p(a) / F.log1p(p)
    return F.when(ok & (val > 0), F.least(F.lit(365.0), F.greatest(F.lit(1.0), val)))


# ------------------------------------------------------------ supervised set


def supervised_set(std: DataFrame, h: int = 1, target_col: str = TARGET_COL,
                   features=FEATURE_COLS) -> DataFrame:
    """target = growth % of ``target_col`` ``h`` periods ahead; rows
    with a NULL target or any NULL feature are dropped (zero bases give a
    NULL target, never ±inf)."""
    w = Window.partitionBy("ticker").orderBy("date")
    nxt = F.lead(target_col, h).over(w)
    cur = F.col(target_col)
    d = std.select("ticker", "date", *features,
                   nxt.alias(f"{target_col}_next"),
                   ((nxt - cur) / F.nullif(cur, F.lit(0.0)) * 100).alias("target"))
    return d.dropna(subset=["target", *features])


def future_rows(std: DataFrame, features=FEATURE_COLS) -> DataFrame:
    """M1 future rows: the latest row per ticker, missing features -> 0."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    last = std.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    return last.select("ticker", "date", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                                           for c in features])


# ------------------------------------------------------------ split and folds


def date_positions(sup: DataFrame) -> DataFrame:
    """Distinct dates with their 1-based position and the total count.
    The input is bounded by the calendar (one row per period), so the
    unpartitioned ordered window here is small by construction."""
    d = sup.select("date").distinct()
    return d.select("date", F.row_number().over(Window.orderBy("date")).alias("k"),
                    F.count(F.lit(1)).over(Window.partitionBy()).alias("n_dates"))


def cutoff_date(sup: DataFrame, test_ratio: float = TEST_RATIO) -> Column:
    """W16 cutoff (a fitted scalar, applied as a literal): dates[split - 1] with
    split = min(max(1, int(n * (1 - ratio))), n - 1)."""
    dp = date_positions(sup)
    split = F.least(F.greatest(F.lit(1), F.floor(F.col("n_dates") * (1 - test_ratio)).cast("int")),
                    F.col("n_dates") - 1)
    return F.lit(fitted(dp.filter(F.col("k") == split).select("date")))


def time_split(sup: DataFrame, test_ratio: float = TEST_RATIO) -> DataFrame:
    """split = train (date <= cutoff) / test."""
    cut = cutoff_date(sup, test_ratio)
    return sup.withColumn("split", F.when(F.col("date") <= cut, "train").otherwise("test"))


def ts_folds(split_df: DataFrame, max_splits: int = 5) -> DataFrame:
    """Expanding-window folds over the distinct training dates:
    n_splits = min(5, max(2, n_train_rows // 6)); test block size
    = D // (n_splits + 1); fold f tests date positions
    [D - (n_splits - f)·size, D - (n_splits - f - 1)·size) and trains on
    all earlier dates.  Output (fold, date, role)."""
    train = split_df.filter(F.col("split") == "train")
    n_rows = F.lit(fitted(train.agg(F.count(F.lit(1)))))
    dp = date_positions(train)
    ns = F.least(F.lit(max_splits), F.greatest(F.lit(2), F.floor(n_rows / 6).cast("int")))
    dp = dp.withColumns({"ns": ns, "size": F.floor(F.col("n_dates") / (ns + 1)).cast("int")})
    folds = dp.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)))
    start = F.col("n_dates") - (F.col("ns") - F.col("fold")) * F.col("size") + 1
    end = start + F.col("size")
    role = F.when(F.col("k") < start, "train").when(F.col("k") < end, "test")
    return folds.select(as_long("fold").alias("fold"), "date", role.alias("role")) \
        .filter(F.col("role").isNotNull())


# ------------------------------------------------------------ deterministic models


def _test_with_history(split_df: DataFrame) -> DataFrame:
    return split_df.select("ticker", "date", "target", "split")


def naive_last(split_df: DataFrame) -> DataFrame:
    """Previous realised target of the same ticker (train history then
    earlier test rows); a ticker without history gets the train mean."""
    w = Window.partitionBy("ticker").orderBy("date")
    mean_train = F.lit(fitted(split_df.filter(F.col("split") == "train").agg(F.avg("target"))))
    d = split_df.select("ticker", "date", "target", "split",
                        F.lag("target").over(w).alias("prev"))
    return d.filter(F.col("split") == "test").select(
        F.lit("NaiveLast").alias("model"), "ticker", "date", F.col("target").alias("actual"),
        F.coalesce(F.col("prev"), mean_train).alias("predicted"))


def naive_mean(split_df: DataFrame) -> DataFrame:
    """M6: the training mean for every test row."""
    mean_train = F.lit(fitted(split_df.filter(F.col("split") == "train").agg(F.avg("target"))))
    return split_df.filter(F.col("split") == "test").select(
        F.lit("NaiveMean").alias("model"), "ticker", "date", F.col("target").alias("actual"),
        mean_train.alias("predicted"))


def trend_fit(split_df: DataFrame) -> DataFrame:
    """Per-ticker OLS of the training targets on the period index."""
    w = Window.partitionBy("ticker").orderBy("date")
    d = split_df.withColumn("idx", F.row_number().over(w) - 1)
    fit = d.filter(F.col("split") == "train").groupBy("ticker").agg(
        F.regr_slope("target", "idx").alias("slope"),
        F.regr_intercept("target", "idx").alias("intercept"),
        F.count(F.lit(1)).alias("n_train"))
    return d, fit


def linear_trend(split_df: DataFrame) -> DataFrame:
    """Per-ticker linear trend of the growth target (train rows); tickers
    with fewer than two training rows fall back to the training mean."""
    mean_train = F.lit(fitted(split_df.filter(F.col("split") == "train").agg(F.avg("target"))))
    d, fit = trend_fit(split_df)
    t = d.filter(F.col("split") == "test").join(fit, "ticker", "left")
    pred = F.when(F.col("n_train") >= 2, F.col("intercept") + F.col("slope") * F.col("idx")) \
        .otherwise(mean_train)
    return t.select(F.lit("LinearTrend").alias("model"), "ticker", "date",
                    F.col("target").alias("actual"), pred.alias("predicted"))


def predictions(split_df: DataFrame) -> DataFrame:
    return naive_last(split_df).unionByName(naive_mean(split_df)) \
        .unionByName(linear_trend(split_df))


# ------------------------------------------------------------ metrics and selection


def regression_metrics(preds: DataFrame, by="model") -> DataFrame:
    """MAE, RMSE, R² (NULL when n < 2; 1 - SSE/SST with SST = 0 giving
    1.0 for a perfect fit and 0.0 otherwise), residual mean / population σ /
    min / max, test size."""
    by = [by] if isinstance(by, str) else list(by)
    r = F.col("actual") - F.col("predicted")
    g = preds.groupBy(*by).agg(
        F.avg(F.abs(r)).alias("mae"), F.avg(r * r).alias("mse"), F.sum(r * r).alias("sse"),
        (F.var_pop("actual") * F.count(F.lit(1))).alias("sst"),
        F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"),
        F.min(r).alias("residual_min"), F.max(r).alias("residual_max"),
        F.count(F.lit(1)).alias("test_size"))
    r2 = (F.when(F.col("test_size") < 2, F.lit(None).cast("double"))
          .when(F.col("sst") == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("sse") / F.col("sst")))
    return g.select(*by, rnd("mae", 6).alias("mae"), rnd(F.sqrt("mse"), 6).alias("rmse"),
                    rnd(r2, 6).alias("r2"), rnd("residual_mean", 6).alias("residual_mean"),
                    rnd("residual_std", 6).alias("residual_std"),
                    rnd("residual_min", 6).alias("residual_min"),
                    rnd("residual_max", 6).alias("residual_max"),
                    as_long("test_size").alias("test_size"))


def champion(metrics: DataFrame) -> DataFrame:
    """M8: rank the candidates by R² (NULL last) then MAE; rank 1 is the champion.
    One row per model — the unpartitioned window is over the handful of
    candidate models."""
    w = Window.orderBy(F.col("r2").desc_nulls_last(), F.col("mae").asc(), F.col("model"))
    return metrics.filter(~F.col("model").isin(*BENCHMARK_ONLY)).select("model", "r2", "mae", "rmse",
                          F.row_number().over(w).cast("bigint").alias("rank"))


def reliability(metrics: DataFrame, champion_model: Column | None = None) -> DataFrame:
    """M9: reliability ladder for the champion + beats-naive + best benchmark."""
    metrics = one_row_each(metrics)
    ch = champion(metrics).filter(F.col("rank") == 1).select("model")
    m = metrics.join(ch, "model")
    naive_mae = F.lit(fitted(metrics.filter(F.col("model") == "NaiveLast").select("mae")))
    best = F.lit(fitted(metrics.agg(F.min_by("model", F.struct("mae", "model")))))
    beats = F.coalesce(F.col("mae") <= naive_mae, F.lit(False))
    r2 = F.col("r2")
    status = (F.when(F.col("test_size") < 8, "Low").when(r2.isNull(), "Low")
              .when(r2 < 0.2, "Low").when(~beats, "Low").when(r2 >= 0.5, "High")
              .otherwise("Medium"))
    reason = (F.when(F.col("test_size") < 8, "insufficient_holdout_samples")
              .when(r2.isNull(), "invalid_r2").when(r2 < 0.2, "r2_below_threshold")
              .when(~beats, "does_not_beat_naive").when(r2 >= 0.5, "strong_fit_and_beats_naive")
              .otherwise("adequate_fit_and_beats_naive"))
    return m.select(F.col("model").alias("selected_model"), "r2", "mae", "test_size",
                    "residual_std", status.alias("model_reliability"),
                    reason.alias("model_reliability_reason"), beats.alias("beats_naive"),
                    naive_mae.alias("naive_mae"), best.alias("best_benchmark_model"))


def blend_weight(r2) -> Column:
    """clamp(0.35 + 0.45·R², 0.35, 0.85); NULL R² -> 0.85."""
    r = col_(r2)
    return F.when(r.isNull(), F.lit(0.85)).otherwise(
        F.greatest(F.lit(0.35), F.least(F.lit(0.85), 0.35 + 0.45 * r)))


# ------------------------------------------------------------ priors


def recent_prior(split_df: DataFrame, lookback: int = RECENT_LOOKBACK) -> DataFrame:
    """Median of the last max(2, lookback) training targets per ticker
    (upper-cased).  Each group holds at most ``lookback`` values."""
    k = max(2, int(lookback))
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    t = split_df.filter(F.col("split") == "train").withColumn("_rn", F.row_number().over(w)) \
        .filter(F.col("_rn") <= k)
    return t.groupBy(F.upper("ticker").alias("ticker")).agg(
        F.percentile("target", 0.5).alias("recent_prior"))


def level_prior(std: DataFrame, h: int = 1, target_col: str = TARGET_COL) -> DataFrame:
    """Compounded first -> last growth of the level projected ``h``
    steps: needs >= 3 points and both ends > 0."""
    d = std.filter(F.col(target_col).isNotNull())
    g = d.groupBy(F.upper("ticker").alias("ticker")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(target_col, "date").alias("first"),
        F.max_by(target_col, "date").alias("last"))
    steps = F.col("n") - 1
    per = F.pow(F.col("last") / F.col("first"), 1.0 / steps) - 1.0
    val = (F.pow(1.0 + per, F.lit(float(max(1, h)))) - 1.0) * 100.0
    return g.filter((F.col("n") >= 3) & (F.col("first") > 0) & (F.col("last") > 0)) \
        .select("ticker", val.alias("level_prior"))


def merge_priors(recent: DataFrame, level: DataFrame, w_recent: float = RECENT_WEIGHT) -> DataFrame:
    """Full outer join; weighted blend when both exist."""
    w = max(0.0, min(1.0, w_recent))
    j = recent.join(level, "ticker", "full_outer")
    r, lv = F.col("recent_prior"), F.col("level_prior")
    prior = (F.when(r.isNotNull() & lv.isNotNull(), w * r + (1.0 - w) * lv)
             .when(r.isNotNull(), r).otherwise(lv))
    return j.select("ticker", "recent_prior", "level_prior", prior.alias("prior"))


# ------------------------------------------------------------ forecast


def model_future_predictions(split_df: DataFrame, fut: DataFrame, model: str) -> DataFrame:
    """Prediction of one deterministic model for the future row of each ticker."""
    mean_train = F.lit(fitted(split_df.filter(F.col("split") == "train").agg(F.avg("target"))))
    if model == "NaiveMean":
        return fut.select("ticker", mean_train.alias("pred"))
    if model == "NaiveLast":
        last = split_df.groupBy("ticker").agg(F.max_by("target", "date").alias("pred"))
        return fut.select("ticker").join(last, "ticker", "left") \
            .select("ticker", F.coalesce("pred", mean_train).alias("pred"))
    d, fit = trend_fit(split_df)
    n_rows = d.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_all"))
    j = fut.select("ticker").join(fit, "ticker", "left").join(n_rows, "ticker", "left")
    pred = F.when(F.col("n_train") >= 2, F.col("intercept") + F.col("slope") * F.col("n_all")) \
        .otherwise(mean_train)
    return j.select("ticker", pred.alias("pred"))


def forecast_gap(std: DataFrame, split_df: DataFrame, metrics: DataFrame,
                 priors: DataFrame, ppy: float, target_annual: float = DEFAULT_TARGET_GROWTH,
                 h: int = 1, future=None) -> DataFrame:
    """Blend the champion's prediction with the prior, gap vs the
    period target, ±1.96σ band, next income, annualised variants.
    ``future`` maps the champion's name to (ticker, pred) rows; without it the
    deterministic models predict."""
    rel = reliability(metrics)
    model = rel.select("selected_model").first()["selected_model"]  # one row
    fut = std.groupBy("ticker").agg(F.max("date").alias("date"),
                                    F.max_by(TARGET_COL, "date").alias("net_income"))
    preds = future(model) if future else model_future_predictions(split_df, fut, model)
    r = rel.first()
    w = blend_weight(F.lit(r["r2"]).cast("double"))
    pr = priors.select(F.col("ticker").alias("_t"), "prior")
    j = fut.join(preds, "ticker").join(pr, F.upper(F.col("ticker")) == F.col("_t"), "left")
    p = F.when(F.col("prior").isNotNull(), w * F.col("pred") + (1.0 - w) * F.col("prior")) \
        .otherwise(F.col("pred"))
    tgt = annual_to_period(F.lit(float(target_annual)), F.lit(float(ppy)))
    sigma = F.lit(r["residual_std"]).cast("double")
    out = j.select("ticker", "date", "net_income", p.alias("p"), tgt.alias("t"))
    return out.select(
        "ticker", "date", F.col("net_income").alias("current_net_income"),
        rnd("p", 6).alias("predicted_growth_rate"), rnd("t", 6).alias("target_growth_rate"),
        rnd(F.col("p") - F.col("t"), 6).alias("gap_vs_target"),
        rnd("p", 6).alias("predicted_growth_rate_period_pct"), rnd("t", 6).alias("target_growth_rate_period_pct"),
        rnd(F.col("p") - F.col("t"), 6).alias("gap_vs_target_period_pct"),
        F.when(F.col("p") - F.col("t") >= 0, "surplus").otherwise("shortfall").alias("gap_status"),
        rnd(F.col("p") - CI_Z * sigma, 6).alias("confidence_lower_95"),
        rnd(F.col("p") + CI_Z * sigma, 6).alias("confidence_upper_95"),
        rnd(F.col("net_income") * (1 + F.col("p") / 100), 4).alias("predicted_next_net_income"),
        rnd(F.col("net_income") * (1 + F.col("t") / 100), 4).alias("target_next_net_income"),
        period_label(F.lit(float(ppy))).alias("period_type"),
        F.lit(float(ppy)).alias("periods_per_year"),
        rnd(period_to_annual("p", F.lit(float(ppy))), 6).alias("predicted_growth_rate_annualized_pct"),
        rnd(period_to_annual("t", F.lit(float(ppy))), 6).alias("target_growth_rate_annualized_pct"),
        rnd(period_to_annual("p", F.lit(float(ppy))) - period_to_annual("t", F.lit(float(ppy))), 6)
        .alias("gap_vs_target_annualized_pct"),
        F.lit(int(h)).cast("bigint").alias("forecast_horizon_periods"),
        F.lit(r["model_reliability"]).alias("model_reliability"),
        F.lit(r["model_reliability_reason"]).alias("model_reliability_reason"),
        F.lit(model).alias("selected_model"),
        F.lit(r["r2"]).cast("double").alias("model_r2"),
        F.lit(r["naive_mae"]).cast("double").alias("benchmark_naive_mae"),
        F.lit(bool(r["beats_naive"])).alias("beats_naive"))


def basic_forecast(std: DataFrame, target: float = 10.0) -> DataFrame:
    """First -> last net income growth as % of |first| (0 when first is
    0; 5.0 with fewer than two rows), gap vs 10, surplus/shortfall."""
    g = std.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"),
                                  F.min_by("net_income", "date").alias("first"),
                                  F.max_by("net_income", "date").alias("last"),
                                  F.max("date").alias("date"))
    growth = (F.when(F.col("n") < 2, F.lit(5.0)).when(F.col("first") == 0, F.lit(0.0))
              .otherwise((F.col("last") - F.col("first")) / F.abs("first") * 100))
    return g.select("ticker", "date", F.col("last").alias("current_net_income"),
                    rnd(growth, 6).alias("predicted_growth_rate"),
                    F.lit(target).alias("target_growth_rate"),
                    rnd(growth - target, 6).alias("gap_vs_target"),
                    F.when(growth - target >= 0, "surplus").otherwise("shortfall").alias("gap_status"))


def prediction_bounds(preds: DataFrame) -> DataFrame:
    """Plot range over actual and predicted values."""
    return preds.groupBy("model").agg(
        rnd(F.least(F.min("actual"), F.min("predicted")), 6).alias("lower"),
        rnd(F.greatest(F.max("actual"), F.max("predicted")), 6).alias("upper"))


def forecast_table(fc: DataFrame, band: float = 10.0) -> DataFrame:
    """Display projection with title-cased names and a ±10 band when
    the model gave no bounds."""
    lo = F.coalesce(F.col("confidence_lower_95"), F.col("predicted_growth_rate") - band)
    hi = F.coalesce(F.col("confidence_upper_95"), F.col("predicted_growth_rate") + band)
    return fc.select(F.col("ticker").alias("Ticker"), F.col("date").alias("Date"),
                     F.col("predicted_growth_rate").alias("Predicted Growth Rate"),
                     F.col("target_growth_rate").alias("Target Growth Rate"),
                     F.col("gap_vs_target").alias("Gap Vs Target"),
                     F.col("gap_status").alias("Gap Status"),
                     rnd(lo, 6).alias("Lower"), rnd(hi, 6).alias("Upper"))


def has_predictions(tickers: DataFrame, fc: DataFrame) -> DataFrame:
    """Per ticker, whether a forecast row exists (case-insensitive),
    for all tickers at once (left semi-join turned into a flag)."""
    keys = fc.select(F.upper("ticker").alias("_t")).distinct().withColumn("_hit", F.lit(True))
    return tickers.join(keys, F.upper(tickers["ticker"]) == keys["_t"], "left") \
        .select("ticker", F.coalesce("_hit", F.lit(False)).alias("has_predictions"))


def fold_predictions(d: DataFrame) -> DataFrame:
    """The three deterministic models evaluated in every fold at once.
    ``d`` = (fold, ticker, date, target, split); every statistic is keyed by
    the fold (per-fold training means are one row per fold)."""
    tr = F.col("split") == "train"
    means = d.filter(tr).groupBy("fold").agg(F.avg("target").alias("_mt"))
    w = Window.partitionBy("fold", "ticker").orderBy("date")
    x = d.join(means, "fold", "left").withColumns({
        "_prev": F.lag("target").over(w), "_idx": F.row_number().over(w) - 1})
    fit = x.filter(tr).groupBy("fold", "ticker").agg(
        F.regr_slope("target", "_idx").alias("_slope"),
        F.regr_intercept("target", "_idx").alias("_icpt"), F.count(F.lit(1)).alias("_n"))
    t = x.filter(~tr).join(fit, ["fold", "ticker"], "left")
    trend = F.when(F.col("_n") >= 2, F.col("_icpt") + F.col("_slope") * F.col("_idx")) \
        .otherwise(F.col("_mt"))
    models = F.array(
        F.struct(F.lit("NaiveLast").alias("model"), F.coalesce("_prev", "_mt").alias("predicted")),
        F.struct(F.lit("NaiveMean").alias("model"), F.col("_mt").alias("predicted")),
        F.struct(F.lit("LinearTrend").alias("model"), trend.alias("predicted")))
    return t.select("fold", "ticker", "date", F.col("target").alias("actual"), F.inline(models))


def fold_rows(split_df: DataFrame, folds: DataFrame) -> DataFrame:
    """The training rows replicated into their folds (a bounded table of fold dates)."""
    rows = split_df.filter(F.col("split") == "train").select("ticker", "date", "target")
    return rows.join(folds, "date").select(
        "fold", "ticker", "date", "target",
        F.when(F.col("role") == "train", "train").otherwise("test").alias("split"))


def cv_summary(preds: DataFrame) -> DataFrame:
    """Per model, mean and population σ of MAE / RMSE / R² over the
    expanding-window folds, from (fold, model, actual, predicted) rows."""
    m = regression_metrics(preds, by=["fold", "model"])
    return m.groupBy("model").agg(
        *[rnd_sig(f(c), 8).alias(f"cv_{c}_{n}") for c in ("mae", "rmse", "r2")
          for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
        F.count(F.lit(1)).alias("folds"))
