"""Time-series operators (T1-T5, W9-W11) on a long (ticker, metric, idx, value) form.

Every window is partitioned by ``ticker`` (plus metric / phase), which a
ticker-bucketed input already satisfies, so no exchange is planned.  OLS fits
use the SQL regression aggregates (``regr_slope``/``regr_intercept``/
``regr_r2``) instead of per-group Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.finance import trend_label
from ledgerline.functions.numeric import as_long, rnd

# Metric sets per report (fixed values: which measures each analysis covers).
DECOMPOSE_METRICS = ("revenue", "net_income", "operating_expenses")
SEASONALITY_METRICS = ("revenue", "net_income", "profit_margin")
SLOPE_METRICS = ("revenue", "net_income", "operating_expenses", "profit_margin")


def long_form(std: DataFrame, metrics, fill_zero: bool = True) -> DataFrame:
    """Unpivot to (ticker, date, metric, value) and add the 0-based position
    ``idx`` of the row in the ticker's date order.  Missing values become 0
    when ``fill_zero`` (the decomposition convention)."""
    base = std.withColumn(
        "operating_expenses",
        F.greatest(F.col("revenue") - F.col("operating_income"), F.lit(0.0)))
    base = base.withColumn("idx", F.row_number().over(
        Window.partitionBy("ticker").orderBy("date")) - 1)
    # explode (Generate) keeps the ticker partitioning of a bucketed input,
    # so the per-(ticker, metric) windows below need no exchange
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in metrics])
    lf = base.select("ticker", "date", "idx", F.inline(pairs))
    if fill_zero:
        lf = lf.withColumn("value", F.coalesce(F.col("value"), F.lit(0.0)))
    return lf


def trend_class(std: DataFrame) -> DataFrame:
    """Revenue / profit / growth trend labels per ticker (tickers with at
    least two rows).  Positions count every row for revenue and profit; the
    growth series is re-indexed after dropping NULL growth."""
    w = Window.partitionBy("ticker").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = std.select(
        "ticker", "date", "revenue", "net_income", "revenue_growth",
        (F.row_number().over(w) - 1).alias("idx"),
        (F.count("revenue_growth").over(run) - 1).alias("gidx"))
    g = df.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("revenue", "idx").alias("rs"), F.avg("revenue").alias("rm"),
        F.count("revenue").alias("rn"),
        F.regr_slope("net_income", "idx").alias("ps"), F.avg("net_income").alias("pm"),
        F.count("net_income").alias("pn"),
        F.regr_slope("revenue_growth", "gidx").alias("gs"),
        F.avg("revenue_growth").alias("gm"), F.count("revenue_growth").alias("gn"),
        F.max("date").alias("latest_date"),
        F.max_by("revenue", "date").alias("revenue_latest"),
        F.max_by("net_income", "date").alias("profit_latest"),
    ).filter(F.col("n") >= 2)
    return g.select(
        "ticker",
        trend_label("rs", "rm", "rn").alias("revenue_trend"),
        trend_label("ps", "pm", "pn").alias("profit_trend"),
        trend_label("gs", "gm", "gn").alias("growth_trend"),
        F.year("latest_date").cast("bigint").alias("latest_year"),
        "revenue_latest", "profit_latest")


def decompose(std: DataFrame, metrics=DECOMPOSE_METRICS) -> DataFrame:
    """T2 rows: value = trend + seasonal + residual per (ticker, metric).

    trend = OLS line on idx; period = min(4, n // 2); seasonal = mean of the
    detrended values sharing ``idx mod period`` (0 when period <= 1).  Series
    shorter than three points are skipped."""
    lf = long_form(std, metrics)
    g = Window.partitionBy("ticker", "metric")
    lf = lf.select("*", F.count(F.lit(1)).over(g).alias("n"),
                   F.regr_slope("value", "idx").over(g).alias("slope"),
                   F.regr_intercept("value", "idx").over(g).alias("intercept")) \
        .filter(F.col("n") >= 3)
    lf = lf.withColumns({
        "trend": F.col("intercept") + F.col("slope") * F.col("idx"),
        "period": F.least(F.lit(4), F.floor(F.col("n") / 2).cast("int")),
    })
    lf = lf.withColumn("detrended", F.col("value") - F.col("trend"))
    phase = Window.partitionBy("ticker", "metric", F.pmod(F.col("idx"), F.col("period")))
    lf = lf.withColumn("seasonal", F.when(F.col("period") > 1,
                                          F.avg("detrended").over(phase)).otherwise(F.lit(0.0)))
    lf = lf.withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal"))
    return lf.select("ticker", "metric", "date", as_long("idx").alias("idx"), "value",
                     "trend", "seasonal", "residual")


def decompose_rows(std: DataFrame, metrics=DECOMPOSE_METRICS) -> DataFrame:
    """T2 rows rounded for reporting (money scale, 2 dp)."""
    d = decompose(std, metrics)
    return d.select("ticker", "metric", "date", "idx", "value",
                    *[rnd(c, 2).alias(c) for c in ("trend", "seasonal", "residual")])


def decompose_strength(std: DataFrame, metrics=DECOMPOSE_METRICS) -> DataFrame:
    """T2 summary: strength = 1 - var(res) / var(component + res) (population
    variance; 0 when the denominator variance is 0)."""
    d = decompose(std, metrics)
    g = d.groupBy("ticker", "metric").agg(
        F.var_pop("residual").alias("vr"),
        F.var_pop(F.col("trend") + F.col("residual")).alias("vt"),
        F.var_pop(F.col("seasonal") + F.col("residual")).alias("vs"),
        F.count(F.lit(1)).alias("n"))
    return g.select(
        "ticker", "metric", as_long("n").alias("n"),
        rnd(F.when(F.col("vt") > 0, 1 - F.col("vr") / F.col("vt")).otherwise(F.lit(0.0)), 4)
        .alias("trend_strength"),
        rnd(F.when(F.col("vs") > 0, 1 - F.col("vr") / F.col("vs")).otherwise(F.lit(0.0)), 4)
        .alias("seasonal_strength"))


def seasonality(std: DataFrame, period: int = 4, metrics=SEASONALITY_METRICS) -> DataFrame:
    """T3 (+W9): mean rolling population σ over windows [i, i+period) for
    i < n - period, against 0.5 × overall σ."""
    lf = long_form(std, metrics)
    g = Window.partitionBy("ticker", "metric")
    roll = Window.partitionBy("ticker", "metric").orderBy("idx").rowsBetween(0, period - 1)
    lf = lf.select("*", F.count(F.lit(1)).over(g).alias("n"),
                   F.stddev_pop("value").over(roll).alias("roll_std"))
    agg = lf.groupBy("ticker", "metric").agg(
        F.first("n").alias("n"),
        F.avg(F.when(F.col("idx") < F.col("n") - period, F.col("roll_std"))).alias("vol"),
        F.stddev_pop("value").alias("overall_std")) \
        .filter(F.col("n") >= period)
    vol = F.coalesce(F.col("vol"), F.lit(0.0))
    return agg.select(
        "ticker", "metric",
        F.when(F.col("overall_std") > 0, vol > F.col("overall_std") * 0.5)
        .otherwise(F.lit(False)).alias("is_seasonal"),
        rnd(vol, 4).alias("volatility"), rnd("overall_std", 4).alias("overall_std"),
        rnd(vol / (F.col("overall_std") + 1e-10), 6).alias("pattern_strength"))


def growth_periods(std: DataFrame) -> DataFrame:
    """Period-over-period revenue growth with a five-way label."""
    w = Window.partitionBy("ticker").orderBy("date")
    rev = F.coalesce(F.col("revenue"), F.lit(0.0))
    df = std.select("ticker", "date", rev.alias("r"),
                    F.lag("date").over(w).alias("prev_date"),
                    F.lag(rev).over(w).alias("p")).filter(F.col("prev_date").isNotNull())
    yoy = (F.col("r") - F.col("p")) / (F.col("p") + 1e-10) * 100
    label = (F.when(F.abs("r") < 1e-10, "No data").when(yoy > 10, "Strong growth")
             .when(yoy > 0, "Moderate growth").when(yoy > -5, "Stable/slight decline")
             .otherwise("Significant decline"))
    return df.select("ticker", "date", "prev_date", rnd(yoy, 6).alias("yoy_growth_pct"),
                     label.alias("period_type"))


def trend_slopes(std: DataFrame, metrics=SLOPE_METRICS) -> DataFrame:
    """T5: OLS slope, intercept, R² and direction per (ticker, metric)."""
    lf = long_form(std, metrics)
    g = lf.groupBy("ticker", "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("value", "idx").alias("slope"),
        F.regr_intercept("value", "idx").alias("intercept"),
        F.regr_r2("value", "idx").alias("r_squared")).filter(F.col("n") >= 2)
    return g.select("ticker", "metric", rnd("slope", 4).alias("slope"),
                    rnd("intercept", 4).alias("intercept"),
                    F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
                    .alias("slope_interpretation"),
                    rnd("r_squared", 6).alias("r_squared"))
