"""Per-ticker historical reports.

Every report is one ``groupBy('ticker')`` over the ticker-bucketed standard
table: partial aggregation runs map-side and, because the table is bucketed by
ticker, no exchange is needed at all.  First/last values use
``min_by``/``max_by`` on the date instead of sorting rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.finance import cagr, pct_change, performance_class
from ledgerline.functions.numeric import as_long, exact_avg, exact_sum, rnd


def first_by_date(c: str):
    return F.min_by(c, "date")


def last_by_date(c: str):
    return F.max_by(c, "date")


def historical_performance(std: DataFrame) -> DataFrame:
    """A4 + A5 (CAGR) + A6 (performance class), one row per ticker."""
    g = std.groupBy("ticker").agg(
        F.min("date").alias("period_start"),
        F.max("date").alias("period_end"),
        F.count(F.lit(1)).alias("num_periods"),
        first_by_date("revenue").alias("revenue_start"),
        last_by_date("revenue").alias("revenue_end"),
        first_by_date("net_income").alias("net_income_start"),
        last_by_date("net_income").alias("net_income_end"),
        F.avg("profit_margin").alias("profit_margin_avg"),
        last_by_date("profit_margin").alias("profit_margin_last"),
        F.avg("operating_margin").alias("operating_margin_avg"),
        (last_by_date("operating_margin") - first_by_date("operating_margin"))
        .alias("operating_margin_trend"),
        exact_sum("operating_cashflow").alias("total_cashflow"),
        exact_avg("operating_cashflow").alias("avg_period_cashflow"),
        first_by_date("debt_to_asset").alias("debt_ratio_start"),
        last_by_date("debt_to_asset").alias("debt_ratio_end"),
        F.avg("asset_efficiency").alias("asset_efficiency_avg"),
        (last_by_date("asset_efficiency") - first_by_date("asset_efficiency"))
        .alias("asset_efficiency_trend"),
    )
    g = g.select(
        "*",
        cagr("revenue_start", "revenue_end", "num_periods").alias("revenue_cagr"),
        pct_change("revenue_start", "revenue_end").alias("revenue_total_growth"),
        cagr("net_income_start", "net_income_end", "num_periods").alias("net_income_cagr"),
        (F.col("debt_ratio_start") - F.col("debt_ratio_end")).alias("debt_ratio_improvement"),
    )
    g = g.withColumn("performance_class", performance_class(
        "revenue_total_growth", "profit_margin_last", "debt_ratio_improvement"))
    return g.select(
        "ticker", "period_start", "period_end", as_long("num_periods").alias("num_periods"),
        "revenue_start", "revenue_end", rnd("revenue_cagr").alias("revenue_cagr"),
        rnd("revenue_total_growth").alias("revenue_total_growth"),
        "net_income_start", "net_income_end", rnd("net_income_cagr").alias("net_income_cagr"),
        rnd("profit_margin_avg").alias("profit_margin_avg"),
        rnd("profit_margin_last").alias("profit_margin_last"),
        rnd("operating_margin_avg").alias("operating_margin_avg"),
        rnd("operating_margin_trend").alias("operating_margin_trend"),
        rnd("total_cashflow", 6).alias("total_cashflow"),
        rnd("avg_period_cashflow", 4).alias("avg_period_cashflow"),
        rnd("debt_ratio_start").alias("debt_ratio_start"),
        rnd("debt_ratio_end").alias("debt_ratio_end"),
        rnd("debt_ratio_improvement").alias("debt_ratio_improvement"),
        rnd("asset_efficiency_avg").alias("asset_efficiency_avg"),
        rnd("asset_efficiency_trend").alias("asset_efficiency_trend"),
        "performance_class",
    )


def ratio_report(std: DataFrame) -> DataFrame:
    """Profitability / efficiency / leverage / cash-flow ratios per ticker.
    Cash flow to revenue is 0 when total revenue is not positive."""
    g = std.groupBy("ticker").agg(
        F.avg("profit_margin").alias("profit_margin_avg"),
        last_by_date("profit_margin").alias("profit_margin_latest"),
        F.avg("operating_margin").alias("operating_margin_avg"),
        last_by_date("operating_margin").alias("operating_margin_latest"),
        F.avg("asset_efficiency").alias("asset_efficiency_avg"),
        last_by_date("asset_efficiency").alias("asset_efficiency_latest"),
        first_by_date("asset_efficiency").alias("_ae_first"),
        F.avg("debt_to_asset").alias("debt_to_asset_avg"),
        last_by_date("debt_to_asset").alias("debt_to_asset_latest"),
        first_by_date("debt_to_asset").alias("_da_first"),
        exact_sum("operating_cashflow").alias("total_cashflow"),
        exact_sum("revenue").alias("_total_revenue"),
        exact_avg("operating_cashflow").alias("avg_period_cashflow"),
        last_by_date("operating_cashflow").alias("latest_period_cashflow"),
    )
    return g.select(
        "ticker",
        *[rnd(c).alias(c) for c in ("profit_margin_avg", "profit_margin_latest",
                                    "operating_margin_avg", "operating_margin_latest",
                                    "asset_efficiency_avg", "asset_efficiency_latest")],
        rnd(F.col("asset_efficiency_latest") - F.col("_ae_first")).alias("asset_turnover_trend"),
        rnd("debt_to_asset_avg").alias("debt_to_asset_avg"),
        rnd("debt_to_asset_latest").alias("debt_to_asset_latest"),
        rnd(F.col("_da_first") - F.col("debt_to_asset_latest")).alias("debt_to_asset_improvement"),
        rnd(1 - F.col("debt_to_asset_latest")).alias("equity_to_asset_latest"),
        rnd("total_cashflow", 6).alias("total_cashflow"),
        rnd("avg_period_cashflow", 4).alias("avg_period_cashflow"),
        rnd(F.when(F.col("_total_revenue") > 0,
                   F.col("total_cashflow") / F.col("_total_revenue") * 100)
            .otherwise(F.lit(0.0))).alias("cashflow_to_revenue"),
        "latest_period_cashflow",
    )


def market_trends(std: DataFrame) -> DataFrame:
    """One row — growth of Σ latest revenue over Σ earliest revenue,
    mean margin, mean first / last debt ratio across tickers."""
    per = std.groupBy("ticker").agg(
        first_by_date("revenue").alias("rev_first"),
        last_by_date("revenue").alias("rev_last"),
        first_by_date("debt_to_asset").alias("debt_first"),
        last_by_date("debt_to_asset").alias("debt_last"),
        F.sum("profit_margin").alias("pm_sum"),
        F.count("profit_margin").alias("pm_n"),
    )
    g = per.agg(
        exact_sum("rev_first").alias("earliest_total_revenue"),
        exact_sum("rev_last").alias("latest_total_revenue"),
        F.avg("debt_first").alias("avg_debt_ratio_first"),
        F.avg("debt_last").alias("avg_debt_ratio_last"),
        (F.sum("pm_sum") / F.sum("pm_n")).alias("avg_profit_margin"),
        F.count(F.lit(1)).alias("num_companies"),
    )
    return g.select(
        as_long("num_companies").alias("num_companies"),
        rnd("earliest_total_revenue", 4).alias("earliest_total_revenue"),
        rnd("latest_total_revenue", 4).alias("latest_total_revenue"),
        rnd(pct_change("earliest_total_revenue", "latest_total_revenue"))
        .alias("market_growth_pct"),
        rnd("avg_profit_margin").alias("avg_profit_margin"),
        rnd("avg_debt_ratio_first").alias("avg_debt_ratio_first"),
        rnd("avg_debt_ratio_last").alias("avg_debt_ratio_last"),
    )


def company_trends(std: DataFrame) -> DataFrame:
    """A10: revenue multiple, first/last margin, debt reduction % (only when
    the ratio fell), mean and population σ of revenue growth."""
    g = std.groupBy("ticker").agg(
        first_by_date("revenue").alias("revenue_first"),
        last_by_date("revenue").alias("revenue_last"),
        first_by_date("profit_margin").alias("profit_margin_first"),
        last_by_date("profit_margin").alias("profit_margin_last"),
        first_by_date("debt_to_asset").alias("debt_first"),
        last_by_date("debt_to_asset").alias("debt_last"),
        F.avg("revenue_growth").alias("avg_revenue_growth"),
        F.stddev_pop("revenue_growth").alias("revenue_growth_volatility"),
    )
    return g.select(
        "ticker", "revenue_first", "revenue_last",
        rnd(F.col("revenue_last") / F.nullif("revenue_first", F.lit(0.0))).alias("revenue_multiple"),
        rnd("profit_margin_first").alias("profit_margin_first"),
        rnd("profit_margin_last").alias("profit_margin_last"),
        rnd(F.when(F.col("debt_first") > F.col("debt_last"),
                   (F.col("debt_first") - F.col("debt_last")) / F.col("debt_first") * 100))
        .alias("debt_reduction_pct"),
        rnd("avg_revenue_growth").alias("avg_revenue_growth"),
        rnd("revenue_growth_volatility").alias("revenue_growth_volatility"),
    )
