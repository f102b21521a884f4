"""Anomaly detection and the insight report.

Each anomaly kind is a per-ticker window or aggregate; all kinds share one
schema ``(ticker, kind, date, value, message)`` and are combined with
``unionByName``.  Message texts are fixed formats (reference wording, with
years and companies taken from the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.ordering import global_row_number

ANOMALY_COLUMNS = ("ticker", "kind", "date", "value", "message")


def margin_drops(std: DataFrame, threshold: float = -5.0) -> DataFrame:
    """Consecutive profit-margin change below ``threshold`` points.
    Both ends are reported; the message names the year of the later period."""
    w = Window.partitionBy("ticker").orderBy("date")
    d = std.select("ticker", F.lag("date").over(w).alias("from_date"),
                   F.col("date").alias("to_date"),
                   (F.col("profit_margin") - F.lag("profit_margin").over(w)).alias("change"))
    d = d.filter(F.col("change") < threshold)
    return d.withColumn("message", F.format_string(
        "%s (FY %d): Profit margin dropped %.2f%% - investigate profitability decline",
        "ticker", F.year("to_date"), "change"))


def efficiency_degradation(std: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Latest asset efficiency below ``ratio`` × mean of all earlier rows."""
    w = Window.partitionBy("ticker").orderBy("date")
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    d = std.select("ticker", "date", "asset_efficiency",
                   F.avg("asset_efficiency").over(prev).alias("historical_avg"),
                   F.row_number().over(w.orderBy(F.col("date").desc())).alias("rn"))
    d = d.filter((F.col("rn") == 1) & (F.col("asset_efficiency") < F.col("historical_avg") * ratio))
    return d.select("ticker", "date", F.col("asset_efficiency").alias("recent_efficiency"),
                    "historical_avg",
                    F.format_string("%s: Asset efficiency degraded to %.2fx (below historical avg %.2fx)",
                                    "ticker", "asset_efficiency", "historical_avg").alias("message"))


def anomalies(std: DataFrame) -> DataFrame:
    """Margin drops ∪ negative-income count ∪ efficiency degradation ∪
    high latest debt ratio (> 0.7)."""
    drops = margin_drops(std).select(
        "ticker", F.lit("margin_drop").alias("kind"), F.col("to_date").alias("date"),
        F.col("change").alias("value"), "message")
    per = std.groupBy("ticker").agg(
        F.count_if(F.col("net_income") < 0).alias("neg"),
        F.max("date").alias("last_date"),
        F.max_by("debt_to_asset", "date").alias("latest_debt"))
    neg = per.filter(F.col("neg") > 0).select(
        "ticker", F.lit("negative_income").alias("kind"), F.col("last_date").alias("date"),
        F.col("neg").cast("double").alias("value"),
        F.format_string("%s showed negative net income in %d years", "ticker", "neg")
        .alias("message"))
    eff = efficiency_degradation(std).select(
        "ticker", F.lit("efficiency_degradation").alias("kind"), "date",
        F.col("recent_efficiency").alias("value"), "message")
    debt = per.filter(F.col("latest_debt") > 0.7).select(
        "ticker", F.lit("high_debt").alias("kind"), F.col("last_date").alias("date"),
        F.col("latest_debt").alias("value"),
        F.format_string("%s: High debt-to-assets ratio (%.2f) - potential financial risk",
                        "ticker", "latest_debt").alias("message"))
    return drops.unionByName(neg).unionByName(eff).unionByName(debt)


def insight_lines(std: DataFrame) -> DataFrame:
    """U6 content: market lines (section 1), company lines (section 2),
    anomaly lines (section 3) as (section, ticker, item, message)."""
    per = std.groupBy("ticker").agg(
        F.min_by("revenue", "date").alias("rf"), F.max_by("revenue", "date").alias("rl"),
        F.min_by("profit_margin", "date").alias("pf"), F.max_by("profit_margin", "date").alias("pl"),
        F.min_by("debt_to_asset", "date").alias("df"), F.max_by("debt_to_asset", "date").alias("dl"),
        F.avg("revenue_growth").alias("ga"), F.stddev_pop("revenue_growth").alias("gs"),
        F.min("date").alias("d0"), F.max("date").alias("d1"))
    m = per.agg(F.sum("rf").alias("rf"), F.sum("rl").alias("rl"), F.avg("df").alias("df"),
                F.avg("dl").alias("dl"), F.min("d0").alias("d0"), F.max("d1").alias("d1"))
    # overall mean margin as a scalar subquery (no cross join)
    market = m.select("*", std.agg(F.avg("profit_margin")).scalar().alias("pm"))
    market_lines = market.select(F.explode(F.array(
        F.struct(F.lit(1).alias("item"), F.format_string(
            "Total market revenue grew %.1f%% from %d to %d",
            (F.col("rl") - F.col("rf")) / F.col("rf") * 100, F.year("d0"), F.year("d1"))
            .alias("message")),
        F.struct(F.lit(2).alias("item"), F.format_string(
            "Average profit margin across all companies: %.2f%%", "pm").alias("message")),
        F.struct(F.lit(3).alias("item"), F.format_string(
            "Average debt ratio moved from %.2f to %.2f", "df", "dl").alias("message")),
    )).alias("x")).select(F.lit(1).alias("section"), F.lit("").alias("ticker"), "x.*")
    comp = per.select("ticker", F.array_compact(F.array(
        F.struct(F.lit(1).alias("item"), F.format_string(
            "%s: Revenue grew %.1fx ($%.1fB → $%.1fB)", "ticker", F.col("rl") / F.col("rf"),
            F.col("rf") / 1e9, F.col("rl") / 1e9).alias("message")),
        F.struct(F.lit(2).alias("item"), F.format_string(
            "%s: Profit margin at %.2f%% (from %.2f%%)", "ticker", "pl", "pf").alias("message")),
        F.when(F.col("df") > F.col("dl"), F.struct(F.lit(3).alias("item"), F.format_string(
            "%s: Reduced debt-to-assets by %.1f%% (stronger balance sheet)", "ticker",
            (F.col("df") - F.col("dl")) / F.col("df") * 100).alias("message"))),
        F.when(F.col("ga").isNotNull(), F.struct(F.lit(4).alias("item"), F.format_string(
            "%s: Average revenue growth %.1f%% (volatility: %.1f%%)", "ticker", "ga", "gs")
            .alias("message"))),
    )).alias("xs")).select(F.lit(2).alias("section"), "ticker",
                           F.inline("xs"))
    an = anomalies(std)
    kind_order = (F.when(F.col("kind") == "margin_drop", 1)
                  .when(F.col("kind") == "negative_income", 2)
                  .when(F.col("kind") == "efficiency_degradation", 3).otherwise(4))
    anomaly_lines = an.select(
        F.lit(3).alias("section"), "ticker",
        (kind_order * 100000 + F.coalesce(F.datediff("date", F.lit("1900-01-01")), F.lit(0)) % 100000)
        .alias("item"), "message")
    out = market_lines.unionByName(comp).unionByName(anomaly_lines)
    return out.withColumn("item", F.col("item").cast("bigint"))


def insights_report(std: DataFrame) -> DataFrame:
    """Numbered insight lines (global row number over section, ticker, item)."""
    lines = insight_lines(std)
    return global_row_number(lines, [F.col("section"), F.col("ticker"), F.col("item")],
                             "line_no")
