"""Latest rows, peer comparison and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import rnd
from ledgerline.operators.ordering import global_rank_many


def latest_row(std: DataFrame) -> DataFrame:
    """The latest row of every ticker (``max_by`` on the date: one
    aggregation, no sort, no single-partition step)."""
    cols = [c for c in std.columns if c != "ticker"]
    g = std.groupBy("ticker").agg(F.max_by(F.struct(*cols), "date").alias("r"))
    return g.select("ticker", "r.*")


def first_last(std: DataFrame) -> DataFrame:
    """First / last date and values per ticker."""
    return std.groupBy("ticker").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by("revenue", "date").alias("first_revenue"),
        F.max_by("revenue", "date").alias("last_revenue"),
        F.min_by("net_income", "date").alias("first_net_income"),
        F.max_by("net_income", "date").alias("last_net_income"))


def peer_comparison(std: DataFrame) -> DataFrame:
    """One row of leaders and ranges.  Leaders are ``max_by``/``min_by``
    over one row per ticker (latest row joined with the mean growth); a tie
    goes to the later ticker for the largest and the earlier for the smallest."""
    latest = latest_row(std).select("ticker", "profit_margin", "operating_margin",
                                    "asset_efficiency", "debt_to_asset")
    growth = std.groupBy("ticker").agg(F.avg("revenue_growth").alias("avg_revenue_growth"),
                                       F.avg("net_income_growth").alias("avg_income_growth"))
    t = latest.join(growth, "ticker")

    def first(c):
        return F.when(F.col(c).isNotNull(), F.struct(c, "ticker"))

    g = t.agg(
        F.max_by("ticker", first("profit_margin")).alias("profitability_leader"),
        F.min("profit_margin").alias("profit_margin_min"),
        F.max("profit_margin").alias("profit_margin_max"),
        F.min("operating_margin").alias("operating_margin_min"),
        F.max("operating_margin").alias("operating_margin_max"),
        F.max_by("ticker", first("avg_revenue_growth")).alias("growth_leader"),
        F.max("avg_revenue_growth").alias("growth_leader_rate"),
        F.max_by("ticker", first("asset_efficiency")).alias("efficiency_leader"),
        F.min("asset_efficiency").alias("asset_efficiency_min"),
        F.max("asset_efficiency").alias("asset_efficiency_max"),
        F.min_by("ticker", first("debt_to_asset")).alias("lowest_debt"),
        F.min("debt_to_asset").alias("debt_ratio_min"),
        F.max("debt_to_asset").alias("debt_ratio_max"),
        F.count(F.lit(1)).cast("bigint").alias("num_companies"))
    return g.select(*[rnd(c).alias(c) if c.endswith(("_min", "_max", "_rate")) else F.col(c)
                      for c in g.columns])


def peer_rankings(std: DataFrame) -> DataFrame:
    """Rank of each ticker's latest profitability, efficiency and
    financial health (1 = best); tied values share the average rank,
    truncated to an integer."""
    latest = latest_row(std).select(
        F.col("ticker").alias("company"), "profit_margin", "asset_efficiency",
        (1 - F.col("debt_to_asset")).alias("financial_health"))
    metrics = ("profit_margin", "asset_efficiency", "financial_health")
    out = global_rank_many(latest, ["company"], metrics, descending=True)
    return out.select("company", *metrics,
                      *[F.floor(f"{c}_rank_avg").cast("bigint").alias(f"{c}_rank") for c in metrics])
