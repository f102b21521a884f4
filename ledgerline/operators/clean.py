"""Row-level cleaning, projection and predicate operators (C-ops, K10)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.finance import growth_category, risk_level
from ledgerline.functions.numeric import finite_or_null, safe_div

REQUIRED_FOR_ROW = ("date", "ticker", "revenue", "net_income")


def clean_rows(df: DataFrame) -> DataFrame:
    """Drop rows missing date, ticker, revenue or net income."""
    return df.dropna(subset=list(REQUIRED_FOR_ROW))


def with_category(std: DataFrame) -> DataFrame:
    """C18 on the standard table; the zero-base rule needs the previous
    revenue, taken with a per-ticker lag (no extra exchange on a
    ticker-bucketed table)."""
    w = Window.partitionBy("ticker").orderBy("date")
    prev = F.lag("revenue").over(w)
    return std.withColumn("category", growth_category("revenue_growth", "revenue", prev))


def category_table(std: DataFrame) -> DataFrame:
    """C20 category table: ticker, date, sector, category, risk_level, three measures."""
    return with_category(std).select(
        "ticker", "date", "sector", "category",
        risk_level("debt_to_asset").alias("risk_level"),
        "revenue", "operating_income", "net_income")


def ratios_null(df: DataFrame) -> DataFrame:
    """Fractions with NULL for a zero denominator."""
    return df.select(
        "ticker", "date",
        safe_div("net_income", "revenue").alias("profit_margin"),
        safe_div("total_liabilities", "total_assets").alias("debt_ratio"),
        safe_div("operating_income", "revenue").alias("operating_margin"))


def derive_opex(df: DataFrame) -> DataFrame:
    """operating_expenses = max(revenue - operating_income, 0); fiscal_year."""
    return df.withColumns({
        "operating_expenses": F.greatest(F.col("revenue") - F.col("operating_income"),
                                         F.lit(0.0)),
        "fiscal_year": F.year("date").cast("bigint"),
    })


def sector_lookup(df: DataFrame, dim: DataFrame, default: str = "Unknown") -> DataFrame:
    """C17: left join to a (ticker, sector) dimension, default label.
    The dimension is one row per ticker; the planner broadcasts it when its
    measured size is under the broadcast threshold and shuffles otherwise."""
    return (df.join(dim.dropDuplicates(["ticker"]), "ticker", "left")
              .withColumn("sector", F.coalesce(F.col("sector"), F.lit(default))))


def filter_companies(df: DataFrame, tickers: Iterable[str]) -> DataFrame:
    """``ticker IN (...)`` — pushed to the parquet scan."""
    return df.filter(F.col("ticker").isin(list(tickers)))


def filter_years(df: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Year range written as date bounds so min/max statistics prune
    row groups (``year(date) BETWEEN`` could not be pushed down)."""
    return df.filter(F.col("date").between(F.lit(f"{first_year}-01-01").cast("date"),
                                           F.lit(f"{last_year}-12-31").cast("date")))


def overview(df: DataFrame) -> DataFrame:
    """Overview projection with display names."""
    return df.select(
        F.year("date").cast("bigint").alias("year"), F.col("ticker").alias("company"),
        "revenue", "net_income", F.col("operating_cashflow").alias("cashflow"),
        "profit_margin", F.col("debt_to_asset").alias("debt_ratio"))


def sanitize(df: DataFrame) -> DataFrame:
    """Date -> ISO text, NaN/±inf -> NULL over every double column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(finite_or_null(f.name).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(f.name, "yyyy-MM-dd").alias(f"{f.name}_text"))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def normalize_ticker(c) -> F.Column:
    """upper(trim(x)); '', NAN, NONE, NULL -> NULL."""
    t = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(t.isin("", "NAN", "NONE", "NULL"), F.lit(None)).otherwise(t)
