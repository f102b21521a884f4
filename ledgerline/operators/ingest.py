"""Ingest-side operators: header/alias normalisation, ticker filling, type
coercion and the whole raw normalisation (C3-C13, C22, C42, A22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.parsing import (clean_ticker, normalize_header, parse_money,
                                          parse_period_date, strip_ws)
from ledgerline.sources.panel import MEASURES

# Canonical field -> accepted header variants, first match wins.
FIELD_ALIASES = {
    "date": ["date", "period", "fiscal_date", "report_date", "year", "quarter", "fiscal_year"],
    "ticker": ["ticker", "symbol", "company", "company_name", "stock", "stock_symbol"],
    "revenue": ["revenue", "total_revenue", "sales", "net_sales", "operating_revenue", "turnover"],
    "net_income": ["net_income", "income", "earnings", "net_profit", "ni", "profit_after_tax", "pat"],
    "operating_income": ["operating_income", "operating_profit", "ebit", "operating_earnings",
                         "op_income"],
    "total_assets": ["total_assets", "assets", "total_asset", "asset_total"],
    "total_liabilities": ["total_liabilities", "liabilities", "total_liability", "liability_total"],
    "operating_cashflow": ["operating_cashflow", "operating_cash_flow", "cash_from_operations", "ocf",
                           "cashflow_from_operations"],
}

# Columns voted on for ticker inference.
TICKER_CANDIDATES = ("ticker", "symbol", "stock_symbol", "company_ticker", "security_symbol")

UNIT_MULTIPLIERS = {"units": 1.0, "thousands": 1e3, "millions": 1e6, "billions": 1e9}


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename every column by the header rule (metadata only)."""
    return df.toDF(*[normalize_header(c) for c in df.columns])


def alias_map(df: DataFrame) -> DataFrame:
    """C4: canonical name for the first matching variant, only when the
    canonical column is absent."""
    cols = list(df.columns)
    renames = {}
    for target, variants in FIELD_ALIASES.items():
        if target in cols or target in renames.values():
            continue
        for v in variants:
            if v in cols and v not in renames:
                renames[v] = target
                break
    return df.withColumnsRenamed(renames) if renames else df


def fill_ticker(df: DataFrame, ticker: str) -> DataFrame:
    """Create / fill NULL / fill empty ticker with the given value."""
    if "ticker" not in df.columns:
        return df.withColumn("ticker", F.lit(ticker))
    t = F.col("ticker")
    return df.withColumn("ticker", F.when(t.isNull() | (t == ""), F.lit(ticker)).otherwise(t))


def fill_ticker_first(df: DataFrame, batch: str, order: str, ticker: str) -> DataFrame:
    """NULL tickers take the first valid ticker of their batch (in row
    order), else the parameter."""
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding,
                                                             Window.unboundedFollowing)
    first = F.first("ticker", ignorenulls=True).over(w)
    return df.withColumn("ticker", F.coalesce(F.col("ticker"), first, F.lit(ticker)))


def coerce_types(df: DataFrame) -> DataFrame:
    """Date -> DATE, measures -> DOUBLE; bad values become NULL (ANSI
    casts would raise, so try_* forms are used)."""
    cols = {"date": parse_period_date("date")} if "date" in df.columns else {}
    for m in MEASURES:
        if m in df.columns:
            cols[m] = strip_ws(F.col(m).cast("string")).try_cast("double")
        else:
            cols[m] = F.lit(None).cast("double")
    return df.withColumns(cols)


def normalize_raw(df: DataFrame, ticker: str) -> DataFrame:
    """Headers + aliases + ticker fill + period dates + money parsing."""
    d = alias_map(normalize_headers(df))
    d = fill_ticker(d, ticker)
    cols = {}
    if "date" in d.columns:
        cols["date"] = parse_period_date("date")
    for m in MEASURES:
        if m in d.columns:
            cols[m] = parse_money(m)
    return d.withColumns(cols)


def scale_units(df: DataFrame, unit_col: str = "unit") -> DataFrame:
    """Amounts declared in thousands / millions / billions -> units."""
    u = F.lower(strip_ws(unit_col))
    mult = F.lit(1.0)
    for k, v in UNIT_MULTIPLIERS.items():
        mult = F.when(u == k, F.lit(v)).otherwise(mult)
    return df.withColumns({m: F.col(m) * mult for m in MEASURES if m in df.columns})


def infer_ticker(raw: DataFrame, upload_col: str, file_col: str | None = None) -> DataFrame:
    """Per upload, vote over the candidate columns (upper/trim, ≤ 12
    chars, no space); most votes then alphabetical; else the first
    alphanumeric token of the file stem; else UNKNOWN.

    Votes are a ``groupBy(upload, candidate).count()`` (partial aggregation)
    and the winner a ``max_by`` over (count, reversed order): no sort of the
    raw rows."""
    cand = [c for c in TICKER_CANDIDATES if c in raw.columns]
    if cand:
        vals = raw.select(upload_col, F.explode(F.array(*[F.col(c).cast("string") for c in cand]))
                          .alias("v"))
        v = F.upper(strip_ws("v"))
        votes = vals.select(upload_col, v.alias("v")).filter(
            F.col("v").isNotNull() & (F.col("v") != "") & (F.length("v") <= 12)
            & ~F.col("v").contains(" ")) \
            .groupBy(upload_col, "v").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(upload_col).agg(
            F.min_by("v", F.struct((-F.col("n")).alias("negn"), F.col("v"))).alias("ticker"))
    else:
        best = raw.select(upload_col).distinct().withColumn("ticker", F.lit(None).cast("string"))
    uploads = raw.select(upload_col, *([file_col] if file_col else [])).dropDuplicates([upload_col])
    out = uploads.join(best, upload_col, "left")
    if file_col:
        stem = F.upper(F.regexp_replace(F.col(file_col), r"^.*/|\.[^.]*$", ""))
        token = F.substring(F.regexp_extract(stem, r"([A-Z0-9]+)", 1), 1, 12)
        out = out.withColumns({
            "source": F.when(F.col("ticker").isNotNull(), "file data")
            .when(token != "", "filename").otherwise("fallback"),
            "ticker": F.coalesce(F.col("ticker"), F.when(token != "", token), F.lit("UNKNOWN"))})
    else:
        out = out.withColumns({
            "source": F.when(F.col("ticker").isNotNull(), "file data").otherwise("fallback"),
            "ticker": F.coalesce(F.col("ticker"), F.lit("UNKNOWN"))})
    return out.select(upload_col, "ticker", "source")


def clean_tickers(df: DataFrame, col: str = "ticker") -> DataFrame:
    return df.withColumn(col, clean_ticker(col))


# The eight direct-schema columns.
DIRECT_STANDARD_COLUMNS = ("date", "ticker", "revenue", "operating_income", "net_income",
                           "total_assets", "total_liabilities", "operating_cashflow")


def has_direct_standard_schema(df: DataFrame) -> bool:
    """All eight direct columns present after the C2 header rule."""
    from ledgerline.functions.parsing import normalize_header_dash
    cols = {normalize_header_dash(c) for c in df.columns}
    return all(c in cols for c in DIRECT_STANDARD_COLUMNS)


def require_columns(df: DataFrame, required=None) -> DataFrame:
    """Fail before planning when a required column is missing."""
    req = required or ("date", "ticker", "revenue", "operating_income", "net_income",
                       "total_assets", "total_liabilities", "operating_cashflow")
    missing = [c for c in req if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df
