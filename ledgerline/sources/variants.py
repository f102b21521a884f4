"""Deterministic variants of the panel (FIXTURES.md §B "derive those").

The base panel has no NULLs, zero bases, duplicate keys, user scopes or messy
strings, so every variant is derived by Spark from the panel with rules on
the ticker number (the nine digits that end the ticker) and the quarter
number — never engine hashes, so the SQL oracle can derive the same rows.

Fixed rule values (shared with the SQL twins in ``plans/variant_sql.py``):

* NULLs: measure ``i`` (in MEASURES order) is NULL when
  ``pmod(tn * 7 + qn + 3 * i, 13) = 0``;
* zero base: ``net_income = 0`` on the 7th period of every 10th ticker;
* duplicates: rows of every 9th ticker again with ``load_seq = 2`` and
  revenue × 1.01;
* users: ``predefined`` when tn % 3 = 0, ``u1`` when 1, ``u2`` when 2;
* messy upload strings: revenue as ``$1,234`` / ``(1234)`` / ``1234K`` /
  ``1.234M`` by tn % 4; dates ISO / ``2001Q3`` / ``Q3-2001`` by tn % 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.panel import MEASURES


def ticker_no(c: str = "ticker") -> Column:
    return F.substring(F.col(c), -9, 9).cast("bigint")


def quarter_no(c: str = "date") -> Column:
    return F.year(c) * 4 + F.quarter(c)


def with_nulls(panel: DataFrame) -> DataFrame:
    tn, qn = ticker_no(), quarter_no()
    return panel.withColumns({
        m: F.when(F.pmod(tn * 7 + qn + 3 * i, F.lit(13)) == 0, F.lit(None).cast("double"))
        .otherwise(F.col(m)) for i, m in enumerate(MEASURES)})


def with_zero_base(panel: DataFrame) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    return panel.withColumn(
        "net_income", F.when((F.pmod(ticker_no(), F.lit(10)) == 0) & (pos == 7), F.lit(0.0))
        .otherwise(F.col("net_income")))


def with_users(panel: DataFrame) -> DataFrame:
    r = F.pmod(ticker_no(), F.lit(3))
    return panel.withColumn("user_id", F.when(r == 0, "predefined").when(r == 1, "u1")
                            .otherwise("u2"))


def with_duplicates(panel: DataFrame) -> DataFrame:
    base = panel.withColumn("load_seq", F.lit(1))
    again = panel.filter(F.pmod(ticker_no(), F.lit(9)) == 0) \
        .withColumn("revenue", F.col("revenue") * 1.01).withColumn("load_seq", F.lit(2))
    return base.unionByName(again)


def _int_str(c: Column) -> Column:
    return F.floor(c).cast("bigint").cast("string")


def money_string(c: str, tn: Column) -> Column:
    v = F.col(c)
    k = F.floor(v / 1000).cast("bigint")
    r = F.pmod(tn, F.lit(4))
    return (F.when(r == 0, F.concat(F.lit("$"), F.format_number(F.floor(v), 0)))
            .when(r == 1, F.concat(F.lit("("), _int_str(v), F.lit(")")))
            .when(r == 2, F.concat(k.cast("string"), F.lit("K")))
            .otherwise(F.concat((k / 1000).cast("bigint").cast("string"), F.lit("."),
                                F.lpad(F.pmod(k, F.lit(1000)).cast("string"), 3, "0"),
                                F.lit("M"))))


def period_string(tn: Column) -> Column:
    r = F.pmod(tn, F.lit(3))
    y, q = F.year("date").cast("string"), F.quarter("date").cast("string")
    return (F.when(r == 0, F.date_format("date", "yyyy-MM-dd"))
            .when(r == 1, F.concat(y, F.lit("Q"), q))
            .otherwise(F.concat(F.lit("Q"), q, F.lit("-"), y)))


def symbol_string(tn: Column) -> Column:
    return (F.when(F.pmod(tn, F.lit(7)) == 0, F.lit(""))
            .when(F.pmod(tn, F.lit(11)) == 0, F.lit("nan"))
            .when(F.pmod(tn, F.lit(5)) == 0, F.concat(F.lit("  "), F.lower("ticker"), F.lit(" ")))
            .otherwise(F.col("ticker")))


def messy_upload(panel: DataFrame) -> DataFrame:
    """A raw upload with display headers and string-typed values, one upload
    per ticker (``upload_id`` = ticker number, ``row_pos`` = period index)."""
    tn = ticker_no()
    pos = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    nullish = F.pmod(tn * 7 + quarter_no(), F.lit(13)) == 0
    return panel.select(
        tn.alias("upload_id"), pos.cast("bigint").alias("row_pos"),
        F.col("ticker").alias("true_ticker"),
        symbol_string(tn).alias("Symbol"),
        period_string(tn).alias("Period"),
        money_string("revenue", tn).alias("Total Revenue"),
        _int_str(F.col("net_income")).alias("Net Profit"),
        _int_str(F.col("operating_income")).alias("Operating Profit"),
        _int_str(F.col("total_assets")).alias("Total Assets"),
        _int_str(F.col("total_liabilities")).alias("Total Liabilities"),
        F.when(nullish, F.lit("none")).otherwise(_int_str(F.col("operating_cashflow")))
        .alias("Cash From Operations"),
    )
