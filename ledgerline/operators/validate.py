"""Validation gates (V1-V5) as one aggregate per batch -> issues table.

Every gate is a single ``agg`` (null counts, duplicate-key count, revenue
maximum) over the batch, reshaped into an issues table
``(batch, severity, field, pct, message)``; ``valid`` = no CRITICAL issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.functions.numeric import rnd

# Field groups and thresholds of the gates (the issue message
# texts in the functions below are fixed values too).
REQUIRED_FOR_ML = ("revenue", "net_income", "total_assets", "date", "ticker")
REQUIRED_FOR_ANALYSIS = ("operating_income", "total_liabilities", "operating_cashflow")
ENGINEERED = ("profit_margin", "operating_margin", "revenue_growth", "net_income_growth",
              "asset_efficiency", "debt_to_asset")
GROWTH = ("revenue_growth", "net_income_growth")
MIN_RECORDS = 3


def _issue(batch, severity, field, pct, message):
    return F.struct(batch.alias("batch"), F.lit(severity).alias("severity"),
                    F.lit(field).alias("field"), pct.alias("pct"), message.alias("message"))


def _pct0(x):
    """``{x:.0%}`` formatting on a pre-rounded value."""
    return F.format_string("%d%%", F.round(x * 100).cast("bigint"))


def validate_records(df: DataFrame, batch: str = "ticker") -> DataFrame:
    """V1: per batch — fewer than 3 rows (CRITICAL); required null rate > 30 %
    (CRITICAL); analysis null rate > 50 % (WARNING); duplicate (ticker, date)
    keys (WARNING); all-zero revenue (CRITICAL)."""
    dups = df.filter(F.col("date").isNotNull()).groupBy(batch, "ticker", "date") \
        .agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1) \
        .groupBy(batch).agg(F.count(F.lit(1)).alias("dup_keys"))
    aggs = [F.count(F.lit(1)).alias("n"),
            F.max(F.abs("revenue")).alias("max_abs_rev"), F.count("revenue").alias("rev_n")]
    fields = list(REQUIRED_FOR_ML) + list(REQUIRED_FOR_ANALYSIS)
    aggs += [F.count_if(F.col(f).isNull()).alias(f"nulls_{f}") for f in fields]
    g = df.groupBy(batch).agg(*aggs).join(dups, batch, "left") \
        .withColumn("dup_keys", F.coalesce("dup_keys", F.lit(0)))
    b = F.col(batch)
    items = [F.when(F.col("n") < MIN_RECORDS, _issue(
        b, "CRITICAL", "records", F.lit(None).cast("double"),
        F.format_string("CRITICAL: Only %d records found. Need at least %d periods for trend analysis.",
                        "n", F.lit(MIN_RECORDS))))]
    for f in REQUIRED_FOR_ML:
        p = F.col(f"nulls_{f}") / F.col("n")
        items.append(F.when(p > 0.3, _issue(b, "CRITICAL", f, rnd(p, 6), F.format_string(
            "CRITICAL: '%s' is null in %s of records — SVR pipeline will fail.", F.lit(f), _pct0(p)))))
    for f in REQUIRED_FOR_ANALYSIS:
        p = F.col(f"nulls_{f}") / F.col("n")
        items.append(F.when(p > 0.5, _issue(b, "WARNING", f, rnd(p, 6), F.format_string(
            "WARNING: '%s' is null in %s of records — some analysis modules will be skipped.",
            F.lit(f), _pct0(p)))))
    items.append(F.when(F.col("dup_keys") > 0, _issue(
        b, "WARNING", "ticker,date", F.lit(None).cast("double"), F.format_string(
            "WARNING: %d duplicate (ticker, date) pairs detected.", "dup_keys"))))
    items.append(F.when((F.col("rev_n") > 0) & (F.col("max_abs_rev") == 0), _issue(
        b, "CRITICAL", "revenue", F.lit(None).cast("double"),
        F.lit("CRITICAL: All revenue values are zero — data extraction likely failed."))))
    return g.select(F.explode(F.array_compact(F.array(*items))).alias("i")).select("i.*")


def validation_summary(issues: DataFrame, batches: DataFrame, batch: str = "ticker") -> DataFrame:
    """(batch, valid, critical_count, warning_count)."""
    c = issues.groupBy(F.col("batch").alias(batch)).agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_count"))
    out = batches.select(batch).distinct().join(c, batch, "left").fillna(
        0, ["critical_count", "warning_count"])
    return out.withColumn("valid", F.col("critical_count") == 0)


def validate_features(df: DataFrame, batch: str = "ticker") -> DataFrame:
    """V2: engineered-feature gate per batch: growth features may be NULL in
    up to 50 % of rows, other features 30 %; at least 3 complete rows."""
    req = list(REQUIRED_FOR_ML) + list(ENGINEERED)
    complete = F.lit(True)
    for f in req:
        complete = complete & F.col(f).isNotNull()
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(complete).alias("clean")]
    aggs += [F.count_if(F.col(f).isNull()).alias(f"nulls_{f}") for f in ENGINEERED]
    g = df.groupBy(batch).agg(*aggs)
    b = F.col(batch)
    items = []
    for f in ENGINEERED:
        p = F.col(f"nulls_{f}") / F.col("n")
        lim = 0.5 if f in GROWTH else 0.3
        items.append(F.when(p > lim, _issue(b, "CRITICAL", f, rnd(p, 6), F.format_string(
            "CRITICAL: '%s' is null in %s of records (max allowed: %d%%).", F.lit(f), _pct0(p),
            F.lit(int(lim * 100))))).when(p > 0, _issue(b, "INFO", f, rnd(p, 6), F.format_string(
                "Feature '%s': %d/%d rows NULL (%s)", F.lit(f), F.col(f"nulls_{f}"), "n", _pct0(p)))))
    items.append(F.when(F.col("clean") < MIN_RECORDS, _issue(
        b, "CRITICAL", "records", F.lit(None).cast("double"), F.format_string(
            "CRITICAL: After removing rows with any NULL values, only %d records remain (need ≥%d).",
            "clean", F.lit(MIN_RECORDS))))
        .when(F.col("clean") < F.col("n"), _issue(
            b, "OK", "records", F.lit(None).cast("double"), F.format_string(
                "Data ready: Using %d clean records (%d rows with NULL values will be skipped)",
                "clean", F.col("n") - F.col("clean"))))
        .otherwise(_issue(b, "OK", "records", F.lit(None).cast("double"), F.format_string(
            "All %d records are complete with no NULL values", "clean"))))
    return g.select(F.explode(F.array_compact(F.array(*items))).alias("i")).select("i.*")


TRAINING_FIELDS = ("date", "ticker", "revenue", "net_income", "operating_income", "total_assets",
                   "total_liabilities", "operating_cashflow")


def _first_missing() -> Column:
    """The first required field that is NULL, in field order."""
    out = F.lit(None).cast("string")
    for f in reversed(TRAINING_FIELDS):
        out = F.when(F.col(f).isNull(), F.lit(f)).otherwise(out)
    return out


def prepare_training(df: DataFrame, batch: str = "ticker") -> DataFrame:
    """V3: sequential drop of rows missing a required field, with the
    removed count attributed to the first missing field in field order
    (one cascaded ``count_if`` aggregate instead of one pass per field)."""
    d = df.withColumn("_miss", _first_missing())
    return d.groupBy(batch, "_miss").agg(F.count(F.lit(1)).alias("rows")) \
        .select(batch, F.coalesce(F.col("_miss"), F.lit("(kept)")).alias("field"), "rows")


def write_prepared(df: DataFrame, path: str) -> dict[str, int]:
    """V3 while writing: rows with every required field go to ``path``; the rows each
    field removed are observed on the way, so nothing is read twice."""
    seen = Observation()
    d = df.withColumn("_miss", _first_missing()).observe(
        seen, F.count_if(F.col("_miss").isNull()).alias("(kept)"),
        *[F.count_if(F.col("_miss") == f).alias(f) for f in TRAINING_FIELDS])
    d.filter(F.col("_miss").isNull()).drop("_miss").write.mode("overwrite").parquet(path)
    return {f: int(n) for f, n in seen.get.items()}


def land_batch(df: DataFrame, path: str) -> dict:
    """V1 for one batch while it lands: its row and null counts and whether it is valid
    (enough rows, required null rates of at most 30 %, some revenue that isn't zero)."""
    seen = Observation()
    fields = REQUIRED_FOR_ML + REQUIRED_FOR_ANALYSIS
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.abs("revenue")).alias("top"),
               *[F.count_if(F.col(f).isNull()).alias(f"nulls_{f}") for f in fields]) \
        .write.mode("overwrite").parquet(path)
    got = seen.get
    top = got.pop("top")
    return got | {"valid": got["n"] >= MIN_RECORDS and top != 0 and all(
        got[f"nulls_{f}"] <= 0.3 * got["n"] for f in REQUIRED_FOR_ML)}
