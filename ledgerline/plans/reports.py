"""Report sinks and accessors.

``write_reports`` persists each analysis report as its own parquet table
(one Spark job per report, partitioned write, no driver collection);
``read_report`` reads one back (the serving side).  Accessors name the two
panels and the model-data load with its required-column check.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators import clean
from ledgerline.plans.registry import queries
from ledgerline.sources.panel import STANDARD_COLUMNS, standard_table

# Reports written by the analysis phases.
REPORTS = ("historical_performance", "ratio_report", "peer_rankings", "anomalies",
           "insights_report", "feature_variance", "feature_statistics", "correlation_matrix",
           "outliers_iqr", "outlier_recommendations", "decompose_strength", "trend_slopes",
           "regression_metrics", "champion", "forecast_gap", "benchmark_table",
           "shap_global", "shap_local", "normalize_recommendation")

MODEL_REQUIRED = ("date", "ticker", "revenue", "operating_income", "net_income", "total_assets",
                  "total_liabilities", "operating_cashflow")


def write_reports(spark: SparkSession, sf_dir: str, out_dir: str, names=REPORTS) -> dict[str, str]:
    """One parquet table per report under ``out_dir``."""
    qs = queries()
    paths = {}
    for n in names:
        p = os.path.join(out_dir, n)
        qs[n](spark, sf_dir).write.mode("overwrite").parquet(p)
        paths[n] = p
    return paths


def read_report(spark: SparkSession, out_dir: str, name: str,
                renames: dict[str, str] | None = None) -> DataFrame:
    """Read a written report; legacy column names can be renamed."""
    df = spark.read.parquet(os.path.join(out_dir, name))
    return df.withColumnsRenamed(renames) if renames else df


def append_table(df: DataFrame, path: str) -> None:
    """K4: load a staged table by appending (no key)."""
    df.write.mode("append").parquet(path)


def standard_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard table accessor."""
    return standard_table(spark, sf_dir).select(*STANDARD_COLUMNS)


def category_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category table accessor."""
    return clean.category_table(standard_table(spark, sf_dir))


def load_modeling_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model data with the required-column check (a schema decision,
    made before any job runs)."""
    df = standard_panel(spark, sf_dir)
    missing = [c for c in MODEL_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df
