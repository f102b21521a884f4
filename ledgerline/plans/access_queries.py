"""Accessors, sinks and schema checks as queries (S6, S7, S12, K1, K4, K6, K12,
C1, C2, C7, C21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import parsing as P
from ledgerline.operators import ingest, tables
from ledgerline.plans import reports
from ledgerline.plans.ingest_queries import MU, PU, messy
from ledgerline.plans.panel_queries import category_table_q  # noqa: F401  (registers its oracle)
from ledgerline.plans.registry import ORACLES, query
from ledgerline.plans.report_queries import historical_performance_q  # noqa: F401
from ledgerline.plans.sqlparts import with_panel, with_std
from ledgerline.session import job_folder
from ledgerline.sources import files, variants
from ledgerline.sources.panel import STANDARD_COLUMNS, panel

_STD = ", ".join(STANDARD_COLUMNS)


@query("standard_panel", with_std(f"select {_STD} from std"))
def standard_panel_q(spark, sf_dir):
    """The standard table by name."""
    return reports.standard_panel(spark, sf_dir)


@query("category_panel", ORACLES["category_table"])
def category_panel_q(spark, sf_dir):
    """The category table by name."""
    return reports.category_panel(spark, sf_dir)


@query("model_data", with_std(f"select {_STD} from std"))
def model_data_q(spark, sf_dir):
    """The model data behind its required-column check."""
    return ingest.require_columns(reports.load_modeling_data(spark, sf_dir))


@query("stored_report", ORACLES["historical_performance"])
def stored_report_q(spark, sf_dir):
    """K12 + S12: a report written to the shared folder and read back."""
    out = job_folder(spark, "reports")
    reports.write_reports(spark, sf_dir, out, ("historical_performance",))
    return reports.read_report(spark, out, "historical_performance")


@query("append_load", with_panel("""select user_id, ticker, date, revenue from pu
where user_id in ('predefined', 'u1')""", PU))
def append_load_q(spark, sf_dir):
    """K4: two staged loads appended to one table."""
    staged = variants.with_users(panel(spark, sf_dir)).select("user_id", "ticker", "date", "revenue")
    path = job_folder(spark, "append_load")
    staged.filter(F.col("user_id") == "predefined").write.mode("overwrite").parquet(path)
    reports.append_table(staged.filter(F.col("user_id") == "u1"), path)
    return spark.read.parquet(path)


@query("stored_uploads", with_panel("""select upload_id, upper(true_ticker) as upload_ticker,
  case upload_id % 3 when 0 then 'predefined' when 1 then 'u1' else 'u2' end as user_id, count(*) as records
from mu group by all""", MU))
def stored_uploads_q(spark, sf_dir):
    """K6 (+ K1): uploads as they are stored, by real users, with upper-cased tickers."""
    m = files.guarded_uploads(messy(spark, sf_dir).withColumn("user_id", files.upload_user()))
    return m.groupBy("upload_id", "upload_ticker", "user_id").agg(F.count(F.lit(1)).alias("records"))


def _headers_sql() -> str:
    rows = "\n  union all ".join(
        f"select upload_id, '{c}' as header, '{P.normalize_header_basic(c)}' as basic, "
        f"'{P.normalize_header_dash(c)}' as dashed, '{P.normalize_header(c)}' as normal, "
        f"\"{c}\" as val from mu" for c in files.UPLOAD_COLS)
    return f"""select upload_id, header, basic, dashed, normal,
  count(*) filter (val is not null and trim(val) <> '') as filled
from ({rows}) x group by all"""


@query("upload_headers", with_panel(_headers_sql(), MU))
def upload_headers_q(spark, sf_dir):
    """Every upload's headers under the three header rules, and how
    many of its records fill them."""
    m = messy(spark, sf_dir).select("upload_id", F.inline(F.array(*[
        F.struct(F.lit(c).alias("header"), F.lit(P.normalize_header_basic(c)).alias("basic"),
                 F.lit(P.normalize_header_dash(c)).alias("dashed"), F.lit(P.normalize_header(c)).alias("normal"),
                 F.col(f"`{c}`").alias("val")) for c in files.UPLOAD_COLS])))
    return m.groupBy("upload_id", "header", "basic", "dashed", "normal").agg(
        F.count_if(F.col("val").isNotNull() & (F.trim("val") != "")).alias("filled"))


@query("direct_schema", with_panel("""select upload_id, false as raw_is_direct, true as mapped_is_direct,
  count(*) as records from mu group by upload_id""", MU))
def direct_schema_q(spark, sf_dir):
    """C21 (+ C7): whether an upload already has the direct schema, before and
    after header normalisation and alias mapping."""
    raw = messy(spark, sf_dir)
    mapped = ingest.require_columns(ingest.alias_map(ingest.normalize_headers(raw)))
    return mapped.groupBy("upload_id").agg(
        F.lit(ingest.has_direct_standard_schema(raw)).alias("raw_is_direct"),
        F.lit(ingest.has_direct_standard_schema(mapped)).alias("mapped_is_direct"),
        F.count(F.lit(1)).alias("records"))


@query("deleted_scope", with_panel("""select user_id, ticker, count(*) as rows from pu
where not (user_id = 'u1' and upper(ticker) = 'SUPPLIER#000000001') group by all""", PU))
def deleted_scope_q(spark, sf_dir):
    """K8: the table after a (user, ticker) delete, rows per user and ticker."""
    left = tables.apply_delete(variants.with_users(panel(spark, sf_dir)), "u1", "Supplier#000000001")
    return left.groupBy("user_id", "ticker").agg(F.count(F.lit(1)).alias("rows"))
