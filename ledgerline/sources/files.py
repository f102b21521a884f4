"""File sources: landed uploads and statement payloads (S1-S4, S8, S11, S13,
S14, K1, K6).

Uploads are derived by Spark from the panel and landed once per application
in the shared folder (``spark.checkpoint.dir``), many uploads per file.  CSV
files have a header and one record per line.  JSON files hold one document
per line, in three shapes: an array with all records of an upload, an object
with the records in its first list member, or one object per record.  Every
record carries its upload's id and ticker, so no reader depends on paths.
Statement payloads are JSON documents per (symbol, statement) with
``annualReports`` and ``quarterlyReports`` arrays of string-typed values.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.session import job_folder
from ledgerline.sources import variants
from ledgerline.sources.panel import panel
from ledgerline.sources.tables import data_version

UPLOAD_COLS = ("Symbol", "Period", "Total Revenue", "Net Profit", "Operating Profit",
               "Total Assets", "Total Liabilities", "Cash From Operations")
ENVELOPE_COLS = ("upload_id", "row_pos", "upload_ticker")
RECORD_COLS = ENVELOPE_COLS + UPLOAD_COLS
JSON_SHAPES = ("array", "object", "record")

_LANDED: dict[tuple[str, str, str], str] = {}


def upload_user(c: str = "upload_id") -> Column:
    r = F.pmod(F.col(c), F.lit(3))
    return F.when(r == 0, "predefined").when(r == 1, "u1").otherwise("u2")


def guarded_uploads(records: DataFrame) -> DataFrame:
    """K6: records of uploads by a real user (an upload without records has no
    rows here); the stored ticker is upper-cased."""
    user = F.col("user_id")
    return records.filter(user.isNotNull() & ~user.isin("", "anonymous")) \
        .withColumn("upload_ticker", F.upper(F.col("true_ticker")))


def land_uploads(spark: SparkSession, sf_dir: str) -> str:
    """K1: write the uploads as csv (even ids) and json (odd ids, one of the
    three shapes).  Returns the root folder.  Written once per application
    and version of the data."""
    key = (spark.sparkContext.applicationId, sf_dir, data_version(spark, sf_dir))
    if key in _LANDED:
        return _LANDED[key]
    root = job_folder(spark, "uploads_" + hashlib.sha1("|".join(key).encode()).hexdigest()[:12])
    m = variants.messy_upload(panel(spark, sf_dir)).withColumn("user_id", upload_user())
    m = guarded_uploads(m).select(*RECORD_COLS, F.pmod("upload_id", F.lit(2)).alias("fmt"),
                                  F.pmod(F.floor(F.col("upload_id") / 2), F.lit(3)).alias("shape"))
    (m.filter("fmt = 0").select(*RECORD_COLS)
       .repartitionByRange("upload_id", "row_pos").sortWithinPartitions("upload_id", "row_pos")
       .write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False).csv(os.path.join(root, "csv")))
    odd = m.filter("fmt = 1")
    rec = F.struct(*[F.col(c) for c in RECORD_COLS])
    # an array or an object holds its whole upload by definition
    docs = (odd.filter("shape < 2").groupBy("upload_id", "shape")
            .agg(F.sort_array(F.collect_list(F.struct("row_pos", rec.alias("r")))).alias("rs"))
            .select("shape", F.transform("rs", lambda x: x["r"]).alias("records")))
    whole = docs.select("shape", F.when(F.col("shape") == 0, F.to_json("records")).otherwise(
        F.to_json(F.struct(F.lit("statement").alias("kind"), F.col("records").alias("data")))).alias("value"))
    single = odd.filter("shape = 2").select("shape", F.to_json(rec).alias("value"))
    for k, name in enumerate(JSON_SHAPES):
        (whole.union(single).filter(F.col("shape") == k).select("value")
         .write.mode("overwrite").text(os.path.join(root, "json", name)))
    _LANDED[key] = root
    return root


_RECORD_SCHEMA = ", ".join(f"`{c}` string" for c in RECORD_COLS)


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("upload_id", "row_pos")})


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every value as text (PERMISSIVE), an empty field is NULL,
    file path kept."""
    raw = spark.read.schema(_RECORD_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return _typed(raw).withColumn("source_file", F.col("_metadata.file_path"))


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of records.  A document that is no array of records
    has no row here but one in ``_corrupt_record``, so nothing is all NULL."""
    raw = spark.read.schema(_RECORD_SCHEMA + ", _corrupt_record string").json(path)
    return _typed(raw).withColumn("source_file", F.col("_metadata.file_path"))


def _elements(v: Column) -> Column:
    """The records of a document: an array's elements, the elements of an object's first
    list-valued member, or the object itself."""
    kind = F.schema_of_variant(v)
    members = F.map_entries(F.variant_get(v, "$", "map<string,variant>"))
    lists = F.filter(members, lambda kv: F.schema_of_variant(kv["value"]).startswith("ARRAY"))
    return F.when(kind.startswith("ARRAY"), F.variant_get(v, "$", "array<variant>")) \
        .when(kind.startswith("OBJECT"), F.coalesce(
            F.variant_get(F.get(lists, F.lit(0))["value"], "$", "array<variant>"), F.array(v)))


def flex_records(lines: DataFrame) -> DataFrame:
    """S3: JSON documents (``value``) of any shape -> their records.  One expression per
    document, so it also runs on a stream."""
    docs = lines.select(*[c for c in lines.columns if c != "value"], F.try_parse_json("value").alias("v"))
    recs = docs.select(*[c for c in docs.columns if c != "v"], F.explode(_elements(F.col("v"))).alias("rec"))
    return _typed(recs.select(*[c for c in recs.columns if c != "rec"], *[
        F.variant_get("rec", f"$['{c}']", "string").alias(c) for c in RECORD_COLS]))


def document_records(lines: DataFrame) -> DataFrame:
    """S3: the same documents, each with its records as one array of text fields."""
    docs = lines.select(F.try_parse_json("value").alias("v"))
    return docs.select(F.transform(_elements(F.col("v")), lambda r: F.struct(*[
        F.variant_get(r, f"$['{c}']", "string").alias(c) for c in RECORD_COLS])).alias("records"))


def scan_json_flex(spark: SparkSession, path: str) -> DataFrame:
    """S3: shape-tolerant JSON documents, one per line."""
    lines = spark.read.text([os.path.join(path, s) for s in JSON_SHAPES])
    return flex_records(lines.select("value", F.col("_metadata.file_path").alias("source_file")))


READERS = {"csv": scan_csv, "json": scan_json_flex}


def ingest_dispatch(spark: SparkSession, root: str, kinds=("csv", "json")) -> DataFrame:
    """Pick the reader by source type; unknown types are rejected."""
    out = None
    for k in kinds:
        if k not in READERS:
            raise ValueError(f"Unsupported source type: {k}")
        df = READERS[k](spark, os.path.join(root, k)).select(*RECORD_COLS) \
            .withColumn("source_type", F.lit(k))
        out = df if out is None else out.unionByName(df)
    return out


def upload_envelope(records: DataFrame) -> DataFrame:
    """Per upload: name, ticker (upper-cased first symbol in upload
    order), record count."""
    symbol = F.upper(F.trim("Symbol"))
    return records.groupBy("upload_id", "source_type").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.min_by(symbol, F.when(symbol != "", F.col("row_pos"))).alias("ticker")) \
        .select(F.concat(F.lit("upload_"), "upload_id", F.lit("."), "source_type").alias("source_name"),
                "ticker", "record_count", "upload_id")


# ------------------------------------------------------------- statements

STATEMENTS = {"INCOME_STATEMENT": ("totalRevenue", "operatingIncome", "netIncome"),
              "BALANCE_SHEET": ("totalAssets", "totalLiabilities"),
              "CASH_FLOW": ("operatingCashflow",)}
FIELD_SOURCE = {"totalRevenue": "revenue", "operatingIncome": "operating_income",
                "netIncome": "net_income", "totalAssets": "total_assets",
                "totalLiabilities": "total_liabilities", "operatingCashflow": "operating_cashflow"}
FLOW_FIELDS = {"totalRevenue", "operatingIncome", "netIncome", "operatingCashflow"}


def statement_values(p: DataFrame) -> DataFrame:
    """Quarterly rows and annual rows (flows: sum of the year's quarters;
    stocks: the year-end value) dated at the year end, with an 'None' text
    where the rule puts one."""
    q = p.select("ticker", "date", F.lit("quarterly").alias("report_type"),
                 *[F.col(s).cast("decimal(38,6)").alias(f) for f, s in FIELD_SOURCE.items()])
    y = p.groupBy("ticker", F.year("date").alias("y")).agg(
        *[F.sum(F.col(s).cast("decimal(38,6)")).alias(f) if f in FLOW_FIELDS
          else F.max_by(F.col(s).cast("decimal(38,6)"), "date").alias(f)
          for f, s in FIELD_SOURCE.items()])
    y = y.select("ticker", F.make_date("y", F.lit(12), F.lit(31)).alias("date"),
                 F.lit("annual").alias("report_type"), *FIELD_SOURCE)
    v = q.unionByName(y)
    tn = variants.ticker_no()
    bad = F.pmod(tn * 5 + F.year("date") + F.month("date"), F.lit(17)) == 0
    return v.withColumns({f: F.when(bad & (F.lit(f) == "operatingIncome"), F.lit("None"))
                          .otherwise(F.col(f).cast("double").cast("string")) for f in FIELD_SOURCE})


def land_statements(spark: SparkSession, sf_dir: str) -> str:
    """K1: one JSON payload per (symbol, statement)."""
    key = (spark.sparkContext.applicationId, "statements:" + sf_dir, data_version(spark, sf_dir))
    if key in _LANDED:
        return _LANDED[key]
    root = job_folder(spark, "statements_" + hashlib.sha1("|".join(key).encode()).hexdigest()[:12])
    v = statement_values(panel(spark, sf_dir))
    outs = []
    for fn, fields in STATEMENTS.items():
        rep = F.struct(F.date_format("date", "yyyy-MM-dd").alias("fiscalDateEnding"),
                       F.lit("USD").alias("reportedCurrency"), *[F.col(f) for f in fields])
        g = v.groupBy("ticker").agg(
            F.sort_array(F.collect_list(F.when(F.col("report_type") == "annual",
                                               F.struct("date", rep.alias("r")))), False).alias("a"),
            F.sort_array(F.collect_list(F.when(F.col("report_type") == "quarterly",
                                               F.struct("date", rep.alias("r")))), False).alias("q"))
        outs.append(g.select(F.lit(fn).alias("function"), "ticker", F.to_json(F.struct(
            F.col("ticker").alias("symbol"),
            F.transform("a", lambda x: x["r"]).alias("annualReports"),
            F.transform("q", lambda x: x["r"]).alias("quarterlyReports"))).alias("value")))
    docs = outs[0].unionByName(outs[1]).unionByName(outs[2])
    # spread the write by symbol (three statement kinds would be three hot tasks)
    (docs.repartition("ticker").select("function", "value")
         .write.mode("overwrite").partitionBy("function").text(root))
    _LANDED[key] = root
    return root


def statement_flatten(spark: SparkSession, root: str) -> DataFrame:
    """annualReports ++ quarterlyReports per document; the first report
    per fiscal date wins (annual before quarterly); empty dates dropped."""
    docs = spark.read.text(root).select(F.col("function"), F.parse_json("value").alias("d"))
    rep = lambda k: F.variant_get("d", f"$.{k}", "array<variant>")
    ex = docs.select("function", F.variant_get("d", "$.symbol", "string").alias("symbol"),
                     F.posexplode(F.concat(
                         F.transform(rep("annualReports"), lambda r: F.struct(F.lit(0).alias("rank"), r.alias("r"))),
                         F.transform(rep("quarterlyReports"), lambda r: F.struct(F.lit(1).alias("rank"), r.alias("r")))))
                     .alias("pos", "x"))
    ex = ex.select("function", "symbol", "pos", F.col("x.rank").alias("src_rank"),
                   F.variant_get("x.r", "$.fiscalDateEnding", "string").alias("fiscalDateEnding"), "x.r")
    ex = ex.filter(F.col("fiscalDateEnding").isNotNull() & (F.col("fiscalDateEnding") != ""))
    w = Window.partitionBy("symbol", "function", "fiscalDateEnding").orderBy("src_rank", "pos")
    first = ex.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    fields = sorted({f for fs in STATEMENTS.values() for f in fs})
    return first.select("symbol", "function", F.to_date("fiscalDateEnding").alias("fiscal_date"),
                        F.when(F.col("src_rank") == 0, "annual").otherwise("quarterly").alias("report_type"),
                        *[F.variant_get("r", f"$.{f}", "string").alias(f) for f in fields])


def merge_statements(flat: DataFrame) -> DataFrame:
    """Income ⋈ balance ⋈ cash flow on (symbol, fiscal date); values
    that do not parse become 0."""
    def part(fn):
        fs = STATEMENTS[fn]
        return flat.filter(F.col("function") == fn).select(
            "symbol", "fiscal_date",
            *[F.coalesce(F.col(f).try_cast("double"), F.lit(0.0)).alias(FIELD_SOURCE[f]) for f in fs])
    return part("INCOME_STATEMENT").join(part("BALANCE_SHEET"), ["symbol", "fiscal_date"]) \
        .join(part("CASH_FLOW"), ["symbol", "fiscal_date"])


def common_dates(flat: DataFrame) -> DataFrame:
    """Fiscal dates present in all three statements of a symbol."""
    d = [flat.filter(F.col("function") == fn).select("symbol", "fiscal_date") for fn in STATEMENTS]
    return d[0].intersect(d[1]).intersect(d[2])
