"""Incremental upload ingest with Structured Streaming.

The reference ingests uploads on demand (extract -> normalise -> validate ->
keep-last upsert per (ticker, date, user)).  Here the same flow runs as a
stream over the upload landing folders, of every shape:

``readStream`` (file sources, fixed schemas, ``maxFilesPerTrigger``) ->
normalise, fill the ticker from the upload, stamp the user -> append to a
Parquet table with the file sink, which commits every batch exactly once.

A row carries its ``load_seq``; the row loaded last wins, whatever the order
of arrival.  That is resolved when the table is read (one aggregation with
map-side combine), so a batch costs its own size and never rewrites the
table; :func:`compact` writes the resolved table anew now and then.

An upload that lands again under another name is another matter: uploads that are
whole documents carry a content hash, and keyed state on (user, ticker, hash) lets each
content through once, over triggers and restarts (:func:`append_unique`).

Table, stream checkpoint and compacted copies live under one folder that the
caller names in shared storage, so a restarted job goes on where it ended.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import parsing as P
from ledgerline.operators import tables
from ledgerline.sources import files

MEASURE_SOURCES = {"revenue": "Total Revenue", "net_income": "Net Profit",
                   "operating_income": "Operating Profit", "total_assets": "Total Assets",
                   "total_liabilities": "Total Liabilities",
                   "operating_cashflow": "Cash From Operations"}


def normalize_batch(records: DataFrame) -> DataFrame:
    """Raw upload records -> typed rows; a missing or unusable symbol is filled
    with the upload's ticker (C5)."""
    seq = F.col("load_seq") if "load_seq" in records.columns else F.col("upload_id")
    d = records.select(
        F.coalesce(P.clean_ticker("Symbol"), F.col("upload_ticker")).alias("ticker"),
        P.parse_period_date("Period").alias("date"),
        *[P.parse_money(src).alias(dst) for dst, src in MEASURE_SOURCES.items()],
        files.upload_user().alias("user_id"), seq.cast("long").alias("load_seq"))
    return d.filter(F.col("ticker").isNotNull() & F.col("date").isNotNull())


def upload_stream(spark: SparkSession, root: str, files_per_trigger: int = 200) -> DataFrame:
    """New records of all landing folders under ``root``."""
    schema = ", ".join(f"`{c}` string" for c in files.RECORD_COLS)
    source = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    csv = source.schema(schema).option("header", True).csv(os.path.join(root, "csv"))
    out = csv.withColumns({c: F.col(c).cast("bigint") for c in ("upload_id", "row_pos")})
    for shape in files.JSON_SHAPES:
        lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) \
            .text(os.path.join(root, "json", shape))
        out = out.unionByName(files.flex_records(lines.select("value")))
    return out


def append_stream(records: DataFrame, table_dir: str) -> None:
    """Run a stream of raw records to the end of what is there now."""
    query = (normalize_batch(records).writeStream.format("parquet").outputMode("append")
             .option("path", os.path.join(table_dir, "rows"))
             .option("checkpointLocation", os.path.join(table_dir, "checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()


def read_table(spark: SparkSession, table_dir: str) -> DataFrame:
    """The table: per (ticker, date, user) the row with the largest ``load_seq``."""
    return tables.dedupe_keep_last(spark.read.parquet(os.path.join(table_dir, "rows")))


def compact(spark: SparkSession, table_dir: str, target: str) -> None:
    """Write the resolved table to ``target`` (reads no longer pay for old loads)."""
    read_table(spark, table_dir).repartition("user_id", "ticker") \
        .write.mode("overwrite").parquet(target)


def run_upload_stream(spark: SparkSession, root: str, table_dir: str,
                      files_per_trigger: int = 200) -> DataFrame:
    """Ingest the uploads present under ``root`` and return the table."""
    append_stream(upload_stream(spark, root, files_per_trigger), table_dir)
    return read_table(spark, table_dir)


# ------------------------------------------------------------ duplicate uploads

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def document_stream(spark: SparkSession, root: str, files_per_trigger: int = 200) -> DataFrame:
    """Uploads that land as one document each (an array, or an object with the records
    in its first list), one row per document: envelope, records and content hash."""
    source = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    lines = [source.text(os.path.join(root, "json", shape)) for shape in files.JSON_SHAPES[:2]]
    return identified(lines[0].union(lines[1]))


def identified(lines: DataFrame) -> DataFrame:
    """upload_id, user_id, ticker, content_hash, records of documents (``value``).

    The hash is A23's: SHA-256 of the records' canonical JSON in upload order.  An
    expression per document, so it needs no grouping and runs on a stream.
    """
    docs = files.document_records(lines)
    canonical = F.transform("records", lambda r: F.struct(*[r[c].alias(c) for c in sorted(files.UPLOAD_COLS)]))
    first = F.get("records", F.lit(0))
    d = docs.filter(F.size("records") > 0).select(
        first["upload_id"].cast("long").alias("upload_id"), F.upper(first["upload_ticker"]).alias("ticker"),
        F.sha2(F.to_json(canonical, {"ignoreNullFields": "false"}), 256).alias("content_hash"), "records")
    return d.select("upload_id", files.upload_user().alias("user_id"), "ticker", "content_hash", "records")


def append_unique(documents: DataFrame, table_dir: str) -> None:
    """Run a stream of documents to the end of what is there now; a content that its user
    and ticker delivered before is dropped.

    The state holds one key for each distinct upload, like the list of stored uploads it
    stands for; RocksDB keeps it on disk.  It lives in the checkpoint, so a restart goes
    on with it.
    """
    spark = documents.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        (documents.dropDuplicates(["user_id", "ticker", "content_hash"]).writeStream.format("parquet")
         .outputMode("append").option("path", os.path.join(table_dir, "uploads"))
         .option("checkpointLocation", os.path.join(table_dir, "uploads-checkpoint"))
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(STATE_STORE, before)


def unique_uploads(spark: SparkSession, table_dir: str) -> DataFrame:
    """The accepted uploads, one row each."""
    return spark.read.parquet(os.path.join(table_dir, "uploads"))


def unique_rows(spark: SparkSession, table_dir: str) -> DataFrame:
    """The typed rows of the accepted uploads."""
    u = unique_uploads(spark, table_dir).select(F.explode("records").alias("r")).select("r.*")
    return normalize_batch(u.withColumn("upload_id", F.col("upload_id").cast("long")))
