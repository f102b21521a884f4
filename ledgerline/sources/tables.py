"""Readers for the driver's parquet tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan; naming the columns up front keeps ReadSchema minimal."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


PANEL_SOURCES = ("lineitem", "part", "supplier", "nation", "region")


def data_version(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the panel's source files (path, length, modification time), so
    artifacts kept per application never outlive changed inputs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in PANEL_SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        fs = path.getFileSystem(conf)
        for st in (fs.globStatus(path) or []):
            seen.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.sha1("|".join(seen).encode()).hexdigest()[:12]
