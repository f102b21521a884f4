"""A stored table that takes committed upserts, deletes and replacements.

The table is a Parquet folder partitioned by key bucket, a hash of the upper-cased
ticker.  A change reads the buckets that hold changed keys, merges them, and writes
them back with dynamic partition overwrite, so other buckets keep their files and a
change costs its own buckets, not the table.  Written buckets are staged and put in their
places, one after another, when the job commits; a job that dies before its commit leaves
the table as it was, and running it again ends in the same table.

Buckets are few and fixed when the table is made; which of them a change touches (at
most all of them) is what the driver learns of it.  Row counts of a change are observed
while it is written: no second pass counts them.

Writers of one table take turns; readers that started before a commit should read again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ledgerline.operators import tables
from ledgerline.session import delete_folder

BUCKET = "key_bucket"
SCHEMA = "_schema"


class StoredTable:
    """A folder of rows keyed by `key`; `ticker` decides the bucket."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = tables.PANEL_KEY, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, list(key), buckets

    def _bucket(self, ticker="ticker") -> Column:
        return F.pmod(F.xxhash64(F.upper(F.col(ticker))), F.lit(self.buckets)).cast("int")

    def _placed(self, df: DataFrame) -> DataFrame:
        # one file per bucket and change
        return df.withColumn(BUCKET, self._bucket()).repartition(self.buckets, BUCKET)

    def _stored(self) -> DataFrame:
        # the schema lies beside the rows, so a table that lost its last row can be read too
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/{SCHEMA}").first()[0]))
        return self.spark.read.schema(schema.add(BUCKET, IntegerType())).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _touched(self, tickers: DataFrame) -> list[int]:
        return sorted(r[0] for r in tickers.select(self._bucket()).distinct().collect())  # at most `buckets`

    def reload(self, df: DataFrame) -> dict:
        """K9: put `df` in place of everything; the rows written, as they were written."""
        seen = Observation()
        self._placed(df).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ticker").isNull()).alias("without_ticker")) \
            .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(self.path)
        self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(f"{self.path}/{SCHEMA}")
        return seen.get

    def _commit(self, touched: list[int], change) -> dict:
        """Rewrite the touched buckets as `change` (old rows -> new rows) says."""
        if not touched:
            return {"rows": 0, "buckets": 0}
        old = self._stored().filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
        new = self._placed(change(old).select(*old.columns))
        seen = Observation()
        new.observe(seen, F.count(F.lit(1)).alias("rows"), F.collect_set(BUCKET).alias("filled")) \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        got = seen.get
        # a bucket that lost its last row was not written: its old files go
        self._drop(set(touched) - set(got["filled"]))
        return {"rows": got["rows"], "buckets": len(touched)}

    def _drop(self, buckets) -> None:
        for b in buckets:
            delete_folder(self.spark, f"{self.path}/{BUCKET}={b}")

    def upsert(self, new: DataFrame) -> dict:
        """K3: rows with a stored key replace the stored ones, others are added; of
        several new rows with one key the last loaded stays where there is a `load_seq`."""
        if "load_seq" in new.columns:
            new = tables.dedupe_keep_last(new, self.key)
        return self._commit(self._touched(new), lambda old: tables.upsert(old, new, self.key))

    def delete(self, user_id: str, ticker: str) -> dict:
        """K8: the rows of a user's ticker go."""
        one = self.spark.createDataFrame([(ticker,)], "ticker string")
        return self._commit(self._touched(one), lambda old: tables.apply_delete(old, user_id, ticker))

    def replace_tickers(self, new: DataFrame, tickers: DataFrame) -> dict:
        """The rows of `tickers` (in any case) go and `new` is added."""
        both = tickers.select("ticker").union(new.select("ticker"))
        return self._commit(self._touched(both), lambda old: tables.replace_by_ticker(old, new, tickers))

    def files(self) -> dict[int, list[str]]:
        """Data files of every bucket, for tests and housekeeping."""
        rows = self._stored().select(BUCKET, F.col("_metadata.file_path").alias("f")).distinct().collect()
        out: dict[int, list[str]] = {}
        for r in rows:
            out.setdefault(r[0], []).append(r[1])
        return {b: sorted(f) for b, f in out.items()}


def delete_user_ticker(stored: dict[str, StoredTable], user_id: str, ticker: str) -> dict[str, dict]:
    """K8 over several stored tables: what each change wrote."""
    return {name: t.delete(user_id, ticker) for name, t in stored.items()}
