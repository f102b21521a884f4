"""Table maintenance as DataFrame operators.

There is no row-level table format here, so an upsert is a keep-last merge
(``left_anti`` on the key + ``unionByName``); deletes are rewrites with
``left_anti``.  Keys are always full
keys — nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.parsing import clean_ticker

PANEL_KEY = ("ticker", "date", "user_id")


def dedupe_keep_last(df: DataFrame, key: Sequence[str] = PANEL_KEY,
                     seq: str = "load_seq") -> DataFrame:
    """K5: one row per key, the one loaded last.  ``max_by`` on the load
    sequence is a plain aggregation (partial aggregation before the shuffle,
    so a hot key is combined map-side instead of sorted in one task)."""
    rest = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return g.select(*key, "_r.*").select(*df.columns)


def user_load(df: DataFrame, user_id: str) -> DataFrame:
    """K5 preparation: stamp the user, normalise the ticker, NaN/inf -> NULL."""
    if not user_id or user_id == "predefined":
        raise ValueError(f"Invalid user_id: {user_id}")
    return df.withColumn("user_id", F.lit(user_id)).withColumn("ticker", clean_ticker("ticker")) \
        .filter(F.col("ticker").isNotNull())


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str] = PANEL_KEY) -> DataFrame:
    """K3: keep-last merge — existing rows whose key is re-delivered are
    replaced by the new rows."""
    new_keys = new.select(*key).distinct()
    return existing.join(new_keys, list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def user_scope(df: DataFrame, user_id: str) -> DataFrame:
    """Own rows plus predefined rows."""
    return df.filter((F.col("user_id") == user_id) | (F.col("user_id") == "predefined"))


def accessible_tickers(panel_users: DataFrame, uploads: DataFrame, user_id: str) -> DataFrame:
    """Predefined tickers ∪ tickers of the user's uploads (distinct)."""
    pre = panel_users.filter(F.col("user_id") == "predefined").select("ticker")
    own = uploads.filter(F.col("user_id") == user_id).select("ticker")
    return pre.union(own).distinct()


def delete_scope(tables: dict[str, DataFrame], user_id: str, ticker: str) -> DataFrame:
    """K8: per-table count of rows a delete of (user, ticker) removes."""
    out = None
    for name, t in tables.items():
        c = t.filter((F.col("user_id") == user_id) & (F.upper("ticker") == ticker.upper())) \
            .agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        out = c if out is None else out.unionByName(c)
    return out


def apply_delete(t: DataFrame, user_id: str, ticker: str) -> DataFrame:
    """K8: the table after the delete (rewrite without the scoped rows)."""
    return t.filter(~((F.col("user_id") == user_id) & (F.upper("ticker") == ticker.upper())))


def replace_by_ticker(report: DataFrame, new: DataFrame, tickers: DataFrame) -> DataFrame:
    """Drop the report rows of the given tickers (case-insensitive) and
    append the new rows (missing columns allowed)."""
    keys = tickers.select(F.upper("ticker").alias("_t")).distinct()
    kept = report.join(keys, F.upper(report["ticker"]) == keys["_t"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def reload_verify(df: DataFrame) -> DataFrame:
    """K9: row count per ticker after a reload."""
    return df.groupBy("ticker").agg(F.count(F.lit(1)).alias("row_count"))


def content_hash(rows: DataFrame, upload_col: str | Sequence[str], order_col: str, cols: Sequence[str]) -> DataFrame:
    """SHA-256 of the canonical JSON of an upload's records (keys
    sorted, records in upload order).  The records of one upload are
    gathered into one value by construction (the hash is over the whole
    upload); uploads are independent groups."""
    cols = sorted(cols)
    rec = F.struct(*[F.col(c) for c in cols])
    keys = [upload_col] if isinstance(upload_col, str) else list(upload_col)
    g = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("_o"), rec.alias("r"))))
        .alias("_recs"))
    text = F.to_json(F.transform("_recs", lambda x: x["r"]), {"ignoreNullFields": "false"})
    return g.select(*keys, F.sha2(text, 256).alias("content_hash"))


def duplicate_uploads(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploads whose (user, ticker, hash) already exists (full semi-join,
    no row cap)."""
    return new.join(existing.select("user_id", "ticker", "content_hash").distinct(),
                    ["user_id", "ticker", "content_hash"], "left_semi")


def duplicate_keys(df: DataFrame, key: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """V5: keys that occur more than once, with their multiplicity."""
    return df.filter(F.col("date").isNotNull()).groupBy(*key) \
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
