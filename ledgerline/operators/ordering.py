"""Global orderings without a single-partition window.

A window with no ``partitionBy`` moves every row into one task.  Rankings
over all tickers (1e9 of them at the target scale) instead use:

``global_rank``
    distinct values with multiplicities (a hot value collapses to one row),
    range buckets from approximate quantiles (``nb - 1`` boundaries reach the
    driver: bounded by the partition count), per-bucket totals (``nb`` rows,
    broadcast — a proven bound), a running sum inside each bucket, then a join
    back on the value (AQE splits a skewed value on the large side).

``global_row_number``
    range-partitioned, sorted, reliably checkpointed rows; row numbers are
    the per-partition offset (``nb`` counts) plus the position inside the
    partition.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import shared_dir


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def global_rank(df: DataFrame, value_col: str, out_col: str, descending: bool = True,
                method: str = "average") -> DataFrame:
    """pandas-style rank of ``value_col`` over all rows (1 = first in the
    order).  ``method`` = 'average' (ties share the mean position) or 'min'.
    NULL values get a NULL rank."""
    v = F.col(value_col).cast("double")
    key = (-v) if descending else v
    vc = (df.select(key.alias("_k")).filter(F.col("_k").isNotNull())
            .groupBy("_k").agg(F.count(F.lit(1)).alias("_n")))
    nb = _parts(df)
    bounds = sorted(set(vc.approxQuantile("_k", [i / nb for i in range(1, nb)], 0.001))) \
        if nb > 1 else []
    splits = [float("-inf")] + [b for b in bounds if b not in (float("-inf"), float("inf"))] \
        + [float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_k", outputCol="_b").transform(vc)
    totals = bucketed.groupBy("_b").agg(F.sum("_n").alias("_bn"))
    offsets = totals.select(
        "_b", F.coalesce(F.sum("_bn").over(
            Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_off"))  # one row per bucket: the unpartitioned window is bounded
    w = Window.partitionBy("_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.join(F.broadcast(offsets), "_b").select(
        "_k", "_n", (F.col("_off") + F.coalesce(F.sum("_n").over(w), F.lit(0))).alias("_before"))
    if method == "average":
        r = F.col("_before") + (F.col("_n") + 1) / 2.0
    elif method == "min":
        r = (F.col("_before") + 1).cast("double")
    else:
        raise ValueError(method)
    ranks = ranked.select("_k", r.alias(out_col))
    return (df.withColumn("_k", key).join(ranks, "_k", "left").drop("_k"))


def global_rank_many(df: DataFrame, id_cols, value_cols, descending: bool = True,
                     suffix: str = "_rank_avg") -> DataFrame:
    """Average-tie ranks of several columns over all rows in one set of
    stages: a long (metric, value) form, distinct values with multiplicities
    per metric, per-metric ``percentile_approx`` range buckets, bucket
    offsets (metrics × buckets rows), running counts inside (metric, bucket),
    and a pivot back to one row per id (``id_cols`` must identify rows)."""
    ids = list(id_cols)
    nb = _parts(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("_m"), F.col(c).cast("double").alias("_v"))
                      for c in value_cols])
    lf = df.select(*ids, F.inline(pairs))
    key = (-F.col("_v")) if descending else F.col("_v")
    lf = lf.withColumn("_k", key)
    vc = lf.filter(F.col("_k").isNotNull()).groupBy("_m", "_k").agg(F.count(F.lit(1)).alias("_n"))
    bounds = vc.groupBy("_m").agg(
        F.percentile_approx("_k", [i / nb for i in range(1, nb)], 10000).alias("_bounds")) \
        if nb > 1 else vc.select("_m").distinct().withColumn("_bounds", F.array().cast("array<double>"))
    vb = vc.join(bounds, "_m").withColumn(
        "_b", F.size(F.filter("_bounds", lambda b: b < F.col("_k")))).drop("_bounds")
    tot = vb.groupBy("_m", "_b").agg(F.sum("_n").alias("_bn"))
    off = tot.select("_m", "_b", F.coalesce(F.sum("_bn").over(
        Window.partitionBy("_m").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    w = Window.partitionBy("_m", "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    ranked = vb.join(off, ["_m", "_b"]).select(
        "_m", "_k", (F.col("_off") + F.coalesce(F.sum("_n").over(w), F.lit(0))
                     + (F.col("_n") + 1) / 2.0).alias("_r"))
    out = lf.join(ranked, ["_m", "_k"], "left")
    return out.groupBy(*ids).agg(
        *[F.max(F.when(F.col("_m") == c, F.col("_v"))).alias(c) for c in value_cols],
        *[F.max(F.when(F.col("_m") == c, F.col("_r"))).alias(f"{c}{suffix}") for c in value_cols])


def global_row_number(df: DataFrame, order: list[Column], out_col: str = "row_no") -> DataFrame:
    """1-based row number over a total order (``order`` must be unique)."""
    shared_dir(df.sparkSession)
    nb = _parts(df)
    ranged = df.repartitionByRange(nb, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    ranged = ranged.select("*", F.spark_partition_id().alias("_p"),
                           F.monotonically_increasing_id().alias("_mid"))
    counts = {r["_p"]: r["n"] for r in
              ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= nb rows
    acc, rows = 0, []
    for p in sorted(counts):
        rows.append((p, acc))
        acc += counts[p]
    spark = df.sparkSession
    offs = spark.createDataFrame(rows or [(0, 0)], "_p int, _off long")
    local = F.col("_mid") - F.shiftleft(F.col("_p").cast("long"), 33)
    return (ranged.join(F.broadcast(offs), "_p")
                  .withColumn(out_col, F.col("_off") + local + 1)
                  .drop("_p", "_mid", "_off"))
