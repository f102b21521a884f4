"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a minimum per vertex (combined before the shuffle) and a join back
to the edges, both tables written first so that a hot vertex's edges can be
split.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Stages


def _mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, stages: Stages, name: str = "cc") -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, for linked nodes only.

    Self links and null ends are dropped; repeated links count once; no links give no rows.
    """
    edges = (edges.where("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges = stages.keep(edges, f"{name}-0")
    mark, turn = _mark(edges), 0
    if not mark[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        turn += 1
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stages.keep(both.groupBy("u").agg(F.min("v").alias("m"))
                            .select("u", F.least("u", "m").alias("m")), f"{name}-{turn}-large")
        # each larger neighbour of u is tied to the smallest node around u
        star = stages.keep(both.where("v > u").join(least, "u")
                           .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
                           f"{name}-{turn}-star")
        low = stages.keep(star.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{turn}-small")
        # each smaller neighbour of u, and u itself, is tied to the smallest of them
        new = stages.keep(star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                          .union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{turn}")
        now = _mark(new)
        stages.drop(f"{name}-{turn - 1}", f"{name}-{turn}-large", f"{name}-{turn}-star", f"{name}-{turn}-small")
        if now == mark:
            break
        edges, mark = new, now
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
