"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors of one label become one class with a weight.  The moments of all unit
vectors (summed by Spark) give the principal directions, strongest first.  Two vectors
of cosine t or more differ by at most sqrt(2 - 2t) in every direction, so classes are
laid on a grid of that width along up to `AXES` directions in which they spread wider
than a cell, and only equal or neighbouring cells meet.  Cells are split by hash into
tiles of `TILE_BYTES`.

A task compares two tiles, `SIDE` by `SIDE` classes at a time: it multiplies `STEP`
leading dimensions, adds the product of the two suffix norms as a bound on what is left,
and stops for every pair whose bound falls below t.  Survivors get the exact cosine of
the original vectors.  It returns link counts and one link to the smallest class of each
part, never the pairs; components come from those links.

Where vectors spread in no direction (close to random ones), every tile of a label meets
every other: an exact answer has no way round that, and larger tiles are what keeps the
rows dealt to a task few.

Defined results: a null, zero or non-finite vector, or a null label, links with
nothing; vectors of other lengths never meet; repeated rows count each; a null
vec_id still counts as a link of others and has a null component; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Stages
from ledgerline.llm.components import connected_components
from ledgerline.llm.vectors import exact_cosine, matrix, unit, whole_vectors

#: Bytes of doubles in a tile, and classes that are multiplied at once.
TILE_BYTES, SIDE = 1 << 23, 2048
AXES = 3
STEP = 8
THRESHOLD = 0.93
_SLACK = 1e-9


def _moments(batches):
    """A task's sums of x_i * x_j over unit vectors, then of x_i, by vector length."""
    import pyarrow as pa

    sums: dict = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            m = unit(matrix(batch.filter(pa.array(dims == d)).column("v")))
            sums[int(d)] = sums.get(int(d), 0) + np.concatenate([(m.T @ m).ravel(), m.sum(axis=0), [len(m)]])
    for d, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * len(s), pa.int32()), pa.array(np.arange(len(s)), pa.int32()),
                                          pa.array(s)], ["dim", "k", "s"])


def principal_axes(vectors: DataFrame, width: float) -> dict:
    """Per vector length, the matrix that turns vectors into PCA order, and its columns to lay the grid on."""
    sums = vectors.select("v", "dim").mapInArrow(_moments, "dim int, k int, s double")
    table = sums.groupBy("dim", "k").agg(F.sum("s").alias("s")).toPandas()  # dim * dim numbers a length
    out = {}
    for d, part in table.groupby("dim"):
        m = np.zeros(d * d + d + 1)
        m[part["k"].to_numpy()] = part["s"].to_numpy()
        second, mean = m[:d * d].reshape(d, d), m[d * d:-1] / m[-1]
        turn = np.linalg.eigh(second)[1][:, ::-1]
        spread = np.sqrt(np.maximum(0, ((second @ turn) * turn).sum(axis=0) / m[-1] - (mean @ turn) ** 2))
        wide = np.argsort(-spread, kind="stable")[:AXES]
        out[int(d)] = turn, wide[spread[wide] > width]
    return out


def _cells(axes, width: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros((AXES, batch.num_rows), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                turn, wide = axes.value[int(d)]
                lead = unit(matrix(batch.take(pa.array(at)).column("v"))) @ turn[:, wide]
                cell[:len(wide), at] = np.floor(lead / width).astype(np.int64).T
            for k in range(AXES):
                batch = batch.append_column(f"c{k}", pa.array(cell[k]))
            yield batch
    return run


def similar_pairs(a: np.ndarray, b: np.ndarray, threshold: float, turn: np.ndarray, same: bool):
    """Index pairs (i, j) of rows of two tiles whose exact cosine reaches the threshold."""
    x, y = unit(a) @ turn, unit(b) @ turn
    rest_x = np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]))
    rest_y = np.sqrt(np.maximum(0, np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]))
    dim, k = x.shape[1], min(STEP, x.shape[1])
    total = x[:, :k] @ y[:, :k].T
    bound = total + np.outer(rest_x[:, k], rest_y[:, k]) if k < dim else total
    i, j = np.nonzero(bound >= threshold - _SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    total = total[i, j]
    while k < dim and len(i):
        e = min(k + STEP, dim)
        parts = [np.einsum("ij,ij->i", x[i[s:s + 65536], k:e], y[j[s:s + 65536], k:e]) for s in range(0, len(i), 65536)]
        total, k = total + np.concatenate(parts), e
        bound = total + (rest_x[i, k] * rest_y[j, k] if k < dim else 0)
        go = bound >= threshold - _SLACK
        i, j, total = i[go], j[go], total[go]
    if len(i):
        go = np.concatenate([exact_cosine(a[i[s:s + 65536]], b[j[s:s + 65536]]) for s in range(0, len(i), 65536)]) >= threshold
        i, j = i[go], j[go]
    return i, j


def join_parts(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Parts (each row's smallest known member) after the links i - j."""
    while len(i):
        a, b = part[i], part[j]
        go = a != b
        i, j, a, b = i[go], j[go], a[go], b[go]
        np.minimum.at(part, np.maximum(a, b), np.minimum(a, b))
        while (part[part] != part).any():
            part = part[part]
    return part


def _compare(axes, threshold: float):
    def run(table):
        import pyarrow as pa

        side, h, w = (table.column(c).to_numpy() for c in ("side", "h", "w"))
        v = matrix(table.column("v"))
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
        same = not (side == 1).any()  # one tile against itself: all rows are on both sides
        turn = axes.value[v.shape[1]][0]
        n, part = np.zeros(len(h)), np.arange(len(h))
        for a in range(0, len(left), SIDE):
            for b in range(a if same else 0, len(right), SIDE):
                own, other = left[a:a + SIDE], right[b:b + SIDE]
                i, j = similar_pairs(v[own], v[other], threshold, turn, same and a == b)
                i, j = own[i], other[j]
                n += np.bincount(i, w[j], len(h)) + np.bincount(j, w[i], len(h))
                part = join_parts(part, i, j)
        some, tied = np.flatnonzero(n), np.flatnonzero(part != np.arange(len(h)))
        return pa.table({
            "h": pa.array(np.concatenate([h[some], h[tied]]).astype(np.int64), pa.int64()),
            "n": pa.array(np.concatenate([n[some], np.zeros(len(tied))]).astype(np.int64), pa.int64()),
            "other": pa.array([None] * len(some) + h[part[tied]].tolist(), pa.int64())})
    return run


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    `tile`: classes of a tile, as many as TILE_BYTES hold unless given.
    """
    spark = df.sparkSession
    stages = Stages(spark, "embed-dedup")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    whole = whole_vectors(rows).where("label is not null").withColumn(
        "h", F.xxhash64(F.col("label").cast("string"), "v"))
    whole = stages.keep(whole.select("vec_id", F.col("label").cast("string").alias("label"), "dim", "h", "v"), "whole")
    classes = stages.keep(whole.groupBy("h", "label", "dim", "v").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w")), "classes")
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    axes = spark.sparkContext.broadcast(principal_axes(classes, width))
    at = [f"c{k}" for k in range(AXES)]
    celled = stages.keep(classes.mapInArrow(_cells(axes, width), "h long, label string, dim int, v array<double>, rep long, "
                                            "w long, " + ", ".join(f"{c} long" for c in at)), "cells")
    cell = ["label", "dim", *at]
    tile = F.lit(tile) if tile else F.greatest(F.lit(1), F.expr(f"{TILE_BYTES} div (8 * dim)"))
    sizes = stages.keep(celled.groupBy(*cell).agg(F.count(F.lit(1)).alias("size")).select(
        *cell, F.ceil(F.col("size") / tile).cast("long").alias("parts")), "sizes")
    tiles = stages.keep(sizes.select(*cell, F.explode(F.expr("sequence(0L, parts - 1)")).alias("part")), "tiles")
    # a cell meets itself and those that follow it among its neighbours, so two cells meet once
    steps = [s for s in itertools.product((-1, 0, 1), repeat=AXES) if s >= (0,) * AXES]
    met = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"s{k}") for k, x in enumerate(s)]) for s in steps])
    a = tiles.select("label", "dim", *at, "part", F.explode(met).alias("s")).select(
        "label", "dim", *[F.col(c).alias(f"a{c}") for c in at], F.col("part").alias("apart"),
        *[(F.col(c) + F.col(f"s.s{k}")).alias(c) for k, c in enumerate(at)],
        F.expr(" and ".join(f"s.s{k} = 0" for k in range(AXES))).alias("itself"))
    pairs = a.join(tiles, cell).where("not itself or apart <= part").withColumn("same", F.expr("itself and apart = part"))
    pairs = stages.keep(pairs.withColumn("pair", F.xxhash64("label", "dim", *[f"a{c}" for c in at], "apart", *at, "part")),
                        "tile-pairs")
    placed = celled.join(sizes, cell).withColumn("part", F.pmod(F.xxhash64("h", F.lit(5)), F.col("parts")))
    placed = stages.keep(placed.select(*cell, "part", "h", "w", "v"), "placed")
    first = pairs.select("label", "dim", *[F.col(f"a{c}").alias(c) for c in at], F.col("apart").alias("part"), "pair",
                         F.expr("if(same, 0, 1)").alias("side"))
    second = pairs.where("not same").select(*cell, "part", "pair", F.lit(2).alias("side"))
    dealt = placed.join(first.union(second), [*cell, "part"]).select("pair", "side", "h", "w", "v")
    found = stages.keep(dealt.groupBy("pair").applyInArrow(
        _compare(axes, threshold), "h long, n long, other long"), "found")
    links = found.where("other is null").groupBy("h").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("other is not null").select(
        F.col("h").alias("a"), F.col("other").alias("b")), stages)
    named = classes.select("h", "rep", "w").join(parts.withColumnRenamed("node", "h"), "h", "left").select(
        "h", "rep", "w", F.coalesce("component", "h").alias("part"))
    named = stages.keep(named.join(links, "h", "left"), "named")
    first_id = stages.keep(named.groupBy("part").agg(F.min("rep").alias("component")), "first")
    of_class = stages.keep(named.join(first_id, "part").select(
        "h", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("links"), "component"), "of-class")
    members = whole.select(F.col("vec_id"), "h").join(of_class, "h").select("vec_id", "links", "component")
    lone = rows.select("vec_id").exceptAll(whole.select("vec_id"))
    out = members.union(lone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.select("vec_id", F.col("links").alias("n_links"), F.expr(
        "if(vec_id is null, null, component)").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = f"""
with recursive v as (select vec_id, label, embedding::double[] as x from embeddings),
 w as (select * from v where label is not null and x is not null and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0
     and len(list_filter(x, lambda c: c <> 0)) > 0),
 l as (select a.vec_id as a, b.vec_id as b from w a join w b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
     where list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
 r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
 f as (select a, min(b) as component_id from r group by a),
 n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from v join f on f.a = vec_id left join n on n.a = vec_id
"""
