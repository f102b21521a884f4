"""Approximate nearest neighbours by multiprobe p-stable hashing.

`TABLES` tables of `HASHES` functions floor((a.x + b) / WIDTH) with Gaussian a are
applied to unit vectors, whose Euclidean order is their cosine order.  Every row is
indexed in one bucket per table.  A query visits `PROBES` buckets per table, in order
of estimated success: a perturbation moves some of its coordinates one cell down or
up and costs the sum of squared distances to the walls it crosses.  All 3**HASHES
perturbations are scored, so the order is the true one.

Buckets are dealt by Spark: rows of a bucket in blocks of `BLOCK` by hash, queries
likewise, so neither a hot bucket nor a popular probe makes a large group.  Each
(bucket, row block, query block) has a number of its own and is dealt by that number
alone, so those of a hot bucket spread over all tasks; it reranks by the exact cosine
and returns its k best, each vec_id once; they are merged per query.  Repeated rows collapse to one before
they are indexed.  A query that found fewer than k although more rows exist
visits every bucket of the first table, so small tables are answered in full.

More rows take more hash functions, so that buckets stay small, and more tables and
probes, so that neighbours stay found (`settings`).  The figures were fitted on vectors
that are close to random directions, where neighbours at cosine 0.4 must be told from
background at 0.1; see the README for the measured recall and share of rows visited.

Defined results: null, zero or non-finite vectors take no part, nor do rows with a
null vec_id; only vectors of the query's length are candidates; rows with the
query's vec_id are its own; ties go to the smaller vec_id; repeated candidates of one
vec_id count once, with their best score; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Stages, mix64
from ledgerline.llm.vectors import exact_cosine, matrix, scaled, unit, whole_vectors

TABLES, HASHES, WIDTH, PROBES = 4, 6, 2.0, 48
#: Up to so many rows the settings above hold; every eightfold adds a hash function and a table.
FEW_ROWS = 2500
BLOCK = 2048
#: Rows that one group holds on average: small blocks share a group, each is reranked by itself.
DEALT = 1 << 15


def settings(rows: int) -> tuple[int, int, int]:
    """Tables, hash functions and probes for an index of so many rows."""
    level = max(0, math.ceil(math.log(max(rows, 1) / FEW_ROWS, 8)))
    return TABLES + level, HASHES + level, int(PROBES * 1.5 ** level)


class PStable:
    """The hash functions for vectors of one length."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float):
        rng = np.random.default_rng([7, dim])
        self.shape, self.width = (tables, hashes), width
        self.a = rng.standard_normal((dim, tables * hashes))
        self.b = rng.uniform(0, width, tables * hashes)
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=hashes)))

    def cells(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and positions within the cells, as rows x tables x hashes."""
        p = (unit(m) @ self.a + self.b) / self.width
        low = np.floor(p)
        return low.astype(np.int64).reshape(-1, *self.shape), (p - low).reshape(-1, *self.shape)

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        """One 64-bit bucket number per row of cells."""
        key = np.zeros(cells.shape[:-1], np.uint64)
        for k in range(cells.shape[-1]):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.uint64) + np.uint64(k + 1))
        return key.view(np.int64)

    def probes(self, m: np.ndarray, n: int) -> np.ndarray:
        """rows x tables x n buckets, most promising first."""
        cells, at = self.cells(m)
        out = np.zeros((len(m), self.shape[0], min(n, len(self.moves))), np.int64)
        cost = np.stack([at ** 2, np.zeros_like(at), (1 - at) ** 2], -1)
        for t in range(self.shape[0]):
            score = sum(cost[:, t, k][:, self.moves[:, k] + 1] for k in range(self.shape[1]))
            best = np.argsort(score, axis=1, kind="stable")[:, :out.shape[2]]
            out[:, t] = self.buckets(cells[:, t][:, None, :] + self.moves[best])
        return out


def _hashed(tables: int, hashes: int, width: float, probes: int):
    """Rows of (vec_id, dim, v) once per table with their bucket, or once per probe."""
    def run(batches):
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                dims = part.column("dim").to_numpy()
                for d in np.unique(dims):
                    own = part.filter(pa.array(dims == d))
                    f = held.setdefault(int(d), PStable(int(d), tables, hashes, width))
                    m = matrix(own.column("v"))
                    found = f.probes(m, probes) if probes else f.buckets(f.cells(m)[0])[:, :, None]
                    n = found.shape[1] * found.shape[2]
                    row = pa.array(np.repeat(np.arange(len(m)), n))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("vec_id").take(row), own.column("dim").take(row), own.column("v").take(row),
                         pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), found.shape[2]), len(m))),
                         pa.array(found.ravel())], ["vec_id", "dim", "v", "tab", "bucket"])
    return run


def _best(ids: np.ndarray, m: np.ndarray, query: np.ndarray, k: int):
    """(query ids, candidate ids, cosines) of the k best of one block, each candidate id once."""
    q, c = np.flatnonzero(query), np.flatnonzero(~query)
    if not len(q) or not len(c):
        return
    norm = np.sqrt((m * m).sum(axis=1))
    c = c[np.argsort(ids[c], kind="stable")]
    first = np.flatnonzero(np.diff(ids[c], prepend=ids[c[0]] - 1))
    for s in range(0, len(q), 256):
        mine = q[s:s + 256]
        score = (m[mine] @ m[c].T) / np.outer(norm[mine], norm[c])
        score[ids[mine][:, None] == ids[c][None, :]] = -np.inf
        best = np.maximum.reduceat(score, first, axis=1)  # copies of a vec_id count once
        edge = -np.partition(-best, k - 1, axis=1)[:, k - 1] if len(first) > k else best.min(axis=1)
        r, j = np.nonzero((score >= edge[:, None] - 1e-12) & np.isfinite(score))  # all ties of the last place
        exact, own = exact_cosine(m[mine[r]], m[c[j]]), ids[c[j]]
        order = np.lexsort((-exact, own, r))
        new = np.ones(len(r), bool)
        new[1:] = (np.diff(own[order]) != 0) | (np.diff(r[order]) != 0)
        r, j, exact, own = (x[order[new]] for x in (r, j, exact, own))
        order = np.lexsort((own, -exact, r))
        rank = np.arange(len(r)) - np.searchsorted(r[order], r[order], "left")
        some = order[rank < k]
        yield ids[mine[r[some]]], own[some], exact[some]


def _rerank(k: int):
    def run(table):
        import pyarrow as pa

        block = table.column("block").to_numpy() if "block" in table.schema.names else np.zeros(len(table), np.int64)
        query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
        ids, m = table.column("vec_id").to_numpy(), scaled(matrix(table.column("v")))
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        found = [x for at in np.split(order, cuts) for x in _best(ids[at], m[at], query[at], k)]
        flat = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
        return pa.table({"query_id": pa.array(flat[0].astype(np.int64)), "vec_id": pa.array(flat[1].astype(np.int64)),
                         "score": pa.array(flat[2].astype(float))})
    return run


def _visit(rows: DataFrame, probes: DataFrame, stages: Stages, name: str, k: int, block: int) -> DataFrame:
    """The k best of every (bucket, row block, query block), as (query_id, vec_id, score)."""
    at = ["tab", "bucket", "dim"]
    sizes = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    asked = probes.groupBy(*at).agg(F.count(F.lit(1)).alias("q"), F.ceil(F.count(F.lit(1)) / block).cast("long").alias("turns"))
    grid = stages.keep(sizes.join(asked, at), f"{name}-grid")  # buckets that somebody visits
    deals = -(-int(grid.agg(F.sum(F.expr("n * turns + q * blocks"))).first()[0] or 1) // DEALT)
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks"))
    turn = F.pmod(F.xxhash64("vec_id", F.lit(4)), F.col("turns"))
    one = rows.join(grid, at).select(*at, part.alias("part"), F.explode(F.expr("sequence(0L, turns - 1)")).alias("turn"),
                                     F.lit(False).alias("query"), "vec_id", "v")
    two = probes.join(grid, at).select(*at, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("part"),
                                       turn.alias("turn"), F.lit(True).alias("query"), "vec_id", "v")
    # a number of its own for each block: Spark would let groups by the joins' keys stay where the joins put them
    both = one.union(two).select(F.xxhash64(*at, "part", "turn").alias("block"), "dim", "query", "vec_id", "v")
    return both.groupBy(F.pmod("block", F.lit(deals)).alias("deal"), "dim").applyInArrow(
        _rerank(k), "query_id long, vec_id long, score double")


def search(df: DataFrame, is_query, k: int = 5, tables: int | None = None, hashes: int | None = None,
           width: float = WIDTH, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row that `is_query` (SQL) holds for.

    What isn't given of tables, hashes and probes follows the number of rows.
    """
    stages = Stages(df.sparkSession, "nearest")
    rows = whole_vectors(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).where(
        "vec_id is not null").select("vec_id", "dim", "v")
    rows = stages.keep(rows.distinct(), "rows")
    own = settings(rows.count())
    tables, hashes, probes = (x if x is not None else y for x, y in zip((tables, hashes, probes), own, strict=True))
    schema = "vec_id long, dim int, v array<double>, tab int, bucket long"
    index = stages.keep(rows.mapInArrow(_hashed(tables, hashes, width, 0), schema), "index")
    queries = rows.where(is_query)
    asked = stages.keep(queries.mapInArrow(_hashed(tables, hashes, width, probes), schema), "probes")
    found = stages.keep(_visit(index, asked, stages, "visit", k, block), "found")

    def best(x):
        x = x.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return x.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")

    first = stages.keep(best(found), "first")
    full = first.where(f"rank = {k}").select(F.col("query_id").alias("vec_id"))
    short = stages.keep(queries.join(full, "vec_id", "left_anti"), "short")
    if not short.isEmpty():  # few candidates: every bucket of the first table holds every row once
        everywhere = index.where("tab = 0").select("dim", "tab", "bucket").distinct()
        again = _visit(index.where("tab = 0"), short.join(everywhere, "dim").select(
            "vec_id", "dim", "v", "tab", "bucket"), stages, "short-visit", k, block)
        first = best(first.select("query_id", "vec_id", "score").union(again))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
