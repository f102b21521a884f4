"""Packing documents into fixed windows by non-negative least squares.

A document's ids are cut into full windows and one remainder while they are made,
so ids never move again: only (document, start, length, checksum) rows do.  What is
left to pack is the histogram of piece lengths, which has at most `window` entries
whatever the corpus.  On it the driver

1. enumerates shallow combinations that fill a window exactly: pairs of lengths,
   doubles with a third, and triples around the `COMMON` most frequent lengths;
2. solves repeat counts x >= 0 for min |A x - h|^2 by accelerated projected
   gradients;
3. rounds them, largest first, within what the histogram still holds;
4. packs the residual greedily, longest first, always the longest piece that fits.

Pieces then get ranks within their length (hashed sub-groups with prefix counts, as
many as the length's count asks for, so a hot length is no hot task) and read their sequence and offset from the plan.

Defined results: null text counts as empty, and an empty document is its end id
alone; repeated rows are packed each; equal pieces are ranked by (doc_id, start);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Stages
from ledgerline.llm.tokens import encode_column, vocabulary, word_table

WINDOW = 4096
COMMON = 24
STEPS = 300
#: A length has at least so many sub-groups, and more where one would rank more than RANKED pieces.
SALTS, RANKED = 16, 1 << 16


def _pieces(path: str, end_id: int, window: int):
    def run(batches):
        import pyarrow as pa

        table = word_table(path)
        for batch in batches:
            ids_col = batch.column("doc_id").to_pylist()
            doc, start, length, crc, whole = [], [], [], [], []
            for first, ids, at in encode_column(batch.column("text"), table, end_id):
                raw = memoryview(ids).cast("B")
                for r in range(len(at) - 1):
                    a, b = int(at[r]), int(at[r + 1])
                    for s in range(a, b, window):
                        e = min(s + window, b)
                        doc.append(ids_col[first + r])
                        start.append(s - a)
                        length.append(e - s)
                        crc.append(zlib.crc32(raw[4 * s:4 * e]))
                        whole.append(b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three lengths (0 for none) that fill a window exactly."""
    have = np.flatnonzero(counts)
    there = counts > 0
    rows = []
    a = have[(have * 2 <= window)]
    a = a[there[window - a]]
    rows.append(np.stack([a, window - a, np.zeros_like(a)], 1))
    third = window - 2 * have
    ok = (third > 0) & there[np.maximum(third, 0)]
    rows.append(np.stack([have[ok], have[ok], third[ok]], 1))
    for c in have[np.argsort(-counts[have], kind="stable")][:COMMON]:
        third = window - c - have
        ok = (third >= have) & (third > 0) & there[np.maximum(third, 0)]
        rows.append(np.stack([np.full(ok.sum(), c), have[ok], third[ok]], 1))
    return np.unique(np.sort(np.concatenate(rows), 1)[:, ::-1], axis=0)


def solve_counts(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """min |A x - counts|^2 for x >= 0, A's columns being the combinations."""
    n, h = len(combos), counts.astype(float).copy()
    h[0] = 0
    width = len(h)
    use = (combos > 0).astype(float)

    def forward(x):
        return sum(np.bincount(combos[:, k], x * use[:, k], width) for k in range(combos.shape[1]))

    def back(r):
        return sum(r[combos[:, k]] * use[:, k] for k in range(combos.shape[1]))

    v = np.ones(n)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - h) / top)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(counts: np.ndarray, window: int = WINDOW) -> list:
    """[(lengths of one sequence, repeats)]: uses every piece of the histogram exactly once."""
    left, out = counts.astype(np.int64).copy(), []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(left, window)
    if len(combos):
        x = solve_counts(combos, left)
        for c in np.argsort(-x, kind="stable"):
            want = int(x[c] + 0.5)
            if not want:
                break
            lengths, times = np.unique(combos[c][combos[c] > 0], return_counts=True)
            n = min(want, *(int(v) for v in left[lengths] // times))
            if n > 0:
                left[lengths] -= n * times
                out.append((tuple(int(v) for v in combos[c] if v), n))
    while left.any():
        have = np.flatnonzero(left)
        used: dict = {}
        room, top = window, len(have) - 1
        while top >= 0:
            k = int(have[top])
            fit = min(room // k, int(left[k]))
            if fit:
                used[k] = fit
                room -= fit * k
            top = min(top - 1, int(np.searchsorted(have, room, "right")) - 1)
        n = min(int(left[k]) // m for k, m in used.items())
        for k, m in used.items():
            left[k] -= n * m
        out.append((tuple(k for k, m in used.items() for _ in range(m)), n))
    return out


def slots(templates: list) -> list:
    """(length, first rank, last rank + 1, pieces a sequence, first sequence, offset) rows."""
    rows, used, sequence = [], {}, 0
    for lengths, n in templates:
        offset = 0
        for k in sorted(set(lengths), reverse=True):
            m = lengths.count(k)
            lo = used.get(k, 0)
            rows.append((k, lo, lo + m * n, m, sequence, offset))
            used[k] = lo + m * n
            offset += m * k
        sequence += n
    return rows


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    stages = Stages(spark, "packing")
    run = _pieces(tokenizer or vocabulary(), end_id, window)
    pieces = stages.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    counts = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `window` rows
        counts[length] = n
    groups = spark.createDataFrame([(int(k), max(SALTS, -(-int(counts[k]) // RANKED))) for k in np.flatnonzero(counts)],
                                   "length long, salts long")
    salted = pieces.join(F.broadcast(groups), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts"))).drop("salts")
    sizes = stages.keep(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "sizes")
    rows = slots(plan(counts, window)) if counts.any() else []
    table = spark.createDataFrame(rows, "length long, lo long, hi long, each long, first long, at long")
    # a row for each sub-group: SALTS a length, or one for RANKED pieces
    before = sizes.select("length", "salt", (F.sum("n").over(
        Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = (salted.withColumn("k", within - 1).join(F.broadcast(before), ["length", "salt"])
              .withColumn("rank", F.col("before") + F.col("k")))
    # the plan's rows are bounded by the combinations of lengths, not by the corpus
    placed = ranked.join(F.broadcast(table), "length").where("rank >= lo and rank < hi")
    turn = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.expr("(rank - lo) div each")).alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("each")) * F.col("length")).alias("offset"))
