"""Vector columns inside tasks: which rows take part, and as matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector isn't null or zero and has only finite components, as column `v`, with its length `dim`.

    Components become doubles; equal vectors are equal arrays.
    """
    v = F.col(vector).cast("array<double>")
    fine = (v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    return df.where(fine).withColumn("v", F.transform(v, lambda x: x + F.lit(0.0))).withColumn("dim", F.size("v"))


def matrix(column) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled first by their largest component, so no square overflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 1/2 .. 1.

    Exact, so cosines stay the same bits, and no square overflows or vanishes.
    """
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1]) if m.size else m


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine of original vectors in double precision."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
