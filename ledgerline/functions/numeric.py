"""Numeric helpers shared by operators.

Results are compared against an independent SQL engine, so the helpers are
chosen to be engine-independent:

* ``rnd`` rounds as ``round(x * 10^k) / 10^k``: both factors are the same
  IEEE double in any engine and half-away-from-zero on that double is
  unambiguous (rounding a double to k decimals directly depends on how an
  engine turns the double into decimal digits);
* money sums run in DECIMAL (exact, order-independent); money means are that
  exact sum divided by the count in one IEEE division.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, k: int = 6) -> Column:
    scale = float(10 ** k)
    return F.round(col_(c) * F.lit(scale)) / F.lit(scale)


def exact_sum(c) -> Column:
    return F.sum(col_(c).cast(MONEY)).cast("double")


def exact_avg(c) -> Column:
    c = col_(c)
    return exact_sum(c) / F.nullif(F.count(c), F.lit(0))


def safe_div(num, den) -> Column:
    """num / den with NULL for a zero or NULL denominator (ANSI-safe)."""
    return col_(num) / F.nullif(col_(den), F.lit(0.0))


def finite_or_null(c) -> Column:
    """NaN and ±inf -> NULL; the panel never carries NaN (Spark orders NaN
    above every number, unlike pandas)."""
    c = col_(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def as_long(c) -> Column:
    return col_(c).cast("bigint")


def rnd_sig(c, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (engine-independent: the scale
    is an exact power of ten, applied by multiplication or division)."""
    c = col_(c)
    k = F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))
    s = F.pow(F.lit(10.0), F.abs(k))
    return (F.when(c.isNull(), c).when(c == 0, F.lit(0.0))
            .when(k >= 0, F.round(c * s) / s)
            .otherwise(F.round(c / s) * s))
