"""Column-expression builders for financial classifications and growth maths.

Thresholds and labels below are fixed values that must equal the reference
behaviour; they are listed where they are used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.numeric import col_


def growth_category(growth, cur=None, prev=None) -> Column:
    """>10 High Growth; (0,10] Moderate Growth; other non-null Stable;
    null Unknown.  A zero base (growth NULL here, ±inf in pandas) keeps the
    pandas label: rising from zero is High Growth, falling from zero Stable."""
    g = col_(growth)
    out = F.when(g > 10, "High Growth").when((g > 0) & (g <= 10), "Moderate Growth") \
        .when(g.isNotNull(), "Stable")
    if cur is not None and prev is not None:
        c, p = col_(cur), col_(prev)
        out = out.when((p == 0) & (c > 0), "High Growth").when((p == 0) & (c < 0), "Stable")
    return out.otherwise("Unknown")


def risk_level(debt_to_asset) -> Column:
    """>0.7 High Risk; (0.4,0.7] Medium Risk; other non-null Low Risk."""
    d = col_(debt_to_asset)
    return (F.when(d > 0.7, "High Risk").when((d > 0.4) & (d <= 0.7), "Medium Risk")
            .when(d.isNotNull(), "Low Risk").otherwise("Unknown"))


def cagr(start, end, n) -> Column:
    """A5: ((end/start)^(1/n) - 1) * 100, NULL unless both ends are > 0.
    ``n`` is the number of rows (reference convention)."""
    s, e, n = col_(start), col_(end), col_(n)
    return F.when((s > 0) & (e > 0),
                  (F.pow(e / s, F.lit(1.0) / n) - 1) * 100)


def pct_change(first, last) -> Column:
    """(last - first) / first * 100 with NULL for a zero base."""
    f = col_(first)
    return (col_(last) - f) / F.nullif(f, F.lit(0.0)) * 100


def performance_class(total_growth, margin_last, debt_improvement) -> Column:
    """A6 weighted score -> Excellent (>=5) / Good (>=2) / Moderate (>=0) /
    Concerning.  NULL inputs behave like pandas NaN (every comparison false)."""
    g, m, d = col_(total_growth), col_(margin_last), col_(debt_improvement)
    score = (F.when(g > 50, 3).when(g > 20, 2).when(g > 0, 1).otherwise(-1)
             + F.when(m > 20, 2).when(m > 10, 1).otherwise(0)
             + F.when(d > 0, 1).otherwise(0))
    return (F.when(score >= 5, "Excellent").when(score >= 2, "Good")
            .when(score >= 0, "Moderate").otherwise("Concerning"))


def trend_label(slope, mean, n) -> Column:
    """Slope as % of mean -> five classes; mean 0 -> Neutral; fewer than
    two points -> Insufficient Data."""
    s, m, n = col_(slope), col_(mean), col_(n)
    pct = s / F.nullif(m, F.lit(0.0)) * 100
    return (F.when(n < 2, "Insufficient Data").when(m == 0, "Neutral")
            .when(pct > 5, "Strong Increase").when(pct > 1, "Moderate Increase")
            .when(pct > -1, "Stable").when(pct > -5, "Moderate Decrease")
            .otherwise("Strong Decrease"))


def clip01(x) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), col_(x)))
