"""Property tests: formatted amounts and period strings round-trip through
the column parsers (one Spark job per generated batch)."""

from __future__ import annotations

import calendar
import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.functions import parsing as P

amounts = st.integers(min_value=-10**12, max_value=10**12)
styles = st.sampled_from(["plain", "dollar", "paren", "pct", "K", "M", "B", "ws"])


def render(v: int, style: str) -> tuple[str, float]:
    if style == "dollar":
        return f"${abs(v):,}", float(abs(v))
    if style == "paren":
        return f"({abs(v)})", -float(abs(v))
    if style == "pct":
        return f"{v}%", float(v)
    if style in ("K", "M", "B"):
        mult = {"K": 1e3, "M": 1e6, "B": 1e9}[style]
        return f"{v}{style}", float(v) * mult
    if style == "ws":
        return f"  {v}\t", float(v)
    return str(v), float(v)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(amounts, styles), min_size=1, max_size=60))
def test_parse_money_round_trip(spark, items):
    rows = [render(v, s) for v, s in items]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    got = [r[0] for r in df.select(P.parse_money("s")).collect()]
    for (text, want), g in zip(rows, got):
        assert g is not None and math.isclose(g, want, rel_tol=1e-12), text


quarters = st.tuples(st.integers(min_value=1990, max_value=2030), st.integers(min_value=1, max_value=4))
forms = st.sampled_from(["{y}Q{q}", "{y}-Q{q}", "{y} Q{q}", "Q{q}-{y}", "Q{q} {y}", "Q{q}{y}"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(quarters, forms), min_size=1, max_size=40))
def test_period_strings_map_to_quarter_end(spark, items):
    rows = [(f.format(y=y, q=q), y, q) for (y, q), f in items]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    got = [r[0] for r in df.select(P.parse_period_date("s")).collect()]
    for (text, y, q), g in zip(rows, got):
        m = q * 3
        assert g == dt.date(y, m, calendar.monthrange(y, m)[1]), text
