"""Column parsers for messy uploads."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.numeric import col_

# Null tokens, suffix multipliers and quarter-end days.
NULL_TOKENS = ("", "nan", "none", "null")
SUFFIX_MULTIPLIERS = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}


def strip_ws(c) -> Column:
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


# An amount without its symbols and separators: bracket, sign, digits, scale letter, bracket.
MONEY_NOISE = r"[,$€£₹%\s]"
MONEY_PATTERN = r"^(\(?)([-+]?)((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)([KMBTkmbt]?)(\)?)$"


def parse_money(c) -> Column:
    """C11: ``$1,234`` / ``(123)`` -> -123 / ``12%`` -> 12 / ``1.2B`` -> 1.2e9 / currency
    symbols ₹€£$ and separators skipped; null tokens and whatever is no amount -> NULL.

    One anchored pattern takes the text apart and the parts are put together as a number,
    so a text that is only partly an amount (one bracket, two signs, a word) is none.
    """
    s = F.regexp_replace(col_(c), MONEY_NOISE, "")
    part = {name: F.regexp_extract(s, MONEY_PATTERN, k) for k, name in enumerate(("open", "sign", "digits", "scale", "close"), 1)}
    digits = part["digits"].try_cast("double")
    scale = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_MULTIPLIERS.items() for x in kv]),
                                    F.nullif(F.upper(part["scale"]), F.lit(""))), F.lit(1.0))
    whole = (part["open"] == "(") == (part["close"] == ")")
    signed = F.when(part["sign"] == "-", -digits).otherwise(digits)
    in_brackets = part["open"] == "("
    # a sign inside brackets is no amount
    value = F.when(in_brackets & (part["sign"] != ""), F.lit(None)).when(in_brackets, -digits).otherwise(signed)
    return F.when(whole, value * scale)


def quarter_end_date(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year.cast("int"), quarter.cast("int") * 3, F.lit(1)))


DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss")


def parse_period_date(c) -> Column:
    """Quarter forms ``2024Q1`` / ``2024-Q1`` / ``2024 Q1`` / ``Q1-2024``
    -> quarter end; ``2024`` -> 2024-12-31; otherwise a date in one of
    DATE_FORMATS.  Period patterns are tried first (period-end intent)."""
    s = strip_ws(c)
    p1 = r"^(\d{4})[-\s]?Q([1-4])$"
    p2 = r"^Q([1-4])[-\s]?(\d{4})$"
    general = F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(f)))
                           for f in DATE_FORMATS])
    return (F.when(s.rlike(p1), quarter_end_date(F.regexp_extract(s, p1, 1),
                                                 F.regexp_extract(s, p1, 2)))
            .when(s.rlike(p2), quarter_end_date(F.regexp_extract(s, p2, 2),
                                                F.regexp_extract(s, p2, 1)))
            .when(s.rlike(r"^\d{4}$"), F.make_date(s.cast("int"), F.lit(12), F.lit(31)))
            .otherwise(general))


def clean_ticker(c) -> Column:
    """upper(trim()); '', NAN, NONE -> NULL."""
    t = F.upper(strip_ws(c))
    return F.when(t.isin("", "NAN", "NONE"), F.lit(None)).otherwise(t)


def safe_float(c, default: float | None = None) -> Column:
    """tolerant float with default."""
    v = strip_ws((F.col(c) if isinstance(c, str) else c).cast("string")).try_cast("double")
    return F.coalesce(v, F.lit(default)) if default is not None else v


TRUE_TOKENS = ("true", "1", "yes", "y", "t")
FALSE_TOKENS = ("false", "0", "no", "n", "f")


def safe_bool(c, default: bool = False) -> Column:
    """tolerant boolean (true/1/yes/y/t and false/0/no/n/f)."""
    s = F.lower(strip_ws(col_(c).cast("string")))
    return (F.when(s.isin(*TRUE_TOKENS), F.lit(True))
            .when(s.isin(*FALSE_TOKENS), F.lit(False)).otherwise(F.lit(default)))


def ascii_safe(c) -> Column:
    """every non-ASCII character -> '?'."""
    return F.regexp_replace(col_(c), r"[^\x00-\x7F]", "?")


def strip_code_fences(c) -> Column:
    """Drop a leading ```json / ``` fence and a trailing ``` fence."""
    s = strip_ws(c)
    s = F.regexp_replace(s, r"^```[A-Za-z]*\s*", "")
    return strip_ws(F.regexp_replace(s, r"\s*```$", ""))


def normalize_header(name: str) -> str:
    """C3 header rule: lower, strip, non-alphanumeric runs -> '_', collapse, trim '_'."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", name.lower().strip())).strip("_")


def normalize_header_basic(name: str) -> str:
    """C1 header rule: lower, strip, spaces -> '_'."""
    return name.lower().strip().replace(" ", "_")


def normalize_header_dash(name: str) -> str:
    """C2 header rule: C1 plus '-' -> '_'."""
    return normalize_header_basic(name).replace("-", "_")
