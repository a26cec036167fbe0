"""Display text for numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AVAILABLE = "not available"


def _as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def format_money(x, missing: str | Column = NOT_AVAILABLE) -> Column:
    """``1 234.56``: two decimals, thousands separated by a space; null → placeholder."""
    c = _as_col(x).cast("double")
    text = F.regexp_replace(F.format_number(c, 2), ",", " ")
    miss = missing if isinstance(missing, Column) else F.lit(missing)
    return F.when(c.isNull(), miss).otherwise(text)


def format_count(x) -> Column:
    """Integer with space-separated thousands."""
    c = _as_col(x)
    return F.when(c.isNull(), F.lit(NOT_AVAILABLE)).otherwise(
        F.regexp_replace(F.format_number(c.cast("bigint"), 0), ",", " "))


def _trim_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def _fixed(x: Column, places: int) -> Column:
    """Fixed-point text rounded like Python's format (exact binary value,
    half-even): ``format_number`` without its grouping commas."""
    return F.regexp_replace(F.format_number(x, places), ",", "")


def compact_number(x) -> Column:
    """Axis text: ``1.2k``, ``3.4m``, ``5b``; ≥100 without decimals; else ≤2 decimals."""
    v = _as_col(x).cast("double")
    a = F.abs(v)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))

    def scaled(div: float, suffix: str) -> Column:
        return F.concat(sign, _trim_zeros(_fixed(a / div, 1)), F.lit(suffix))

    return (F.when(v.isNull(), F.lit(None).cast("string")).when(v == 0, F.lit("0"))
            .when(a >= 1e9, scaled(1e9, "b")).when(a >= 1e6, scaled(1e6, "m"))
            .when(a >= 1e3, scaled(1e3, "k"))
            .when(a >= 100, _fixed(v, 0))
            .otherwise(_trim_zeros(_fixed(v, 2))))


def format_percent(x) -> Column:
    """One decimal, without a pointless ``.0`` (rounded like Python's ``round``)."""
    text = _fixed(_as_col(x).cast("double"), 1)
    return F.regexp_replace(text, r"\.0$", "")


def format_date(x, pattern: str = "dd.MM.yyyy") -> Column:
    return F.date_format(_as_col(x), pattern)
