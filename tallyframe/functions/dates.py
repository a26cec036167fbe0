"""Date text → timestamp_ntz (UTC wall time) as one Column expression.

Every cell is read on its own, by the first form that fits:

* year first: ``2024-01-31``, ``2024/1/31``, ``2024.01.31``, ``20240131``;
* day first: ``31.01.2024``, ``31/01/2024``, ``31-01-24`` (two digits below 70 are
  20xx); when the second number cannot be a month but the first can, the cell is
  month first (``12/31/2024``);
* English month names: ``5 January 2024``, ``Jan 5, 2024``.

Each may carry a time (``H:mm[:ss[.ffffff]]``, after a space or ``T``, also with AM/PM)
and an offset (``Z``, ``+03:00``, ``+0300``), which is applied so the result is UTC.
Unreadable cells are null; ``unreadable`` tells them from blank ones.

The parts come from one regular expression per form, and the parts array is bound in a
lambda, so the generated code of a query stays small however many dates it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from tallyframe.functions import qcol
from tallyframe.functions.money import utrim

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")
_NAME = "((?i:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + r"|sept))\.?"
_TIME = r"(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?:\s?([AaPp])\.?[Mm]\.?)?)?"
_OFFSET = r"\s*(Z|[+-]\d{2}:?\d{2})?$"
_REST = "|$4|$5|$6|$7|$8|$9"
#: (pattern, replacement that lists year, month, day, time parts, AM/PM, offset).
FORMS = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME + _OFFSET, "$1|$2|$3" + _REST),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _TIME + _OFFSET, "$3|$2|$1" + _REST),
    (r"^(\d{4})(\d{2})(\d{2})" + _TIME + _OFFSET, "$1|$2|$3" + _REST),
    (r"^(\d{1,2})[ -]" + _NAME + r",?[ -](\d{4})" + _TIME + _OFFSET, "$3|$2|$1" + _REST),
    ("^" + _NAME + r" (\d{1,2}),? (\d{4})" + _TIME + _OFFSET, "$3|$1|$2" + _REST),
)


def _number(part: Column) -> Column:
    return F.when(part != "", part.try_cast("int"))


def _assembled(p: Column) -> Column:
    """Timestamp of the parts (year, month, day, hour, minute, second, fraction, a/p,
    offset); null for null parts and for days or times that do not exist."""
    year = F.when(F.length(p[0]) == 2, _number(p[0]) + F.when(_number(p[0]) < 70, 2000).otherwise(1900)
                  ).otherwise(_number(p[0]))
    named = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substring(p[1], 1, 3)))
    first, second = F.when(named > 0, named.cast("int")).otherwise(_number(p[1])), _number(p[2])
    # only a day-first cell can have a "month" over 12 and a day up to 12
    turned = (first > 12) & (second <= 12)
    month, day = F.when(turned, second).otherwise(first), F.when(turned, first).otherwise(second)
    hour = F.coalesce(_number(p[3]), F.lit(0))
    hour = F.when(p[7] == "", hour).otherwise(hour % 12 + F.when(F.lower(p[7]) == "p", 12).otherwise(0))
    seconds = F.concat(F.when(p[5] == "", F.lit("0")).otherwise(p[5]), F.lit("."),
                       F.substring(F.rpad(p[6], 6, "0"), 1, 6)).cast("decimal(8,6)")
    at = F.try_make_timestamp_ntz(year, month, day, hour, F.coalesce(_number(p[4]), F.lit(0)), seconds)
    digits = F.regexp_replace(p[8], "[:Z]", "")
    minutes = F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")
    shift = F.when(digits == "", F.lit(0)).when(digits.startswith("-"), -minutes).otherwise(minutes)
    return at - F.make_dt_interval(F.lit(0), F.lit(0), shift)


def _parsed(t: Column) -> Column:
    parts = F.lit(None).cast("array<string>")
    for pattern, parts_in_order in reversed(FORMS):
        found = F.split(F.regexp_replace(t, pattern, parts_in_order), r"\|")
        parts = F.when(t.rlike(pattern), found).otherwise(parts)
    return F.transform(F.array(parts), _assembled)[0]


def parse_date_text(text: Column) -> Column:
    """Date/time text → timestamp_ntz in UTC, or null."""
    return F.transform(F.array(utrim(text)), _parsed)[0]


def unreadable(text: Column, ts: Column) -> Column:
    """A cell with text that ``parse_date_text`` could not read."""
    return ts.isNull() & F.coalesce(utrim(text) != "", F.lit(False))


def with_ledger_ts(df: DataFrame, src: str, out: str) -> DataFrame:
    """Add ``out`` as timestamp_ntz from any supported date column type."""
    dtype = df.schema[src].dataType
    if isinstance(dtype, TimestampNTZType):
        return df.withColumn(out, qcol(src))
    if isinstance(dtype, (TimestampType, DateType)):
        return df.withColumn(out, qcol(src).cast("timestamp_ntz"))
    return df.withColumn(out, parse_date_text(qcol(src).cast("string")))
