"""Cleaning and preparation: raw ledger columns → a prepared ``Ledger``.

One pass of aggregation (only when a text money column or several date
columns need it) decides, per key and per column, how to read the data; the
decision is attached back and the rest is one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallyframe.functions import qcol
from tallyframe.functions.dates import with_ledger_ts
from tallyframe.functions.money import is_dirty_cell, numeric_money, with_clean_money_column
from tallyframe.functions.text import combine_categories
from tallyframe.operators._keys import attach
from tallyframe.roles import Ledger, Roles
from tallyframe.session import staged_table

LEDGER_COLUMNS = ("ts", "revenue", "expenses", "amount", "category")


def _is_text(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, NumericType)


def clean_money(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Clean money columns in place (per key column-wide switch), → double."""
    prepared = _with_decisions(df, list(columns), [], keys)
    prepared, exprs = _money_columns(prepared, list(columns))
    return prepared.select(*[exprs[c].alias(c) if c in exprs else qcol(c) for c in df.columns])


def _safe(name: str) -> str:
    """A parse-safe internal column suffix for a user column name."""
    import hashlib
    import re
    return re.sub(r"\W", "_", name) + "_" + hashlib.md5(name.encode()).hexdigest()[:6]


def _flag(name: str) -> str:
    return f"__dirty_{_safe(name)}"


def _dates_flag(i: int) -> str:
    return f"__dates_{i}"


def _with_decisions(df: DataFrame, money_cols: list[str], date_cols: list[str],
                    keys: Sequence[str], staged: bool = False) -> DataFrame:
    """Add per-key decision columns: dirty flag per text money column and, when
    several date columns are selected, the valid-date count of each."""
    aggs: list[Column] = []
    for c in money_cols:
        if _is_text(df, c):
            aggs.append(F.coalesce(F.bool_or(is_dirty_cell(qcol(c).cast("string"))),
                                   F.lit(False)).alias(_flag(c)))
    if len(date_cols) > 1:
        for i, _ in enumerate(date_cols):
            aggs.append(F.count(F.col(_date_col(i))).alias(_dates_flag(i)))
    if not aggs:
        return df
    decisions = df.groupBy(*keys).agg(*aggs)
    if keys and staged:
        decisions = staged_table(decisions, "decisions")
    return attach(df, decisions, keys)


def _money_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Cleaned money per column: numeric columns directly, text columns through
    staged projections (``__money_<name>``)."""
    exprs: dict[str, Column] = {}
    for name in names:
        if not _is_text(df, name):
            exprs[name] = numeric_money(qcol(name))
        else:
            out = f"__money_{_safe(name)}"
            df = with_clean_money_column(df, name, out, F.col(_flag(name)))
            exprs[name] = F.col(out)
    return df, exprs


def _date_col(i: int) -> str:
    return f"__date_{i}"


def _with_dates(df: DataFrame, date_cols: list[str]) -> DataFrame:
    """Parsed timestamp per selected date column (staged projections)."""
    for i, c in enumerate(date_cols):
        df = with_ledger_ts(df, c, _date_col(i))
    return df


def _date_expr(df: DataFrame, date_cols: list[str]) -> Column | None:
    if not date_cols:
        return None
    parsed = [F.col(_date_col(i)) for i in range(len(date_cols))]
    if len(parsed) == 1:
        return parsed[0]
    # first selected column having at least one valid date (per key)
    chosen = None
    for i in reversed(range(len(parsed))):
        cond = F.col(_dates_flag(i)) > 0
        chosen = F.when(cond, parsed[i]) if chosen is None else F.when(cond, parsed[i]).otherwise(chosen)
    return chosen


def prepare(df: DataFrame, roles: Roles, keys: Sequence[str] = (), *,
            persist: bool = False, staged: bool = False) -> Ledger:
    """Build the prepared ledger ``keys…, ts, revenue, expenses, amount, category``.

    * revenue / expense columns: cleaned, summed row-wise;
    * amount columns: cleaned; their sum is ``amount``, positive parts add to
      revenue and the absolute negative parts to expenses;
    * date: the first selected column with a valid date; category: the selected
      columns cleaned and joined with ' / '.
    An unselected side stays a null column.

    ``staged`` writes the decisions, a row per key, at once. Unwritten, their estimated
    size is that of all rows; a join planned by that deals the rows by their key, so that
    one task reads all rows of a large key.
    """
    keys = tuple(keys)
    r = roles.require(df.columns)
    money_cols = list(dict.fromkeys(r.revenue + r.expense + r.amount))
    base = _with_dates(df.select(*[qcol(c) for c in dict.fromkeys(list(keys) + list(r.selected()))]), list(r.date))
    decided = _with_decisions(base, money_cols, list(r.date), keys, staged)
    decided, money = _money_columns(decided, money_cols)

    def total(parts: list[Column]) -> Column | None:
        return reduce(add, parts) if parts else None

    revenue = total([money[c] for c in r.revenue])
    expenses = total([money[c] for c in r.expense])
    amount = total([money[c] for c in r.amount])
    if r.amount:
        pos = total([F.greatest(money[c], F.lit(0.0)) for c in r.amount])
        neg = total([F.abs(F.least(money[c], F.lit(0.0))) for c in r.amount])
        revenue = pos if revenue is None else revenue + pos
        expenses = neg if expenses is None else expenses + neg
    ts = _date_expr(decided, list(r.date))
    category = combine_categories([qcol(c) for c in r.category]) if r.category else None

    def col_or_null(e: Column | None, dtype: str) -> Column:
        return e if e is not None else F.lit(None).cast(dtype)

    out = decided.select(
        *[qcol(k) for k in keys],
        col_or_null(ts, "timestamp_ntz").alias("ts"),
        col_or_null(revenue, "double").alias("revenue"),
        col_or_null(expenses, "double").alias("expenses"),
        col_or_null(amount, "double").alias("amount"),
        col_or_null(category, "string").alias("category"),
    )
    if persist:
        out = out.persist()
    return Ledger(out, keys, len(r.revenue), len(r.expense), len(r.amount), len(r.category),
                  len(r.date))


def from_prepared(df: DataFrame, keys: Sequence[str] = (), *, revenue: bool = False,
                  expenses: bool = False, amount: bool = False, category: bool = False,
                  dates: bool = True) -> Ledger:
    """Wrap a DataFrame that already has the prepared columns."""
    return Ledger(df, tuple(keys), int(revenue), int(expenses), int(amount), int(category),
                  int(dates))
