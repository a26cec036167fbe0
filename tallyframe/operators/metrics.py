"""Totals, averages, date range and category breakdown (M1-M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators._keys import top_k
from tallyframe.roles import Ledger

# Fixed values that must equal the reference: category list sizes.
UI_CATEGORY_LIMIT = 5
ANALYSIS_CATEGORY_LIMIT = 25


def basic_metrics(ledger: Ledger) -> DataFrame:
    """One row per key: counts, totals, per-transaction and daily averages.

    ``transaction_count`` counts every row (dateless rows included); a side
    that was not selected is null, and profit needs both sides.
    """
    return basic_from_totals(ledger_totals(ledger), ledger)


def ledger_totals(ledger: Ledger) -> DataFrame:
    """The sums that every per-key figure comes from, one row per key."""
    return ledger.df.groupBy(*ledger.keys).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("expenses").alias("total_expenses"),
        F.min("ts").alias("date_min"),
        F.max("ts").alias("date_max"),
        F.count("ts").alias("dated_rows"),
    )


def basic_from_totals(agg: DataFrame, ledger: Ledger) -> DataFrame:
    """Derived metrics from per-key count, sums and date range."""
    keys = list(ledger.keys)
    rev = F.col("total_revenue") if ledger.has_revenue else F.lit(None).cast("double")
    exp = F.col("total_expenses") if ledger.has_expenses else F.lit(None).cast("double")
    profit = rev - exp
    n = F.col("transaction_count")
    days = F.greatest(F.datediff(F.to_date("date_max"), F.to_date("date_min")) + 1, F.lit(1))
    days = F.when(F.col("date_min").isNotNull(), days).cast("bigint")
    return agg.select(
        *keys, n,
        rev.alias("total_revenue"), exp.alias("total_expenses"), profit.alias("total_profit"),
        F.try_divide(rev, n).alias("average_revenue"),
        F.try_divide(exp, n).alias("average_expense"),
        F.lit(ledger.revenue_columns).cast("bigint").alias("revenue_column_count"),
        F.lit(ledger.expense_columns).cast("bigint").alias("expense_column_count"),
        F.lit(ledger.amount_columns).cast("bigint").alias("amount_column_count"),
        F.lit(ledger.category_columns).cast("bigint").alias("category_column_count"),
        "date_min", "date_max", days.alias("period_days"),
        F.try_divide(rev, days).alias("average_daily_revenue"),
        F.try_divide(exp, days).alias("average_daily_expense"),
        F.try_divide(profit, days).alias("average_daily_profit"),
    )


def category_breakdown(ledger: Ledger) -> DataFrame:
    """Per key and category: count and revenue/expenses/profit sums.

    A missing side counts as 0; with no category or no money side at all the
    result is empty.
    """
    df, keys = ledger.df, list(ledger.keys)
    out = df.groupBy(*keys, "category").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum(F.coalesce("revenue", F.lit(0.0))).alias("revenue"),
        F.sum(F.coalesce("expenses", F.lit(0.0))).alias("expenses"),
        F.sum(F.coalesce("revenue", F.lit(0.0)) - F.coalesce("expenses", F.lit(0.0))).alias("profit"),
    )
    if not ledger.has_category or not (ledger.has_revenue or ledger.has_expenses):
        out = out.where(F.lit(False))
    return out


def top_categories(ledger: Ledger, limit: int | None = ANALYSIS_CATEGORY_LIMIT) -> DataFrame:
    """Categories ranked by |profit| descending (ties: category name)."""
    return ranked_categories(category_breakdown(ledger), ledger, limit)


def ranked_categories(cats: DataFrame, ledger: Ledger, limit: int | None = ANALYSIS_CATEGORY_LIMIT) -> DataFrame:
    order = [F.abs("profit").desc(), F.col("category").asc()]
    return top_k(cats, ledger.keys, order, limit)


# grouping_id of each level for grouping columns (keys…, category, period)
_LEVEL_TOTAL, _LEVEL_CATEGORY, _LEVEL_PERIOD = 3, 1, 2


def ledger_rollup(ledger: Ledger, grain: str = "day", week_start: str = "monday") -> DataFrame:
    """Totals per key, per key and category, and per key and period from ONE
    scan and ONE shuffle (grouping sets; partial aggregation before the
    exchange). ``level`` is ``total`` / ``category`` / ``period``."""
    from tallyframe.operators.series import period_start
    keys = list(ledger.keys)
    df = ledger.df.withColumn("period", period_start(F.col("ts"), grain, week_start))
    rev0, exp0 = F.coalesce("revenue", F.lit(0.0)), F.coalesce("expenses", F.lit(0.0))
    sets = [keys, keys + ["category"], keys + ["period"]]
    agg = df.groupingSets([[F.col(c) for c in s] for s in sets], *keys, "category", "period").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("revenue").alias("total_revenue"), F.sum("expenses").alias("total_expenses"),
        F.min("ts").alias("date_min"), F.max("ts").alias("date_max"),
        F.sum(rev0).alias("revenue"), F.sum(exp0).alias("expenses"), F.sum(rev0 - exp0).alias("profit"),
        F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount"),
        F.grouping_id().alias("gid"))
    level = (F.when(F.col("gid") == _LEVEL_TOTAL, F.lit("total"))
             .when(F.col("gid") == _LEVEL_CATEGORY, F.lit("category")).otherwise(F.lit("period")))
    return agg.withColumn("level", level).drop("gid")


def basic_from_rollup(rollup: DataFrame, ledger: Ledger) -> DataFrame:
    return basic_from_totals(rollup.where(F.col("level") == "total"), ledger)


def categories_from_rollup(rollup: DataFrame, ledger: Ledger) -> DataFrame:
    out = rollup.where(F.col("level") == "category").select(
        *ledger.keys, "category", "transaction_count", "revenue", "expenses", "profit")
    if not ledger.has_category or not (ledger.has_revenue or ledger.has_expenses):
        out = out.where(F.lit(False))
    return out


def points_from_rollup(rollup: DataFrame, ledger: Ledger) -> DataFrame:
    out = rollup.where((F.col("level") == "period") & F.col("period").isNotNull()).select(
        *ledger.keys, "period", "revenue", "expenses", "profit", "amount")
    return out if ledger.has_dates else out.where(F.lit(False))
