"""Period series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.format import compact_number, format_money
from tallyframe.operators import series
from tallyframe.plans import views
from tallyframe.plans.registry import query, r
from tallyframe.plans.sql_views import CASH, ORDERS, SALES, points, visible


def _pts(df, *keys):
    return df.select(*keys, "period", r("revenue"), r("expenses"), r("profit"), r("amount"))


def _pts_sql(src_cte, src, grain, keys="", week_start=0, key_alias=None):
    k = f"{keys} AS {key_alias}, " if keys else ""
    return (f"WITH {src_cte}, p AS ({points(src, grain, keys, week_start)})\n"
            f"SELECT {k}period, round(revenue, 2) AS revenue, round(expenses, 2) AS expenses, "
            f"round(profit, 2) AS profit, round(amount, 2) AS amount FROM p")


@query("q_series_hour", _pts_sql(CASH, "cash", "hour"))
def q_series_hour(spark, sf):
    """Hourly points of the event cash flow."""
    return _pts(series.time_series(views.cash(spark, sf), "hour"))


@query("q_series_day", _pts_sql(SALES, "sales", "day"))
def q_series_day(spark, sf):
    """Daily points of the sales ledger."""
    return _pts(series.time_series(views.sales(spark, sf), "day"))


@query("q_series_month", _pts_sql(SALES, "sales", "month", "k", key_alias="l_linestatus"))
def q_series_month(spark, sf):
    """T3/T5 per key: monthly points per line status."""
    return _pts(series.time_series(views.sales(spark, sf, keyed=True), "month"), "l_linestatus")


@query("q_series_year", _pts_sql(ORDERS, "ords", "year"))
def q_series_year(spark, sf):
    """Yearly points of the orders ledger."""
    return _pts(series.time_series(views.orders(spark, sf), "year"))


@query("q_series_week_mon", _pts_sql(SALES, "sales", "week", week_start=0))
def q_series_week_mon(spark, sf):
    """T4: weekly points, weeks starting on Monday."""
    return _pts(series.time_series(views.sales(spark, sf), "week", "monday"))


@query("q_series_week_sun", _pts_sql(SALES, "sales", "week", week_start=6))
def q_series_week_sun(spark, sf):
    """T4: weekly points, weeks starting on Sunday."""
    return _pts(series.time_series(views.sales(spark, sf), "week", "sunday"))


@query("q_visible_series", f"""WITH {SALES}, {CASH}, {ORDERS},
ps AS ({points('sales', 'day')}), pc AS ({points('cash', 'day')}), po AS ({points('ords', 'month')})
SELECT 'sales' AS ledger, series, series_order FROM ({visible('ps')})
UNION ALL SELECT 'cash', series, series_order FROM ({visible('pc', amount_only=True)})
UNION ALL SELECT 'orders', series, series_order FROM ({visible('po')})""")
def q_visible_series(spark, sf):
    """T6 over three ledgers: two-sided, amount-only and revenue-only."""
    out = None
    for name, led, grain in (("sales", views.sales(spark, sf), "day"),
                             ("cash", views.cash(spark, sf), "day"),
                             ("orders", views.orders(spark, sf), "month")):
        v = series.visible_series(series.time_series(led, grain), led)
        v = v.select(F.lit(name).alias("ledger"), "series", "series_order")
        out = v if out is None else out.unionByName(v)
    return out


@query("q_period_labels", f"""WITH {SALES}, {CASH}, pm AS ({points('sales', 'month')}), ph AS ({points('cash', 'hour')}),
py AS ({points('sales', 'year')})
SELECT 'month' AS grain, strftime(period, '%Y-%m') AS label, period FROM pm
UNION ALL SELECT 'hour', strftime(period, '%Y-%m-%d %H:%M'), period FROM ph
UNION ALL SELECT 'year', strftime(period, '%Y'), period FROM py""")
def q_period_labels(spark, sf):
    """Period label per grain."""
    out = None
    for grain, led in (("month", views.sales(spark, sf)), ("hour", views.cash(spark, sf)),
                       ("year", views.sales(spark, sf))):
        p = series.time_series(led, grain)
        p = p.select(F.lit(grain).alias("grain"), series.period_label(F.col("period"), grain).alias("label"),
                     "period")
        out = p if out is None else out.unionByName(p)
    return out


def _compact_sql(x: str) -> str:
    """Compact number text in DuckDB (same rule as ``compact_number``)."""
    def trim(v):
        return f"regexp_replace(regexp_replace(printf('%.1f', {v}), '0+$', ''), '\\.$', '')"
    def trim2(v):
        return f"regexp_replace(regexp_replace(printf('%.2f', {v}), '0+$', ''), '\\.$', '')"
    return (f"CASE WHEN abs({x}) >= 1e9 THEN {trim(f'{x} / 1e9')} || 'b' "
            f"WHEN abs({x}) >= 1e6 THEN {trim(f'{x} / 1e6')} || 'm' "
            f"WHEN abs({x}) >= 1e3 THEN {trim(f'{x} / 1e3')} || 'k' "
            f"WHEN abs({x}) >= 100 THEN printf('%.0f', {x}) ELSE {trim2(x)} END")


@query("q_format", f"""WITH {SALES}, pm AS ({points('sales', 'month')})
SELECT period, replace(format('{{:,.2f}}', round(revenue, 2)), ',', ' ') AS revenue_text,
       replace(format('{{:,.2f}}', round(profit, 2)), ',', ' ') AS profit_text,
       {_compact_sql('round(revenue, 2)')} AS revenue_compact,
       {_compact_sql('round(expenses, 2) / 997.0')} AS small_compact
FROM pm""")
def q_format(spark, sf):
    """Money text and compact axis numbers over monthly points (expenses
    per 997 units puts values in the <1k branches of the compact format)."""
    p = series.time_series(views.sales(spark, sf), "month")
    return p.select("period", format_money(F.round("revenue", 2)).alias("revenue_text"),
                    format_money(F.round("profit", 2)).alias("profit_text"),
                    compact_number(F.round("revenue", 2)).alias("revenue_compact"),
                    compact_number(F.round("expenses", 2) / 997.0).alias("small_compact"))


@query("q_series_status", f"""WITH {SALES}
SELECT 'sales' AS ledger, count(ts)::BIGINT AS dated_rows, '' AS message, count(*)::BIGINT AS transaction_count,
       round(sum(revenue) - sum(expenses), 2) AS total_profit,
       greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1)::BIGINT AS period_days FROM sales
UNION ALL
SELECT 'balance', 0::BIGINT, 'Select a date column to build a chart.', count(*)::BIGINT,
       round(sum(greatest(c_acctbal, 0.0)) - sum(abs(least(c_acctbal, 0.0))), 2), CAST(NULL AS BIGINT) FROM customer""")
def q_series_status(spark, sf):
    """T7 + the dateless path: status per ledger, and totals without a date range."""
    from tallyframe.operators import metrics
    out = None
    for name, led in (("sales", views.sales(spark, sf)), ("balance", views.balance(spark, sf))):
        totals = metrics.ledger_totals(led).checkpoint()  # one row per key, from one scan
        m, s = metrics.basic_from_totals(totals, led), series.status_from_totals(totals, led)
        row = s.select(F.lit(name).alias("ledger"), "dated_rows", "message").join(
            m.select(F.lit(name).alias("ledger"), "transaction_count", r("total_profit"), "period_days"), "ledger")
        out = row if out is None else out.unionByName(row)
    return out
