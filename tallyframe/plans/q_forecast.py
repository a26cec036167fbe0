"""Forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import forecast, series
from tallyframe.plans import views
from tallyframe.plans.registry import query, r
from tallyframe.plans.sql_views import CASH, ORDERS, SALES, forecast_ctes

_ORD_M = forecast_ctes(ORDERS, "ords", "month")
_SALES_W = forecast_ctes(SALES, "sales", "week")


def _fit(spark, sf, which):
    if which == "orders":
        led = views.orders(spark, sf)
        return forecast.forecast_fit(series.time_series(led, "month"), led)
    led = views.sales(spark, sf)
    return forecast.forecast_fit(series.time_series(led, "week"), led)


@query("q_linear_trend", f"""WITH {_ORD_M}
SELECT series, n::BIGINT AS n, round(slope, 4) AS slope, round(intercept, 4) AS intercept FROM fit""")
def q_linear_trend(spark, sf):
    """Least-squares line over the ordinal index of monthly orders."""
    return _fit(spark, sf, "orders").select("series", F.col("n").cast("bigint").alias("n"),
                                            r("slope", 4), r("intercept", 4))


@query("q_moving_average", f"""WITH {_ORD_M}
SELECT series, round(ma_level, 4) AS ma_level, CAST(last_period AS TIMESTAMP) AS last_period FROM fit""")
def q_moving_average(spark, sf):
    """moving-average level of the last three months (orders)."""
    return _fit(spark, sf, "orders").select("series", r("ma_level", 4), "last_period")


@query("q_forecast_errors", f"""WITH {_SALES_W}
SELECT series, round(trend_mae, 4) AS trend_mae, round(ma_mae, 4) AS ma_mae FROM fit""")
def q_forecast_errors(spark, sf):
    """Trend and moving-average errors from index 3 on (weekly sales)."""
    return _fit(spark, sf, "sales").select("series", r("trend_mae", 4), r("ma_mae", 4))


@query("q_forecast_method", f"""WITH {_ORD_M} SELECT 'orders' AS ledger, series, method FROM fit
UNION ALL (WITH {_SALES_W} SELECT 'sales' AS ledger, series, method FROM fit)""")
def q_forecast_method(spark, sf):
    """the chosen method per series for two ledgers."""
    a = _fit(spark, sf, "orders").select(F.lit("orders").alias("ledger"), "series", "method")
    b = _fit(spark, sf, "sales").select(F.lit("sales").alias("ledger"), "series", "method")
    return a.unionByName(b)


@query("q_forecast", f"""WITH {_ORD_M} SELECT 'orders' AS ledger, series, step, period, round(value, 4) AS value, method FROM fc
UNION ALL (WITH {_SALES_W} SELECT 'sales' AS ledger, series, step, period, round(value, 4) AS value, method FROM fc)""")
def q_forecast(spark, sf):
    """Three projected periods per series for monthly orders and weekly sales."""
    out = []
    for name, led, grain in (("orders", views.orders(spark, sf), "month"),
                             ("sales", views.sales(spark, sf), "week")):
        fc = forecast.forecast(series.time_series(led, grain), led, grain, 3)
        out.append(fc.select(F.lit(name).alias("ledger"), "series", "step", "period", r("value", 4), "method"))
    return out[0].unionByName(out[1])


def _elig_sql(cte, src, grain, name, amount_only=False):
    body = forecast_ctes(cte, src, grain, amount_only=amount_only)
    return f"""(WITH {body}
SELECT '{name}' AS ledger, (SELECT count(*) FROM p)::BIGINT AS n_points,
       (SELECT count(*) FROM v)::BIGINT AS n_visible, (SELECT count(*) FROM fit)::BIGINT AS n_forecast,
       CASE WHEN (SELECT count(*) FROM p) < 6 THEN 'Need at least 6 periods to forecast.'
            WHEN (SELECT count(*) FROM v) = 0 THEN 'No series available to forecast.'
            WHEN (SELECT count(*) FROM fit) = 0 THEN 'No series could be forecast.' ELSE '' END AS message)"""


@query("q_forecast_eligibility", _elig_sql(ORDERS, "ords", "year", "orders_year") + "\nUNION ALL\n"
       + _elig_sql(CASH, "cash", "week", "cash_week", amount_only=True) + "\nUNION ALL\n"
       + _elig_sql(SALES, "sales", "month", "sales_month"))
def q_forecast_eligibility(spark, sf):
    """F1 guards over three ledgers/grains (cash by week has only 5 periods)."""
    out = None
    for name, led, grain in (("orders_year", views.orders(spark, sf), "year"),
                             ("cash_week", views.cash(spark, sf), "week"),
                             ("sales_month", views.sales(spark, sf), "month")):
        points = series.time_series(led, grain).checkpoint()  # a row per period, read three times
        st = forecast.forecast_status(points, led).select(
            F.lit(name).alias("ledger"), "n_points", "n_visible", "n_forecast", "message")
        out = st if out is None else out.unionByName(st)
    return out


@query("q_forecast_pivot", f"""WITH {_ORD_M}
SELECT CASE series WHEN 'revenue' THEN 'Revenue' WHEN 'expenses' THEN 'Expenses' WHEN 'profit' THEN 'Profit' ELSE 'Amount' END AS indicator,
       max(CASE WHEN step = 0 THEN replace(format('{{:,.2f}}', round(value, 2)), ',', ' ') END) AS step_1,
       max(CASE WHEN step = 1 THEN replace(format('{{:,.2f}}', round(value, 2)), ',', ' ') END) AS step_2,
       max(CASE WHEN step = 2 THEN replace(format('{{:,.2f}}', round(value, 2)), ',', ' ') END) AS step_3,
       max(strftime(period, '%d.%m.%Y')) FILTER (WHERE step = 0) AS first_period,
       CASE max(method) WHEN 'linear_trend' THEN 'linear trend' ELSE 'moving average' END AS method
FROM fc GROUP BY series""")
def q_forecast_pivot(spark, sf):
    """One row per series, one column per future period."""
    from tallyframe.operators.report import forecast_table
    led = views.orders(spark, sf)
    fc = forecast.forecast(series.time_series(led, "month"), led, "month", 3)
    return forecast_table(fc, led.keys, 3, "en").drop("series_order")
