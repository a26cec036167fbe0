"""Short-horizon forecasts (F1-F9): moving average vs least-squares trend.

Per key and visible series, over the ordinal index of the *observed* periods
(gaps are not filled): fit a line, measure both methods' mean absolute error
from index 3 on, keep the line only when it beats the moving average by a
clear margin, and project ``horizon`` periods past the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators._keys import attach
from tallyframe.operators.series import long_visible, normalize_grain, visible_series
from tallyframe.roles import Ledger

# Fixed values that must equal the reference.
MIN_POINTS_FOR_FORECAST = 6
DEFAULT_PERIODS_AHEAD = 3
MOVING_AVERAGE_WINDOW = 3
TREND_ADVANTAGE = 0.85
METHOD_MOVING_AVERAGE = "moving_average"
METHOD_LINEAR_TREND = "linear_trend"
MSG_NOTHING = "Nothing to forecast."
MSG_FEW_POINTS = "Need at least 6 periods to forecast."
MSG_NO_SERIES = "No series available to forecast."
MSG_NONE_FORECAST = "No series could be forecast."


def _finite(c):
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def indexed_points(points: DataFrame, ledger: Ledger) -> DataFrame:
    """Visible long points with ``idx`` (0-based ordinal over observed periods),
    ``n``, the mean of the preceding 3 values, and the least-squares line of the
    whole series (``slope``, ``intercept``) — all windows over ``keys, series``,
    which the key shuffle of the points already clusters: one sort, no join."""
    keys = list(ledger.keys)
    long = long_visible(points, ledger)
    part = Window.partitionBy(*keys, "series")
    w = part.orderBy("period")
    ix = (long.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))
          .withColumn("ma_prev", F.avg("value").over(w.rowsBetween(-MOVING_AVERAGE_WINDOW, -1))))
    return (ix.withColumn("n", F.count(F.lit(1)).over(part))
            .withColumn("slope", F.regr_slope("value", "idx").over(part))
            .withColumn("intercept", F.regr_intercept("value", "idx").over(part))
            .withColumn("non_finite", F.count_if(~_finite(F.col("value"))).over(part)))


def forecast_fit(points: DataFrame, ledger: Ledger) -> DataFrame:
    """Per key and series: n, slope, intercept, moving-average level, both MAEs
    and the chosen method. Only eligible series (≥6 points, all finite)."""
    keys = list(ledger.keys)
    ix = indexed_points(points, ledger).where((F.col("n_points") >= MIN_POINTS_FOR_FORECAST)
                                              & (F.col("non_finite") == 0))
    start = F.least(F.lit(MOVING_AVERAGE_WINDOW), F.col("n"))
    trend = F.col("slope") * F.col("idx") + F.col("intercept")
    fit = ix.groupBy(*keys, "series", "series_order").agg(
        F.max("n").alias("n"),
        F.first("slope").alias("slope"),
        F.first("intercept").alias("intercept"),
        F.max("period").alias("last_period"),
        F.avg(F.when(F.col("idx") >= F.col("n") - MOVING_AVERAGE_WINDOW, F.col("value"))).alias("ma_level"),
        F.avg(F.when(F.col("idx") >= start, F.abs(F.col("value") - F.col("ma_prev")))).alias("ma_mae"),
        F.avg(F.when(F.col("idx") >= start, F.abs(F.col("value") - trend))).alias("trend_mae"),
    )
    trend_ok = F.col("slope").isNotNull() & F.col("trend_mae").isNotNull() & _finite(F.col("trend_mae"))
    ma_ok = F.col("ma_level").isNotNull() & F.col("ma_mae").isNotNull() & _finite(F.col("ma_mae"))
    method = (F.when(trend_ok & ~ma_ok, F.lit(METHOD_LINEAR_TREND))
              .when(trend_ok & ma_ok & (F.col("trend_mae") < F.col("ma_mae") * TREND_ADVANTAGE),
                    F.lit(METHOD_LINEAR_TREND))
              .otherwise(F.lit(METHOD_MOVING_AVERAGE)))
    return fit.withColumn("method", method)


def step_period(period, k, grain: str):
    """``period`` advanced by ``k`` grains. Months and years step one at a time,
    so a day clamped at a short month stays clamped (Jan 31 → Feb 29 → Mar 29)."""
    grain = normalize_grain(grain)
    if grain in ("month", "year"):
        one = F.make_interval(F.lit(0), F.lit(1)) if grain == "month" else F.make_interval(F.lit(1))
        return F.aggregate(F.sequence(F.lit(1), k), period, lambda acc, _: acc + one)
    if grain == "week":
        return period + F.make_dt_interval(k * 7)
    if grain == "day":
        return period + F.make_dt_interval(k)
    return period + F.make_dt_interval(F.lit(0), k)


def forecast(points: DataFrame, ledger: Ledger, grain: str = "day",
             horizon: int = DEFAULT_PERIODS_AHEAD) -> DataFrame:
    """Projected values ``keys…, series, step, period, value, method``.

    ``step`` is 0-based; ``period`` is the last observed one plus step+1 grains.
    """
    keys = list(ledger.keys)
    fit = forecast_fit(points, ledger)
    if horizon < 1:
        fit = fit.where(F.lit(False))
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                           F.lit(max(horizon, 1) - 1).cast("bigint"))))
    value = F.when(F.col("method") == METHOD_LINEAR_TREND,
                   F.col("slope") * (F.col("n") + F.col("step")) + F.col("intercept")) \
        .otherwise(F.col("ma_level"))
    return steps.select(*keys, "series", "series_order", "step",
                        step_period(F.col("last_period"), (F.col("step") + 1).cast("int"), grain).alias("period"),
                        value.alias("value"), "method")


def forecast_status(points: DataFrame, ledger: Ledger, horizon: int = DEFAULT_PERIODS_AHEAD) -> DataFrame:
    """Per key: point count, forecast series count and status message."""
    keys = list(ledger.keys)
    base = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    vis = visible_series(points, ledger).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_visible"))
    fc = forecast_fit(points, ledger).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_forecast"))
    base = attach(attach(base, vis, keys), fc, keys)
    n_vis = F.coalesce("n_visible", F.lit(0)).cast("bigint")
    n_fc = F.coalesce("n_forecast", F.lit(0)).cast("bigint")
    if horizon < 1:
        msg = F.lit(MSG_NOTHING)
    else:
        msg = (F.when(F.col("n_points") < MIN_POINTS_FOR_FORECAST, F.lit(MSG_FEW_POINTS))
               .when(n_vis == 0, F.lit(MSG_NO_SERIES))
               .when(n_fc == 0, F.lit(MSG_NONE_FORECAST)).otherwise(F.lit("")))
    return base.select(*keys, "n_points", n_vis.alias("n_visible"), n_fc.alias("n_forecast"),
                       msg.alias("message"))
