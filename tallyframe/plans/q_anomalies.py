"""Anomaly queries."""

from __future__ import annotations

from tallyframe.operators import anomalies, series
from tallyframe.plans import views
from tallyframe.plans.registry import query, r
from tallyframe.plans.sql_views import CASH, SALES, anomaly_ctes

_STAT_COLS = ("q1", "median", "q3", "mean", "std", "high_iqr_bound", "low_iqr_bound",
              "high_z_bound", "low_z_bound")


@query("q_anomaly_stats", f"""WITH {anomaly_ctes(SALES, 'sales', 'day')}
SELECT series, n_values, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(mean, 4) AS mean, round(std, 4) AS std, round(high_iqr, 4) AS high_iqr_bound,
       round(low_iqr, 4) AS low_iqr_bound, round(high_z, 4) AS high_z_bound, round(low_z, 4) AS low_z_bound
FROM sb""")
def q_anomaly_stats(spark, sf):
    """A2-A3: quartiles, mean, population std and bounds per visible series (daily sales)."""
    led = views.sales(spark, sf)
    st = anomalies.series_stats(series.time_series(led, "day"), led)
    return st.select("series", "n_values", *[r(c, 4) for c in _STAT_COLS])


def _flagged(df, *keys):
    return df.select(*keys, "period", "series", "series_label", "kind", r("value"), r("baseline", 4),
                     r("score", 6), "rule", "severity")


_FLAGGED_SQL = """SELECT period, series, series_label, kind, round(value, 2) AS value, round(baseline, 4) AS baseline,
       round(score, 6) AS score, rule, severity FROM ar"""


@query("q_anomalies_day", f"WITH {anomaly_ctes(SALES, 'sales', 'day')}\n{_FLAGGED_SQL}")
def q_anomalies_day(spark, sf):
    """Every daily anomaly of the sales ledger."""
    led = views.sales(spark, sf)
    return _flagged(anomalies.all_anomalies(series.time_series(led, "day"), led))


@query("q_anomalies_week", f"WITH {anomaly_ctes(SALES, 'sales', 'week')}\n{_FLAGGED_SQL}")
def q_anomalies_week(spark, sf):
    """Every weekly (Monday) anomaly of the sales ledger."""
    led = views.sales(spark, sf)
    return _flagged(anomalies.all_anomalies(series.time_series(led, "week", "monday"), led))


@query("q_anomalies_hour_amount", f"WITH {anomaly_ctes(CASH, 'cash', 'hour', amount_only=True)}\n{_FLAGGED_SQL}")
def q_anomalies_hour_amount(spark, sf):
    """A1-A7 on a signed amount: hourly event cash flow, drops and spikes."""
    led = views.cash(spark, sf)
    return _flagged(anomalies.all_anomalies(series.time_series(led, "hour"), led))


@query("q_anomaly_top8", f"""WITH {anomaly_ctes(SALES, 'sales', 'day')}
SELECT rank, total_found, period, series, kind, round(value, 2) AS value, round(score, 6) AS score, severity
FROM ar WHERE rank <= 8""")
def q_anomaly_top8(spark, sf):
    """The 8 strongest daily anomalies and the total found."""
    led = views.sales(spark, sf)
    top = anomalies.detect_anomalies(series.time_series(led, "day"), led, 8)
    return top.select("rank", "total_found", "period", "series", "kind", r("value"), r("score", 6), "severity")


@query("q_anomalies_keyed", f"""WITH {anomaly_ctes(SALES, 'sales', 'week', keys='k')}
SELECT k AS l_linestatus, rank, total_found, period, series, kind, round(value, 2) AS value,
       round(score, 6) AS score, rule, severity
FROM ar WHERE rank <= 8""")
def q_anomalies_keyed(spark, sf):
    """A8 per key: top 8 weekly anomalies per line status, with totals."""
    led = views.sales(spark, sf, keyed=True)
    top = anomalies.detect_anomalies(series.time_series(led, "week"), led, 8)
    return top.select("l_linestatus", "rank", "total_found", "period", "series", "kind", r("value"),
                      r("score", 6), "rule", "severity")


@query("q_anomaly_status", f"""WITH {anomaly_ctes(CASH, 'cash', 'week', amount_only=True)}
SELECT (SELECT count(*) FROM p)::BIGINT AS n_points, (SELECT count(*) FROM a)::BIGINT AS total_found,
       CASE WHEN (SELECT count(*) FROM p) < 4 THEN 'Need at least 4 periods to detect anomalies.'
            WHEN (SELECT count(*) FROM a) = 0 THEN 'No unusual periods found with the current grouping.'
            ELSE '' END AS message""")
def q_anomaly_status(spark, sf):
    """A1 guards: weekly cash points (5 periods) and their message."""
    led = views.cash(spark, sf)
    points = series.time_series(led, "week").checkpoint()  # a row per period, read three times
    st = anomalies.anomaly_status(points, led)
    return st.select("n_points", "total_found", "message")
