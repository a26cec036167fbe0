"""IQR and Z-score anomalies over period points.

All statistics are per ``keys…, series`` over *aggregated* points, so their
cost is bounded by the number of periods, never by ledger rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators._keys import attach, top_k
from tallyframe.operators.series import SERIES_LABELS, long_visible, visible_series
from tallyframe.roles import Ledger

# Fixed values that must equal the reference.
Z_SCORE_THRESHOLD = 2.5
IQR_MULTIPLIER = 1.5
MIN_PERIODS_FOR_ANOMALIES = 4
MAX_ANOMALIES = 8
HIGH_SEVERITY_SCORE = 3.0
# Allowed directions per series; the first that fires wins.
SERIES_DIRECTIONS = {"revenue": ("high",), "expenses": ("high",), "profit": ("low",),
                     "amount": ("low", "high")}
MSG_NO_POINTS = "No chart data available for anomaly detection."
MSG_FEW_PERIODS = "Need at least 4 periods to detect anomalies."
MSG_NO_VISIBLE = "No visible financial series available for anomaly detection."
MSG_NONE_FOUND = "No unusual periods found with the current grouping."


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _stat_columns(value: Column, agg) -> dict[str, Column]:
    """Per-series statistics; ``agg`` wraps an aggregate (groupBy or window)."""
    return {
        "n_values": agg(F.count(F.lit(1))),
        "abs_sum": agg(F.sum(F.abs(value))),
        "q1": agg(F.percentile(value, 0.25)),
        "median": agg(F.percentile(value, 0.5)),
        "q3": agg(F.percentile(value, 0.75)),
        "mean": agg(F.avg(value)),
        "std": agg(F.stddev_pop(value)),
    }


def _bounds() -> dict[str, Column]:
    q1, q3, std, mean = F.col("q1"), F.col("q3"), F.col("std"), F.col("mean")
    iqr = q3 - q1
    return {
        "high_iqr_bound": F.when(iqr > 0, q3 + IQR_MULTIPLIER * iqr),
        "low_iqr_bound": F.when(iqr > 0, q1 - IQR_MULTIPLIER * iqr),
        "high_z_bound": F.when(std > 0, mean + Z_SCORE_THRESHOLD * std),
        "low_z_bound": F.when(std > 0, mean - Z_SCORE_THRESHOLD * std),
    }


def _eligible() -> Column:
    return ((F.col("n_points") >= MIN_PERIODS_FOR_ANOMALIES) & (F.col("n_values") >= MIN_PERIODS_FOR_ANOMALIES)
            & (F.col("abs_sum") != 0))


def series_stats(points: DataFrame, ledger: Ledger) -> DataFrame:
    """Per key and visible series: quartiles, median, mean, population std and
    the IQR / Z bounds (a bound is null when IQR or std is 0).

    Only series with at least 4 finite values, a non-zero absolute sum, and keys
    with at least 4 points are kept.
    """
    keys = list(ledger.keys)
    long = long_visible(points, ledger).where(_finite(F.col("value")))
    cols = _stat_columns(F.col("value"), lambda c: c)
    stats = long.groupBy(*keys, "series", "series_order").agg(
        *[c.alias(n) for n, c in cols.items()], F.max("n_points").alias("n_points"))
    stats = stats.where(_eligible())
    return stats.select(*keys, "series", "series_order", "n_values", "q1", "median", "q3", "mean", "std",
                        *[c.alias(n) for n, c in _bounds().items()])


def _direction_test(direction: str):
    v = F.col("value")
    iqr_b, z_b = F.col(f"{direction}_iqr_bound"), F.col(f"{direction}_z_bound")
    if direction == "high":
        iqr_hit, z_hit = v > iqr_b, v > z_b
    else:
        iqr_hit, z_hit = v < iqr_b, v < z_b
    iqr_hit = F.coalesce(iqr_hit, F.lit(False))
    z_hit = F.coalesce(z_hit, F.lit(False))
    iqr_score = F.lit(1.0) + F.abs(v - iqr_b) / F.greatest(F.abs(iqr_b), F.lit(1.0))
    z_score = F.abs(v - F.col("median")) / F.col("std")
    score = F.greatest(F.when(iqr_hit, iqr_score), F.when(z_hit, z_score))
    rule = F.concat_ws(", ", F.when(iqr_hit, F.lit("IQR")), F.when(z_hit, F.lit("Z-score")))
    return iqr_hit | z_hit, score, rule


def all_anomalies(points: DataFrame, ledger: Ledger) -> DataFrame:
    """Every flagged point: ``keys…, period, series, series_label, kind, value,
    baseline, score, rule, severity, series_order``.

    One chain over the points: visible long form, statistics as window
    aggregates over ``keys, series`` (the key shuffle of the points already
    clusters them), bounds and rules as projections. No join back.
    """
    keys = list(ledger.keys)
    long = long_visible(points, ledger).where(_finite(F.col("value")))
    w = Window.partitionBy(*keys, "series")
    stats = _stat_columns(F.col("value"), lambda c: c.over(w))
    cand = long.select("*", *[c.alias(n) for n, c in stats.items()]).where(_eligible())
    cand = cand.select("*", *[c.alias(n) for n, c in _bounds().items()])
    hit_cols, score_cols, rule_cols, kind_cols = [], [], [], []
    for direction in ("low", "high"):
        hit, score, rule = _direction_test(direction)
        allowed = F.col("series").isin(*[s for s, d in SERIES_DIRECTIONS.items() if direction in d])
        hit_cols.append(allowed & hit)
        score_cols.append(score)
        rule_cols.append(rule)
        kind_cols.append(F.lit("drop" if direction == "low" else "spike"))
    low_hit, high_hit = hit_cols
    pick = lambda lo, hi: F.when(low_hit, lo).when(high_hit, hi)
    labels = F.create_map(*[x for k, v in SERIES_LABELS.items() for x in (F.lit(k), F.lit(v))])
    out = cand.where(low_hit | high_hit).select(
        *keys, "period", "series", labels[F.col("series")].alias("series_label"),
        pick(*kind_cols).alias("kind"), "value", F.col("median").alias("baseline"),
        pick(*score_cols).alias("score"), pick(*rule_cols).alias("rule"), "series_order",
    )
    return out.withColumn("severity", F.when(F.col("score") >= HIGH_SEVERITY_SCORE, "High")
                          .otherwise("Medium"))


def detect_anomalies(points: DataFrame, ledger: Ledger, max_items: int | None = MAX_ANOMALIES) -> DataFrame:
    """Strongest anomalies per key (score, then distance from baseline), with
    ``rank`` and ``total_found`` (all anomalies found for the key)."""
    keys = list(ledger.keys)
    found = all_anomalies(points, ledger)
    found = found.withColumn("total_found", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    order = [F.col("score").desc(), F.abs(F.col("value") - F.col("baseline")).desc(),
             F.col("series_order").asc(), F.col("period").asc()]
    return top_k(found, keys, order, max_items)


def anomaly_status(points: DataFrame, ledger: Ledger) -> DataFrame:
    """Per key status message of anomaly detection ('' when anomalies exist)."""
    keys = list(ledger.keys)
    visible = visible_series(points, ledger).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_visible"))
    found = all_anomalies(points, ledger).groupBy(*keys).agg(F.count(F.lit(1)).alias("total_found"))
    base = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    base = attach(attach(base, visible, keys), found, keys)
    n_vis = F.coalesce("n_visible", F.lit(0))
    tot = F.coalesce("total_found", F.lit(0)).cast("bigint")
    msg = (F.when(F.col("n_points") == 0, F.lit(MSG_NO_POINTS))
           .when(F.col("n_points") < MIN_PERIODS_FOR_ANOMALIES, F.lit(MSG_FEW_PERIODS))
           .when(n_vis == 0, F.lit(MSG_NO_VISIBLE))
           .when(tot == 0, F.lit(MSG_NONE_FOUND)).otherwise(F.lit("")))
    return base.select(*keys, "n_points", tot.alias("total_found"), msg.alias("message"))
