"""Rule-based insight sentences (I1-I9), per key, as DataFrames.

Each rule yields rows ``keys…, rule_order, rule, value, text`` only when its
inputs support a sentence; the union is capped at 6 per key in rule order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.format import format_date, format_money, format_percent
from tallyframe.operators._keys import top_k
from tallyframe.operators.labels import label_col, series_label_col, template_col
from tallyframe.roles import Ledger

# Fixed values that must equal the reference.
MAX_INSIGHTS = 6
MIN_CATEGORY_SHARE = 25.0
MIN_COMPARISON_BASE = 1e-9
FORECAST_PREFERENCE = ("profit", "amount", "revenue")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def percent_change(base: Column, current: Column) -> Column:
    """(current − base) / |base| · 100; null when |base| ≤ 1e-9 or not finite."""
    pct = (current - base) / F.abs(base) * 100
    return F.when(_finite(base) & _finite(current) & (F.abs(base) > MIN_COMPARISON_BASE) & _finite(pct), pct)


def _rows(df: DataFrame, keys, order: int, rule: str, value: Column, text: Column) -> DataFrame:
    return df.select(*keys, F.lit(order).cast("bigint").alias("rule_order"), F.lit(rule).alias("rule"),
                     value.cast("double").alias("value"), text.alias("text")).where(F.col("text").isNotNull())


def last_period_change(points: DataFrame, keys, language: str = "en") -> DataFrame:
    """Profit of the last period against the one before (needs 2 points)."""
    keys = list(keys)
    last2 = top_k(points, keys, [F.col("period").desc()], 2, "pos")
    agg = last2.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                   F.max(F.when(F.col("pos") == 1, F.col("profit"))).alias("latest"),
                                   F.max(F.when(F.col("pos") == 2, F.col("profit"))).alias("previous"))
    pct = F.when(F.col("n") >= 2, percent_change(F.col("previous"), F.col("latest")))
    agg = agg.withColumn("pct", pct)
    up = template_col(language, "insight_profit_change_up", percent=format_percent(F.abs("pct")))
    down = template_col(language, "insight_profit_change_down", percent=format_percent(F.abs("pct")))
    text = F.when(F.col("pct") >= 0, up).when(F.col("pct") < 0, down)
    return _rows(agg, keys, 1, "last_period_change", F.col("pct"), text)


def half_period_trend(points: DataFrame, keys, language: str = "en") -> DataFrame:
    """Second half of the points against the first (split at n // 2; needs 4)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("period")
    ix = (points.withColumn("idx", F.row_number().over(w) - 1)
          .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    mid = F.floor(F.col("n") / 2)
    agg = ix.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(F.when(F.col("idx") < mid, F.col("profit")).otherwise(F.lit(0.0))).alias("first_half"),
        F.sum(F.when(F.col("idx") >= mid, F.col("profit")).otherwise(F.lit(0.0))).alias("second_half"))
    agg = agg.withColumn("pct", F.when(F.col("n") >= 4, percent_change(F.col("first_half"), F.col("second_half"))))
    up = template_col(language, "insight_half_trend_up", percent=format_percent(F.abs("pct")))
    down = template_col(language, "insight_half_trend_down", percent=format_percent(F.abs("pct")))
    text = F.when(F.col("pct") >= 0, up).when(F.col("pct") < 0, down)
    return _rows(agg, keys, 2, "half_period_trend", F.col("pct"), text)


def category_concentration(top_categories: DataFrame, keys, language: str = "en") -> DataFrame:
    """Share of turnover (|revenue| + |expenses|) held by the leading listed category."""
    keys = list(keys)
    t = top_categories.withColumn("turnover", F.abs(F.coalesce("revenue", F.lit(0.0)))
                                  + F.abs(F.coalesce("expenses", F.lit(0.0))))
    agg = t.groupBy(*keys).agg(
        F.sum("turnover").alias("total"),
        F.max_by("category", F.struct(F.col("turnover"), -F.col("rank"))).alias("leader"),
        F.max("turnover").alias("leader_turnover"))
    share = F.col("leader_turnover") / F.col("total") * 100
    agg = agg.withColumn("share", F.when((F.col("total") > MIN_COMPARISON_BASE) & _finite(share)
                                         & (share >= MIN_CATEGORY_SHARE), share))
    text = F.when(F.col("share").isNotNull(), template_col(
        language, "insight_category_share", name=F.col("leader"), percent=format_percent(F.col("share"))))
    return _rows(agg, keys, 3, "category_concentration", F.col("share"), text)


def anomaly_summary(ranked_anomalies: DataFrame, keys, language: str = "en") -> DataFrame:
    """How many unusual periods, and the strongest (rank 1)."""
    keys = list(keys)
    first = ranked_anomalies.where(F.col("rank") == 1)
    kind = label_col(language, F.when(F.col("kind") == "drop", F.lit("anomaly_drop")).otherwise(F.lit("anomaly_spike")))
    text = template_col(language, "insight_anomalies", count=F.col("total_found").cast("string"), kind=kind,
                        series=series_label_col(language, F.col("series")),
                        date=format_date(F.col("period")))
    return _rows(first, keys, 4, "anomaly_summary", F.col("total_found"), text)


def burn_rate_and_cash_gap(basic: DataFrame, keys, language: str = "en") -> DataFrame:
    """Average daily expense (> 0) and a cash-gap warning when the average day loses money."""
    keys = list(keys)
    exp, prof = F.col("average_daily_expense"), F.col("average_daily_profit")
    burn = F.when(_finite(exp) & (exp > 0),
                  template_col(language, "insight_burn_rate", value=format_money(exp)))
    gap = F.when(_finite(prof) & (prof < 0),
                 template_col(language, "insight_cash_gap", value=format_money(F.abs(prof))))
    return _rows(basic, keys, 5, "burn_rate", exp, burn).unionByName(
        _rows(basic, keys, 6, "cash_gap", prof, gap))


def forecast_summary(forecasts: DataFrame, keys, language: str = "en") -> DataFrame:
    """Next projected value of the first of profit / amount / revenue that was forecast."""
    keys = list(keys)
    pref = F.create_map(*[x for i, s in enumerate(FORECAST_PREFERENCE) for x in (F.lit(s), F.lit(i))])
    first = forecasts.where((F.col("step") == 0) & F.col("series").isin(*FORECAST_PREFERENCE))
    pick = first.groupBy(*keys).agg(F.min_by(F.struct("series", "value"), pref[F.col("series")]).alias("p"))
    v = F.col("p.value")
    text = F.when(_finite(v), template_col(language, "insight_forecast",
                                           series=series_label_col(language, F.col("p.series")),
                                           value=format_money(v)))
    return _rows(pick, keys, 7, "forecast_summary", v, text)


def generate_insights(ledger: Ledger, points: DataFrame, basic: DataFrame, top_categories: DataFrame,
                      ranked_anomalies: DataFrame, forecasts: DataFrame | None = None,
                      language: str = "en", limit: int = MAX_INSIGHTS) -> DataFrame:
    """All insight rules in priority order, at most ``limit`` per key."""
    keys = list(ledger.keys)
    parts = [last_period_change(points, keys, language), half_period_trend(points, keys, language),
             category_concentration(top_categories, keys, language),
             anomaly_summary(ranked_anomalies, keys, language),
             burn_rate_and_cash_gap(basic, keys, language)]
    if forecasts is not None:
        parts.append(forecast_summary(forecasts, keys, language))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_k(out, keys, [F.col("rule_order").asc()], limit, "position")

