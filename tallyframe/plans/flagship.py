"""The flagship plan: weekly sales points with their anomalies attached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import anomalies, series
from tallyframe.plans import views
from tallyframe.plans.registry import query, r
from tallyframe.plans.sql_views import SALES, anomaly_ctes


def weekly_points_with_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.session import configure
    configure(spark)
    led = views.sales(spark, sf_dir)
    pts = series.time_series(led, "week", "monday")
    flagged = anomalies.all_anomalies(pts, led)
    per_period = flagged.groupBy("period").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        F.max("score").alias("max_score"),
        F.concat_ws(", ", F.sort_array(F.collect_set(F.concat_ws(" ", "series", "kind")))).alias("anomalies"))
    return (pts.join(per_period, "period", "left")
            .select("period", r("revenue"), r("expenses"), r("profit"),
                    F.coalesce("anomaly_count", F.lit(0)).cast("bigint").alias("anomaly_count"),
                    r("max_score", 6), F.coalesce("anomalies", F.lit("")).alias("anomalies")))


@query("q_weekly_flagged", f"""WITH {anomaly_ctes(SALES, 'sales', 'week')},
pa AS (SELECT period, count(*)::BIGINT AS anomaly_count, max(score) AS max_score,
          string_agg(series || ' ' || kind, ', ' ORDER BY series || ' ' || kind) AS anomalies FROM a GROUP BY period)
SELECT p.period, round(p.revenue, 2) AS revenue, round(p.expenses, 2) AS expenses, round(p.profit, 2) AS profit,
       coalesce(pa.anomaly_count, 0)::BIGINT AS anomaly_count, round(pa.max_score, 6) AS max_score,
       coalesce(pa.anomalies, '') AS anomalies
FROM p LEFT JOIN pa USING (period)""")
def q_weekly_flagged(spark, sf):
    """entry(): weekly points left-joined to their anomalies."""
    return weekly_points_with_anomalies(spark, sf)
