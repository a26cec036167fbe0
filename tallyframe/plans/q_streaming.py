"""Streaming query: hourly points kept by a file stream over staged events."""

from __future__ import annotations

import os
import uuid

from tallyframe.plans import staging
from tallyframe.plans.registry import query, r
from tallyframe.plans.sql_views import CASH, points
from tallyframe.roles import Roles
from tallyframe.streaming.points import read_points, start_points_stream


@query("q_stream_points", f"""WITH {CASH}, p AS ({points('cash', 'hour')})
SELECT period, round(revenue, 2) AS revenue, round(expenses, 2) AS expenses, round(profit, 2) AS profit,
       round(amount, 2) AS amount FROM p""")
def q_stream_points(spark, sf):
    """Structured Streaming over the staged event files (available-now trigger):
    per-batch partial points, summed per hour."""
    src = staging.stage_events_csv(spark, sf)
    # a fresh sink and stream checkpoint per run, so every run streams all files
    root = os.path.join(staging.stage_root(spark, sf), "streams", uuid.uuid4().hex)
    roles = Roles(date="ts", amount="amount", category="event_type")
    q = start_points_stream(spark, src, "ts string, event_type string, amount string", roles,
                            os.path.join(root, "stream_points"), grain="hour",
                            checkpoint_location=os.path.join(root, "stream_points_ckpt"))
    q.awaitTermination()
    pts = read_points(spark, os.path.join(root, "stream_points"), roles)
    return pts.select("period", r("revenue"), r("expenses"), r("profit"), r("amount"))
