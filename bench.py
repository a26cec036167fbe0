"""Benchmark: time every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is executed once to warm the JVM/plan caches, then timed; results
go to the ``noop`` sink so the measure is execution, not driver transfer.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyframe.plans.registry import QUERIES, load_all  # noqa: E402
from tallyframe.session import get_session  # noqa: E402


CORE = ("q_metrics", "q_series", "q_anomalies", "q_forecast", "q_insights", "q_report", "flagship")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(f"local[{cpus}]", int(cpus))
    load_all()
    names = sorted(n for n in QUERIES if not only or n in only)
    timings: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - t0, 4)
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e).splitlines()[0][:200]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "sf": float(m.group(1)) if m else sf_dir, "n_queries": len(timings),
           # the reference's end-to-end action (file → roles → analysis → report), for BASELINE,
           # and the analytics queries over the driver tables (no files, no column detection)
           "headline": {"file_to_report_sec": timings.get("q_file_report"),
                        "core_analytics_sec": round(sum(v for k, v in timings.items()
                                                        if QUERIES[k].__module__.rsplit(".", 1)[-1] in CORE), 3)}}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
