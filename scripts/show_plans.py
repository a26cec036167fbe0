"""Print the physical plans of selected queries (markdown) for review.

Usage: python scripts/show_plans.py [sf_dir] [query ...] > PLANS.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.plans.registry import QUERIES, load_all  # noqa: E402
from tallyframe.session import get_session  # noqa: E402

DEFAULT = ["q_anomalies_keyed", "q_ledger_rollup", "q_top_categories_keyed", "q_top_categories", "q_clean_money",
           "q_forecast_errors"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or DEFAULT
    load_all()
    spark = get_session("local[8]", 8)
    print(f"# Physical plans (`{sf}`, local[8], AQE final plans after execution)\n")
    print("Generated by `scripts/show_plans.py`. Each plan is the adaptive plan after the query ran, so")
    print("runtime decisions (broadcast conversions, coalesced partitions) are visible.\n")
    for name in names:
        df = QUERIES[name](spark, sf)
        df.collect()  # runs this DataFrame's own QueryExecution, finalising its adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        doc = (QUERIES[name].__doc__ or "").strip().splitlines()
        print(f"## {name}\n\n{doc[0] if doc else ''}\n\n```\n{plan}```\n")


if __name__ == "__main__":
    main()
