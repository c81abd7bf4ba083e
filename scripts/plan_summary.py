"""Print, per registered query, the physical plan's exchanges, broadcasts,
scans (with their read schema) and whether Python runs in it.

Usage: python scripts/plan_summary.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bugroute.plans.catalog import CATALOG  # noqa: E402
from bugroute.session import local_session  # noqa: E402


def summary(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin", plan))
    broadcasts = plan.count("BroadcastExchange")
    python = "yes" if ("MapInPandas" in plan or "ArrowEvalPython" in plan or "PythonMapInArrow" in plan) else "no"
    scans = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))
    return f"shuffles={exchanges} broadcasts={broadcasts} python={python} scans={scans}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or [n for n, (_, sql) in CATALOG.items() if sql]
    spark = local_session(8)
    for name in names:
        df = CATALOG[name][0](spark, sf_dir)
        print(f"{name}: {summary(df)}")


if __name__ == "__main__":
    main()
