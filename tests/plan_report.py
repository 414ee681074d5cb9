"""Physical-operator census of the headline queries (initial plan, before AQE
re-planning): shuffles, join strategies, windows, Python stages.

Usage: python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

OPS = {
    "shuffle": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobinPartitioning",
    "broadcast": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "bnlj": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "window": r"(?<!Group)Window \[|^\s*[+:\- ]*Window\b",
    "group_limit": r"WindowGroupLimit",
    "topk": r"TakeOrderedAndProject",
    "python": r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|BatchEvalPython",
    "partial_agg": r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_",
}


def census(plan: str) -> dict[str, int]:
    return {k: len(re.findall(p, plan, flags=re.M)) for k, p in OPS.items()}


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from cohortlens.session import build_session
    import __spark_entry__ as E
    from bench import HEADLINE
    spark = build_session("local[8]", 16)
    q = E.queries()
    print("| query | " + " | ".join(OPS) + " |")
    print("|---" * (len(OPS) + 1) + "|")
    for n in HEADLINE:
        if n.startswith("scan_"):
            continue
        plan = q[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
        c = census(plan)
        print(f"| {n} | " + " | ".join(str(c[k]) for k in OPS) + " |")


if __name__ == "__main__":
    main(sys.argv)
