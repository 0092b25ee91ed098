"""Print a plan summary per query: exchanges, joins, Python stages, scans.

Usage: python scripts/plan_check.py [sf_dir] [query ...] [--full]
Flags single-partition exchanges, cartesian / nested-loop joins and
row-at-a-time Python UDFs.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from dialoglab.plans.catalog import QUERIES  # noqa: E402
from dialoglab.session import get_spark  # noqa: E402


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main():
    args = sys.argv[1:]
    full = "--full" in args
    args = [a for a in args if a != "--full"]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # static plan: what the cluster would start with
    qs = QUERIES  # the queries of dialoglab.llm run jobs while they are built
    for name in names or list(qs):
        if name in ("train_binary", "train_multilabel", "train_epochs", "best_training_run", "annotator_reliability"):
            continue
        p = plan_text(qs[name](spark, sf))
        flags = []
        for pat, label in [(r"SinglePartition", "SINGLE-PARTITION"), (r"CartesianProduct", "CARTESIAN"),
                           (r"BroadcastNestedLoopJoin", "NESTED-LOOP"), (r"BatchEvalPython", "ROW-UDF"),
                           (r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", "ARROW")]:
            n = len(re.findall(pat, p))
            if n:
                flags.append(f"{label}x{n}")
        ex = len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", p))
        bc = len(re.findall(r"BroadcastExchange", p))
        print(f"{name:32s} shuffles={ex} broadcasts={bc} {' '.join(flags)}")
        if full:
            print(p)


if __name__ == "__main__":
    main()
