"""Summarise the physical plan of registered jobs (after AQE has run).

    python tools/plan_report.py [--sf DIR] [name ...]  > PLANS.md

Per job: exchanges (shuffles) and what they partition on, join strategies,
window / aggregate operators, Python evaluation nodes, and the columns
each parquet scan reads.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aspectspark import catalog  # noqa: E402
from aspectspark.session import get_session  # noqa: E402


def summarize(plan: str) -> dict:
    lines = plan.splitlines()
    out = {"exchanges": [], "joins": [], "windows": 0, "group_limits": 0, "aggs": {},
           "python": 0, "scans": []}
    for ln in lines:
        m = re.search(r"Exchange (hashpartitioning\(([^)]*)\)|SinglePartition|rangepartitioning"
                      r"|RoundRobinPartitioning\(\d+\))", ln)
        if m and "ReusedExchange" not in ln:
            part = m.group(1)
            if m.group(2):
                keys = [re.sub(r"#\d+L?", "", k.strip()) for k in m.group(2).split(",")[:-1]]
                part = "hash(" + ", ".join(keys) + ")"
            out["exchanges"].append(part)
        m = re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|"
                      r"CartesianProduct)\b", ln)
        if m:
            t = re.search(r", (Inner|LeftOuter|LeftSemi|LeftAnti|FullOuter|RightOuter)\b", ln)
            out["joins"].append(m.group(1) + (f" {t.group(1)}" if t else ""))
        if re.search(r"\bWindow \[", ln):
            out["windows"] += 1
        if "WindowGroupLimit" in ln and "Partial" in ln:
            out["group_limits"] += 1
        m = re.search(r"\b(HashAggregate|ObjectHashAggregate|SortAggregate)\(", ln)
        if m:
            out["aggs"][m.group(1)] = out["aggs"].get(m.group(1), 0) + 1
        if re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", ln):
            out["python"] += 1
        m = re.search(r"FileScan (\w+) \[([^\]]*)\].*Location: [^\[]*\[([^\]]*)\]", ln)
        if m:
            cols = [re.sub(r"#\d+L?", "", c) for c in m.group(2).split(",")]
            t = re.search(r"/([a-z_]+)\.parquet", m.group(3))
            name = t.group(1) if t else f"{m.group(1)} scratch"
            out["scans"].append(f"{name}({', '.join(cols)})")
    return out


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_session("local[8]")
    names = a.names or list(catalog.QUERIES)
    print("# Physical plans (after AQE), sf dir " + a.sf + "\n")
    print("| job | shuffles | joins | windows (partial limits) | aggregates | python | scans |")
    print("|---|---|---|---|---|---|---|")
    for n in names:
        if n in ("train_head", "cross_validate", "cross_validate_metrics", "cross_validate_multilabel",
                 "cross_validate_multilabel_metrics"):
            continue
        df = catalog.QUERIES[n](spark, a.sf)
        df.write.format("noop").mode("overwrite").save()      # let AQE finalise
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        aggs = ", ".join(f"{k} x{v}" for k, v in sorted(s["aggs"].items()))
        print(f"| {n} | {len(s['exchanges'])}: {'; '.join(s['exchanges'])} | "
              f"{'; '.join(s['joins']) or '-'} | {s['windows']} ({s['group_limits']}) | "
              f"{aggs or '-'} | {s['python'] or '-'} | {'; '.join(sorted(set(s['scans'])))} |")


if __name__ == "__main__":
    main()
