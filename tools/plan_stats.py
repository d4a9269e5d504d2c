"""Print plan statistics (scans, shuffles, reuse, broadcasts) per query.

Usage: ``python tools/plan_stats.py [base_dir] [--full name] [--markdown]``.
The final (adaptive) plan is read after running the query once.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "scans": r"Scan parquet",
    "shuffles": r"(?<![A-Za-z])Exchange \(",
    "reused": r"ReusedExchange",
    "bcast": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "bnlj": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "expand": r"Expand",
    "python": r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas",
    "window": r"Window ",
    }


def plan_text(df) -> str:
    """Operator trees of the final adaptive plans (main query and each
    subquery) of the run itself: ``collect`` uses the frame's own query
    execution, so the formatted explain afterwards shows what ran."""
    df.collect()
    jvm = df.sparkSession._jvm
    text = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    keep, final = [], False
    for line in text.splitlines():
        if "== Final Plan ==" in line:
            final = True
            continue
        if "== Initial Plan ==" in line or line.startswith("("):
            final = False
            continue
        if final:
            keep.append(line)
    if not keep:  # no exchange, so no adaptive plan: the tree is the plan
        keep = [line for line in text.splitlines() if not line.startswith("(")]
    return "\n".join(keep)


def scan_widths(df) -> list[int]:
    """Number of columns read by each Parquet scan of the final plans
    (a 1-column scan is the narrow date scan behind a scalar subquery)."""
    df.collect()
    jvm = df.sparkSession._jvm
    text = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    final_ids, final = set(), False
    for line in text.splitlines():
        if "== Final Plan ==" in line:
            final = True
        elif "== Initial Plan ==" in line or line.startswith("("):
            final = False
        elif final:
            m = re.search(r"Scan parquet\s+\((\d+)\)", line)
            if m:
                final_ids.add(m.group(1))
    lines = text.splitlines()
    widths = []
    for i, line in enumerate(lines):
        m = re.match(r"\((\d+)\) Scan parquet", line)
        if m and (not final_ids or m.group(1) in final_ids):
            out = next((x for x in lines[i + 1:i + 3] if x.startswith("Output [")), "Output [0]")
            widths.append(int(re.match(r"Output \[(\d+)\]", out).group(1)))
    return widths


def main(argv):
    from basketlens.plans import queries
    from basketlens.session import build_session

    base = "/root/testdata/sf0.01"
    full = None
    args = list(argv)
    markdown = "--markdown" in args
    if markdown:
        args.remove("--markdown")
    if "--full" in args:
        i = args.index("--full")
        full = args[i + 1]
        del args[i : i + 2]
    if args:
        base = args[0]
    spark = build_session("local[8]", 8)
    cat = queries()
    names = [full] if full else list(cat)
    if markdown:
        keys = list(PATTERNS)
        print("| query | " + " | ".join(keys) + " |")
        print("| --- | " + " | ".join("---" for _ in keys) + " |")
    for name in names:
        df = cat[name](spark, base)
        if full:
            print(plan_text(df))
            continue
        text = plan_text(df)
        stats = {k: len(re.findall(p, text)) for k, p in PATTERNS.items()}
        if markdown:
            print(f"| `{name}` | " + " | ".join(str(stats[k]) for k in PATTERNS) + " |")
            continue
        print(f"{name:28s} " + " ".join(f"{k}={v}" for k, v in stats.items() if v))


if __name__ == "__main__":
    main(sys.argv[1:])
