"""Write PLANS.md: the formatted physical plan summary of chosen queries.

usage: python scripts/show_plans.py [sf_dir] [name ...]

For each query: shuffle / broadcast exchange counts of the static plan (before
AQE re-plans at runtime), and every parquet scan with its pushed filters and
read schema, so column pruning and filter pushdown can be checked by eye.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nutriyield.plans.catalog import QUERIES  # noqa: E402
from nutriyield.session import get_spark  # noqa: E402

DEFAULT = ["dom_summary_table", "dom_kobo_trips", "dom_density_by_habitat", "dom_affordability",
           "sta_permanova_gn"]


def summarize(name: str, plan: str) -> str:
    head = plan.split("\n\n(1)")[0]
    n_bc = head.count("BroadcastExchange")
    n_sh = head.count("Exchange") - n_bc - head.count("ReusedExchange")
    lines = [f"## {name}", "",
             f"static plan: {n_sh} shuffle exchanges, {n_bc} broadcast exchanges, "
             f"{head.count('SortMergeJoin')} sort-merge joins, {head.count('BroadcastHashJoin')} broadcast joins, "
             f"{head.count('Window')} windows", ""]
    for block in re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]*\n){0,8}", plan):
        keep = [ln for ln in block.splitlines() if ln.startswith(("(", "PushedFilters", "ReadSchema"))]
        lines.append("    " + "\n    ".join(keep))
        lines.append("")
    return "\n".join(lines)


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    names = args[1:] or DEFAULT
    spark = get_spark("local[2]", 8)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    out = ["# Physical plans", "",
           f"Generated by `scripts/show_plans.py` on {os.path.basename(sf_dir)}. Counts are of the static plan;",
           "AQE reuses identical exchanges and turns measured-small joins into broadcasts at runtime.", ""]
    for n in names:
        df = QUERIES[n](spark, sf_dir)
        out.append(summarize(n, df._jdf.queryExecution().explainString(mode)))
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out) + "\n")
    print(path)


if __name__ == "__main__":
    main()
