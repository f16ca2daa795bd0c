"""Run registered queries against their DuckDB oracles.

usage: python scripts/check_oracle.py [--oracle-only] [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nutriyield.plans.catalog import ORACLE, QUERIES  # noqa: E402
from nutriyield.plans.compare import compare, duck  # noqa: E402
from nutriyield.session import get_spark  # noqa: E402


def main() -> int:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    if "--oracle-only" in sys.argv:
        names = [n for n in names if n in ORACLE]
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        t0 = time.time()
        if n not in ORACLE:
            rows = QUERIES[n](spark, sf_dir).count()
            print(json.dumps({"name": n, "rows_only": rows, "sec": round(time.time() - t0, 2)}))
            continue
        try:
            r = compare(spark, con, n, QUERIES[n], ORACLE[n], sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "error": str(e)[:800]}
        r["sec"] = round(time.time() - t0, 2)
        bad += not r.get("hash_match")
        print(json.dumps(r, default=str))
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
