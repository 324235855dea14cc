"""Physical-plan audit of every registered query: number of exchanges and any
cartesian product / nested-loop join / explicit broadcast of growing data.

    python -m checks.plans [sf_dir]
"""

from __future__ import annotations

import re
import sys


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from ledgermatch import get_session
    from ledgermatch.plans.registry import QUERIES
    spark = get_session()
    bad = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin")
    worst = 0
    for name, fn in QUERIES.items():
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        hits = sorted(set(m.group(0) for m in bad.finditer(plan)))
        worst += bool(hits)
        print(f"{name:28s} exchanges={plan.count('Exchange'):3d} "
              f"scans={plan.count('FileScan'):3d} {' '.join(hits) or 'ok'}")
    return worst


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
