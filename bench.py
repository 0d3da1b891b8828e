"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each query is forced to completion with the no-op sink (every row computed,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradewell.session import get_session  # noqa: E402
from gradewell.plans import registry  # noqa: E402
from gradewell.sources.corpus import responses  # noqa: E402

HEADLINE = ["score_standardization", "standardization_report", "score_simplicity", "robustness_components",
            "score_robustness", "score_efficiency", "score_comment", "score_modularity", "score_functionality",
            "scorecard"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus) * 2)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    qs = registry.queries()
    times = {}
    t0 = time.time()
    responses(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times["corpus"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        if name not in qs:
            continue
        t = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
