"""Headline benchmark: runs the engine's main jobs over $BENCH_SF_DIR.

Prints one JSON line: {"metric": ..., "value": total_sec, "unit": "sec",
"queries": {name: sec}, "sf": ...}. Each query is executed fully (noop sink),
after one warm-up run of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logloom.plans.registry import queries  # noqa: E402
from logloom.session import local_session  # noqa: E402

HEADLINE = [
    "rule_parse_metrics",      # flagship: F1, F8, F9 + all metrics
    "mask_message",            # F2 over logs and text tables
    "uncommon_tokens",         # P1: dictionary anti-join over all tokens
    "candidate_groups",        # A2/A3 dedup before sampling
    "diversified_sample",      # A5-A8 sampling, 32 per system
    "catalog_parse_metrics",   # L3: catalog seed, match joins, labelling, metrics
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    qs = queries()
    names = [n for n in HEADLINE if n in qs]
    # warm-up: JIT and parquet footers, not counted
    qs["log_view"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
