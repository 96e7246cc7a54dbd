"""Times the headline queries on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from auditloom.plans.queries import QUERIES  # noqa: E402
from auditloom.session import get_session  # noqa: E402

HEADLINE = (
    "lines",
    "rules_sql",
    "rules_code",
    "rules_secret",
    "rules_rel",
    "mask_documents",
    "secrets_in_documents",
    "dedup",
    "severity_counts",
    "scores",
    "manifest",
    "dependencies",
    "undocumented_env",
    "routes_express",
    "routes_python",
    "flows",
    "graph_nodes",
    "graph_summary",
    "correlate",
    "sarif_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "auditloom-bench", int(cpus) if cpus.isdigit() else 8)
    timings: dict[str, float] = {}
    QUERIES["corpus"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up, not timed
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
