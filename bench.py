"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  tables to read      (default /root/testdata/sf0.1)
BENCH_CPUS    local threads       (default 8)
BENCH_QUERIES comma list of names (default: the headline queries)
"""

from __future__ import annotations

import json
import os
import re
import time

from cartloom.plans.pinning import drop_pinned
from cartloom.plans.session import local_session
from cartloom.queries import QUERIES

HEADLINE = [
    "picks_per_slot", "order_lines", "line_class_counts", "legacy_line_numbers", "members_start",
    "first_pickup_slot", "cart_search", "standard_full_match", "standard_collapsed",
    "lines_after_delete", "reconciliation", "item_labels", "page_packing", "page_grid",
    "two_column_sheet", "cell_styles",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus)
    # start the JVM's and the Python workers' machinery outside the timings
    QUERIES["line_class_counts"](spark, sf_dir).count()
    spark.range(cpus).mapInPandas(lambda batches: batches, "id long").count()
    times = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        drop_pinned(spark)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
