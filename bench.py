"""Benchmark the headline queries.

Runs each headline query over the tables in ``$BENCH_SF_DIR`` (default
``/root/testdata/sf0.1``) on ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is executed to completion with the ``noop`` sink (full work, no
driver collect).  Before timing, every headline query runs once, untimed, on
the smallest tables (``$BENCH_WARMUP_DIR``, default the sf0.001 folder next
to the benchmark folder) so JIT and whole-stage code generation are warm:
the timings are steady-state, which is what long jobs at scale see.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfspark.plans import registry  # noqa: E402
from shelfspark.session import get_spark  # noqa: E402

HEADLINE = (
    "top_links_per_page",
    "page_profile",
    "site_profile",
    "canonical_product",
    "merge_products",
    "catalog_summary",
    "category_tree",
    "category_assignments",
    "pricebook_entries",
    "products_per_category",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, app_name="shelfspark-bench")
    spark.conf.set("spark.shelfspark.spreadPartitions", cpus if cpus.isdigit() else "8")  # the tables here have one row group
    plans = registry.plans()
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            plans[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
            spark.catalog.clearCache()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "warmup": warm_dir if os.path.isdir(warm_dir) else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
