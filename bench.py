"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: data folder. BENCH_CPUS: local threads. BENCH_QUERIES: comma list of
query names, or ``all``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tallyhouse.plans import load_queries
from tallyhouse.session import build_session

HEADLINE = (
    "governed_top_customers", "top_n", "revenue_by_category", "group_by_month", "group_by_two_dims",
    "count_distinct", "invoices", "order_subtotals", "category_sales_rollup", "filter_having_style",
    "left_anti", "bridge_join", "multi_hop_path", "customer_metrics", "min_group_size", "catalog_lint",
    "redact_payload", "mask_partial", "extract_terms", "classify_columns", "match_glossary",
    "score_examples", "score_tables", "pack_context", "keyword_search", "vector_search",
    "multi_collection_search", "embed_once", "span_mean_pool", "trailing_window_count",
    "concurrency_peak", "rate_limit_replay", "request_lifecycle", "audit_rollup", "windowed_activity",
    "missing_references", "benchmark_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    known = load_queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not chosen else tuple(known) if chosen == "all" else tuple(chosen.split(","))
    spark = build_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One small query per engine path, so that no figure carries the start of the JVM or
    # of the Python workers.
    for name in ("top_n", "embed_once"):
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    sf = re.search(r"sf([0-9.]+)", folder)
    line = {
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else None,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
