"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local session (default all)
BENCH_QUERIES  comma-separated names, or `all`
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larkspan.registry import Tables, load_all  # noqa: E402
from larkspan.session import build_session  # noqa: E402

HEADLINE = [
    # catalogue: filter, facets, merge, sort, freshness
    "facet_counts", "search_filter_items", "saved_filter", "merge_feeds", "sort_events_stable", "freshest", "read_ttl_docs",
    # files: matching, retention, clean-up
    "match_files", "match_files_contains", "best_match", "evict_plan", "restore_plan",
    # books: contents, offset, tiers, parts
    "toc_entries", "vote_offset", "fallback_tiers", "resplit_oversized", "greedy_pack",
    # quality and transcripts
    "cer", "region_density", "gap_nearest_centre", "validate_text", "apply_terms",
    # sequences
    "drop_repeats", "drop_recent_repeats", "recent_distinct", "dedupe_active_jobs", "last_purchase_as_of",
    # graph and scene
    "degree", "connected_components", "communities", "proximity_anti", "upsert_by_id", "apply_changes",
    # streams
    "current_state", "active_requests",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "*"), partitions=os.cpu_count() or 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(registry) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    tables = Tables(spark, folder)
    registry["jobs_by_status"].run(tables).write.format("noop").mode("overwrite").save()  # start the session
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry[name].run(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_query_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
