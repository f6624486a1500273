"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tastegrid.queries import QUERIES  # noqa: E402
from tastegrid.sources.session import build_session  # noqa: E402

HEADLINE = [
    "popular_items",
    "rating_stats",
    "rating_moments",
    "activity_summary",
    "genre_stats",
    "data_quality",
    "temporal_features",
    "split_stratified",
    "filter_cold_users",
    "baseline_comparison",
    "popularity_quantile",
    "popular_for_users",
    "genre_based_topn",
    "route_cold_start",
    "route_service_cold",
    "hybrid_topn",
    "ranking_report",
    "diversity",
    "similar_by_genre",
    "similar_by_vector",
    "factor_metrics",
    "als_metrics",
    "factor_recommend",
    "tier_counts_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    shared = tempfile.mkdtemp(prefix="tastegrid-")  # one machine, so a local folder is shared
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=shared,
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["rating_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.monotonic() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
