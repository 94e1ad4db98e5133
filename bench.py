"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ampwise.plans.catalog import QUERIES  # noqa: E402
from ampwise.session import local_session  # noqa: E402

HEADLINE = [
    "status_events",
    "status_lines",
    "status_shaped",
    "candidates_over_months",
    "episode_headers",
    "episode_rows",
    "episode_summary",
    "blows_shaped",
    "overlay_traces",
    "synthetic_blows",
    "blow_mae",
    "fold_map",
    "sample_arrays",
    "health_scores",
    "score_quartiles",
    "threshold_sweep",
    "positive_curve",
    "map_report",
]


def run(spark, name: str, folder: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begun, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "ampwise-bench", os.environ.get("BENCH_MEMORY", "12g"))
    run(spark, "status_events", folder)  # start-up cost belongs to no query
    seconds = {name: run(spark, name, folder) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
