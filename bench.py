"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run to the end once, with its rows discarded by the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "daily_activity",
    "sessions",
    "session_counts",
    "daily_merged",
    "enriched_daily",
    "user_zscore",
    "dictionary_encode",
    "user_split",
    "scaled_features",
    "sliding_windows",
    "window_score",
    "threshold_metrics",
    "average_precision",
    "per_user_breakdown",
    "session_drilldown",
    "numeric_profile",
    "score_range",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from vigilume.session import local_session

    spark = local_session(cpus, name="vigilume-bench", memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    from vigilume.plans.registry import QUERIES

    chosen = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor
    seconds = {}
    for name in chosen:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
