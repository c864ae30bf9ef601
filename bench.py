"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) names the input, ``BENCH_CPUS`` (default 8) the
local cores. Each query runs once to warm up code and file caches and is then timed once; the result
is consumed by a no-op sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parley.plans.queries import all_queries  # noqa: E402
from parley.session import build_session  # noqa: E402

HEADLINE = [
    "conv_features",
    "ingest_stats",
    "quality_score",
    "quality_issues",
    "duplicate_marks",
    "dedup_conversations",
    "dataset_profile",
    "distinct_responses",
    "json_output_flag",
    "column_validation",
    "dataset_gate",
    "sample_page",
    "positional_sample",
    "recommend_primary",
    "training_manifest",
    "add_system_prompt",
    "render_chat",
    "prompt_expected_pairs",
    "generation_context",
    "containment_accuracy",
    "token_budget",
    "jsonl_scan",
    "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
