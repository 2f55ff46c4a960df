"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logquarry.plans.catalog import QUERIES  # noqa: E402
from logquarry.session import local_session  # noqa: E402

HEADLINE = [
    "line_profile",
    "token_types",
    "format_parse",
    "multiline_records",
    "tag_counts",
    "tag_threshold",
    "template_counts",
    "generic_templates",
    "json_templates",
    "storage_types",
    "round_trip",
    "round_trip_documents",
    "group_accuracy",
    "template_match",
    "number_columns",
    "partition_step4",
    "partition_templates",
    "word_candidates",
    "word_weights_1",
    "similarity_templates",
    "relation_scores",
    "header_formats",
    "event_vectors",
    "iterative_clusters",
    "spearman",
    "kendall_tau",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
