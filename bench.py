"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from keyweave import build_session
from keyweave.session import intermediates
from workloads import QUERIES

# One query per kind of work; `python bench.py all` times every registered query.
HEADLINE = (
    "job_run_spec",
    "agg_by_key",
    "agg_sum",
    "join_inner3",
    "join_left4",
    "srt_limit",
    "srt_topk_per_group",
    "set_intersect",
    "qua_dropped_detail",
    "key_emd",
    "pro_column_profile",
    "pro_role_values",
    "gra_best_key",
    "gra_pairs",
    "gra_joinable_sets",
    "gra_link_check",
    "sea_tokens",
    "sea_bm25",
    "sea_cosine",
    "sea_hybrid",
    "sea_multi",
    "src_find_records",
    "src_assemble_pages",
    "src_page_metadata",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    names = list(QUERIES) if sys.argv[1:] == ["all"] else sys.argv[1:] or list(HEADLINE)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        with intermediates(spark):
            start = time.perf_counter()
            # every row is produced, nothing is sent to the driver
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
