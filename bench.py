"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.registry import ALL  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = (
    "skill_stats market_totals top_employers salary_by_experience weekly_counts_events"
    " search_filtered posting_detail search_text text_match_phrase text_rank postings_df"
    " upsert_partial link_replace skill_dimension bisect_windows extract_text chunk_documents"
    " hash_embed cosine_topk knn_batch hybrid match_profiles ground_truth retrieval_metrics"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark__sql__shuffle__partitions": cpus, "spark__default__parallelism": cpus},
    )
    spark.sparkContext.setLogLevel("ERROR")
    ALL["market_totals"][0](spark, sf_dir).collect()  # start-up is not a query's time
    timed: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            ALL[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timed[name] = round(statistics.median(taken), 3)
        print(name, timed[name], file=sys.stderr, flush=True)
    total = round(sum(timed.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": timed,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
