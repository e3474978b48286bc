"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query is run once
to warm up and then timed; the time covers building the plan and computing every output row.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticketloom.catalog import registry  # noqa: E402
from ticketloom.session import local_session  # noqa: E402

HEADLINE = (
    "reply_join", "brand_priorities", "funnel", "features", "document_features", "clean_pages",
    "document_dedup", "conversation_replies", "numeric_summary", "value_quartiles",
    "length_histogram", "firing_rates", "minmax_mean_gap", "ticket_split", "binary_metrics",
    "dense_numbers", "cosine_topk", "cell_topk_all", "upsert", "populate_tickets", "responses",
    "scope_guard", "comparison", "audit_rollup", "latency_quantiles", "stream_triage",
    "stream_dedup", "stream_counts", "train_compare",
)


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    chosen = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    queries = registry.queries()
    seconds = {}
    for name in chosen:
        if name != "train_compare":  # long enough to make warming up pointless
            timed(queries[name], spark, sf_dir)
        seconds[name] = round(timed(queries[name], spark, sf_dir), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
