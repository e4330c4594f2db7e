"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Stored inputs (memory tables, the stored ranking) are written before the clock
starts, as they are in use; the queries that make them are timed on their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("OMP_NUM_THREADS", "1")

from turnstore.runtime import build_session  # noqa: E402
from workloads import derive as D  # noqa: E402
from workloads.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "ingest_messages", "build_memories", "assign_seq", "embed_memories", "ingest_exactly_once", "stream_ingest",
    "search_scores", "rank_memories", "fused_scores", "neighbour_window", "search_memories", "search_degraded",
    "order_raw_first", "budgeted_results", "diversity_cap", "parent_chunks", "bm25_scores", "rrf_fusion",
    "merge_rounds", "corpus_requests", "recall_at_k", "recall_by_category", "answer_sweep", "paired_flips",
    "replicate_majority",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    for build in (D.chat_memories, D.document_memories, D.retrieval, D.results, D.document_index):
        build(spark, sf)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf.rstrip("/").rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
