"""Seconds per headline query: one warm-up, then the median of three runs.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docloom import registry  # noqa: E402
from docloom.session import build_session, drop_work, work_folder  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "documents_to_lines",
    "extract_items",
    "count_items",
    "order_by_type",
    "strip_html",
    "clean_text",
    "readability",
    "build_vocab",
    "encode_tokens",
    "make_dataset",
    "pad_batch",
    "train_test_split",
    "chunk_documents",
    "chunk_fixed",
    "number_chunks",
    "knn_join",
    "knn_join_global",
    "rerank_topn",
    "build_context",
    "tfidf_cosine",
    "consistency",
    "score_answers",
    "score_answers_hosted",
    "tokens_per_second",
    "early_stop_step",
    "upsert_chunks",
    "write_jsonl",
    "read_token_jsonl",
    "retrieve_prompt",
    "populate_chunks",
)


def _spread(spark) -> str:
    """The driver's tables in one file per core: theirs hold one row group, so one task would read each."""
    folder = work_folder(spark, "tables")
    for table in sorted(t for t in os.listdir(SF_DIR) if t.endswith(".parquet")):
        spark.read.parquet(f"{SF_DIR}/{table}").repartition(int(CPUS)).write.parquet(f"{folder}/{table}")
    return folder


def main() -> None:
    # plan building is measured too; skip PySpark's call site capture for it
    spark = build_session("bench", cpus=CPUS, **{"spark.python.sql.dataFrameDebugging.enabled": "false"})
    queries = registry.queries()
    folder = _spread(spark)
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    drop_work(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
