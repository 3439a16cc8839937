"""Time the headline queries and print one JSON line.

Tables come from ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1), cores from ``$BENCH_CPUS`` (default 8).
Names given on the command line run instead of the headline list.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusmill.plans.catalog import registry  # noqa: E402
from corpusmill.session import build_session  # noqa: E402

HEADLINE = (
    "chunk_fixed", "line_repair", "page_chunks", "legal_chunks", "cross_references", "hash_embedding",
    "bm25_topk", "fts_topk", "fts_topk_stemmed", "metadata_filter_topk", "dense_topk", "rrf_hybrid",
    "rerank_topk", "responses", "answer_scores", "eval_harness", "bench_questions", "pool_candidates",
    "run_rows_log", "kpi_headline", "kpi_all_groups", "agent_trace",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["chunk_fixed"](spark, folder).limit(1).count()  # start workers and load classes
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        # The noop sink computes every row and column without keeping them.
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
