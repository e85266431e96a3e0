"""Seconds per headline query, printed as one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores,
BENCH_QUERIES a comma-separated list to run instead of the default.
"""

from __future__ import annotations

import json
import os
import sys
import time

from quire.plans.registry import all_queries
from quire.session import local_session

HEADLINE = [
    "normalize_text", "chunk_recursive", "build_keyword_index", "keyword_search", "keyword_search_any",
    "semantic_search", "hybrid_search", "persona_sections", "budget_pack", "strategic_content",
    "pair_similarity", "pair_cosine", "similarity_stats", "outline", "outline_scores",
    "match_document_names", "stream_ingest", "connected_components",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cores, partitions=cores * 2, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").write.format("noop").mode("overwrite").save()
    queries, seconds = all_queries(), {}
    for name in names:
        start = time.perf_counter()
        queries[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cores": cores, "memory": "16g",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
