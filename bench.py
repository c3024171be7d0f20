"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores. Every query
is timed once, with its plan built and its rows counted; stored intermediates
(the index, the candidate list) are built by the queries named ``build_*``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from folioscope.catalog import load
from folioscope.catalog import lexical as lexical_catalog
from folioscope.catalog import ranking as ranking_catalog
from folioscope.catalog.registry import QUERIES
from folioscope.session import local_session

HEADLINE = [
    "clean_full_chain",
    "chunk_fixed",
    "chunk_sentence",
    "chunk_recursive",
    "page_headings",
    "forward_fill",
    "chapter_boundaries",
    "asof_chapter",
    "tokenize_terms",
    "build_index",
    "bm25_topk",
    "bm25_topk_by_subject",
    "bm25_topk_no_filter",
    "knn_l2_topk",
    "knn_filtered",
    "knn_approximate",
    "rrf_fusion",
    "build_candidates",
    "hybrid_topk",
    "rerank_overlap",
    "prompt_choice",
    "paper_valid_questions",
    "table_row_facts",
    "latency_summary",
    "accuracy_by_subject",
    "failure_stage",
    "collection_upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    load()
    builders = {"build_index": lexical_catalog.index, "build_candidates": ranking_catalog.candidates}
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        if name in builders:
            builders[name](spark, sf_dir)
        else:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
