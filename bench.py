"""Benchmark the headline jobs and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=4 python bench.py

Each job's full result is written to the ``noop`` sink (so every row is
computed, nothing is collected).  One warm-up run, then the median of
``BENCH_RUNS`` (default 5) timed runs.  The value is the sum of the medians;
once, outside the timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quarry.operators.hybrid import build_index, hybrid_search, read_index  # noqa: E402
from quarry.plans import catalog  # noqa: E402,F401
from quarry.plans.registry import QUERIES  # noqa: E402
from quarry.session import get_session, scratch_path  # noqa: E402
from quarry.sources.scans import read_table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINE = ["chunk_documents", "html_to_words", "bm25_batch", "vector_batch", "deal_tranches",
            "hybrid_similarity"]


def _sf(path: str) -> float | str:
    base = os.path.basename(path.rstrip("/"))
    try:
        return float(base.replace("sf", ""))
    except ValueError:
        return base


def timed(fn) -> float:
    fn()
    times = []
    for _ in range(RUNS):
        t0 = time.perf_counter()
        fn()
        times.append(time.perf_counter() - t0)
    return statistics.median(times)


def main() -> None:
    spark = get_session(shuffle_partitions=int(os.environ.get("BENCH_CPUS", "8")) * 2)
    results = {}
    for name in HEADLINE:
        results[name] = round(timed(lambda n=name: QUERIES[n](spark, SF_DIR).write.format("noop")
                                    .mode("overwrite").save()), 3)

    # single hybrid query against an index on disk (built once, untimed)
    path = scratch_path(spark, "bench-index")
    docs = read_table(spark, SF_DIR, "documents", spread=True).select(
        F.lit("doc").alias("source"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    t0 = time.perf_counter()
    build_index(docs, path, html=False)
    results["build_index"] = round(time.perf_counter() - t0, 3)
    idx = read_index(spark, path)
    q = spark.range(1).select(F.lit(0).cast("bigint").alias("query_id"),
                              F.lit("the quick reference of the index").alias("query"))
    results["hybrid_single_on_disk"] = round(timed(
        lambda: hybrid_search(idx, q, 5, semantic_score="similarity").write.format("noop")
        .mode("overwrite").save()), 3)

    n_chunks = QUERIES["chunk_documents"](spark, SF_DIR).count()
    n_pages = read_table(spark, SF_DIR, "pages").count()
    n_queries = read_table(spark, SF_DIR, "benchmark").count()
    n_vec = read_table(spark, SF_DIR, "embeddings").count()
    n_tranches = read_table(spark, SF_DIR, "lineitem").count()

    def rate(n, sec):
        return round(n / sec, 1) if sec else None
    rates = {
        "build_index_chunks_per_s": rate(n_chunks, results["build_index"]),
        "html_to_words_pages_per_s": rate(n_pages, results["html_to_words"]),
        "bm25_batch_queries_per_s": rate(n_queries, results["bm25_batch"]),
        "vector_batch_pairs_per_s": rate(n_vec * n_vec, results["vector_batch"]),
        "deal_tranches_per_s": rate(n_tranches, results["deal_tranches"]),
    }
    print(json.dumps({"metric": "sum_of_median_job_seconds", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": _sf(SF_DIR), "rates": rates}))


if __name__ == "__main__":
    main()
