"""The two calls a user of the reference makes, as Spark jobs.

* ``ingest`` - scan issue and page exports, convert HTML to text, chunk,
  embed and (re)build the index at ``path`` (one overwrite, re-runnable).
* ``query``  - hybrid search for one query text or a frame of queries,
  returning hits ``(query_id, rank, source_id, snippet, score)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.hybrid import build_index, hybrid_search, read_index
from quarry.sources.scans import combine_sources, issue_scan, page_scan

TOP_K = 5

# The source tags that prefix every hit's ``source_id``
# (``<tag>:<id>``), as in the reference: issues -> "jira", pages -> "confluence".
ISSUE_SOURCE = "jira"
PAGE_SOURCE = "confluence"


def ingest(path: str, issues: DataFrame | None = None, pages: DataFrame | None = None,
           issue_filter: Column | None = None, page_filter: Column | None = None,
           embed=None, dim: int = 64) -> None:
    """Index landed issue exports (``key``, ``fields.description``) and page
    exports (``id``, ``body.storage.value``) into ``path``."""
    frames = []
    if issues is not None:
        frames.append(issue_scan(issues, source=ISSUE_SOURCE, where=issue_filter))
    if pages is not None:
        frames.append(page_scan(pages, source=PAGE_SOURCE, where=page_filter))
    if not frames:
        raise ValueError("nothing to ingest")
    build_index(combine_sources(*frames), path, embed=embed, dim=dim, html=True)


def query(spark: SparkSession, path: str, queries: str | DataFrame, top_k: int = TOP_K,
          semantic_score: str = "distance", embed=None, dim: int = 64) -> DataFrame:
    """Hybrid hits for one query string (``query_id`` 0) or a
    ``(query_id, query[, top_k])`` frame, best first within each query; a
    ``top_k`` column overrides the parameter where it is not null."""
    if isinstance(queries, str):
        queries = spark.range(1).select(F.lit(0).cast("bigint").alias("query_id"),
                                        F.lit(queries).alias("query"))
    hits = hybrid_search(read_index(spark, path), queries, top_k, semantic_score=semantic_score,
                         embed=embed, dim=dim)
    return hits.select("query_id", "rank", "source_id", "snippet", "score")


def nested(hits: DataFrame) -> DataFrame:
    """One row per query: ``query_id, hits array<struct<source_id, snippet,
    score>>`` in rank order (at most ``top_k`` each)."""
    one = F.struct("rank", "source_id", "snippet", "score")
    ordered = F.array_sort(F.collect_list(one))
    return hits.groupBy("query_id").agg(F.transform(ordered, lambda h: F.struct(
        h["source_id"].alias("source_id"), h["snippet"].alias("snippet"), h["score"].alias("score"))).alias("hits"))
