"""Hybrid search (keyword leg + vector leg, merged) and the index build job.

``build_index`` is the ingest job: scan -> HTML to text -> chunks ->
embeddings -> the tables of a new version (``store``), committed as the next
generation (``versions``).  A version counts once it is committed, so a failed
rebuild leaves the former index readable and readers never see new chunks with
old postings.  ``read_index`` opens the newest generation.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.embed import hash_embed, hash_embed_tokens
from quarry.operators import versions
from quarry.operators.chunking import CHUNK_KEY, chunk_text
from quarry.operators.common import significant, sized, top_k_per_group
from quarry.operators.embedding import embed_distinct
from quarry.operators.keyword import KeywordIndex, bm25_match, rank_order, tokenize_chunks, with_snippets
from quarry.operators.store import Store, write_store
from quarry.operators.vector import knn
from quarry.sources.scans import to_text


@dataclass
class HybridIndex:
    """A keyword index whose tokenized chunks have an ``embedding``."""

    keyword: KeywordIndex

    @property
    def chunks(self) -> DataFrame:
        """CHUNK_KEY, content, n_tokens, embedding."""
        return self.keyword.tokenized.drop("tokens")


def embed_chunks(chunks: DataFrame, embed=None, dim: int = 64, model=None) -> DataFrame:
    """Add ``embedding``: ``embed(content_col) -> Column``, a caller's model
    (``load_model`` of ``model_embed``; each distinct text is embedded once), or
    the hash default (which reuses a ``tokens`` column when the chunks have one)."""
    if model is not None:
        return embed_distinct(chunks, model)
    if embed is None and "tokens" in chunks.columns:
        return chunks.withColumn("embedding", hash_embed_tokens("tokens", dim))
    fn = embed or (lambda c: hash_embed(c, dim))
    return chunks.withColumn("embedding", fn(F.col("content")))


def index_in_memory(chunks: DataFrame, embed=None, dim: int = 64) -> HybridIndex:
    """A lazy index over ``chunks``.  Both sides start from one tokenization,
    which the first search writes."""
    tok = embed_chunks(tokenize_chunks(chunks), embed, dim)
    return HybridIndex(KeywordIndex(chunks=tok.drop("tokens", "embedding"), tokenized=tok))


def build_index(docs: DataFrame, path: str, embed=None, dim: int = 64, html: bool = True,
                max_words: int = 300, overlap: int = 50, model=None) -> int:
    """Ingest ``docs(source, doc_id, html|text)`` into ``path`` as a new
    generation, which replaces the former one for readers once it is
    committed; returns its number."""
    spark = docs.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    text = to_text(docs) if html else docs
    chunks = tokenize_chunks(chunk_text(text, "text", max_words=max_words, overlap=overlap))
    entry = write_store(embed_chunks(chunks, embed, dim, model), f"{path}/{folder}")
    return versions.commit(spark, path, entry | {"folder": folder})


def read_index(spark: SparkSession, path: str) -> HybridIndex:
    entry = versions.newest(spark, path)
    return HybridIndex(Store(spark, f"{path}/{entry['folder']}", entry).index())


def _source_id() -> Column:
    return F.concat_ws(":", "source", "doc_id")


def hybrid_search(index: HybridIndex, queries: DataFrame, top_k: int = 5, overfetch: int = 2,
                  semantic_score: str = "distance", embed=None, dim: int = 64,
                  query_col: str = "query", id_col: str = "query_id") -> DataFrame:
    """Keyword hits (AND match, BM25, ``top_k * overfetch`` fetched, first
    ``top_k`` kept) plus the ``top_k`` nearest chunks, merged by score
    descending (ties: vector hits first, then by leg rank), cut to
    ``top_k``.  A ``top_k`` column of ``queries`` overrides it per query.

    ``semantic_score='distance'`` puts the raw squared distance next to the
    BM25 scores as the reference does (so the *farthest* of the nearest
    chunks rank first); ``'similarity'`` uses ``1 / (1 + distance)``.
    Snippet: the whole chunk for vector hits, the highlighted 5-token
    window for keyword hits.
    """
    if semantic_score not in ("distance", "similarity"):
        raise ValueError("semantic_score must be 'distance' or 'similarity'")
    per_query = "top_k" in queries.columns
    wanted = F.coalesce(F.col("top_k").cast("int"), F.lit(top_k)) if per_query else F.lit(top_k)
    q = sized(queries.select(F.col(id_col).alias("query_id"), F.col(query_col).alias("query"), wanted.alias("wanted")), "queries")
    most = (q.agg(F.max("wanted")).first()[0] or top_k) if per_query else top_k
    limit = q.select("query_id", "wanted")
    kw = bm25_match(index.keyword, q, "all")
    kw = top_k_per_group(kw, ["query_id"], rank_order(), most * overfetch, "leg_rank")
    kw = kw.where(F.col("leg_rank") <= most).select("query_id", *CHUNK_KEY, "score", "leg_rank",
                                                     F.lit(1).alias("leg"))
    index.keyword.kept()
    fn = embed or (lambda c: hash_embed(c, dim))
    qv = q.select("query_id", fn(F.col("query")).alias("vector"))
    sem = knn(index.chunks.select(*CHUNK_KEY, "embedding"), qv, most, CHUNK_KEY, rank_col="leg_rank")
    s = F.col("dist") if semantic_score == "distance" else 1.0 / (1.0 + F.col("dist"))
    sem = sem.select("query_id", *CHUNK_KEY, s.alias("score"), "leg_rank", F.lit(0).alias("leg"))
    both = kw.unionByName(sem).join(limit, "query_id").where(F.col("leg_rank") <= F.col("wanted"))
    order = [significant(F.col("score")).desc(), F.col("leg").asc(), F.col("leg_rank").asc()]
    ranked = top_k_per_group(both, ["query_id"], order, most).where(F.col("rank") <= F.col("wanted")).drop("wanted")
    # keyword hits carry the highlighted window, vector hits the whole chunk
    out = with_snippets(ranked, index.keyword, q, whole_when=F.col("leg") == 0)
    return out.select("query_id", "rank", "leg", _source_id().alias("source_id"), *CHUNK_KEY,
                      "snippet", "score")
