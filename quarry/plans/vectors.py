"""Registered vector, embedding, hybrid and index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import api
from quarry.functions.embed import hash_embed
from quarry.operators.chunking import CHUNK_KEY
from quarry.operators.common import sized
from quarry.operators.hybrid import build_index, hybrid_search, index_in_memory, read_index
from quarry.operators.vector import knn
from quarry.plans.registry import register, sql_doc_tokens, sql_significant, sql_tokens
from quarry.plans.search import SQL_PASSAGE_TERMS, TOP_K, _bm25_sql, doc_chunks, passages, snippet_sql
from quarry.session import scratch_path
from quarry.sources.scans import read_table

DIM = 64

_SQL_DIST = ("list_sum(list_transform(list_zip({a}, {b}), "
             "lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))")


def _sql_bucket(tok: str) -> str:
    return f"CAST(('0x' || substr(md5({tok}), 1, 6))::BIGINT % {DIM} AS INTEGER)"


# ------------------------------------------------------------ P5

@register("hash_embed", f"""
WITH t AS (SELECT item_id, unnest({sql_tokens('text')}) AS tok FROM benchmark),
c AS (SELECT item_id, {_sql_bucket('tok')} AS bucket, count(*) AS cnt FROM t GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(cnt * cnt)) AS nrm FROM c GROUP BY item_id)
SELECT item_id, bucket, round(CAST(CAST(cnt / nrm AS FLOAT) AS DOUBLE), 6) AS weight
FROM c JOIN n USING (item_id)""")
def hash_embed_q(spark: SparkSession, sf: str) -> DataFrame:
    b = read_table(spark, sf, "benchmark")
    v = b.select("item_id", F.posexplode(hash_embed("text", DIM)).alias("bucket", "w"))
    return v.where(F.col("w") != 0).select("item_id", "bucket",
                                           F.round(F.col("w").cast("double"), 6).alias("weight"))


# ------------------------------------------------------------ V1 - V5

@register("vector_batch", f"""
WITH d AS (SELECT q.vec_id AS query_id, x.vec_id, {_SQL_DIST.format(a='q.embedding', b='x.embedding')} AS dist
           FROM embeddings q, embeddings x),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {sql_significant('dist')}, vec_id) AS INTEGER)
        AS rank FROM d)
SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM r WHERE rank <= {TOP_K}""")
def vector_batch(spark: SparkSession, sf: str) -> DataFrame:
    emb = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    r = knn(emb, q, TOP_K, ["vec_id"])
    return r.select("query_id", "rank", "vec_id", F.round("dist", 6).alias("dist"))


@register("vector_topk", f"""
WITH d AS (SELECT vec_id, list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)) AS dist
           FROM embeddings),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY {sql_significant('dist')}, vec_id) AS INTEGER) AS rank FROM d)
SELECT 0::BIGINT AS query_id, rank, vec_id, round(dist, 6) AS dist FROM r WHERE rank <= {TOP_K}""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """One query, the origin of the table's vector space."""
    emb = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    dim = emb.agg(F.max(F.size("embedding")).alias("d"))
    q = dim.select(F.lit(0).cast("bigint").alias("query_id"),
                   F.array_repeat(F.lit(0.0), F.col("d")).alias("vector"))
    r = knn(emb, q, TOP_K, ["vec_id"])
    return r.select("query_id", "rank", "vec_id", F.round("dist", 6).alias("dist"))


# ------------------------------------------------------------ H1 - H5

def _hybrid_sql(mode: str, wanted: str = f"SELECT item_id AS query_id, {TOP_K} AS wanted FROM benchmark", most: int = TOP_K) -> str:
    """``wanted``: the number of hits of each query, ``most`` at most."""
    score = "dist" if mode == "distance" else "1.0 / (1.0 + dist)"
    kw = _bm25_sql(SQL_PASSAGE_TERMS, "all", most * 2).replace("round(score, 6) AS score", "score")
    snippets = snippet_sql("SELECT query_id, leg_rank AS rank, source || ':' || doc_id AS source_id, source, doc_id, chunk_no, score FROM kw")
    return f"""
WITH kwr AS ({kw}), wanted AS ({wanted}),
kw AS (SELECT query_id, source, doc_id, chunk_no, score, rank AS leg_rank, 1 AS leg FROM kwr JOIN wanted USING (query_id)
       WHERE rank <= wanted),
tok AS ({sql_doc_tokens()}),
hv AS (SELECT source, doc_id, chunk_no, {_sql_bucket('t')} AS bucket, count(*) AS cnt
       FROM (SELECT source, doc_id, chunk_no, unnest(tokens) AS t FROM tok) u GROUP BY ALL),
hn AS (SELECT source, doc_id, chunk_no, sqrt(sum(cnt * cnt)) AS nrm FROM hv GROUP BY ALL),
cv AS (SELECT k.source, k.doc_id, k.chunk_no,
              list(coalesce(CAST(CAST(hv.cnt / hn.nrm AS FLOAT) AS DOUBLE), 0.0) ORDER BY b.bucket) AS vec
       FROM tok k CROSS JOIN range({DIM}) b(bucket)
       LEFT JOIN hv ON hv.source = k.source AND hv.doc_id = k.doc_id AND hv.chunk_no = k.chunk_no
                   AND hv.bucket = b.bucket
       LEFT JOIN hn ON hn.source = k.source AND hn.doc_id = k.doc_id AND hn.chunk_no = k.chunk_no
       GROUP BY k.source, k.doc_id, k.chunk_no),
qt AS (SELECT item_id AS query_id, {sql_tokens('text')} AS tokens FROM benchmark),
qh AS (SELECT query_id, {_sql_bucket('t')} AS bucket, count(*) AS cnt
       FROM (SELECT query_id, unnest(tokens) AS t FROM qt) u GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(cnt * cnt)) AS nrm FROM qh GROUP BY ALL),
qv AS (SELECT q.query_id,
              list(coalesce(CAST(CAST(qh.cnt / qn.nrm AS FLOAT) AS DOUBLE), 0.0) ORDER BY b.bucket) AS vec
       FROM qt q CROSS JOIN range({DIM}) b(bucket)
       LEFT JOIN qh ON qh.query_id = q.query_id AND qh.bucket = b.bucket
       LEFT JOIN qn ON qn.query_id = q.query_id
       GROUP BY q.query_id),
d AS (SELECT qv.query_id, cv.source, cv.doc_id, cv.chunk_no, {_SQL_DIST.format(a='qv.vec', b='cv.vec')} AS dist
      FROM qv, cv),
semr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {sql_significant('dist')}, source, doc_id, chunk_no)
           AS leg_rank FROM d),
sem AS (SELECT query_id, source, doc_id, chunk_no, {score} AS score, leg_rank, 0 AS leg FROM semr JOIN wanted USING (query_id)
        WHERE leg_rank <= wanted),
both_legs AS (SELECT * FROM kw UNION ALL SELECT * FROM sem),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {sql_significant('score')} DESC, leg, leg_rank)
        AS INTEGER) AS rank FROM both_legs),
sn AS ({snippets})
SELECT r.query_id, r.rank, r.leg, r.source || ':' || r.doc_id AS source_id, r.source, r.doc_id, r.chunk_no,
       CASE WHEN r.leg = 0 THEN tok.content ELSE sn.snippet END AS snippet, round(r.score, 6) AS score
FROM r JOIN wanted USING (query_id)
JOIN tok ON tok.source = r.source AND tok.doc_id = r.doc_id AND tok.chunk_no = r.chunk_no
LEFT JOIN sn ON r.leg = 1 AND sn.query_id = r.query_id AND sn.source = r.source AND sn.doc_id = r.doc_id AND sn.chunk_no = r.chunk_no
WHERE r.rank <= wanted"""


def _hybrid(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    idx = index_in_memory(doc_chunks(spark, sf), dim=DIM)
    h = hybrid_search(idx, passages(spark, sf), TOP_K, semantic_score=mode, dim=DIM)
    return h.withColumn("score", F.round("score", 6))


@register("hybrid_distance", _hybrid_sql("distance"))
def hybrid_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, "distance")


@register("hybrid_similarity", _hybrid_sql("similarity"))
def hybrid_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, "similarity")


#: Hits asked for by each passage: its id modulo 4, the default where that is 0.
_WANTED_SQL = f"SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN {TOP_K} ELSE item_id % 4 END AS wanted FROM benchmark"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", spread=True).select(
        F.lit("doc").alias("source"), F.col("doc_id").cast("string").alias("doc_id"), "text")


@register("hybrid_nested", f"""
SELECT query_id, count(*) AS n_hits, string_agg(source_id, ',' ORDER BY rank) AS source_ids,
       string_agg(snippet, chr(10) ORDER BY rank) AS snippets, max(score) AS best_score
FROM ({_hybrid_sql("similarity", _WANTED_SQL)}) x GROUP BY query_id""")
def hybrid_nested(spark: SparkSession, sf: str) -> DataFrame:
    """The nested answer of the two calls in ``api``: a stored index, queries
    with a ``top_k`` of their own (null: the default)."""
    path = scratch_path(spark, "index")
    build_index(_documents(spark, sf), path, dim=DIM, html=False)
    wanted = F.nullif(F.col("query_id") % 4, F.lit(0)).cast("int")
    hits = api.query(spark, path, passages(spark, sf).withColumn("top_k", wanted), TOP_K, "similarity", dim=DIM)
    answer = api.nested(hits.withColumn("score", F.round("score", 6)))
    every = lambda field: F.transform("hits", lambda h: h[field])
    return answer.select("query_id", F.size("hits").cast("bigint").alias("n_hits"), F.array_join(every("source_id"), ",").alias("source_ids"),
                         F.array_join(every("snippet"), "\n").alias("snippets"), F.array_max(every("score")).alias("best_score"))


# ------------------------------------------------------------ H6, K1, K2

@register("index_roundtrip", f"""
WITH t AS ({sql_doc_tokens()}),
u AS (SELECT DISTINCT source, doc_id, chunk_no, unnest(tokens) AS term FROM t),
d AS (SELECT term, count(*) AS df FROM u GROUP BY term),
s AS (SELECT source, doc_id, chunk_no, CAST(sum(df) AS BIGINT) AS sum_df FROM u JOIN d USING (term) GROUP BY ALL),
f AS (SELECT term FROM d WHERE df * 20 > (SELECT count(*) FROM t)),
p AS (SELECT source, doc_id, chunk_no, count(*) AS n_pairs
      FROM (SELECT source, doc_id, chunk_no, tokens, unnest(range(1, len(tokens))) AS i FROM t) x
      WHERE tokens[i] IN (SELECT term FROM f) AND tokens[i + 1] IN (SELECT term FROM f) GROUP BY ALL)
SELECT t.source, t.doc_id, t.chunk_no, CAST(len(tokens) AS INTEGER) AS n_tokens,
       len(list_distinct(tokens)) AS n_terms, CAST(len(tokens) AS BIGINT) AS sum_tf,
       coalesce(sum_df, 0) AS sum_df, coalesce(n_pairs, 0) AS n_pairs, {DIM} AS dim
FROM t LEFT JOIN s USING (source, doc_id, chunk_no) LEFT JOIN p USING (source, doc_id, chunk_no)""")
def index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Build the index into the shared scratch folder, read it back, and
    report per chunk what the two sides hold."""
    path = scratch_path(spark, "index")
    build_index(_documents(spark, sf), path, dim=DIM, html=False)
    idx = read_index(spark, path)
    store = idx.keyword.store
    postings = store.table("postings")
    # every term's stored frequency is read through the vocabulary's ranges
    df = idx.keyword.df_for(sized(postings.select("term").distinct(), "terms"))
    per = postings.join(df, "term").groupBy(*CHUNK_KEY).agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("sum_tf"), F.sum("df").alias("sum_df"))
    pairs = store.table("pairs").groupBy(*CHUNK_KEY).agg(F.sum("tf").alias("n_pairs"))
    c = idx.chunks.select(*CHUNK_KEY, "n_tokens", F.size("embedding").alias("dim"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (c.join(per, CHUNK_KEY, "left").join(pairs, CHUNK_KEY, "left")
             .select(*CHUNK_KEY, "n_tokens", none("n_terms"), none("sum_tf"), none("sum_df"), none("n_pairs"), "dim"))
