"""Registered document-search queries over the test tables.

Index rows are the chunks of *all* documents (and pages where stated); query
sets are *all* ``benchmark`` passages.  Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import html_to_text, let, split_words, unicode61_tokens
from quarry.operators.chunking import CHUNK_KEY, chunk_text
from quarry.operators.keyword import (KeywordIndex, bm25_match, corpus_stats, keyword_hits, match_first, match_near,
                                      term_df, tokenize_chunks, top_k, with_snippets)
from quarry.operators.phrases import match_phrase
from quarry.operators.ranked import bm25_top
from quarry.operators.vocabulary import match_prefix
from quarry.plans.registry import (DOC_SOURCE_SQL, register, sql_chunks, sql_doc_tokens,
                                   sql_html_text, sql_significant, sql_token_rows, sql_tokens, sql_words)
from quarry.sources.scans import (combine_sources, issue_scan, page_scan, read_table, to_text)

TOP_K = 5
PREFIX_LEN = 4
SINGLE_QUERY = "the and"


# ------------------------------------------------------------ shared inputs

def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of every document; documents are plain text already."""
    docs = read_table(spark, sf, "documents", spread=True)
    src = docs.select(F.lit("doc").alias("source"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return chunk_text(src, "text")


def doc_index(spark: SparkSession, sf: str) -> KeywordIndex:
    return KeywordIndex.from_chunks(doc_chunks(spark, sf))


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage as a query ``(query_id, query)``."""
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"),
                                                      F.col("text").alias("query"))


SQL_PASSAGE_TERMS = f"""
  SELECT query_id, term, count(*) AS qtf, max(n_terms) AS n_terms FROM (
    SELECT item_id AS query_id, unnest(t) AS term, len(list_distinct(t)) AS n_terms
    FROM (SELECT item_id, {sql_tokens('text')} AS t FROM benchmark) b) u
  GROUP BY query_id, term"""


def _bm25_sql(qterms_sql: str, mode: str, k: int | None) -> str:
    having = "n_matched = n_terms" if mode == "all" else "n_matched >= 1"
    rank_sel = (f"CAST(row_number() OVER (PARTITION BY query_id ORDER BY {sql_significant('score')} DESC, "
                "source, doc_id, chunk_no) AS INTEGER) AS rank")
    body = f"""
WITH tok AS ({sql_doc_tokens()}),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
qterms AS ({qterms_sql}),
tr AS ({sql_token_rows()}),
post AS (SELECT term, source, doc_id, chunk_no, dl, count(*) AS tf FROM tr
         WHERE term IN (SELECT term FROM qterms) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (
  SELECT q.query_id, p.source, p.doc_id, p.chunk_no, max(q.n_terms) AS n_terms,
    sum((CASE WHEN ln((st.n - d.df + 0.5) / (d.df + 0.5)) <= 0 THEN 1e-6
              ELSE ln((st.n - d.df + 0.5) / (d.df + 0.5)) END)
        * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / st.avgdl)) * q.qtf) AS score,
    count(*) AS n_matched
  FROM post p JOIN qterms q ON p.term = q.term JOIN dfs d ON p.term = d.term, stats st
  GROUP BY q.query_id, p.source, p.doc_id, p.chunk_no),
m AS (SELECT query_id, source, doc_id, chunk_no, score, {rank_sel} FROM sc WHERE {having})"""
    if k is None:
        return body + "\nSELECT query_id, source, doc_id, chunk_no, round(score, 6) AS score FROM m"
    return body + f"""
SELECT query_id, rank, source || ':' || doc_id AS source_id, source, doc_id, chunk_no,
       round(score, 6) AS score FROM m WHERE rank <= {k}"""


# ------------------------------------------------------------ P1, P2

@register("html_to_words", f"""
SELECT page_id, CAST(len(w) AS INTEGER) AS n_words, array_to_string(w, ' ') AS words
FROM (SELECT page_id, {sql_words(sql_html_text('html'))} AS w FROM pages) p""")
def html_to_words(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages", spread=True)
    # one row per page, through a generator: both columns come from one parse
    row = let(split_words(html_to_text("html")), lambda w: F.struct(F.size(w).alias("n_words"), F.array_join(w, " ").alias("words")))
    return pages.select("page_id", F.inline(F.array(row)))


# ------------------------------------------------------------ P3

@register("chunk_documents", f"""
SELECT source, doc_id, chunk_no, content FROM ({sql_chunks(DOC_SOURCE_SQL)}) c""")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return doc_chunks(spark, sf)


# ------------------------------------------------------------ P4, P6, S1, S2

_COMBINED_SQL = f"""
SELECT source || ':' || doc_id AS source_id, source, doc_id, chunk_no, content FROM (
  {sql_chunks(f"SELECT 'issue' AS source, CAST(doc_id AS VARCHAR) AS doc_id, {sql_html_text("coalesce(text, '')")} AS text FROM documents")}
  UNION ALL
  {sql_chunks(f"SELECT 'page' AS source, CAST(page_id AS VARCHAR) AS doc_id, {sql_html_text("coalesce(html, '')")} AS text FROM pages")}
) u"""


@register("combine_sources", _COMBINED_SQL)
def combine_sources_q(spark: SparkSession, sf: str) -> DataFrame:
    issues = issue_scan(read_table(spark, sf, "documents", spread=True), key="doc_id", description="text",
                        source="issue")
    pages = page_scan(read_table(spark, sf, "pages", spread=True), key="page_id", body="html", source="page")
    chunks = chunk_text(to_text(combine_sources(issues, pages)), "text")
    return chunks.select(F.concat_ws(":", "source", "doc_id").alias("source_id"), *CHUNK_KEY, "content")


# ------------------------------------------------------------ X1, X2, X3

@register("tokenize_chunks", f"""
SELECT source, doc_id, chunk_no, CAST(len(tokens) AS INTEGER) AS n_tokens,
       array_to_string(tokens, ' ') AS tokens FROM ({sql_doc_tokens()}) t""")
def tokenize_chunks_q(spark: SparkSession, sf: str) -> DataFrame:
    t = tokenize_chunks(doc_chunks(spark, sf))
    return t.select(*CHUNK_KEY, "n_tokens", F.array_join("tokens", " ").alias("tokens"))


@register("term_postings", f"""
SELECT term, source, doc_id, chunk_no, dl, count(*) AS tf,
       array_to_string(list_sort(list(pos)), ',') AS positions
FROM ({sql_token_rows()}) r GROUP BY term, source, doc_id, chunk_no, dl""")
def term_postings(spark: SparkSession, sf: str) -> DataFrame:
    p = doc_index(spark, sf).postings()
    return p.select("term", *CHUNK_KEY, "dl", "tf", F.array_join("positions", ",").alias("positions"))


@register("corpus_stats", f"""
SELECT count(*) AS n_chunks, CAST(sum(len(tokens)) AS BIGINT) AS total_tokens,
       round(avg(len(tokens)), 6) AS avgdl FROM ({sql_doc_tokens()}) t""")
def corpus_stats_q(spark: SparkSession, sf: str) -> DataFrame:
    s = corpus_stats(doc_index(spark, sf))
    return s.select("n_chunks", "total_tokens", F.round("avgdl", 6).alias("avgdl"))


@register("term_df", f"""
SELECT term, count(DISTINCT (source, doc_id, chunk_no)) AS df FROM ({sql_token_rows()}) r GROUP BY term""")
def term_df_q(spark: SparkSession, sf: str) -> DataFrame:
    return term_df(doc_index(spark, sf))


# ------------------------------------------------------------ X4, X5, X10, X12, X13

@register("match_all", f"""
SELECT query_id, source, doc_id, chunk_no FROM ({_bm25_sql(SQL_PASSAGE_TERMS, 'all', None)}) x""")
def match_all(spark: SparkSession, sf: str) -> DataFrame:
    m = bm25_match(doc_index(spark, sf), passages(spark, sf), "all")
    return m.select("query_id", *CHUNK_KEY)


@register("match_any", f"""
SELECT query_id, source, doc_id, chunk_no, score FROM ({_bm25_sql(SQL_PASSAGE_TERMS, "any", TOP_K)}) x""")
def match_any(spark: SparkSession, sf: str) -> DataFrame:
    # ORDER BY rank LIMIT k, as the reference cuts every search
    m = bm25_top(doc_index(spark, sf), passages(spark, sf), TOP_K)
    return m.select("query_id", *CHUNK_KEY, F.round("score", 6).alias("score"))


NOT_TERMS = "the"


@register("match_none", f"""
WITH anyq AS ({_bm25_sql(SQL_PASSAGE_TERMS, 'any', None).replace("round(score, 6) AS score", "score")}),
bad AS (SELECT DISTINCT source, doc_id, chunk_no FROM ({sql_token_rows()}) r WHERE term = '{NOT_TERMS}')
SELECT query_id, source, doc_id, chunk_no, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {sql_significant('score')} DESC, source, doc_id, chunk_no) AS rank
  FROM anyq
  WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.source = anyq.source AND bad.doc_id = anyq.doc_id
                    AND bad.chunk_no = anyq.chunk_no)) x
WHERE rank <= {TOP_K}""")
def match_none(spark: SparkSession, sf: str) -> DataFrame:
    q = passages(spark, sf)
    excl = q.select("query_id", F.lit(NOT_TERMS).alias("query"))
    m = bm25_top(doc_index(spark, sf), q, TOP_K, exclude=excl)
    return m.select("query_id", *CHUNK_KEY, F.round("score", 6).alias("score"))


_TOK = r"[\p{L}\p{N}\p{Co}]"


def snippet_sql(hits: str) -> str:
    """DuckDB statement of the snippet rules (see quarry.functions.snippet) over
    ranked hits (query_id, rank, source_id, source, doc_id, chunk_no, score)."""
    return f"""
WITH b AS ({hits}),
c AS ({sql_chunks(DOC_SOURCE_SQL)}),
q AS (SELECT item_id AS query_id, list_distinct({sql_tokens('text')}) AS terms FROM benchmark),
p0 AS (SELECT b.*, c.content, q.terms,
              regexp_extract_all(c.content, '({_TOK}+|[^\\p{{L}}\\p{{N}}\\p{{Co}}]+)', 1) AS pc
       FROM b JOIN c ON b.source = c.source AND b.doc_id = c.doc_id AND b.chunk_no = c.chunk_no
       JOIN q ON q.query_id = b.query_id),
p1 AS (SELECT *, CASE WHEN len(pc) > 0 AND regexp_matches(pc[1], '^{_TOK}') THEN 0 ELSE 1 END AS off FROM p0),
p2 AS (SELECT *, CAST(floor((len(pc) - off + 1) / 2) AS INTEGER) AS nd FROM p1),
p3 AS (SELECT *, list_transform(range(nd), lambda i: strip_accents(lower(pc[2 * i + off + 1]))) AS tk FROM p2),
p4 AS (SELECT *, list_filter(range(nd), lambda i: list_contains(terms, tk[i + 1])) AS hp,
              list_filter(range(nd), lambda i: i = 0 OR
                          regexp_matches(coalesce(pc[2 * i + off], ''), '[.:][ \\t\\n\\r]+$')) AS st
       FROM p3),
p5 AS (SELECT *, list_filter(flatten(list_transform(hp, lambda p: [
          {{'s': 999 * len(list_distinct(list_transform(list_filter(hp, lambda h: h >= p AND h < p + 5),
                                                         lambda h: tk[h + 1])))
                 + len(list_filter(hp, lambda h: h >= p AND h < p + 5)),
            'st': greatest(CASE WHEN p - CAST(floor((5 - (list_max(list_filter(hp, lambda h: h >= p AND h < p + 5))
                                                           + 1 - p)) / 2) AS INTEGER) + 5 > nd
                                THEN nd - 5
                                ELSE p - CAST(floor((5 - (list_max(list_filter(hp, lambda h: h >= p AND h < p + 5))
                                                           + 1 - p)) / 2) AS INTEGER) END, 0)}},
          CASE WHEN nd > 5 AND list_max(list_filter(st, lambda x: x <= p)) < p THEN
          {{'s': 999 * len(list_distinct(list_transform(
                      list_filter(hp, lambda h: h >= list_max(list_filter(st, lambda x: x <= p))
                                        AND h < list_max(list_filter(st, lambda x: x <= p)) + 5),
                      lambda h: tk[h + 1])))
                 + len(list_filter(hp, lambda h: h >= list_max(list_filter(st, lambda x: x <= p))
                                        AND h < list_max(list_filter(st, lambda x: x <= p)) + 5))
                 + CASE WHEN list_max(list_filter(st, lambda x: x <= p)) = 0 THEN 120 ELSE 100 END,
            'st': list_max(list_filter(st, lambda x: x <= p))}} END])), lambda x: x IS NOT NULL) AS cands
       FROM p4),
p6 AS (SELECT *, coalesce(list_filter(cands, lambda x: x.s = list_max(list_transform(cands, lambda y: y.s)))[1].st,
                          0) AS start FROM p5),
p7 AS (SELECT *, start + 5 >= nd AS to_end,
              CASE WHEN start = 0 THEN 0 ELSE 2 * start + off END AS k0,
              CASE WHEN start + 5 >= nd THEN len(pc) - 1 ELSE 2 * (start + 4) + off END AS k1 FROM p6)
SELECT query_id, rank, source_id, source, doc_id, chunk_no, score,
  CASE WHEN start > 0 THEN '...' ELSE '' END
  || array_to_string(list_transform(range(k0, greatest(k1, k0) + 1), lambda k:
       CASE WHEN k >= off AND (k - off) % 2 = 0 AND list_contains(hp, (k - off) // 2)
            THEN '[' || pc[k + 1] || ']' ELSE pc[k + 1] END), '')
  || CASE WHEN to_end THEN '' ELSE '...' END AS snippet
FROM p7"""


@register("snippet", snippet_sql(_bm25_sql(SQL_PASSAGE_TERMS, "all", TOP_K)))
def snippet_q(spark: SparkSession, sf: str) -> DataFrame:
    """Top-5 BM25 hits per passage with their highlighted 5-token snippet
    (also checked against SQLite FTS5 in tests)."""
    idx = doc_index(spark, sf)
    q = passages(spark, sf)
    hits = keyword_hits(top_k(bm25_match(idx, q, "all"), TOP_K))
    return with_snippets(hits, idx, q).withColumn("score", F.round("score", 6))


@register("bm25_batch", _bm25_sql(SQL_PASSAGE_TERMS, "all", TOP_K))
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    hits = top_k(bm25_match(doc_index(spark, sf), passages(spark, sf), "all"), TOP_K)
    return keyword_hits(hits).withColumn("score", F.round("score", 6))


_SINGLE_TERMS_SQL = f"""
  SELECT 0::BIGINT AS query_id, term, count(*) AS qtf, max(n_terms) AS n_terms FROM (
    SELECT unnest(t) AS term, len(list_distinct(t)) AS n_terms
    FROM (SELECT {sql_tokens(repr(SINGLE_QUERY))} AS t) b) u GROUP BY term"""


@register("bm25_topk", _bm25_sql(_SINGLE_TERMS_SQL, "all", TOP_K))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = spark.range(1).select(F.lit(0).cast("bigint").alias("query_id"), F.lit(SINGLE_QUERY).alias("query"))
    m = bm25_match(doc_index(spark, sf), q, "all")
    # one query: a global ORDER BY ... LIMIT (TakeOrderedAndProject)
    from quarry.operators.keyword import rank_order
    best = m.orderBy(*rank_order()).limit(TOP_K)
    ranked = top_k(best, TOP_K)
    return keyword_hits(ranked).withColumn("score", F.round("score", 6))


# ------------------------------------------------------------ X6 - X9

_PASSAGE_TOKENS_SQL = f"SELECT item_id AS query_id, {sql_tokens('text')} AS ph FROM benchmark"


@register("match_phrase", f"""
WITH q AS ({_PASSAGE_TOKENS_SQL}), tok AS ({sql_doc_tokens()}), tr AS ({sql_token_rows()})
SELECT DISTINCT q.query_id, tr.source, tr.doc_id, tr.chunk_no
FROM q JOIN tr ON tr.term = q.ph[1]
JOIN tok ON tok.source = tr.source AND tok.doc_id = tr.doc_id AND tok.chunk_no = tr.chunk_no
WHERE len(q.ph) > 0 AND tok.tokens[tr.pos + 1 : tr.pos + len(q.ph)] = q.ph""")
def match_phrase_q(spark: SparkSession, sf: str) -> DataFrame:
    return match_phrase(doc_index(spark, sf), passages(spark, sf))


#: A passage's tokens are wanted within twice its length.
NEAR_FACTOR = 2


@register("match_near", f"""
WITH q AS (SELECT query_id, len(ph) * {NEAR_FACTOR} + 1 AS span, unnest(list_distinct(ph)) AS term, len(list_distinct(ph)) AS n
           FROM ({_PASSAGE_TOKENS_SQL}) x),
tr AS ({sql_token_rows()}),
hit AS (SELECT q.query_id, q.span, q.n, q.term, tr.source, tr.doc_id, tr.chunk_no, tr.pos FROM q JOIN tr ON tr.term = q.term),
held AS (SELECT query_id, source, doc_id, chunk_no FROM hit GROUP BY query_id, source, doc_id, chunk_no
         HAVING count(DISTINCT term) = max(n)),
h AS (SELECT hit.* FROM hit JOIN held USING (query_id, source, doc_id, chunk_no))
SELECT DISTINCT query_id, source, doc_id, chunk_no FROM (
  SELECT a.query_id, a.source, a.doc_id, a.chunk_no, a.pos FROM h a JOIN h b
    ON a.query_id = b.query_id AND a.source = b.source AND a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no
   AND b.pos BETWEEN a.pos AND a.pos + a.span
  GROUP BY a.query_id, a.source, a.doc_id, a.chunk_no, a.pos HAVING count(DISTINCT b.term) = max(a.n)) w""")
def match_near_q(spark: SparkSession, sf: str) -> DataFrame:
    """All tokens of each passage, near one another."""
    q = passages(spark, sf).withColumn("distance", F.size(unicode61_tokens("query")) * NEAR_FACTOR)
    return match_near(doc_index(spark, sf), q, "distance")


@register("match_first", f"""
WITH q AS (SELECT query_id, ph[1] AS a FROM ({_PASSAGE_TOKENS_SQL}) x WHERE len(ph) > 0),
tr AS ({sql_token_rows()})
SELECT DISTINCT q.query_id, tr.source, tr.doc_id, tr.chunk_no
FROM q JOIN tr ON tr.term = q.a AND tr.pos = 0""")
def match_first_q(spark: SparkSession, sf: str) -> DataFrame:
    t = unicode61_tokens("query")
    q = passages(spark, sf).where(F.size(t) > 0).select("query_id", t[0].alias("query"))
    return match_first(doc_index(spark, sf), q)


@register("match_prefix", f"""
WITH q AS (SELECT query_id, unnest(list_distinct(list_transform(ph, lambda t: t[1:{PREFIX_LEN}]))) AS pfx
           FROM ({_PASSAGE_TOKENS_SQL}) x),
nq AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
tr AS ({sql_token_rows()}),
hit AS (SELECT DISTINCT q.query_id, q.pfx, tr.source, tr.doc_id, tr.chunk_no
        FROM q JOIN tr ON starts_with(tr.term, q.pfx))
SELECT h.query_id, h.source, h.doc_id, h.chunk_no FROM hit h JOIN nq USING (query_id)
GROUP BY h.query_id, h.source, h.doc_id, h.chunk_no HAVING count(*) = max(nq.n)""")
def match_prefix_q(spark: SparkSession, sf: str) -> DataFrame:
    t = unicode61_tokens("query")
    q = passages(spark, sf).select("query_id", F.array_distinct(
        F.transform(t, lambda x: F.substring(x, 1, PREFIX_LEN))).alias("prefixes"))
    return match_prefix(doc_index(spark, sf), q)
