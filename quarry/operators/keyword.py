"""Keyword index and search: postings, corpus statistics, BM25, match forms.

Layout of an index (all ordinary DataFrames / tables):

* ``chunks``   - ``source, doc_id, chunk_no, content, n_tokens``
* ``postings`` - ``term, source, doc_id, chunk_no, dl, tf, positions``
  (one row per term and chunk; ``positions`` is bounded by the chunk length)
* ``term_df``  - ``term, df``: chunks that hold a term
* statistics   - ``N`` = number of chunks, ``avgdl`` = mean tokens per chunk

A chunk's postings are made inside its Arrow batch, so no token is ever
shuffled.  A search over a lazy index writes the tokenized chunks once and
takes everything from there; a ranked OR search writes its terms' postings only.  Stored indexes (``quarry.operators.store``) lay
the same rows out by term bucket; a lookup opens the buckets of its terms only.

A search writes its query terms (``sized``), so the planner knows their size
and decides itself whether to broadcast them; beyond that the joins shuffle,
with adaptive skew splitting for frequent terms.  AND queries start from each
query's rarest term; ranked OR queries are in ``quarry.operators.ranked``,
prefixes in ``vocabulary``, phrases in ``phrases``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import let, unicode61_tokens
from quarry.operators.chunking import CHUNK_KEY
from quarry.operators.common import significant, sized, top_k_per_group

if TYPE_CHECKING:
    from quarry.operators.store import Store

K1 = 1.2
B = 0.75
# FTS5 floors a non-positive idf at this value.
IDF_FLOOR = 1e-6
#: Chunks of a slice (see ``ranked``), and slices at most.
SLICE_CHUNKS, MAX_SLICES = 4096, 4096
#: Stands for the chunk itself among its postings; no term is empty.
NO_TERM = ""
#: Chunks whose postings a Python worker holds at once.
PIECE_ROWS = 512

# worker-side code travels by value: workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def slice_count(n_chunks: int) -> int:
    return max(1, min(MAX_SLICES, n_chunks // SLICE_CHUNKS))


def chunk_slice(n_slices: int) -> Column:
    """The slice of a chunk: 64 consecutive chunks of a document stay together."""
    return F.pmod(F.xxhash64("source", "doc_id", F.floor(F.col("chunk_no") / 64)), F.lit(n_slices)).cast("int")


def tokenize_chunks(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Add ``tokens`` (unicode61 rules) and ``n_tokens``."""
    return (chunks.withColumn("tokens", unicode61_tokens(content))
                  .withColumn("n_tokens", F.size("tokens")))


def in_pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what is made of a chunk's tokens is many times their size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def term_runs(tokens: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """``(row, term, offsets, positions)`` of a column of token lists: the
    positions of each distinct term of a row, ascending, are the slice of
    ``positions`` between consecutive ``offsets``."""
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = row * max(1, len(flat.dictionary)) + flat.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    terms = flat.dictionary.take(flat.indices.take(pa.array(order[first])))
    return row[order[first]], terms, np.append(first, len(key)), place[order]


def postings_of(tokenized: DataFrame, positions: bool = True, every_chunk: bool = False) -> DataFrame:
    """``term, *CHUNK_KEY, dl, tf[, positions]`` of chunks with ``tokens`` and
    ``n_tokens``, a batch at a time, without a shuffle.  ``every_chunk``
    (without positions) adds a row per chunk, under ``NO_TERM``."""
    keep = tokenized.select(*CHUNK_KEY, F.col("n_tokens").alias("dl"))
    names = ["term", *keep.columns, "tf"] + (["positions"] if positions else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            row, terms, offsets, places = term_runs(b.column("tokens"))
            tf = np.diff(offsets).astype(np.int32)
            if every_chunk:
                row, tf = np.append(row, np.arange(b.num_rows)), np.append(tf, np.zeros(b.num_rows, np.int32))
                terms = pa.concat_arrays([terms, pa.array([NO_TERM] * b.num_rows, terms.type)])
            at = pa.array(row)
            columns = [terms, *[c.take(at) for c in b.columns[1:]], pa.array(tf)]
            if positions:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(places.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep.schema)
    schema = f"term string, {kinds}, tf int" + (", positions array<int>" if positions else "")
    return tokenized.select("tokens", *CHUNK_KEY, F.col("n_tokens").alias("dl")).mapInArrow(run, schema)


@dataclass
class KeywordIndex:
    """A keyword index: lazy (tokenized chunks, nothing written until the
    first search) or stored (tables of ``quarry.operators.store``)."""

    chunks: DataFrame                         # CHUNK_KEY, content, n_tokens
    tokenized: DataFrame                      # the chunks with tokens
    store: Store | None = None
    _stats: tuple[int, float] | None = field(default=None, repr=False)
    _kept: bool = field(default=False, repr=False)

    @classmethod
    def from_chunks(cls, chunks: DataFrame) -> KeywordIndex:
        tok = tokenize_chunks(chunks)
        return cls(chunks=tok.drop("tokens"), tokenized=tok)

    def kept(self) -> KeywordIndex:
        """This index with its tokenized chunks written (once)."""
        if self.store is None and not self._kept:
            self.tokenized = sized(self.tokenized, "tokenized")
            self.chunks, self._kept = self.tokenized.drop("tokens"), True
        return self

    def postings(self, positions: bool = True) -> DataFrame:
        if self.store is None:
            return postings_of(self.tokenized, positions)
        p = self.store.table("postings").drop("bucket", "slice")
        return p if positions else p.drop("positions")

    def postings_for(self, terms: DataFrame, positions: bool = True) -> DataFrame:
        """Postings of the terms in ``terms(term)``; of a stored index only
        their buckets are read."""
        if self.store is None:
            p = postings_of(self.tokenized, positions)
        else:
            p = self.store.bucket_rows("postings", terms).drop("bucket", "slice")
            p = p if positions else p.drop("positions")
        return p.join(terms.select("term").distinct(), "term", "left_semi")

    def holders(self, terms: DataFrame) -> DataFrame:
        """``term, *CHUNK_KEY``: the chunks that hold each of ``terms (term)``."""
        if self.store is not None:
            return self.postings_for(terms, positions=False).select("term", *CHUNK_KEY)
        rows = self.tokenized.select(F.explode(F.array_distinct("tokens")).alias("term"), *CHUNK_KEY)
        return rows.join(terms.select("term").distinct(), "term", "left_semi")

    def tokenized_in(self, chunks: DataFrame) -> DataFrame:
        """The tokenized chunks of the keys in ``chunks (CHUNK_KEY)``."""
        return self.tokenized.join(chunks.select(*CHUNK_KEY).distinct(), CHUNK_KEY, "left_semi")

    def postings_in(self, chunks: DataFrame, terms: DataFrame, positions: bool = True) -> DataFrame:
        """``postings_for(terms)`` in the chunks of ``chunks (CHUNK_KEY)``: of a
        lazy index, postings are made of these chunks alone."""
        if self.store is not None:
            return self.postings_for(terms, positions).join(chunks.select(*CHUNK_KEY).distinct(), CHUNK_KEY, "left_semi")
        p = postings_of(self.tokenized_in(chunks).select(*CHUNK_KEY, "tokens", "n_tokens"), positions)
        return p.join(terms.select("term").distinct(), "term", "left_semi")

    def lists_for(self, *terms: DataFrame) -> tuple[DataFrame, int, float]:
        """``(lists, N, avgdl)`` of a lazy index: the postings of ``terms (term)``
        and a row per chunk (under ``NO_TERM``) are written, in one pass that
        writes no tokens."""
        asked = self.tokenized.sparkSession.range(1).select(F.lit(NO_TERM).alias("term"))
        for t in terms:
            asked = asked.union(t.select("term"))
        p = postings_of(self.tokenized, positions=False, every_chunk=True)
        p = sized(p.join(asked.distinct(), "term", "left_semi"), "query-postings")
        if self._stats is None:
            self._stats = _totals(p.where(F.col("term") == NO_TERM), "dl")
        return p, *self._stats

    def df_for(self, terms: DataFrame, postings: DataFrame | None = None) -> DataFrame:
        """``(term, df)``: from the stored vocabulary, else counted over
        ``postings`` (all rows of those terms; partial counts)."""
        if self.store is not None:
            return self.store.terms(terms)
        p = postings if postings is not None else self.holders(terms)
        return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def stats(self) -> tuple[int, float]:
        """``(N, avgdl)``: chunks, not documents, are the rows being ranked."""
        if self._stats is None:
            self._stats = _totals(self.chunks, "n_tokens")
        return self._stats


def _totals(chunks: DataFrame, length: str) -> tuple[int, float]:
    r = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("t")).first()
    n = int(r["n"])
    return n, (float(r["t"] or 0) / n) if n else 0.0


def corpus_stats(index: KeywordIndex) -> DataFrame:
    """One row: ``n_chunks, total_tokens, avgdl``."""
    return index.chunks.agg(F.count(F.lit(1)).alias("n_chunks"),
                            F.sum("n_tokens").cast("bigint").alias("total_tokens"),
                            F.avg("n_tokens").alias("avgdl"))


def term_df(index: KeywordIndex) -> DataFrame:
    """Document frequency per term (chunks containing the term): one partial
    aggregation, so a very frequent term costs one row per input partition
    in the shuffle."""
    if index.store is not None:
        return index.store.table("vocabulary").select("term", "df")
    terms = index.tokenized.select(F.explode_outer(F.array_distinct("tokens")).alias("term")).where(F.col("term").isNotNull())
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


# ---------------------------------------------------------------- queries

def query_terms(queries: DataFrame, query_col: str = "query", id_col: str = "query_id") -> DataFrame:
    """``(query_id, term, qtf, n_terms)``: the query text tokenized like the
    content; a term repeated in the query counts once for matching and
    ``qtf`` times in the score.  A query without terms yields no rows (so it
    matches nothing rather than failing)."""
    def counted(toks):
        distinct = F.array_distinct(toks)
        return let(F.size(distinct), lambda n: F.transform(distinct, lambda t: F.struct(
            t.alias("term"), F.size(F.filter(toks, lambda x: x == t)).alias("qtf"), n.alias("n_terms"))))
    return queries.select(
        F.col(id_col).alias("query_id"),
        F.inline(let(unicode61_tokens(query_col), counted))
    ).select("query_id", "term", "qtf", "n_terms")


def idf(n: int, df: Column) -> Column:
    raw = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def impact(avgdl: float, k1: float = K1, b: float = B) -> Column:
    """What a posting adds to a score, but for its term's weight (idf x qtf)."""
    norm = F.lit(k1) * (1 - b + b * F.col("dl") / F.lit(avgdl if avgdl else 1.0))
    return F.col("tf") * (k1 + 1) / (F.col("tf") + norm)


def rarest(terms: DataFrame, what: str = "term", number: str = "n_terms") -> DataFrame:
    """``(query_id, what)``: the rarest of each query's ``terms (query_id, what,
    df, number)``.  A query of which fewer than ``number`` are in the index has
    no match, so none is looked up."""
    best = terms.groupBy("query_id").agg(F.min_by(what, F.struct("df", what)).alias(what), F.count(F.lit(1)).alias("_n"),
                                         F.min(number).alias("_least"))
    return sized(best.where("_n >= _least").select("query_id", what), "rarest")


def from_rarest(index: KeywordIndex, terms: DataFrame, positions: bool = False) -> DataFrame:
    """Postings in the chunks that hold each query's rarest term, joined to
    ``terms (query_id, term, df, ...)``.  A chunk that holds every term of a
    query holds the rarest one, so a frequent term never fans out across the
    queries that mention it, and only those chunks' postings are made or moved."""
    rare = rarest(terms)
    cand = sized(index.holders(rare).join(rare, "term").select("query_id", *CHUNK_KEY), "candidates")
    p = index.postings_in(cand, terms, positions)
    return p.join(cand, CHUNK_KEY).join(terms, ["query_id", "term"])


def without(rows: DataFrame, index: KeywordIndex, exclude: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """``rows (query_id, CHUNK_KEY, ...)`` of chunks that hold none of their
    query's terms in ``exclude (query_id, term)``.  The chunks of ``rows`` are
    looked up in those terms' postings (``postings``, where they are at hand),
    so a frequent term costs its postings once and no row per query."""
    keys = rows.select("query_id", *CHUNK_KEY).distinct()
    p = (index.postings_for(exclude, positions=False) if postings is None else postings).select("term", *CHUNK_KEY)
    bad = p.join(keys, CHUNK_KEY).join(exclude.select("query_id", "term").distinct(), ["query_id", "term"])
    return rows.join(bad.select("query_id", *CHUNK_KEY).distinct(), ["query_id", *CHUNK_KEY], "left_anti")


def bm25_match(index: KeywordIndex, queries: DataFrame, mode: str = "all",
               exclude: DataFrame | None = None, k1: float = K1, b: float = B,
               query_col: str = "query", id_col: str = "query_id") -> DataFrame:
    """*All* chunks matching each query, with their BM25 score (bigger =
    better).  The best k of an OR query alone: ``ranked.bm25_top``.

    ``mode='all'`` - every query term occurs (the implicit AND of a MATCH);
    ``mode='any'`` - at least one occurs (OR).  ``exclude`` is an optional
    ``(query_id, query)`` frame of terms that must *not* occur (NOT).  The
    score sums over the positive terms present:
    ``idf * tf * (k1+1) / (tf + k1 * (1 - b + b * dl / avgdl))``.
    """
    if mode not in ("all", "any"):
        raise ValueError("mode must be 'all' or 'any'")
    index.kept()
    qt = sized(query_terms(queries, query_col, id_col), "query-terms")
    n, avgdl = index.stats()
    # OR: the postings of the query terms are read for the term frequencies
    # (lazy index) and the scores, so written once
    p = None if mode == "all" else sized(index.postings_for(qt, positions=False), "query-postings")
    qt = sized(qt.join(index.df_for(qt, p), "term"), "query-terms")
    score = idf(n, F.col("df")) * impact(avgdl, k1, b) * F.col("qtf")
    scored = from_rarest(index, qt) if mode == "all" else p.join(qt, "term")
    hits = (scored.groupBy("query_id", "n_terms", *CHUNK_KEY)
                  .agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("n_matched")))
    if mode == "all":
        hits = hits.where(F.col("n_matched") == F.col("n_terms"))
    if exclude is not None:
        hits = without(sized(hits, "hits"), index, sized(query_terms(exclude, query_col, id_col), "exclude"))
    return hits.select("query_id", *CHUNK_KEY, "score")


def match_terms(index: KeywordIndex, queries: DataFrame, mode: str = "all",
                query_col: str = "query", id_col: str = "query_id") -> DataFrame:
    """``(query_id, CHUNK_KEY)`` of chunks holding all / any query terms."""
    index.kept()
    qt = sized(query_terms(queries, query_col, id_col), "query-terms")
    m = ((from_rarest(index, sized(qt.join(index.df_for(qt), "term"), "query-terms")) if mode == "all"
          else index.holders(qt).join(qt, "term"))
         .groupBy("query_id", "n_terms", *CHUNK_KEY).agg(F.count(F.lit(1)).alias("n_matched")))
    if mode == "all":
        m = m.where(F.col("n_matched") == F.col("n_terms"))
    return m.select("query_id", *CHUNK_KEY)


def match_near(index: KeywordIndex, queries: DataFrame, distance: int | str = 10,
               query_col: str = "query", id_col: str = "query_id") -> DataFrame:
    """``NEAR(t1 t2 ..., distance)``: some clump holds every term with at most
    ``distance`` tokens between its first and last term; ``distance`` may name a
    column of ``queries``.  Candidates come from each query's rarest term."""
    index.kept()
    span = F.col(distance) if isinstance(distance, str) else F.lit(distance)
    limits = queries.select(F.col(id_col).alias("query_id"), (span + 1).alias("span"))
    qt = sized(query_terms(queries, query_col, id_col), "query-terms")
    qt = sized(qt.join(index.df_for(qt), "term"), "query-terms")
    held = (from_rarest(index, qt, positions=True).groupBy("query_id", "n_terms", *CHUNK_KEY)
            .agg(F.collect_list("positions").alias("places"))          # a list per query term
            .where(F.size("places") == F.col("n_terms")).join(sized(limits, "spans"), "query_id"))
    ok = F.exists(F.flatten("places"), lambda p: F.forall(
        "places", lambda arr: F.exists(arr, lambda q: (q >= p) & (q <= p + F.col("span")))))
    return held.where(ok).select("query_id", *CHUNK_KEY)


def match_first(index: KeywordIndex, queries: DataFrame, query_col: str = "query",
                id_col: str = "query_id") -> DataFrame:
    """``^term``: chunks whose first token is the query's (single) term; for
    a query of several terms, the first must start the chunk and the rest
    occur anywhere.  The chunks that start with a query's first term are found
    first; the other terms are looked up in those alone."""
    index.kept()
    qt = sized(query_terms(queries, query_col, id_col), "query-terms")
    lead = sized(queries.select(F.col(id_col).alias("query_id"), F.get(unicode61_tokens(query_col), F.lit(0)).alias("term"))
                 .where(F.col("term").isNotNull()), "first-terms")
    p = index.postings_for(qt)
    starts = p.where(F.get("positions", F.lit(0)) == 0).join(lead, "term").select("query_id", *CHUNK_KEY)
    more = sized(starts.join(qt.groupBy("query_id").agg(F.max("n_terms").alias("n_terms")), "query_id"), "starts")
    one = more.where("n_terms = 1").select("query_id", *CHUNK_KEY)
    rest = (index.postings_for(qt, positions=False).join(more.where("n_terms > 1"), CHUNK_KEY)
            .join(qt.select("query_id", "term"), ["query_id", "term"])
            .groupBy("query_id", "n_terms", *CHUNK_KEY).agg(F.count(F.lit(1)).alias("n_matched")))
    return one.unionByName(rest.where("n_matched = n_terms").select("query_id", *CHUNK_KEY))


# ---------------------------------------------------------------- ranking

def rank_order(score: str = "score", descending: bool = True) -> list[Column]:
    """Total order for top-k: the score to 12 significant digits (so float
    noise of the summation order cannot reorder exact duplicates, and small
    scores keep their order), then the key."""
    s = significant(F.col(score))
    return [s.desc() if descending else s.asc(), *[F.col(c).asc() for c in CHUNK_KEY]]


def top_k(hits: DataFrame, k: int, score: str = "score", descending: bool = True) -> DataFrame:
    """Per-query top-k with a ``rank`` column (1 = best)."""
    return top_k_per_group(hits, ["query_id"], rank_order(score, descending), k)


def keyword_hits(hits: DataFrame) -> DataFrame:
    """Project ranked matches to hits: ``source_id = source:doc_id``."""
    return hits.select("query_id", "rank", F.concat_ws(":", "source", "doc_id").alias("source_id"),
                       *CHUNK_KEY, "score")


def with_snippets(hits: DataFrame, index: KeywordIndex, queries: DataFrame, n: int = 5,
                  query_col: str = "query", id_col: str = "query_id", whole_when: Column | None = None
                  ) -> DataFrame:
    """Add ``snippet`` (see ``quarry.functions.snippet``) to ranked hits;
    rows matching ``whole_when`` get the whole chunk text instead.

    The ranked hits (at most k per query) are written first, so the planner
    knows their size when it joins them to the chunks by key."""
    from quarry.functions.snippet import snippet
    index.kept()
    qs = queries.select(F.col(id_col).alias("query_id"),
                        F.array_distinct(unicode61_tokens(query_col)).alias("_terms"))
    h = sized(hits.join(qs, "query_id"), "hits")
    j = index.chunks.select(*CHUNK_KEY, "content").join(h, CHUNK_KEY)
    snip = snippet(F.col("content"), F.col("_terms"), n)
    if whole_when is not None:
        snip = F.when(whole_when, F.col("content")).otherwise(snip)
    return j.withColumn("snippet", snip).drop("_terms", "content")
