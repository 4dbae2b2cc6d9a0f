"""Ranked OR search: the best k chunks per query without scoring all matches.

Chunks are dealt to slices, and per (term, slice) the greatest impact of the
term's postings is known (stored with an index, or taken from the query terms'
postings).  A search then

1. scores each query's rarest terms alone; the k-th best of these partial
   scores is a score that k chunks reach, so the threshold of the answer; the
   k-th best slice maximum of a single term is another such score;
2. adds up, per query and slice, the terms' bounds from the smallest: terms
   whose sum stays below the threshold cannot lift a chunk into the answer by
   themselves (stop words, mostly), and a slice whose whole sum stays below it
   holds no answer at all;
3. reads the postings of the other terms, drops chunks that cannot reach the
   threshold even with the rest, and raises it by what was found;
4. scores the chunks that are left in full.

Of a lazy index the postings of the query terms are dealt by slice, once, and
meet the query terms that may matter there: steps 3 and 4 are done inside each
slice, and no more than its best rows of a query leave it.  Of a stored index,
where a search is to read little, they are joins.

Nothing is lost: only chunks whose bound is below a score reached by k others
are skipped, with room for rounding.
"""

from __future__ import annotations

import sys
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.chunking import CHUNK_KEY
from quarry.operators.common import sized, top_k_per_group
from quarry.operators.keyword import (B, K1, NO_TERM, KeywordIndex, chunk_slice, idf, impact, query_terms, rank_order,
                                      slice_count, without)

#: Rows that a query's rarest terms may give in the first pass.  A larger
#: number makes the threshold better, not the answer.
SEED_ROWS = 1000
#: Room for the rounding of sums.
ROOM = 1 - 1e-9

# worker-side code travels by value: workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _kth(rows: DataFrame, k: int, by: list[str], score: str) -> DataFrame:
    """``(query_id, floor)``: each group's k-th largest score; groups of fewer
    rows have none, and of several groups of a query the largest counts."""
    ranked = top_k_per_group(rows, by, [F.col(score).desc()], k, "_nth").where(F.col("_nth") == k)
    return ranked.groupBy("query_id").agg(F.max(score).alias("floor"))


def bm25_top(index: KeywordIndex, queries: DataFrame, k: int, exclude: DataFrame | None = None,
             k1: float = K1, b: float = B, query_col: str = "query", id_col: str = "query_id",
             trace: dict[str, DataFrame] | None = None) -> DataFrame:
    """``query_id, *CHUNK_KEY, score, rank``: the ``k`` best chunks that hold
    any term of the query (and no term of ``exclude (query_id, query)``), as
    ``top_k(bm25_match(..., 'any'), k)`` gives them.  Queries without terms
    have no rows.  ``trace`` receives the intermediate frames by name."""
    qt = sized(query_terms(queries, query_col, id_col), "query-terms")
    not_terms = None if exclude is None else sized(query_terms(exclude, query_col, id_col), "exclude")
    lists = None
    if index.store is None:
        lists, n, avgdl = index.lists_for(qt, *([] if not_terms is None else [not_terms]))
    else:
        n, avgdl = index.stats()
    n_slices = index.store.slices if index.store else slice_count(n)
    worth = impact(avgdl, k1, b).alias("impact")
    part = chunk_slice(n_slices).alias("slice")

    if lists is not None:
        lists = lists.where(F.col("term") != NO_TERM).select("term", *CHUNK_KEY, part, worth)
        postings = lambda terms: lists.join(terms.select("term").distinct(), "term", "left_semi")
        qt = qt.join(index.df_for(qt, lists), "term")
        bounds_of = None
    else:
        postings = lambda terms: index.postings_for(terms, positions=False).select("term", *CHUNK_KEY, part, worth)
        qt = qt.join(index.df_for(qt), "term")
        bounds_of = index.store.impacts if index.store.scores_with(k1, b) else None
    qt = sized(qt.select("query_id", "term", "df", (idf(n, F.col("df")) * F.col("qtf")).alias("weight")), "query-terms")
    if bounds_of is None:
        most = postings(qt).groupBy("term", "slice").agg(F.max("impact").alias("impact"))
    else:
        most = bounds_of(qt, postings)
    most = sized(most.join(qt, "term").select("query_id", "slice", "term", "weight", (F.col("impact") * F.col("weight")).alias("bound")), "bounds")

    # 1. the threshold
    rising = Window.partitionBy("query_id").orderBy("df", "term")
    rare = qt.withColumn("_rows", F.sum("df").over(rising.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_rows") <= SEED_ROWS)
    rare = sized(rare.drop("_rows"), "rare-terms")
    seeds = (postings(rare).join(rare, "term").groupBy("query_id", *CHUNK_KEY)
             .agg(F.sum(F.col("impact") * F.col("weight")).alias("partial")))
    if not_terms is not None:
        seeds = without(sized(seeds, "seeds"), index, not_terms, None if lists is None else postings(not_terms))
    floors = _kth(seeds, k, ["query_id"], "partial")
    if not_terms is None:
        # each slice's greatest impact is some chunk's
        floors = floors.unionByName(_kth(most, k, ["query_id", "term"], "bound"))
    floors = floors.groupBy("query_id").agg((F.max("floor") * ROOM).alias("floor"))

    # 2. the terms that a chunk of the answer must hold one of, per slice
    up = Window.partitionBy("query_id", "slice").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    summed = sized(most.join(sized(floors, "floors"), "query_id", "left").withColumn("_sum", F.sum("bound").over(up))
                   .withColumn("needed", F.col("_sum") >= F.coalesce("floor", F.lit(0.0))), "bounds")
    if lists is not None:
        rows = partial(_in_slices, lists, summed, not_terms, k)
        if trace is not None:
            trace.update(bounds=summed, needed=rows("needed"), candidates=rows("candidates"))
        return top_k_per_group(rows("best"), ["query_id"], rank_order(), k)
    needed = summed.where("needed").select("query_id", "slice", "term", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    rest = summed.where("not needed").groupBy("query_id", "slice").agg(F.max("_sum").alias("rest"))

    # 3. candidates, with the part of their score that is known
    rows = postings(needed).join(needed, ["term", "slice"]).join(qt.select("query_id", "term", "weight"), ["query_id", "term"])
    found = (rows.groupBy("query_id", "slice", *CHUNK_KEY, "floor").agg(F.sum(F.col("impact") * F.col("weight")).alias("partial"))
             .join(rest, ["query_id", "slice"], "left")
             .where(F.col("partial") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor")))
    if not_terms is not None:
        found = without(sized(found, "found"), index, not_terms)
    found = sized(found, "found")
    higher = _kth(found, k, ["query_id"], "partial").select("query_id", (F.col("floor") * ROOM).alias("higher"))
    left = (found.join(higher, "query_id", "left")
            .where(F.col("higher").isNull() | (F.col("partial") + F.coalesce("rest", F.lit(0.0)) >= F.col("higher")))
            .select("query_id", *CHUNK_KEY))
    left = sized(left, "candidates")
    if trace is not None:
        trace.update(bounds=summed, needed=rows, found=found, candidates=left)

    # 4. their whole scores
    scored = (postings(qt).drop("slice").join(left, CHUNK_KEY).join(qt.select("query_id", "term", "weight"), ["query_id", "term"])
              .groupBy("query_id", *CHUNK_KEY).agg(F.sum(F.col("impact") * F.col("weight")).alias("score")))
    return top_k_per_group(scored, ["query_id"], rank_order(), k)


# ---------------------------------------------------------------- inside a slice

def _in_slices(lists: DataFrame, summed: DataFrame, not_terms: DataFrame | None, k: int, what: str) -> DataFrame:
    """``query_id, *CHUNK_KEY, score``: each slice's best rows per query
    (``what='best'``), or the rows of its steps (see ``_slice_rows``)."""
    pair = Window.partitionBy("query_id", "slice")
    asked = (summed.withColumn("_any", F.max("needed").over(pair)).where("_any")
             .select("slice", "query_id", "term", "weight", "needed", F.coalesce("floor", F.lit(0.0)).alias("floor"),
                     F.when(~F.col("needed"), F.col("_sum")).otherwise(0.0).alias("rest")))
    if not_terms is not None:
        nots = asked.select("slice", "query_id").distinct().join(not_terms.select("query_id", "term"), "query_id")
        asked = asked.unionByName(nots, allowMissingColumns=True)         # no weight: excluded
    kinds = {f.name: f.dataType.simpleString() for f in [*lists.schema, *asked.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["query_id", *CHUNK_KEY]) + ", score double"
    run = lambda left, right: _slice_rows(left, right, k, what)
    return lists.groupBy("slice").cogroup(asked.groupBy("slice")).applyInArrow(run, schema)


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the column's values, null first."""
    import pyarrow.compute as pc

    coded = column.combine_chunks().dictionary_encode()
    rank = np.zeros(len(coded.dictionary) + 1, dtype=np.int64)            # the last: of null
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(rank))
    return rank[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]


def _slice_rows(left: pa.Table, right: pa.Table, k: int, what: str) -> pa.Table:
    """Steps 3 and 4 for the postings ``left`` of a slice and its query terms
    ``right``.  Numbers of chunks follow the order of their keys; rows of one
    key count as one chunk.  As in joins, a null key equals none: it is not
    excluded, and not among the best."""
    import pyarrow.compute as pc

    number, known = np.zeros(left.num_rows, dtype=np.int64), np.ones(left.num_rows, dtype=bool)
    for c in CHUNK_KEY:
        rank = _ranks(left.column(c))
        known &= rank > 0
        number = number * (rank.max(initial=0) + 1) + rank
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    n = max(1, len(first))
    terms = left.column("term").combine_chunks().dictionary_encode()
    cells, cell = np.unique(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + number, return_inverse=True)
    worth = np.bincount(cell, left.column("impact").to_numpy(), minlength=len(cells))
    chunks, starts = cells % n, np.searchsorted(cells, np.arange(len(terms.dictionary) + 1) * n)
    right = right.append_column("_at", pc.fill_null(pc.index_in(right.column("term"), value_set=terms.dictionary), -1))
    right = right.filter(pc.greater_equal(right.column("_at"), 0)).sort_by("query_id")      # an excluded term may be in no chunk
    ids = right.column("query_id").combine_chunks()
    at, weight, needed, floor, rest = (right.column(c).to_numpy() for c in ("_at", "weight", "needed", "floor", "rest"))
    rank = _ranks(right.column("query_id"))
    ends = np.append(np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else [], len(rank)).astype(np.int64)
    who, which, scores = [], [], []
    for low, high in zip(ends[:-1], ends[1:]):
        rows = np.arange(low, high)
        scored = rows[~np.isnan(weight[rows])]
        if not len(scored):
            continue
        free = np.ones(n, dtype=bool)
        for i in rows[np.isnan(weight[rows])]:
            free[chunks[starts[at[i]]: starts[at[i] + 1]]] = False
        free[:len(first)] |= ~known[first]
        sums, held = np.zeros(n), np.zeros(n, dtype=bool)
        entered = []
        for i in scored:
            if needed[i]:
                run = slice(starts[at[i]], starts[at[i] + 1])
                sums[chunks[run]] += worth[run] * weight[i]
                held[chunks[run]] = True
                if what == "needed":
                    entered.append(chunks[run][free[chunks[run]]])
        bar, more = floor[scored[0]], rest[scored].max()
        found = np.flatnonzero(held & free)
        found = found[sums[found] + more >= bar]
        if len(found) > k:
            found = found[sums[found] + more >= np.partition(sums[found], -k)[-k] * ROOM]
        if what == "best":
            found = found[known[first[found]]]
            for i in scored:
                if not needed[i]:
                    run = slice(starts[at[i]], starts[at[i] + 1])
                    sums[chunks[run]] += worth[run] * weight[i]
            if len(found) > k:
                found = found[sums[found] >= np.partition(sums[found], -k)[-k] * ROOM]
                # of equal scores, no more than the k first keys
                order = np.lexsort((found, -sums[found]))
                found, values = found[order], sums[found][order]
                since = np.maximum.accumulate(np.where(np.append(True, values[1:] != values[:-1]), np.arange(len(values)), 0))
                found = found[np.arange(len(values)) - since < k]
        elif what == "needed":
            found = np.concatenate([*entered, np.zeros(0, dtype=np.int64)])
        who.append(np.full(len(found), low))
        which.append(found)
        scores.append(sums[found])
    who, which = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for x in (who, which))
    keys = left.select(CHUNK_KEY).take(pa.array(first[which]))
    return pa.table([ids.take(pa.array(who)), *keys.columns, pa.array(np.concatenate([*scores, np.zeros(0)]))],
                    names=["query_id", *CHUNK_KEY, "score"])
