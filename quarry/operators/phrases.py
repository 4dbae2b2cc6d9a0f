"""Phrase search with word pairs.

Pairs of frequent terms that stand side by side have postings of their own,
under the key ``"first second"`` (terms hold no space), chosen from the term
frequencies.  A phrase is covered by units: the pairs of its frequent
neighbours, and single terms for what no pair covers.  A phrase of frequent
words alone therefore opens pair lists only, which are far shorter than the
words' own.  Units are looked up from the query's rarest one on.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import unicode61_tokens
from quarry.operators.chunking import CHUNK_KEY
from quarry.operators.common import sized
from quarry.operators.keyword import KeywordIndex, in_pieces, postings_of, rarest

#: A term is frequent in an index of N chunks when it is in more than N / 20.
#: A chunk holds few distinct terms, so there are at most 20 times their mean.
FREQUENT_PART = 20

# worker-side code travels by value: workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def is_frequent(df: Column, n_chunks: int) -> Column:
    return df * FREQUENT_PART > F.lit(n_chunks)


def pair_tokens(tokenized: DataFrame, frequent: list[str]) -> DataFrame:
    """``tokenized`` with ``tokens`` replaced: at each place the pair of the
    term and its right neighbour where both are in ``frequent``, else null."""
    names = [*CHUNK_KEY, "n_tokens", "tokens"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokenized.select(names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        wanted = pa.array(frequent, pa.string())
        for b in in_pieces(batches):
            tokens = b.column("tokens")
            lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = tokens.flatten().cast(pa.string())
            known = pc.is_in(flat, value_set=wanted).to_numpy(zero_copy_only=False)
            ends = np.zeros(len(flat), dtype=bool)
            ends[np.cumsum(lengths)[lengths > 0] - 1] = True
            both = np.zeros(len(flat), dtype=bool)
            both[:-1] = known[:-1] & known[1:] & ~ends[:-1]
            after = pa.concat_arrays([flat[1:], pa.array([""], pa.string())]) if len(flat) else flat
            pairs = pc.if_else(pa.array(both), pc.binary_join_element_wise(flat, after, " "), pa.scalar(None, pa.string()))
            offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pairs)], names)

    return tokenized.select(names).mapInArrow(run, kinds)


def pair_postings(tokenized: DataFrame, frequent: list[str]) -> DataFrame:
    """Postings of the pairs of ``frequent`` terms (``positions``: of the first)."""
    return postings_of(pair_tokens(tokenized, frequent)).where(F.col("term").isNotNull())


def _units(phrase: Column, frequent: Column) -> Column:
    """``array<struct<term, place, pair>>`` that cover a phrase; ``frequent``:
    a flag per token."""
    n = F.size(phrase)
    two = lambda i: F.get(frequent, i) & F.coalesce(F.get(frequent, i + 1), F.lit(False)) & (i + 1 < n)
    pairs = F.transform(F.filter(F.sequence(F.lit(0), n - 1), two), lambda i: F.struct(
        F.concat(F.get(phrase, i), F.lit(" "), F.get(phrase, i + 1)).alias("term"), i.alias("place"), F.lit(True).alias("pair")))
    alone = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~two(i) & ~F.when(i > 0, two(i - 1)).otherwise(F.lit(False)))
    singles = F.transform(alone, lambda i: F.struct(F.get(phrase, i).alias("term"), i.alias("place"), F.lit(False).alias("pair")))
    return F.concat(pairs, singles)


def match_phrase(index: KeywordIndex, queries: DataFrame, query_col: str = "query", id_col: str = "query_id",
                 trace: dict[str, DataFrame] | None = None) -> DataFrame:
    """Chunks where the query's tokens occur consecutively (``"a b c"``);
    ``trace`` receives the units looked up."""
    index.kept()
    n, _ = index.stats()
    qs = sized(queries.select(F.col(id_col).alias("query_id"), unicode61_tokens(query_col).alias("phrase"))
               .where(F.size("phrase") > 0), "phrases")
    words = sized(qs.select("query_id", F.posexplode("phrase").alias("place", "term")), "phrase-terms")
    # a term that is in no chunk has no frequency: its phrase matches nothing
    flags = words.join(sized(index.df_for(words), "term-df"), "term", "left").withColumn("f", is_frequent(F.coalesce("df", F.lit(0)), n))
    flags = flags.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "f"))), lambda x: x["f"]).alias("f"))
    units = sized(qs.join(flags, "query_id").select("query_id", F.inline(_units(F.col("phrase"), F.col("f")))), "units")
    frequent = None
    if index.store is None:
        # pairs of a lazy index: those of the query set's frequent terms (bounded as all frequent terms are)
        rows = units.where("pair").select(F.explode(F.split("term", " ")).alias("term")).distinct().collect()
        frequent = [r["term"] for r in rows]

    def lists_of(units: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
        """``term, *CHUNK_KEY[, positions]`` of units, or with positions in ``chunks``."""
        pairs, single = units.where("pair").select("term").distinct(), units.where("not pair").select("term")
        out = index.holders(single) if chunks is None else index.postings_in(chunks, single)
        double = None
        if index.store is not None:
            double = index.store.bucket_rows("pairs", pairs).drop("bucket").join(pairs, "term", "left_semi")
            if chunks is not None:
                double = double.join(chunks.select(*CHUNK_KEY).distinct(), CHUNK_KEY, "left_semi")
        elif frequent:
            tokenized = index.tokenized if chunks is None else index.tokenized_in(chunks)
            double = pair_postings(tokenized, frequent).join(pairs, "term", "left_semi")
        columns = ["term", *CHUNK_KEY] + ([] if chunks is None else ["positions"])
        out = out.select(columns)
        return out if double is None else out.unionByName(double.select(columns))

    counted = units.join(lists_of(units).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    sizes = units.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_units"))
    counted = sized(counted.join(sizes, "query_id"), "units")
    # the chunks that hold each query's rarest unit, then these chunks' units
    rare = rarest(counted, number="n_units")
    of_rare = sized(rare.join(counted.select("query_id", "term", "pair").distinct(), ["query_id", "term"]), "rarest")
    cand = sized(lists_of(of_rare).join(rare, "term").select("query_id", *CHUNK_KEY), "candidates")
    lists = sized(lists_of(counted, cand), "unit-postings")
    if trace is not None:
        trace.update(units=counted, lists=lists)
    starts = F.transform("positions", lambda p: p - F.col("place"))
    held = (lists.join(cand, CHUNK_KEY).join(counted, ["query_id", "term"]).groupBy("query_id", "n_units", *CHUNK_KEY)
            .agg(F.collect_list(starts).alias("starts")).where(F.size("starts") == F.col("n_units")))    # a list per unit
    common = F.aggregate(F.slice("starts", 2, F.col("n_units")), F.col("starts")[0], lambda a, s: F.array_intersect(a, s))
    return held.where(F.size(common) > 0).select("query_id", *CHUNK_KEY)
