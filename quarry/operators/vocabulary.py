"""The vocabulary of an index, sorted and cut into ranges, and prefix search.

Terms with their frequencies are range-partitioned by term (Spark samples the
bounds), and each range is a folder of the table.  A prefix is a run of that
order: the bounds say which ranges it touches, only those are read, and the
terms come first, the postings of just these terms after them.  A prefix that
covers a third of all terms lies in a third of the ranges, so it stays spread.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.chunking import CHUNK_KEY
from quarry.operators.common import sized
from quarry.operators.keyword import KeywordIndex, rarest, term_df
from quarry.session import scratch_path

#: Greater than any character of a term.
LAST = "\U0010FFFF"


@dataclass
class Vocabulary:
    """``rows``: term, df, split; ``firsts``: the first term of each split, in
    order (one entry per range partition)."""

    rows: DataFrame
    firsts: list[str]

    def split_of(self, term: str) -> int:
        return max(0, bisect_right([f.encode() for f in self.firsts], term.encode()) - 1)

    def split_column(self, term: Column) -> Column:
        """``split_of`` as an expression."""
        if not self.firsts:
            return F.lit(0)
        at = F.size(F.filter(F.lit(self.firsts), lambda f: f <= term)) - 1
        return F.greatest(F.lit(0), at)

    def in_splits(self, splits: list[int]) -> DataFrame:
        return self.rows.where(F.col("split").isin(splits))


def write_vocabulary(terms: DataFrame, path: str) -> Vocabulary:
    """Store ``terms (term, df)`` under ``path`` in term order."""
    (terms.repartitionByRange("term").sortWithinPartitions("term")
     .withColumn("split", F.spark_partition_id()).write.partitionBy("split").parquet(path))
    return read_vocabulary(terms.sparkSession, path)


def read_vocabulary(spark, path: str) -> Vocabulary:
    rows = spark.read.schema("term string, df bigint, split int").parquet(path)
    firsts = rows.groupBy("split").agg(F.min("term").alias("first")).collect()          # a row per range
    by_split = {r["split"]: r["first"] for r in firsts}
    # an empty range begins where the next one does, and is never looked up
    out, nxt = [], LAST
    for s in range(max(by_split, default=-1), -1, -1):
        nxt = by_split.get(s, nxt)
        out.append(nxt)
    return Vocabulary(rows, out[::-1])


def vocabulary(index: KeywordIndex) -> Vocabulary:
    """The stored vocabulary, or one written for a lazy index (once)."""
    if index.store is not None:
        return index.store.vocabulary()
    if not hasattr(index, "_vocabulary"):
        index._vocabulary = write_vocabulary(term_df(index.kept()), scratch_path(index.chunks.sparkSession, "vocabulary"))
    return index._vocabulary


def prefix_terms(index: KeywordIndex, prefixes: DataFrame) -> DataFrame:
    """``(pfx, term, df)``: the terms that start with each of ``prefixes (pfx)``.

    Joined on (range, prefix): terms of the touched ranges are cut to the
    prefix lengths asked for, a handful of numbers."""
    v = vocabulary(index)
    asked = sized(prefixes.select("pfx").distinct().where(F.length("pfx") > 0)
                  .withColumn("split", F.explode(F.sequence(v.split_column(F.col("pfx")), v.split_column(F.concat("pfx", F.lit(LAST))))))
                  .withColumn("plen", F.length("pfx")), "prefixes")
    splits = [r[0] for r in asked.select("split").distinct().collect()]                 # a number per range
    lens = sorted(r[0] for r in asked.select("plen").distinct().collect())
    cuts = F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in lens]) if lens else F.array(F.lit(""))
    rows = v.in_splits(splits).select("term", "df", "split", F.explode(cuts).alias("pfx")).where(F.col("pfx").isNotNull())
    return rows.join(asked, ["split", "pfx"]).select("pfx", "term", "df")


def match_prefix(index: KeywordIndex, prefixes: DataFrame, id_col: str = "query_id",
                 prefix_col: str = "prefixes") -> DataFrame:
    """``p1* p2* ...``: chunks where every prefix starts some token.  Terms
    first, then the postings of these terms, from each query's rarest prefix."""
    index.kept()
    qp = (prefixes.select(F.col(id_col).alias("query_id"), F.array_distinct(F.col(prefix_col)).alias("pfx"))
          .select("query_id", F.explode("pfx").alias("pfx")).where(F.length("pfx") > 0))
    qp = sized(qp.join(qp.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms")), "query_id"), "prefix-queries")
    terms = sized(prefix_terms(index, qp), "prefix-terms")
    counts = terms.groupBy("pfx").agg(F.sum("df").alias("df"))
    # a query with a prefix that starts no term has no match
    asked = qp.join(counts, "pfx")
    whole = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    asked = sized(asked.join(whole, "query_id").where("_n = n_terms").drop("_n"), "prefix-queries")
    live = sized(terms.join(asked.select("pfx").distinct(), "pfx", "left_semi").select("term", "pfx"), "prefix-terms")
    # the chunks that hold a term of each query's rarest prefix, then these chunks' terms
    rare = rarest(asked, "pfx")
    lead = live.join(rare, "pfx").select("query_id", "term")
    cand = sized(index.holders(lead).join(lead, "term").select("query_id", *CHUNK_KEY).distinct(), "candidates")
    wanted = asked.groupBy("query_id").agg(F.collect_set("pfx").alias("wanted"))
    return (_held_prefixes(index, live, cand).join(cand, CHUNK_KEY).join(wanted, "query_id")
            .where(F.size(F.array_except("wanted", "held")) == 0).select("query_id", *CHUNK_KEY))


def _held_prefixes(index: KeywordIndex, live: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(CHUNK_KEY, held)``: the prefixes that start a token, per chunk of
    ``chunks``.  A row per chunk: of a lazy index the tokens are cut where they are."""
    if index.store is not None:
        rows = index.postings_in(chunks, live, positions=False).join(live, "term")
        return rows.groupBy(*CHUNK_KEY).agg(F.collect_set("pfx").alias("held"))
    lens = sorted(r[0] for r in live.select(F.length("pfx")).distinct().collect())                   # a handful of numbers
    cut = lambda n: F.transform("tokens", lambda t: F.substring(t, 1, n))
    held = F.array_distinct(F.concat(*[cut(n) for n in lens])) if lens else F.array().cast("array<string>")
    rows = index.tokenized.select(*CHUNK_KEY, held.alias("held")).join(chunks.select(*CHUNK_KEY).distinct(), CHUNK_KEY, "left_semi")
    return rows.groupBy(*CHUNK_KEY).agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
