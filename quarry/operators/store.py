"""A stored keyword index: tables, their layout, and lookups.

A version folder holds

* ``tokenized``  - chunks with tokens (and embeddings)
* ``postings``   - bucket / term, *CHUNK_KEY, dl, tf, positions, slice
* ``vocabulary`` - split / term, df, in term order (``vocabulary``)
* ``impacts``    - bucket / term, slice, impact: each frequent term's greatest
  impact per slice (``ranked``)
* ``pairs``      - bucket / postings of pairs of frequent terms (``phrases``)

``bucket`` (a hash of the term) is a partition folder, so a lookup opens its
terms' buckets only; inside, rows are in term order.  The numbers of buckets,
of files per bucket and of slices come from the size of the corpus and are
stored with the version.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.chunking import CHUNK_KEY
from quarry.operators.keyword import B, K1, KeywordIndex, chunk_slice, impact, postings_of, slice_count
from quarry.operators.phrases import is_frequent, pair_postings
from quarry.operators.vocabulary import Vocabulary, read_vocabulary, write_vocabulary

#: Postings of a bucket (about 100 MB of Parquet), and buckets at most; beyond
#: that a bucket has several files, dealt by chunk.
BUCKET_ROWS, MAX_BUCKETS = 4_000_000, 4096
#: Terms in fewer chunks have no rows in ``impacts``: their postings are as short.
IMPACT_DF = 64


def bucket_of(term: Column, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n_buckets)).cast("int")


@dataclass
class Store:
    """Tables of one version under ``root``; ``entry`` is its record."""

    spark: SparkSession
    root: str
    entry: dict
    _vocabulary: Vocabulary | None = field(default=None, repr=False)

    @property
    def slices(self) -> int:
        return self.entry["slices"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.entry["schemas"][name]).parquet(f"{self.root}/{name}")

    def scores_with(self, k1: float, b: float) -> bool:
        """Were the impacts computed with these parameters?"""
        return (self.entry["k1"], self.entry["b"]) == (k1, b)

    def bucket_rows(self, name: str, terms: DataFrame) -> DataFrame:
        """Rows of a bucketed table in the buckets of ``terms``."""
        of = bucket_of(F.col("term"), self.entry["buckets"])
        buckets = [r[0] for r in terms.select(of).distinct().collect()]       # MAX_BUCKETS numbers at most
        return self.table(name).where(F.col("bucket").isin(buckets))

    def vocabulary(self) -> Vocabulary:
        if self._vocabulary is None:
            self._vocabulary = read_vocabulary(self.spark, f"{self.root}/vocabulary")
        return self._vocabulary

    def terms(self, terms: DataFrame) -> DataFrame:
        """``(term, df)`` of the terms that occur."""
        v = self.vocabulary()
        asked = terms.select("term").distinct().withColumn("split", v.split_column(F.col("term")))
        splits = [r[0] for r in asked.select("split").distinct().collect()]   # a number per range
        return v.in_splits(splits).join(asked, ["split", "term"], "left_semi").select("term", "df")

    def impacts(self, terms: DataFrame, postings) -> DataFrame:
        """``(term, slice, impact)`` of ``terms (term, df, ...)``: stored for
        frequent terms, from the postings of the others."""
        rare = postings(terms.where(F.col("df") < IMPACT_DF)).groupBy("term", "slice").agg(F.max("impact").alias("impact"))
        often = terms.where(F.col("df") >= IMPACT_DF).select("term").distinct()
        stored = self.bucket_rows("impacts", often).join(often, "term", "left_semi")
        return stored.select("term", "slice", "impact").unionByName(rare)

    def index(self) -> KeywordIndex:
        n, total = self.entry["n_chunks"], self.entry["total_tokens"]
        tok = self.table("tokenized")
        return KeywordIndex(chunks=tok.select(*CHUNK_KEY, "content", "n_tokens"), tokenized=tok, store=self,
                            _stats=(n, total / n if n else 0.0))


def write_store(tokenized: DataFrame, root: str, k1: float = K1, b: float = B) -> dict:
    """Write the tables of a version from tokenized chunks; returns its record."""
    spark = tokenized.sparkSession
    # sorted by key inside each file: a lookup of a few documents skips the
    # other row groups
    schemas = {"tokenized": _schema(tokenized)}
    tokenized.sortWithinPartitions(*CHUNK_KEY).write.parquet(f"{root}/tokenized")
    stored = spark.read.schema(schemas["tokenized"]).parquet(f"{root}/tokenized")
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).first()
    n, total = size["n"], int(size["t"] or 0)
    buckets = max(1, min(MAX_BUCKETS, total // BUCKET_ROWS))
    entry = {"n_chunks": n, "total_tokens": total, "buckets": buckets, "slices": slice_count(n), "k1": k1, "b": b, "schemas": schemas}
    bucket = bucket_of(F.col("term"), buckets).alias("bucket")
    # files of a bucket, dealt by chunk: a frequent term is in all of them
    per_bucket = max(1, total // (buckets * BUCKET_ROWS))
    tasks = max(buckets * per_bucket, spark.sparkContext.defaultParallelism)

    def lay(postings: DataFrame, name: str) -> DataFrame:
        spread = F.pmod(F.xxhash64(*CHUNK_KEY), F.lit(max(1, tasks // buckets)))
        (postings.select("*", bucket).repartition(tasks, "bucket", spread).sortWithinPartitions("bucket", "term")
         .write.partitionBy("bucket").parquet(f"{root}/{name}"))
        schemas[name] = f"{_schema(postings)}, bucket int"
        return spark.read.schema(schemas[name]).parquet(f"{root}/{name}")

    postings = lay(postings_of(stored).withColumn("slice", chunk_slice(entry["slices"])), "postings")
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    vocabulary = write_vocabulary(counts, f"{root}/vocabulary")
    schemas |= {"vocabulary": _schema(vocabulary.rows), "impacts": "term string, slice int, impact double, bucket int"}
    # impacts: a term's rows lie together, so partial results shrink frequent terms before the shuffle
    best = (postings.select("bucket", "term", "slice", impact(total / n if n else 0.0, k1, b).alias("impact"))
            .groupBy("bucket", "term", "slice").agg(F.max("impact").alias("impact"), F.count(F.lit(1)).alias("rows")))
    (best.withColumn("df", F.sum("rows").over(Window.partitionBy("bucket", "term"))).where(F.col("df") >= IMPACT_DF)
     .select("bucket", "term", "slice", "impact").write.partitionBy("bucket").parquet(f"{root}/impacts"))
    frequent = [r["term"] for r in vocabulary.rows.where(is_frequent(F.col("df"), n)).select("term").collect()]   # bounded, see phrases
    lay(pair_postings(stored, frequent), "pairs")
    return entry


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
