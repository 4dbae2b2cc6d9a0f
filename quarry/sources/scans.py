"""Scans: landed exports of issues and pages, deal messages, labelled rows.

The reference pulls issues and pages from live APIs one page at a time; here
the same records are read from files that were landed beforehand, so the
scan is an ordinary (pruned, pushed-down) Spark read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import html_to_text

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read one table.  How finely files are split is the session's setting
    (``spark.sql.files.maxPartitionBytes``), but a file of one row group is one
    task.  ``spread`` is for tables whose work per row dwarfs their size: where
    the scan has fewer tasks than the cluster has cores, its rows are dealt out
    anew; a large table's scan has more, and nothing is added."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if not spread:
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def issue_scan(df: DataFrame, key="key", description="fields.description",
               source: str = "issue", where: Column | None = None) -> DataFrame:
    """Issue records -> ``(source, doc_id, html)``.

    A missing or null description reads as the empty string.
    """
    if where is not None:
        df = df.where(where)
    return df.select(F.lit(source).alias("source"),
                     _as_col(key).cast("string").alias("doc_id"),
                     F.coalesce(_as_col(description).cast("string"), F.lit("")).alias("html"))


def page_scan(df: DataFrame, key="id", body="body.storage.value",
              source: str = "page", where: Column | None = None) -> DataFrame:
    """Page records -> ``(source, doc_id, html)``; the body comes with the
    row, so there is no per-page fetch."""
    if where is not None:
        df = df.where(where)
    return df.select(F.lit(source).alias("source"),
                     _as_col(key).cast("string").alias("doc_id"),
                     F.coalesce(_as_col(body).cast("string"), F.lit("")).alias("html"))


def to_text(df: DataFrame) -> DataFrame:
    """``(source, doc_id, html)`` -> ``(source, doc_id, text)``."""
    return df.select("source", "doc_id", html_to_text("html").alias("text"))


def combine_sources(*frames: DataFrame) -> DataFrame:
    """Union of tagged sources (UNION ALL by column name)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    """Does the path (or glob) name anything?  Asked of Hadoop's file system,
    as Spark's own readers ask."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_messages(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Whole-text messages ``(msg_id, text)``, one row per file.

    When ``path`` does not exist and a ``fallback`` text is given, the result
    is a one-row frame holding the fallback (the reference's behaviour for a
    missing sample file).
    """
    if fallback is not None and not _exists(spark, path):
        return spark.createDataFrame([(path, fallback)], "msg_id string, text string")
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("msg_id"), F.col("value").alias("text"))


def labelled_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Inline labelled sentences ``(sentence_id, tokens, labels)``."""
    data = [(i, list(r["tokens"]), list(r["labels"])) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "sentence_id bigint, tokens array<string>, labels array<string>")
