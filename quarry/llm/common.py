"""Helpers shared by the operators: tables, lineage cuts, bounded samples and
joins whose key may be hot."""

from __future__ import annotations

import pickle
import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

#: A key is hot when it holds more than one row in this many; so there are at
#: most as many hot keys, which bounds what is broadcast for them.
HOT_SHARE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared scratch folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def labelled_sample(labels: DataFrame, label: str, limit: int, where: Column | None = None,
                    key: str = "doc_id") -> DataFrame:
    """At most ``limit`` labelled keys ``(key, label)``: those with the smallest
    hash of the key, so reruns and input orders agree.  Null keys or labels are
    left out; a key labelled twice counts once, with the larger label."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    if where is not None:
        rows = rows.where(where)
    return (rows.groupBy(F.col(key)).agg(F.max(F.col(label)).cast("int").alias("label"))
            .orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit))


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """``crc32(key as text) mod modulus = remainder``; a null key is the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def join_by_key(left: DataFrame, per_key: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of ``left`` with one row per key, where any key may hold a
    third of ``left``.  ``per_key[rows]`` counts the key's rows in ``left``.
    Keys above 1 / HOT_SHARE of all rows (so at most HOT_SHARE of them) are
    broadcast; every other key is small and takes the shuffle join."""
    total = per_key.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * HOT_SHARE > F.lit(total)
    hot_keys = F.broadcast(per_key.where(hot))
    few = per_key.where(~hot)
    name = f"_{key}_hot"
    marked = left.join(F.broadcast(per_key.where(hot).select(F.col(key).alias(name))),
                       F.col(key) == F.col(name), "left")
    return (marked.where(F.col(name).isNotNull()).drop(name).join(hot_keys, key)
            .unionByName(marked.where(F.col(name).isNull()).drop(name).join(few, key)))


def per_process(key, make: Callable):
    """``make()``, once per Python process: kept beside the modules, since this
    one is shipped to workers anew with every task."""
    kept = sys.modules.setdefault("quarry-worker-cache", types.ModuleType("quarry-worker-cache")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def shipped(spark: SparkSession, value) -> Callable:
    """Broadcast ``value``; the function returned gives it inside a task.

    Spark pickles broadcasts by reference, so an object of a class of this
    package could only be read by workers that can import it; here its class
    travels along."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)
