"""Helpers shared by the operators: measured tables and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import scratch_path


def sized(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The planner then knows its true size: whether a join broadcasts it is
    Spark's own decision (``spark.sql.autoBroadcastJoinThreshold``), at every
    size, and nothing is gathered on the driver."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def significant(x: Column, digits: int = 12) -> Column:
    """``x`` cut to significant digits: scores that differ only by the order
    of a summation compare equal, however small they are."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """``row_number() <= k`` per group.

    Spark plans this as a partial WindowGroupLimit before the shuffle and a
    final one after it, so a group that holds most of the rows still ships at
    most ``k`` rows per input partition.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
