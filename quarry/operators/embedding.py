"""Embedding each distinct text once.

Chunks repeat (notices, copies, forms), and a model call costs far more than a
join.  Texts are known by their SHA-256; the model sees one row per distinct
text, and the vectors are joined back.  Texts that fill more than one row in
``HOT_SHARE`` (so at most that many of them) are joined by broadcast, all others
by a shuffle in which no key is large.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.embed import model_embed
from quarry.operators.common import sized

HOT_SHARE = 2000


def join_back(rows: DataFrame, per_key: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key`` (never null), where any
    key may hold a third of the rows; ``per_key[count]`` tells how many it holds."""
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    often, seldom = per_key.where(hot), per_key.where(~hot)
    marks = F.broadcast(often.select(F.col(key).alias("_hot")))
    marked = rows.join(marks, F.col(key) == F.col("_hot"), "left")
    few = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(often), key)
    return few.unionByName(marked.where(F.col("_hot").isNull()).drop("_hot").join(seldom, key)).drop(count)


def embed_distinct(chunks: DataFrame, load_model: Callable, content: str = "content", out: str = "embedding") -> DataFrame:
    """``chunks`` with ``out``, the model's vector of ``content`` (null: of the
    empty text), computed once per distinct text; equal to ``model_embed``."""
    keyed = chunks.withColumn("_key", F.sha2(F.coalesce(content, F.lit("")), 256))
    texts = sized(keyed.groupBy("_key").agg(F.first(F.coalesce(content, F.lit(""))).alias("_text"), F.count(F.lit(1)).alias("_rows")), "texts")
    vectors = sized(texts.select("_key", "_rows", model_embed("_text", load_model).alias(out)), "vectors")
    return join_back(keyed, vectors, "_key", "_rows").drop("_key")
