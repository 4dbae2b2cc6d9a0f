"""Registered tagging queries.  A labelled sentence is rendered from every
line item: ``notes <n>y paying <currency> near T+<spread>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.tagging import (LABELS, explode_labelled, explode_text, label_indexer, load_tagger, pair_labels,
                                      predict_path, save_tagger, train_tagger)
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources.scans import read_table

_CUR_SQL = "CASE l_returnflag WHEN 'A' THEN 'CHF' WHEN 'N' THEN 'SEK' ELSE 'AUD' END"
SENTENCE_LABELS = ["O", "B-TENOR", "O", "B-CURRENCY", "O", "B-IPT"]

_SENTENCES_SQL = f"""
SELECT l_orderkey, l_linenumber, ['notes', CAST(floor(l_quantity) AS INTEGER) || 'y', 'paying', {_CUR_SQL}, 'near',
         'T+' || (CAST(round(l_discount * 1000) AS INTEGER) + 100)] AS tokens, {SENTENCE_LABELS} AS labels
FROM lineitem"""


def labelled_sentences(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem", spread=True)
    tenor = F.concat(F.floor("l_quantity").cast("int").cast("string"), F.lit("y"))
    cur = F.when(F.col("l_returnflag") == "A", "CHF").when(F.col("l_returnflag") == "N", "SEK").otherwise("AUD")
    spread = F.concat(F.lit("T+"), (F.round(F.col("l_discount") * 1000).cast("int") + 100).cast("string"))
    tokens = F.array(F.lit("notes"), tenor, F.lit("paying"), cur, F.lit("near"), spread)
    sid = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.monotonically_increasing_id())
    return li.select(sid.alias("sentence_id"), tokens.alias("tokens"), F.lit(SENTENCE_LABELS).alias("labels"))


def _line_item(rows: DataFrame, *columns) -> DataFrame:
    # the line-item key is part of the sentence id, so no join is needed
    parts = F.split("sentence_id", ":")
    return rows.select(parts[0].cast("bigint").alias("l_orderkey"), parts[1].cast("int").alias("l_linenumber"), *columns)


_TOKENS_SQL = f"""
SELECT l_orderkey, l_linenumber, CAST(p AS INTEGER) AS pos, tokens[p + 1] AS token, labels[p + 1] AS label,
       CAST(list_position({LABELS}, labels[p + 1]) - 1 AS INTEGER) AS label_id
FROM (SELECT *, unnest(range(6)) AS p FROM ({_SENTENCES_SQL}) s) t"""


@register("bio_tokens", _TOKENS_SQL)
def bio_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = label_indexer().transform(explode_labelled(labelled_sentences(spark, sf)))
    return _line_item(rows, "pos", "token", "label", F.col("label_id").cast("int").alias("label_id"))


def _tagged(spark: SparkSession, sf: str, nested: bool = False) -> DataFrame:
    """Train on every labelled sentence, save and reload the tagger, then tag
    the same sentences given as raw text."""
    s = labelled_sentences(spark, sf)
    path = scratch_path(spark, "tagger")
    save_tagger(train_tagger(s), path)
    texts = s.select("sentence_id", F.array_join("tokens", " ").alias("text"))
    return predict_path(load_tagger(path), explode_text(texts), adjacent=True, nested=nested)


@register("tag_tokens", f"SELECT l_orderkey, l_linenumber, pos, token, label FROM ({_TOKENS_SQL}) x")
def tag_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _line_item(_tagged(spark, sf), "pos", "token", F.col("predicted_label").alias("label"))


@register("tag_pairs", f"""
SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_zip(tokens, labels), lambda p: p[1] || '/' || p[2]), ' ') AS pairs
FROM ({_SENTENCES_SQL}) s""")
def tag_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each sentence with its labels, in token order."""
    pairs = F.transform("pairs", lambda p: F.concat_ws("/", p["token"], p["predicted_label"]))
    return _line_item(pair_labels(_tagged(spark, sf, nested=True)), F.array_join(pairs, " ").alias("pairs"))
