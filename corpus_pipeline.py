"""The corpus pipeline: five stages over ``documents``, each written as
Parquet and read again as the next one's input.

1. quality rules: documents that fail the base rules or a learned rule go;
2. n-gram Jaccard join: of each group of (near) copies the document of the
   smallest id stays, a single row of it; documents without words stay;
3. benchmark decontamination: documents that hold a benchmark passage go;
4. personal data: spans are replaced by ``[kind]``, ``n_chars`` follows;
5. mixing: every column of the document, and how the mix takes it.

All but the last return the columns of ``documents``.  Stages decide and act per
row: null ids and ids of several texts are no key.  Columns beside id and text
go through an operator as one struct, so they may have any names; where the last
stage's own columns (``source_size``, ``taken`` ...) are names of the document's,
the document's are returned as ``document_<name>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, written
from quarry.llm.decontam import without_matches
from quarry.llm.mixing import mix_sources
from quarry.llm.ngram_join import one_of_each
from quarry.llm.pii import personal_data
from quarry.llm.quality_rules import quality_rules
from quarry.llm.queries import MIX_WEIGHTS


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _row``: all other columns in one struct, numbered."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.lit(None).cast("int")
    return docs.select("doc_id", "text", row.alias("_row"))


def unpacked(rows: DataFrame, docs: DataFrame, **given: Column) -> DataFrame:
    """The columns of ``docs`` back in their order; ``given`` replaces some."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    place = {c: F.col(f"_row.c{i}") for i, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return rows.select(*[given.get(c, place[c]).alias(c) for c in docs.columns])


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unpacked(quality_rules(packed(docs), table(spark, sf_dir, "labels"), carry=["_row"]).where("kept"), docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unpacked(one_of_each(packed(docs)), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_matches(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = personal_data(packed(docs), redact=True, carry=["_row"])
    return unpacked(out, docs, n_chars=F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select("doc_id", "text", "source", row.alias("_row"))
    out = mix_sources(rows, MIX_WEIGHTS, carry=["_row"])
    own = [c for c in out.columns if c != "_row"]
    same = {"doc_id", "source"}                            # one column: the mix returns the document's
    return out.select(*own, *[F.col(f"_row.c{i}").alias(f"document_{c}" if c in own else c)
                              for i, c in enumerate(docs.columns) if c not in same])


STAGES = [("quality_rules", rules_stage), ("near_copies", near_copies_stage), ("decontamination", decontamination_stage),
          ("personal_data", personal_data_stage), ("mixing", mixing_stage)]

#: Learned rules, alignment and a network are not SQL: the stages are tested
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
