"""Merkle manifest of a dataset: per-language trees of fan-out eight under one
root, built level by level from lag and lead columns.

Leaves are placed by a range shuffle of their keys (no text is shuffled), so a
language of any size is spread.  A level's windows are cut into blocks of whole
runs: runs never cross a block, and no window group holds more than ``BLOCK``
rows.  Every level is a table in the shared scratch folder; paths are joined
from the root downwards, eight children to a node.

Nulls are hashed as ``-``; rows of one ``doc_id`` (also of a null one, which
comes first) follow each other by leaf, and equal rows are leaves of their own.
An empty table has no rows and no root.  Only the five hashed columns are
read, so other columns of any name do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import join_by_key, written

FAN = 8
#: Nodes of a window group: a power of the fan-out.
BLOCK = FAN ** 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(value: Column) -> Column:
    """``-`` for a null, else the value's UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: dict[str, Column] | None = None) -> Column:
    """Leaf of a document; ``values`` stand in for columns of ``FIELDS``."""
    values = values or {}
    return F.sha2(F.concat(*[encoded(values.get(c, F.col(c))) for c in FIELDS]), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (a written table) with ``at``, their place from 0 in ``order``.

    One range shuffle; what is summed over is a count per partition.  A row
    number of the input breaks ties, so equal keys are spread as well.
    """
    keys = [F.col(c).asc_nulls_first() for c in order] + [F.col("_tie")]
    laid = written(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
                   .sortWithinPartitions(*keys).drop("_tie").withColumn("_id", F.monotonically_increasing_id()), name)
    # the id holds the partition above bit 33 and the place in it below
    laid = laid.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))      # a row per partition
    return (laid.join(F.broadcast(starts), "_part").withColumn("at", F.col("_start") + F.col("_row"))
            .drop("_part", "_row", "_id", "_start"))


def level(nodes: DataFrame) -> DataFrame:
    """``nodes (tree, pos, n, node, ...)`` of trees of ``n > 1`` nodes with
    ``before`` and ``after``: their siblings' digests, joined."""
    w = Window.partitionBy("tree", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    slot = F.col("pos") % FAN
    run = F.least(F.lit(FAN), F.col("n") - F.col("pos") + slot)
    before = [F.when(slot >= k, F.lag("node", k).over(w)).otherwise("") for k in range(FAN - 1, 0, -1)]
    after = [F.when(slot + k < run, F.lead("node", k).over(w)).otherwise("") for k in range(1, FAN)]
    return nodes.where("n > 1").withColumns({"before": F.concat(*before), "after": F.concat(*after)})


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: each run's first child hashes the run."""
    return (nodes.where(F.col("pos") % FAN == 0)
            .select("tree", (F.col("pos") / FAN).cast("long").alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n"),
                    F.sha2(F.concat("node", "after"), 256).alias("node")))


def build(nodes: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees over ``nodes`` (the largest of ``most`` nodes) and
    their roots ``(tree, height, node)``."""
    columns = ["tree", "pos", "n", "node"]
    levels, height = [], 0
    roots = nodes.where("n = 1").select("tree", F.lit(0).alias("height"), "node")
    while most > 1:
        levels.append(written(level(nodes), f"{name}-{height}"))
        nodes = parents(levels[-1]).select(columns)
        height += 1
        roots = roots.unionByName(nodes.where("n = 1").select("tree", F.lit(height).alias("height"), "node"))
        most = -(-most // FAN)
    return levels, roots


def paths(levels: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """Rows ``tree, pos, *keep, steps`` of the lowest level of every tree.
    ``tops (tree, height, steps, *keep)`` is where a tree's own path ends;
    steps are ``(before, after)``, lowest first."""
    at = len(levels)
    above = tops.where(F.col("height") == at).select("tree", F.lit(0).cast("long").alias("pos"), "steps", *keep)
    for lower in reversed(levels):
        at -= 1
        up = above.select("tree", F.col("pos").alias("_up"), F.col("steps").alias("_steps"), *keep)
        own = lower.select("tree", "pos", "before", "after", (F.col("pos") / FAN).cast("long").alias("_up"))
        step = F.array(F.struct("before", "after"))
        above = (own.join(up, ["tree", "_up"]).select("tree", "pos", F.concat(step, "_steps").alias("steps"), *keep)
                 .unionByName(tops.where(F.col("height") == at).select("tree", F.lit(0).cast("long").alias("pos"), "steps", *keep)))
    return above


def folded(start: Column, steps: Column) -> Column:
    """The root that ``start`` leads to along ``steps``."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_hash(steps: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(steps, lambda s: F.concat(s["before"], s["after"]))), 256)


@dataclass
class Manifest:
    """``leaves``: tree, pos, leaf, subroot, ``steps`` and the carried columns,
    a row per document; ``root``: None without rows."""

    root: str | None
    leaves: DataFrame


def merkle_manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> Manifest:
    """Build the manifest of ``docs``; ``carry`` gives short columns to keep
    with the leaves (``doc_id`` is always kept)."""
    carry = carry or {}
    no_steps = F.array().cast("array<struct<before:string,after:string>>")
    leaves = written(docs.select("doc_id", "lang", encoded(F.col("lang")).alias("_lang"), leaf_hash().alias("node"),
                                 *[c.alias(f"_carry_{k}") for k, c in carry.items()]), "merkle-leaves")
    placed = numbered(leaves, ["lang", "doc_id", "node"], "merkle-order")
    # a tree is known by its first leaf's place, which also orders the languages
    trees = written(placed.groupBy("_lang").agg(F.min("at").alias("tree"), F.count(F.lit(1)).alias("n")), "merkle-trees")
    nodes = (join_by_key(placed, trees, "_lang", "n").drop("_lang", "lang")
             .withColumn("pos", F.col("at") - F.col("tree")).drop("at"))
    levels, roots = build(nodes, trees.agg(F.max("n")).first()[0] or 0, "merkle-level")
    roots = written(roots, "merkle-roots")

    # the languages' roots are the leaves of one more tree
    order = numbered(roots.withColumnRenamed("tree", "_tree"), ["_tree"], "merkle-languages")
    count = roots.count()
    heads = order.select(F.lit(0).cast("long").alias("tree"), F.col("at").alias("pos"), F.lit(count).cast("long").alias("n"), "node")
    head_levels, head_roots = build(heads, count, "merkle-top")
    root = head_roots.first()
    top = paths(head_levels, head_roots.select("tree", "height", no_steps.alias("steps")), [])
    tops = written(order.join(top.select(F.col("pos").alias("at"), "steps"), "at")
                   .select(F.col("_tree").alias("tree"), "height", F.col("node").alias("subroot"), "steps"), "merkle-tops")

    names = ["tree", "pos", "doc_id", F.col("node").alias("leaf"), *[F.col(f"_carry_{k}").alias(k) for k in carry], "subroot", "steps"]
    way = nodes.where("n = 1").join(tops.where("height = 0"), "tree").select(names)
    if levels:
        up = paths(levels[1:], tops.withColumn("height", F.col("height") - 1), ["subroot"])
        up = up.select("tree", F.col("pos").alias("_up"), F.col("steps").alias("_steps"), "subroot")
        below = (levels[0].withColumn("_up", (F.col("pos") / FAN).cast("long")).join(up, ["tree", "_up"])
                 .withColumn("steps", F.concat(F.array(F.struct("before", "after")), "_steps")))
        way = below.select(names).unionByName(way)
    return Manifest(root["node"] if root else None, way)


def tamper_check(docs: DataFrame) -> DataFrame:
    """Fold every document's leaf to the root with its original siblings, the
    leaves of the documents whose crc32 of the decimal id is a multiple of 3
    taken from the text with A-Z lower-cased (a null id is left alone)."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = merkle_manifest(docs, {"tampered": F.when(chosen, leaf_hash({"text": lowered}))})
    root = F.lit(made.root).cast("string")
    fold = folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    return (made.leaves.withColumn("folded_root", fold)
            .select("doc_id", "leaf", "subroot", root.alias("root"), proof_hash(F.col("steps")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == root).alias("verified")))
