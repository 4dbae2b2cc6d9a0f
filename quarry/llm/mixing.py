"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

DataFrame functions only.  Every document gets the key ``-ln(u) / w`` with a
uniform ``u`` from the hash of its id and ``w`` from its quality; the smallest
keys win.  A source whose target is ``e`` whole epochs and a remainder takes
every document ``e`` times, then the documents of the smallest keys until the
remainder's token budget is met.

The prefix sum over a source never sorts the source.  Keys ``k`` are cut into
GRID * GRID cells of ``k / (1 + k)``, which spreads the keys of every weight:
sums of sizes per cell (partial sums before the shuffle) tell which cells lie
wholly inside or outside the budget.  In the one cell of each source that holds
the border, rows of equal key, id and size are counted first, and those counts
are ordered; where the border falls among such rows, a place among the equal
ones (counts per part of the written table, summed) tells which are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Cells per level.
GRID = 1024
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>0123456789"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of characters that are no digits or symbols."""
    n = F.length(text)
    plain = F.length(F.translate(text, SYMBOLS, ""))
    return F.when(n > 0, 0.1 + 0.9 * plain / n).otherwise(F.lit(0.1))


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 48 bits of the key's MD5; null is the empty text."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, take ``weights`` in turn.  Targets are
    ``min(level * weight, most * source_size)`` with the level at which they
    add up to ``share`` of all sizes (less only where every source is at its
    cap).  One row per source is ordered here, never rows of documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    # sources reach their cap in the order of cap / weight
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * float(share)
    rest_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rest = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", rest / rest_w)
    # the first source that stays below its cap sets the level for all
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(
        F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"])
    target = F.coalesce(F.least(F.col("level") * F.col("w"), F.col("cap")), F.col("cap"))
    return s.select("source", "source_size", target.alias("target"))


def _border_rows(rows: DataFrame) -> DataFrame:
    """``rows`` of the border cells with ``extra``: 1 for those that the budget
    still takes, in the order of key, id and size."""
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    same = ["source", "draw", "doc_id", "size"]
    groups = rows.groupBy(*same, "below2", "budget").agg(F.count(F.lit(1)).alias("m"))
    run = Window.partitionBy("source").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("budget") - F.col("below2") - F.coalesce(F.sum(F.col("m") * F.col("size")).over(run), F.lit(0)) - F.col("size") / 2.0
    # of m equal rows, those whose middle lies inside the budget
    fit = F.when(F.col("size") == 0, F.when(room >= 0, F.col("m")).otherwise(0)).otherwise(
        F.greatest(F.lit(0), F.least(F.col("m"), F.floor(room / F.col("size")) + 1)))
    groups = written(groups.select(*[F.col(c).alias(f"g_{c}") for c in same], "m", fit.cast("long").alias("fit")), "mix-equal")
    on = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in same]
    met = rows.join(groups, on).drop(*[f"g_{c}" for c in same])
    whole = met.where("fit = 0 or fit = m").withColumn("extra", (F.col("fit") > 0).cast("long"))
    # the equal rows at the border itself are numbered, part by part
    part = F.shiftright("_id", 33)
    some = met.where("fit > 0 and fit < m").withColumn("part", part)
    per = some.groupBy(*same, "part").agg(F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("start", F.coalesce(F.sum("k").over(earlier), F.lit(0)))
    per = per.select(*[F.col(c).alias(f"g_{c}") for c in same], F.col("part").alias("g_part"), "start")
    within = F.row_number().over(Window.partitionBy(*same, "part").orderBy("_id")) - 1
    some = (some.withColumn("within", within).join(per, [*on, F.col("part") == F.col("g_part")])
            .withColumn("extra", (F.col("start") + F.col("within") < F.col("fit")).cast("long")))
    keep = [c for c in whole.columns if c not in ("_id", "m", "fit")]
    return whole.select(keep).unionByName(some.select(keep))


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0,
                text: str = "text", key: str = "doc_id", source: str = "source",
                carry: list[str] | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, times, taken`` for every row.

    ``times`` is how often the mix repeats the document, ``taken`` its words
    with repeats.  The document at the border of a budget is taken if at
    least half of it fits.  Null text: size 0, weight 0.1.  Null source: a
    source of its own.  Null key: drawn as the empty text.  Rows of equal key
    are ordered by size; repeated rows are drawn one by one.  Empty input:
    no rows.  ``carry`` names further columns to keep; they may have any names
    but those of the result.
    """
    carry = carry or []
    u = uniform(F.col(key))
    kept = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                       (-F.log(u) / quality_weight(F.col(text))).alias("draw"), kept.alias("kept"))
    cell = F.floor(F.col("draw") / (1.0 + F.col("draw")) * float(GRID * GRID))
    rows = written(rows.withColumn("cell", F.least(cell, F.lit(GRID * GRID - 1)).cast("long")), "mix")
    coarse = (rows.groupBy("source", F.floor(F.col("cell") / GRID).cast("long").alias("c1"))
              .agg(F.sum("size").alias("n")))
    sizes = coarse.groupBy("source").agg(F.sum("n").alias("source_size"))
    plan = (source_targets(sizes, weights, share, most)
            .withColumn("epochs", F.when(F.col("source_size") > 0,
                                         F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
            .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = written(plan, "mix-plan")          # one row per source; Spark broadcasts it while it is small
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    def border(cells: DataFrame, start: Column) -> DataFrame:
        """The cell in which each source's running sum passes its budget."""
        run = Window.partitionBy("source").orderBy("at")
        c = cells.withColumn("upto", F.sum("n").over(run) + start)
        hit = c.where(F.col("upto") >= F.col("budget")).groupBy("source").agg(
            F.min_by(F.struct("at", (F.col("upto") - F.col("n")).alias("below")), "at").alias("b"))
        return hit.select("source", "b.at", "b.below")

    # level 1: at most GRID cells per source
    one = border(coarse.withColumnRenamed("c1", "at").join(plan.select(F.col("source").alias("s"), "budget"),
                                                           same("source", "s")).drop("s"), F.lit(0.0))
    one = one.select(F.col("source").alias("s1"), F.col("at").alias("at1"), F.col("below").alias("below1"))
    # level 2: the GRID cells inside the border cell
    fine = (rows.join(one, same("source", "s1") & (F.floor(F.col("cell") / GRID) == F.col("at1")))
            .groupBy("source", F.col("cell").alias("at"), "below1").agg(F.sum("size").alias("n"))
            .join(plan.select(F.col("source").alias("s"), "budget"), same("source", "s")).drop("s"))
    two = border(fine, F.col("below1"))
    two = written(two.select(F.col("source").alias("s2"), F.col("at").alias("at2"), F.col("below").alias("below2")),
                  "mix-border")
    got = (rows.join(plan.withColumnRenamed("source", "s"), same("source", "s"), "left").drop("s")
           .join(two, same("source", "s2"), "left").drop("s2"))
    # no border: the whole source fits into its budget (only an empty source does)
    outside = got.where(F.col("at2").isNull() | (F.col("cell") != F.col("at2"))).withColumn(
        "extra", F.coalesce((F.col("cell") < F.col("at2")).cast("long"), F.lit(0).cast("long")))
    out = _border_rows(got.where(F.col("cell") == F.col("at2"))).unionByName(outside)
    most_times = F.lit(int(most)).cast("long")
    times = F.least(F.col("epochs") + F.col("extra"), most_times)
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"),
                      "target", times.alias("times"), (times * F.col("size")).alias("taken"),
                      *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(carry)])
