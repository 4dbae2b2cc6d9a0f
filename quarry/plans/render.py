"""Deal messages rendered from the test tables: one message per order, one
tranche per line item (ordered by line number).  The values come straight
from the table columns, so the expected parse of every message can be
computed from the same tables in SQL.

The only shuffle is the join of ``lineitem`` and ``orders`` on the order key,
of the tables' own columns; the cells are made behind it, those of the layout
only, and the grouping into messages reuses its partitioning.  A message holds
one order's lines, so its size is bounded by the lines per order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.scans import read_table

MOODYS = ["Aa2", "B1", "Caa2"]
SP = ["AA", "B+", "CCC"]
FITCH = ["AA-", "B", "CCC+"]


def _pick(values: list[str], key: Column) -> Column:
    """The value of a key; the last one where the key is null."""
    at = (F.pmod(key, F.lit(len(values))) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.coalesce(at, F.lit(-1)))


def _long_date(c: Column) -> Column:
    return F.date_format(c, "MMMM d, yyyy")


# Tranche order inside a message: line number, then every other column, so
# that repeated line numbers still give one fixed order.
ORDER_COLS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def tranche_cells() -> dict[str, Column]:
    """Per line item: the cell text of each field of its tranche."""
    q = F.floor("l_quantity").cast("int")
    number = F.col("l_linenumber").cast("string")
    line_id = F.concat(F.col("l_orderkey").cast("string"), F.lit("L"), number)
    return {
        "tenor": F.when(F.col("l_linenumber") % 2 == 1, F.concat(q.cast("string"), F.lit("NC"), (q - 1).cast("string")))
                  .otherwise(F.concat(q.cast("string"), F.lit("Y"))),
        "format": F.when(F.col("l_linestatus") == "O", F.lit("SEC Registered")).otherwise(F.lit("Reg S / 144A")),
        "ranking": F.when(F.col("l_returnflag") == "R", F.lit("Senior Secured (Covered)"))
                    .when(F.col("l_returnflag") == "A", F.lit("Subordinated (Tier 2)"))
                    .otherwise(F.lit("Senior Unsecured")),
        "size": F.concat(F.lit("USD "), F.floor("l_extendedprice").cast("string")),
        "coupon_type": F.when(F.col("l_discount") >= 0.05, F.lit("Fixed-to-Float")).otherwise(F.lit("Fixed Rate")),
        "coupon": F.concat(F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit("% semi-annual")),
        "ipt": F.concat(F.lit("T+["), F.round(F.col("l_discount") * 1000).cast("int").cast("string"),
                        F.lit("bps] area")),
        "benchmark": F.concat(F.lit("UST "), F.year("l_shipdate").cast("string")),
        "isin": F.concat(F.lit("**US"), line_id, F.lit("**")),
        "cusip": F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")),
        "maturity": F.concat(F.lit("**"), _long_date("l_shipdate"), F.lit("**")),
        "maturity_iso": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "series": F.concat(F.lit("Series "), number),
        "label": F.when(F.col("l_returnflag") == "A", F.lit("TIER 2")).otherwise(F.lit("TLAC")),
        "moodys": F.concat(F.lit("Moody's: "), _pick(MOODYS, F.col("l_partkey"))),
        "sp": F.concat(F.lit("S&P: "), _pick(SP, F.col("l_suppkey"))),
        "isin_144a": F.concat(F.lit("US"), line_id, F.lit(" (144A)")),
        "isin_reg_s": F.concat(F.lit("XS"), line_id, F.lit(" (Reg S)")),
    }


def _grouped(spark: SparkSession, sf: str, fields: list[str]) -> DataFrame:
    """Per order: its lines' cells of the given fields, in tranche order."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", *ORDER_COLS)
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey)
    cells = tranche_cells()
    line = F.struct(*[F.col(c).alias(f"k_{c}") for c in ORDER_COLS], *[cells[f].alias(f) for f in fields])
    return joined.groupBy("l_orderkey", "o_custkey", "o_orderdate").agg(F.sort_array(F.collect_list(line)).alias("t"))


def _cells(field: str, sep: str = "\t") -> Column:
    return F.array_join(F.col("t")[field], sep)


def _each(value: Column, sep: str) -> Column:
    """A text that is the same for every tranche."""
    return F.array_join(F.array_repeat(value, F.size("t")), sep)


def _row(header: str, field: str) -> Column:
    return F.concat(F.lit(header + "\t"), _cells(field))


def tabular_messages(spark: SparkSession, sf: str, rate_null: bool = True) -> DataFrame:
    """``(msg_id, text)`` in the one-column-per-tranche layout.  An order without
    a customer is rated as the last kind is; without ``rate_null`` it has no
    rating lines."""
    g = _grouped(spark, sf, ["tenor", "format", "ranking", "size", "coupon_type", "coupon", "ipt", "benchmark", "isin",
                             "cusip", "maturity"])
    cust = F.col("o_custkey").cast("string")

    def rating(values: list[str]) -> Column:
        value = F.concat(_pick(values, F.col("o_custkey")), F.lit(" (Stable)"))
        return value if rate_null else F.when(F.col("o_custkey").isNotNull(), value)

    lines = [
        F.concat(F.lit("$$ New Deal: Issuer "), cust, F.lit(" plc (C"), cust, F.lit(") | $ "),
                 _cells("tenor", " & "), F.lit(" $$")),
        F.lit("\t\t\t"),
        F.concat(F.lit("Issuer/Ticker\tIssuer "), cust, F.lit(" plc (“C"), cust, F.lit("”)")),
        F.concat(F.lit("Issuer Ratings*\tMoody's: "), rating(MOODYS)),
        F.concat(F.lit("S&P: "), rating(SP)),
        F.concat(F.lit("Fitch: "), rating(FITCH)),
        _row("Tenor", "tenor"),
        _row("Format", "format"),
        _row("Ranking ", "ranking"),
        _row("Size", "size"),
        _row("Coupon Type", "coupon_type"),
        _row("Coupon", "coupon"),
        _row("IPTs", "ipt"),
        _row("Benchmark Treasury", "benchmark"),
        _row("ISIN ", "isin"),
        _row("CUSIP", "cusip"),
        _row("Maturity Date", "maturity"),
        F.concat(F.lit("Optional Redemption by Holder"), _each(F.lit("\tNone"), "")),
        F.concat(F.lit("Settlement\t**"), _long_date("o_orderdate"), F.lit("** (T+5)")),
        F.lit("Use of Proceeds\tGeneral corporate purposes"),
    ]
    return g.select(F.col("l_orderkey").cast("string").alias("msg_id"),
                    F.concat_ws("\n", *lines).alias("text"))


def block_messages(spark: SparkSession, sf: str) -> DataFrame:
    """``(msg_id, text)`` in the block layout: label lines with one value per
    line below, a tabular maturity row, a ratings block and an ISIN block
    with regulation tags."""
    g = _grouped(spark, sf, ["series", "label", "maturity_iso", "moodys", "sp", "isin_144a", "isin_reg_s"])
    cust = F.col("o_custkey").cast("string")
    lines = [
        F.concat(F.lit("$$ New Deal: Issuer "), cust, F.lit(" plc | block layout $$")),
        F.lit("Optional Redemption by Issuer"),
        _each(F.concat(F.lit("- Par call from year "), (F.year("o_orderdate") + 1).cast("string")), "\n"),
        F.lit("Tenor"),
        _cells("series", "\n"),
        F.lit("Label"),
        _cells("label", "\n"),
        F.lit("Issue Date"),
        _each(F.date_format("o_orderdate", "yyyy-MM-dd"), "\n"),
        _row("Maturity Date", "maturity_iso"),
        F.lit("Expected Ratings"),
        _cells("moodys", "\n"),
        _cells("sp", "\n"),
        F.lit(""),
        F.lit("ISIN"),
        _cells("isin_144a", "\n"),
        _cells("isin_reg_s", "\n"),
    ]
    return g.select(F.col("l_orderkey").cast("string").alias("msg_id"),
                    F.concat_ws("\n", *lines).alias("text"))
