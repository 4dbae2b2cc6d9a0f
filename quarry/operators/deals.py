"""Deal messages -> one row per tranche.

A message is one text whose rows are ``Header<TAB>cell<TAB>cell...`` (one
cell per tranche, or one for the whole deal) and whose blocks are a label
line followed by one value per line.  Each message is walked once, in Arrow
batches (``functions.deal_rows``): no shuffle, and the work per row is bounded
by that message's length.

Fields are read in two ways:

* tabular - the first line whose header matches; its cleaned cells, one per
  tranche (missing cells read as null);
* block   - the first line that *is* the label; every non-blank line after it
  up to the next terminator label line (blocks of different fields may
  overlap; a tabular row never ends a block since the whole line is
  compared).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quarry.functions.deal import LABEL_SYNONYMS, decode_tenor, field_key, infer_tenor, terminator_keys
from quarry.functions.deal_rows import block_lines, table_tranches
from quarry.functions.patterns import ANY_PAREN
from quarry.functions.text import btrim_ws, let

# ---------------------------------------------------------------------------
# These must equal the reference's for the same results.
# Fields read from a table row / from a block, with their output column.
TABULAR_FIELDS = [
    ("Format", "format"), ("Ranking", "ranking"), ("Size", "size"),
    ("Coupon Type", "coupon_type"), ("Coupon", "coupon"), ("SOFR Convention", "sofr_convention"),
    ("IPT", "ipt"), ("Benchmark Treasury", "benchmark_treasury"), ("ISIN", "isin"), ("CUSIP", "cusip"),
    ("Par Redemption Date", "par_redemption_date"), ("Maturity", "maturity_date"),
    ("Next Interest Payment Date", "next_interest_payment_date"),
    ("Optional Redemption by Holder", "optional_redemption_by_holder"),
    ("Use of Proceeds", "use_of_proceeds"),
]
BLOCK_FIELDS = [("Label", "label"), ("Optional Redemption by Issuer", "optional_redemption_by_issuer"),
                ("Issue Date", "issue_date")]

TRANCHE_COLUMNS = [
    "tranche", "tenor", "tenor_maturity_years", "tenor_non_call_years", "label", "expected_ratings",
    "format", "ranking", "size", "coupon_type", "coupon", "sofr_convention", "ipt",
    "benchmark_treasury", "isin", "cusip", "par_redemption_date", "maturity_date",
    "next_interest_payment_date", "optional_redemption_by_holder", "optional_redemption_by_issuer",
    "use_of_proceeds",
]
# ---------------------------------------------------------------------------


KINDS = {"tenor_maturity_years": pa.int32(), "tenor_non_call_years": pa.int32(),
         "expected_ratings": pa.map_(pa.string(), pa.string())}


def arrow_call(run, kinds: pa.DataType, text: Column) -> Column:
    """A worker function of Arrow arrays as a column of type ``kinds``."""
    return F.arrow_udf(run, from_arrow_type(kinds))(text)


def tranches_of(text: Column, synonyms: dict | None = None, strict_labels: bool = False,
                ratings_label: str = "Expected Ratings", date_formats: tuple[str, ...] = ()) -> Column:
    """``array<struct<TRANCHE_COLUMNS>>`` of one message.

    Tranches: cells of the first ``Tenor`` row that has cells, else the length
    of the ``Tenor`` block, else 1."""
    syn = synonyms or LABEL_SYNONYMS
    columns = TRANCHE_COLUMNS if not date_formats else \
        [c for c in TRANCHE_COLUMNS if c not in ("tenor_maturity_years", "tenor_non_call_years")] + ["issue_date"]
    kinds = [pa.field(c, KINDS.get(c, pa.string())) for c in columns]
    tabular = {col: field_key(name, syn) for name, col in [("Tenor", "tenor"), *TABULAR_FIELDS]}
    blocks = {col: field_key(name, syn) for name, col in BLOCK_FIELDS}
    run = table_tranches(kinds, tabular, blocks, syn, terminator_keys(strict_labels, syn), ratings_label, infer=not date_formats)
    found = arrow_call(run, pa.list_(pa.struct(kinds)), text)
    if not date_formats:
        return found

    # further date patterns are Spark's, so these tenors are inferred by Spark
    def dated(t):
        tenor = F.coalesce(t["tenor"], infer_tenor(t["issue_date"], t["maturity_date"], date_formats))
        decoded = let(tenor, lambda x: F.struct(x.alias("tenor"), decode_tenor(x).alias("dec")))
        return let(decoded, lambda d: F.struct(*[{
            "tenor": d["tenor"], "tenor_maturity_years": d["dec"]["maturity_years"],
            "tenor_non_call_years": d["dec"]["non_call_years"]}.get(c, t[c]).alias(c) for c in TRANCHE_COLUMNS]))
    return F.transform(found, dated)


def with_tranches(messages: DataFrame, text_col: str = "text", id_col: str = "msg_id",
                  synonyms: dict | None = None, strict_labels: bool = False,
                  ratings_label: str = "Expected Ratings", keep: list[str] | None = None,
                  date_formats: tuple[str, ...] = ()) -> DataFrame:
    """Deal messages -> ``(msg_id, *keep, tranches)`` where ``tranches`` is
    the message's ``array<struct<TRANCHE_COLUMNS>>`` (still one row per
    message, so nested documents need no regrouping)."""
    return messages.select(F.col(id_col).alias("msg_id"), *(keep or []),
                           tranches_of(F.col(text_col), synonyms, strict_labels, ratings_label, date_formats).alias("tranches"))


def parse_tranches(messages: DataFrame, text_col: str = "text", id_col: str = "msg_id",
                   synonyms: dict | None = None, strict_labels: bool = False,
                   ratings_label: str = "Expected Ratings", date_formats: tuple[str, ...] = ()) -> DataFrame:
    """Deal messages -> tranche rows (``msg_id`` + ``TRANCHE_COLUMNS``)."""
    t = with_tranches(messages, text_col, id_col, synonyms, strict_labels, ratings_label, date_formats=date_formats)
    # An outer generator: for a non-outer one over a computed column Spark
    # infers ``size(tranches) > 0`` below it and substitutes the whole parse
    # into that filter, evaluating it three times.  Rows of an empty parse
    # are dropped by the null test instead.
    return t.select("msg_id", F.inline_outer("tranches")).where(F.col("tranche").isNotNull())


def reg_tagged_values(messages: DataFrame, field: str = "ISIN", text_col: str = "text",
                      id_col: str = "msg_id", synonyms: dict | None = None) -> DataFrame:
    """Block lines of ``field`` tagged by regulation and dealt round-robin to
    the tranches: ``(msg_id, tranche, item_no, reg_label, value)``.

    A line containing ``(Reg S)`` is tagged ``Reg S``, else ``(144A)`` ->
    ``144A``, else ``Unknown``; the value is the line without any
    parenthesised parts.  Line ``j`` goes to tranche ``j % n``.
    """
    syn = synonyms or LABEL_SYNONYMS
    kinds = pa.struct([pa.field("n", pa.int32()), pa.field("lines", pa.list_(pa.string()))])
    per_msg = arrow_call(block_lines(field_key(field, syn), syn, terminator_keys(False, syn), kinds), kinds, F.col(text_col))
    df = messages.select(F.col(id_col).alias("msg_id"), per_msg.alias("_m"))
    df = df.select("msg_id", F.col("_m.n").alias("_n"), F.posexplode("_m.lines").alias("j", "line"))
    tag = (F.when(F.col("line").contains("(Reg S)"), F.lit("Reg S"))
            .when(F.col("line").contains("(144A)"), F.lit("144A")).otherwise(F.lit("Unknown")))
    return df.select(
        "msg_id",
        F.concat(F.lit("Tranche "), (F.pmod("j", "_n") + 1).cast("string")).alias("tranche"),
        F.floor(F.col("j") / F.col("_n")).cast("int").alias("item_no"),
        tag.alias("reg_label"),
        btrim_ws(F.regexp_replace("line", ANY_PAREN, "")).alias("value"))
