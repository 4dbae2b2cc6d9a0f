"""Whole-message fields and the draft (line-oriented) deal layouts.

These read a message with a handful of regular expressions over the raw
text, as the earlier draft parser does: the issuer, the issuer ratings, the
settlement line, fields taken from the lines following a label, and the
tenor list.  The fields of the draft layouts are read in Arrow batches
(``functions.deal_rows``); documents with nested tranches are assembled in
the same row, so there is no regrouping shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.deal_rows import line_group_tranches, three_line_tranches
from quarry.functions.patterns import ISSUER, RATING_AGENCIES, SETTLEMENT, TENOR_LINE, rating_line
from quarry.functions.text import btrim_ws, split_words
from quarry.operators.deals import KINDS, arrow_call, tranches_of

# ---------------------------------------------------------------------------
# These must equal the reference's for the same results.
# Optional redemption terms of a tranche whose label contains TLAC, and of others.
REDEMPTION_TLAC = [
    "Optional Redemption Dates (1 year par call prior to maturity)",
    "Certain tax events (any time)",
    "Loss Absorption Disqualification Event",
    "Make Whole Call 6 month from issue date to 1 year prior to maturity",
]
REDEMPTION_OTHER = [
    "Optional Redemption Dates (1 year par call prior to maturity)",
    "Certain tax events (any time)",
    "Capital Disqualification Event",
]
# Draft field labels (used as regular expressions, as the draft does) and
# their output columns.
DRAFT_FIELDS = [
    ("Format", "format"), ("Ranking", "ranking"), ("Size", "size"), ("Coupon Type", "coupon_type"),
    ("Coupon", "coupon"), ("SOFR Convention", "sofr_convention"), ("IPTs", "ipt"),
    ("Benchmark Treasury", "benchmark_treasury"), ("ISIN", "isin"), ("CUSIP", "cusip"),
    ("Par Redemption Date", "par_redemption_date"), ("Maturity Date", "maturity_date"),
    ("Next Interest Payment Date", "next_interest_payment_date"),
    ("Optional Redemption by Holder", "optional_redemption_by_holder"),
    ("Use of Proceeds", "use_of_proceeds"),
]
# ---------------------------------------------------------------------------


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, or null when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def issuer(text: Column) -> Column:
    """``Issuer/Ticker <name> (`` -> name."""
    return btrim_ws(_extract(text, ISSUER))


def issuer_ratings(text: Column) -> Column:
    """First ``Moody's:``, ``S&P:``, ``Fitch:`` value, each to the end of
    its line: ``map<string,string>`` (null value when absent)."""
    return F.create_map(*[x for name, pat in RATING_AGENCIES
                          for x in (F.lit(name), btrim_ws(_extract(text, rating_line(pat))))])


def settlement(text: Column) -> Column:
    return btrim_ws(_extract(text, SETTLEMENT))


def with_constants(df: DataFrame, constants: dict[str, str]) -> DataFrame:
    """Caller-supplied whole-deal attributes (ticker, bookrunner, listing,
    governing law, ...) as literal columns."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def tenor_list(text: Column) -> Column:
    """``Tenor <cells>`` on one line -> whitespace-separated tenors."""
    return split_words(btrim_ws(_extract(text, TENOR_LINE)))


def redemption_terms(label: str | None, tlac: list[str] | None = None,
                     other: list[str] | None = None) -> list[str] | None:
    if label is None:
        return None
    return (tlac or REDEMPTION_TLAC) if "TLAC" in label else (other or REDEMPTION_OTHER)


def draft_tranches(messages: DataFrame, layout: str = "line_group", text_col: str = "text",
                   id_col: str = "msg_id", label: str = "TLAC", tenors: list[str] | None = None,
                   labels: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Draft parser: ``(msg_id, tranches array<struct>)`` per message.

    ``line_group``: one tranche per whitespace-separated tenor; every field
    is the group of lines following its label.  ``three_line``: three
    tranches; every field is the three lines after its label; ``tenors``
    and ``labels`` are supplied by the caller (the draft hard-codes them).
    """
    return messages.select(F.col(id_col).alias("msg_id"), *(keep or []),
                           draft_tranches_of(F.col(text_col), layout, label, tenors, labels).alias("tranches"))


def draft_tranches_of(text: Column, layout: str = "line_group", label: str = "TLAC",
                      tenors: list[str] | None = None, labels: list[str] | None = None) -> Column:
    """``array<struct>`` of the tranches of one message."""
    fields = {col: lab for lab, col in DRAFT_FIELDS}
    kinds = [pa.field("tranche_no", pa.int32()), *[pa.field(c, KINDS.get(c, pa.string())) for c in (
        "tenor", "label", "expected_ratings", *fields)], pa.field("optional_redemption_by_issuer", pa.list_(pa.string()))]
    if layout == "line_group":
        run = line_group_tranches(kinds, fields, label, redemption_terms(label))
    elif layout == "three_line":
        def three(values):
            return [*values, None, None, None][:3]
        labs = three(labels or [label] * 3)
        run = three_line_tranches(kinds, fields, three(tenors or []), labs, [redemption_terms(x) for x in labs])
    else:
        raise ValueError("layout must be 'line_group' or 'three_line'")
    return arrow_call(run, pa.list_(pa.struct(kinds)), text)


def deal_documents(messages: DataFrame, parser: str = "draft", text_col: str = "text",
                   id_col: str = "msg_id", constants: dict[str, str] | None = None) -> DataFrame:
    """One document per message: issuer, ratings, settlement, constants and
    the nested ``tranches`` - from the draft line-group layout
    (``parser='draft'``) or the table parser (``parser='table'``).  Globals
    and tranches come from the same row, so nothing is regrouped."""
    if parser not in ("draft", "table"):
        raise ValueError("parser must be 'draft' or 'table'")
    tx = F.col("text")
    # the text is read more than once, so Spark keeps it a column of its own
    out = messages.select(F.col(id_col).alias("msg_id"), F.col(text_col).alias("text")).select(
        "msg_id", issuer(tx).alias("issuer"), issuer_ratings(tx).alias("ratings"), settlement(tx).alias("settlement"),
        (draft_tranches_of if parser == "draft" else tranches_of)(tx).alias("tranches"))
    return with_constants(out, constants) if constants else out


def to_json_documents(docs: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """``(msg_id, json)``: every other column as one JSON object, nulls kept."""
    cols = [c for c in docs.columns if c != id_col]
    return docs.select(id_col, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_json(docs: DataFrame, path: str) -> None:
    """JSON-lines export, nulls kept."""
    docs.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
