"""Column functions for deal-message parsing (labels, cells, tenors).

Labels are compared through a *label key*: lower-cased, every ``:``
removed, whitespace-stripped, then mapped through the synonym table.  Two
labels match exactly when their keys are equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.patterns import CELL_SEP, TENOR_NC, TRAILING_PAREN
from quarry.functions.text import btrim_ws, let

# ---------------------------------------------------------------------------
# These must equal the reference's for the same results.
# Label synonyms: lower-case label without colons -> field name.
LABEL_SYNONYMS = {
    "maturity": "Maturity Date",
    "maturity date": "Maturity Date",
    "coupontype": "Coupon Type",
    "coupon type": "Coupon Type",
    "benchmark": "Benchmark Treasury",
    "benchmark treasury": "Benchmark Treasury",
    "issue date": "Issue Date",
    "expected ratings": "Expected Ratings",
}

# Field labels that may end a block, in the reference's order.
FIELD_LABELS = [
    "Label", "Tenor", "Format", "Ranking", "Size", "Coupon Type", "Coupon",
    "SOFR Convention", "IPT", "Benchmark Treasury", "ISIN", "CUSIP",
    "Par Redemption Date", "Maturity", "Maturity Date", "Issue Date",
    "Next Interest Payment Date", "Optional Redemption by Holder",
    "Optional Redemption by Issuer", "Use of Proceeds", "Expected Ratings",
]
# ---------------------------------------------------------------------------


def _reachable(label: str, synonyms: dict[str, str]) -> bool:
    """Can a normalised line ever equal ``label``?  A normalised name is a
    synonym target or the title-cased label text, so labels that are not in
    title case (``IPT``, ``Use of Proceeds``) are never produced, and
    ``Maturity`` is always rewritten by its synonym."""
    low = label.lower()
    return label in synonyms.values() or (low not in synonyms and low.title() == label)


def terminator_keys(strict: bool = False, synonyms: dict[str, str] | None = None) -> list[str]:
    """Label keys that end a block.

    Default: only the labels a normalised line can actually equal (the
    reference compares title-cased names with this list, which leaves 13).
    ``strict=True``: every listed label.
    """
    syn = synonyms or LABEL_SYNONYMS
    keys = []
    for lab in FIELD_LABELS:
        if strict or _reachable(lab, syn):
            k = syn.get(lab.lower(), lab).lower()
            if k not in keys:
                keys.append(k)
    return keys


def _syn_map(synonyms: dict[str, str] | None) -> Column:
    syn = synonyms or LABEL_SYNONYMS
    return F.create_map(*[x for k, v in syn.items() for x in (F.lit(k), F.lit(v.lower()))])


def label_key(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Comparison key of a label."""
    # bound once: the key is looked up and, where it is no synonym, returned
    return let(btrim_ws(F.replace(F.lower(c), F.lit(":"), F.lit(""))),
               lambda k: F.coalesce(F.try_element_at(_syn_map(synonyms), k), k))


def field_key(name: str, synonyms: dict[str, str] | None = None) -> str:
    """Python-side label key of a field name (same rule as ``label_key``)."""
    k = name.lower().replace(":", "").strip()
    return (synonyms or LABEL_SYNONYMS).get(k, k).lower()


def split_cells(line: Column) -> Column:
    """Row -> cells: split on tab runs or runs of 2+ whitespace.  The first
    cell is the row header.  ``A<TAB><TAB>B`` gives 2 cells, ``A<TAB> <TAB>B``
    gives 3 with an empty middle one."""
    return F.split(btrim_ws(line), CELL_SEP, -1)


def clean_cell(c: Column) -> Column:
    """Strip surrounding ``*``, strip, drop a trailing parenthesised part
    (cut from the first ``(`` when the cell ends in ``)``), strip; empty ->
    null."""
    # each step is bound once (``let``): inside array lambdas there is no
    # common-subexpression elimination, and when/nullif repeat their inputs
    def cut(x):
        # the parenthesis rule can only apply to a (stripped) cell ending in ')'
        return F.when(x.endswith(")"), btrim_ws(F.regexp_replace(x, TRAILING_PAREN, ""))).otherwise(x)
    # leading and trailing '*' runs: a btrim over '*'
    return let(btrim_ws(F.btrim(c, F.lit("*"))), lambda x: let(cut(x), lambda y: F.when(y != "", y)))


def decode_tenor(tenor: Column) -> Column:
    """``11NC10`` / ``11 nc 10`` anywhere in the text -> struct(11, 10); else nulls."""
    pat = TENOR_NC
    found = F.regexp_extract_all(tenor, F.lit(pat), F.lit(0))

    def decode(first):
        groups = F.struct(F.regexp_extract(first, pat, 1).alias("m"), F.regexp_extract(first, pat, 2).alias("nc"))
        return let(groups, lambda g: F.struct(g["m"].try_cast("int").alias("maturity_years"),
                                              g["nc"].try_cast("int").alias("non_call_years")))
    empty = F.struct(F.lit(None).cast("int").alias("maturity_years"),
                     F.lit(None).cast("int").alias("non_call_years"))
    # the first match is found once; only a matching tenor is parsed further
    return let(F.get(found, 0), lambda first: F.when(first.isNull(), empty).otherwise(decode(first)))


# ISO ``yyyy-m-d`` as ``strptime('%Y-%m-%d')`` accepts it (4-digit year,
# 1-2 digit month and day, day may be space-padded).
_ISO_DATE = r"^[0-9]{4}-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])$"


def _iso_date(c: Column) -> Column:
    ok = c.rlike(_ISO_DATE) & ~c.startswith("0000")
    return F.when(ok, F.try_to_date(F.replace(c, F.lit(" "), F.lit("")), "yyyy-M-d"))


def infer_tenor(issue_date: Column, maturity_date: Column, formats: tuple[str, ...] = ()) -> Column:
    """Whole years between two dates (``days // 365``) as ``'<n>Y'``; null
    when either is missing or not a date.  Dates are ISO; ``formats`` adds
    further Spark date patterns (``'MMMM d, yyyy'``), tried in order."""
    def date(c: Column) -> Column:
        return F.coalesce(_iso_date(c), *[F.try_to_date(btrim_ws(c), f) for f in formats])
    days = F.datediff(date(maturity_date), date(issue_date))
    return F.concat(F.floor(days / 365).cast("int").cast("string"), F.lit("Y"))
