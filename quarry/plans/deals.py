"""Registered deal-message queries.  Messages are rendered from every order
and its line items (``plans.render``); the oracles compute the expected
parse directly from the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.deal import infer_tenor
from quarry.operators.deals import parse_tranches, reg_tagged_values
from quarry.operators.layouts import DRAFT_FIELDS, REDEMPTION_OTHER, REDEMPTION_TLAC, deal_documents, draft_tranches, issuer, \
    issuer_ratings, settlement, to_json_documents
from quarry.plans.registry import register
from quarry.plans.render import block_messages, tabular_messages
from quarry.sources.scans import read_table

_LI = """FROM (SELECT *, CAST(floor(l_quantity) AS INTEGER) AS q,
                row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                  l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
      FROM lineitem) l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

_TRANCHE = "'Tranche ' || CAST(rn AS VARCHAR) AS tranche"


@register("deal_tranches", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, {_TRANCHE},
  CASE WHEN l_linenumber % 2 = 1 THEN q || 'NC' || (q - 1) ELSE q || 'Y' END AS tenor,
  CASE WHEN l_linenumber % 2 = 1 THEN q END AS tenor_maturity_years,
  CASE WHEN l_linenumber % 2 = 1 THEN q - 1 END AS tenor_non_call_years,
  CAST(NULL AS VARCHAR) AS label, 0 AS n_ratings,
  CASE WHEN l_linestatus = 'O' THEN 'SEC Registered' ELSE 'Reg S / 144A' END AS format,
  CASE l_returnflag WHEN 'R' THEN 'Senior Secured' WHEN 'A' THEN 'Subordinated'
       ELSE 'Senior Unsecured' END AS ranking,
  'USD ' || CAST(floor(l_extendedprice) AS BIGINT) AS size,
  CASE WHEN l_discount >= 0.05 THEN 'Fixed-to-Float' ELSE 'Fixed Rate' END AS coupon_type,
  CAST(round(l_tax * 100) AS INTEGER) || '% semi-annual' AS coupon,
  CAST(NULL AS VARCHAR) AS sofr_convention, CAST(NULL AS VARCHAR) AS ipt,
  'UST ' || year(l_shipdate) AS benchmark_treasury,
  'US' || l_orderkey || 'L' || l_linenumber AS isin,
  l_partkey || '-' || l_suppkey AS cusip,
  CAST(NULL AS VARCHAR) AS par_redemption_date,
  strftime(l_shipdate, '%B %-d, %Y') AS maturity_date,
  CAST(NULL AS VARCHAR) AS next_interest_payment_date,
  'None' AS optional_redemption_by_holder,
  CAST(NULL AS VARCHAR) AS optional_redemption_by_issuer,
  CASE WHEN rn = 1 THEN 'General corporate purposes' END AS use_of_proceeds
{_LI}""")
def deal_tranches(spark: SparkSession, sf: str) -> DataFrame:
    t = parse_tranches(tabular_messages(spark, sf))
    return t.withColumn("n_ratings", F.size("expected_ratings")).drop("expected_ratings")


@register("deal_block_fields", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, {_TRANCHE},
  CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 365) AS INTEGER)
    || 'Y' AS tenor,
  CASE WHEN l_returnflag = 'A' THEN 'TIER 2' ELSE 'TLAC' END AS label,
  '- Par call from year ' || (year(o_orderdate) + 1) AS optional_redemption_by_issuer,
  strftime(l_shipdate, '%Y-%m-%d') AS maturity_date,
  CAST(NULL AS VARCHAR) AS isin
{_LI}""")
def deal_block_fields(spark: SparkSession, sf: str) -> DataFrame:
    t = parse_tranches(block_messages(spark, sf))
    return t.select("msg_id", "tranche", "tenor", "label", "optional_redemption_by_issuer",
                    "maturity_date", "isin")


@register("deal_ratings", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, {_TRANCHE},
  ['Aa2', 'B1', 'Caa2'][l_partkey % 3 + 1] AS moodys,
  ['AA', 'B+', 'CCC'][l_suppkey % 3 + 1] AS sp,
  CAST(NULL AS VARCHAR) AS fitch, 2 AS n_ratings
{_LI}""")
def deal_ratings(spark: SparkSession, sf: str) -> DataFrame:
    t = parse_tranches(block_messages(spark, sf))
    r = F.col("expected_ratings")
    return t.select("msg_id", "tranche", r.getItem("Moody's").alias("moodys"), r.getItem("S&P").alias("sp"),
                    r.getItem("Fitch").alias("fitch"), F.size(r).alias("n_ratings"))


@register("deal_reg_tags", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, {_TRANCHE}, 0 AS item_no, '144A' AS reg_label,
       'US' || l_orderkey || 'L' || l_linenumber AS value {_LI}
UNION ALL
SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, {_TRANCHE}, 1 AS item_no, 'Reg S' AS reg_label,
       'XS' || l_orderkey || 'L' || l_linenumber AS value {_LI}""")
def deal_reg_tags(spark: SparkSession, sf: str) -> DataFrame:
    return reg_tagged_values(block_messages(spark, sf), "ISIN")


@register("infer_tenor", """
SELECT l_orderkey, l_linenumber,
  CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 365) AS INTEGER)
    || 'Y' AS tenor
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def infer_tenor_q(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber",
                    infer_tenor(F.date_format("o_orderdate", "yyyy-MM-dd"),
                                F.date_format("l_shipdate", "yyyy-MM-dd")).alias("tenor"))


_RATING = "['{a}', '{b}', '{c}'][o_custkey % 3 + 1] || ' (Stable)'"


@register("deal_globals", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS msg_id, 'Issuer ' || o_custkey || ' plc' AS issuer,
  {_RATING.format(a='Aa2', b='B1', c='Caa2')} AS moodys,
  {_RATING.format(a='AA', b='B+', c='CCC')} AS sp,
  {_RATING.format(a='AA-', b='B', c='CCC+')} AS fitch,
  '**' || strftime(o_orderdate, '%B %-d, %Y') || '**' AS settlement
FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def deal_globals(spark: SparkSession, sf: str) -> DataFrame:
    m = tabular_messages(spark, sf)
    t = F.col("text")
    r = issuer_ratings(t)
    return m.select("msg_id", issuer(t).alias("issuer"), r.getItem("Moody's").alias("moodys"),
                    r.getItem("S&P").alias("sp"), r.getItem("Fitch").alias("fitch"),
                    settlement(t).alias("settlement"))


_SQL_TRIM = "regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _sql_group(label: str) -> str:
    """DuckDB spelling of the draft's n-line group for ``label``: the list
    of stripped lines (null list when the label is absent)."""
    g = f"regexp_extract(text, '{label}[\\s\\p{{Z}}]+([^\\n]+(?:\\n[^\\n]+){{0,' || (n - 1) || '}})', 1)"
    return (f"CASE WHEN {g} = '' THEN NULL ELSE "
            f"list_transform(string_split({g}, chr(10)), lambda v: {_SQL_TRIM.format(x='v')}) END")


# The message text rendered in SQL exactly as ``plans.render.tabular_messages``
# renders it, so the draft's regular expressions run on the same strings.
_SQL_MESSAGES = f"""
WITH li AS (
  SELECT l.*, o.o_custkey, o.o_orderdate, CAST(floor(l_quantity) AS INTEGER) AS q,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                       l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
c AS (
  SELECT *,
    CASE WHEN l_linenumber % 2 = 1 THEN q || 'NC' || (q - 1) ELSE q || 'Y' END AS c_tenor,
    CASE WHEN l_linestatus = 'O' THEN 'SEC Registered' ELSE 'Reg S / 144A' END AS c_format,
    CASE l_returnflag WHEN 'R' THEN 'Senior Secured (Covered)' WHEN 'A' THEN 'Subordinated (Tier 2)'
         ELSE 'Senior Unsecured' END AS c_ranking,
    'USD ' || CAST(floor(l_extendedprice) AS BIGINT) AS c_size,
    CASE WHEN l_discount >= 0.05 THEN 'Fixed-to-Float' ELSE 'Fixed Rate' END AS c_ctype,
    CAST(round(l_tax * 100) AS INTEGER) || '% semi-annual' AS c_coupon,
    'T+[' || CAST(round(l_discount * 1000) AS INTEGER) || 'bps] area' AS c_ipt,
    'UST ' || year(l_shipdate) AS c_bench,
    '**US' || l_orderkey || 'L' || l_linenumber || '**' AS c_isin,
    l_partkey || '-' || l_suppkey AS c_cusip,
    '**' || strftime(l_shipdate, '%B %-d, %Y') || '**' AS c_mat
  FROM li),
m AS (
  SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_lines, concat_ws(chr(10),
    '$$ New Deal: Issuer ' || max(o_custkey) || ' plc (C' || max(o_custkey) || ') | $ '
      || string_agg(c_tenor, ' & ' ORDER BY rn) || ' $$',
    chr(9) || chr(9) || chr(9),
    'Issuer/Ticker' || chr(9) || 'Issuer ' || max(o_custkey) || ' plc (“C' || max(o_custkey) || '”)',
    'Issuer Ratings*' || chr(9) || 'Moody''s: ' || ['Aa2', 'B1', 'Caa2'][max(o_custkey) % 3 + 1] || ' (Stable)',
    'S&P: ' || ['AA', 'B+', 'CCC'][max(o_custkey) % 3 + 1] || ' (Stable)',
    'Fitch: ' || ['AA-', 'B', 'CCC+'][max(o_custkey) % 3 + 1] || ' (Stable)',
    'Tenor' || chr(9) || string_agg(c_tenor, chr(9) ORDER BY rn),
    'Format' || chr(9) || string_agg(c_format, chr(9) ORDER BY rn),
    'Ranking ' || chr(9) || string_agg(c_ranking, chr(9) ORDER BY rn),
    'Size' || chr(9) || string_agg(c_size, chr(9) ORDER BY rn),
    'Coupon Type' || chr(9) || string_agg(c_ctype, chr(9) ORDER BY rn),
    'Coupon' || chr(9) || string_agg(c_coupon, chr(9) ORDER BY rn),
    'IPTs' || chr(9) || string_agg(c_ipt, chr(9) ORDER BY rn),
    'Benchmark Treasury' || chr(9) || string_agg(c_bench, chr(9) ORDER BY rn),
    'ISIN ' || chr(9) || string_agg(c_isin, chr(9) ORDER BY rn),
    'CUSIP' || chr(9) || string_agg(c_cusip, chr(9) ORDER BY rn),
    'Maturity Date' || chr(9) || string_agg(c_mat, chr(9) ORDER BY rn),
    'Optional Redemption by Holder' || string_agg(chr(9) || 'None', '' ORDER BY rn),
    'Settlement' || chr(9) || '**' || strftime(max(o_orderdate), '%B %-d, %Y') || '** (T+5)',
    'Use of Proceeds' || chr(9) || 'General corporate purposes') AS text
  FROM c GROUP BY l_orderkey),
t AS (
  SELECT l_orderkey, text,
    regexp_split_to_array({_SQL_TRIM.format(x="regexp_extract(text, 'Tenor[\\s\\p{Z}]+(.+?)\\n', 1)")},
                          '[\\s\\p{{Z}}]+') AS tenors
  FROM m),
g AS (SELECT l_orderkey, text, tenors, len(tenors) AS n FROM t)"""


_GROUPS_SQL = ", ".join(f"{_sql_group(label)} AS f_{col}" for label, col in DRAFT_FIELDS)
_FIELDS_SQL = ", ".join(f"f_{col}[i] AS {col}" for _, col in DRAFT_FIELDS)
DRAFT_COLUMNS = [col for _, col in DRAFT_FIELDS]


def _terms_sql(label: str) -> str:
    q = lambda terms: " | ".join(terms).replace("'", "''")
    return f"CASE WHEN contains({label}, 'TLAC') THEN '{q(REDEMPTION_TLAC)}' ELSE '{q(REDEMPTION_OTHER)}' END"


def _draft_rows(drafts: DataFrame) -> DataFrame:
    # outer generator: see parse_tranches
    return drafts.select("msg_id", F.inline_outer("tranches")).where(F.col("tranche_no").isNotNull()).select(
        "msg_id", "tranche_no", "tenor", "label", *DRAFT_COLUMNS, F.size("expected_ratings").alias("n_ratings"),
        F.concat_ws(" | ", "optional_redemption_by_issuer").alias("redemption_terms"))


@register("deal_line_group", _SQL_MESSAGES + f"""
SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, CAST(i AS INTEGER) AS tranche_no, tenors[i] AS tenor,
       'TLAC' AS label, {_FIELDS_SQL}, 0 AS n_ratings, {_terms_sql("'TLAC'")} AS redemption_terms
FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM (SELECT l_orderkey, tenors, n, {_GROUPS_SQL} FROM g) x) y""")
def deal_line_group(spark: SparkSession, sf: str) -> DataFrame:
    """Draft line-group layout over the rendered messages: every field."""
    return _draft_rows(draft_tranches(tabular_messages(spark, sf)))


#: What the caller supplies for the three-tranche draft, and attributes of the whole deal.
THREE_TENORS, THREE_LABELS = ["5Y", "8NC7", "30Y"], ["TIER 2", "TLAC", "Senior"]
CONSTANTS = {"ticker": "EXMPL", "listing": "Euro MTF", "governing_law": "England", "denominations": "200k + 1k"}


def _three_sql(label: str, col: str) -> str:
    """The three lines after a label as the list f_col (nulls without it)."""
    ws = "[\\s\\p{Z}]"
    pattern = f"{label}{ws}+(.*?)\\n(.*?)\\n(.*?)\\n"
    parts = [_SQL_TRIM.format(x=f"regexp_extract(text, '{pattern}', {g})") for g in (1, 2, 3)]
    return f"CASE WHEN regexp_matches(text, '{pattern}') THEN [{', '.join(parts)}] ELSE [NULL, NULL, NULL]::VARCHAR[] END AS f_{col}"


@register("deal_three_line", _SQL_MESSAGES + f"""
SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, CAST(i AS INTEGER) AS tranche_no, {THREE_TENORS}[i] AS tenor, {THREE_LABELS}[i] AS label,
       {_FIELDS_SQL}, 0 AS n_ratings, {_terms_sql(f"{THREE_LABELS}[i]")} AS redemption_terms
FROM (SELECT *, unnest(range(1, 4)) AS i FROM (SELECT l_orderkey, {", ".join(_three_sql(*f) for f in DRAFT_FIELDS)} FROM m) x) y""")
def deal_three_line(spark: SparkSession, sf: str) -> DataFrame:
    """Draft three-line layout: three tranches with supplied tenors and labels."""
    return _draft_rows(draft_tranches(tabular_messages(spark, sf), "three_line", tenors=THREE_TENORS, labels=THREE_LABELS))


@register("deal_json", f"""
SELECT CAST(l_orderkey AS VARCHAR) AS msg_id, 'Issuer ' || o_custkey || ' plc' AS issuer,
  '**' || strftime(o_orderdate, '%B %-d, %Y') || '**' AS settlement,
  {_RATING.format(a='Aa2', b='B1', c='Caa2')} AS moodys,
  {", ".join(f"'{v}' AS {k}" for k, v in CONSTANTS.items())},
  CAST(rn AS INTEGER) AS tranche_no, CAST(count(*) OVER (PARTITION BY l_orderkey) AS INTEGER) AS n_tranches,
  CASE WHEN l_linenumber % 2 = 1 THEN q || 'NC' || (q - 1) ELSE q || 'Y' END AS tenor,
  CASE WHEN l_linenumber % 2 = 1 THEN q END AS tenor_maturity_years,
  'US' || l_orderkey || 'L' || l_linenumber AS isin, 'USD ' || CAST(floor(l_extendedprice) AS BIGINT) AS size,
  strftime(l_shipdate, '%B %-d, %Y') AS maturity_date, true AS null_label_kept
{_LI}""")
def deal_json(spark: SparkSession, sf: str) -> DataFrame:
    """Deal documents (globals, constants and nested tranches from the table
    parser) exported as JSON, then every tranche read back from the text."""
    messages = tabular_messages(spark, sf, rate_null=False)
    docs = to_json_documents(deal_documents(messages, parser="table", constants=CONSTANTS))
    tranche = "struct<tenor:string,tenor_maturity_years:int,isin:string,size:string,maturity_date:string>"
    shape = (f"issuer string, settlement string, ratings map<string,string>, {', '.join(f'{k} string' for k in CONSTANTS)}, "
             f"tranches array<{tranche}>")
    # two generators: the text is parsed once, not once per column
    rows = docs.select("msg_id", (F.size(F.split("json", '"label":null', -1)) - 1).alias("nulls"),
                       F.inline(F.array(F.from_json("json", shape))))
    rows = rows.select("msg_id", "nulls", "issuer", "settlement", "ratings", *CONSTANTS, F.size("tranches").alias("n_tranches"),
                       F.posexplode("tranches").alias("i", "t"))
    return rows.select("msg_id", "issuer", "settlement", F.col("ratings").getItem("Moody's").alias("moodys"), *CONSTANTS,
                       (F.col("i") + 1).alias("tranche_no"), "n_tranches", "t.*", (F.col("nulls") == F.col("n_tranches")).alias("null_label_kept"))
