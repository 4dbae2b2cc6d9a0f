"""Deal queries over tables of their own: messages are rendered with one
shuffle per table and read once each, not by interpreted array lambdas."""

import datetime

import pytest
from quarry.operators.deals import parse_tranches
from quarry.operators.layouts import deal_documents, draft_tranches
from quarry.plans import deals  # noqa: F401  (registers the queries)
from quarry.plans.registry import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("deals"))
    day = datetime.datetime
    lines = [(1, 3, 5, 1, 10.0, 1000.5, 0.01, 0.02, "A", "O", day(2001, 2, 3)),
             (1, 4, 6, 2, 20.0, 2000.5, 0.06, 0.03, "R", "F", day(2002, 2, 3)),
             (2, 5, 7, 1, 30.0, 3000.5, 0.02, 0.04, "N", "O", day(2003, 2, 3)),
             (3, 6, 8, 1, 40.0, 4000.5, 0.02, 0.04, "N", "O", day(2003, 2, 3)),
             (None, 6, 8, 1, 40.0, 4000.5, 0.02, 0.04, "N", "O", day(2003, 2, 3))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    # order 2 comes twice: its line stands twice in one message
    orders = [(1, 7, day(2000, 1, 1)), (2, 8, day(2000, 1, 1)), (2, 8, day(2000, 1, 1)), (4, 9, day(2000, 1, 1))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    return d


def _run(spark, tables, name, order="tranche"):
    df = QUERIES[name](spark, tables)
    plan = df._jdf.queryExecution().toString()
    assert "lambdafunction" not in plan.split("== Optimized Logical Plan ==")[1]
    # the tables meet by their own columns, dealt no more than once each
    assert "RoundRobin" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") <= 2
    return df.orderBy("msg_id", order).collect()


def test_line_group(spark, tables):
    rows = _run(spark, tables, "deal_line_group", "tranche_no")
    assert [(r.msg_id, r.tranche_no, r.tenor) for r in rows] == \
        [("1", 1, "10NC9"), ("1", 2, "20Y"), ("2", 1, "30NC29"), ("2", 2, "30NC29")]
    assert rows[0].format == "SEC Registered\tReg S / 144A" and rows[1].format.startswith("Ranking \t")
    assert rows[1].use_of_proceeds is None and rows[0].n_ratings == 0 and rows[0].redemption_terms.count(" | ") == 3


def test_line_group_of_a_long_message(spark):
    """The lines behind a label are counted, not matched to the message's end one inside the other."""
    text = "Tenor\t5Y\t7Y\nFormat\tA\nB \n" + "x\n" * 60_000 + "\nSize\tS\r\n\n"
    m = spark.createDataFrame([("a", text), ("b", None), ("c", "Tenor \n")], "msg_id string, text string")
    a, b, c = (r.tranches for r in draft_tranches(m).orderBy("msg_id").collect())
    assert [t.format for t in a] == ["A", "B"] and [t.size for t in a] == ["S", ""] and b is None and c is None


def test_three_line(spark, tables):
    rows = _run(spark, tables, "deal_three_line", "tranche_no")
    assert [(r.msg_id, r.tenor, r.label) for r in rows[:3]] == [("1", "5Y", "TIER 2"), ("1", "8NC7", "TLAC"), ("1", "30Y", "Senior")]
    assert len(rows) == 6 and rows[0].size == "USD 1000\tUSD 2000" and rows[1].size.startswith("Coupon Type\t")
    assert [r.redemption_terms.count(" | ") for r in rows[:3]] == [2, 3, 2] and rows[0].sofr_convention is None


def test_three_lines_reach_back_for_their_line_ends(spark):
    """Blank lines behind a label are given back until three lines fit."""
    m = spark.createDataFrame([("a", "Size \n\n\n"), ("b", "Size\n1\n2"), ("c", None)], "msg_id string, text string")
    a, b, c = (r.tranches for r in draft_tranches(m, "three_line").orderBy("msg_id").collect())
    assert [t.size for t in a] == [""] * 3 and [t.size for t in b] == [None] * 3 == [t.size for t in c]
    assert [t.label for t in c] == ["TLAC"] * 3


def test_tranches(spark, tables):
    rows = _run(spark, tables, "deal_tranches")
    assert [(r.msg_id, r.tranche, r.tenor, r.tenor_maturity_years) for r in rows] == [
        ("1", "Tranche 1", "10NC9", 10), ("1", "Tranche 2", "20Y", None),
        ("2", "Tranche 1", "30NC29", 30), ("2", "Tranche 2", "30NC29", 30)]
    assert [r.ranking for r in rows] == ["Subordinated", "Senior Secured", "Senior Unsecured", "Senior Unsecured"]
    assert [r.isin for r in rows] == ["US1L1", "US1L2", "US2L1", "US2L1"] and rows[1].maturity_date == "February 3, 2002"


def test_odd_cells_and_labels(spark):
    text = "Tenor :\nTenor  5 nc 4\u00a0 7Y\nMATURITY\t**May 1** (T+5)\t( )\nISIN\t \tX\x1fY\nLabel\t:\n TLAC \n\nIssue Date"
    t = parse_tranches(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "msg_id string, text string"))
    a, b, c, d = t.orderBy("msg_id", "tranche").collect()
    # the values are those of the first row of a header: here one without cells
    assert (a.tenor, a.label, a.maturity_date, a.isin, b.isin) == (None, "TLAC", "May 1**", None, "X\x1fY")
    assert (b.tranche, b.maturity_date, b.label) == ("Tranche 2", None, None)
    assert (c.tranche, c.expected_ratings, d.tranche, d.expected_ratings) == ("Tranche 1", None, "Tranche 1", {})


def test_ratings(spark, tables):
    rows = _run(spark, tables, "deal_ratings")
    assert [(r.msg_id, r.tranche, r.moodys, r.sp, r.fitch, r.n_ratings) for r in rows] == [
        ("1", "Tranche 1", "Aa2", "CCC", None, 2), ("1", "Tranche 2", "B1", "AA", None, 2),
        ("2", "Tranche 1", "Caa2", "B+", None, 2), ("2", "Tranche 2", "Caa2", "B+", None, 2)]


def test_json_documents(spark, tables):
    rows = _run(spark, tables, "deal_json", "tranche_no")
    assert [(r.msg_id, r.issuer, r.tranche_no, r.n_tranches, r.tenor) for r in rows] == [
        ("1", "Issuer 7 plc", 1, 2, "10NC9"), ("1", "Issuer 7 plc", 2, 2, "20Y"),
        ("2", "Issuer 8 plc", 1, 2, "30NC29"), ("2", "Issuer 8 plc", 2, 2, "30NC29")]
    assert all(r.null_label_kept and r.listing == "Euro MTF" for r in rows)


def test_documents_of_orders_without_customer(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3, None, datetime.datetime(2000, 1, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    r, = QUERIES["deal_json"](spark, str(tmp_path)).collect()
    assert (r.msg_id, r.issuer, r.moodys, r.tranche_no, r.tenor) == ("3", None, None, 1, "40NC39")


def test_documents_of_both_parsers(spark):
    m = spark.createDataFrame([("a", "Tenor\t5Y\t7Y\nSize\t1\t2\n")], "msg_id string, text string")
    draft, table = (deal_documents(m, parser=p).first() for p in ("draft", "table"))
    assert [t.size for t in draft.tranches] == ["1\t2", None] and [t.size for t in table.tranches] == ["1", "2"]
    assert draft.ratings == table.ratings == {"Moody's": None, "S&P": None, "Fitch": None} and table.issuer is None


def test_block_fields(spark, tables):
    rows = _run(spark, tables, "deal_block_fields")
    assert [(r.msg_id, r.tranche, r.tenor, r.label, r.maturity_date) for r in rows] == [
        ("1", "Tranche 1", "1Y", "TIER 2", "2001-02-03"), ("1", "Tranche 2", "2Y", "TLAC", "2002-02-03"),
        ("2", "Tranche 1", "3Y", "TLAC", "2003-02-03"), ("2", "Tranche 2", "3Y", "TLAC", "2003-02-03")]
    assert {r.optional_redemption_by_issuer for r in rows} == {"- Par call from year 2001"}


def test_tenors_from_other_date_patterns(spark):
    text = "Tenor\nA\nB\nIssue Date\nMay 1, 2020\n2020-05- 1\nLabel\nMaturity Date\tMay 2, 2025\t2031-5-1"
    m = spark.createDataFrame([("a", text)], "msg_id string, text string")
    assert [r.tenor for r in parse_tranches(m).orderBy("tranche").collect()] == [None, "11Y"]
    t = parse_tranches(m, date_formats=("MMMM d, yyyy",)).orderBy("tranche").collect()
    assert [r.tenor for r in t] == ["5Y", "11Y"] and "issue_date" not in t[0]
