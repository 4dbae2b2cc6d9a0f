"""Deal-message parsing: our own fixture messages in the reference's shapes
(tab-separated columns per tranche, hard-wrapped cells, block labels)."""

import os

from pyspark.sql import functions as F

from quarry.functions.deal import clean_cell, decode_tenor, infer_tenor, split_cells, terminator_keys
from quarry.operators.deals import parse_tranches, reg_tagged_values
from quarry.operators.layouts import deal_documents, draft_tranches, issuer, issuer_ratings, settlement, \
    tenor_list, to_json_documents
from quarry.sources.scans import read_messages

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def _msgs(spark, *texts):
    return spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(texts)], "msg_id string, text string")


def _file(name):
    with open(os.path.join(FIX, name), encoding="utf-8") as f:
        return f.read()


def _rows(df):
    return [r.asDict(recursive=True) for r in df.orderBy("msg_id", "tranche").collect()]


def test_terminators_are_the_reachable_labels():
    keys = terminator_keys()
    assert len(keys) == 13
    assert "isin" not in keys and "use of proceeds" not in keys and "maturity" not in keys
    assert len(terminator_keys(strict=True)) == 20


def test_wrapped_message(spark):
    t = _rows(parse_tranches(_msgs(spark, _file("deal_wrapped.txt"))))
    assert [r["tranche"] for r in t] == ["Tranche 1", "Tranche 2"]
    assert [(r["tenor"], r["tenor_maturity_years"], r["tenor_non_call_years"]) for r in t] == \
        [("5NC4", 5, 4), ("8NC7", 8, 7)]
    assert [r["ranking"] for r in t] == ["Junior Unsecured", "Preferred Subordi"]
    assert [r["isin"] for r in t] == ["US1111AA11", "US1111AA22"]
    assert [r["cusip"] for r in t] == ["1111AA11", "1111AA22"]
    assert [r["maturity_date"] for r in t] == ["May 1, 2030", "May 1, 2033"]
    assert [r["optional_redemption_by_holder"] for r in t] == ["None", "None"]
    assert [r["use_of_proceeds"] for r in t] == ["General Corporate Purposes", None]
    assert all(r["ipt"] is None and r["label"] is None and r["coupon"] is None for r in t)
    assert all(r["expected_ratings"] == {} for r in t)


def test_covered_message(spark):
    t = _rows(parse_tranches(_msgs(spark, _file("deal_covered.txt"))))
    assert [r["tenor"] for r in t] == ["2Y Floating", "9Y Fixed"]
    assert all(r["tenor_maturity_years"] is None for r in t)
    assert [r["ranking"] for r in t] == ["Covered Bond", "Covered Bond"]     # trailing parenthesis cut
    assert [r["coupon_type"] for r in t] == ["Floater", "Fixed"]
    assert [r["coupon"] for r in t] == ["3m Euribor + [x]", "Annual, act/act"]
    assert [r["benchmark_treasury"] for r in t] == ["–", "DBR 0 02/15/34"]
    assert [r["sofr_convention"] for r in t] == ["Not applicable", "Not applicable"]
    assert [r["isin"] for r in t] == ["DE000LMA0017", "DE000LMA0025"]
    assert [r["maturity_date"] for r in t] == ["June 17, 2027", "June 17, 2034"]
    assert [r["use_of_proceeds"] for r in t] == [None, None]


def test_blocks_overlap_and_count(spark):
    t = _rows(parse_tranches(_msgs(spark, "Label\nTLAC\nISIN\nX1\nTenor\n5Y")))
    assert len(t) == 1 and t[0]["label"] == "TLAC"
    # the Tenor block sets the count; its values are read as a table row
    assert t[0]["tenor"] is None


def test_ratings_block_stops_at_word_colon(spark):
    t = _rows(parse_tranches(_msgs(spark, "Expected Ratings\nMoody's: A3\nS&P: A-\nFitch: A+")))
    assert t[0]["expected_ratings"] == {"Moody's": "A3", "S&P": "A-"}


def test_ratings_round_robin_last_wins(spark):
    text = "Tenor\t5Y\t7Y\nExpected Ratings\nMoody's: A1\nMoody's: A2\nMoody's: A3\n\nISIN\tX\tY"
    t = _rows(parse_tranches(_msgs(spark, text)))
    assert [r["expected_ratings"] for r in t] == [{"Moody's": "A3"}, {"Moody's": "A2"}]


def test_reg_tags(spark):
    text = "Tenor\t5Y\t7Y\nISIN\nUS1 (144A)\nXS1 (Reg S)\nUS2"
    r = reg_tagged_values(_msgs(spark, text)).orderBy("tranche", "item_no").collect()
    assert [(x.tranche, x.item_no, x.reg_label, x.value) for x in r] == [
        ("Tranche 1", 0, "144A", "US1"), ("Tranche 1", 1, "Unknown", "US2"), ("Tranche 2", 0, "Reg S", "XS1")]


def test_inferred_tenor(spark):
    text = "Tenor\nA\nB\nC\nIssue Date\n2025-01-01\n2025-1-1\nNovember 3, 2022\nLabel\n" \
           "Maturity Date\t2030-01-01\t2026-1-1\t2030-01-01"
    t = _rows(parse_tranches(_msgs(spark, text)))
    assert [r["tenor"] for r in t] == ["5Y", "1Y", None]


def test_cell_functions(spark):
    df = spark.createDataFrame([("A\t\tB",), ("A\t \tB",)], "l string")
    assert [r[0] for r in df.select(split_cells(F.col("l"))).collect()] == [["A", "B"], ["A", "", "B"]]
    df = spark.createDataFrame([(x,) for x in ["**US1**", "Senior (Covered)", "a (b) c (d)", "(x)",
                                               "**Sep 1** (T+5)"]], "c string")
    assert [r[0] for r in df.select(clean_cell(F.col("c"))).collect()] == \
        ["US1", "Senior", "a", None, "Sep 1**"]
    df = spark.createDataFrame([("11NC10",), ("11 nc 10",), ("7Y",), (None,)], "t string")
    assert [tuple(r[0]) for r in df.select(decode_tenor(F.col("t"))).collect()] == \
        [(11, 10), (11, 10), (None, None), (None, None)]
    df = spark.createDataFrame([("2025-01-01", "2030-01-01"), ("2025-1-1", "2026-1-1"),
                                ("November 3, 2022", "2030-01-01"), ("2025-02-30", "2030-01-01")], "a string, b string")
    assert [r[0] for r in df.select(infer_tenor(F.col("a"), F.col("b"))).collect()] == ["5Y", "1Y", None, None]


def test_globals_and_draft(spark):
    m = _msgs(spark, _file("deal_wrapped.txt"), _file("deal_covered.txt"))
    t = F.col("text")
    g = m.select("msg_id", issuer(t).alias("i"), issuer_ratings(t).alias("r"), settlement(t).alias("s"),
                 tenor_list(t).alias("tl")).orderBy("msg_id").collect()
    assert g[0].i == "Northwind Bank plc" and g[1].i == "Lakeside Mortgage AG"
    assert g[0].r == {"Moody's": "A2 (Stable)", "S&P": "A (Stable)", "Fitch": "A+ (Stable)"}
    assert g[0].s == "**May 1, 2025**"
    assert g[0].tl == ["5NC4", "8NC7"] and g[1].tl == ["2Y", "Floating", "9Y", "Fixed"]
    d = draft_tranches(m).orderBy("msg_id").collect()
    first = d[0].tranches
    assert len(first) == 2
    assert first[0].format == "SEC Registered\tSEC Registered"
    assert first[1].format == "Ranking \tJunior Unsecured\tPreferred Subordi"
    assert first[0].isin == "**US1111AA11**\t**US1111AA22**"
    assert first[1].isin == "CUSIP\t1111AA11\t1111AA22"
    assert first[0].coupon is None
    assert len(first[0].optional_redemption_by_issuer) == 4
    assert len(d[1].tranches) == 4   # the whitespace split breaks "2Y Floating"


def test_document_json(spark):
    m = _msgs(spark, _file("deal_wrapped.txt"))
    j = to_json_documents(deal_documents(m, parser="table")).first().json
    import json
    doc = json.loads(j)
    assert doc["issuer"] == "Northwind Bank plc"
    assert [x["tenor"] for x in doc["tranches"]] == ["5NC4", "8NC7"]
    assert doc["tranches"][1]["use_of_proceeds"] is None and "label" in doc["tranches"][0]


def test_read_messages_fallback(spark, tmp_path):
    df = read_messages(spark, str(tmp_path / "missing.txt"), fallback="Tenor\t5Y")
    assert df.count() == 1
    p = tmp_path / "m.txt"
    p.write_text(_file("deal_covered.txt"), encoding="utf-8")
    assert parse_tranches(read_messages(spark, str(p))).count() == 2


def test_parser_plan_stays_compact(spark):
    """Each per-message intermediate is bound once (``let``); if Catalyst
    were allowed to inline them into the lambdas the optimized plan would
    grow several-fold and the parse would recompute them per element."""
    m = _msgs(spark, _file("deal_wrapped.txt"))
    plan = parse_tranches(m)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 90_000


def test_three_line_layout(spark):
    m = _msgs(spark, _file("deal_wrapped.txt"))
    d = draft_tranches(m, layout="three_line", tenors=["5NC4", "8NC7", None],
                       labels=["TLAC", "TIER 2", None]).first().tranches
    assert [t.tranche_no for t in d] == [1, 2, 3]
    assert [t.format for t in d] == ["SEC Registered\tSEC Registered",
                                     "Ranking \tJunior Unsecured\tPreferred Subordi", "nated"]
    assert [t.coupon for t in d] == [None, None, None]          # label absent
    assert [len(t.optional_redemption_by_issuer or []) for t in d] == [4, 3, 0]
    assert d[1].label == "TIER 2" and d[2].tenor is None


def test_hard_wrapped_three_tranches(spark):
    t = _rows(parse_tranches(_msgs(spark, _file("deal_wrapped3.txt"))))
    assert [(r["tenor"], r["tenor_maturity_years"], r["tenor_non_call_years"]) for r in t] == \
        [("3NC2", 3, 2), ("5NC4", 5, 4), ("12NC7", 12, 7)]
    # a wrapped row keeps only what is on its first line
    assert [r["ranking"] for r in t] == ["Senior Preferred", "Senior Preferred", "Tier Two"]
    assert [r["coupon"] for r in t] == ["Fixed 30/360 payable yearly until the call", None, None]
    assert [r["benchmark_treasury"] for r in t] == ["T 3 1/2 06/30/28", "T 3 3/4 06/30/", None]
    assert [r["par_redemption_date"] for r in t] == ["June 9, 2027", "June 9, 2029", "June"]
    assert [r["use_of_proceeds"] for r in t] == ["Grid expansion", "Refinancing of note", None]
    # block-only field given as a table row is not read
    assert [r["optional_redemption_by_issuer"] for r in t] == [None, None, None]
    assert all(r["label"] is None and r["expected_ratings"] == {} for r in t)


def test_synonyms_are_a_parameter(spark):
    from quarry.functions.deal import LABEL_SYNONYMS
    m = _msgs(spark, _file("deal_wrapped.txt"))
    assert [r["ipt"] for r in _rows(parse_tranches(m))] == [None, None]
    syn = {**LABEL_SYNONYMS, "ipts": "IPT"}
    assert [r["ipt"] for r in _rows(parse_tranches(m, synonyms=syn))] == ["T+200bps area", "T+260bps area"]


def test_strict_labels_option(spark):
    # ISIN is not a terminator by default (Q7), so the Label block runs on
    text = "Label\nTLAC\nISIN\nX1\nTenor\n5Y\n7Y"
    m = _msgs(spark, text)
    assert [r["label"] for r in _rows(parse_tranches(m))] == ["TLAC", "ISIN"]
    assert [r["label"] for r in _rows(parse_tranches(m, strict_labels=True))] == ["TLAC", None]
