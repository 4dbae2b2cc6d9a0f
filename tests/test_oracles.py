"""Every registered query against its DuckDB oracle (sf0.001), compared the
way the driver compares: columns by name, floats to 6 places, as a multiset."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import check
from quarry.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "score" in df.columns


def test_every_query_matches_its_oracle_without_cross_joins(spark):
    """And no registered query plans a cartesian product or a nested-loop join
    (the kNN pairs the numbers of its tiles before, without their rows)."""
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) == set(ORACLES)
    plans = {}
    res = check(spark, list(QUERIES), SF, verbose=False, plans=plans)
    assert res == dict.fromkeys(QUERIES, True)
    bad = {n: op for n, p in plans.items() for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in p}
    assert not bad, bad
