import random

import pytest
from pyspark.sql import functions as F

from quarry.llm.queries import URL_RULES
from quarry.llm.urlfilter import build_cascade, judge_urls, listed_keys


@pytest.mark.parametrize("share,shard", [(0.02, 10 ** 6), (0.5, 10 ** 6), (0.3, 900), (0.0, 100), (1.0, 10 ** 6)])
def test_membership_is_exact(spark, share, shard):
    rnd = random.Random(7)
    data = [(f"host{i}.example", rnd.random() < share) for i in range(3000)]
    keys = spark.createDataFrame(data, "host string, listed boolean")
    rows = keys.select("host").unionByName(keys.select("host").limit(50)).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS host"))
    got = listed_keys(rows, "host", keys, out="hit", shard_keys=shard).collect()
    assert len(got) == 3051
    want = dict(data)
    assert all(r["hit"] == want.get(r["host"], False) for r in got)


def test_cascade_alternates(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"), (F.col("id") % 3 == 0).alias("listed"))
    levels = build_cascade(keys)
    assert len(levels) > 2 and sum(len(x.bits) for x in levels) < 4000
    assert build_cascade(keys.where("not listed")) == [] == build_cascade(keys.limit(0))


def test_rules_and_odd_urls(spark):
    urls = {1: "http://A.Example.NET/en/x?q", 2: "https://example.net/de/", 3: "x://a.example.com/de/1", 4: "http://b.org/fr/",
            5: "http://b.org/en/", 6: None, 7: "no scheme", 8: "http://casino.test", 9: "http://net", 10: "http://net/", 11: "a://b://c.net/x#y",
            12: "http://notexample.com/de/", 13: "http://" + "x" * 50_000 + ".net/", 14: "://", 15: "http://é.net/\n/en"}
    rows = [(i, u, "h") for i, u in urls.items()] + [(1, urls[1], "h"), (None, urls[8], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = judge_urls(pages, URL_RULES, F.col("host").contains("casino")).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out if r["page_id"] is not None}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/de/", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][2:] == (None, "allow") and got[6] == ("", "", None, "allow") == got[7]
    assert got[8] == ("casino.test", "", None, "block") and got[9][2:] == (None, "allow")
    assert got[10][2:] == ("net/", "block") and got[11][:2] == ("b:", "//c.net/x") and got[12][2] is None
    assert got[13][2] == "net/" and got[14][:2] == ("", "") and got[15][1] == "/\n/en"
    assert judge_urls(pages.limit(0), URL_RULES, F.lit(True)).count() == 0
