import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quarry.llm.quality_rules import BASE, FEATURES, describe, fit_rules, learn_rules, quality_rules, statistics

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    rep = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep))


CASES = [None, "", "a", " \n\t", "a b c a b c a", "x\nx\n\nx \n y\ny", "é ß #*|\r\n#", "a b a b a b", "ñ" * 5000,
         "one two\n" * 300, "x\n", "\nx\nx"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab#é \n\t ", max_size=60)), max_size=8))
def test_statistics_match_brute_force(texts):
    texts = texts + CASES
    s = statistics(pa.array(texts, pa.string()))
    got = list(zip(*(s[c].tolist() for c in BASE)))
    assert got == [brute(t) for t in texts]


def test_learned_rules_reject_planted_junk():
    rng = np.random.default_rng(1)
    n = 2000
    good = rng.random(n) > 0.2
    x = {"symbols_per_word": np.where(good, rng.random(n) * 0.2, 0.3 + rng.random(n)), "mean_word": rng.random(n)}
    rules = learn_rules(x, good)
    assert rules and all(t.feature == "symbols_per_word" for t in rules[0])
    hit = np.zeros(n, bool)
    for r in rules:
        c = np.ones(n, bool)
        for t in r:
            c &= t.holds(x)
        hit |= c
    assert (hit & good).sum() <= 0.02 * n and (hit & ~good).sum() >= 0.9 * (~good).sum()
    assert learn_rules(x, np.ones(n, bool)) == []


@pytest.mark.parametrize("with_labels", [True, False])
def test_query_on_odd_rows(spark, with_labels):
    rows = [(1, "w " * 80, "k"), (2, None, None), (None, "", "k"), (1, "w " * 80, "k"), (3, " ".join(map(str, range(70))), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1)][: 3 if with_labels else 0], "doc_id long, quality int")
    out = sorted(((r["doc_id"] or 0, r["base_failed"], r["kept"]) for r in quality_rules(docs, labels).collect()))
    assert out == [(0, True, False), (1, True, False), (1, True, False), (2, True, False), (3, False, True)]
    assert quality_rules(docs.limit(0), labels).count() == 0


def test_kept_is_what_the_list_of_rules_says(spark):
    """Every row judged again from the learned thresholds, whatever the order
    of rows and with an id of two texts."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    first = labels.where("quality = 1").first()["doc_id"]
    docs = docs.unionByName(docs.where(f"doc_id = {first}").withColumn("text", F.concat("text", F.lit(" more words at the end"))))
    own = docs.select("doc_id", "text")
    rules = fit_rules(own, labels)
    assert rules and describe(rules) == describe(fit_rules(own.orderBy(F.xxhash64("text")).repartition(5), labels))
    stats = {f: F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()}
    out = quality_rules(docs, labels).select("doc_id", "base_failed", "kept", "rule", *stats.values()).collect()
    for r in out:
        fires = [i for i, rule in enumerate(rules, 1)
                 if all((r[t.feature] > t.threshold) if t.above else (r[t.feature] <= t.threshold) for t in rule)]
        assert r["rule"] == (fires[0] if fires else None) and r["kept"] == (not r["base_failed"] and not fires)
