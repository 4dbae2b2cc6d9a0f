import hashlib
import math
import re

import pytest

from quarry.llm import mixing
from quarry.llm.mixing import mix_sources


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string, size long")


def test_targets_epochs_and_budgets(spark):
    data = [(i, "w " * (1 + i % 7), "abc"[i % 3], 0) for i in range(3000)] + [(9000 + i, "x y", None, 0) for i in range(10)]
    out = mix_sources(rows(spark, data), [3.0, 1.0, 2.0]).toPandas()
    assert len(out) == len(data)
    total = out["size"].sum()
    per = out.groupby("source", dropna=False).agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"),
                                                  stated=("source_size", "first"))
    assert (per["size"] == per["stated"]).all()
    assert abs(per["target"].sum() - 1.5 * total) < 1e-6 * total
    assert (per["target"] <= 2 * per["size"] + 1e-9).all()
    assert ((per["taken"] - per["target"]).abs() <= 4).all()            # half of the largest document
    assert (out["taken"] <= 2 * out["size"]).all()
    for _, g in out.groupby("source", dropna=False):                    # whole epochs come first
        assert g["times"].max() - g["times"].min() <= 1
    again = mix_sources(rows(spark, list(reversed(data))).repartition(7), [3.0, 1.0, 2.0]).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


@pytest.mark.parametrize("data", [[], [(1, None, None, 0), (None, "", "a", 1), (1, None, None, 0)],
                                  [(1, "a b c", "s", 5)] * 4, [(1, "w " * 50_000, "s", 5), (2, "w", "s", 5)]])
def test_odd_inputs(spark, data):
    out = mix_sources(rows(spark, data), [3.0, 1.0, 2.0]).collect()
    assert len(out) == len(data)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)


def plain_mix(data, weights):
    """The rule, a row at a time: (doc_id, size, taken) of every row."""
    by = {}
    for i, t, s in data:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        w = 0.1 + 0.9 * len(re.sub(r"[#*$%&|<>0-9]", "", t)) / len(t) if t else 0.1
        u = (int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48
        by.setdefault(s, []).append((-math.log(u) / w, i is not None, i or 0, n))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[3] for r in by[s]) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, open_, target = 1.5 * sum(size.values()), list(names), {}
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ = [s for s in open_ if s not in full]
    out = []
    for s in names:
        epochs, before = (math.floor(target[s] / size[s] + 1e-12) if size[s] else 0), 0
        for _, there, i, n in sorted(by[s]):
            more = before + n / 2 <= target[s] - epochs * size[s]
            out.append((i if there else None, n, min(epochs + more, 2) * n))
            before += n
    return sorted(out, key=str)


@pytest.mark.parametrize("grid", [2, 1024])
def test_agrees_with_the_rule_at_low_weights_and_among_equal_rows(spark, monkeypatch, grid):
    """Digits only weigh 0.1; a third of the rows is one row repeated, and
    another part has no id."""
    monkeypatch.setattr(mixing, "GRID", grid)
    data = [(i, "12 345 6 " * (1 + i % 5) if i % 2 else "some words " * (1 + i % 4), "ab"[i % 2]) for i in range(600)]
    data += [(7000, "9 9 9", "a")] * 300 + [(None, "x y", "b")] * 150 + [(None, None, "b")] * 20 + [(7001, "one two three", "c")] * 200
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(6)
    got = mix_sources(df, [3.0, 1.0, 2.0]).collect()
    assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=str) == plain_mix(data, [3.0, 1.0, 2.0])
