"""Held-out accuracy on the given tables, gradients, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import quality_knn, toxicity as tox
from quarry.llm.quality_knn import quality_votes
from quarry.llm.toxicity import Net, gather, score_block, toxicity, train, windows
from quarry.llm.words import Words

SF = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_votes(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (crc(i) % 5 == 0) for i, r in got.items())
    test = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good = [p for q, p in test if q == 1]
    assert sum(good) / len(good) > 0.95
    assert sum(q == p for q, p in test) / len(test) > 0.9


def test_toxicity_learns_words_and_character_patterns():
    rng = np.random.default_rng(4)
    syl = ["ba", "de", "mi", "ro", "tu", "ne", "sha", "lo"]
    word = lambda: "".join(rng.choice(syl, rng.integers(1, 5)))
    texts, y = [], []
    for i in range(700):
        w = [word() for _ in range(rng.integers(3, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):      # a fixed word, or a stem with an ending never seen twice
                w.insert(rng.integers(0, len(w)), "grobian" if rng.random() < 0.5 else "zwixk" + word() + word())
        texts.append(" ".join(w))
        y.append(float(bad))
    y = np.array(y)
    net = train(texts[:500], y[:500], steps=120)
    s = score_block(net, pa.array(texts[500:]))
    assert ((s >= 0.3) == (y[500:] > 0)).mean() > 0.95
    alone = np.concatenate([score_block(net, pa.array([t])) for t in texts[500:520]])
    assert np.allclose(alone, s[:20], atol=1e-5)
    odd = score_block(net, pa.array([None, "", " \n", "grobian " + "ba " * 3000 + " zwixkro zwixkde"]))
    assert (odd[:3] <= 0.25).all() and odd[3] >= 0.3


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    net = Net(np.empty(0, np.uint64), np.empty(0), np.zeros(tox.GRAMS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(0, 0.4, (7, 3, tox.WORD_DIM + tox.CHAR_DIM + 1))
    mask = np.ones((7, 3))
    mask[5:, 1] = 0
    y = np.array([1.0, 0.0, 1.0])
    _, grad, _ = net.gradient(x, mask, y)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for j in rng.integers(0, flat.size, 4):
            old, e = flat[j], 1e-4
            flat[j] = old + e
            up = net.gradient(x, mask, y)[0]
            flat[j] = old - e
            down = net.gradient(x, mask, y)[0]
            flat[j] = old
            assert abs((up - down) / (2 * e) - np.asarray(grad[k]).reshape(-1)[j]) < 2e-3, k


def test_windows_cover_every_word():
    w = Words(pa.array(["a " * n for n in (0, 1, 47, 48, 49, 85, 500)]))
    doc, start, end = windows(w.first)
    seen = np.zeros(len(w.start), int)
    for a, b in zip(start, end):
        assert 0 < b - a <= tox.WINDOW
        seen[a:b] += 1
    assert (seen > 0).all() and (w.doc[start] == doc).all()


@pytest.mark.parametrize("run,column", [(quality_votes, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, run, column):
    rows = [(i, f"some words here {i} " * (i + 1)) for i in range(30)] + [(None, None), (None, ""), (3, "a"), (3, "a"), (50, "é" * 30_000)]
    docs = spark.createDataFrame([(a, b, 1.5) for a, b in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None) for i in range(30)] + [(None, 1, None), (3, None, None), (3, 1, None)],
                                   f"doc_id long, {column} int, text string")
    out = run(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert len(run(docs, labels.limit(0)).collect()) == len(rows)
    assert run(docs.limit(0), labels).count() == 0


def test_toxicity_trains_on_whole_texts(spark):
    """Passages far beyond the first characters are learned from, and the
    windows that training gets do not depend on the partitions."""
    rng = np.random.default_rng(6)
    syl = ["ba", "de", "mi", "ro", "tu", "ne", "sha", "lo"]
    word = lambda: "".join(rng.choice(syl, rng.integers(1, 5)))
    docs, labels = [], []
    for i in range(240):
        w = [word() for _ in range(1500)]                 # about 9,000 characters
        if i % 4 == 0:
            w[-20:-20] = ["grobian", "zwixk" + word(), "grobian"]
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = pa.array(["ba lo grobian de mi grobian ro", "ba lo de mi ro tu ne"])
    nets = [tox.fit_net(docs.repartition(n), labels) for n in (1, 7)]
    for net in nets:
        high, low = score_block(net, probe)
        assert high >= 0.3 > low
    assert all(np.array_equal(nets[0].p[k], nets[1].p[k]) for k in nets[0].p)


def test_votes_are_those_of_the_plain_nearest_neighbours():
    """A cosine at a time, with labelled documents that tie at the border."""
    rng = np.random.default_rng(8)
    counts = rng.poisson(1.0, (300, quality_knn.DIM)).astype(np.float32)
    counts[40:90] = counts[40]                                   # fifty copies: ties
    labels = rng.random(300) < 0.5
    voter = quality_knn.Voter(counts, labels, np.ones(quality_knn.DIM))
    asked = np.concatenate([counts[:60], rng.poisson(1.0, (30, quality_knn.DIM)).astype(np.float32)])
    got = voter.score(asked)
    for v, s in zip(voter.embed(asked), got):
        sim = (voter.known @ v).astype(np.float64)
        last = np.sort(sim)[-quality_knn.NEIGHBOURS]
        near = sim >= last - 1e-6
        vote = np.maximum(sim[near], 1e-6) ** 4
        assert abs((vote * labels[near]).sum() / vote.sum() - s) < 1e-4


def test_document_scores_are_the_highest_of_plain_window_scores():
    """The recurrence a word at a time, over every window of whole texts."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["ba", "de", "grobian", "mi", "rotu", "ne"], n)) for n in (1, 30, 48, 49, 200)]
    y = np.array([0.0, 1, 0, 1, 0])
    net = train(texts, y, steps=5)
    got = score_block(net, pa.array(texts))
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, tox.HIDDEN

    def direction(x, d):
        state, out = np.zeros(h), []
        for row in x:
            a = row @ p["x" + d] + p["b" + d]
            gates = np.clip(0.25 * (a[: 2 * h] + state @ p["u" + d][:, : 2 * h]) + 0.5, 0, 1)
            new = np.clip(a[2 * h:] + gates[h:] * (state @ p["u" + d][:, 2 * h:]), -1, 1)
            state = state + gates[:h] * (new - state)
            out.append(state)
        return np.array(out)
    for text, s in zip(texts, got):
        w = Words(pa.array([text]), lower=True)
        ids, chars, _ = net.inputs(w)
        scores = []
        for _, a, b in zip(*windows(w.first)):
            x = np.c_[net.word[ids[a:b]], chars[a:b]].astype(np.float64)
            both = np.c_[direction(x, "f"), direction(x[::-1], "b")[::-1]]
            att = np.exp(both @ p["v"] - (both @ p["v"]).max())
            z = (att / att.sum()) @ both @ p["w"] + p["c"][0]
            scores.append(1 / (1 + np.exp(-z)))
        assert abs(max(scores) - s) < 1e-3, (max(scores), s)


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.01", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity(docs.join(labels.select("doc_id"), "doc_id"), labels).collect() if r["held_out"]]
    assert all(crc(r["doc_id"]) % 4 == 2 for r in rows)
    bad = [r["predicted"] for r in rows if marks[r["doc_id"]] == 1]
    clean = [r["predicted"] for r in rows if marks[r["doc_id"]] == 0]
    # measured: 107 of 120 (learned from some 2,200 documents)
    assert len(bad) == 120 and sum(bad) >= 102 and sum(clean) / len(clean) <= 0.01
