"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word is read as its own embedding (vocabulary of the training sample) and
the embedding of its characters: the mean over its character n-grams, and the
highest log odds among them.  Embeddings start from the log odds of word and
n-gram in the labelled sample and are trained, with the recurrent layers, the attention and the output, by Adam in numpy.  Every
window of WINDOW words of every text is scored, windows overlap by
WINDOW - STEP words, and a text's score is its highest window's.  Gates are
piecewise linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out, labelled_sample, shipped, written
from quarry.llm.words import Words, blocks, mix

#: Labelled documents learned from (whole texts), and the vocabulary's size,
#: at most.
SAMPLE_DOCS, VOCABULARY = 8_000, 50_000
WINDOW, STEP = 48, 36
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
#: Bytes of a character n-gram, and their hash buckets.
GRAM, GRAMS = 4, 1 << 15
#: Texts of the sample that hold a word of the vocabulary, at least.
LEAST_TEXTS = 3
BLOCK_BYTES = 1_000_000
THRESHOLD = 0.3


def grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character n-grams inside words; each word's first and end."""
    m = max(0, len(w.raw) - GRAM + 1)
    key = np.zeros(m, dtype=np.uint64)
    for i in range(GRAM):
        key += w.raw[i: i + m].astype(np.uint64) << np.uint64(8 * i)
    bucket = (mix(key, 31) % np.uint64(GRAMS)).astype(np.int32)
    return bucket, np.minimum(w.start, m), np.minimum(np.maximum(w.end - GRAM + 1, w.start), m)


class Net:
    """``words``: sorted keys of the vocabulary; row 0 of the embedding stands
    for every other word."""

    def __init__(self, words: np.ndarray, odds: np.ndarray, char_odds: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.words = words
        self.word = rng.normal(0, 0.05, (len(words) + 1, WORD_DIM)).astype(np.float32)
        self.word[:, 0] = np.append(0, odds)
        self.char = rng.normal(0, 0.05, (GRAMS, CHAR_DIM)).astype(np.float32)
        self.char[:, 0] = char_odds
        self.odds = char_odds.astype(np.float32)        # kept as they were counted
        p, h, n = {}, HIDDEN, WORD_DIM + CHAR_DIM + 1
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.3, (n, 3 * h))
            p["u" + d] = rng.normal(0, 0.3, (h, 3 * h))
            p["b" + d] = np.r_[np.zeros(2 * h), np.zeros(h)]
        p["v"] = rng.normal(0, 0.3, 2 * h)
        p["w"] = rng.normal(0, 0.3, 2 * h)
        p["c"] = np.array([-2.0])
        self.p = {k: np.asarray(v, np.float32) for k, v in p.items()}

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Word ids, character embedding of each word, and the n-grams."""
        if len(self.words):
            key = w.hashes()
            at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
            ids = np.where(self.words[at] == key, at + 1, 0)
        else:
            ids = np.zeros(len(w.start), dtype=np.int64)
        bucket, a, b = grams(w)
        sums = np.zeros((len(bucket) + 1, CHAR_DIM), np.float64)
        np.cumsum(self.char[bucket], axis=0, out=sums[1:])
        mean = (sums[b] - sums[a]) / np.maximum(b - a, 1)[:, None]
        return ids, np.c_[mean.astype(np.float32), self.highest(bucket, a, b)], (bucket, a, b)

    def highest(self, bucket, a, b) -> np.ndarray:
        """Highest log odds among each word's n-grams; 0 for a word too short."""
        if not len(bucket):
            return np.zeros(len(a), np.float32)
        edges = np.minimum(np.stack([a, b], 1).reshape(-1), len(bucket) - 1)
        top = np.maximum.reduceat(self.odds[bucket], edges)[::2]
        last = b == len(bucket)                       # the last edge cannot be past the end
        top[last] = np.maximum(top[last], self.odds[bucket[-1]])
        return np.where(b > a, top, 0).astype(np.float32)

    # one direction over (T, B, n) inputs; masked steps keep the state
    def _run(self, x, mask, d):
        t, b, _ = x.shape
        h, p = HIDDEN, self.p
        hs = np.zeros((t + 1, b, h), np.float32)
        acts = x @ p["x" + d] + p["b" + d]
        rec = np.empty((t, b, h), np.float32)
        u = p["u" + d]
        for s in range(t):
            a = acts[s]
            old = hs[s]
            a[:, : 2 * h] += old @ u[:, : 2 * h]
            g = np.clip(0.25 * a[:, : 2 * h] + 0.5, 0, 1)
            rec[s] = old @ u[:, 2 * h:]
            a[:, 2 * h:] += g[:, h:] * rec[s]
            new = np.clip(a[:, 2 * h:], -1, 1)
            z = g[:, :h] * mask[s][:, None]
            hs[s + 1] = old + z * (new - old)
        return hs, acts, rec

    def forward(self, x, mask):
        f = self._run(x, mask, "f")
        b = self._run(x[::-1], mask[::-1], "b")
        both = np.concatenate([f[0][1:], b[0][1:][::-1]], axis=2)
        score = np.where(mask > 0, both @ self.p["v"], -1e9)
        att = np.exp(score - score.max(0))
        att *= mask
        att /= np.maximum(att.sum(0), 1e-9)
        pooled = (att[:, :, None] * both).sum(0)
        logit = pooled @ self.p["w"] + self.p["c"][0]
        return logit, (f, b, both, att, pooled)

    def probability(self, x, mask):
        return 1 / (1 + np.exp(-np.clip(self.forward(x, mask)[0].astype(np.float64), -30, 30)))

    def _back(self, x, mask, d, state, dh_out, grad):
        hs, acts, rec = state
        t, b, _ = x.shape
        h, u = HIDDEN, self.p["u" + d]
        dh = np.zeros((b, h), np.float32)
        da = np.empty((t, b, 3 * h), np.float32)
        d_rec = np.empty((t, b, h), np.float32)
        for s in range(t - 1, -1, -1):
            a, old = acts[s], hs[s]
            dh = dh + dh_out[s]
            m = mask[s][:, None]
            g = np.clip(0.25 * a[:, : 2 * h] + 0.5, 0, 1)
            slope = 0.25 * (np.abs(a[:, : 2 * h]) < 2)
            new = np.clip(a[:, 2 * h:], -1, 1)
            z = g[:, :h] * m
            d_new = dh * z * (np.abs(a[:, 2 * h:]) < 1)
            da[s, :, 2 * h:] = d_new
            d_rec[s] = d_new * g[:, h:]
            da[s, :, h: 2 * h] = d_new * rec[s] * slope[:, h:]
            da[s, :, :h] = dh * (new - old) * m * slope[:, :h]
            dh = dh * (1 - z) + da[s, :, : 2 * h] @ u[:, : 2 * h].T + d_rec[s] @ u[:, 2 * h:].T
        old = hs[:-1].reshape(-1, h)
        grad["u" + d] = np.concatenate([old.T @ da[:, :, : 2 * h].reshape(-1, 2 * h), old.T @ d_rec.reshape(-1, h)], 1)
        flat = da.reshape(-1, 3 * h)
        grad["x" + d] = x.reshape(-1, x.shape[2]).T @ flat
        grad["b" + d] = flat.sum(0)
        return da @ self.p["x" + d].T

    def gradient(self, x, mask, y):
        logit, (f, b, both, att, pooled) = self.forward(x, mask)
        q = 1 / (1 + np.exp(-logit))
        dl = ((q - y) / len(y)).astype(np.float32)
        grad = {"w": pooled.T @ dl, "c": np.array([dl.sum()], np.float32)}
        d_pool = dl[:, None] * self.p["w"]
        d_both = att[:, :, None] * d_pool
        d_att = (both * d_pool).sum(2)
        d_score = att * (d_att - (att * d_att).sum(0))
        grad["v"] = np.einsum("tb,tbk->k", d_score, both)
        d_both += d_score[:, :, None] * self.p["v"]
        dx = self._back(x, mask, "f", f, d_both[:, :, :HIDDEN], grad)
        dx = dx + self._back(x[::-1], mask[::-1], "b", b, d_both[::-1, :, HIDDEN:], grad)[::-1]
        loss = float(-(y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9)).mean())
        return loss, grad, dx


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a block's texts: text, first word, end word."""
    size = np.diff(first)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STEP)), 0)
    doc = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[doc] + k * STEP
    return doc, start, np.minimum(start + WINDOW, first[doc + 1])


def gather(net: Net, ids, mean, start, end):
    """Inputs (T, B, n) and mask of windows of words."""
    at = start[None, :] + np.arange(WINDOW)[:, None]
    mask = (at < end[None, :]).astype(np.float32)
    at = np.minimum(at, max(len(ids) - 1, 0))
    return np.concatenate([net.word[ids[at]], mean[at]], axis=2) * mask[:, :, None], mask, at


def score_block(net: Net, column: pa.Array) -> np.ndarray:
    """Highest window score of each text; an empty text gets the score of the
    output bias alone."""
    w = Words(column, lower=True)
    n = len(w.offsets) - 1
    empty = 1 / (1 + np.exp(-float(net.p["c"][0])))
    out = np.zeros(n)
    doc, start, end = windows(w.first)
    out[np.diff(w.first) == 0] = min(empty, 0.25)
    if len(doc):
        ids, mean, _ = net.inputs(w)
        for a in range(0, len(doc), 4096):
            s = slice(a, a + 4096)
            x, mask, _ = gather(net, ids, mean, start[s], end[s])
            np.maximum.at(out, doc[s], net.probability(x, mask))
    return out


def _held(code: np.ndarray, owner: np.ndarray, mark: np.ndarray, size: int) -> np.ndarray:
    """Toxic and other texts of a block that hold each code: (size, 2)."""
    pair = np.unique(code * len(mark) + owner)
    code, owner = pair // len(mark), pair % len(mark)
    return np.stack([np.bincount(code, weights=mark[owner], minlength=size),
                     np.bincount(code, weights=1 - mark[owner], minlength=size)], 1)


def count_block(w: Words, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's word keys, the texts that hold each (toxic, other), and the
    same for the buckets of n-grams.  ``mark``: 1 for a toxic text."""
    keys, code = np.unique(w.hashes(), return_inverse=True)
    bucket, a, b = grams(w)
    inside = np.zeros(len(bucket) + 1, dtype=np.int64)
    np.add.at(inside, a[b > a], 1)
    np.add.at(inside, b[b > a], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    owner = np.searchsorted(w.offsets, at, side="right") - 1
    return keys, _held(code, w.doc, mark, len(keys)), _held(bucket[at].astype(np.int64), owner, mark, GRAMS)


def first_net(words: np.ndarray, counts: np.ndarray, gram_counts: np.ndarray, pos: float, neg: float) -> Net:
    """A net that starts from the log odds of the most frequent words (keys
    ascending) and of the n-grams, among ``pos`` toxic and ``neg`` other texts."""
    pos, neg = max(1, int(pos)), max(1, int(neg))

    def odds(p: np.ndarray, q: np.ndarray, prior: float) -> np.ndarray:
        """From the toxic and other texts that hold each code."""
        p, q = p + prior * pos / (pos + neg), q + prior * neg / (pos + neg)
        low = np.log(p / pos) - np.log(q / neg) - 2.5 * np.sqrt(1 / p + 1 / q)
        return np.clip(low, 0, 4) / 4               # a lower bound: chance counts for nothing
    seen = counts.sum(1)
    keep = np.flatnonzero(seen >= LEAST_TEXTS)
    keep = np.sort(keep[np.argsort(-seen[keep], kind="stable")[:VOCABULARY]])
    return Net(words[keep], odds(counts[keep, 0], counts[keep, 1], 2.0), odds(gram_counts[:, 0], gram_counts[:, 1], 10.0))


def choose_windows(net: Net, w: Words, mark: np.ndarray) -> list[tuple[bytes, float]]:
    """The windows of a block's texts to train on, as (words, label): of every
    text the window of highest log odds, of one that is not toxic also one
    drawn by a hash of the text."""
    doc, start, end = windows(w.first)
    if not len(doc):
        return []
    total = np.r_[0, np.cumsum(np.maximum(net.word[net.inputs(w)[0], 0], 0) ** 2)]
    best = total[end] - total[start]
    order = np.lexsort((-best, doc))
    lead = np.r_[True, doc[order][1:] != doc[order][:-1]]
    first, top = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), order[lead]
    owner, count = doc[first], np.diff(np.r_[first, len(doc)])
    text = w.range_hash(w.offsets[owner], w.offsets[owner + 1])
    drawn = first + (mix(text, 37) % count.astype(np.uint64)).astype(np.int64)
    clean = mark[owner] == 0
    at = np.concatenate([top, drawn[clean]])
    return [(w.raw[w.start[start[j]]: w.end[end[j] - 1]].tobytes(), float(mark[doc[j]])) for j in at]


def train(texts: list[str], y: np.ndarray, steps: int = 200, batch: int = 256, rate: float = 0.01, seed: int = 2) -> Net:
    """Log odds by documents, then Adam over the chosen windows of whole texts."""
    col = pa.array(texts, pa.large_string())
    parts = [(Words(col.slice(a, 200), lower=True), y[a: a + 200]) for a in range(0, len(texts), 200)]
    keys, counts, gram_counts = zip(*(count_block(*p) for p in parts))
    words, code = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((len(words), 2))
    np.add.at(sums, code, np.concatenate(counts))
    net = first_net(words, sums, sum(gram_counts), y.sum(), (1 - y).sum())
    return fit_windows(net, [r for p in parts for r in choose_windows(net, *p)], steps, batch, rate, seed)


def fit_windows(net: Net, rows: list[tuple[bytes, float]], steps: int = 200, batch: int = 256, rate: float = 0.01,
                seed: int = 2) -> Net:
    """Adam over windows: (words, label), each at most WINDOW words."""
    if not rows:
        return net
    rng = np.random.default_rng(seed)
    col = pa.array([t for t, _ in rows], pa.large_binary())
    label = np.array([v for _, v in rows])
    ids, start, end, base = [], [], [], 0
    parts = [Words(col.slice(a, 200)) for a in range(0, len(rows), 200)]    # part by part: prefix sums are long
    for w in parts:
        ids.append(net.inputs(w)[0].astype(np.int32))
        del w._sums
        start.append(w.first[:-1] + base)
        end.append(w.first[1:] + base)
        base += len(w.start)
    ids, start, end = map(np.concatenate, (ids, start, end))
    yes, no = np.flatnonzero(label > 0), np.flatnonzero(label == 0)
    groups = [g for g in (yes, no) if len(g)]
    # the n-grams of every word, for the gradient of their embedding
    tri = [grams(w) for w in parts]
    shift = np.r_[0, np.cumsum([len(t[0]) for t in tri])]
    bucket = np.concatenate([t[0] for t in tri])
    tri_a = np.concatenate([t[1] + s for t, s in zip(tri, shift)])
    tri_b = np.concatenate([t[2] + s for t, s in zip(tri, shift)])
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for i in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, batch // len(groups)) for g in groups])
        at = np.minimum(start[pick][None] + np.arange(WINDOW)[:, None], len(ids) - 1)
        used, place = np.unique(at, return_inverse=True)
        count = tri_b[used] - tri_a[used]
        owner = np.repeat(np.arange(len(used)), count)
        flat = bucket[np.repeat(tri_a[used] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        mean = np.zeros((len(used), CHAR_DIM), np.float32)
        np.add.at(mean, owner, net.char[flat])
        mean /= np.maximum(count, 1)[:, None]
        mean = np.c_[mean, net.highest(bucket, tri_a[used], tri_b[used])]
        mask = (at == start[pick][None] + np.arange(WINDOW)[:, None]).astype(np.float32)
        mask *= start[pick][None] + np.arange(WINDOW)[:, None] < end[pick][None]
        x = np.concatenate([net.word[ids[at]], mean[place.reshape(at.shape)]], 2) * mask[:, :, None]
        _, grad, dx = net.gradient(x, mask, label[pick].astype(np.float32))
        for k, g in grad.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            net.p[k] -= rate * (m1[k] / (1 - 0.9 ** i)) / (np.sqrt(m2[k] / (1 - 0.99 ** i)) + 1e-8)
        dx *= mask[:, :, None]
        np.add.at(net.word, ids[at], -rate * 5 * dx[:, :, :WORD_DIM])
        d_word = np.zeros((len(used), CHAR_DIM), np.float32)
        np.add.at(d_word, place.reshape(-1), dx[:, :, WORD_DIM: WORD_DIM + CHAR_DIM].reshape(-1, CHAR_DIM))
        np.add.at(net.char, flat, -rate * 5 * (d_word / np.maximum(count, 1)[:, None])[owner])
    # the classes were drawn evenly: move the output so that the stated
    # threshold separates the training texts best (F1)
    means = []
    for w in parts:
        means.append(net.inputs(w)[1])
        del w._sums
    mean = np.concatenate(means)
    z = np.concatenate([net.forward(*gather(net, ids, mean, start[a: a + 4096], end[a: a + 4096])[:2])[0]
                        for a in range(0, len(rows), 4096)])
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(label[order])
    weight = np.cumsum(np.where(label[order] > 0, 1.0, 0.5))
    best = int(np.argmax(2 * hits / (weight + label.sum())))
    cut = z[order[best]] if best + 1 == len(z) else (z[order[best]] + z[order[best + 1]]) / 2
    net.p["c"] = net.p["c"] + np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    return net


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: words (``gram`` false) and n-gram buckets with the toxic and
    other texts that hold them."""
    for batch in batches:
        for b in blocks(batch, "text", BLOCK_BYTES):
            keys, counts, gram_counts = count_block(Words(b.column("text"), lower=True), b.column("label").to_numpy(zero_copy_only=False))
            held = np.flatnonzero(gram_counts.any(1))
            both = np.concatenate([counts, gram_counts[held]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(both)) >= len(keys)), pa.array(np.concatenate([keys.view(np.int64), held])),
                 pa.array(both[:, 0]), pa.array(both[:, 1])], ["gram", "code", "toxic", "other"])


def _windows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model()
        for batch in batches:
            for b in blocks(batch, "text", BLOCK_BYTES):
                got = choose_windows(net, Words(b.column("text"), lower=True), b.column("label").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.binary()), pa.array([v for _, v in got], pa.float64())],
                                                 ["words", "label"])
    return run


def fit_net(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE_DOCS) -> Net | None:
    """From the whole texts of at most ``limit`` labelled documents that are
    not held out; None without any.  Tasks read the texts; the driver gets the
    counts of the vocabulary and at most two windows a document."""
    ids = labelled_sample(labels, label, limit, ~held_out(F.col("doc_id"), 4, 2))
    sample = written(docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
                     .select("text", (F.col("label") != 0).cast("double").alias("label")), "toxicity-sample")
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    if not size["n"]:
        return None
    counts = written(sample.mapInArrow(_counts, "gram boolean, code bigint, toxic bigint, other bigint")
                     .groupBy("gram", "code").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "toxicity-counts")
    seen = F.col("toxic") + F.col("other")
    unsigned = F.col("code").bitwiseXOR(F.lit(-1 << 63))
    words = (counts.where(~F.col("gram") & (seen >= LEAST_TEXTS)).orderBy(seen.desc(), unsigned).limit(VOCABULARY)
             .select("code", "toxic", "other").toPandas())
    key = words["code"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(key)
    in_grams = counts.where("gram").select("code", "toxic", "other").toPandas()        # at most GRAMS rows
    gram_counts = np.zeros((GRAMS, 2))
    gram_counts[in_grams["code"].to_numpy(dtype=np.int64)] = in_grams[["toxic", "other"]].to_numpy(dtype=float)
    net = first_net(key[order], words[["toxic", "other"]].to_numpy(dtype=float)[order], gram_counts, size["pos"], size["n"] - size["pos"])
    rows = sample.mapInArrow(_windows(shipped(docs.sparkSession, net)), "words binary, label double").collect()
    return fit_windows(net, sorted((bytes(r["words"]), r["label"]) for r in rows))      # task order must not matter


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``
    (1 if score >= 0.3).

    Null and empty texts have no window and score low (at most 0.25).  A null
    key is the empty text for the held-out rule and is never learned from;
    repeated rows get equal rows.  Without labelled documents all score 0."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col(key).alias("doc_id"), F.col(label).alias(label))
    model = shipped(docs.sparkSession, fit_net(rows, marks, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model()
        for batch in batches:
            for b in blocks(batch, "text", BLOCK_BYTES):
                score = score_block(net, b.column("text")) if net else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
