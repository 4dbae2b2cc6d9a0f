"""Quality by nearest-neighbour voting in a latent semantic space.

Features of a text are log counts of hashed words, hashed word shapes and
bucketed text statistics, weighted by inverse document frequency over all
documents.  A bounded sample of labelled documents gives the latent space
(singular vectors of its weighted matrix) and the labelled vectors; these are
broadcast (LABEL_LIMIT * RANK floats at most), and every document is compared
with all of them by blocked cosine products.  The nearest NEIGHBOURS vote,
weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out, labelled_sample, shipped
from quarry.llm.quality_rules import statistics
from quarry.llm.words import Words, blocks, mix, prefix_sums, range_hash

LABEL_LIMIT = 6_000
RANK = 48
NEIGHBOURS = 25
#: Feature columns: words, shapes, statistics.
N_WORDS, N_SHAPES, BUCKETS = 384, 384, 16
#: Weight of the statistics against the hashed counts.
STAT_WEIGHT = 3.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97
RATIOS = [("n_symbols", "n_words", 4.0), ("n_bars", "n_words", 8.0), ("n_dup_lines", "n_lines", 16.0),
          ("n_repeat_words", "n_words", 16.0), ("word_chars", "n_words", 1.0), ("n_words", "n_lines", 0.25),
          ("n_upper", "n_bytes", 64.0), ("n_digits", "n_bytes", 64.0), ("n_distinct", "n_words", 16.0)]
DIM = N_WORDS + N_SHAPES + BUCKETS * (len(RATIOS) + 1)


def features(column: pa.Array) -> np.ndarray:
    """Counts (texts, DIM) of a block."""
    w = Words(column, lower=True)
    n = len(w.offsets) - 1
    cells = [w.doc * DIM + (w.hashes() % np.uint64(N_WORDS)).astype(np.int64)]
    # word shapes: runs of equal character classes count once
    plain = Words(column)
    cls = _SHAPE[plain.raw]
    keep = np.ones(len(cls), dtype=bool)
    keep[1:] = cls[1:] != cls[:-1]
    keep[plain.start] = True
    at = np.zeros(len(cls) + 1, dtype=np.int64)
    np.cumsum(keep, out=at[1:])
    shape = range_hash(prefix_sums(cls[keep]), at[plain.start], at[plain.end])
    cells.append(plain.doc * DIM + N_WORDS + (mix(shape, 21) % np.uint64(N_SHAPES)).astype(np.int64))
    out = np.log1p(np.bincount(np.concatenate(cells), minlength=n * DIM).reshape(n, DIM).astype(np.float32))
    s = statistics(column)
    base = N_WORDS + N_SHAPES
    ratios = [np.log2(1 + s["n_words"])] + [s[a] / np.maximum(s[b], 1) * k for a, b, k in RATIOS]
    for i, r in enumerate(ratios):
        bucket = np.minimum(np.round(r), BUCKETS - 1).astype(np.int64)
        out[np.arange(n), base + i * BUCKETS + bucket] = STAT_WEIGHT
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task that have each feature; DIM rows a task."""
    df, n = np.zeros(DIM, dtype=np.int64), 0
    for batch in batches:
        for b in blocks(batch, "text"):
            df += (features(b.column("text")) > 0).sum(0)
            n += b.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(df, n))], ["feature", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch, "text"):
            f = features(b.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([r.tobytes() for r in f], pa.binary())],
                                             ["doc_id", "label", "f"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Voter:
    def __init__(self, counts: np.ndarray, labels: np.ndarray, idf: np.ndarray):
        self.idf = idf.astype(np.float32)
        x = _unit(counts * self.idf)
        self.mean = x.mean(0)
        _, vec = np.linalg.eigh((x - self.mean).T @ (x - self.mean))
        self.space = np.ascontiguousarray(vec[:, ::-1][:, :RANK]).astype(np.float32)
        self.known = self.embed(counts)
        self.labels = labels.astype(np.float32)

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit((_unit(counts * self.idf) - self.mean) @ self.space)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of the votes for label 1."""
        out = np.empty(len(counts))
        k = min(NEIGHBOURS, len(self.known))
        for a in range(0, len(counts), 512):
            sim = self.embed(counts[a: a + 512]) @ self.known.T
            kth = np.partition(sim, sim.shape[1] - k, axis=1)[:, -k]
            near = sim >= kth[:, None]                   # neighbours as similar as the last one vote too
            vote = np.where(near, np.maximum(sim, 1e-6), 0).astype(np.float64) ** 2
            vote *= vote
            out[a: a + 512] = vote @ self.labels / vote.sum(1)
        return out


def fit_voter(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LABEL_LIMIT) -> Voter | None:
    """From at most ``limit`` labelled documents that are not held out; None
    without labelled documents."""
    df = dict((r["feature"], r["n"]) for r in docs.select("text").mapInArrow(_frequencies, "feature bigint, n bigint")
              .groupBy("feature").agg(F.sum("n").alias("n")).collect())          # DIM + 1 rows
    ids = labelled_sample(labels, label, limit, ~held_out(F.col("doc_id"), 5, 0))
    sample = (docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sorted(sample.mapInArrow(_vectors, f"doc_id {kind}, label int, f binary").collect(), key=lambda r: r["doc_id"])
    if not rows:
        return None
    counts = np.stack([np.frombuffer(r["f"], np.float16) for r in rows]).astype(np.float32)
    total = df.get(DIM, 0)
    idf = np.array([np.log((1 + total) / (1 + df.get(i, 0))) + 0.05 for i in range(DIM)])
    return Voter(counts, np.array([r["label"] != 0 for r in rows]), idf)


def quality_votes(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``
    (1 if score >= 0.3).

    Null and empty texts are scored by their statistics alone.  A null key is
    the empty text for the held-out rule and is never learned from; repeated
    rows get equal rows.  Neighbours as similar as the last of the NEIGHBOURS
    all vote.  Without labelled documents every score is 0.5."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col(key).alias("doc_id"), F.col(label).alias(label))
    model = shipped(docs.sparkSession, fit_voter(rows, marks, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = model()
        for batch in batches:
            for b in blocks(batch, "text"):
                score = voter.score(features(b.column("text"))) if voter else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(score, 0, 1))], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))
