"""Whitening of embeddings on their leading principal components, found by
spectrum slicing.

The covariance is summed in tasks, a ``d x d`` matrix each, over the fit list
(every distinct vector once).  The driver holds that matrix only: a symmetric
LDL' factorization of ``V - s I`` counts the eigenvalues above ``s`` (Sylvester's
law of inertia), bisection by these counts isolates each leading eigenvalue,
Rayleigh quotient iteration refines it, and two more counts certify its number.

Vectors that are null or hold null or non-finite entries are left out.  Entries
become ``floor(256 c)``, at the limits of a long where they lie beyond.  A
vector shorter than the longest counts as filled up with zeros (an empty one is
all zeros).  Components without variance (below 1e-12 of the trace) cannot be
whitened and are left out, so equal vectors alone, or a single one, give no
rows; an empty table gives none either.  Repeated rows and null ids are rows of
their own; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

SCALE = 256
#: Matrices are added up in this many tasks, then in one.
FOLD = 16
#: Part of the trace below which a component has no variance.
NO_VARIANCE = 1e-12

LIMIT = float(2 ** 63)


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, x)``: positions of the usable vectors and their entries as
    longs, filled up with zeros to the longest of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())                  # skips null lists
    values = flat.to_numpy(zero_copy_only=False)                # null entries: nan
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = column.is_null().to_numpy(zero_copy_only=False).copy()
    bad[owner[~np.isfinite(values)]] = True
    rows = np.flatnonzero(~bad)
    width = int(lengths[rows].max()) if len(rows) else 0
    x = np.zeros((len(rows), width), dtype=np.int64)
    place = np.cumsum(~bad) - 1
    inner = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    use = ~bad[owner]
    scaled = np.floor(values[use] * SCALE)
    high, low = scaled >= LIMIT, scaled < -LIMIT
    entries = np.where(high | low, 0, scaled).astype(np.int64)
    entries[high], entries[low] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    x[place[owner[use]], inner[use]] = entries
    return rows, x


def packed(x: np.ndarray) -> list[bytes]:
    """A key per row, equal for equal vectors however many zeros end them:
    the width of an integer (2 or 8), then the entries."""
    if x.shape[1] == 0:
        return [b"\x02"] * len(x)
    used = np.where((x != 0).any(axis=1), x.shape[1] - np.argmax(x[:, ::-1] != 0, axis=1), 0)
    small = ((x >= -32768) & (x < 32768)).all(axis=1)
    narrow = np.where(small[:, None], x, 0).astype("<i2")
    wide = x.astype("<i8", copy=False)
    return [b"\x02" + narrow[i, :w].tobytes() if s else b"\x08" + wide[i, :w].tobytes()
            for i, (w, s) in enumerate(zip(used.tolist(), small.tolist()))]


def unpacked(keys: list[bytes], width: int) -> np.ndarray:
    x = np.zeros((len(keys), width), dtype=np.int64)
    for i, k in enumerate(keys):
        part = np.frombuffer(k, dtype="<i2" if k[0] == 2 else "<i8", offset=1)
        x[i, : len(part)] = part
    return x


# ---------------------------------------------------------------- eigenpairs

def inertia(a: np.ndarray) -> tuple[int, int]:
    """Numbers of positive and negative eigenvalues of a symmetric matrix, from
    the pivots of ``P A P' = L D L'`` with 1 x 1 and 2 x 2 blocks; a block is
    taken where it bounds the growth of the rest."""
    a, k, up, down = a.copy(), 0, 0, 0
    n, bound = len(a), (1 + 17 ** 0.5) / 8

    def swap(i, j):
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        pivot, size = abs(a[k, k]), 1
        column = np.abs(a[k + 1:, k])
        most = column.max() if k + 1 < n else 0.0
        if pivot == 0 and most == 0:
            k += 1                                       # a zero eigenvalue
            continue
        if pivot < bound * most:
            r = k + 1 + int(column.argmax())
            others = np.abs(a[r, k:])
            others[r - k] = 0
            beside = others.max()
            if pivot * beside < bound * most * most:
                if abs(a[r, r]) >= bound * beside:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        if size == 1:
            p = a[k, k]
            up, down = up + (p > 0), down + (p < 0)
            c = a[k + 1:, k].copy()
            a[k + 1:, k + 1:] -= np.outer(c, c / p)
        else:                                            # such a block has one eigenvalue of each sign
            up, down = up + 1, down + 1
            block, c = a[k: k + 2, k: k + 2].copy(), a[k + 2:, k: k + 2].copy()
            a[k + 2:, k + 2:] -= c @ np.linalg.solve(block, c.T)
        k += size
    return int(up), int(down)


@dataclass
class Component:
    value: float
    vector: np.ndarray
    #: Eigenvalues counted above ``value - margin`` and above ``value + margin``.
    margin: float
    above_low: int
    above_high: int


def leading_components(v: np.ndarray, most: int) -> list[Component]:
    """The ``most`` largest eigenpairs of a positive semidefinite matrix, by
    falling value, certified by counts: at least ``i`` eigenvalues lie above
    the i-th value less the margin and fewer than ``i`` above it plus the margin."""
    n = len(v)
    trace = float(np.trace(v))
    if n == 0 or not trace > 0:
        return []
    norm = float(np.abs(v).sum(axis=1).max())
    tiny = n * np.finfo(float).eps * norm
    eye = np.eye(n)
    counts: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = inertia(v - s * eye)[0]
        return counts[s]

    def solved(shift: float, b: np.ndarray) -> np.ndarray:
        for step in range(4):
            try:
                y = np.linalg.solve(v - (shift + step * tiny / 4) * eye, b)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all():
                return y / np.linalg.norm(y)
        return b

    def clear(x: np.ndarray, found: list[Component]) -> np.ndarray:
        for _ in range(2):
            for c in found:
                x = x - (c.vector @ x) * c.vector
        return x / np.linalg.norm(x)

    found: list[Component] = []
    start = np.random.default_rng(12).standard_normal(n)
    high = norm * (1 + 1e-9) + tiny
    for i in range(1, min(most, n) + 1):
        low, high_i = -tiny, high
        # isolate: i eigenvalues or more above low, fewer than i above high_i
        while True:
            alone = above(low) == i and above(high_i) == i - 1
            if high_i - low <= 2 * tiny or (alone and high_i - low <= 0.05 * abs(high_i)):
                x = clear(start, found)
                value = (low + high_i) / 2
                for _ in range(3):
                    x = clear(solved(value, x), found)
                for _ in range(8):                       # Rayleigh quotients: the error is cubed
                    value = float(x @ v @ x)
                    if np.linalg.norm(v @ x - value * x) <= tiny:
                        break
                    x = clear(solved(value, x), found)
                value = float(x @ v @ x)
                margin = 4 * max(tiny, float(np.linalg.norm(v @ x - value * x)))
                if (low - margin <= value <= high_i + margin and above(value - margin) >= i and above(value + margin) < i
                        and margin <= 64 * tiny) or high_i - low <= tiny / 4:
                    break
            middle = (low + high_i) / 2
            low, high_i = (middle, high_i) if above(middle) >= i else (low, middle)
        if value <= NO_VARIANCE * trace:
            break
        x = x * (1 if x[np.abs(x).argmax()] > 0 else -1)
        found.append(Component(value, x, margin, above(value - margin), above(value + margin)))
    return found


# ---------------------------------------------------------------- jobs

def _added(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of a frame's binary columns ``m`` of ``size`` doubles: every task
    adds what it reads, so no more than ``FOLD`` of them meet in one."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for b in batches:
            for m in b.column("m"):
                total += np.frombuffer(m.as_py())
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    got = parts.repartition(FOLD).mapInArrow(add, "m binary").repartition(1).mapInArrow(add, "m binary").first()
    return np.frombuffer(got["m"]) if got else np.zeros(size)


def _products(fit: DataFrame, width: int, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Sum over the fit list of ``w w'`` for ``w = turn' (x - mean)``."""
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k)), False
        for b in batches:
            w = (unpacked(b.column("key").to_pylist(), width) - mean) @ turn
            total += w.T @ w
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return _added(fit.mapInArrow(run, "m binary"), k * k).reshape(k, k)


def fit_list(rows: DataFrame, vector: str) -> DataFrame:
    """Distinct usable vectors as ``key``, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = whole_vectors(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary())], ["key"])

    return written(rows.select(vector).mapInArrow(run, "key binary").distinct(), "whitening-fit")


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """``(n, S)``, exact; sums travel as high and low halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for b in batches:
            keys = b.column("key").to_pylist()
            width = max([(len(k) - 1) // k[0] for k in keys], default=0)
            x = unpacked(keys, width)
            low, high = (x & 0xFFFFFFFF).sum(axis=0).tolist(), (x >> 32).sum(axis=0).tolist()
            total += [0] * (width - len(total))
            for j in range(width):
                total[j] += (high[j] << 32) + low[j]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([t >> 32 for t in total], pa.int64()),
                                          pa.array([t & 0xFFFFFFFF for t in total], pa.int64())], ["dim", "high", "low"])

    sums = (fit.mapInArrow(run, "dim int, high bigint, low bigint").groupBy("dim")
            .agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect())        # a row per dimension
    out = [0] * len(sums)
    for r in sums:
        out[r["dim"]] = (r["high"] << 32) + r["low"]
    return fit.count(), out


def whiten(rows: DataFrame, most: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component: ``key, component, n, deviation, whitened,
    explained, identity_error``.  ``deviation`` is exact; null where it is
    beyond a long."""
    spark = rows.sparkSession
    kind = dict(rows.select(key).dtypes)[key]
    schema = (f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    fit = fit_list(rows, vector)
    n, sums = column_sums(fit)
    width = len(sums)
    if not n or not width:
        return spark.createDataFrame([], schema)
    mean = np.array([s / n for s in sums])                        # correctly rounded
    cov = _products(fit, width, mean, np.eye(width)) / n
    found = leading_components((cov + cov.T) / 2, most)
    if not found:
        return spark.createDataFrame([], schema)
    turn = np.column_stack([c.vector / np.sqrt(c.value) for c in found])
    error = float(np.abs(_products(fit, width, mean, turn) / n - np.eye(len(found))).max())
    explained = [c.value / float(np.trace(cov)) for c in found]
    wrapped = np.array([s & 0xFFFFFFFFFFFFFFFF for s in sums], dtype=np.uint64)
    about = np.array([float(s) for s in sums])
    k = len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = whole_vectors(b.column(1))
            if not len(at):
                continue
            x = np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x[:, :width]
            # sums modulo 2^64 are exact where the true one fits a long
            d = x.view(np.uint64) * np.uint64(n & 0xFFFFFFFFFFFFFFFF) - wrapped
            exact = (d * d).sum(axis=1, dtype=np.uint64).view(np.int64)
            fits = (((x.astype(float) * n - about) ** 2).sum(axis=1) < LIMIT * 1.001) & (exact >= 0)
            w = (x - mean) @ turn
            m = len(at)
            each = lambda a: np.repeat(a, k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each(at))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n, dtype=np.int64)), pa.array(each(exact), mask=~each(fits)), pa.array(w.ravel()),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, vector).mapInArrow(run, schema)
