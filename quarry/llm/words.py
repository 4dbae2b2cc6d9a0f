"""Vectorised word arithmetic over Arrow string columns.

A block of texts is looked at as one UTF-8 byte buffer.  Words are the runs
``[^\\x20\\x09-\\x0D]+``; a word's 64-bit key is a polynomial over its bytes,
taken from prefix sums, so no Python string is made per word.  Every byte of
every text is read; nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once (a longer text makes a block of its own).
BLOCK_BYTES = 2_000_000

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Tables(dict):
    """Per-process cache; shipped empty with a task."""

    def __reduce__(self):
        return _Tables, ()


_tables = _Tables()

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Splitmix finaliser: spreads 64-bit keys; ``seed`` picks the order."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, n - 1).bit_length()
        for name, base in (("up", _R), ("down", _RINV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums from which ``range_hash`` takes the key of any byte range."""
    up, _ = _powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of byte ranges; equal bytes give equal keys."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def string_block(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``limit`` bytes; a longer
    text is a slice of its own."""
    _, off = string_block(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a block of texts.

    ``start``/``end``: byte positions; ``doc``: index of the text;
    ``first``: index of each text's first word (one more entry than texts).
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, off = string_block(column)
        self.raw, self.offsets = (LOWER[raw] if lower else raw), off
        n = len(raw)
        inside = ~IS_SPACE[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_sums"):
            self._sums = prefix_sums(self.raw)
        return range_hash(self._sums, start, end)

    def hashes(self) -> np.ndarray:
        return self.range_hash(self.start, self.end)

    def points(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points in byte ranges."""
        count = np.zeros(len(self.raw) + 1, dtype=np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=count[1:])
        return count[end] - count[start]


_K = [np.uint64(pow(0xD6E8FEB86659FD93 | 1, i + 1, 1 << 64)) for i in range(64)]


def ngram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Keys of the windows of ``n`` consecutive words (over text borders too:
    the caller keeps the windows that stay inside a text)."""
    m = max(0, len(word_hash) - n + 1)
    out = np.full(m, n, dtype=np.uint64)
    for i in range(n):
        out += word_hash[i: i + m] * _K[i]
    return mix(out)


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct ``n``-word shingles; a text of fewer words
    has its whole sequence as one; a text without words an empty set."""
    h = words.hashes()
    grams = ngram_hashes(h, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a: b - n + 1]))
        elif b > a:
            out.append(ngram_hashes(h[a:b], b - a))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
