"""Benchmark decontamination by the q-gram lemma.

A passage within ``e`` edits of an item of ``L`` characters shares at least
``L + 1 - q - q e`` q-grams with it, on diagonals (document position minus
item position) no more than ``e`` apart.  Per document the q-grams that some
item has are flagged; where the flags are dense enough for any item, they are
expanded to (item, diagonal), counted in bands of two neighbouring cells of
``e + 1`` diagonals (so every run of ``e + 1`` diagonals lies in one band),
and the bands that reach their item's bound are verified by banded
alignment of the item against the band's region.

Texts are compared as lower-case code points (letters whose lower case is one
code point; final sigma as sigma) with runs of Unicode white space as one space; spans are given in code points of the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shipped, written
from quarry.llm.words import blocks

Q = 8
#: Edit budget as a share of the item's length.
EDIT_SHARE = 0.08
#: Characters of items that are searched for in one pass over the documents.
ITEM_BLOCK_CHARS = 4_000_000
#: Pairs of equal q-grams (text position, item position) expanded at once.
EXPANDED = 1_000_000
#: Characters of documents handled at once (a longer text is its own block).
BLOCK_CHARS = 1_000_000

_R = 0x9E3779B97F4A7C15 | 1
#: All letters with case and all white space lie in the first two planes.
_TABLE = 0x20000
_LOWER = np.arange(_TABLE, dtype=np.uint32)
for _c in range(_TABLE):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
_LOWER[0x3C2] = 0x3C3                       # final sigma, which has no capital of its own
_SPACE = np.array([chr(_c).isspace() for _c in range(_TABLE)])
_SPACE[0x1C:0x20] = False                   # separators, not white space in Unicode


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and each text's offset among them."""
    texts = [t or "" for t in texts]
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), off


def normal(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased points with white space runs as one space, their offsets,
    and the position of each in the input."""
    low = points < _TABLE
    clipped = np.where(low, points, 0)
    space = _SPACE[clipped] & low
    drop = np.zeros(len(points), dtype=bool)
    drop[1:] = space[1:] & space[:-1]
    drop[off[:-1][off[:-1] < len(points)]] = False
    at = np.flatnonzero(~drop)
    out = np.where(low, _LOWER[clipped], points)
    out[space] = 32
    return out[at], np.searchsorted(at, off), at


def qgrams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """32-bit keys of all q-grams (those over a text's end included)."""
    m = max(0, len(points) - q + 1)
    out = np.zeros(m, dtype=np.uint64)
    x = points.astype(np.uint64)
    for i in range(q):
        out += x[i: i + m] * np.uint64(pow(_R, i + 1, 1 << 64))
    return ((out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def budget(length: int) -> int:
    """Edits allowed for an item; small enough that the lemma asks for a q-gram."""
    return max(0, min(int(length * EDIT_SHARE), (length - Q) // Q))


class Items:
    """Index of one block of items: q-gram -> (item, position)."""

    def __init__(self, ids: list[int], texts: list[str]):
        pts, off = code_points(texts)
        pts, off, _ = normal(pts, off)
        strip = [(a + (b > a and pts[a] == 32), b - (b > a + 1 and pts[b - 1] == 32)) for a, b in zip(off[:-1], off[1:])]
        self.ids = list(ids)
        self.points = [pts[a:b] for a, b in strip]
        self.length = np.array([len(p) for p in self.points], dtype=np.int64)
        self.edits = np.array([budget(n) for n in self.length.tolist()], dtype=np.int64)
        self.bound = np.maximum(1, self.length + 1 - Q - Q * self.edits)
        self.short = [i for i, n in enumerate(self.length.tolist()) if 0 < n < Q]
        grams = [qgrams(p) for p in self.points]
        key = np.concatenate([*grams, np.empty(0, np.uint32)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.key, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key)).astype(np.int64)
        self.item, self.pos = item[order], pos[order]
        self.flags = np.zeros(1 << 22, dtype=bool)
        self.flags[self.key >> np.uint32(10)] = True
        long = self.length >= Q
        self.span = int((self.length + self.edits)[long].max()) if long.any() else 0
        self.least = int(self.bound[long].min()) if long.any() else 0


def align(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of ``item`` against any part of each region (rows, padded
    with 0xFFFFFFFF), with the part's start and end.  A region is one band
    wide more than the item, so the whole table stays inside the band."""
    c, width = regions.shape
    band = width - len(item) + 1
    k = np.arange(band, dtype=np.int32)
    cost = np.zeros((c, band), dtype=np.int32)          # column j of row i: region position i + j
    begin = np.broadcast_to(k, (c, band)).copy()
    for i, ch in enumerate(item.tolist()):
        sub = cost + (regions[:, i: i + band] != ch)
        up = np.full_like(cost, 1 << 20)                # item character not in the region
        up[:, :-1] = cost[:, 1:] + 1
        b_up = np.zeros_like(begin)
        b_up[:, :-1] = begin[:, 1:]
        take = up < sub
        now = np.where(take, up, sub)
        b_now = np.where(take, b_up, begin)
        # region characters not in the item: runs along the row.  Row i + 1's
        # column j ends at region position i + 1 + j
        low = np.minimum.accumulate(now - k, axis=1)
        at = np.maximum.accumulate(np.where(now - k == low, k, 0), axis=1)
        cost = low + k
        begin = np.take_along_axis(b_now, at, axis=1)
    best = np.argmin(cost, axis=1)
    rows = np.arange(c)
    return cost[rows, best], begin[rows, best], best + len(item)


def _dense(flag: np.ndarray, span: int, least: int) -> np.ndarray:
    """Flagged positions that lie in some window of ``span`` with ``least`` flags."""
    at = np.flatnonzero(flag)
    if len(at) < least or not least:
        return at[:0]
    close = at[least - 1:] - at[: len(at) - least + 1] < span
    cover = np.zeros(len(at) + 1, dtype=np.int64)
    i = np.flatnonzero(close)
    np.add.at(cover, i, 1)
    np.add.at(cover, i + least, -1)
    return at[np.cumsum(cover[:-1]) > 0]


def _cell_counts(items: Items, at: np.ndarray, slot: np.ndarray, off: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared q-grams per (text, item, cell of diagonals), counted in slices of
    ``EXPANDED`` pairs, so that a text that repeats itself takes no more room."""
    n = items.first[slot + 1] - items.first[slot]
    upto = np.append(0, np.cumsum(n))
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    pending: list[tuple[np.ndarray, np.ndarray]] = []
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + EXPANDED, side="right")) - 1)
        m = n[a:b]
        where = np.repeat(items.first[slot[a:b]] - (upto[a:b] - upto[a]), m) + np.arange(int(upto[b] - upto[a]))
        item, pos = items.item[where], items.pos[where]
        hit = np.repeat(at[a:b], m)
        doc = np.searchsorted(off, hit, side="right") - 1
        diag = hit - pos
        e = items.edits[item]
        # no alignment within the budget starts more than e before its text
        ok = diag - off[doc] >= -e
        item, doc, diag, e = item[ok], doc[ok], diag[ok], e[ok]
        # cells are counted per text, so that a band never joins two texts
        cell = (diag - off[doc] + e) // (e + 1) + 1
        pending.append(np.unique((doc * len(items.ids) + item) * wide + cell, return_counts=True))
        a = b
        if a >= len(at) or sum(len(k) for k, _ in pending) > EXPANDED:
            every = np.concatenate([keys, *(k for k, _ in pending)])
            each = np.concatenate([counts, *(c for _, c in pending)])
            keys, place = np.unique(every, return_inverse=True)
            counts = np.bincount(place, weights=each, minlength=len(keys)).astype(np.int64)
            pending = []
    return keys, counts


def find(texts: list[str | None], items: Items) -> list[tuple[int, int, int, int, int]]:
    """``(text, item, start, end, edits)`` of passages within the budget; of
    overlapping ones of an item the one of fewest edits (then the first)."""
    raw, raw_off = code_points(texts)
    pts, off, back = normal(raw, raw_off)
    found: list[tuple[int, int, int, int, int]] = []
    if len(pts) >= Q and len(items.key):
        gram = qgrams(pts)
        flag = items.flags[gram >> np.uint32(10)]
        at = _dense(flag, items.span, items.least)
        slot = np.minimum(np.searchsorted(items.key, gram[at]), len(items.key) - 1)
        ok = items.key[slot] == gram[at]
        at, slot = at[ok], slot[ok]
        wide = int(len(pts)) + 4 * int(items.length.max(initial=0)) + 64
        key, count = _cell_counts(items, at, slot, off, wide)
        after = np.minimum(np.searchsorted(key, key + 1), len(key) - 1)
        both = count + np.where(key[after] == key + 1, count[after], 0) if len(key) else count
        # a band is a cell and the next one
        band = key[both >= items.bound[key // wide % len(items.ids)]]
        jobs: dict[int, list[tuple[int, int]]] = {}
        for x in band.tolist():
            di, cell_ = divmod(x, wide)
            d, i = divmod(di, len(items.ids))
            e_ = int(items.edits[i])
            jobs.setdefault(i, []).append((d, int(off[d]) + (cell_ - 1) * (e_ + 1) - e_))
        for i, places in jobs.items():
            e_, length = int(items.edits[i]), int(items.length[i])
            width = length + 4 * e_ + 2                # the band's 2 e + 2 diagonals and e on either side
            for a in range(0, len(places), 512):
                part = places[a: a + 512]
                region = np.full((len(part), width), 0xFFFFFFFF, dtype=np.uint32)
                for r, (d, diag_) in enumerate(part):
                    lo = diag_ - e_
                    x, y = max(lo, int(off[d])), min(lo + width, int(off[d + 1]))
                    if y > x:
                        region[r, x - lo: y - lo] = pts[x:y]
                cost, begin, end = align(items.points[i], region)
                for (d, diag_), c, b, f in zip(part, cost.tolist(), begin.tolist(), end.tolist()):
                    lo = diag_ - e_
                    b, f = max(b + lo, int(off[d])), min(f + lo, int(off[d + 1]))
                    if c <= e_ and f > b:
                        found.append((d, i, int(back[b]), int(back[f - 1]) + 1, c))
    for i in items.short:                               # too short for a q-gram: exact
        word = "".join(map(chr, items.points[i].tolist()))
        for d in range(len(texts)):
            seg = pts[off[d]: off[d + 1]].tobytes().decode("utf-32-le", "surrogatepass")
            p = seg.find(word)
            while p >= 0:
                found.append((d, i, int(back[off[d] + p]), int(back[off[d] + p + len(word) - 1]) + 1, 0))
                p = seg.find(word, p + len(word))
    out: list[tuple[int, int, int, int, int]] = []
    kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, i, b, f, c in sorted(found, key=lambda m: (m[0], m[1], m[4], m[2], m[3])):
        spans = kept.setdefault((d, i), [])
        if all(f <= x or b >= y for x, y in spans):
            spans.append((b, f))
            out.append((d, i, b - int(raw_off[d]), f - int(raw_off[d]), c))
    return out


def benchmark_matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id",
                      item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``doc_id, item_id, start_pos, end_pos, edits``: every passage of a whole
    text within an item's edit budget (of overlapping ones the best).

    Items of fewer than Q characters match exactly; null and empty items match
    nothing, null and empty texts hold nothing.  Repeated rows and equal
    items each report.  Items pass through in blocks of ITEM_BLOCK_CHARS, one
    pass over the documents each.  No items or no rows: no matches.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out_schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id bigint, start_pos bigint, "
                  "end_pos bigint, edits int")
    out = None
    for index in _indexes(items, item_text, item_key):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index()
            for batch in batches:
                for b in blocks(batch, "text", BLOCK_CHARS):
                    got = find(b.column("text").to_pylist(), held)
                    if got:
                        d, i, s, f, c = map(list, zip(*got))
                        ids = pa.array([held.ids[x] for x in i], pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [b.column("doc_id").take(pa.array(d)), ids, pa.array(s, pa.int64()), pa.array(f, pa.int64()),
                             pa.array(c, pa.int32())], ["doc_id", "item_id", "start_pos", "end_pos", "edits"])
        got = rows.mapInArrow(run, out_schema)
        out = got if out is None else out.unionByName(got)
    return out


def _indexes(items: DataFrame, item_text: str, item_key: str) -> Iterator:
    """Broadcast ``Items``, of ITEM_BLOCK_CHARS about; one at least."""
    wanted = items.where(F.length(F.trim(F.col(item_text))) > 0).select(F.col(item_key).cast("long").alias("item_id"),
                                                                      F.col(item_text).alias("text"))
    chars = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // ITEM_BLOCK_CHARS))
    for part in range(parts):
        some = wanted.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield shipped(items.sparkSession, Items([r["item_id"] for r in some], [r["text"] for r in some]))


def without_matches(docs: DataFrame, items: DataFrame, item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of ``docs`` (all columns) whose ``text`` holds no passage that
    ``benchmark_matches`` reports.  Every row is judged by itself, whatever
    its id.  Between passes over the items the rows are written."""
    out = None
    for index in _indexes(items, item_text, item_key):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index()
            for batch in batches:
                for b in blocks(batch, "text", BLOCK_CHARS):
                    clean = np.ones(b.num_rows, dtype=bool)
                    clean[[d for d, *_ in find(b.column("text").to_pylist(), held)]] = False
                    yield b.filter(pa.array(clean))
        out = (docs if out is None else written(out, "decontamination-pass")).mapInArrow(run, docs.schema)
    return out
