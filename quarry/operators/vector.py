"""Exact k-nearest-neighbour search (squared L2) over tiles with distance bounds.

Index rows are packed into tiles of rows that lie near one another (dealt by
their nearest pivot, a few sampled vectors), queries into blocks alike.  Each
tile and block has, per pivot, the interval of its rows' distances to it.  By
the triangle inequality two such intervals bound every distance between a
block's queries and a tile's rows from below and from above, so

1. the tiles that must hold k neighbours of all of a block's queries give a
   bound on the k-th distance, and tiles that lie beyond it are left out;
2. a block is scored against its nearest tiles first; the k-th distances
   found there tighten the bound for the rest.

What is paired up are tile and block numbers with their intervals; a block's
bytes are shipped to its tasks, and the bytes of the tiles that it is compared
with after it.  A task scores a block against one tile at a time, keeps the k
nearest rows of each query and emits those; the final top-k runs over them.  Neither vectors nor
results pass through the driver (but for the pivots), and no (query, vector)
pair becomes a row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.common import significant, sized, top_k_per_group

# Rows of a tile or block, and of the pieces that are scored at once: a
# piece's distance matrix holds QUERY_PIECE * ROWS numbers at most.
ROWS = 2048
QUERY_PIECE = 256
#: Sampled vectors whose distances bound all others.
PIVOTS = 16
#: Tiles that a block is compared with before the others.
FIRST_TILES = 4
#: So few tiles are all compared: finding bounds would cost more.
ALL_TILES = 32
#: Tiles that a task compares with a block, and such tasks at most.
RUN_TILES, MAX_TASKS = 64, 10_000
#: Room for the rounding of distances.
ROOM = 1e-9

# worker-side code travels by value: workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _load(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if not len(lengths):
        return np.zeros((0, 0))
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), int(lengths[0]))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots, a row of numbers per row."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(x), 0))


def _packed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(number, n, lo, hi, block)`` of ``rows (..., vector)``: rows of one
    nearest pivot, by their distance to it, ROWS to a block at most.  Blocks end
    where the nearest pivot changes, so there are at most PIVOTS more of them a
    task."""
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_matrix(b.column("vector")), pivots)
            home = d.argmin(1) if d.shape[1] else np.zeros(b.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home] if d.shape[1] else np.zeros(b.num_rows))],
                [*b.schema.names, "_home", "_far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            batch = t.drop(["_home", "_far"]).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            d = _distances(_matrix(batch.column("vector")), pivots)
            return pa.RecordBatch.from_arrays(
                [pa.array([batch.num_rows], pa.int64()), pa.array([d.min(0).tolist()], pa.list_(pa.float64())),
                 pa.array([d.max(0).tolist()], pa.list_(pa.float64())), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["n", "lo", "hi", "block"])
        for b in batches:
            home = b.column("_home").to_numpy()
            cuts = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), b.num_rows]
            for a, e in zip(cuts, cuts[1:]):
                if e == a:
                    continue
                part = pa.Table.from_batches([b.slice(a, e - a)])
                if held is not None and held.column("_home")[0] != part.column("_home")[0]:
                    yield out(held)
                    held = None
                held = part if held is None else pa.concat_tables([held, part])
                while held.num_rows > ROWS:
                    yield out(held.slice(0, ROWS))
                    held = held.slice(ROWS)
        if held is not None and held.num_rows:
            yield out(held)

    kind = T.StructType([*rows.schema.fields, T.StructField("_home", T.IntegerType()), T.StructField("_far", T.DoubleType())])
    # in ranges of (nearest pivot, distance to it): a pivot that most rows are near to has many
    laid = rows.mapInArrow(near, kind)
    if len(pivots):
        laid = laid.repartitionByRange("_home", "_far").sortWithinPartitions("_home", "_far")
    blocks = laid.mapInArrow(pack, "n bigint, lo array<double>, hi array<double>, block binary")
    return blocks.withColumn("number", F.monotonically_increasing_id())


def _cut(x: np.ndarray) -> np.ndarray:
    """Twelve significant digits, as ``common.significant`` cuts them."""
    with np.errstate(divide="ignore"):
        e = np.where(x > 0, np.floor(np.log10(np.where(x > 0, x, 1))), 0)
    scale = 10.0 ** (11 - e)
    return np.round(x * scale) / scale


def _score(rows: list[pd.DataFrame], keys: list[str], k: int) -> pd.DataFrame:
    """The k nearest of ``rows (at, dist, cut, *keys)`` of each query, ties by key."""
    every = pd.concat(rows, ignore_index=True).sort_values(["at", "cut", *keys], kind="mergesort", ignore_index=True)
    first = every["at"].to_numpy()
    return every[np.arange(len(first)) - np.searchsorted(first, first) < k]


class _Nearest:
    """The k nearest rows so far of each query of a block; tiles are added one
    after the other, and only rows within a query's k-th distance are kept."""

    def __init__(self, q: np.ndarray, keys: list[str], k: int):
        self.q, self.keys, self.k = q, keys, k
        self.norm = (q * q).sum(1)
        self.ahead = np.column_stack([q, np.ones(len(q))]) if len(q) else q
        self.kth = np.full(len(q), np.inf)
        self.held: list[pd.DataFrame] = []
        self.fresh = 0

    def add(self, rows: pd.DataFrame, x: np.ndarray) -> None:
        xn = (x * x).sum(1)
        behind = np.column_stack([x, -xn / 2]).T                # q.x - xx/2: the larger, the nearer
        room = 1e-6 + 1e-12 * (self.norm + (xn.max(initial=0.0, where=np.isfinite(xn))))
        for a in range(0, len(self.q), QUERY_PIECE):
            b = slice(a, a + QUERY_PIECE)
            near, kth = self.ahead[b] @ behind, self.kth[b]
            new = ~np.isfinite(kth)
            if new.any() and len(x) >= self.k:
                # no bound yet: the k-th nearest of this tile
                some = np.partition(np.where(np.isnan(near[new]), -np.inf, near[new]), len(x) - self.k, axis=1)[:, len(x) - self.k]
                kth = kth.copy()
                kth[new] = self.norm[b][new] - 2 * some
            limit = kth + room[b] + 1e-9 * (1.0 + np.abs(kth))
            close = near >= ((self.norm[b] - limit) / 2)[:, None]
            # exact distances of the candidates, a bounded number at a time
            for one in np.array_split(np.arange(len(close)), max(1, int(close.sum()) // 65_536)):
                qi, xi = np.nonzero(close[one])
                if not len(qi):
                    continue
                at = a + one[qi]
                d = x[xi] - self.q[at]
                dist = (d * d).sum(1)
                got = rows.iloc[xi].reset_index(drop=True)
                got.insert(0, "at", at)
                got["dist"], got["cut"] = dist, _cut(dist)
                self._take(got)

    def _take(self, got: pd.DataFrame) -> None:
        self.held.append(got)
        self.fresh += len(got)
        if np.isinf(self.kth).any() or self.fresh > len(self.q) * self.k:
            self.settle()

    def settle(self) -> pd.DataFrame | None:
        if not self.held:
            return None
        best = _score(self.held, self.keys, self.k)
        self.held, self.fresh = [best], 0
        at = best["at"].to_numpy()
        last = np.append(at[1:] != at[:-1], True)
        full = last & (np.arange(len(at)) - np.searchsorted(at, at) == self.k - 1)
        self.kth[at[full]] = best["dist"].to_numpy()[full]
        return best


def _scored(tiles: DataFrame, blocks: DataFrame, pairs: DataFrame, keys: list[str], k: int, schema: T.StructType) -> DataFrame:
    """The nearest rows of the queries of ``pairs (tile, block_no)``.  A task
    holds a block and meets up to RUN_TILES of its tiles one after the other, so
    it gives k rows a query, however many tiles there are."""
    n_blocks, n_tiles = max(1, blocks.count()), max(1, tiles.count())
    cores = tiles.sparkSession.sparkContext.defaultParallelism
    parts = min(n_tiles, max(-(-n_tiles // RUN_TILES), -(-2 * cores // n_blocks)))
    dealt = pairs.select("tile", "block_no", F.pmod(F.xxhash64("tile"), F.lit(parts)).alias("part"))
    ship = (dealt.select("block_no", "part").distinct().join(blocks, F.col("number") == F.col("block_no"))
            .select("block_no", "part", F.lit(-1).cast("long").alias("tile"), "block")
            .unionByName(dealt.join(tiles, F.col("number") == F.col("tile")).select("block_no", "part", "tile", "block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nearest = None, None

        def out() -> Iterator[pa.RecordBatch]:
            best = None if nearest is None else nearest.settle()
            if best is not None:
                got = best[[*keys, "dist"]].reset_index(drop=True)
                got.insert(0, "query_id", ids[best["at"].to_numpy()])
                yield from pa.Table.from_pandas(got, preserve_index=False).to_batches()

        for batch in batches:
            for number, block in zip(batch.column("tile").to_pylist(), batch.column("block")):
                part = _load(block.as_py())
                if number < 0:
                    yield from out()
                    ids = part.column("query_id").to_pandas().to_numpy()
                    nearest = _Nearest(_matrix(part.column("vector")), keys, k)
                else:
                    nearest.add(part.select(keys).to_pandas(), _matrix(part.column("vector")))
        yield from out()

    tasks = min(n_blocks * parts, MAX_TASKS)
    return ship.repartition(tasks, "block_no", "part").sortWithinPartitions("block_no", "part", "tile").mapInArrow(run, schema)


def _bound(name: str, pick, a: str, b: str) -> Column:
    """``pick`` of ``name[a] ? name[b]`` over the pivots."""
    return F.coalesce(pick(F.zip_with(a, b, name)), F.lit(0.0))


def knn(index: DataFrame, queries: DataFrame, k: int = 5, keys: list[str] | None = None,
        vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "vector",
        rank_col: str = "rank", trace: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(query_id, rank, *keys, dist)``: the ``k`` index rows nearest to
    each query, ascending squared distance (to 12 significant digits), ties by
    key.  Null vectors take no part.  ``trace`` receives the pairs of block and
    tile numbers: all, and those that were compared."""
    keys = keys or [c for c in index.columns if c != vec_col]
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("vector")).where(F.col("vector").isNotNull())
    x = index.select(*keys, F.col(vec_col).alias("vector")).where(F.col("vector").isNotNull())
    schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), *[index.schema[c] for c in keys],
                           T.StructField("dist", T.DoubleType())])
    if x.select(F.lit(1)).limit(ALL_TILES * ROWS + 1).count() <= ALL_TILES * ROWS:
        tiles = sized(_packed(x, np.zeros((0, 0))), "knn-tiles")
        numbers = [r["number"] for r in tiles.select("number").collect()]              # a number per tile
        every = F.array(*[F.lit(n) for n in numbers]).cast("array<bigint>")
        blocks = sized(_packed(q, np.zeros((0, 0))), "knn-blocks")
        pairs = blocks.select(F.explode(every).alias("tile"), F.col("number").alias("block_no"))
        if trace is not None:
            trace.update(all=pairs, compared=pairs)
        return top_k_per_group(_scored(tiles, blocks, pairs, keys, k, schema), ["query_id"], _nearest_first(keys), k, rank_col)
    sample = [r["vector"] for r in x.select("vector").orderBy(F.xxhash64("vector")).limit(PIVOTS).collect()]
    pivots = np.unique(np.array(sample, dtype=np.float64), axis=0) if sample else np.zeros((0, 0))
    tiles, blocks = sized(_packed(x, pivots), "knn-tiles"), sized(_packed(q, pivots), "knn-blocks")

    # numbers and intervals only: a row per tile and block of ROWS rows each
    t = tiles.select(F.col("number").alias("tile"), "n", F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    b = blocks.select(F.col("number").alias("block_no"), "lo", "hi")
    apart = F.greatest(_bound(lambda u, v: u - v, F.array_max, "tlo", "hi"), _bound(lambda u, v: u - v, F.array_max, "lo", "thi"), F.lit(0.0))
    within = F.array_min(F.zip_with("hi", "thi", lambda u, v: u + v))
    every = sized(b.crossJoin(t).select("block_no", "tile", "n", (apart * (1 - ROOM)).alias("apart"), (within * (1 + ROOM)).alias("within")), "knn-pairs")
    return _nearest(every, tiles, blocks, keys, k, schema, rank_col, trace)


def _nearest(every: DataFrame, tiles: DataFrame, blocks: DataFrame, keys: list[str], k: int, schema: T.StructType,
             rank_col: str, trace: dict[str, DataFrame] | None) -> DataFrame:
    # a block's queries all have k rows within the tiles that add up to k rows
    order = Window.partitionBy("block_no").orderBy("within", "tile")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    reach = every.withColumn("_n", upto).where(F.col("_n") >= k).groupBy("block_no").agg(F.min("within").alias("reach"))
    live = every.join(reach, "block_no", "left").where(F.col("reach").isNull() | (F.col("apart") <= F.col("reach")))
    live = sized(live.withColumn("_turn", F.row_number().over(Window.partitionBy("block_no").orderBy("apart", "within", "tile")))
                 .select("block_no", "tile", "apart", "_turn"), "knn-live")
    top = _nearest_first(keys)
    first = live.where(F.col("_turn") <= FIRST_TILES)
    near = top_k_per_group(_scored(tiles, blocks, first, keys, k, schema), ["query_id"], top, k, rank_col)
    if live.where(F.col("_turn") > FIRST_TILES).isEmpty():
        if trace is not None:
            trace.update(all=every, compared=first)
        return near
    near = sized(near, "knn-first")
    # the k-th distances found bound the rest: the largest of a block's queries counts
    kth = near.where(F.col(rank_col) == k).select("query_id", F.sqrt("dist").alias("kth"))
    of = blocks.select(F.col("number").alias("block_no"), "block").mapInArrow(_members, T.StructType([
        T.StructField("block_no", T.LongType()), schema["query_id"]]))
    bound = (of.join(kth, "query_id", "left").groupBy("block_no")
             .agg(F.max("kth").alias("kth"), F.max(F.col("kth").isNull()).alias("open")))
    rest = (live.where(F.col("_turn") > FIRST_TILES).join(bound, "block_no")
            .where(F.col("open") | (F.col("apart") <= F.col("kth") * (1 + ROOM) + ROOM)).select("block_no", "tile"))
    rest = sized(rest, "knn-rest")
    if trace is not None:
        trace.update(all=every, compared=first.select("block_no", "tile").unionByName(rest))
    more = _scored(tiles, blocks, rest, keys, k, schema)
    return top_k_per_group(near.drop(rank_col).unionByName(more), ["query_id"], top, k, rank_col)


def _nearest_first(keys: list[str]) -> list[Column]:
    return [significant(F.col("dist")).asc(), *[F.col(c).asc() for c in keys]]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = _load(block.as_py()).column("query_id")
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), ids], ["block_no", "query_id"])
