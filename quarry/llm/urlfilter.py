"""URL filters by a Bloom filter cascade.

Level 1 encodes the listed keys, level 2 the keys of the universe that pass
level 1 though not listed, level 3 the listed keys that pass level 2, and so
on until nothing passes wrongly.  For every key of the universe the level at
which it first fails tells its membership exactly, without a join; a key
outside the universe has no guarantee, so the universe is every key of the
corpus.  False positives are found by distributed scans; only the levels'
bits come to the driver, and their size is set by counts before that.

Large lists are cut into shards by key hash, one cascade of bounded size each;
keys and rows are then dealt to their shards once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shipped, written
from quarry.session import scratch_path

#: Keys a shard holds, about; so a cascade takes some 20 bits of each at most.
SHARD_KEYS = 8_000_000
MAX_LEVELS = 60


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; empty for a null or a url without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def rule_column(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null.  A rule fits
    its host and all subdomains where the path starts with the rule's."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):       # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


@dataclass(frozen=True)
class Level:
    bits: np.ndarray
    hashes: int


def _slots(h: np.ndarray, level: int, hashes: int, size: int) -> Iterator[np.ndarray]:
    """Bit positions of keys by double hashing; every level draws anew."""
    with np.errstate(over="ignore"):
        a = (h ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        b = (a * np.uint64(0x94D049BB133111EB)) >> np.uint64(17) | np.uint64(1)
        a ^= a >> np.uint64(29)
        for i in range(hashes):
            yield (a + np.uint64(i) * b) % np.uint64(size)


def passes(h: np.ndarray, number: int, level: Level) -> np.ndarray:
    ok = np.ones(len(h), dtype=bool)
    for slot in _slots(h, number, level.hashes, len(level.bits) * 8):
        ok &= (level.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def member(h: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Membership of keys of the universe: the parity of the levels passed."""
    out = np.zeros(len(h), dtype=bool)
    alive = np.ones(len(h), dtype=bool)
    for i, level in enumerate(levels):
        alive[alive] = passes(h[alive], i, level)
        out[alive] = i % 2 == 0
    return out


def _level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """A filter over column ``h``; its bits are set by tasks and or-ed."""
    rate = min(0.5, max(rate, 1e-6))
    hashes = max(1, round(-math.log2(rate)))
    size = max(64, 8 * math.ceil(n * 1.4427 * -math.log2(rate) / 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            slots = np.unique(np.concatenate([*_slots(h, number, hashes, size), np.empty(0, np.uint64)]))
            word, at = np.unique(slots >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), at) if len(at) else slots
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    words = keys.select("h").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(-(-size // 64), dtype=np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return Level(out.view(np.uint8)[: size // 8], hashes)


def build_cascade(keys: DataFrame) -> list[Level]:
    """Levels over ``keys`` (``h``: distinct 64-bit keys of the universe,
    ``listed``: is it on the list).  No listed key: no level."""
    n_all, n_listed = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0))).first()
    levels: list[Level] = []
    wanted, n, rest, n_rest = keys.where("listed"), n_listed, keys.where("not listed"), n_all - n_listed
    while n:
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end: two keys share their 64-bit hash")
        level = _level(wanted, n, n / max(1, n_rest) if not levels else 0.5, len(levels))
        held, number = shipped(keys.sparkSession, level), len(levels)

        def run(batches: Iterator[pa.RecordBatch], held=held, number=number) -> Iterator[pa.RecordBatch]:
            level = held()
            for b in batches:
                h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(passes(h, number, level)))], ["h"])

        levels.append(level)
        wrong = written(rest.select("h").mapInArrow(run, "h bigint"), "cascade")
        wanted, n, rest, n_rest = wrong, wrong.count(), wanted, n
    return levels


def _asked(levels):
    @F.pandas_udf("boolean")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = levels()
        for h in batches:
            yield pd.Series(member(h.to_numpy(dtype=np.int64).view(np.uint64), held))
    return ask


def listed_keys(rows: DataFrame, key: str, universe: DataFrame, out: str = "listed", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``rows`` with a boolean column: is ``rows[key]`` listed?  ``universe``
    holds ``key`` and ``listed`` for every key that rows can have (repeated
    keys: listed if any of them is).  Null keys are never listed."""
    keys = (universe.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("h"))
            .agg(F.max("listed").alias("listed")))
    keys = written(keys, "cascade-keys")
    shards = max(1, -(-keys.count() // shard_keys))
    if shards > 1:                                     # dealt out once; each shard then reads its own
        keys = _sharded(keys, F.col("h"), shards, "cascade-keys")
        rows = _sharded(rows, F.xxhash64(F.col(key)), shards, "cascade-rows")
    result = None
    for s in range(shards):
        mine, part = (keys, rows) if shards == 1 else (d.where(F.col("_shard") == s).drop("_shard") for d in (keys, rows))
        levels = shipped(rows.sparkSession, build_cascade(mine))
        part = part.withColumn(out, _asked(levels)(F.xxhash64(F.col(key))) & F.col(key).isNotNull())
        result = part if result is None else result.unionByName(part)
    return result


def _sharded(df: DataFrame, h: Column, shards: int, name: str) -> DataFrame:
    """``df`` written with ``_shard``, a folder each."""
    path = scratch_path(df.sparkSession, name)
    df.withColumn("_shard", F.pmod(F.xxhash64(h), F.lit(shards)).cast("int")).write.partitionBy("_shard").parquet(path)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.sparkSession.read.schema(f"{kinds}, _shard int").parquet(path)


def judge_urls(pages: DataFrame, rules: list[Rule], list_of: Column, url: str = "url", key: str = "page_id",
               shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict``.

    The longest fitting rule decides; other urls are blocked when their host
    is listed.  ``list_of`` tells of a host (column ``host``) whether it is
    listed; it is asked once per distinct host of the corpus.  A null url or
    one without ``://`` has an empty host and path.  Repeated rows get equal
    rows; empty input gives none.
    """
    rows = pages.select(F.col(key).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    universe = rows.select("host").distinct().withColumn("listed", F.coalesce(list_of, F.lit(False)))
    out = listed_keys(rows, "host", universe, shard_keys=shard_keys)
    host, path = F.col("host"), F.col("path")
    by_rule = rule_column(host, path, rules, lambda r: "allow" if r.allow else "block")
    return out.select("page_id", "host", "path", rule_column(host, path, rules, lambda r: r.name).cast("string").alias("rule"),
                      F.coalesce(by_rule, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
