"""N-gram Jaccard join by multiple-global-order prefix filtering.

Texts are sets of five-word shingles; equal sets are one *class* from the
start.  Two sets of Jaccard similarity >= t must share a token within the
first ``n - ceil(t n) + 1`` tokens of each, under *every* global order of the
tokens.  Order 1 finds candidates (classes that share a prefix token, within
the length and position bounds).  Sketches then bound the overlap from above:
a set's tokens are counted in SKETCH classes, and two sets share at most the
sum of the smaller counts; only candidates that pass move texts.  They must
share prefix tokens under the further orders too, and what is left is
verified on the whole sets.

Every order puts frequent tokens last and is a hash order otherwise.
"Frequent" rests on counts over all documents, gathered wherever a block
holds a token twice; it only shapes the order, so it cannot change results.
At most FREQUENT tokens are frequent by construction (each takes that share
of all tokens), which bounds the broadcast list.

Groups of copies are not expanded into pairs.  A first round links members of
a bucket to its pivots and joins what is similar; the second round takes only
pairs of a bucket that are still in different components, all of them, so no
link between different texts is lost.  Buckets of frequent tokens are dealt
out in SALTS parts in the first round.  In the second, large buckets are cut
into blocks; a task compares two blocks by sketches and emits only the pairs
that pass, and skips a pair whose sets both lead with one common token that
comes earlier: that token's bucket has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_by_key, written
from quarry.llm.components import components
from quarry.llm.words import Words, blocks, mix, shingle_sets

#: Similarity as a fraction (numerator, denominator).
THRESHOLD = (4, 5)
SHINGLE = 5
#: Token orders: the first finds candidates, the others filter them.
ORDERS = (1, 2, 3)
#: Most tokens that can be frequent (8 bytes each), and the least count.
FREQUENT = 1 << 22
FREQUENT_LEAST = 32
SALTS = 64
#: Token classes that a set's tokens are counted in (a byte each).
SKETCH = 1024
#: First prefix tokens that a class carries to recognise pairs met before.
LEAD = 8
#: Buckets of more classes are compared inside tasks, in blocks of BLOCK.
LARGE_BUCKET, BLOCK = 32, 2048
#: Bits of the fixed-size filter of classes whose texts are wanted.
WANTED_BITS = 1 << 26
#: Bytes of text whose words are keyed at once: some thirty times as many are
#: held meanwhile.  Sets are an eighth of that, so more texts' are held.
KEYED_BYTES = 500_000
#: Rows of sorted buckets looked at in one go, and pairs held to find equal ones.
RUN_ROWS, HELD_PAIRS = 1 << 16, 1 << 19


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _digest(s: np.ndarray) -> int:
    """Key of a sorted set; order matters not, size does."""
    x = int(mix(s, 11).sum(dtype=np.uint64)) ^ int(mix(s, 13).sum(dtype=np.uint64)) * 0x9E3779B97F4A7C15 ^ len(s)
    return ((x + (1 << 63)) & ((1 << 64) - 1)) - (1 << 63)


def _is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _sets(column: pa.Array) -> list[np.ndarray]:
    """``shingle_sets`` of texts, a few texts at a time."""
    texts = pa.RecordBatch.from_arrays([column], ["text"])
    return [s for b in blocks(texts, "text", KEYED_BYTES) for s in shingle_sets(Words(b.column("text"), lower=True), SHINGLE)]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = RUN_ROWS) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows out of batches that come in the order of
    ``keys``; rows of equal keys are never parted."""
    held: list[pa.RecordBatch] = []
    n, least = 0, rows
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.logical_and.reduce([t.column(k).to_numpy() == t.column(k)[-1].as_py() for k in keys])
        cut = 0 if same.all() else n - int(np.argmin(same[::-1]))
        if cut:
            yield t.slice(0, cut)
        held, n = (t.slice(cut).to_batches(), n - cut)
        least = max(rows, 2 * n)                     # a bucket of many rows is not looked at again for every batch
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


class _Pairs:
    """Distinct pairs, given in batches; a bounded number is held."""

    def __init__(self):
        self.held = np.empty((0, 2), np.int64)
        self.fresh: list[np.ndarray] = []
        self.n = 0

    def add(self, pairs: np.ndarray) -> bool:
        """Is it time to give the pairs out?"""
        self.fresh.append(pairs)
        self.n += len(pairs)
        if self.n > max(HELD_PAIRS, len(self.held)):
            self.settle()
        return len(self.held) > HELD_PAIRS

    def settle(self) -> None:
        self.held, self.fresh, self.n = np.unique(np.concatenate([self.held, *self.fresh]), axis=0), [], 0

    def out(self) -> tuple[pa.Array, pa.Array]:
        self.settle()
        pairs, self.held = self.held, np.empty((0, 2), np.int64)
        return pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))


def prefix(s: np.ndarray, order: int, frequent: np.ndarray) -> np.ndarray:
    """The prefix of a set under an order, first tokens first."""
    n = len(s)
    p = n + (-THRESHOLD[0] * n // THRESHOLD[1]) + 1
    key = mix(s, order) >> np.uint64(1) | _is_in(frequent, s).astype(np.uint64) << np.uint64(63)
    first = np.argpartition(key, p - 1)[:p] if p < n else np.arange(n)
    return s[first[np.argsort(key[first], kind="stable")]]


def _bounds(na, ia, nb, ib):
    """May two sets that share a token at these prefix positions be similar?
    (Sizes close enough, and enough tokens left for the needed overlap.)"""
    num, den = THRESHOLD
    least, most = np.minimum(na, nb), np.maximum(na, nb)
    need = -(-num * (na + nb) // (num + den))
    return (den * least >= num * most) & (np.minimum(ia, ib) + 1 + np.minimum(na - ia - 1, nb - ib - 1) >= need)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a document (id, class, size); kind 1: a token that a block holds
    more than once (token, times); kind 2: tokens of a block (-, -, number)."""
    for batch in batches:
        for b in blocks(batch, "text", 4_000_000):
            sets = _sets(b.column("text"))
            ids = b.column("doc_id").cast(pa.int64())
            n = np.array([len(s) for s in sets], dtype=np.int64)
            cls = np.array([_digest(s) if len(s) else 0 for s in sets], dtype=np.int64)
            seen = {int(c): s for c, s in zip(cls, sets) if len(s)}            # copies count once per block
            tokens, times = np.unique(np.concatenate([*seen.values(), np.empty(0, np.uint64)]), return_counts=True)
            often = times > 1
            tokens, times = tokens[often], times[often]
            m, k = len(ids), len(tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([0, 1, 2], [m, k, 1]).astype(np.int32)),
                 pa.concat_arrays([ids, _long(tokens), pa.array([0], pa.int64())]),
                 pa.array(np.concatenate([cls, times, [0]])), pa.array(np.concatenate([n, np.zeros(k, np.int64), [n.sum()]]))],
                ["kind", "a", "b", "n"])


def _prefix_rows(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            for b in blocks(batch, "text", 4_000_000):
                sets = _sets(b.column("text"))
                once = {_digest(s): s for s in sets if len(s)}
                if not once:
                    continue
                cols = [[], [], [], []]
                for c, s in once.items():
                    t = prefix(s, ORDERS[0], often)
                    for col, x in zip(cols, (t, np.full(len(t), c, np.int64), np.full(len(t), len(s), np.int32),
                                             np.arange(len(t), dtype=np.int32))):
                        col.append(x)
                token, cls, n, pos = map(np.concatenate, cols)
                hot = _is_in(often, token)
                salt = mix(cls.view(np.uint64) ^ token, 17) % np.uint64(SALTS)      # other parts for every token
                key = np.where(hot, mix(token + salt, 19), token)
                yield pa.RecordBatch.from_arrays([_long(key), _long(token), pa.array(cls), pa.array(n), pa.array(pos),
                                                  pa.array(hot)], ["key", "token", "cls", "n", "pos", "hot"])
    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of prefix rows in the order of key and class: the rows of tokens that
    several classes share (pair = false) and pivot pairs (pair = true)."""
    names = ["pair", "token", "cls", "n", "pos"]
    pairs = _Pairs()

    def linked() -> pa.RecordBatch:
        a, b = pairs.out()
        none = pa.array(np.zeros(len(a), np.int32))
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), bool)), a, b, none, none], names)

    for table in _runs(batches, ["key"]):
        key, token, cls, n, pos, hot = (table.column(c).to_numpy() for c in ("key", "token", "cls", "n", "pos", "hot"))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, token, cls, n, pos, hot = (x[new] for x in (key, token, cls, n, pos, hot))
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        keep = np.repeat(size > 1, size) | hot
        full = False
        for a, m in zip(start[size > 1].tolist(), size[size > 1].tolist()):
            # two pivots, drawn anew in every bucket, so that a group of near
            # copies meets many of its members
            draw = np.argsort(mix(cls[a: a + m].view(np.uint64), int(key[a]) & 0xFFFF))
            for pivot in draw[: 1 + (m > 16)]:
                i = a + int(pivot)
                ok = _bounds(int(n[i]), int(pos[i]), n[a: a + m].astype(np.int64), pos[a: a + m].astype(np.int64))
                ok[pivot] = False
                other = cls[a: a + m][ok]
                full |= pairs.add(np.stack([np.minimum(other, cls[i]), np.maximum(other, cls[i])], 1))
        rows = np.flatnonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), bool)), pa.array(token[rows]), pa.array(cls[rows]),
                                          pa.array(n[rows]), pa.array(pos[rows])], names)
        if full:
            yield linked()
    yield linked()


def _sketch(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH), 255).astype(np.uint8).tobytes()


def _lead(s: np.ndarray, frequent: np.ndarray) -> bytes:
    """The first LEAD prefix tokens; a shorter prefix repeats its last one."""
    p = prefix(s, ORDERS[0], frequent)[:LEAD]
    return np.concatenate([p, np.repeat(p[-1:], LEAD - len(p))]).tobytes()


def _may_overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow the needed overlap.  A full counter (255)
    bounds nothing, so such a pair passes."""
    num, den = THRESHOLD
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
        na, nb = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
        least = np.minimum(x, y)
        ok = (least.max(1) == 255) | (least.sum(1, dtype=np.int64) >= -(-num * (na + nb) // (num + den)))
        yield b.select(["a", "b"]).filter(pa.array(ok))


def _large_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of large buckets that are still apart and may be similar.  Rows, in
    the order of the first three: token, the two blocks (x <= y), the class's own
    block, and its data."""
    num, den = THRESHOLD
    pairs = _Pairs()
    for t in _runs(batches, ["token", "x", "y"], 2 * BLOCK):
        token, x, y, own, cls, n, pos, label = (t.column(c).to_numpy() for c in ("token", "x", "y", "own", "cls", "n", "pos", "label"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        lead = np.frombuffer(b"".join(t.column("lead").to_pylist()), np.int64).reshape(-1, LEAD)
        order = np.lexsort((cls, y, x, token))
        cut = np.flatnonzero(np.r_[True, np.any(np.stack([token, x, y])[:, order][:, 1:] != np.stack([token, x, y])[:, order][:, :-1], axis=0), True])
        full = False
        for a, b in zip(cut[:-1], cut[1:]):
            i = order[a:b]
            names, sizes = np.unique(label[i], return_counts=True)
            if len(names) == 1:
                continue
            most = names[np.argmax(sizes)]
            for r in i[label[i] != most]:
                # each pair once: with the largest component, else in class order
                o = i[(label[i] != label[r]) & ((label[i] == most) | (cls[i] > cls[r]))]
                if x[r] != y[r]:
                    o = o[own[o] != own[r]]
                o = o[_bounds(int(n[r]), int(pos[r]), n[o].astype(np.int64), pos[o].astype(np.int64))]
                # tokens before this one in both sets' order: an earlier bucket has the pair
                met = np.zeros(len(o), dtype=bool)
                for k in range(min(LEAD, int(pos[r]))):
                    met |= (lead[o] == lead[r, k]).any(1)
                o = o[~met]
                if not len(o):
                    continue
                least = np.minimum(sketch[o], sketch[r])
                ok = (least.max(1) == 255) | (least.sum(1, dtype=np.int64) >= -(-num * (n[o].astype(np.int64) + int(n[r])) // (num + den)))
                o = o[ok]
                full |= pairs.add(np.stack([np.minimum(cls[o], cls[r]), np.maximum(cls[o], cls[r])], 1))
        if full:
            yield pa.RecordBatch.from_arrays(list(pairs.out()), ["a", "b"])
    yield pa.RecordBatch.from_arrays(list(pairs.out()), ["a", "b"])


def _texts(wanted, frequent):
    """Texts, sizes, sketches and leading tokens of wanted classes, once per
    block and class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often = wanted.value, frequent.value
        for batch in batches:
            for b in blocks(batch, "text", 4_000_000):
                sets = _sets(b.column("text"))
                first: dict[int, int] = {}
                for i, s in enumerate(sets):
                    if len(s):
                        c = _digest(s)
                        at = c & (WANTED_BITS - 1)
                        if bits[at >> 6] >> np.uint64(at & 63) & np.uint64(1):
                            first.setdefault(c, i)
                if first:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(first), pa.int64()), pa.array([len(sets[i]) for i in first.values()], pa.int64()),
                         pa.array([_sketch(sets[i]) for i in first.values()], pa.binary()),
                         pa.array([_lead(sets[i], often) for i in first.values()], pa.binary()),
                         b.column("text").cast(pa.string()).take(pa.array(list(first.values())))],
                        ["cls", "n", "sketch", "lead", "text"])
    return run


def _verified(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        num, den = THRESHOLD
        held: dict[int, tuple] = {}
        for batch in batches:
            for b in blocks(batch, "text_b", 2_000_000):
                a_ids, b_ids = b.column("a").to_pylist(), b.column("b").to_pylist()
                held = {k: v for k, v in held.items() if k == a_ids[0]}        # rows come ordered by a
                for ids, name in ((a_ids, "text_a"), (b_ids, "text_b")):
                    at = {c: i for i, c in enumerate(ids) if c not in held}
                    if at:
                        col = b.column(name).take(pa.array(list(at.values())))
                        for c, s in zip(at, _sets(col)):
                            held[c] = (s, [prefix(s, k, often) for k in ORDERS[1:]])
                yes = []
                for x, y in zip(a_ids, b_ids):
                    (s, ps), (t, pt) = held[x], held[y]
                    if all(len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(ps, pt)):
                        same = len(np.intersect1d(s, t, assume_unique=True))
                        yes.append(den * same >= num * (len(s) + len(t) - same))
                    else:
                        yes.append(False)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(yes)), b.column("b").filter(pa.array(yes))],
                                                 ["a", "b"])
    return run


def _bit_filter(classes: DataFrame) -> np.ndarray:
    """A fixed-size bit map (WANTED_BITS / 8 bytes at most) of classes."""
    at = F.col("cls").bitwiseAND(F.lit(WANTED_BITS - 1))
    words = (classes.groupBy(F.shiftright(at, 6).alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas())
    out = np.zeros(WANTED_BITS >> 6, dtype=np.uint64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _labelled_classes(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, text): members (doc_id, cls, n_shingles) per row, and
    classes of equal sets (cls, least id, rows, label of the component)."""
    spark = base.sparkSession
    sc = spark.sparkContext
    scan = written(base.mapInArrow(_scan, "kind int, a bigint, b bigint, n bigint"), "jaccard-scan")
    total = scan.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT_LEAST, total // FREQUENT)          # so at most FREQUENT tokens pass
    often = (scan.where("kind = 1").groupBy("a").agg(F.sum("b").alias("times")).where(F.col("times") >= least)
             .select("a").toPandas()["a"].to_numpy(dtype=np.int64).view(np.uint64))
    frequent = sc.broadcast(np.sort(often))
    rows = base.mapInArrow(_prefix_rows(frequent), "key bigint, token bigint, cls bigint, n int, pos int, hot boolean")
    found = written(rows.repartition(F.col("key")).sortWithinPartitions("key", "cls").mapInArrow(_buckets, "pair boolean, token bigint, cls bigint, n int, pos int"),
                    "jaccard-buckets")
    shared = found.where(~F.col("pair")).drop("pair")
    first = found.where("pair").select(F.col("token").alias("a"), F.col("cls").alias("b")).distinct()
    wanted = sc.broadcast(_bit_filter(shared.select("cls").distinct()))
    texts = written(base.mapInArrow(_texts(wanted, frequent), "cls bigint, n bigint, sketch binary, lead binary, text string").dropDuplicates(["cls"]), "jaccard-texts")

    def with_both(pairs: DataFrame, columns: list[str]) -> DataFrame:
        for side in "ba":
            pairs = pairs.join(texts.select(F.col("cls").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in "ab"])

    def verify(pairs: DataFrame) -> DataFrame:
        close = written(with_both(pairs, ["n", "sketch"]).mapInArrow(_may_overlap, "a bigint, b bigint"), "jaccard-close")
        return with_both(close, ["text"]).mapInArrow(_verified(frequent), "a bigint, b bigint")

    links = written(verify(first), "jaccard-links")
    label = components(links)
    # second round: pairs of a bucket that are still apart
    named = shared.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = written(named, "jaccard-labelled")
    apart = written(named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                               F.count(F.lit(1)).alias("size"))
                    .where(F.col("lo") != F.col("hi")).select("token", "size"), "jaccard-apart")
    open_rows = named.join(apart.where(F.col("size") <= LARGE_BUCKET).select("token"), "token")
    blocks_of = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks_of).cast("int")
    large = (named.join(apart.where(F.col("size") > LARGE_BUCKET), "token").withColumn("own", own)
             .join(texts.select("cls", "sketch", "lead"), "cls")
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks_of - 1)))
             .select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cls", "n", "pos",
                     "label", "sketch", "lead"))
    from_large = large.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(_large_buckets, "a bigint, b bigint")
    x, y = (open_rows.select("token", *[F.col(c).alias(c + s) for c in ("cls", "n", "pos", "label")]) for s in "xy")
    num, den = THRESHOLD
    need = F.ceil(num * (F.col("nx") + F.col("ny")) / F.lit(num + den))
    fits = ((F.col("clsx") < F.col("clsy")) & (F.col("labelx") != F.col("labely"))
            & (den * F.least("nx", "ny") >= num * F.greatest("nx", "ny"))
            & (F.least("posx", "posy") + 1 + F.least(F.col("nx") - F.col("posx") - 1, F.col("ny") - F.col("posy") - 1) >= need))
    cross = (x.join(y, "token").where(fits).select(F.col("clsx").alias("a"), F.col("clsy").alias("b")).unionByName(from_large).distinct()
             .join(first, ["a", "b"], "left_anti"))
    more = written(verify(cross), "jaccard-links")
    label = components(links.unionByName(more)).select(F.col("node").alias("cls"), "label")

    members = scan.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("n").alias("n_shingles"))
    classes = (members.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
               .join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls")))
    classes = written(classes, "jaccard-classes")
    return members, classes


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``.

    Two texts link when the Jaccard similarity of their sets is at least
    THRESHOLD; the component is the smallest id reachable by links.  Null and
    empty texts have no shingles and link with nothing (component: own id).
    Rows of a null id take part; ids are compared as longs, nulls last.
    Repeated rows are copies.  Empty input: no rows.
    """
    members, classes = _labelled_classes(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    groups = classes.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("group_rows"))
    of_class = written(join_by_key(classes.select("cls", "label", "rows"), written(groups, "jaccard-groups"), "label", "group_rows")
                       .select("cls", "component_id", "rows"), "jaccard-of-class")
    with_words = join_by_key(members.where("n_shingles > 0"), of_class, "cls", "rows").select("doc_id", "n_shingles", "component_id")
    alone = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.unionByName(alone)


def _with_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with words and their class; of a block's rows of one id and class
    the first, since one at most is kept."""
    for batch in batches:
        for b in blocks(batch, "text", 4_000_000):
            cls = [_digest(s) if len(s) else None for s in _sets(b.column("text"))]
            once = {}
            for i, pair in enumerate(zip(b.column("doc_id").to_pylist(), cls)):
                if pair[1] is not None:
                    once.setdefault(pair, i)
            at = pa.array(list(once.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(cls, pa.int64()).take(at)],
                                             [*b.schema.names, "_cls"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) without near copies: of each
    component of ``jaccard_components`` one row, of the smallest id (null ids
    last, then by class).  Rows are told apart by id and text, so neither null
    nor repeated ids join what is different.  Rows without words stay; those
    repeated under one id stay once."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, classes = _labelled_classes(base)
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "cls")).alias("best")
    keep = written(classes.groupBy("label").agg(best).select(
        F.col("best.cls").alias("_cls"), F.coalesce("best.least", F.lit(0)).alias("_id"), F.col("best.none").alias("_none")), "jaccard-kept")
    number = F.col("doc_id").cast("long")
    pair = ["_cls", "_id", "_none"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    worded = (docs.mapInArrow(_with_class, f"{schema}, _cls bigint")
              .withColumn("_id", F.coalesce(number, F.lit(0))).withColumn("_none", number.isNull())
              .join(keep, pair, "left_semi").dropDuplicates(pair).select(docs.columns))
    bare = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return (worded.unionByName(bare.where(F.col("doc_id").isNull()))
            .unionByName(bare.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])))
