import random
import re

from quarry.llm.components import components
from quarry.llm.ngram_join import jaccard_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                comp[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return sorted(out, key=str)


def ours(spark, rows):
    docs = spark.createDataFrame([(a, b, "c", 1) for a, b in rows], "doc_id long, text string, cls string, n long")
    return sorted(((r[0], r[1], r[2]) for r in jaccard_components(docs).collect()), key=str)


def test_near_copies_match_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeXYZé") for _ in range(rnd.randint(1, 6)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(6, 120))]
        for _ in range(rnd.randint(1, 14)):
            t = list(base)
            for _ in range(rnd.randint(0, 1 + len(t) // 25)):
                t[rnd.randrange(len(t))] = word()
            if rnd.random() < 0.3:
                t += passage
            rows.append((len(rows) * 3 % 1009, " ".join(t)))
    rows += [(5000 + i, None if i == 0 else ["", " \n", "one two", "ONE two", "one  two", "a b c d e", "A b c d E"][i - 1])
             for i in range(8)]
    rows += [rows[0], rows[0], (None, rows[1][1])]
    assert ours(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rnd.randint(1, 4)):
            t[rnd.randrange(150)] = f"x{rnd.randrange(10 ** 6)}"
        rows.append((i, " ".join(t)))
    assert ours(spark, rows) == brute(rows)


def test_empty(spark):
    assert ours(spark, []) == []


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001)]
    random.Random(1).shuffle(edges)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_buckets_are_looked_at_in_runs():
    import numpy as np
    import pyarrow as pa

    from quarry.llm import ngram_join as nj
    r = np.random.default_rng(1)
    key = np.sort(np.concatenate([r.integers(0, 300, 4_000), np.full(3_000, 77), np.full(900, 299)]))
    table = pa.table({"key": key, "row": np.arange(len(key))})
    for size in (7, 100, 10_000):
        runs = list(nj._runs(iter(table.to_batches(max_chunksize=50)), ["key"], size))
        assert pa.concat_tables(runs).equals(table)
        firsts = [t.column("key")[0].as_py() for t in runs]
        assert len(set(firsts)) == len(firsts) and all(t.column("key")[-1].as_py() < f for t, f in zip(runs, firsts[1:]))
        if size == 100:
            # no run holds more than its own bucket, the rows asked for and a batch
            assert max(t.num_rows for t in runs if 77 not in t.column("key").to_pylist()) < 1_200


def test_words_are_keyed_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from quarry.llm import ngram_join as nj
    texts = pa.array([" ".join(f"w{random.randrange(5000)}" for _ in range(400)) for _ in range(2_000)])   # 4 MB
    want = nj.shingle_sets(nj.Words(texts, lower=True), nj.SHINGLE)
    tracemalloc.start()
    got = nj._sets(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(got, want)) and len(got) == len(want)
    assert peak < 60 << 20
