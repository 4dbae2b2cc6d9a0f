"""The manifest against a plain tree, and on odd rows."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from quarry.llm.merkle import merkle_manifest, tamper_check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, low=False):
    text = row[1].translate(LOWER) if low and row[1] is not None else row[1]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    paths = [[] for _ in nodes]
    width = 1
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            p = i // width
            run = nodes[p // 8 * 8: p // 8 * 8 + 8]
            path.append(("".join(run[: p % 8]), "".join(run[p % 8 + 1:])))
        nodes = [sha("".join(nodes[i: i + 8])) for i in range(0, len(nodes), 8)]
        width *= 8
    return nodes[0], paths


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
    subs = [tree([leaf(r) for r in by[x]]) for x in langs]
    root, tops = tree([s for s, _ in subs])
    out = []
    for lang, (sub, paths), top in zip(langs, subs, tops):
        for r, path in zip(by[lang], paths):
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for a, b in path + top:
                node = sha(a + node + b)
            out.append((r[0], leaf(r), sub, root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [(1, "A lone Row", "en", "s", 3)],
    [(1, None, None, None, None)] * 3,
    [(i, f"Text {i}", "en", "s", i) for i in range(8)] + [(9, "Z", "", "s", 1)],
    [(i, f"Text {i}", "en", "s", i) for i in range(600)] + [(i, "é" * 40, "fr", None, 2) for i in range(65)] + [(7, "B", None, "s", 0)],
    [(5, "Same", "en", "s", 1)] * 40 + [(None, "No id", "en", "s", 1)] * 20 + [(6, "", "de", "", 0), (7, "X" * 200_000, "de", "s", 0)],
    [(i, f"T{i}", f"l{i % 77}", "s", i) for i in range(200)],
])
def test_agrees_with_a_plain_tree(spark, rows):
    got = tamper_check(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle_manifest(empty).root is None and tamper_check(empty).count() == 0
    rows = [(i, f"T{i}", "en", "s", i) for i in range(20)]
    clash = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA + ", tree long, pos long, node long, at long, _tie long")
    assert sorted(map(tuple, tamper_check(clash).collect()), key=str) == expected(rows)
