"""Properties of the column functions on generated inputs (one DataFrame per
property), and hand-made cases."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.deal import clean_cell, split_cells
from quarry.functions.text import split_words
from quarry.operators.chunking import chunk_words


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=900), min_size=20, max_size=20),
       st.sampled_from([(300, 50), (10, 3), (5, 0), (7, 6)]))
def test_chunks_cover_and_overlap(spark, sizes, params):
    most, overlap = params
    df = spark.createDataFrame([(n, " ".join(f"w{j}" for j in range(n))) for n in sizes], "n int, t string")
    for n, chunks in df.select("n", chunk_words(split_words("t"), most, overlap)).collect():
        cut = [c.split(" ") for c in chunks]
        assert len(cut) == math.ceil(n / (most - overlap))
        assert all(1 <= len(c) <= most for c in cut)
        # a chunk starts with the words its predecessor ended with
        for left, right in zip(cut, cut[1:]):
            assert len(left) == most or left[-1] == f"w{n - 1}"
            if len(left) == most and overlap:
                assert right[: len(left[-overlap:])] == left[-overlap:][: len(right)]
        # with the overlap taken out, the words come back in order
        assert [w for i, c in enumerate(cut) for w in c[: most - overlap if i + 1 < len(cut) else None]] == [f"w{j}" for j in range(n)]


CELL_CHARS = ["a", "B", " ", "\t", "*", "(", ")", "x", "\u00a0"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(CELL_CHARS), max_size=14), min_size=60, max_size=60))
def test_cells_lose_nothing_and_come_out_clean(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    for line, cells, clean in df.select("l", split_cells(F.col("l")), F.transform(split_cells(F.col("l")), clean_cell)).collect():
        assert not any("\t" in c for c in cells)
        solid = lambda s: [c for c in s if not c.isspace()]
        assert solid("".join(cells)) == solid(line)
        assert len(clean) == len(cells)
        for c in clean:
            assert c is None or (c and not c[0].isspace() and not c[-1].isspace())


def test_cells_by_hand(spark):
    cases = {"One\tTwo": ["One", "Two"], " One  Two words \t\tThree ": ["One", "Two words", "Three"],
             "**XY**\tAB (note)\t(only)": ["XY", "AB", None], "p (q) r (s)": ["p"], "": [None]}
    df = spark.createDataFrame([(x,) for x in cases], "l string")
    for line, got in df.select("l", F.transform(split_cells(F.col("l")), clean_cell)).collect():
        assert got == cases[line], line
