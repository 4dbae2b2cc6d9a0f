import random
import tracemalloc

import pytest

from quarry.llm import decontam
from quarry.llm.decontam import EDIT_SHARE, Items, benchmark_matches, budget, find


def least_edits(item, text):
    """Least edits of item against any part of text (plain table)."""
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        cur = [i]
        for j, b in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (a != b), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(1, len(s) - 1)
        kind = rnd.randrange(3)
        if kind == 0:
            s[i] = "z"
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, "q")
    return "".join(s)


def test_agrees_with_the_plain_table():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(rnd.randint(10, 60)) for _ in range(8)] + ["kkkkk"]
    index = Items(list(range(9)), items)
    texts = [None, "", " "]
    for _ in range(60):
        parts = [prose(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            it = rnd.choice(items[:8])
            parts += [edited(rnd, it, rnd.randint(0, int(len(it) * EDIT_SHARE) + 4)), prose(rnd.randint(0, 30))]
        texts.append(" ".join(parts))
    got = {(d, i) for d, i, *_ in find(texts, index)}
    for d, t in enumerate(texts):
        for i, it in enumerate(items[:8]):
            assert ((d, i) in got) == (least_edits(it, (t or "").strip()) <= budget(len(it))), (d, i)


def test_spans_case_and_space():
    item = "The quick brown fox jumps over the lazy dog and runs far away from here"
    index = Items([7], [item])
    text = "ñ" * 50 + "\n" + item.upper().replace(" ", " \n ") + "!" + " tail" * 30 + " " + item
    got = find([text, "x" + item[:-1]], index)
    assert [g[0] for g in got] == [0, 0, 1]
    assert text[got[0][2]:got[0][3]].split() == item.upper().split() and got[0][4] == 0
    assert text[got[1][2]:got[1][3]] == item


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "abc " * 40, 5), (2, "abc " * 40, 5), (3, "x" * 20_000 + "needle", 5)],
                                 "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, None, 0), (None, "abc " * 20, 0), (3, " ", 0), (4, "needle", 0), (4, "needle", 0)],
                                  "item_id long, text string, doc_id long")
    got = benchmark_matches(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(2, None), (3, 4)}
    assert sum(r["doc_id"] == 3 for r in got) == 2
    assert benchmark_matches(docs.limit(0), items).count() == 0
    assert benchmark_matches(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("passage", ["Ο γρήγορος σκύλος τρέχει στους δρόμους της πόλης όταν νυχτώνει",
                                     "Съешь же ещё этих мягких французских булок да выпей чаю",
                                     "Բարեւ ձեզ սիրելի բարեկամներ այսօր մենք միասին կարդում ենք",
                                     "𐐔𐐯𐑅𐐨𐑉𐐯𐐻 𐐢𐐯𐐻𐐲𐑉𐑆 𐐰𐑉 𐐩 𐑅𐐿𐑉𐐮𐐹𐐻 𐐶𐐮𐑄 𐐻𐐭 𐐿𐐩𐑅𐐲𐑆"])
def test_case_and_space_of_other_scripts(passage):
    items = Items([1], [passage])
    for other in (passage.upper(), passage.replace(" ", "\u2003\u3000"), passage.upper().replace(" ", "\u2009")):
        text = "before it " + other + " after it"
        assert [(i, s, e, c) for _, i, s, e, c in find([text], items)] == [(0, 10, 10 + len(other), 0)]


@pytest.mark.parametrize("expanded", [7, 1000])
def test_slices_of_the_count_make_no_difference(monkeypatch, expanded):
    rnd = random.Random(3)
    items = [" ".join(rnd.choice(["ab", "cd", "abc", "e"]) for _ in range(40)) for _ in range(6)]
    texts = [" ".join(rnd.choice(["ab", "cd", "abc", "e"]) for _ in range(80)) + " " + rnd.choice(items) for _ in range(30)]
    index = Items(list(range(6)), items)
    want = find(texts, index)
    monkeypatch.setattr(decontam, "EXPANDED", expanded)
    assert find(texts, index) == want and want


def test_a_text_that_repeats_itself_takes_bounded_memory():
    index = Items([1], ["ab " * 200])
    tracemalloc.start()
    got = find(["ab " * 120_000], index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got and peak < 500e6, peak
