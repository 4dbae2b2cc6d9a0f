"""Ranked OR, prefixes, phrases and NEAR over lazy and stored indexes,
against SQLite FTS5 and plain scoring; what each of them reads; versions."""

import random
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F

from quarry.operators import hybrid, keyword, ranked, store, versions, vocabulary
from quarry.operators.keyword import KeywordIndex, bm25_match, match_first, match_near, top_k
from quarry.operators.phrases import match_phrase
from quarry.operators.ranked import bm25_top
from quarry.operators.vocabulary import match_prefix, prefix_terms

STOP = ["the", "of", "and", "to"]


def corpus(n=400, seed=3):
    rnd = random.Random(seed)
    rare = [f"{rnd.choice('abcde')}word{i}" for i in range(150)]
    return [" ".join(rnd.choice(STOP) if rnd.random() < 0.6 else rnd.choice(rare) for _ in range(rnd.randint(1, 30)))
            for _ in range(n)]


DOCS = corpus()


@pytest.fixture(scope="module", params=["lazy", "stored"])
def index(request, spark, tmp_path_factory):
    if request.param == "lazy":
        return KeywordIndex.from_chunks(spark.createDataFrame(
            [("s", str(i), 0, t) for i, t in enumerate(DOCS)], "source string, doc_id string, chunk_no int, content string"))
    patch = pytest.MonkeyPatch()
    patch.setattr(keyword, "SLICE_CHUNKS", 50)
    patch.setattr(store, "BUCKET_ROWS", 1000)
    patch.setattr(store, "IMPACT_DF", 8)
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame([("s", str(i), t) for i, t in enumerate(DOCS)], "source string, doc_id string, text string")
    hybrid.build_index(docs, path, html=False)
    patch.undo()
    idx = hybrid.read_index(spark, path).keyword
    assert idx.store.slices == 8 and idx.store.entry["buckets"] > 3
    return idx


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(content, tokenize='unicode61')")
    con.executemany("INSERT INTO d(rowid, content) VALUES (?, ?)", list(enumerate(DOCS)))
    return lambda q: {r[0] for r in con.execute("SELECT rowid FROM d WHERE d MATCH ?", (q,))}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], set()).add(int(r["doc_id"]))
    return out


def texts(n, seed, words=(1, 8)):
    rnd = random.Random(seed)
    every = sorted({w for d in DOCS for w in d.split()})
    return [" ".join(rnd.choice(STOP) if rnd.random() < 0.4 else rnd.choice(every) for _ in range(rnd.randint(*words))) for _ in range(n)]


@pytest.mark.parametrize("seed_rows, k, k1", [(1000, 5, 1.2), (1, 3, 0.9)])
def test_best_of_any_term_is_what_full_scoring_gives(spark, index, monkeypatch, seed_rows, k, k1):
    monkeypatch.setattr(ranked, "SEED_ROWS", seed_rows)
    monkeypatch.setattr(ranked, "slice_count", lambda n: 9)
    q = queries(spark, [*texts(25, k), "the", "the of", "nothing", "", "the the and", "awordx to"])
    got = bm25_top(index, q, k, k1=k1).collect()
    want = top_k(bm25_match(index, q, "any", k1=k1), k).collect()
    key = lambda r: (r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9))
    assert sorted(map(key, got)) == sorted(map(key, want))
    ex = spark.createDataFrame([(i, t) for i in range(31) for t in ("of", "nothing")][:50], "query_id long, query string")
    got = bm25_top(index, q, k, exclude=ex, k1=k1).collect()
    want = top_k(bm25_match(index, q, "any", exclude=ex, k1=k1), k).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_few_rows_enter_the_sums(spark, index):
    """Stop words are in most chunks; a query's rows come from its rare terms."""
    q = queries(spark, [f"the of and to {t}" for t in texts(30, 8, (3, 3))])
    df = lambda w: sum(w in d.split() for d in DOCS)
    words = [set(r["query"].split()) for r in q.collect()]
    most = sum(sum(map(df, w - set(STOP) or w)) for w in words)         # stop words count where a query has no other
    seen = {}
    bm25_top(index, q, 3, trace=seen).collect()
    entered = seen["needed"].count()
    assert seen["candidates"].count() <= entered
    plain = bm25_match(index, q, "any").count()
    assert entered <= most and entered < plain / 3, (entered, most, plain)


def test_prefixes(spark, index):
    match = fts()
    asked = [["aword"], ["bword1", "the"], ["a", "t"], ["zz"], ["a", "zz"], ["o", "b", "c"], ["dword14", "e"], [""]]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, prefixes array<string>")
    got = found(match_prefix(index, q))
    for i, ps in enumerate(asked):
        assert got.get(i, set()) == (match(" ".join(f"{p}*" for p in ps)) if ps != [""] else set()), ps
    pairs = {(r["pfx"], r["term"]) for r in prefix_terms(index, spark.createDataFrame([("aw",), ("t",)], "pfx string")).collect()}
    words = {w for d in DOCS for w in d.split()}
    assert pairs == {(p, w) for p in ("aw", "t") for w in words if w.startswith(p)}


def test_a_prefix_reads_its_ranges_only(spark, tmp_path):
    words = [f"w{i:05d}" for i in range(3000)] + [f"x{i:05d}" for i in range(6000)]
    rows = spark.createDataFrame([(w, 1) for w in words], "term string, df bigint")
    spark.conf.set("spark.sql.adaptive.enabled", "false")        # eight ranges
    try:
        v = vocabulary.write_vocabulary(rows, str(tmp_path / "v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(v.firsts) == 8 and v.firsts == sorted(v.firsts)
    lo, hi = v.split_of("w"), v.split_of("w" + vocabulary.LAST)
    assert 1 <= hi - lo <= 4                                     # a third of the terms: several ranges, not all
    got = v.in_splits(list(range(lo, hi + 1))).where(F.col("term").startswith("w")).count()
    assert got == 3000
    terms = spark.createDataFrame([("x00000",), ("a",), ("zz",), ("w01500",)], "term string")
    want = {t: v.split_of(t) for t in ("x00000", "a", "zz", "w01500")}
    assert dict(terms.select("term", v.split_column(F.col("term"))).collect()) == want


def test_prefix_plan_explodes_no_postings(spark, index):
    q = spark.createDataFrame([(0, ["a"])], "query_id long, prefixes array<string>")
    terms = prefix_terms(index, q.select(F.explode("prefixes").alias("pfx")))
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert "positions" not in plan and "chunk_no" not in plan and "split" in plan


def test_phrases(spark, index):
    match = fts()
    rnd = random.Random(1)
    asked = [" ".join(d.split()[s: s + n]) for d in rnd.sample([d for d in DOCS if len(d.split()) > 8], 20)
             for s, n in [(rnd.randrange(3), rnd.randint(1, 6))]]
    asked += ["the of", "of the", "the the", "the the the", "and to the of", "the", "to aword1", "nothing", "the nothing", "and and and and"]
    got = found(match_phrase(index, queries(spark, asked)))
    for i, t in enumerate(asked):
        assert got.get(i, set()) == match(f'"{t}"'), t
    assert match_phrase(index, queries(spark, ["", "  "])).count() == 0


def test_a_phrase_of_frequent_words_reads_pairs_only(spark, index):
    seen = {}
    match_phrase(index, queries(spark, ["the of", "and to the"]), trace=seen).collect()
    assert {r["term"] for r in seen["units"].collect()} == {"the of", "and to", "to the"}
    assert all(" " in r["term"] for r in seen["lists"].select("term").distinct().collect())


def test_near_with_a_distance_per_query_and_first_tokens(spark, index):
    match = fts()
    rnd = random.Random(7)
    asked = [(rnd.sample(STOP, 2) + [rnd.choice(rnd.choice(DOCS).split())], rnd.randint(0, 12)) for _ in range(20)]
    asked = [(sorted(set(w)), n) for w, n in asked]
    df = spark.createDataFrame([(i, " ".join(w), n) for i, (w, n) in enumerate(asked)], "query_id long, query string, gap int")
    got = found(match_near(index, df, "gap"))
    for i, (w, n) in enumerate(asked):
        assert got.get(i, set()) == match(f"NEAR({' '.join(w)}, {n})"), (w, n)
    firsts = ["the", "of and", "to nothing", "nothing", DOCS[5].split()[0]]
    got = found(match_first(index, queries(spark, firsts)))
    for i, t in enumerate(firsts):
        head, *rest = t.split()
        assert got.get(i, set()) == {j for j, d in enumerate(DOCS) if d.split()[0] == head and set(rest) <= set(d.split())}


def test_a_search_tokenizes_the_corpus_once(spark):
    """After the first use, everything is read from the written chunks."""
    idx = KeywordIndex.from_chunks(spark.createDataFrame(
        [("s", str(i), 0, t) for i, t in enumerate(DOCS[:20])], "source string, doc_id string, chunk_no int, content string"))
    hits = bm25_match(idx, queries(spark, ["the"]), "all")
    plan = idx.postings(False)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "tokens" in plan
    assert "split(" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert idx.kept().tokenized is idx.tokenized


# ---------------------------------------------------------------- versions

def docs_of(spark, *t):
    return spark.createDataFrame([("s", str(i), x) for i, x in enumerate(t)], "source string, doc_id string, text string")


def contents(spark, path):
    return sorted(r["content"] for r in hybrid.read_index(spark, path).chunks.collect())


def test_the_later_commit_is_the_newest_whatever_the_clocks_say(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "idx")
    with pytest.raises(FileNotFoundError):
        hybrid.read_index(spark, path)
    assert hybrid.build_index(docs_of(spark, "first"), path, html=False) == 1
    monkeypatch.setattr("time.time", lambda: 1.0)
    monkeypatch.setattr("time.time_ns", lambda: 1)
    assert hybrid.build_index(docs_of(spark, "second"), path, html=False) == 2
    monkeypatch.undo()
    assert contents(spark, path) == ["second"]


def test_concurrent_commits_all_get_a_number(spark, tmp_path):
    path, got = str(tmp_path / "idx"), []

    def work(i):
        got.append((versions.commit(spark, path, {"folder": f"v-{i}"}), i))
    threads = [threading.Thread(target=work, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in got) == list(range(1, 13)) == versions.generations(spark, path)
    for n, i in got:
        assert versions.record(spark, path, n) == {"folder": f"v-{i}"}
    assert versions.newest(spark, path) == {"folder": f"v-{dict(got)[12]}"}


def test_a_taken_number_is_not_overwritten(spark, tmp_path, monkeypatch):
    """A builder that read the list before another one committed."""
    path = str(tmp_path / "idx")
    versions.commit(spark, path, {"folder": "a"})
    real, stale = versions.generations, [[], []]
    monkeypatch.setattr(versions, "generations", lambda *a: stale.pop() if stale else real(*a))
    assert versions.commit(spark, path, {"folder": "b"}) == 2
    monkeypatch.undo()
    assert [versions.record(spark, path, n)["folder"] for n in (1, 2)] == ["a", "b"]


def test_old_versions_expire(spark, tmp_path):
    path = str(tmp_path / "idx")
    for t in ("one", "two", "three"):
        hybrid.build_index(docs_of(spark, t), path, html=False)
    (tmp_path / "idx" / "v-running").mkdir()
    assert versions.expire(spark, path, keep=2) == [1] and versions.generations(spark, path) == [2, 3]
    assert versions.expire(spark, path, keep=0) == [2]
    assert contents(spark, path) == ["three"] and (tmp_path / "idx" / "v-running").exists()
    assert len([p for p in (tmp_path / "idx").iterdir() if p.name.startswith("v-")]) == 2


def test_empty_corpus(spark, tmp_path):
    path = str(tmp_path / "idx")
    hybrid.build_index(docs_of(spark, "x").limit(0), path, html=False)
    idx = hybrid.read_index(spark, path).keyword
    q = queries(spark, ["the of"])
    assert bm25_top(idx, q, 3).count() == match_phrase(idx, q).count() == bm25_match(idx, q).count() == 0
    p = spark.createDataFrame([(0, ["a"])], "query_id long, prefixes array<string>")
    assert match_prefix(idx, p).count() == 0
