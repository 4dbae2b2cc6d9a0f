"""Text preparation and search: properties against Python built-ins, BM25 and
match forms against SQLite FTS5 (stdlib), kNN against numpy brute force."""

import random
import sqlite3

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.text import html_to_text, split_lines, split_words, unicode61_tokens
from quarry.operators.chunking import chunk_text, chunk_words
from quarry.operators.keyword import KeywordIndex, bm25_match, match_first, match_near, top_k
from quarry.operators.phrases import match_phrase
from quarry.operators.vector import knn
from quarry.operators.vocabulary import match_prefix

WS_CHARS = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(["a", "b", "é", "1", *WS_CHARS]), max_size=30),
                min_size=40, max_size=40))
def test_words_and_lines_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.w, r.l) for r in df.select("i", split_words("t").alias("w"),
                                             F.filter(split_lines("t"), lambda x: x != "").alias("l")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == t.split()
        assert got[i][1] == [x for x in t.splitlines() if x != ""]


def test_chunk_counts(spark):
    sizes = [0, 1, 250, 251, 260, 550]
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "n int, t string")
    got = dict(df.select("n", F.size(chunk_words(split_words("t"))).alias("c")).collect())
    assert [got[n] for n in sizes] == [0, 1, 1, 2, 2, 3]
    rows = chunk_text(df.where("n = 260").select(F.lit("s").alias("source"), F.lit("d").alias("doc_id"),
                                                  F.col("t").alias("text"))).orderBy("chunk_no").collect()
    assert [len(r.content.split()) for r in rows] == [260, 10]


def test_html_and_tokens(spark):
    df = spark.createDataFrame([("a<b>b</b>&amp;c<!--x-->d<script>var t='</p>';</script>",
                                 "Café_déjà vu's ß")], "h string, t string")
    r = df.select(split_words(html_to_text("h")).alias("w"), unicode61_tokens("t").alias("k")).first()
    assert r.w == ["a", "b", "&c", "d"]
    assert r.k == ["cafe", "deja", "vu", "s", "ß"]


VOCAB = ["alpha", "beta", "gamma", "delta", "kappa", "kappan", "lambda", "omega", "sigma", "tau"]


def _corpus(n=60, seed=7):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(VOCAB) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


def _fts(docs, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(content, tokenize='unicode61')")
    con.executemany("INSERT INTO d(rowid, content) VALUES (?, ?)", [(i, t) for i, t in enumerate(docs)])
    return {r[0]: -r[1] for r in con.execute("SELECT rowid, bm25(d) FROM d WHERE d MATCH ?", (query,))}


def _index(spark, docs):
    chunks = spark.createDataFrame([("s", str(i), 0, t) for i, t in enumerate(docs)],
                                   "source string, doc_id string, chunk_no int, content string")
    return KeywordIndex.from_chunks(chunks)


def test_bm25_and_match_forms_equal_fts5(spark):
    docs = _corpus()
    idx = _index(spark, docs)
    queries = ["alpha", "alpha beta", "kappa omega tau", "gamma gamma delta", "nothing"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    got = {}
    for r in bm25_match(idx, q, "all").collect():
        got.setdefault(r.query_id, {})[int(r.doc_id)] = r.score
    for i, text in enumerate(queries):
        want = _fts(docs, text)
        assert set(got.get(i, {})) == set(want), text
        for k, v in want.items():
            assert abs(got[i][k] - v) < 1e-9, (text, k)

    anyq = {(r.query_id, int(r.doc_id)): r.score for r in bm25_match(idx, q, "any").collect()}
    want = _fts(docs, "kappa OR omega OR tau")
    assert {d for (qi, d) in anyq if qi == 2} == set(want)
    assert all(abs(anyq[(2, d)] - s) < 1e-9 for d, s in want.items())

    ph = spark.createDataFrame([(0, "beta gamma"), (1, "alpha alpha")], "query_id long, query string")
    got_ph = {(r.query_id, int(r.doc_id)) for r in match_phrase(idx, ph).collect()}
    assert {d for (qi, d) in got_ph if qi == 0} == set(_fts(docs, '"beta gamma"'))
    assert {d for (qi, d) in got_ph if qi == 1} == set(_fts(docs, '"alpha alpha"'))

    nq = spark.createDataFrame([(0, "alpha omega")], "query_id long, query string")
    got_near = {int(r.doc_id) for r in match_near(idx, nq, 2).collect()}
    assert got_near == set(_fts(docs, "NEAR(alpha omega, 2)"))

    pq = spark.createDataFrame([(0, ["kapp", "om"])], "query_id long, prefixes array<string>")
    assert {int(r.doc_id) for r in match_prefix(idx, pq).collect()} == set(_fts(docs, "kapp* om*"))

    fq = spark.createDataFrame([(0, "sigma")], "query_id long, query string")
    assert {int(r.doc_id) for r in match_first(idx, fq).collect()} == set(_fts(docs, "^sigma"))


def test_top_k_order(spark):
    docs = _corpus()
    idx = _index(spark, docs)
    q = spark.createDataFrame([(0, "alpha")], "query_id long, query string")
    ranked = top_k(bm25_match(idx, q, "all"), 3).orderBy("rank").collect()
    want = sorted(_fts(docs, "alpha").items(), key=lambda kv: (-float(f"{kv[1]:.11e}"), str(kv[0])))[:3]
    assert [int(r.doc_id) for r in ranked] == [k for k, _ in want]


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    qv = rng.normal(size=(7, 8)).astype(np.float32)
    idx = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, qv[i].tolist()) for i in range(len(qv))], "query_id long, vector array<float>")
    got = {}
    for r in knn(idx.repartition(5), q, 4, ["vec_id"]).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for i in range(len(qv)):
        d = ((x.astype(np.float64) - qv[i].astype(np.float64)) ** 2).sum(axis=1)
        want = sorted(range(len(x)), key=lambda j: (round(d[j], 6), j))[:4]
        assert [v for _, v in sorted(got[i])] == want


def test_snippet_equals_fts5(spark):
    from quarry.functions.snippet import snippet
    rnd = random.Random(11)
    vocab = ["alpha", "beta", "gamma", "delta", "kappa", "omega"]
    seps = [" ", " ", " ", ". ", ": ", ", ", ".  ", "\n"]
    docs = []
    for _ in range(300):
        s = "".join(rnd.choice(vocab) + rnd.choice(seps) for _ in range(rnd.randint(1, 30)))
        if rnd.random() < 0.3:
            s = "  " + s
        docs.append(s.rstrip() if rnd.random() < 0.5 else s)
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(content, tokenize='unicode61')")
    con.executemany("INSERT INTO d(rowid, content) VALUES (?, ?)", list(enumerate(docs)))
    rows, want = [], {}
    for qi, q in enumerate(["alpha", "beta gamma", "kappa omega delta"]):
        for rid, sn in con.execute("SELECT rowid, snippet(d, -1, '[', ']', '...', 5) FROM d WHERE d MATCH ?", (q,)):
            rows.append((qi, rid, docs[rid], q.split()))
            want[(qi, rid)] = sn
    df = spark.createDataFrame(rows, "q int, rid int, content string, terms array<string>")
    got = {(r.q, r.rid): r.s for r in df.select("q", "rid", snippet(F.col("content"), F.col("terms")).alias("s"))
           .collect()}
    assert got == want


def test_full_entity_decoding(spark):
    df = spark.createDataFrame([("x&eacute;<i>&#233;</i>&amp;lt;",), ("plain",)], "h string")
    got = [r[0] for r in df.select(split_words(html_to_text("h"))).collect()]
    assert got == [["xé", "é", "&lt;"], ["plain"]]


def test_knn_many_query_blocks(spark, monkeypatch):
    import quarry.operators.vector as vec
    monkeypatch.setattr(vec, "ROWS", 3)             # three rows per block and tile
    monkeypatch.setattr(vec, "QUERY_PIECE", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    qv = rng.normal(size=(10, 8)).astype(np.float32)
    idx = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, qv[i].tolist()) for i in range(len(qv))], "query_id long, vector array<float>")
    got = {}
    for r in vec.knn(idx, q, 3, ["vec_id"]).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got) == list(range(10))
    for i in range(len(qv)):
        d = ((x.astype(np.float64) - qv[i].astype(np.float64)) ** 2).sum(axis=1)
        assert [v for _, v in sorted(got[i])] == sorted(range(len(x)), key=lambda j: (round(d[j], 6), j))[:3]


def test_hash_embedding_from_text_or_tokens(spark):
    from quarry.functions.embed import hash_embed, hash_embed_tokens
    df = spark.createDataFrame([("Alpha beta, béta alpha!",), ("",)], "t string")
    r = df.select(hash_embed("t", 16).alias("a"), hash_embed_tokens(unicode61_tokens("t"), 16).alias("b")).collect()
    assert [x.a for x in r] == [x.b for x in r]
    v = np.array(r[0].a, dtype=np.float64)
    assert abs(np.linalg.norm(v) - 1) < 1e-6 and r[1].a == [0.0] * 16


def test_html_keeps_text(spark):
    cases = {"caf&eacute; x": ["café", "x"], "<![CDATA[if a > b: run()]]>": ["if", "a", ">", "b:", "run()"],
             '<a title="x>y">z</a>': ["z"], "<?xml version='1.0'?>k": ["k"], "&amp;lt; &#233;&#xE9; &#150; &bogus; &copy 2": ["&lt;", "éé", "–", "&bogus;", "©", "2"],
             "&#0;&#xD800; &notin; a & b&": ["\ufffd\ufffd", "∉", "a", "&", "b&"], "5<6 <!-- a > b --> t": ["5<6", "t"], "": []}
    df = spark.createDataFrame([(x,) for x in cases], "h string")
    for h, words in df.select("h", split_words(html_to_text("h"))).collect():
        assert words == cases[h], h


def test_tokens_fold_like_unicode61(spark):
    df = spark.createDataFrame([("cafe\u0301s \u1ea1n \u01fa \u00df x\u0302y",)], "t string")
    assert df.select(unicode61_tokens("t")).first()[0] == ["cafes", "an", "a", "\u00df", "xy"]


def test_floored_idf_keeps_the_order(spark):
    """A term in more than half of the chunks: scores are tiny, and still
    rank as SQLite's FTS5 ranks them."""
    texts = ["alpha beta gamma delta alpha", "alpha x", "alpha alpha alpha", "alpha one two three four", "other"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    con.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", enumerate(texts))
    want = [str(r[0]) for r in con.execute("SELECT rowid FROM t WHERE t MATCH 'alpha' ORDER BY rank, rowid")]
    chunks = spark.createDataFrame([("s", str(i), 0, t) for i, t in enumerate(texts)],
                                   "source string, doc_id string, chunk_no int, content string")
    q = spark.createDataFrame([(0, "alpha")], "query_id long, query string")
    got = top_k(bm25_match(KeywordIndex.from_chunks(chunks), q, "all"), 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == want
