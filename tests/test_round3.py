"""Work per row and per task that must not grow: tagging, layouts, batches."""

import random

from pyspark.sql import functions as F

from quarry.operators.tagging import LABELS, Tagger, explode_labelled, explode_text, predict_path, train_tagger


def _sentences(spark, n=60):
    r = random.Random(3)
    words = {"O": ["notes", "paying", "near"], "B-TENOR": ["5y", "10y"], "B-CURRENCY": ["SEK", "CHF"], "B-IPT": ["T+110"]}
    data = []
    for i in range(n):
        labels = [r.choice(LABELS) for _ in range(r.randint(0, 9))]
        data.append((i, [r.choice(words[x]) for x in labels], labels))
    return spark.createDataFrame(data, "sentence_id bigint, tokens array<string>, labels array<string>")


def test_paths_of_adjacent_rows_need_no_shuffle(spark):
    s = _sentences(spark)
    tagger = train_tagger(s, max_iter=5)
    tokens = explode_text(s.select("sentence_id", F.array_join("tokens", " ").alias("text")))
    near = predict_path(tagger, tokens, adjacent=True)
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    apart = predict_path(tagger, tokens)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, apart.collect()))
    nested = predict_path(tagger, tokens, adjacent=True, nested=True).select("sentence_id", F.inline("labelled"))
    assert sorted(map(tuple, nested.collect())) == sorted(map(tuple, apart.collect()))


def test_sentences_longer_than_a_batch(spark):
    s = _sentences(spark)
    tagger = train_tagger(s, max_iter=5)
    tokens = explode_text(s.select("sentence_id", F.array_join("tokens", " ").alias("text")).coalesce(1))
    want = sorted(map(tuple, predict_path(tagger, tokens).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, predict_path(tagger, tokens, adjacent=True).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_equal_examples_are_one_weighted_row(spark):
    s = _sentences(spark)
    many = s.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("sentence_id", F.col("sentence_id") * 10 + F.col("i"))
    fitted = train_tagger(many, max_iter=5).model
    weights = [st for st in fitted.stages if hasattr(st, "coefficientMatrix")][0]
    assert weights.getWeightCol() == "n" and isinstance(train_tagger(s, max_iter=2), Tagger)


def test_tokens_and_labels_of_unequal_number(spark):
    s = spark.createDataFrame([(1, ["a"], ["O", "O"]), (2, ["b", "c"], ["O"]), (3, [], []), (4, None, ["O"])],
                              "sentence_id int, tokens array<string>, labels array<string>")
    rows = {(r.sentence_id, r.pos, r.token, r.f_prev, r.label) for r in explode_labelled(s).collect()}
    assert rows == {(1, 0, "a", "<s>", "O"), (1, None, None, None, "O"), (2, 0, "b", "<s>", "O"), (2, 1, "c", "b", None)}


def test_postings_are_made_a_few_chunks_at_a_time():
    import pyarrow as pa

    from quarry.operators.keyword import PIECE_ROWS, in_pieces, term_runs
    tokens = pa.array([[f"w{i % 7}", "the", f"w{i % 7}"] for i in range(PIECE_ROWS * 3 + 5)])
    whole = pa.RecordBatch.from_arrays([tokens, pa.array(range(len(tokens)))], ["tokens", "id"])
    pieces = list(in_pieces(iter([whole])))
    assert [p.num_rows for p in pieces] == [PIECE_ROWS] * 3 + [5]

    def rows(b):
        row, terms, offsets, places = term_runs(b.column("tokens"))
        ids = b.column("id").take(pa.array(row)).to_pylist()
        return {(i, t, tuple(places[a:e])) for i, t, a, e in zip(ids, terms.to_pylist(), offsets[:-1], offsets[1:])}
    assert set().union(*map(rows, pieces)) == rows(whole)


def test_excluded_chunks_meet_no_query(spark):
    from quarry.operators.keyword import KeywordIndex, bm25_match, top_k
    from quarry.operators.ranked import bm25_top
    texts = ["alpha the beta", "alpha gamma", "beta the", "alpha beta delta", "gamma delta", "the gamma alpha"]
    chunks = spark.createDataFrame([("d", str(i), 0, t) for i, t in enumerate(texts)], "source string, doc_id string, chunk_no int, content string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma alpha"), (3, "beta")], "query_id bigint, query string")
    excluded = spark.createDataFrame([(1, "the"), (2, "delta the")], "query_id bigint, query string")
    seen = {}
    got = bm25_top(KeywordIndex.from_chunks(chunks), queries, 2, exclude=excluded, trace=seen)
    want = top_k(bm25_match(KeywordIndex.from_chunks(chunks), queries, "any", exclude=excluded), 2)
    cols = ["query_id", "rank", "doc_id", F.round("score", 9)]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    met = {(r.query_id, r.doc_id) for r in seen["needed"].collect()}
    assert not met & {(q, d) for q in (1, 2) for d in "025"} and (2, "3") not in met


def test_nearest_rows_are_kept_over_many_tiles(spark):
    import numpy as np
    from pyspark.sql import types as T

    from quarry.operators import vector
    r = np.random.default_rng(5)
    x = r.integers(0, 4, size=(400, 3)).astype(float)                      # many equal distances
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vector array<double>").repartition(40)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "query_id int, vector array<double>").coalesce(1)
    tiles, blocks = (vector.sized(vector._packed(f, np.zeros((0, 0))), "test") for f in (index, queries))
    pairs = blocks.select(F.col("number").alias("block_no")).crossJoin(tiles.select(F.col("number").alias("tile")))
    schema = T.StructType([T.StructField("query_id", T.IntegerType()), T.StructField("id", T.IntegerType()), T.StructField("dist", T.DoubleType())])
    k, n_tiles = 5, tiles.count()
    before, vector.RUN_TILES = vector.RUN_TILES, n_tiles
    try:
        rows = vector._scored(tiles, blocks, pairs, ["id"], k, schema).collect()
    finally:
        vector.RUN_TILES = before
    parts = min(n_tiles, 2 * spark.sparkContext.defaultParallelism)
    assert n_tiles > parts and len(rows) <= 7 * k * parts                    # not k rows a tile
    for q in range(7):
        d = ((x - x[q]) ** 2).sum(1)
        want = sorted(zip(d, range(400)))[:k]
        assert sorted((e.dist, e.id) for e in rows if e.query_id == q)[:k] == want


def test_lines_and_words_are_split_without_compiling_a_pattern_a_row(spark):
    from quarry.functions.text import split_lines, split_words
    texts = ["", " a  b c\x1f", "a\r\n\r\nb\rc\x0bd e\n", "one\x85two", "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = df.select("id", split_words("t").alias("w"), split_lines("t").alias("l"))
    for r in got.collect():
        assert r.w == texts[r.id].split()
        assert [x for x in r.l if x] == [x for x in texts[r.id].splitlines() if x]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan


def test_searches_move_only_the_chunks_of_the_rarest_term(spark):
    from quarry.operators import keyword
    from quarry.operators.phrases import match_phrase
    from quarry.operators.vocabulary import match_prefix
    texts = ["the alpine beta", "the beta alps", "the gamma", "the beta gamma", "the alpine", "beta the alp"] + ["the of beta"] * 50
    chunks = spark.createDataFrame([("d", str(i), 0, t) for i, t in enumerate(texts)], "source string, doc_id string, chunk_no int, content string")
    made = []
    whole, keyword.postings_of = keyword.postings_of, lambda t, positions=True: made.append(t.count()) or whole(t, positions)
    try:
        index = lambda: keyword.KeywordIndex.from_chunks(chunks)
        q = spark.createDataFrame([(1, "the alpine"), (2, "beta gamma"), (3, "the nothing")], "query_id bigint, query string")
        found = lambda rows: sorted((r.query_id, int(r.doc_id)) for r in rows.collect())
        assert found(keyword.bm25_match(index(), q)) == found(keyword.match_terms(index(), q)) == [(1, 0), (1, 4), (2, 3)]
        assert found(match_phrase(index(), q)) == [(1, 0), (1, 4), (2, 3)]
        p = spark.createDataFrame([(1, ["alp", "th"]), (2, ["be", "gam", "the"]), (3, ["alp", "nothing"]), (4, ["alpi", "t"])], "query_id bigint, prefixes array<string>")
        assert found(match_prefix(index(), p)) == [(1, 0), (1, 1), (1, 4), (1, 5), (2, 3), (4, 0), (4, 4)]
    finally:
        keyword.postings_of = whole
    assert made and max(made) <= 5


def test_prefixes_of_rows_that_share_a_key(spark):
    from quarry.operators.keyword import KeywordIndex
    from quarry.operators.vocabulary import match_prefix
    rows = [("d", "1", 0, "alpha one"), ("d", "1", 0, "beta two"), ("d", "2", 0, "alpha"), (None, "3", 0, "alpha beta"), ("d", "4", 0, None)]
    chunks = spark.createDataFrame(rows, "source string, doc_id string, chunk_no int, content string")
    p = spark.createDataFrame([(1, ["al", "bet"]), (2, ["alpha"]), (3, [""]), (4, [])], "query_id bigint, prefixes array<string>")
    got = sorted((r.query_id, r.doc_id) for r in match_prefix(KeywordIndex.from_chunks(chunks), p).collect())
    assert got == [(1, "1"), (2, "1"), (2, "2")]


def test_best_rows_are_found_inside_slices(spark, monkeypatch):
    """Copies, equal scores and excluded terms: the rows of full scoring, from the
    query terms' postings alone."""
    from quarry.operators import keyword, ranked
    from quarry.operators.keyword import KeywordIndex, bm25_match, top_k
    r = random.Random(11)
    words = lambda: " ".join(r.choices(["the", "of", "rare", "copy", "x", "y"], [9, 6, 1, 2, 3, 3], k=r.randint(0, 5)))
    rows = [(r.choice("st"), str(i // 3), i % 3, words()) for i in range(300)] + [("u", str(i), 0, "the copy of x") for i in range(70)]
    chunks = spark.createDataFrame(rows, "source string, doc_id string, chunk_no int, content string").repartition(5)
    queries = spark.createDataFrame([(1, "the copy"), (2, "rare of"), (3, "the of x y"), (4, "nothing"), (5, "copy nothing the")], "query_id bigint, query string")
    excluded = spark.createDataFrame([(1, "of"), (3, "rare nothing")], "query_id bigint, query string")
    written = []
    for module in (keyword, ranked):
        monkeypatch.setattr(module, "sized", lambda df, name, whole=module.sized: written.append(name) or whole(df, name))
    monkeypatch.setattr(ranked, "slice_count", lambda n: 7)
    got = {}
    for k, no in ((1, None), (4, excluded), (30, None)):
        found = ranked.bm25_top(KeywordIndex.from_chunks(chunks), queries, k, exclude=no)
        assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()          # nothing is tokenized again
        got[k] = found.collect()
    assert not {"tokenized", "found", "candidates"} & set(written) and written.count("query-postings") == 3
    for k, no in ((1, None), (4, excluded), (30, None)):
        want = top_k(bm25_match(KeywordIndex.from_chunks(chunks), queries, "any", exclude=no), k).collect()
        plain = lambda rows: sorted(((x.query_id, x.rank, str(x.source), str(x.doc_id), x.chunk_no, round(x.score, 9)) for x in rows))
        assert plain(got[k]) == plain(want)


def test_each_distinct_token_is_hashed_once(monkeypatch):
    import hashlib

    import numpy as np
    import pyarrow as pa

    from quarry.functions import embed
    asked = []
    whole = embed._token_buckets
    monkeypatch.setattr(embed, "_token_buckets", lambda t, dim: asked.extend(t) or whole(t, dim))
    rows = [["the", "é", "the"], None, [], ["the"] * 50 + ["of"]] * 20
    got = embed._count_vector_fn(pa.array(rows, pa.list_(pa.string())), pa.array([16] * len(rows))).to_pylist()
    assert sorted(asked) == sorted({t.encode() for r in rows for t in r or []})
    for r, v in zip(rows, got):
        want = np.zeros(16)
        for t in r or []:
            want[int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % 16] += 1
        assert v == (want / (np.sqrt((want * want).sum()) or 1)).astype(np.float32).tolist()
    assert embed._count_vector_fn(pa.array([], pa.list_(pa.string())), pa.array([], pa.int32())).to_pylist() == []
