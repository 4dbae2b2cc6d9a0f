"""Regression guards on physical plan shape for the scale-critical paths."""

from pyspark.sql import functions as F

from quarry.operators.deals import parse_tranches
from quarry.operators.keyword import KeywordIndex, bm25_match, term_df, top_k
from quarry.operators.vector import knn


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_tranche_parse_has_no_exchange(spark, tmp_path):
    p = str(tmp_path / "m")
    spark.createDataFrame([("a", "Tenor\t5Y\t7Y\nISIN\tX1\tX2"), ("b", "Tenor\t3Y")],
                          "msg_id string, text string").write.parquet(p)
    plan = _plan(parse_tranches(spark.read.parquet(p)))
    assert "Exchange" not in plan


def _index(spark):
    docs = ["alpha beta gamma", "beta gamma delta", "alpha alpha beta", "gamma delta"] * 5
    return KeywordIndex.from_chunks(spark.createDataFrame(
        [("s", str(i), 0, t) for i, t in enumerate(docs)], "source string, doc_id string, chunk_no int, content string"))


def test_postings_are_made_without_a_shuffle(spark):
    assert "Exchange" not in _plan(_index(spark).postings())
    plan = _plan(term_df(_index(spark))).split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_query_sets_take_the_shuffle_and_agree(spark):
    q = spark.createDataFrame([(0, "alpha beta"), (1, "gamma"), (2, "delta gamma")], "query_id long, query string")
    rows = lambda: sorted(map(tuple, top_k(bm25_match(_index(spark), q, "any"), 3).collect()))
    small = rows()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows() == small
        plan = _plan(top_k(bm25_match(_index(spark), q, "all"), 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_knn_keeps_ties_and_duplicates_bounded(spark):
    vecs = [(i, [0.0, 0.0]) for i in range(5000)] + [(i, [float(i), 1.0]) for i in range(5000, 5010)]
    df = spark.createDataFrame(vecs, "id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(300)] + [(300, [5009.0, 1.0])], "query_id long, vector array<double>")
    out = knn(df, q, 4, ["id"])
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert all(got[i] == [0, 1, 2, 3] for i in range(300)) and got[300] == [5009, 5008, 5007, 5006]
    assert knn(df.limit(0), q, 4, ["id"]).count() == 0 == knn(df, q.limit(0), 4, ["id"]).count()


def test_knn_leaves_out_blocks_beyond_the_bounds(spark, monkeypatch):
    """Rows in far clusters: most pairs of blocks are never compared, and the
    result is the plain one."""
    import numpy as np

    from quarry.operators import vector
    for name, value in (("ROWS", 20), ("FIRST_TILES", 2), ("ALL_TILES", 1), ("QUERY_PIECE", 8)):
        monkeypatch.setattr(vector, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 50, (10, 6))
    x = np.concatenate([c + rng.normal(size=(60, 6)) for c in centres] + [np.repeat(centres[:1], 90, axis=0)]).round(3)
    q = np.concatenate([c + rng.normal(size=(12, 6)) for c in centres]).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(5)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(999, None)], "query_id long, vector array<double>").repartition(3)
    for k in (3, 70, 200):
        seen = {}
        got = {}
        for r in vector.knn(df, qs, k, ["id"], trace=seen).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
        d = ((q[:, None] - x[None]) ** 2).sum(2)
        for i in range(len(q)):
            want = sorted(range(len(x)), key=lambda j: (float(f"{d[i, j]:.11e}"), j))[:k]
            assert [j for _, j in sorted(got[i])] == want, (k, i)
        assert set(got) == set(range(len(q)))
        pairs, compared = seen["all"].count(), seen["compared"].count()
        assert compared == seen["compared"].select("block_no", "tile").distinct().count()
        if k == 3:
            assert compared < pairs / 3, (compared, pairs)


def test_knn_with_fewer_rows_than_asked_for(spark, monkeypatch):
    from quarry.operators import vector
    monkeypatch.setattr(vector, "ROWS", 2)
    monkeypatch.setattr(vector, "FIRST_TILES", 1)
    monkeypatch.setattr(vector, "ALL_TILES", 1)
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(7)] + [(7, None)], "id long, embedding array<double>").repartition(2)
    q = spark.createDataFrame([(i, [float(i) / 2, 1.0]) for i in range(5)], "query_id long, vector array<double>")
    out = vector.knn(df, q, 50, ["id"]).collect()
    assert len(out) == 35 and {r["rank"] for r in out} == set(range(1, 8))
