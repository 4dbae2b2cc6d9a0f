"""Streaming ingestion, scans of nested exports, JSON export, tagger
save/load and a caller-supplied embedding model."""

import json
import os
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.embed import model_embed
from quarry.operators.layouts import deal_documents, to_json_documents, write_json
from quarry.operators.tagging import LABELS, best_path, explode_text, label_transitions, load_tagger, pair_labels, predict, \
    predict_path, save_tagger, train_tagger
from quarry.sources.scans import combine_sources, issue_scan, labelled_rows, page_scan, to_text
from quarry.operators.keyword import term_df
from quarry.streaming.messages import tranche_stream

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def test_tranche_stream_is_incremental(spark, tmp_path):
    land, out, ck = tmp_path / "land", tmp_path / "out", tmp_path / "ck"
    land.mkdir()
    for name in ["deal_wrapped.txt"]:
        (land / name).write_text(open(os.path.join(FIX, name), encoding="utf-8").read(), encoding="utf-8")
    tranche_stream(spark, str(land), str(out), str(ck)).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 2
    (land / "deal_covered.txt").write_text(open(os.path.join(FIX, "deal_covered.txt"), encoding="utf-8").read(),
                                           encoding="utf-8")
    tranche_stream(spark, str(land), str(out), str(ck)).awaitTermination()
    df = spark.read.parquet(str(out))
    assert df.count() == 4   # the first file is not parsed again
    assert sorted(r.tenor for r in df.collect()) == ["2Y Floating", "5NC4", "8NC7", "9Y Fixed"]


def test_restart_without_a_named_checkpoint(spark, tmp_path):
    land, out = tmp_path / "land", tmp_path / "out"
    land.mkdir()
    for name, rows in (("deal_covered.txt", 2), ("deal_wrapped3.txt", 5)):
        (land / name).write_text(open(os.path.join(FIX, name), encoding="utf-8").read(), encoding="utf-8")
        tranche_stream(spark, str(land), str(out)).awaitTermination()
        assert spark.read.parquet(str(out)).count() == rows


def test_shared_scratch_is_required_off_local(spark):
    from quarry.session import checkpoint_root

    class Cluster:
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None)})
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: "spark://host:1" if k == "spark.master" else d)})
    with pytest.raises(RuntimeError):
        checkpoint_root(Cluster())


def test_nested_exports_scan(spark):
    issues = spark.createDataFrame(
        [("P-1", "WIKI", ("<p>alpha <b>beta</b></p>",)), ("P-2", "WIKI", (None,)),
         ("Q-1", "OTHER", ("<p>x</p>",))],
        "key string, project string, fields struct<description:string>")
    pages = spark.createDataFrame([("7", (("<h1>T</h1>&amp;x",),))],
                                  "id string, body struct<storage:struct<value:string>>")
    src = combine_sources(issue_scan(issues, source="jira", where=F.col("project") == "WIKI"),
                          page_scan(pages, source="confluence"))
    rows = {(r.source, r.doc_id): r.text.split() for r in to_text(src).collect()}
    assert rows == {("jira", "P-1"): ["alpha", "beta"], ("jira", "P-2"): [], ("confluence", "7"): ["T", "&x"]}


def test_paged_exports(spark, tmp_path):
    """A partition per page, nested fields, pushed filters, the limit by number."""
    from quarry.sources import paged
    issue = lambda i, project, text: {"key": f"{project}-{i}", "project": project, "fields": {"description": text, "other": 1}}
    issues, pages = tmp_path / "issues", tmp_path / "pages"
    issues.mkdir(), pages.mkdir()
    for n in range(4):
        rows = [issue(10 * n + i, "WIKI" if i % 2 else "OTHER", f"<p>text <b>{10 * n + i}</b></p>" if i else None) for i in range(10)]
        (issues / f"page-{n:03d}.json").write_text(json.dumps({"startAt": 10 * n, "total": 40, "issues": rows}), encoding="utf-8")
    (issues / "page-004.json").write_text(json.dumps({"startAt": 40, "project": "LAST", "issues": [{"key": "LAST-1", "fields": None}]}))
    (issues / "note.txt").write_text("not a page")
    (pages / "0.json").write_text(json.dumps({"results": [{"id": 7, "space": "S", "body": {"storage": {"value": "<h1>é</h1>"}}}, {"id": 8}]}))
    paged.register(spark)
    df = spark.read.format("paged_export").option("path", str(issues)).load()
    assert df.count() == 41 and df.rdd.getNumPartitions() == 5
    got = issue_scan(df, source="jira", where=F.col("project") == "WIKI").collect()
    assert {r["doc_id"] for r in got} == {f"WIKI-{10 * n + i}" for n in range(4) for i in range(1, 10, 2)}
    assert next(r["html"] for r in got if r["doc_id"] == "WIKI-13") == "<p>text <b>13</b></p>"
    plan = df.where("project = 'WIKI'")._jdf.queryExecution().executedPlan().toString()
    assert "WIKI" not in plan, plan                       # the source has the comparison; isnotnull stays
    assert [tuple(r) for r in df.where("key = 'LAST-1'").collect()] == [("LAST-1", "LAST", None)]
    assert df.where("project = 'LAST'").count() == 1 and df.where("fields.description is null").count() == 5
    first = spark.read.format("paged_export").option("path", str(issues)).option("limit", "25").load()
    assert sorted(int(r["key"].split("-")[1]) for r in first.collect()) == list(range(25))
    body = spark.read.format("paged_export").options(path=str(pages), kind="pages").load()
    assert [tuple(r) for r in page_scan(body, source="confluence").orderBy("doc_id").collect()] == [
        ("confluence", "7", "<h1>é</h1>"), ("confluence", "8", "")]
    with pytest.raises(Exception, match="page_size"):
        spark.read.format("paged_export").options(path=str(pages), kind="pages", limit="1").load().collect()
    assert spark.read.format("paged_export").options(path=str(pages), kind="pages", limit="1", page_size="25").load().count() == 1


def test_json_export_keeps_nulls(spark, tmp_path):
    m = spark.createDataFrame([("m1", open(os.path.join(FIX, "deal_wrapped.txt"), encoding="utf-8").read())],
                              "msg_id string, text string")
    docs = deal_documents(m, constants={"governing_law": "New York"})
    j = json.loads(to_json_documents(docs).first().json)
    assert j["governing_law"] == "New York" and "coupon" in j["tranches"][0] and j["tranches"][0]["coupon"] is None
    write_json(docs, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_tagger_train_save_load_predict(spark, tmp_path):
    tags = {"y": "B-TENOR", ")": "B-CURRENCY", "s": "B-IPT"}           # by last character
    sentences = [f"tranche {n}y ({c}) over MS+{b}bps" for n, c, b in [(7, "CHF", 88), (2, "SEK", 31), (15, "AUD", 140), (30, "CAD", 95)]]
    rows = [{"tokens": x.split(), "labels": [tags.get(w[-1], "O") for w in x.split()]} for x in sentences]
    tagger = train_tagger(labelled_rows(spark, rows), max_iter=50)
    save_tagger(tagger, str(tmp_path / "m"))
    again = load_tagger(str(tmp_path / "m"))
    assert (again.start, again.move) == (tagger.start, tagger.move)
    text = spark.createDataFrame([(0, "tranche 9y (NOK) over MS+52bps")], "sentence_id long, text string")
    pred = predict(again, explode_text(text))
    assert sorted(map(tuple, predict_path(again, explode_text(text)).collect())) == sorted(map(tuple, pred.collect()))
    pairs = pair_labels(pred).first().pairs
    assert [p[0] for p in pairs] == ["tranche", "9y", "(NOK)", "over", "MS+52bps"]
    assert [p[1] for p in pairs] == ["O", "B-TENOR", "B-CURRENCY", "O", "B-IPT"]


def test_best_paths_by_enumeration(spark):
    """Every label sequence tried; empty sentences and ties included."""
    rng = np.random.default_rng(4)
    n = len(LABELS)
    move, start = rng.normal(size=(n, n)).round(3).tolist(), rng.normal(size=n).round(3).tolist()
    rows = [(i, rng.normal(size=(i % 6, n)).round(3).tolist()) for i in range(30)] + [(99, [[0.0] * n])]
    df = spark.createDataFrame(rows, "i int, scores array<array<double>>")
    for i, scores, path in df.select("i", "scores", best_path(F.col("scores"), start, move)).collect():
        ways = [(start[p[0]] + sum(s[k] for s, k in zip(scores, p)) + sum(move[a][b] for a, b in zip(p, p[1:])), p)
                for p in product(range(n), repeat=len(scores)) if p]
        assert tuple(path) == (max(ways, key=lambda w: w[0])[1] if ways else ()), i
    flat = spark.createDataFrame([([[0.0] * n] * 4,)], "s array<array<double>>")
    assert flat.select(best_path(F.col("s"), [0.0] * n, [[0.0] * n] * n)).first()[0] == [0, 0, 0, 0]


def test_transitions_are_counted_with_one_added(spark):
    rows = [{"tokens": ["a", "b", "c"], "labels": ["O", "B-TENOR", "O"]}, {"tokens": ["a"], "labels": ["B-IPT"]}, {"tokens": [], "labels": []}]
    start, move = label_transitions(labelled_rows(spark, rows))
    assert np.allclose(np.exp(start), [2 / 6, 1 / 6, 1 / 6, 2 / 6])
    assert np.allclose(np.exp(move[0]), [1 / 5, 2 / 5, 1 / 5, 1 / 5]) and np.allclose(np.exp(move[3]), [1 / 4] * 4)


def test_model_embed_uses_caller_model(spark):
    def load():
        return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)
    df = spark.createDataFrame([("a b c",), ("",)], "t string")
    assert [r[0] for r in df.select(model_embed("t", load)).collect()] == [[5.0, 2.0], [0.0, 0.0]]


def test_each_distinct_text_is_embedded_once(spark, tmp_path):
    """The model logs what it sees; a third of the rows hold one text."""
    from quarry.operators.embedding import embed_distinct
    log = str(tmp_path)

    def load():
        import os
        import uuid

        def encode(texts):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write("".join(f"{t}|" for t in texts))
            return np.array([[len(t), t.count("a"), t.count(" ")] for t in texts], dtype=np.float32)
        return encode
    texts = ["a b a"] * 1500 + [f"text {i % 700} a" for i in range(2900)] + ["", None, None]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "i int, content string, _rows2 int").repartition(7)
    got = {r["i"]: list(r["embedding"]) for r in embed_distinct(df, load).collect()}
    seen = [t for f in os.listdir(log) for t in open(os.path.join(log, f)).read().split("|")[:-1]]
    assert sorted(seen) == sorted(set(t or "" for t in texts))
    want = {r["i"]: list(r["e"]) for r in df.select("i", model_embed("content", load).alias("e")).collect()}
    assert got == want and len(got) == len(texts)
    assert embed_distinct(df.limit(0), load).count() == 0


def test_index_with_a_model(spark, tmp_path):
    from quarry.operators.hybrid import build_index, hybrid_search, read_index

    def load():
        return lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts], dtype=np.float32)
    docs = spark.createDataFrame([("s", str(i), t) for i, t in enumerate(["a a a", "b b", "a b", "a b"])], "source string, doc_id string, text string")
    build_index(docs, str(tmp_path / "idx"), html=False, model=load)
    idx = read_index(spark, str(tmp_path / "idx"))
    assert {r["doc_id"]: list(r["embedding"]) for r in idx.chunks.collect()} == {"0": [3, 0], "1": [0, 2], "2": [1, 1], "3": [1, 1]}
    q = spark.createDataFrame([(0, "b b b")], "query_id long, query string")
    top = hybrid_search(idx, q, 1, semantic_score="similarity", embed=lambda c: model_embed(c, load)).first()
    assert top["doc_id"] == "1"


def test_ingest_and_query_api(spark, tmp_path):
    from quarry.api import ingest, query
    issues = spark.createDataFrame(
        [("P-1", ("<p>alpha beta gamma. Delta epsilon</p>",)), ("P-2", ("<p>omega kappa</p>",))],
        "key string, fields struct<description:string>")
    pages = spark.createDataFrame([("7", (("<h1>Beta</h1><p>alpha &amp; beta</p>",),))],
                                  "id string, body struct<storage:struct<value:string>>")
    path = str(tmp_path / "idx")
    ingest(path, issues, pages)
    ingest(path, issues, pages)          # re-run replaces, never appends
    res = query(spark, path, "alpha beta", top_k=3, semantic_score="similarity")
    assert res.columns == ["query_id", "rank", "source_id", "snippet", "score"]
    hits = res.orderBy("rank").collect()
    assert [h["rank"] for h in hits] == [1, 2, 3]
    assert {h.source_id for h in hits} == {"jira:P-1", "jira:P-2", "confluence:7"}
    # with 3 chunks the query terms' idf is floored to 1e-6, so the vector
    # hits (whole chunk text as snippet) outrank the keyword ones
    assert all("[" not in h.snippet for h in hits)
    from quarry.operators.hybrid import read_index
    assert read_index(spark, path).chunks.count() == 3
    # per-query top_k, and the nested answer
    from quarry.api import nested
    frame = spark.createDataFrame([(1, "alpha", 2), (2, "alpha", 1), (3, "alpha", None)], "query_id long, query string, top_k int")
    got = {r["query_id"]: r["hits"] for r in nested(query(spark, path, frame, top_k=3)).collect()}
    assert [len(got[i]) for i in (1, 2, 3)] == [2, 1, 3]
    two = query(spark, path, "alpha", top_k=2).orderBy("rank").collect()
    assert [h["source_id"] for h in got[1]] == [h["source_id"] for h in two]


def test_failed_rebuild_keeps_the_old_index(spark, tmp_path, monkeypatch):
    from quarry.operators import hybrid
    path = str(tmp_path / "idx")
    docs = lambda *t: spark.createDataFrame([("s", str(i), x) for i, x in enumerate(t)], "source string, doc_id string, text string")
    hybrid.build_index(docs("one two", "three"), path, html=False)
    monkeypatch.setattr(hybrid.versions, "commit", lambda *a: 1 / 0)     # fails before the commit
    with pytest.raises(ZeroDivisionError):
        hybrid.build_index(docs("other"), path, html=False)
    monkeypatch.undo()
    assert sorted(r["content"] for r in hybrid.read_index(spark, path).chunks.collect()) == ["one two", "three"]
    hybrid.build_index(docs("other"), path, html=False)
    idx = hybrid.read_index(spark, path)
    assert [r["content"] for r in idx.chunks.collect()] == ["other"]
    assert [tuple(r) for r in term_df(idx.keyword).collect()] == [("other", 1)]


def test_inferred_tenor_with_other_date_formats(spark):
    from quarry.functions.deal import infer_tenor
    df = spark.createDataFrame([("June 1, 2025", "June 3, 2030"), ("2025-01-01", "June 3, 2030"), ("soon", "2030-01-01")], "a string, b string")
    assert [r[0] for r in df.select(infer_tenor(F.col("a"), F.col("b"), ("MMMM d, yyyy",))).collect()] == ["5Y", "5Y", None]
    assert [r[0] for r in df.select(infer_tenor(F.col("a"), F.col("b"))).collect()] == [None, None, None]


def test_worker_side_modules_ship_by_value():
    """Workers must not need the package installed (queries run from any
    directory or on a cluster)."""
    import pickle
    from pyspark import cloudpickle
    from quarry.functions import embed
    from quarry.operators import vector
    for fn in (embed._count_vector_fn, vector._score, vector._members):
        blob = cloudpickle.dumps(fn)
        # a by-reference pickle is a short global lookup; by value carries the code
        assert len(blob) > 200, fn.__name__
        assert pickle.loads(blob).__code__.co_code == fn.__code__.co_code
