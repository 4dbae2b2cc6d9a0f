import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarry.llm.decontam import Items, find
from quarry.llm.pii import base_spans

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    rows = docs.collect()
    extra = [(90_001, rows[1]["text"].upper(), "en", "src1", 1), (90_002, rows[1]["text"], "en", None, 1), (None, None, None, None, None),
             (90_003, rows[1]["text"][:200] + "\n" + bench[3][1].upper() + "\n" + rows[1]["text"][300:], "en", "src1", 7)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = []
    for name, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    rules, copies, clean, private = kept
    assert None not in rules and 1 in rules
    assert set(copies) <= set(rules) and 90_001 not in copies and 90_002 not in copies
    items = Items(*map(list, zip(*bench)))
    texts = list(copies)
    leaked = {texts[d] for d, *_ in find([copies[t] for t in texts], items)}
    assert 90_003 not in clean and set(clean) == set(copies) - leaked
    assert private.keys() == clean.keys()
    for i, t in private.items():
        assert not base_spans(t)
        if not re.search(r"\[(email|ip|card|phone)\]", t):
            assert t == clean[i]
    mixed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in mixed} == set(private)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_null_and_repeated_ids_are_no_key(spark):
    """Several rows without an id, and one id with two texts: each row is
    judged by itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()[3]["text"]
    good = [r["text"] for r in cp.rules_stage(spark, docs, SF).orderBy("doc_id").collect()]
    leaks = {d for d, *_ in find(good, Items(*map(list, zip(*[(r["item_id"], r["text"]) for r in
                                                         spark.read.parquet(f"{SF}/benchmark.parquet").collect()]))))}
    a, b, c, d = [t for i, t in enumerate(good) if i not in leaks][:4]

    def run(stage, rows):
        out = stage(spark, spark.createDataFrame([(i, t, "en", "src", 1) for i, t in rows], docs.schema), SF)
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    want = lambda rows: sorted(rows, key=str)
    leaked = c[:200] + "\n" + bench + "\n" + c[200:]
    assert run(cp.decontamination_stage, [(None, a), (None, leaked), (7, b), (7, leaked)]) == want([(None, a), (7, b)])
    assert run(cp.rules_stage, [(None, a), (None, "too short"), (7, b), (7, "too short")]) == want([(None, a), (7, b)])
    near = lambda t: t + " tail"
    got = run(cp.near_copies_stage, [(1, a), (None, near(a)), (None, b), (None, near(b)), (7, c), (7, near(c)), (7, d), (7, d),
                                     (None, None), (None, " "), (8, ""), (8, "")])
    assert len(got) == 7 and (1, a) in got and (7, d) in got
    assert sum(t in (b, near(b)) for _, t in got) == 1 == sum(t in (c, near(c)) for _, t in got)
    assert {(None, None), (None, " "), (8, "")} <= set(got)


CLASHES = ["kept", "rule", "n_words", "spans", "n_added", "_cls", "_id", "_row", "taken", "size", "cell", "target", "draw"]


def test_columns_of_any_names_pass_through_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, c in enumerate(CLASHES):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i}-"), F.col("doc_id")))
    ours = lambda r: tuple(r[c] for c in CLASHES)
    for name, stage in cp.STAGES[:-1]:
        out = cp.written(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all(ours(r) == tuple(f"{i}-{r['doc_id']}" for i in range(len(CLASHES))) for r in rows), name
        docs = out
    texts = {r["doc_id"]: (r["text"], r["lang"], r["n_chars"]) for r in docs.collect()}
    mixed = cp.STAGES[-1][1](spark, docs, SF)
    assert len(set(mixed.columns)) == len(mixed.columns)
    for r in mixed.collect():
        assert (r["text"], r["lang"], r["n_chars"]) == texts[r["doc_id"]]
        assert r["document_taken"] == f"8-{r['doc_id']}" and r["document_size"] == f"9-{r['doc_id']}" and r["taken"] <= 2 * r["size"]
        assert r["kept"] == f"0-{r['doc_id']}"
