"""Token tagging with Spark MLlib: explode labelled sentences, index the
labels in a fixed order, featurise each token with its neighbours, train a
multinomial logistic regression, predict, and pair tokens with labels.

Neighbour features are read from the sentence's own token array beside the
exploded position, so featurisation needs no window and no shuffle; training is
MLlib's distributed L-BFGS over the distinct token rows, weighted by how often
each occurs.

Labels are predicted token by token (the most probable one) or for the whole
sentence: how often one label follows another is counted over the labelled
sentences, and the best path through a sentence's label probabilities and
these transitions is found by one fold over the sentence's array.
"""

from __future__ import annotations

import json
import math
import string
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, IndexToString, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import let, split_words
from quarry.operators.common import sized

# ---------------------------------------------------------------------------
# The label set and its order (ids 0..3), as in the reference:
#   O, B-TENOR, B-CURRENCY, B-IPT
LABELS = ["O", "B-TENOR", "B-CURRENCY", "B-IPT"]
# ---------------------------------------------------------------------------

FEATURES = ["f_word", "f_lower", "f_prefix", "f_suffix", "f_shape", "f_prev", "f_next", "f_first", "f_last"]


# worker-side code travels by value: workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _shape(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase + string.ascii_lowercase + string.digits, "X" * 26 + "x" * 26 + "d" * 10)


def token_features(tokens: Column, i: Column) -> list[Column]:
    """Features of token ``i`` of a sentence, all null outside it.  They are read
    beside an exploded position, so no sentence's features are held at once."""
    t, n = F.get(tokens, i), F.size(tokens)
    low = F.lower(t)
    feats = [i.alias("pos"), t.alias("token"),
             t.alias("f_word"), low.alias("f_lower"),
             F.substring(low, 1, 3).alias("f_prefix"),
             F.substring(low, -3, 3).alias("f_suffix"),
             _shape(t).alias("f_shape"),
             F.coalesce(F.lower(F.get(tokens, i - 1)), F.lit("<s>")).alias("f_prev"),
             F.coalesce(F.lower(F.get(tokens, i + 1)), F.lit("</s>")).alias("f_next"),
             (i == 0).cast("string").alias("f_first"),
             (i == n - 1).cast("string").alias("f_last")]
    return [F.when(i < n, f).alias(name) for f, name in zip(feats, ["pos", "token", *FEATURES])]


def explode_labelled(sentences: DataFrame, id_col: str = "sentence_id", tokens: str = "tokens",
                     labels: str = "labels") -> DataFrame:
    """``(sentence_id, pos, token, label, f_*)`` - one row per labelled token
    (tokens and labels paired by position)."""
    s = sentences.select(F.col(id_col).alias("sentence_id"), F.col(tokens).alias("_t"), F.col(labels).alias("_l"))
    # an outer generator: for another one Spark repeats its input in a filter
    rows = s.select("*", F.posexplode_outer(F.arrays_zip("_t", "_l")).alias("_i", "_z")).where(F.col("_i").isNotNull())
    return rows.select("sentence_id", *token_features(F.col("_t"), F.col("_i")), F.get("_l", F.col("_i")).alias("label"))


def explode_text(texts: DataFrame, id_col: str = "sentence_id", text: str = "text") -> DataFrame:
    """Raw text -> one row per whitespace token with its features.  The rows of
    a text lie side by side, in token order."""
    s = texts.select(F.col(id_col).alias("sentence_id"), split_words(text).alias("_t"))
    rows = s.select("*", F.posexplode_outer("_t").alias("_i", "_w")).where(F.col("_i").isNotNull())
    return rows.select("sentence_id", *token_features(F.col("_t"), F.col("_i")))


def label_indexer(input_col: str = "label", output_col: str = "label_id") -> StringIndexerModel:
    """Fixed label -> id mapping (``LABELS`` order), never learned from data."""
    return StringIndexerModel.from_labels(LABELS, inputCol=input_col, outputCol=output_col,
                                          handleInvalid="error")


def tagger_pipeline(max_iter: int = 30, reg: float = 1e-3, num_features: int = 1 << 16) -> Pipeline:
    return Pipeline(stages=[
        label_indexer(),
        FeatureHasher(inputCols=FEATURES, outputCol="features", numFeatures=num_features),
        LogisticRegression(featuresCol="features", labelCol="label_id", weightCol="n", family="multinomial",
                           maxIter=max_iter, regParam=reg),
        IndexToString(inputCol="prediction", outputCol="predicted_label", labels=LABELS),
    ])


@dataclass
class Tagger:
    """The token classifier, and the log probabilities of a sentence's first
    label (``start``) and of a label after another (``move[before][after]``)."""

    model: PipelineModel
    start: list[float]
    move: list[list[float]]


def label_transitions(sentences: DataFrame, labels: str = "labels") -> tuple[list[float], list[list[float]]]:
    """``(start, move)`` of a ``Tagger``, from counts over the label lists with
    one added to each; labels outside ``LABELS`` are an error."""
    each = sentences.select(F.col(labels).alias("_l")).select("_l", F.posexplode_outer("_l").alias("_i", "after"))
    rows = (each.where(F.col("_i").isNotNull()).groupBy(F.get("_l", F.col("_i") - 1).alias("before"), "after")
            .agg(F.count(F.lit(1)).alias("n")).collect())                  # a row per pair of labels
    n = len(LABELS)
    counts = {None: [1] * n} | {label: [1] * n for label in LABELS}
    for r in rows:
        counts[r["before"]][LABELS.index(r["after"])] += r["n"]
    log = {k: [math.log(c / sum(v)) for c in v] for k, v in counts.items()}
    return log[None], [log[label] for label in LABELS]


def train_tagger(sentences: DataFrame, tokens: str = "tokens", labels: str = "labels", id_col: str = "sentence_id", **kw) -> Tagger:
    """Fit on labelled sentences ``(sentence_id, tokens, labels)``.  Tokens of
    equal features and label are one example of that weight: the same sum, in
    one pass over the sentences."""
    rows = explode_labelled(sentences, id_col, tokens, labels)
    examples = sized(rows.groupBy(*FEATURES, "label").agg(F.count(F.lit(1)).cast("double").alias("n")), "examples")
    model = tagger_pipeline(**kw).fit(examples)
    return Tagger(model, *label_transitions(sentences, labels))


def _scored(tagger: Tagger, tokens: DataFrame) -> DataFrame:
    """Token rows with the model's columns; they need no ``label`` (the label
    indexer is skipped for prediction)."""
    stages = [s for s in tagger.model.stages if not isinstance(s, StringIndexerModel)]
    return PipelineModel(stages).transform(tokens)


def predict(tagger: Tagger, tokens: DataFrame) -> DataFrame:
    """``(sentence_id, pos, token, predicted_label)``: each token's most
    probable label by itself."""
    return _scored(tagger, tokens).select("sentence_id", "pos", "token", "predicted_label")


def best_path(scores: Column, start: list[float], move: list[list[float]]) -> Column:
    """Label numbers of the best path through ``scores`` (an array per token of
    log probabilities per label).  One fold keeps, per label, the best score of
    a path that ends there and the label before it, token by token; a second
    one walks back.  Of equal paths the smaller label number is taken."""
    n = len(start)
    kind = "struct<score:array<double>,back:array<array<int>>>"

    def step(acc: Column, e: Column) -> Column:
        def ends(j: int) -> Column:
            ways = [F.struct((F.get(acc["score"], F.lit(i)) + F.lit(move[i][j])).alias("s"), F.lit(-i).alias("i")) for i in range(n)]
            return F.greatest(*ways)
        best = F.array(*[ends(j) for j in range(n)])
        return let(best, lambda b: F.struct(
            F.transform(b, lambda w, j: w["s"] + F.get(e, j)).alias("score"),
            F.concat(acc["back"], F.array(F.transform(b, lambda w: -w["i"]))).alias("back")))

    def walk(done: Column) -> Column:
        last = F.greatest(*[F.struct(F.get(done["score"], F.lit(j)).alias("s"), F.lit(-j).alias("j")) for j in range(n)])
        return F.reverse(F.aggregate(F.reverse(done["back"]), F.array(-last["j"]),
                                     lambda path, row: F.concat(path, F.array(F.get(row, F.element_at(path, -1))))))

    first = F.struct(F.zip_with(F.lit([float(x) for x in start]), F.get(scores, F.lit(0)), lambda a, b: a + b).alias("score"),
                     F.array().cast("array<array<int>>").alias("back")).cast(kind)
    rest = F.slice(scores, 2, F.greatest(F.size(scores) - 1, F.lit(0)))
    return F.when(F.size(scores) == 0, F.array().cast("array<int>")).otherwise(
        let(F.aggregate(rest, first, step), walk))


def _paths(ids: pa.Array, pos: np.ndarray, scores: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, labels)``: the first row of each sentence (position 0) of a
    batch, and ``best_path`` of all of them, a place at a time."""
    starts = np.flatnonzero(pos == 0)
    lengths = np.diff(np.append(starts, len(pos)))
    best, back = scores + start, np.zeros(scores.shape, dtype=np.int64)
    for i in range(1, int(lengths.max(initial=0))):
        at = starts[lengths > i] + i
        ways = best[at - 1][:, :, None] + move[None]
        back[at] = ways.argmax(1)
        best[at] = ways.max(1) + scores[at]
    labels = np.zeros(len(pos), dtype=np.int64)
    ends = starts + lengths - 1
    labels[ends] = best[ends].argmax(1)
    for i in range(int(lengths.max(initial=0)) - 1, 0, -1):
        at = starts[lengths > i] + i
        labels[at - 1] = back[at, labels[at]]
    return starts, labels


def _path_rows(scored: DataFrame, tagger: Tagger, nested: bool) -> DataFrame:
    """``predict_path`` of rows that lie side by side, without a shuffle."""
    start, move, names = np.array(tagger.start), np.array(tagger.move), pa.array(LABELS)

    def out(b: pa.RecordBatch) -> pa.RecordBatch:
        p = b.column("probability")
        scores = np.log(np.maximum(p.flatten().to_numpy(zero_copy_only=False).reshape(len(p), len(start)), 1e-300))
        first, labels = _paths(b.column("sentence_id"), b.column("pos").to_numpy(zero_copy_only=False), scores, start, move)
        columns = [b.column("pos"), b.column("token"), names.take(pa.array(labels))]
        if not nested:
            return pa.RecordBatch.from_arrays([b.column("sentence_id"), *columns], ["sentence_id", *keep])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, b.num_rows).astype(np.int32)), pa.StructArray.from_arrays(columns, keep))
        return pa.RecordBatch.from_arrays([b.column("sentence_id").take(pa.array(first)), lists], ["sentence_id", "labelled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            begins = np.flatnonzero(b.column("pos").to_numpy(zero_copy_only=False) == 0)
            if not len(begins):
                continue                                   # a sentence longer than a batch goes on
            cut = held.num_rows - b.num_rows + int(begins[-1])
            if cut:
                yield out(held.slice(0, cut).combine_chunks().to_batches()[0])
            held = held.slice(cut)
        if held is not None and held.num_rows:
            yield out(held.combine_chunks().to_batches()[0])

    keep = ["pos", "token", "predicted_label"]
    kind = scored.schema["sentence_id"].dataType.simpleString()
    one = "pos int, token string, predicted_label string"
    shape = f"sentence_id {kind}, labelled array<struct<pos:int,token:string,predicted_label:string>>" if nested else f"sentence_id {kind}, {one}"
    rows = scored.select("sentence_id", "pos", "token", vector_to_array("probability").alias("probability"))
    return rows.mapInArrow(run, shape)


def predict_path(tagger: Tagger, tokens: DataFrame, adjacent: bool = False, nested: bool = False) -> DataFrame:
    """``(sentence_id, pos, token, predicted_label)`` of the most probable label
    sequence of each sentence; ``nested``: ``(sentence_id, labelled)``, a row per
    sentence.  A group is one sentence, bounded by its text.  ``adjacent`` says
    that the rows of a sentence lie side by side from position 0 on, as
    ``explode_text`` gives them; others are brought together by a shuffle."""
    if adjacent:
        return _path_rows(_scored(tagger, tokens), tagger, nested)
    log = F.transform(vector_to_array("probability"), lambda p: F.log(F.greatest(p, F.lit(1e-300))))
    one = F.struct("pos", "token", log.alias("scores"))
    whole = (_scored(tagger, tokens).groupBy("sentence_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
             .withColumn("path", best_path(F.col("t.scores"), tagger.start, tagger.move)))
    names = F.lit(LABELS)
    out = F.zip_with("t", "path", lambda t, k: F.struct(t["pos"].alias("pos"), t["token"].alias("token"), F.get(names, k).alias("predicted_label")))
    rows = whole.select("sentence_id", out.alias("labelled"))
    return rows if nested else rows.select("sentence_id", F.inline("labelled"))


def pair_labels(pred: DataFrame) -> DataFrame:
    """One row per sentence: ``pairs`` = [(token, label)] in token order, of
    token rows or of the nested rows of ``predict_path``.  The group is one
    sentence, bounded by its length."""
    if "labelled" in pred.columns:
        whole = pred.select("sentence_id", F.col("labelled").alias("p"))
    else:
        whole = (pred.groupBy("sentence_id")
                 .agg(F.sort_array(F.collect_list(F.struct("pos", "token", "predicted_label"))).alias("p")))
    return whole.select("sentence_id", F.transform("p", lambda x: F.struct(x["token"], x["predicted_label"])).alias("pairs"))


def save_tagger(tagger: Tagger, path: str) -> None:
    """The pipeline under ``path/model`` and the transitions, in one row, under
    ``path/transitions``."""
    spark = SparkSession.getActiveSession()
    tagger.model.write().overwrite().save(f"{path}/model")
    entry = json.dumps({"labels": LABELS, "start": tagger.start, "move": tagger.move})
    spark.createDataFrame([(entry,)], "entry string").coalesce(1).write.mode("overwrite").parquet(f"{path}/transitions")


def load_tagger(path: str) -> Tagger:
    spark = SparkSession.getActiveSession()
    entry = json.loads(spark.read.parquet(f"{path}/transitions").first()["entry"])
    return Tagger(PipelineModel.load(f"{path}/model"), entry["start"], entry["move"])
