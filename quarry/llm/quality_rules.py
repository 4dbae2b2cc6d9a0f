"""Quality rules: text statistics and a learned decision list over them.

Sequential covering in the manner of grow-and-prune rule learners: a rule is
a conjunction of thresholds that predicts "reject"; it is grown on two thirds
of the labelled statistics, pruned on the other third, kept only if it is
precise there, and the rows it covers are taken out before the next rule.
The list becomes one ordered Spark ``CASE`` expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import labelled_sample
from quarry.llm.words import IS_SPACE, Words, blocks, mix, ngram_hashes

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_bytes", "n_upper", "n_digits", "n_bars", "n_distinct"]
#: What rules may look at, as SQL over the statistics.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_bytes, 1)",
    "digit_share": "n_digits / greatest(n_bytes, 1)",
}
#: Labelled rows that rules are learned from, at most.
LABEL_LIMIT = 20_000

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    count = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=count[1:])
    return count[off[1:]] - count[off[:-1]]


def _repeats(key: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more, all occurrences."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of BASE and MORE for each text of a block."""
    w = Words(column)
    raw, off, first = w.raw, w.offsets, w.first
    n = len(off) - 1
    out = {"n_words": np.diff(first)}
    lead = (raw & 0xC0) != 0x80
    out["word_chars"] = _per_text(lead & ~IS_SPACE[raw], off)
    out["n_symbols"] = _per_text(SYMBOL[raw], off)
    out["n_bytes"] = np.diff(off)
    out["n_upper"] = _per_text((raw >= 65) & (raw <= 90), off)
    out["n_digits"] = _per_text((raw >= 48) & (raw <= 57), off)
    out["n_bars"] = _per_text(raw == 124, off)
    # lines that hold a word
    breaks = np.flatnonzero(raw == 10)
    starts = np.union1d(off[:-1], breaks + 1)
    starts = starts[starts < len(raw)]
    doc = np.searchsorted(off, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(raw)), off[doc + 1])
    closed = (ends > starts) & (raw[np.maximum(ends - 1, 0)] == 10)
    ends = ends - closed
    has = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, doc = starts[has], ends[has], doc[has]
    out["n_lines"] = np.bincount(doc, minlength=n)
    key = mix(w.range_hash(starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
    _, kept = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[kept], minlength=n)
    # words, and windows of three words found twice or more in their text
    h = w.hashes()
    salt = w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, kept = np.unique(mix(h + salt, 5), return_index=True)
    out["n_distinct"] = np.bincount(w.doc[kept], minlength=n)
    marks = np.zeros(len(h), dtype=bool)
    if len(h) >= 3:
        inside = np.flatnonzero(w.doc[2:] == w.doc[:-2])
        twice = inside[_repeats(mix(ngram_hashes(h, 3)[inside] + salt[inside], 7))]
        for i in range(3):
            marks[twice + i] = True
    out["n_repeat_words"] = _per_text(marks, first)
    return out


def text_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``doc_id`` and the statistics of every whole text, one row per row of
    ``docs``.  A null or empty text has 0 throughout.  ``carry`` keeps the
    text and further columns."""
    kept = [] if carry is None else ["text", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, "text"):
                s = statistics(b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *(pa.array(s[c].astype(np.int64)) for c in BASE + MORE), *(b.column(c) for c in kept)],
                    ["doc_id", *BASE, *MORE, *kept])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *(carry or []))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", *(f"{c} bigint" for c in BASE + MORE),
                                           *(f"`{c}` {kinds[c]}" for c in kept)]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool          # value > threshold, else value <= threshold
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = F.expr(FEATURES[self.feature])
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)


def _covered(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _candidates(x: dict[str, np.ndarray], rows: np.ndarray) -> list[Test]:
    tests = []
    for name, v in x.items():
        cuts = np.unique(np.round(np.quantile(v[rows], np.linspace(0.02, 0.98, 33)), 6)) if rows.any() else []
        tests += [Test(name, above, float(c)) for c in cuts for above in (False, True)]
    return tests


def _grow(x, bad, weight_total, rows) -> list[Test]:
    """Adds the test of the largest information gain until the rule is pure."""
    rule, now = [], rows.copy()
    while len(rule) < 4:
        p, n = int((now & bad).sum()), int((now & ~bad).sum())
        if not n or not p:
            break
        best, gain = None, 1e-9
        for t in _candidates(x, now):
            c = now & t.holds(x)
            p1, n1 = int((c & bad).sum()), int((c & ~bad).sum())
            if p1:
                g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                if g > gain:
                    best, gain = t, g
        if best is None:
            break
        rule.append(best)
        now &= best.holds(x)
    return rule


def learn_rules(x: dict[str, np.ndarray], good: np.ndarray, min_precision: float = 0.9,
                min_rows: int = 5, most_rules: int = 24, seed: int = 7) -> list[list[Test]]:
    """Ordered reject rules from statistics ``x`` and labels (``good``: keep).

    A rule must cover ``min_rows`` rejects and reach ``min_precision`` on all
    rows still uncovered, so a clean document is given up only with strong
    evidence.  No labelled rejects: no rules."""
    n = len(good)
    bad = ~good
    growing = np.random.default_rng(seed).random(n) < 2 / 3
    left = np.ones(n, dtype=bool)
    rules: list[list[Test]] = []
    while len(rules) < most_rules and (left & bad & growing).any():
        rule = _grow(x, bad, n, left & growing)
        if not rule:
            break

        def worth(r: list[Test], check=left & ~growing) -> float:
            c = check & _covered(r, x, n)
            p, q = int((c & bad).sum()), int((c & ~bad).sum())
            return (p - q) / (p + q) if p + q else -1.0
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = left & _covered(rule, x, n)
        p, q = int((c & bad).sum()), int((c & ~bad).sum())
        if p < min_rows or p < min_precision * (p + q):
            break
        rules.append(rule)
        left &= ~c
    return rules


def reject_expression(rules: list[list[Test]]) -> Column:
    """The 1-based number of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        cond = F.lit(True)
        for t in rule:
            cond &= t.column()
        out = F.when(cond, F.lit(i)).otherwise(out)
    return out


def describe(rules: list[list[Test]]) -> list[str]:
    return [" and ".join(f"{t.feature} {'>' if t.above else '<='} {t.threshold:g}" for t in r) for r in rules]


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LABEL_LIMIT) -> list[list[Test]]:
    """Rules learned from at most ``limit`` labelled documents ``doc_id, text``;
    only their statistics are taken.  An id of several texts has the least
    statistics among them, whatever the order of rows."""
    sample = labelled_sample(labels, label, limit)
    chosen = docs.join(F.broadcast(sample), "doc_id")                     # at most `limit` keys
    stats = text_statistics(chosen, "text", "doc_id", ["label"])
    values = F.struct(*[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()])
    rows = (stats.groupBy("doc_id", "label").agg(F.min(values).alias("x"))
            .select("doc_id", "label", "x.*").collect())
    rows.sort(key=lambda r: r["doc_id"])                                  # row order must not matter
    x = {f: np.array([r[f] for r in rows], dtype=float) for f in FEATURES}
    return learn_rules(x, np.array([r["label"] != 0 for r in rows], dtype=bool))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                  label: str = "quality", carry: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the statistics, ``base_failed``,
    ``rule`` (number of the first learned rule that rejects, else null) and
    ``kept``.

    Nulls and empty texts fail the base rule (no words).  A null key gets its
    row all the same; repeated rows get equal rows.  Without labels the base
    rule decides alone.  ``carry`` keeps the text and further columns, of any
    names but those of the result."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rule = reject_expression(fit_rules(own, labels, label))
    stats = text_statistics(docs, text, key, carry)
    return (stats.withColumn("base_failed", base_failed()).withColumn("rule", rule)
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))
