"""Personal data: fixed patterns, and a character-level bidirectional LSTM with
CRF transitions that adds spans.

The network is trained in numpy on windows around the spans that the patterns
label in a bounded sample of documents.  It reads every character of every
text in overlapping windows; each character takes its tag from the window in
which it lies farthest from an edge, and spans are runs of equal tags over
the whole text, so a span may cross any number of windows.  Gates are
piecewise linear (hard sigmoid and hard tanh).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import labelled_sample, shipped
from quarry.llm.decontam import code_points
from quarry.llm.words import blocks

KINDS = ["email", "ip", "card", "phone"]
#: Documents whose patterns label the training windows, and windows of each.
SAMPLE_DOCS = 6_000
WINDOWS_PER_DOC = 6
WINDOW, MARGIN = 256, 32          # scanned; MARGIN characters are context on either side
TRAIN_WINDOW = 96
HIDDEN = 8
BLOCK_BYTES = 1_000_000

# Fixed patterns.  Possessive forms of the stated ones: they match the same
# spans without backtracking.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str, digits: bool = True) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start.  ``digits=False`` tells
    that the text has none."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:                          # a match holds one @, so each @ is tried once
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if digits:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            d = _DIGITS.sub("", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


# ------------------------------------------------------------------ network
#: Inputs: ASCII by code, one for all others, one for "outside the text".
OTHER, PAD, INPUTS = 128, 129, 130
TAGS = 1 + len(KINDS)


def _inputs(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, points, OTHER).astype(np.uint8)


class Tagger:
    """Weights by name.  ``x``: input rows of the gates (i, f, o, g) per
    character; ``u``: recurrent; ``w``: emissions; f and b: direction."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        p = {}
        for d in "fb":
            p["x" + d] = rng.normal(0, 0.5, (INPUTS, 4 * h))
            p["x" + d][:, h: 2 * h] += 2.0
            p["u" + d] = rng.normal(0, 0.6 / np.sqrt(h), (h, 4 * h))
            p["w" + d] = rng.normal(0, 0.5, (h, TAGS))
        p["bias"] = np.zeros(TAGS)
        p["move"] = np.eye(TAGS) * 1.0
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    # training ---------------------------------------------------------------
    def _run(self, x: np.ndarray, d: str):
        """Hidden states (T, B, H) and what the gradient needs."""
        t, b = x.shape
        h, p = HIDDEN, self.p
        hs = np.zeros((t + 1, b, h), np.float32)
        cs = np.zeros((t + 1, b, h), np.float32)
        acts = np.empty((t, b, 4 * h), np.float32)
        for s in range(t):
            a = p["x" + d][x[s]] + hs[s] @ p["u" + d]
            acts[s] = a
            g = np.clip(0.25 * a[:, :3 * h] + 0.5, 0, 1)
            cs[s + 1] = g[:, h: 2 * h] * cs[s] + g[:, :h] * np.clip(a[:, 3 * h:], -1, 1)
            hs[s + 1] = g[:, 2 * h:] * np.clip(cs[s + 1], -1, 1)
        return hs, cs, acts

    def _back(self, x, d, hs, cs, acts, dh_out, grad):
        t, b = x.shape
        h, u = HIDDEN, self.p["u" + d]
        dh = np.zeros((b, h), np.float32)
        dc = np.zeros((b, h), np.float32)
        da = np.empty((t, b, 4 * h), np.float32)
        for s in range(t - 1, -1, -1):
            a, c = acts[s], cs[s + 1]
            g = np.clip(0.25 * a[:, :3 * h] + 0.5, 0, 1)
            slope = 0.25 * (np.abs(a[:, :3 * h]) < 2)
            cand = np.clip(a[:, 3 * h:], -1, 1)
            dh = dh + dh_out[s]
            m = np.clip(c, -1, 1)
            dc = dc + dh * g[:, 2 * h:] * (np.abs(c) < 1)
            da[s, :, :h] = dc * cand * slope[:, :h]
            da[s, :, h: 2 * h] = dc * cs[s] * slope[:, h: 2 * h]
            da[s, :, 2 * h: 3 * h] = dh * m * slope[:, 2 * h:]
            da[s, :, 3 * h:] = dc * g[:, :h] * (np.abs(a[:, 3 * h:]) < 1)
            dh = da[s] @ u.T
            dc = dc * g[:, h: 2 * h]
        flat = da.reshape(-1, 4 * h)
        np.add.at(grad["x" + d], x.reshape(-1), flat)
        grad["u" + d] += hs[:-1].reshape(-1, h).T @ flat

    def loss(self, x: np.ndarray, y: np.ndarray):
        """CRF negative log-likelihood per window, and the gradient."""
        t, b = x.shape
        p = self.p
        fwd, bwd = self._run(x, "f"), self._run(x[::-1], "b")
        hf, hb = fwd[0][1:], bwd[0][1:][::-1]
        e = hf @ p["wf"] + hb @ p["wb"] + p["bias"]
        move = p["move"]
        alpha = np.empty_like(e)
        alpha[0] = e[0]
        for s in range(1, t):
            z = alpha[s - 1][:, :, None] + move
            top = z.max(1)
            alpha[s] = top + np.log(np.exp(z - top[:, None]).sum(1)) + e[s]
        top = alpha[-1].max(1)
        norm = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        beta = np.zeros_like(e)
        d_move = np.zeros_like(move)
        for s in range(t - 2, -1, -1):
            z = move + (beta[s + 1] + e[s + 1])[:, None, :]
            top = z.max(2)
            beta[s] = top + np.log(np.exp(z - top[:, :, None]).sum(2))
            d_move += np.exp(alpha[s][:, :, None] + z - norm[:, None, None]).sum(0)
        de = np.exp(alpha + beta - norm[:, None])
        rows = np.arange(b)
        gold = np.zeros(b)
        for s in range(t):
            gold += e[s, rows, y[s]]
            de[s, rows, y[s]] -= 1
            if s:
                gold += move[y[s - 1], y[s]]
                np.add.at(d_move, (y[s - 1], y[s]), -1)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        de = (de / b).astype(np.float32)
        grad["move"] = (d_move / b).astype(np.float32)
        grad["bias"] = de.sum((0, 1))
        flat = de.reshape(-1, TAGS)
        grad["wf"] = hf.reshape(-1, HIDDEN).T @ flat
        grad["wb"] = hb.reshape(-1, HIDDEN).T @ flat
        self._back(x, "f", *fwd, de @ p["wf"].T, grad)
        self._back(x[::-1], "b", *bwd, (de @ p["wb"].T)[::-1], grad)
        return float((norm - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 180, batch: int = 128, rate: float = 0.02, seed: int = 3):
        """Adam over windows ``x``, ``y`` of shape (N, T)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, len(x)))
            _, grad = self.loss(x[pick].T.copy(), y[pick].T.copy())
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 5.0 / (size + 1e-9))
            lr = rate * min(1.0, 2.0 * (1 - i / (steps + 1)))
            for k, g in grad.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9 ** i)) / (np.sqrt(v[k] / (1 - 0.99 ** i)) + 1e-8)).astype(np.float32)
        return self

    # decoding -----------------------------------------------------------------
    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, TAGS, B) for windows ``x`` of shape (T, B); state-major, so that
        every gate is a contiguous row block."""
        t, b = x.shape
        h = HIDDEN
        out = np.empty((t, TAGS, b), np.float32)
        out[:] = self.p["bias"][:, None]
        for d, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            scale = np.r_[np.full(3 * h, 0.25), np.ones(h)].astype(np.float32)
            shift = np.r_[np.full(3 * h, 0.5), np.zeros(h)].astype(np.float32)
            table = np.ascontiguousarray((self.p["x" + d] * scale + shift).T)
            u = np.ascontiguousarray((self.p["u" + d] * scale).T)
            w = np.ascontiguousarray(self.p["w" + d].T)
            hid, cell = np.zeros((h, b), np.float32), np.zeros((h, b), np.float32)
            a, r = np.empty((4 * h, b), np.float32), np.empty((4 * h, b), np.float32)
            for s in order:
                np.take(table, x[s], axis=1, out=a, mode="clip")
                np.matmul(u, hid, out=r)
                a += r
                gates, cand = a[:3 * h], a[3 * h:]
                np.clip(gates, 0, 1, out=gates)
                np.clip(cand, -1, 1, out=cand)
                cell *= gates[h: 2 * h]
                cand *= gates[:h]
                cell += cand
                np.clip(cell, -1, 1, out=hid)
                hid *= gates[2 * h:]
                out[s] += w @ hid
        return out

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (T, B) by Viterbi."""
        e = self.emissions(x)
        t, _, b = e.shape
        move = self.p["move"]
        back = np.empty((t, TAGS, b), np.uint8)
        best = e[0].copy()
        for s in range(1, t):
            new = np.empty_like(best)
            for j in range(TAGS):
                top, arg = best[0] + move[0, j], np.zeros(b, np.uint8)
                for i in range(1, TAGS):
                    z = best[i] + move[i, j]
                    more = z > top
                    top = np.maximum(top, z)
                    arg[more] = i
                back[s, j] = arg
                new[j] = top + e[s, j]
            best = new
        tags = np.empty((t, b), np.uint8)
        tags[-1] = best.argmax(0)
        cols = np.arange(b)
        for s in range(t - 1, 0, -1):
            tags[s - 1] = back[s, tags[s], cols]
        return tags


def tag_block(model: Tagger, points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A tag for every character of the texts of a block."""
    x = np.append(_inputs(points), np.uint8(PAD))
    step = WINDOW - 2 * MARGIN
    size = np.diff(off)
    count = np.maximum(0, -(-(size - 2 * MARGIN) // step))
    count[(size > 0) & (count == 0)] = 1
    doc = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    tags = np.zeros(len(points), np.uint8)
    lane = np.arange(WINDOW)[:, None]
    for a in range(0, len(doc), 2048):
        d, w = doc[a: a + 2048], k[a: a + 2048]
        start, end = off[d] + w * step, off[d + 1]
        at = start[None, :] + lane
        inside = at < end[None, :]
        got = model.decode(np.where(inside, x[np.minimum(at, len(points))], np.uint8(PAD)))
        # the part that no neighbouring window sees more of
        own = inside & ((lane >= MARGIN) | (w == 0)) & ((lane < WINDOW - MARGIN) | (w == count[d] - 1))
        tags[at[own]] = got[own]
    return tags


_RUN = [re.compile(r"[^\s<>()\[\]{},;:\"']+"), re.compile(r"[0-9.]+"), re.compile(r"[0-9](?:[0-9 -]*[0-9])?"),
        re.compile(r"(?:\+|00)[0-9 ().\-/]*[0-9]")]
_MAIL = re.compile(r"[^\s@]+@[^\s@.]+(?:\.[^\s@.]+)*\.[^\W\d_]{2,}")
_GROUP = re.compile(r"[0-9]+")


def confirmed(kind: int, text: str, b: int, e: int) -> list[tuple[int, int]]:
    """What a run of the network stands for: the whole addresses or numbers
    that it touches.  The run is widened to its surroundings of the kind's
    characters, which must not go on into a word, and must hold: an address
    with a name and a domain; four parts of at most 255; groups of 16 to 19
    digits that pass the check sum (cards side by side are cut at separators);
    an international number of 8 to 15 digits."""
    lo, hi = max(0, b - 80), min(len(text), e + 80)
    for m in _RUN[kind].finditer(text, lo, hi):
        x, y = m.start(), m.end()
        if y <= b:
            continue
        if x >= e:
            break
        if x == lo > 0 or y == hi < len(text):             # longer than any such thing
            return []
        if kind == 0:
            while y > x and text[y - 1] in ".!?":
                y -= 1
            return [(x, y)] if _MAIL.fullmatch(text, x, y) else []
        if (x and (text[x - 1].isalnum() or text[x - 1] == "_")) or (y < len(text) and (text[y].isalnum() or text[y] == "_")):
            return []
        if kind == 1:
            parts = text[x:y].strip(".").split(".")
            return [(x, y)] if len(parts) == 4 and all(q.isdigit() and int(q) <= 255 for q in parts) and text[y - 1] != "." else []
        if kind == 3:
            return [(x, y)] if 8 <= len(_DIGITS.sub("", text[x:y])) <= 15 else []
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, x, y)]
        out, i = [], 0
        while i < len(groups):                             # leftmost cards, each the shortest run of groups
            for j in range(i, len(groups)):
                digits = "".join(text[s:f] for s, f in groups[i: j + 1])
                if len(digits) > 19:
                    break
                if len(digits) >= 16 and luhn(digits):
                    out.append((groups[i][0], groups[j][1]))
                    i = j
                    break
            i += 1
        return [s for s in out if s[0] < e and s[1] > b]
    return []


def find_spans(model: Tagger | None, texts: list[str | None]) -> list[tuple[list, list]]:
    """``(base, added)`` spans of each text.  Added ones are what the network's
    runs stand for (``confirmed``) where they touch no base span."""
    points, off = code_points(texts)
    digit = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum((points >= 48) & (points <= 57), out=digit[1:])
    tags = tag_block(model, points, off) if model else np.zeros(len(points), np.uint8)
    edge = np.zeros(len(points) + 1, dtype=bool)
    edge[off] = True
    edge[1:-1] |= tags[1:] != tags[:-1]
    cut = np.flatnonzero(edge)
    run = cut[:-1][tags[cut[:-1]] > 0] if len(points) else cut[:0]
    stop = cut[np.searchsorted(cut, run) + 1] if len(run) else run
    doc = np.searchsorted(off, run, side="right") - 1
    out = []
    of = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, t in enumerate(texts):
        t = t or ""
        base = base_spans(t, bool(digit[off[i + 1]] > digit[off[i]])) if t else []
        added = []
        for r in range(of[i], of[i + 1]):
            b, e, kind = int(run[r] - off[i]), int(stop[r] - off[i]), int(tags[run[r]]) - 1
            while b < e and t[b].isspace():
                b += 1
            while e > b and t[e - 1].isspace():
                e -= 1
            for x, y in confirmed(kind, t, b, e) if e > b else ():
                if all(y <= p or x >= q for _, p, q in base + added):
                    added.append((kind, x, y))
        out.append((base, added))
    return out


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _drawn(spans: list[tuple[int, int, int]], rng) -> list[tuple[int, int, int]]:
    """At most WINDOWS_PER_DOC spans, drawn evenly over the kinds and, within a
    kind, over the whole text."""
    turn: dict[int, int] = {}
    order = []
    for i in rng.permutation(len(spans)).tolist():
        kind = spans[i][0]
        turn[kind] = turn.get(kind, -1) + 1
        order.append((turn[kind], kind, i))
    return [spans[i] for _, _, i in sorted(order)[:WINDOWS_PER_DOC]]


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around labelled spans, and as many without any in the middle."""
    for batch in batches:
        text, label = [], []
        for t in batch.column("text").to_pylist():
            if not t:
                continue
            spans = base_spans(t)
            tags = np.zeros(len(t), np.uint8)
            for k, a, b in spans:
                tags[a:b] = k + 1
            rng = np.random.default_rng(len(t))
            middles = [(a + b) // 2 for _, a, b in _drawn(spans, rng)]
            middles += [int(m) for m in rng.integers(0, len(t), 1)]
            for m in middles:
                a = max(0, m - int(rng.integers(TRAIN_WINDOW // 4, 3 * TRAIN_WINDOW // 4)))
                text.append(t[a: a + TRAIN_WINDOW])
                label.append(tags[a: a + TRAIN_WINDOW].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(label, pa.binary())], ["text", "tags"])


def fit_tagger(docs: DataFrame, limit: int = SAMPLE_DOCS) -> Tagger | None:
    """A tagger trained on the patterns' spans in at most ``limit`` documents
    (those of the smallest key hashes); None where they hold no span."""
    ids = labelled_sample(docs.select("doc_id").withColumn("one", F.lit(1)), "one", limit).select("doc_id")
    sample = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = sample.select("text").mapInArrow(_training_windows, "text string, tags binary").collect()
    rows = sorted((r["text"], bytes(r["tags"])) for r in rows)
    if not any(any(t) for _, t in rows):
        return None
    x = np.full((len(rows), TRAIN_WINDOW), PAD, np.uint8)
    y = np.zeros((len(rows), TRAIN_WINDOW), np.uint8)
    for i, (t, tags) in enumerate(rows):
        x[i, : len(t)] = _inputs(code_points([t])[0])
        y[i, : len(tags)] = np.frombuffer(tags, np.uint8)
    # half of what is trained on holds spans
    has = y.any(1)
    rng = np.random.default_rng(9)
    some = np.r_[np.flatnonzero(has), rng.permutation(np.flatnonzero(~has))[: max(200, int(has.sum()))]]
    return Tagger().fit(x[some], y[some])


def personal_data(docs: DataFrame, text: str = "text", key: str = "doc_id", redact: bool = False,
                  carry: list[str] | None = None) -> DataFrame:
    """Per row: ``doc_id``, counts of base spans by kind, ``base_sha256`` of
    the base spans, ``spans`` (all), ``n_added``; with ``redact`` also the
    ``text`` with every span replaced by ``[kind]``.

    Null and empty texts have no spans (a null stays null when redacted).  A
    null key keeps its row; repeated rows get equal rows.  No labelled span
    anywhere: the patterns work alone.  ``carry`` keeps further columns.
    """
    carry = carry or []
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *carry)
    model = shipped(docs.sparkSession, fit_tagger(rows.select("doc_id", "text")))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"] + ["text"] * redact + carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model()
        for batch in batches:
            for b in blocks(batch, "text", BLOCK_BYTES):
                texts = b.column("text").to_pylist()
                got = find_spans(tagger, texts)
                cols = [b.column("doc_id")]
                for k in range(len(KINDS)):
                    cols.append(pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()))
                cols.append(pa.array([hashlib.sha256(span_text(base).encode()).hexdigest() for base, _ in got], pa.string()))
                cols.append(pa.array([span_text(base + added) for base, added in got], pa.string()))
                cols.append(pa.array([len(added) for _, added in got], pa.int64()))
                if redact:
                    cols.append(pa.array([t if t is None else redacted(t, base + added) for t, (base, added) in zip(texts, got)],
                                         pa.string()))
                cols += [b.column(c) for c in carry]
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = [f"doc_id {kinds['doc_id']}", *(f"n_{k} bigint" for k in KINDS), "base_sha256 string", "spans string", "n_added bigint"]
    schema += ["text string"] * redact + [f"`{c}` {kinds[c]}" for c in carry]
    return rows.mapInArrow(run, ", ".join(schema))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by ``[kind]``; overlapping ones by their union's first
    kind.  Spans that come to light by that (a telephone number that ran into
    an address) are replaced as well."""
    while spans:
        out, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"[{KINDS[kind]}]"]
            at = max(at, b)
        text = "".join(out) + text[at:]
        spans = base_spans(text)
    return text
