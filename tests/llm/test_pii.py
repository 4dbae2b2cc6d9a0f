import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import pii
from quarry.llm.decontam import code_points
from quarry.llm.pii import PAD, TRAIN_WINDOW, Tagger, base_spans, confirmed, find_spans, luhn, personal_data, redacted, tag_block

STATED = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", " -"), r"\+[0-9][\x20().0-9-]+[0-9]"]


def stated(text):
    out = []
    for k, p in enumerate(STATED):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split("."))
                    or k == 2 and 16 <= len(d) <= 19 and luhn(d) or k == 3 and 8 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a1.@- +(é\n", max_size=40), st.text(alphabet="0123456789.-+ ", max_size=60)))
def test_patterns(text):
    assert base_spans(text) == stated(text)


def test_patterns_on_known_spans():
    card = "4539 1488 0343 6467"
    text = f"é a.b+c@x-y.co.uk. 10.0.0.255 999.1.1.1 card {card} +49 (0) 89-1234567 x@y 00001.2.3.4.5.6.7.8 " + "1" * 30_000 + "a" * 30_000
    assert base_spans(text) == stated(text)
    assert {text[a:b] for _, a, b in base_spans(text)} >= {"a.b+c@x-y.co.uk", "10.0.0.255", card, "+49 (0) 89-1234567"}
    assert redacted("mail a@b.cd now", [(0, 5, 11)]) == "mail [email] now"


def corpus(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 8)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(rnd.randint(5, 60))]
        for _ in range(rnd.randint(0, 3)):
            w.insert(rnd.randrange(len(w)), rnd.choice([
                lambda: f"{word()}@{word()}.com", lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
                lambda: "+" + "".join(rnd.choice("0123456789") for _ in range(11))])())
        out.append(" ".join(w))
    return out


def test_network_learns_the_labelled_spans():
    x, y = [], []
    for t in corpus(500, 1):
        tags = np.zeros(len(t), np.uint8)
        for k, a, b in base_spans(t):
            tags[a:b] = k + 1
        row, lab = np.full(TRAIN_WINDOW, PAD, np.uint8), np.zeros(TRAIN_WINDOW, np.uint8)
        row[: len(t)] = pii._inputs(code_points([t[:TRAIN_WINDOW]])[0])
        lab[: len(t)] = tags[:TRAIN_WINDOW]
        x.append(row)
        y.append(lab)
    model = Tagger().fit(np.array(x), np.array(y), steps=100)
    texts = [" ".join(corpus(12, 2)), None, "", "a", " ".join(corpus(30, 3))]          # many windows, and odd texts
    points, off = code_points(texts)
    gold = np.zeros(len(points), np.uint8)
    for i, t in enumerate(texts):
        for k, a, b in base_spans(t or ""):
            gold[off[i] + a: off[i] + b] = k + 1
    tags = tag_block(model, points, off)
    assert (tags[gold > 0] == gold[gold > 0]).mean() > 0.85          # labels held out of training
    assert (tags[tags > 0] == gold[tags > 0]).mean() > 0.85
    # a text is tagged alike alone and inside a block
    alone = tag_block(model, points[off[4]:off[5]], off[4:6] - off[4])
    assert (alone == tags[off[4]:off[5]]).all()
    for (base, added), t in zip(find_spans(model, texts), texts):
        assert base == base_spans(t or "")
        assert all(e <= a or b >= f for _, a, f in base for _, b, e in added)


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(corpus(60, 4))] + [(None, None), (None, ""), (3, "x y"), (3, "x y")]
    docs = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, spans string")
    out = personal_data(docs, redact=True).collect()
    assert len(out) == len(rows)
    assert sum(r["text"] is None for r in out) == 1
    assert not any(base_spans(r["text"] or "") for r in out)
    assert personal_data(docs.limit(0)).count() == 0


def test_runs_stand_for_whole_things():
    """What the network's run touches is widened, or refused."""
    card = "4539 1488 0343 6467"
    assert luhn(card.replace(" ", ""))

    def at(kind, text, part):
        b = text.index(part)
        return [text[x:y] for x, y in confirmed(kind, text, b, b + len(part))]
    both = f"pay {card} {card} now"
    assert base_spans(both) == [] and at(2, both, "6467 4539") == [card, card] and at(2, both, "pay 4539") == [card]
    assert at(2, both, both[4:-4]) == [card, card]
    assert at(2, "id 4539148803436468 x", "91488") == []                      # fails the check sum
    assert at(2, "id 453914880343646 x", "91488") == []                       # too short
    assert at(2, "hex 148e6160f674b4be45601 x", "6160") == at(3, "hex 0433955f x", "0433955") == []
    assert at(2, f"ref{card} x", "1488") == [] and at(2, "1" * 400, "111") == []
    assert at(0, "to jörg@exämple.de.", "exämple") == ["jörg@exämple.de"] and at(0, "a @ b", "@") == []
    assert at(1, "at 10.0.0.256 or", "0.0") == at(1, "v1.2.3.4", "2.3") == [] and at(1, "at 10.0.0.25 or", "0.0") == ["10.0.0.25"]
    assert at(3, "call +49/30/1234567 or", "30") == ["+49/30/1234567"] and at(3, "on 2024-01-05", "01") == []


def test_training_draws_over_kinds_and_the_whole_text():
    spans = [(0, 10 * i, 10 * i + 5) for i in range(50)] + [(3, 1000 + 20 * i, 1010 + 20 * i) for i in range(4)] + [(1, 2000, 2008)]
    drawn = pii._drawn(spans, np.random.default_rng(0))
    assert len(drawn) == pii.WINDOWS_PER_DOC and {k for k, _, _ in drawn} == {0, 1, 3}
    late = [pii._drawn(spans, np.random.default_rng(s)) for s in range(40)]
    assert {s for d in late for s in d if s[0] == 0} > set(spans[:6])


def test_crf_sum_gradient_and_best_path_by_enumeration():
    from itertools import product

    from quarry.llm.pii import INPUTS, TAGS

    rng = np.random.default_rng(1)
    model = Tagger(seed=8)
    model.p["move"] = rng.normal(0, 1, (TAGS, TAGS)).astype(np.float32)
    model.p["bias"] = rng.normal(0, 1, TAGS).astype(np.float32)
    x, y = rng.integers(0, INPUTS, (5, 3)), rng.integers(0, TAGS, (5, 3))
    e = model.emissions(x.astype(np.uint8)).astype(np.float64)                 # (T, TAGS, B)
    move = model.p["move"].astype(np.float64)

    def score(path, b):
        return sum(e[s, k, b] for s, k in enumerate(path)) + sum(move[i, j] for i, j in zip(path, path[1:]))
    every = list(product(range(TAGS), repeat=5))
    best = model.decode(x.astype(np.uint8))
    nll = 0.0
    for b in range(3):
        z = np.array([score(p, b) for p in every])
        assert tuple(best[:, b]) == every[int(z.argmax())]
        nll += (np.log(np.exp(z - z.max()).sum()) + z.max() - score(y[:, b], b)) / 3
    loss, grad = model.loss(x, y)
    assert abs(loss - nll) < 1e-4
    for name in ("move", "bias"):
        flat = model.p[name].reshape(-1)
        for j in range(0, flat.size, 3):
            old = flat[j]
            flat[j] = old + 0.01
            up = model.loss(x, y)[0]
            flat[j] = old - 0.01
            down = model.loss(x, y)[0]
            flat[j] = old
            assert abs((up - down) / 0.02 - grad[name].reshape(-1)[j]) < 2e-3, name
