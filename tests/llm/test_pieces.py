"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from quarry.llm import pieces
from quarry.llm.pieces import Vocabulary, decode_pieces, encode_pieces, load_pieces
from quarry.llm.queries import piece_digests

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "a", "▁", "a▁ b", "\U0001F600", "<s> </s> <unk> <0x41>", "é", "﻿x", "\x01", "\x00", "￿",
       "a" * 5000, " " * 1000, "ab" * 3000, "=-" * 500, "́" * 9, "x   y", "tab\tand\r\nline"]


@pytest.fixture(scope="module")
def both():
    return Vocabulary(*load_pieces(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rnd = random.Random(5)
    known = [p.replace("▁", " ") for p in load_pieces(MODEL)[0][259:]]
    for _ in range(3000):
        yield "".join(rnd.choice(" a▁bet\n") for _ in range(rnd.randrange(60)))
        yield "".join(rnd.choice(known)[: rnd.randrange(1, 9)] for _ in range(rnd.randrange(20)))
        yield "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 1280), rnd.randrange(0x4E00, 0x9000),
                                      rnd.randrange(0x1F300, 0x1F700), rnd.randrange(32)])) for _ in range(rnd.randrange(40)))
        yield " " * rnd.randrange(60) + "x" + " " * rnd.randrange(40) + rnd.choice(["the", "\n", "é"]) + " " * rnd.randrange(40)
        yield "".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(200)))


def test_ids_and_texts_are_the_library_s(both):
    mine, library = both
    for t in [*ODD, *texts()]:
        ids = library.encode(t)
        assert mine.encode(t).tolist() == ids, t
        assert mine.decode(ids) == library.decode(ids), t


def test_slices_of_a_text_make_no_difference(both, monkeypatch):
    mine, library = both
    monkeypatch.setattr(pieces, "SLICE", 3)
    for t in [*ODD[:-6], *list(texts())[:500]]:
        assert mine.encode(t).tolist() == library.encode(t), t


@pytest.mark.parametrize("ids", [[229], [229, 133], [0, 1, 2, 300], [28705], [259], [1, 264], [264, 1, 264], [229, 264], [35, 264],
                                 [198, 172], [0, 264], [229, 133, 175, 28705], []])
def test_decoding_of_any_ids(both, ids):
    assert both[0].decode(ids) == both[1].decode(ids)


def test_backtracking_finds_what_merging_gives():
    """A small vocabulary where the longest piece first is wrong, and where a
    piece's own characters merge otherwise."""
    listed = ["ab", "bc", "abc", "cd", "bcd", "aa", "aab", "ca", "dab"]
    every = ["<unk>", *[f"<0x{i:02X}>" for i in range(256)], *listed, *"abcd", "▁"]
    kinds = [2, *[6] * 256, *[1] * (len(listed) + 5)]
    mine = Vocabulary(every, [-float(i) for i in range(len(every))], kinds)
    rnd = random.Random(2)
    for _ in range(3000):
        t = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 30)))
        assert [mine.parts[p] for p in mine.split(t)] == mine.merged(t), t


def test_frames(spark, both):
    library = both[1]
    rows = [(i, t, f"extra {i}") for i, t in enumerate(ODD)] + [(None, None, None), (3, ODD[8], "again"), (3, ODD[8], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = piece_digests(df, MODEL).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert piece_digests(df.limit(0), MODEL).count() == 0
    back = decode_pieces(encode_pieces(df, MODEL, ["doc_id", "text"]), MODEL).where("doc_id = 8").first()
    assert back["decoded"] == back["text"] == ODD[8]
