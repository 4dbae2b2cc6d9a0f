"""SentencePiece BPE encoding without a merge queue, and decoding.

A text is marked up (a space in front, spaces as ``▁``) and cut wherever the
two characters beside a place stand together in no piece: no merge can cross
such a place, so the units between cuts are encoded each by itself, and units
seen before are looked up.  Within a unit the encoding is found by
backtracking: an Aho-Corasick pass gives the longest piece that starts at each
character; the longest one is tried first, then the shorter ones; a piece is
taken only if it is compatible with the one before, that is if merging the
characters of both again ends in just these two.  Positions from which no way
leads on are marked in a bitfield and not tried again.  A sequence whose
neighbours are all compatible is the one that merging gives, so the result is
exact for texts of any length.

Pieces of equal score are merged leftmost first, as in the library.  Characters
that no piece covers become their UTF-8 bytes.  A null text is empty; an empty
text has no ids.  Rows are never joined, so repeated rows, ids and extra
columns of any name are kept as they are.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import per_process
from quarry.llm.words import blocks

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Units, and pairs, of a generation remembered by a Python worker (two are
#: held; what is used again moves to the young one).
REMEMBERED = 200_000
#: Longer units are not remembered.
LONG_UNIT = 64
#: Characters of a text marked up and cut at a time.
SLICE = 1 << 20


def load_pieces(path: str) -> tuple[list[str], list[float], list[int]]:
    """``(pieces, scores, kinds)`` of a BPE model file: a few 10,000 entries,
    read on the driver and sent to the workers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    pieces = [model.id_to_piece(i) for i in ids]
    kinds = [BYTE if model.is_byte(i) else UNKNOWN if model.is_unknown(i) else 3 if model.is_control(i) else 5 if model.is_unused(i) else NORMAL
             for i in ids]
    if kinds.count(BYTE) != 256:
        raise ValueError("pieces: the model has no byte fallback")
    probe = "Aﬁ  éé\t"
    if model.normalize(probe) != (SPACE + probe).replace(" ", SPACE):
        raise ValueError("pieces: the model changes texts other than by marking spaces")
    return pieces, [model.get_score(i) for i in ids], kinds


class Vocabulary:
    """Lookup tables over the pieces, made once per worker.

    ``parts`` are what a unit can be made of: the pieces that merging their own
    characters gives (others never come out of it), and the characters that are
    no piece by themselves, which stand for their bytes."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int]):
        import ahocorasick

        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.score = {p: scores[i] for p, i in ids.items() if len(p) > 1}
        byte_ids = [i for _, i in sorted((int(p[3:5], 16), i) for i, (p, k) in enumerate(zip(pieces, kinds)) if k == BYTE)]
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN
                    else p.replace(SPACE, " ").encode() if k in (NORMAL, 5) else b"" for p, k in zip(pieces, kinds)]
        self.marked = {i for p, i in ids.items() if p.startswith(SPACE)}
        self.fallback = lambda char: array("i", [byte_ids[b] for b in char.encode()]).tobytes()
        single = {c for p in ids for c in p}
        self.parts = sorted(single | {p for p in ids if len(p) > 1 and len(self.merged(p)) == 1})
        number = {p: i for i, p in enumerate(self.parts)}
        self.lengths = [len(p) for p in self.parts]
        self.part_ids = [array("i", [ids[p]]).tobytes() if p in ids else self.fallback(p) for p in self.parts]
        #: The longest part that a part begins with, but for itself (-1: none).
        self.shorter = [next((number[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in number), -1) for p in self.parts]
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.parts):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        # neighbours inside a piece; a class per character, 0 for all others
        pairs = {p[i: i + 2] for p in ids for i in range(len(p) - 1)}
        chars = sorted({c for pair in pairs for c in pair})
        self.kind = np.zeros(max(map(ord, chars), default=0) + 2, dtype=np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for x, y in pairs:
            self.joined[self.kind[ord(x)], self.kind[ord(y)]] = True
        self.units: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.older_units, self.older_pairs = {}, {}

    def merged(self, text: str, border: int = 0) -> list[str] | None:
        """The characters of ``text`` merged by score, then leftmost; None as
        soon as a merge crosses ``border`` (a number of characters)."""
        now = list(text)
        score, none = self.score.get, float("-inf")
        gain = [score(x + y, none) for x, y in zip(now, now[1:])]
        while gain:
            best = max(gain)
            if best == none:
                break
            at = gain.index(best)
            if border:
                if at == border - 1:
                    return None
                border -= at < border
            now[at: at + 2] = [now[at] + now[at + 1]]
            del gain[at]
            if at:
                gain[at - 1] = score(now[at - 1] + now[at], none)
            if at < len(gain):
                gain[at] = score(now[at] + now[at + 1], none)
        return now

    def compatible(self, a: int, b: int) -> bool:
        """Does merging the characters of both parts again end in just these?"""
        key = a * len(self.parts) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs, self.older_pairs = {}, self.pairs
            known = self.older_pairs.get(key)
            if known is None:
                known = self.merged(self.parts[a] + self.parts[b], self.lengths[a]) is not None
            self.pairs[key] = known
        return known

    def split(self, unit: str) -> list[int]:
        """The unit's parts, by backtracking.  Every character is a part."""
        n, lengths, compatible = len(unit), self.lengths, self.compatible
        longest = array("i", bytes(4 * n))
        for end, part in self.automaton.iter(unit):      # of equal starts the longest comes last
            longest[end - lengths[part] + 1] = part
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, part, last = 0, longest[0], -1
        while True:
            end = at + lengths[part]
            if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or compatible(last, part)):
                out.append(part)
                if end == n:
                    return out
                at, last, part = end, part, longest[end]
                continue
            part = self.shorter[part]
            if part < 0:                                  # nothing starts here: the part before has to be shorter
                failed[at >> 3] |= 1 << (at & 7)
                part = out.pop()
                at -= lengths[part]
                last = out[-1] if out else -1

    def unit_ids(self, unit: str) -> bytes:
        """The unit's ids as 32-bit integers."""
        if len(unit) == 1 and unit not in self.automaton:
            return self.fallback(unit)
        return b"".join([self.part_ids[p] for p in self.split(unit)])

    def cut(self, text: str) -> Iterator[list[str]]:
        """The units of a text, a slice at a time; a slice's last unit goes on
        in the next."""
        rest = SPACE
        for lo in range(0, len(text), SLICE):
            marked = rest + text[lo: lo + SLICE].replace(" ", SPACE)
            points = np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32)
            kind = self.kind[np.minimum(points, len(self.kind) - 1)]
            cuts = [0, *(np.flatnonzero(~self.joined[kind[:-1], kind[1:]]) + 1).tolist(), len(marked)]
            if lo + SLICE < len(text):
                rest = marked[cuts[-2]:]
                cuts.pop()
            yield [marked[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        out = []
        for units in self.cut(text):
            got = list(map(self.units.get, units))
            for i in [i for i, ids in enumerate(got) if ids is None]:
                unit = units[i]
                got[i] = self.units.get(unit) or self.older_units.get(unit) or self.unit_ids(unit)
                if len(unit) <= LONG_UNIT:
                    if len(self.units) >= REMEMBERED:
                        self.units, self.older_units = {}, self.units
                    self.units[unit] = got[i]
            out.append(b"".join(got))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, the space that marked the start
        dropped, bytes read as UTF-8 with U+FFFD for each that fits no character."""
        raw = self.raw
        data = b"".join([raw[i] for i in ids])
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = _lenient(data)
        first = next((i for i in ids if raw[i]), None)
        return text[1:] if first in self.marked else text


def _lenient(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at: at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def shared_vocabulary(spark: SparkSession, model: str) -> Callable[[], Vocabulary]:
    """A function that gives the vocabulary inside a task, made once per worker."""
    entries = load_pieces(model)
    shared, key = spark.sparkContext.broadcast(entries), hashlib.sha256(repr(entries).encode()).hexdigest()
    return lambda: per_process(("pieces", key), lambda: Vocabulary(*shared.value))


def encode_pieces(docs: DataFrame, model: str, keep: list[str], text: str = "text", ids: str = "ids") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the ids of ``text`` under the BPE
    model file ``model`` (a path on the driver)."""
    worker = shared_vocabulary(docs.sparkSession, model)
    kinds = docs.select(keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker()
        for batch in batches:
            for b in blocks(batch, "_text"):
                got = [vocabulary.encode(t or "") for t in b.column("_text").to_pylist()]
                offsets = np.zeros(len(got) + 1, dtype=np.int32)
                np.cumsum([len(g) for g in got], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got)))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], lists], [*keep, ids])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), f"`{ids}` array<int>"])
    return docs.select(docs[text].alias("_text"), *keep).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids`` (null ids: empty)."""
    worker = shared_vocabulary(encoded.sparkSession, model)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker()
        for b in batches:
            texts = [vocabulary.decode(i.values.to_numpy().tolist() if i.is_valid else []) for i in b.column(ids)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, text])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), f"`{text}` string"])
    return encoded.mapInArrow(run, schema)
