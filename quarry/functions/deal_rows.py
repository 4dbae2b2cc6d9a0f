"""Deal messages read one by one, as worker-side functions of Arrow batches.

A message's fields depend on the order of its lines (first row of a header,
lines up to the next label), which Spark's array lambdas express only by
interpreting an expression per line, field and cell.  Here each message is
walked once in plain Python, whose ``str`` methods are the reference's own
rules (``splitlines``, ``strip``, ``split``), and a batch's values leave as
flat Arrow columns.

The functions are pickled by value, so executors need no installed copy of
the package.
"""

from __future__ import annotations

import datetime
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ``functions.patterns.CELL_SEP``: in Python ``\s`` is every ``str.isspace`` character.
_SEP = re.compile(r"\t+|\s{2,}")
_WIDE = re.compile(r"\s{2,}")
_TENOR_NC = re.compile(r"([0-9]+)\s*[nN][cC]\s*([0-9]+)")
_ISO_DATE = re.compile(r"[0-9]{4}-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])")
_TENOR_LINE = re.compile(r"Tenor\s+(.+?)\n")
#: The same whitespace where a pattern ignores case, of ASCII letters only.
_WS_ASCII = "[" + re.escape("".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())) + "]"
_INT_MAX = 2**31 - 1
#: Entries of a batch's memo of headers, dates or tenors.
_MEMO = 10_000


def _texts(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _memo(fn):
    kept = {}

    def get(x):
        if x in kept:
            return kept[x]
        if len(kept) >= _MEMO:
            kept.clear()
        kept[x] = out = fn(x)
        return out
    return get


def _lists(counts: list[int | None], columns: list[list], kinds: list[pa.Field]) -> pa.Array:
    """``array<struct>`` from flat columns and the rows of each message (None: a null list)."""
    at, offsets = 0, [0]
    for n in counts:
        at += n or 0
        offsets.append(at)
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], fields=kinds)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, mask=pa.array([n is None for n in counts]))


def plain(line: str) -> bool:
    """Does a stripped line hold no run of two whitespace characters, so that
    only single tabs separate its cells and none has whitespace around it?"""
    if line.isascii():
        return not ("\t\t" in line or "  " in line or " \t" in line or "\t " in line or "\x1f" in line)
    words = line.split()
    return len(line) - len("".join(words)) == len(words) - 1


def cells_of(line: str) -> list[str]:
    """Cells of a stripped line."""
    return line.split("\t") if plain(line) else _SEP.split(line)


def cleaned(cell: str) -> str | None:
    """``functions.deal.clean_cell``."""
    x = cell.strip("*").strip()
    if x.endswith(")"):
        at = x.find("(")
        if at >= 0:
            x = x[:at].strip()
    return x or None


def values_of(line: str, n: int) -> list[str | None]:
    """The first ``n`` cleaned cells behind a line's header."""
    if plain(line):
        cells = line.split("\t", n + 1)[1:n + 1]
        # nothing to strip, and none is empty
        return cells if "*" not in line and ")" not in line else [cleaned(c) for c in cells]
    return [cleaned(c) for c in _SEP.split(line)[1:n + 1]]


def _days(x: str | None) -> int | None:
    """``functions.deal._iso_date``, as a day number."""
    if x is None or not _ISO_DATE.fullmatch(x):
        return None
    y, m, d = x.replace(" ", "").split("-")
    try:
        return datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None


def _decoded(tenor: str | None) -> tuple[int | None, int | None]:
    """``functions.deal.decode_tenor``."""
    m = _TENOR_NC.search(tenor) if tenor else None
    if m is None:
        return None, None
    digits = [g.lstrip("0") or "0" for g in m.groups()]
    return tuple(int(g) if len(g) <= 10 and int(g) <= _INT_MAX else None for g in digits)


def stripped_lines(text: str) -> list[str]:
    return [s for s in map(str.strip, text.splitlines()) if s]


def message_reader(synonyms: dict[str, str], terms: list[str]):
    """Reader of the table and block layout: ``read(text)`` gives the lines,
    the first line of each header key, the first line of each label key, the
    terminators and the number of tranches."""
    terms, tenor_key = set(terms), synonyms.get("tenor", "tenor").lower()

    def label_key(c: str) -> str:
        k = c.lower().replace(":", "").strip()
        return synonyms[k].lower() if k in synonyms else k

    def head_key(head: str) -> tuple[str, bool]:
        """Header key of the text before the first tab, and whether that is one cell."""
        head = head.rstrip()
        wide = _WIDE.search(head)
        return label_key(head[:wide.start()] if wide else head), wide is None
    head_keys: dict[str, tuple[str, bool]] = {}

    def read(text: str):
        lines, headers, labels, stops, n = stripped_lines(text), {}, {}, [], None
        for i, line in enumerate(lines):
            head, tab, rest = line.partition("\t")
            known = head_keys.get(head)
            if known is None:
                if len(head_keys) >= _MEMO:
                    head_keys.clear()
                known = head_keys[head] = head_key(head)
            key, one = known
            if key not in headers:
                headers[key] = i
            if n is None and key == tenor_key and (tab or not one):
                n = len(cells_of(line)) - 1
            if tab or not one:
                # several cells are a label only if the second is colons
                if one and not (rest[0] == ":" or rest[0].isspace()):
                    continue
                if cells_of(line)[1].replace(":", "").strip():
                    continue
                key = label_key(line)
            if key not in labels:
                labels[key] = i
            if key in terms:
                stops.append(i)

        def block(field: str) -> list[str]:
            at = labels.get(field)
            if at is None:
                return []
            return lines[at + 1: next((s for s in stops if s > at), len(lines))]
        return lines, headers, block, n or len(block(tenor_key)) or 1
    return read


def rated(block: str, n: int) -> list[list[tuple[str, str]]]:
    """Ratings of each tranche: each non-blank line ``agency: rating`` of the
    ratings block goes to tranche ``i % n`` (``i`` counts all non-blank lines);
    a repeated agency keeps its first position and its last rating."""
    out = [{} for _ in range(n)]
    for i, line in enumerate(stripped_lines(block)):
        agency, colon, rating = line.partition(":")
        if colon:
            out[i % n][agency.strip()] = rating.strip()
    return [list(r.items()) for r in out]


def table_tranches(kinds: list[pa.Field], tabular: dict[str, str], blocks: dict[str, str], synonyms: dict[str, str],
                   terms: list[str], ratings_label: str, infer: bool):
    """Worker function: texts -> ``array<struct>`` of tranches with the columns
    ``kinds``.  ``tabular`` and ``blocks`` name each column's field key.
    ``infer``: a missing tenor is taken from ISO issue and maturity dates."""
    # from the label to the first line starting ``Word:``, a blank line or the end
    ratings = re.compile(rf"{re.escape(ratings_label)}{_WS_ASCII}+([\s\S]+?)(?:\n[A-Z][a-zA-Z /]+:|\n\n|$)", re.I | re.A)
    mark = ratings_label.lower()

    def run(column: pa.Array) -> pa.Array:
        read, days, decode = message_reader(synonyms, terms), _memo(_days), _memo(_decoded)
        out, counts, names = {f.name: [] for f in kinds}, [], []
        for text in _texts(column):
            if text is None:
                # no text: one tranche without values
                counts.append(1)
                for col, values in out.items():
                    values.append("Tranche 1" if col == "tranche" else None)
                continue
            lines, headers, block, n = read(text)
            counts.append(n)
            names.extend(f"Tranche {i + 1}" for i in range(len(names), n))
            fields, missing = dict.fromkeys(out, [None] * n), {}
            for col, key in tabular.items():
                if key in headers:
                    fields[col] = values_of(lines[headers[key]], n)
            for col, key in blocks.items():
                if values := block(key):
                    fields[col] = values[:n]
            for col, values in fields.items():
                if len(values) < n:
                    missing[col] = values + [None] * (n - len(values))
            fields |= missing
            if infer:
                tenors = fields["tenor"]
                if None in tenors:
                    dates = zip(map(days, fields.get("issue_date", [None] * n)), map(days, fields["maturity_date"]), strict=True)
                    fields["tenor"] = tenors = [t if t is not None or a is None or b is None else f"{(b - a) // 365}Y"
                                                for t, (a, b) in zip(tenors, dates, strict=True)]
                fields["tenor_maturity_years"], fields["tenor_non_call_years"] = zip(*map(decode, tenors), strict=True)
            fields["tranche"] = names[:n]
            m = ratings.search(text) if mark in text.lower() else None
            fields["expected_ratings"] = rated(m[1], n) if m else [()] * n
            for col, values in out.items():
                values.extend(fields[col])
        return _lists(counts, list(out.values()), kinds)
    return run


def block_lines(field: str, synonyms: dict[str, str], terms: list[str], kinds: pa.StructType):
    """Worker function: texts -> struct of ``n`` (tranches) and ``lines`` (of the block ``field``)."""
    def run(column: pa.Array) -> pa.Array:
        read, ns, lines = message_reader(synonyms, terms), [], []
        for text in _texts(column):
            _, _, block, n = read(text or "")
            ns.append(n)
            lines.append(block(field))
        return pa.StructArray.from_arrays([pa.array(ns, kinds[0].type), pa.array(lines, kinds[1].type)], fields=list(kinds))
    return run


def after_label(label: str, tail: str):
    """``search(text)`` of a label (a regex) and what follows it.  A label
    without special characters is found as plain text first."""
    whole, rest = re.compile(label + tail), re.compile(tail)
    if re.search(r"[^\w ]", label):
        return whole.search

    def search(text: str) -> re.Match | None:
        at = text.find(label)
        while at >= 0:
            if m := rest.match(text, at + len(label)):
                return m
            at = text.find(label, at + 1)
        return None
    return search


def line_group_tranches(kinds: list[pa.Field], fields: dict[str, str], label: str | None, terms: list[str] | None):
    """Worker function of the draft's line groups: texts -> ``array<struct>``,
    null without a ``Tenor`` line.  ``fields`` gives each column's label (a
    regex, case-sensitive, matched anywhere); its values are up to as many
    consecutive non-empty lines as there are tenors, from the first match on."""
    def run(column: pa.Array) -> pa.Array:
        # the lines are counted in the pattern, so no more of them is read
        groups = _memo(lambda n: [(col, after_label(lab, rf"\s+([^\n]+(?:\n[^\n]+){{0,{n - 1}}})")) for col, lab in fields.items()])
        out, counts = {f.name: [] for f in kinds}, []
        for text in _texts(column):
            m = _TENOR_LINE.search(text) if text is not None else None
            tenors = None if m is None else m[1].split()
            counts.append(None if tenors is None else len(tenors))
            if not tenors:
                continue
            n = len(tenors)
            out["tranche_no"].extend(range(1, n + 1))
            out["tenor"].extend(tenors)
            for col, value in (("label", label), ("expected_ratings", ()), ("optional_redemption_by_issuer", terms)):
                out[col].extend([value] * n)
            for col, search in groups(n):
                m = search(text)
                values = []
                if m is not None:
                    # a mark keeps an empty last line
                    pieces = (m[1] + "x").splitlines()
                    pieces[-1] = pieces[-1][:-1]
                    values = [v.strip() for v in pieces[:n]]
                if len(values) < n:
                    values += [None] * (n - len(values))
                out[col] += values
        return _lists(counts, list(out.values()), kinds)
    return run


def three_line_tranches(kinds: list[pa.Field], fields: dict[str, str], tenors: list[str | None],
                        labels: list[str | None], terms: list[list[str] | None]):
    """Worker function of the draft's three lines: texts -> ``array<struct>`` of
    three tranches; a field's values are the three lines after its label."""
    fixed = {"tranche_no": [1, 2, 3], "tenor": tenors, "label": labels, "expected_ratings": [()] * 3,
             "optional_redemption_by_issuer": terms}

    def run(column: pa.Array) -> pa.Array:
        searches = {col: after_label(lab, r"\s+([^\n]*)\n([^\n]*)\n([^\n]*)\n") for col, lab in fields.items()}
        out, texts = {f.name: [] for f in kinds}, _texts(column)
        for col, values in fixed.items():
            out[col] = list(values) * len(texts)
        for text in texts:
            for col, search in searches.items():
                m = search(text) if text is not None else None
                out[col] += map(str.strip, m.groups()) if m else (None, None, None)
        return _lists([3] * len(texts), list(out.values()), kinds)
    return run
