"""Highlighted snippet of a chunk for a query: a window of ``n`` tokens of
the original text with every query-term token wrapped in markers.

Window choice (per chunk, over its hit positions in order; a candidate
replaces the best one only with a strictly higher score):

* a window scores 1000 for each distinct query term inside it and 1 for
  every further occurrence;
* candidate A starts at a hit, shifted left to centre the hits it covers
  (``first - (n - (last + 1 - first)) // 2``), kept inside the text;
* candidate B (only when the chunk is longer than ``n``) starts at the
  latest sentence start before the hit, with a bonus of 120 for the first
  token and 100 otherwise.  A sentence starts at token 0 and at a token
  preceded by whitespace whose nearest earlier non-blank character is
  ``.`` or ``:``.

Output: ``...`` when the window does not start at token 0 (the text then
begins at that token), the original text with markers around hits, then
either the rest of the text (window reaches the last token) or ``...``.

Pure array functions: intended for the few rows that survive a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import NON_TOKEN, fold_diacritics, let

_TOKEN = r"[\p{L}\p{N}\p{Co}]"


def snippet(content: Column, terms: Column, n: int = 5, open_mark: str = "[", close_mark: str = "]",
            ellipsis: str = "...") -> Column:
    """``terms``: ``array<string>`` of query terms (already tokenized)."""
    pieces = F.regexp_extract_all(content, F.lit(rf"({_TOKEN}+|{NON_TOKEN})"), F.lit(1))

    def with_pieces(pc):
        off = F.when((F.size(pc) > 0) & F.get(pc, 0).rlike(rf"^{_TOKEN}"), 0).otherwise(1)
        n_pieces = F.size(pc)
        nd = F.floor((n_pieces - off + 1) / 2).cast("int")
        toks = F.transform(F.sequence(F.lit(0), F.greatest(nd - 1, F.lit(0))),
                           lambda i: fold_diacritics(F.lower(F.get(pc, 2 * i + off))))

        def with_toks(tk):
            hits = F.filter(F.sequence(F.lit(0), F.greatest(nd - 1, F.lit(0))),
                            lambda i: (i < nd) & F.array_contains(terms, F.get(tk, i)))
            # sentence starts: token 0, and tokens whose preceding gap ends in [.:] + blanks
            sentence_starts = F.filter(F.sequence(F.lit(0), F.greatest(nd - 1, F.lit(0))), lambda i: (i == 0) | (
                (i < nd) & F.coalesce(F.get(pc, 2 * i + off - 1), F.lit("")).rlike(r"[.:][ \t\n\r]+$")))

            def with_hits(hp, starts):
                def window(s):
                    inw = F.filter(hp, lambda h: (h >= s) & (h < s + n))
                    d = F.size(F.array_distinct(F.transform(inw, lambda h: F.get(tk, h))))
                    return F.struct((F.lit(999) * d + F.size(inw)).alias("score"),
                                    F.array_max(inw).alias("last"))

                def cand(p):
                    def from_window(w):
                        adj = p - F.floor((F.lit(n) - (w["last"] + 1 - p)) / 2).cast("int")
                        adj = F.when(adj + n > nd, nd - n).otherwise(adj)
                        return F.struct(w["score"].alias("score"), F.greatest(adj, F.lit(0)).alias("start"))

                    def from_start(j):
                        return F.when((nd > n) & (j < p), F.struct(
                            (window(j)["score"] + F.when(j == 0, 120).otherwise(100)).alias("score"),
                            j.alias("start")))
                    return F.array(let(window(p), from_window),
                                   let(F.array_max(F.filter(starts, lambda x: x <= p)), from_start))

                def render(best):
                    start = F.coalesce(best["start"], F.lit(0))
                    to_end = start + n >= nd
                    k0 = F.when(start == 0, 0).otherwise(2 * start + off)
                    k1 = F.when(to_end, n_pieces - 1).otherwise(2 * (start + n - 1) + off)
                    ks = F.sequence(k0, F.greatest(k1, k0))
                    body = F.array_join(F.transform(ks, lambda k: F.when(
                        (k >= off) & ((k - off) % 2 == 0) & F.array_contains(hp, F.floor((k - off) / 2).cast("int")),
                        F.concat(F.lit(open_mark), F.get(pc, k), F.lit(close_mark))).otherwise(F.get(pc, k))), "")
                    return F.concat(F.when(start > 0, F.lit(ellipsis)).otherwise(F.lit("")), body,
                                    F.when(to_end, F.lit("")).otherwise(F.lit(ellipsis)))

                def pick(cands):
                    # the first candidate with the highest score (strictly-greater replacement)
                    return let(F.array_max(F.transform(cands, lambda c: c["score"])), lambda top: let(
                        F.get(F.filter(cands, lambda c: c["score"] == top), 0), render))
                return let(F.filter(F.flatten(F.transform(hp, cand)), lambda c: c.isNotNull()), pick)
            return let(F.struct(hits.alias("h"), sentence_starts.alias("s")), lambda hs: with_hits(hs["h"], hs["s"]))
        return let(toks, with_toks)
    return let(pieces, lambda pc: F.when(F.size(pc) > 0, with_pieces(pc)).otherwise(F.lit("")))
