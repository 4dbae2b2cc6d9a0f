"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines (its blocks).  Markup that states what it is --
scripts, forms, menus, page heads and feet, asides, elements whose class, id
or role names an advert, a notice, comments and the like -- gives no lines.
Pages are ordered by URL path within each host; each is aligned with the page
before and the page after it by the longest common subsequence of lines, and
shared lines are deleted: a line outside an article element when either
neighbour shares it, a line inside one only when it stands outside the article
on the neighbour (a menu or a foot that one of two templates puts inside).
Lines that the articles of neighbours share are the articles' own.  Where the
elements marked as articles hold little of a page's running text, they are
teasers, and the whole body counts.

Pages are dealt out by ranges of (host, path), so a host of any size spreads
over tasks; the pages at the edges of a range go to both sides, so results do
not depend on where ranges end.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shuffle_partitions
from quarry.llm.urlfilter import url_host, url_path
from quarry.llm.words import blocks

#: Bytes of html in a range of pages, about: what one task aligns.
RANGE_BYTES = 64 << 20

# Element and attribute names of HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
DROPPED = {"head", "title", "nav", "footer", "aside", "form", "menu", "button", "select", "svg", "object", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
         "cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
         "popup", "promo", "promotion", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor",
         "sponsored", "subscribe", "toolbar", "widget"}
#: Of these, what an article may be wrapped in or begin with.
WEAK_NAMES = {"banner", "footer", "menu", "nav", "navigation", "notice", "toolbar", "widget"}
ARTICLE_NAMES = {"article", "entry", "post", "content"}
TEASERS = {"teaser", "teasers", "preview", "excerpt"}
#: A class that begins so tells of the page, not of the element (``has-sidebar``).
ABOUT = {"has", "with", "no", "without", "is", "show", "hide", "enable", "wp"}
CLOSED_BY = {"li": {"li"}, "p": set(), "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}

_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_IN_TAG = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?…]['\"”’)\]]*$")
#: Words of a line of running text, and how many times the articles' text the
#: rest's has to be for the articles to be teasers.
PROSE_WORDS, TEASER_TIMES = 6, 2


def _tag_end(s: str, at: int, missing: set[str]) -> int:
    """Position after the tag's ``>``; a > inside a quoted value does not end
    it.  ``missing`` holds quotes known not to occur any more."""
    while True:
        m = _IN_TAG.search(s, at)
        if m is None:
            return -1
        if m[1] is None:
            return m.end()
        close = -1 if m[1] in missing else s.find(m[1], m.end())
        if close < 0:
            missing.add(m[1])
            at = m.end()
        else:
            at = close + 1


def _boilerplate(name: str, tag: str, in_article: bool) -> bool:
    if name in DROPPED or name == "header" and not in_article:
        return True
    if name in ("html", "body") or "=" not in tag and "hidden" not in tag:
        return False
    article = name in ("article", "main")
    for key, a, b, c in _ATTRIBUTE.findall(tag, len(name) + 1):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _NAME_PART.findall(word)]
                if not parts or parts[0] in ABOUT:
                    continue
                own = ARTICLE_NAMES.intersection(parts)
                found = NAMES.intersection(parts) - (WEAK_NAMES if own or article else set())
                if found or article and TEASERS.intersection(parts) or "header" in parts and not (own or in_article or article):
                    return True
    return False


def page_lines(s: str) -> tuple[list[str], list[bool]]:
    """The lines of a page that markup does not rule out, and whether each is
    inside an article (or main) element.  White space in a line is one space;
    character references are decoded; no empty lines."""
    lines: list[str] = []
    inside: list[bool] = []
    text: list[str] = []
    stack: list[tuple[str, bool]] = []                 # open elements; does it drop its content
    dropped = articles = 0
    missing: set[str] = set()

    def end_line() -> None:
        if text:
            line = " ".join("".join(map(entities.unescape, text)).split())
            text.clear()
            if line:
                lines.append(line)
                inside.append(articles > 0)

    def close(k: int) -> None:
        nonlocal dropped, articles
        while len(stack) > k:
            name, drops = stack.pop()
            dropped -= drops
            articles -= name in ("article", "main")

    at, n = 0, len(s)
    while at < n:
        lt = s.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not dropped:
            text.append(s[at:lt])
        if lt == n:
            break
        if s.startswith("<!--", lt):
            end = s.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if s.startswith("<![CDATA[", lt):
            end = s.find("]]>", lt)
            end = n if end < 0 else end
            if not dropped:
                text.append(s[lt + 9: end].replace("&", "&amp;"))
            at = min(n, end + 3)
            continue
        if s.startswith(("<!", "<?"), lt):
            end = s.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG_NAME.match(s, lt)
        if m is None:                                   # a bare <
            if not dropped:
                text.append("<")
            at = lt + 1
            continue
        name = m[1].lower()
        end = _tag_end(s, m.end(), missing)
        at = n if end < 0 else end
        if name not in INLINE:
            end_line()
        if s[lt + 1] == "/":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(s, at)
            if found is None:
                break
            end = s.find(">", found.start())
            at = n if end < 0 else end + 1
            continue
        if name in VOID or s[at - 2: at] == "/>" and name not in ("p", "div", "span", "a", "li"):
            continue
        for k in range(len(stack) - 1, -1, -1):         # an open item ends where the next one starts
            if stack[k][0] in CLOSED_BY.get(name, ()):
                close(k)
                break
            if stack[k][0] not in INLINE and stack[k][0] not in CLOSED_BY:
                break
        if name in ("article", "main", "body"):          # a head or menu left open ends here
            for k, (open_name, drops) in enumerate(stack):
                if drops and (name == "body" or open_name in ("head", "title", "nav", "header")):
                    close(k)
                    break
        if name == "p":
            while stack and stack[-1][0] in INLINE | {"p"}:
                close(len(stack) - 1)
        drops = _boilerplate(name, s[lt:at], articles > 0)
        dropped += drops
        articles += name in ("article", "main")
        stack.append((name, drops))
    end_line()
    return lines, inside


def _lcs_row(a: list[int], b: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences of a and every prefix of b."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _lcs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [(i, i) for i in range(lo)]
    x, y = a[lo: len(a) - hi], b[lo: len(b) - hi]
    if len(x) == 1:
        if x[0] in y:
            out.append((lo, lo + y.index(x[0])))
    elif x and y:                                       # linear space: cut x in two, y where the lengths add up best
        mid = len(x) // 2
        up = _lcs_row(x[:mid], np.array(y))
        down = _lcs_row(x[mid:][::-1], np.array(y[::-1]))[::-1]
        cut = int(np.argmax(up + down))
        out += [(lo + i, lo + j) for i, j in _lcs(x[:mid], y[:cut])]
        out += [(lo + mid + i, lo + cut + j) for i, j in _lcs(x[mid:], y[cut:])]
    return out + [(len(a) - hi + i, len(b) - hi + i) for i in range(hi)]


def shared_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of line numbers of a longest common subsequence."""
    common = set(a) & set(b)
    if not common:
        return []
    code = {line: i for i, line in enumerate(common)}
    ia = [i for i, line in enumerate(a) if line in code]
    ib = [j for j, line in enumerate(b) if line in code]
    return [(ia[i], ib[j]) for i, j in _lcs([code[a[i]] for i in ia], [code[b[j]] for j in ib])]


def _prose(line: str) -> bool:
    """Is the line running text: a sentence of some words?"""
    return _SENTENCE.search(line) is not None and line.count(" ") + 1 >= PROSE_WORDS


class _Page:
    def __init__(self, row: dict):
        self.row, self.lines, self.inside = row, row["lines"], row["inside"]
        self.shared: set[int] = set()

    def text(self) -> str:
        """The lines that are left; those outside articles only on a page whose
        articles hold little running text."""
        left = [(x, a) for i, (x, a) in enumerate(zip(self.lines, self.inside)) if i not in self.shared]
        article = sum(len(x) for x, a in left if a)
        rest = sum(len(x) for x, a in left if not a and _prose(x))
        whole = rest > TEASER_TIMES * article
        return " ".join(x for x, a in left if a or whole or not any(self.inside))


def _compare(a: _Page, b: _Page) -> None:
    for i, j in shared_lines(a.lines, b.lines):
        if not (a.inside[i] and b.inside[j]):
            a.shared.add(i)
            b.shared.add(j)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (part, host, path, id); guests are neighbours only."""
    ids, urls, texts = [], [], []
    before: _Page | None = None

    def finish(page: _Page | None) -> None:
        if page is not None and not page.row["guest"]:
            ids.append(page.row["page_id"])
            urls.append(page.row["url"])
            texts.append(page.text())

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())],
                                         ["page_id", "url", "text"])
        ids.clear(), urls.clear(), texts.clear()
        return out

    for b in batches:
        for row in b.to_pylist():
            page = _Page(row)
            if before is not None and (before.row["part"], before.row["host"]) == (row["part"], row["host"]) and row["host"]:
                _compare(before, page)
            finish(before)
            before = page
        yield batch()
    finish(before)
    yield batch()


def main_text(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Per row: ``page_id, url, text, n_chars``.

    Null or empty html has an empty text.  A url without host (or null) has
    no neighbours: markup alone decides.  A null key sorts first; repeated
    rows are neighbours, and copies, of each other.  Empty input: no rows.
    """
    size = pages.agg(F.sum(F.octet_length(html)).alias("b")).first()["b"] or 0
    n = max(shuffle_partitions(pages.sparkSession), -(-size // RANGE_BYTES))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"),
                        url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"),
                        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(html).alias("html"))
    keys = F.struct("host", "path", "id")
    # the ranges: first and last key of each, from the urls alone (one row per range)
    edges = sorted((tuple(r["lo"]), tuple(r["hi"])) for r in
                   rows.select("host", "path", "id").repartitionByRange(n, "host", "path", "id")
                   .groupBy(F.spark_partition_id().alias("p")).agg(F.min(keys).alias("lo"), F.max(keys).alias("hi")).collect())
    held = pages.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = held.value
        last = [hi for _, hi in ranges]
        for whole in batches:
            for b in blocks(whole, "html", 4_000_000):
                out = []
                for r in b.to_pylist():
                    k = (r["host"], r["path"], r["id"])
                    part = min(bisect_left(last, k), len(last) - 1)
                    lines, inside = page_lines(r["html"] or "")
                    row = {"part": part, "guest": False, "host": k[0], "path": k[1], "id": k[2], "page_id": r["page_id"],
                           "url": r["url"], "lines": lines, "inside": inside}
                    out.append(row)
                    if k == ranges[part][1] and part + 1 < len(ranges) and ranges[part + 1][0][0] == k[0]:
                        out.append(row | {"part": part + 1, "guest": True})
                    if k == ranges[part][0] and part and ranges[part - 1][1][0] == k[0]:
                        out.append(row | {"part": part - 1, "guest": True})
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("part", pa.int32()), ("guest", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("id", pa.int64()),
                        ("page_id", pa.int64()), ("url", pa.string()), ("lines", pa.list_(pa.string())), ("inside", pa.list_(pa.bool_()))])
    lines = rows.mapInArrow(run, "part int, guest boolean, host string, path string, id bigint, page_id bigint, url string, "
                                 "lines array<string>, inside array<boolean>")
    out = (lines.repartition(n, "part").sortWithinPartitions("part", "host", "path", "id")
           .mapInArrow(_differences, "page_id bigint, url string, text string"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
