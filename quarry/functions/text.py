"""Column functions for text preparation.

Everything here is a native Catalyst expression (regex, split, translate,
higher-order array functions), so it runs inside the JVM with no Python
round trip.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's ``str.isspace`` sees it.  Java's ``\s`` covers only
# ASCII, so the Unicode separators and the C0 information separators are
# added explicitly.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"

# Line boundaries of Python's ``str.splitlines``.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Token characters of a unicode61-style tokenizer: letters, numbers and
# private-use characters; everything else separates tokens.
NON_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Catalyst inlines a projected column into every lambda that refers to it
    (CollapseProject counts the reference once), so an expensive array used
    inside ``transform``/``filter`` would be recomputed per element.  Passing
    it in as a lambda argument binds it instead."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Every character ``str.isspace()`` accepts (generated, not listed by hand).
WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def btrim_ws(c) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends (native
    ``btrim`` over the whitespace set, no regex)."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def split_at(c, pattern: str, mark: str) -> Column:
    """``split`` at a pattern that matches ``mark`` or takes it for a separator
    too.  A split compiles its pattern for every row, a replacement once, and a
    split at one plain character needs none."""
    return F.split(F.regexp_replace(_col(c), pattern, mark), mark, -1)


def split_words(c) -> Column:
    """``str.split()``: words separated by any whitespace run, no empty words."""
    return F.filter(split_at(c, f"{WS}+", " "), lambda w: w != "")


def split_lines(c) -> Column:
    """``str.splitlines()`` line boundaries (a trailing break gives one extra
    empty element, which every caller drops as blank)."""
    return split_at(c, LINE_BREAK, "\n")


# A tag with its attributes: quoted values may hold ``>``.
TAG = r"""<[a-zA-Z/](?:[^>"']|"[^"]*"|'[^']*')*+>"""
CDATA_OPEN, CDATA_CLOSE = "<![CDATA[", "]]>"
# A character reference: decimal, hexadecimal or named.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*)(;?)"


def _code_point(n: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    ok = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    code = F.when(ok, n).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


# The references that most pages hold, in the order they are
# decoded in (``&amp;`` last, so that nothing is decoded twice).
FREQUENT_REFERENCES = {"&quot;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": "\xa0", "&copy;": "©", "&middot;": "·",
                       "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&rsquo;": "’", "&lsquo;": "‘", "&rdquo;": "”", "&ldquo;": "“",
                       "&amp;": "&"}


#: Parts of the table of character names.
NAME_PARTS = 12


def _named(name: Column) -> Column:
    """A name's character from Python's HTML5 table.  The sorted table is cut
    into parts, so a lookup goes through one of them only, and every part is
    one literal, so the plan stays small."""
    from html.entities import html5
    entries = sorted((k, v) for k, v in html5.items() if "<" not in k)
    size = -(-len(entries) // NAME_PARTS)
    out = F.lit(None).cast("string")
    for at in reversed(range(0, len(entries), size)):
        part = entries[at: at + size]
        table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in part)), F.lit("\x01"), F.lit("\x02"))
        out = F.when(name <= part[-1][0], F.try_element_at(table, name)).otherwise(out)
    return out


def unescape(c) -> Column:
    """Decode every numeric and named character reference, natively.

    A text that holds the frequent references only is decoded by plain
    replacements.  Any other is cut at ``&``; each piece that starts with a
    reference has it replaced.  Names come from Python's HTML5 table; those
    that HTML allows without a semicolon are taken without one too.  The 32
    code points that HTML reads as Windows-1252 are mapped as such.
    """
    win = F.split(F.lit("\x01".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))), "\x01")

    def piece(seg: Column) -> Column:
        def one(whole: Column) -> Column:
            ref = F.rtrim(whole, F.lit(";"))
            number = F.when(F.lower(F.substr(ref, F.lit(2), F.lit(1))) == "x", F.conv(F.substr(ref, F.lit(3)), 16, 10)) \
                .otherwise(F.substr(ref, F.lit(2))).cast("int")
            char = F.when(ref.startswith("#"), F.when(number.between(128, 159), F.get(win, number - 128)).otherwise(_code_point(number))) \
                .otherwise(_named(whole))
            return F.when((whole == "") | char.isNull(), F.concat(F.lit("&"), seg)) \
                .otherwise(F.concat(char, F.substr(seg, F.length(whole) + 1)))
        return let(F.regexp_extract(seg, REFERENCE, 0), one)

    def whole(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
        return F.concat(parts[0], F.array_join(tail, ""))
    x = _col(c)
    names = "|".join(r[1:-1] for r in FREQUENT_REFERENCES)
    plain = x
    for ref, char in FREQUENT_REFERENCES.items():
        plain = F.replace(plain, F.lit(ref), F.lit(char))
    return (F.when(F.instr(x, "&") == 0, x)
            .when(F.instr(F.regexp_replace(x, f"&(?:{names});", ""), "&") == 0, plain)
            .otherwise(let(F.split(x, "&", -1), whole)))


def html_to_text(c) -> Column:
    """Visible text of an HTML document, one piece per text node.

    Every tag boundary becomes a line break (so ``a<b>b</b>`` is two words);
    comments, doctype, processing instructions, script and style bodies are
    dropped; CDATA sections keep their text; all character references are
    decoded without breaking a word.  Script must go before the tag pattern
    because script bodies may contain tag-like strings; a CDATA section's
    markup characters are escaped so that the tag pattern leaves them alone.
    """
    x = _col(c)

    def section(seg: Column) -> Column:
        end = F.instr(seg, CDATA_CLOSE)
        inner = F.when(end > 0, F.substr(seg, F.lit(1), end - 1)).otherwise(seg)
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inner = F.replace(inner, F.lit(raw), F.lit(safe))
        return F.concat(inner, F.when(end > 0, F.substr(seg, end + len(CDATA_CLOSE))).otherwise(F.lit("")))
    x = F.when(F.instr(x, CDATA_OPEN) == 0, x).otherwise(let(F.split(x, r"<!\[CDATA\[", -1), lambda p: F.concat(
        p[0], F.array_join(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), section), ""))))
    x = F.regexp_replace(x, r"(?is)<!--.*?-->", "\n")
    x = F.regexp_replace(x, r"(?is)<script\b.*?</script\s*>", "\n")
    x = F.regexp_replace(x, r"(?is)<style\b.*?</style\s*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[!?][^>]*>", "\n")
    x = F.regexp_replace(x, TAG, "\n")
    return unescape(x)


def _diacritic_table() -> tuple[str, str]:
    """Map every letter whose canonical decomposition is one base letter plus
    combining marks to that base letter (``é`` -> ``e``); letters without such
    a decomposition (``ß``, ``ø``) are left alone.  The combining marks
    U+0300 to U+036F are appended without a partner: ``translate`` deletes
    them, so a decomposed letter folds like a composed one."""
    src, dst = [], []
    for cp in [*range(0x00C0, 0x0590), *range(0x1E00, 0x2000)]:
        ch = chr(cp)
        nfd = unicodedata.normalize("NFD", ch)
        if len(nfd) > 1 and unicodedata.category(ch)[0] == "L" and all(unicodedata.category(m) == "Mn" for m in nfd[1:]):
            src.append(ch)
            dst.append(nfd[0])
    return "".join(src) + "".join(map(chr, range(0x300, 0x370))), "".join(dst)


_DIA_SRC, _DIA_DST = _diacritic_table()


def fold_diacritics(c) -> Column:
    return F.translate(_col(c), _DIA_SRC, _DIA_DST)


def unicode61_tokens(c) -> Column:
    """Tokens as a unicode61 full-text tokenizer makes them: lower-cased,
    diacritics removed, split on anything that is not a letter, number or
    private-use character."""
    return F.filter(F.split(fold_diacritics(F.lower(_col(c))), NON_TOKEN, -1),
                    lambda t: t != "")
