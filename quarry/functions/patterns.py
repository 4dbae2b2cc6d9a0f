"""Regular expressions of the deal-message parser.

Python's Unicode ``\\s`` is written as ``WS`` (Java's ``\\s`` is ASCII-only);
``(?d)`` makes ``.`` and ``$`` treat only ``\\n`` as a line end, as Python does.
"""

from __future__ import annotations

import re

from quarry.functions.text import WS

_U = "(?d)"

# ---------------------------------------------------------------------------
# These patterns must equal the reference's for the same results.
CELL_SEP = rf"\t+|{WS}{{2,}}"
TRAILING_PAREN = rf"{WS}*\(.*?\){WS}*$"
ANY_PAREN = rf"{WS}*\(.*?\)"
TENOR_NC = rf"(?i)(\d+){WS}*NC{WS}*(\d+)"
RATING_AGENCIES = [("Moody's", "Moody'?s"), ("S&P", "S&P"), ("Fitch", "Fitch")]
ISSUER = rf"{_U}Issuer/Ticker{WS}+(.*?)\("
SETTLEMENT = rf"{_U}Settlement{WS}+(.*?)\("
TENOR_LINE = rf"{_U}Tenor{WS}+(.+?)\n"


def ratings_block(label: str = "Expected Ratings") -> str:
    return rf"(?id){re.escape(label)}{WS}+([\s\S]+?)(?:\n[A-Z][a-zA-Z /]+:|\n\n|$)"


def rating_line(agency_pattern: str) -> str:
    return rf"{_U}{agency_pattern}:{WS}*(.*?)\n"


def three_line(label: str) -> str:
    return rf"{_U}{label}{WS}+(.*?)\n(.*?)\n(.*?)\n"


def line_group(label: str) -> str:
    """The n-line group without its repeat bound: every consecutive
    non-empty line from the label on.  Keeping the first ``n`` lines of this
    match equals the bounded pattern's match (the repetition never moves the
    start of the match), and the pattern stays constant across rows."""
    return f"{_U}{label}{WS}+([^\\n]+(?:\\n[^\\n]+)*)"
# ---------------------------------------------------------------------------
