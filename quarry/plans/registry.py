"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the result is expressible in SQL, an equivalent DuckDB statement
over the same tables (used as the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ SQL fragments
# DuckDB spellings of the Spark column functions, so every oracle applies the
# same rules to the same tables.

SQL_WS = r"[\s\p{Z}]+"
SQL_NON_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"


# quotes doubled for SQL
SQL_TAG = "<[a-zA-Z/](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>"


def sql_significant(expr: str) -> str:
    """Twelve significant digits (``common.significant``)."""
    return f"CAST(format('{{:.11e}}', {expr}) AS DOUBLE)"


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{SQL_WS}'), lambda w: w <> '')"


def sql_tokens(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array(strip_accents(lower({expr})), '{SQL_NON_TOKEN}'), "
            f"lambda t: t <> '')")


def sql_html_text(expr: str) -> str:
    x = expr
    for pat in (r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>",
                r"(?s)<[!?][^>]*>", SQL_TAG):
        x = f"regexp_replace({x}, '{pat}', chr(10), 'g')"
    for ent, ch in [("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"),
                    ("&nbsp;", "' || chr(160) || '"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def sql_chunks(source_sql: str, max_words: int = 300, overlap: int = 50) -> str:
    """``source_sql`` yields (source, doc_id, text); result: chunk rows."""
    step = max_words - overlap
    return f"""
    SELECT source, doc_id, CAST(st // {step} AS INTEGER) AS chunk_no,
           array_to_string(words[st + 1 : st + {max_words}], ' ') AS content
    FROM (SELECT source, doc_id, words, unnest(range(0, len(words), {step})) AS st
          FROM (SELECT source, doc_id, {sql_words('text')} AS words FROM ({source_sql}) s0) s1
          WHERE len(words) > 0) s2"""


DOC_SOURCE_SQL = "SELECT 'doc' AS source, CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents"


def sql_doc_tokens() -> str:
    return (f"SELECT source, doc_id, chunk_no, content, {sql_tokens('content')} AS tokens "
            f"FROM ({sql_chunks(DOC_SOURCE_SQL)}) c")


def sql_token_rows() -> str:
    return ("SELECT source, doc_id, chunk_no, dl, CAST(i AS INTEGER) AS pos, tokens[i + 1] AS term "
            "FROM (SELECT source, doc_id, chunk_no, CAST(len(tokens) AS INTEGER) AS dl, tokens, "
            f"unnest(range(len(tokens))) AS i FROM ({sql_doc_tokens()}) t) t2")
