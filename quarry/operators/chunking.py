"""Overlapping word chunks (a row generator)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import let, split_words

CHUNK_KEY = ["source", "doc_id", "chunk_no"]


def chunk_words(words: Column, max_words: int = 300, overlap: int = 50) -> Column:
    """Chunks of ``max_words`` words starting every ``max_words - overlap``
    words, while the start is inside the text; words joined by one space.

    The last chunk may lie wholly inside the one before it (260 words give
    ``[0:260]`` and ``[250:260]``), as in the reference.  No words, no chunks.
    """
    if not 0 <= overlap < max_words:
        raise ValueError("need 0 <= overlap < max_words")
    step = max_words - overlap

    def chunks(w):
        n = F.size(w)
        starts = F.sequence(F.lit(0), n - 1, F.lit(step))
        return F.when(n > 0, F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, max_words), " "))
                      ).otherwise(F.array().cast("array<string>"))
    return let(words, chunks)


def chunk_text(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
               max_words: int = 300, overlap: int = 50) -> DataFrame:
    """One row per chunk: ``keep`` columns, ``chunk_no`` (from 0), ``content``.

    Map-only: each text is split and chunked inside its own row, so the job
    has no shuffle and the work per task is bounded by the texts it holds.
    """
    keep = keep if keep is not None else ["source", "doc_id"]
    return df.select(*keep, F.posexplode(chunk_words(split_words(text_col), max_words, overlap))
                     .alias("chunk_no", "content"))
