"""Text embeddings.

* ``hash_embed`` - built-in default needing no model file: each unicode61
  token is hashed to a bucket (first 24 bits of its MD5, modulo ``dim``) and
  the buckets become a term-count vector, L2-normalised, float32, in an Arrow
  UDF that hashes each distinct token of a piece of rows once.  It is a lexical embedding; it makes no
  claim to semantic quality.
* ``model_embed`` - a caller-supplied model (e.g. a sentence encoder): an
  iterator pandas UDF that loads the model once per Python worker and encodes
  whole Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import unicode61_tokens


#: Rows whose tokens a worker lays out at once.
PIECE_ROWS = 1024


def _token_buckets(tokens: list[bytes], dim: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.md5(t).digest()[:3], "big") % dim for t in tokens], dtype=np.int64)


def _count_vectors(tokens: pa.Array, dim: int) -> np.ndarray:
    """A row of L2-normalised bucket counts per token list: each distinct token
    is hashed once, and one ``bincount`` counts all rows (bucket ``b`` of row
    ``r`` is cell ``r * dim + b``)."""
    n = len(tokens)
    lens = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    buckets = _token_buckets(flat.dictionary.cast(pa.binary()).to_pylist(), dim)
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    flat = buckets[flat.indices.to_numpy(zero_copy_only=False)] if len(rows) else rows
    counts = np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
    norms = np.sqrt((counts * counts).sum(axis=1))
    return np.divide(counts, norms[:, None], out=np.zeros_like(counts), where=norms[:, None] > 0).astype(np.float32)


def _count_vector_fn(tokens: pa.Array, dim: pa.Array) -> pa.Array:
    n = len(tokens)
    d = dim[0].as_py() if n else 1
    pieces = [_count_vectors(tokens.slice(at, PIECE_ROWS), d).reshape(-1) for at in range(0, n, PIECE_ROWS)]
    values = np.concatenate([*pieces, np.zeros(0, dtype=np.float32)])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(values))


_UDF = {}


def _count_vector(tokens: Column, dim: Column) -> Column:
    # created on first use, so importing this module needs no session
    if "count" not in _UDF:
        _UDF["count"] = F.arrow_udf(_count_vector_fn, "array<float>")
    return _UDF["count"](tokens, dim)


def hash_embed(text, dim: int = 64) -> Column:
    """``array<float>`` of length ``dim`` for a text column."""
    c = F.col(text) if isinstance(text, str) else text
    return hash_embed_tokens(unicode61_tokens(c), dim)


def hash_embed_tokens(tokens, dim: int = 64) -> Column:
    """Same vector from an already tokenized column (no second tokenization)."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return _count_vector(t, F.lit(dim))


def model_embed(text, load_model: Callable[[], Callable[[list[str]], np.ndarray]]) -> Column:
    """Embed with a caller-supplied model.  ``load_model()`` runs once per
    Python worker and returns ``encode(list_of_texts) -> 2-D array``."""
    c = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf("array<float>")
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_model()
        for s in batches:
            vecs = np.asarray(encode(s.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(vecs))

    return _embed(c)


def _ship_by_value() -> None:
    """Functions of this module run inside Python workers (pandas UDF /
    mapInPandas).  Pickle them by value so the workers need no installed
    copy of the package."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # older cloudpickle: fall back to import by name
        pass


_ship_by_value()
