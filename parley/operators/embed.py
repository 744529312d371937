"""Embedding.

An *embedder* is any callable ``Column(text) -> Column(array<float>)`` returning
unit-length vectors.  A model-backed embedder is an iterator ``pandas_udf`` /
``arrow_udf`` that loads its model once per Python worker; the batch size is the
session's ``spark.sql.execution.arrow.maxRecordsPerBatch``.

The default, ``hashed_embedder(dim)``, needs no model files: lower-cased ``\\w+``
tokens (repeats kept) are hashed in the JVM (MD5, low 64 bits), and counted into
``hash mod dim`` buckets and L2-normalised vectorised over whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.hashing import token_hashes
from parley.functions.text import _col

# --- fixed values -----------------------------------------------------------
DEFAULT_DIM = 384       # embedding width of the reference default model
DEFAULT_BATCH = 256     # texts embedded at a time
# ---------------------------------------------------------------------------

Embedder = Callable[[Column], Column]


def _bucket_batch(hashes: pa.Array, dim: int) -> pa.Array:
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    n = len(hashes)
    offs = np.asarray(hashes.offsets, dtype=np.int64)
    vals = np.asarray(hashes.values.to_numpy(zero_copy_only=False), dtype=np.int64)
    vals = vals[offs[0]:offs[-1]]
    counts = np.zeros((n, dim), dtype=np.float64)
    if len(vals):
        rows = np.repeat(np.arange(n), np.diff(offs))
        buckets = (vals.view(np.uint64) % np.uint64(dim)).astype(np.int64)
        np.add.at(counts, (rows, buckets), 1.0)
    norms = np.sqrt((counts * counts).sum(axis=1))
    norms[norms == 0] = 1.0
    vecs = (counts / norms[:, None]).astype(np.float32).ravel()
    out_offs = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
    arr = pa.ListArray.from_arrays(out_offs, pa.array(vecs, type=pa.float32()))
    if hashes.null_count:
        arr = pa.ListArray.from_arrays(out_offs, pa.array(vecs, type=pa.float32()),
                                       mask=hashes.is_null())
    return arr


@lru_cache(maxsize=None)
def _bucket_udf(dim: int, batch: int):
    def run(hashes: pa.Array) -> pa.Array:
        # a few rows at a time: the counts of a slice are a dense matrix
        parts = [_bucket_batch(hashes.slice(at, batch), dim) for at in range(0, max(len(hashes), 1), batch)]
        return pa.concat_arrays(parts)
    return F.arrow_udf(run, T.ArrayType(T.FloatType()))


def hashed_embedder(dim: int = DEFAULT_DIM, batch: int = DEFAULT_BATCH) -> Embedder:
    """Default embedder: hashed word counts, unit length (all-zero for no token), ``batch`` texts
    at a time."""
    dim, batch = int(dim), max(1, int(batch))

    def embed_col(c) -> Column:
        return _bucket_udf(dim, batch)(token_hashes(_col(c)))
    return embed_col


def embed(df: DataFrame, text_col: str = "text", embedder: Embedder | None = None,
          out: str = "embedding", batch: int | None = None) -> DataFrame:
    """V1: add ``out`` = embedder(text).  ``batch`` sets how many texts the default embedder takes
    at a time; an embedder that is passed in has a batch size of its own."""
    embedder = embedder or hashed_embedder(batch=batch or DEFAULT_BATCH)
    return df.withColumn(out, embedder(F.col(text_col)))
