"""Embedding of texts, by a pluggable encoder. The default one hashes tokens and needs no weights."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.session import ship

#: Makes an encoder, once for each task: lists of texts to a matrix with a row of float32 each.
Embedder = Callable[[], Callable[[Sequence[str]], np.ndarray]]
BATCH = 32
DIMENSIONS = 256


@lru_cache(1 << 18)
def _place(token: str, dimensions: int) -> tuple[int, float]:
    h = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big")
    return h % dimensions, -1.0 if h // dimensions % 2 else 1.0


def hashed(rows: Sequence[Sequence[str]], dimensions: int = DIMENSIONS) -> np.ndarray:
    """For each row of tokens the sum of a signed unit vector for each token: the first 32 bits of its MD5 give place and sign."""
    out = np.zeros((len(rows), dimensions), np.float32)
    for i, row in enumerate(rows):
        for t in row:
            at, sign = _place(t, dimensions)
            out[i, at] += sign
    return out


def normalized_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def embed(chunks: DataFrame, embedder: Embedder | None = None, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """chunk_id, document_id (where there is one) and v (float32, of unit length) of every chunk; null texts count as empty. Without an embedder, tokens are hashed."""
    ship(chunks.sparkSession)
    keys = [c for c in ("chunk_id", "document_id") if c in chunks.columns]
    value = tokens(F.coalesce(F.col(text), F.lit(""))) if embedder is None else F.coalesce(F.col(text), F.lit(""))
    d = chunks.select(*keys, value.alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = embedder() if embedder else lambda rows: hashed(rows, dimensions)
        size = BATCH if embedder else 1024
        for b in batches:
            for s in range(0, b.num_rows, size):
                part = b.slice(s, size)
                x = normalized_rows(np.asarray(encode(part.column(len(keys)).to_pylist()), np.float32))
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], v], [*keys, "v"])

    kinds = dict(d.dtypes)
    return d.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", v array<float>")
