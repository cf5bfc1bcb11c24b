"""Vectors: the embedder interface, a model-free default, cosines of pairs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import TOKEN

#: texts -> float32 array of texts x dimensions
Embedder = Callable[[pd.Series], np.ndarray]
_TOKEN = re.compile(TOKEN)


def hashing_embedder(texts: pd.Series, dim: int = 64) -> np.ndarray:
    """Signed hashed token counts, unit length.  Reproducible; it knows nothing of meaning."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts, strict=True):
        h = np.array([zlib.crc32(token.encode()) for token in _TOKEN.findall((text or "").lower())], np.int64)
        row += np.bincount(h % dim, np.where(h >> 31, 1.0, -1.0), dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def shingle_embedder(texts: pd.Series, dim: int = 256, words: int = 3) -> np.ndarray:
    """Signed hashed counts of ``words`` tokens in a row (of all where there are fewer), unit length: near for texts with the same wording, about 0 for others."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts, strict=True):
        tokens = _TOKEN.findall((text or "").lower())
        shingles = map(" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [" ".join(tokens)] if tokens else []
        h = np.frombuffer(b"".join([hashlib.md5(s.encode()).digest() for s in shingles]), ">u4")[::4].astype(np.int64)
        row += np.bincount(h % dim, np.where(h >> 31, 1.0, -1.0), dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, embedder: Embedder, key: str, text: str) -> DataFrame:
    """``(key, vec)``, in Arrow batches."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "vec": list(embedder(b[text]))})

    return df.select(key, text).mapInPandas(each, f"{key} {dict(df.dtypes)[key]}, vec array<float>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """From 0 to 1: negative cosines are 0, and so is that of a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))))


def unit(v: Column) -> Column:
    """To unit length; null for a zero vector."""
    # As the one element of an array, so that the norm is computed once, not once a component.
    both = F.transform(F.array(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("norm"))), lambda s: F.when(s["norm"] > 0, F.transform(s["v"], lambda x: x / s["norm"])))
    return both[0]
