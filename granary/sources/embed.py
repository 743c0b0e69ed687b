"""Embeddings by a provider; an offline one that hashes words."""

from __future__ import annotations

import re
import zlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import in_batches

DIMENSIONS = 1536


class EmbeddingError(RuntimeError):
    """A provider can't be used or gave something else than asked for."""


class Provider(Protocol):
    name: str
    dimensions: int

    def __call__(self, texts: list[str], purpose: str) -> list[list[float]]: ...


class HashingProvider:
    """Words hashed into signed places, scaled to length 1; texts without words are the zero vector."""

    name = "hashing"

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions

    def __call__(self, texts: list[str], purpose: str) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            for word in re.findall("[a-z0-9]+", text.lower()):
                h = zlib.crc32(word.encode())
                row[(h >> 1) % self.dimensions] += 1 - 2 * (h & 1)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def embed(df: DataFrame, text: str, provider: Provider | None, purpose: str = "document", batch: int = 64) -> DataFrame:
    """df with embedding array<float> of `text`, null for null. Purpose is document or query.

    A retried task asks the provider again, so write the rows once and read them from there.
    """
    if provider is None:
        raise EmbeddingError("no embedding provider is configured")
    if purpose not in ("document", "query"):
        raise ValueError(f"unknown purpose: {purpose}")

    def vectors(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        held = np.flatnonzero(texts.notna())
        for i in range(0, len(held), batch):
            part = held[i : i + batch]
            got = provider([texts.iloc[j] for j in part], purpose)
            if len(got) != len(part) or any(v is None or len(v) != provider.dimensions for v in got):
                raise EmbeddingError(f"{provider.name} gave an unexpected dimension; expected {provider.dimensions}")
            for j, v in zip(part, got):
                out.iloc[j] = np.asarray(v, "float32")
        return out

    return in_batches(df).withColumn("embedding", F.pandas_udf(vectors, "array<float>")(F.col(text).cast("string")))
