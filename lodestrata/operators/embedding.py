"""Texts to vectors through a model that each Python worker loads once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic stand-in for a model: signed hashed counts of all words, at unit length."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = xxhash.xxh64_intdigest(word)
                row[h % self.dimensions] += 1 if h >> 63 else -1
            norm = float(np.sqrt((row.astype(np.float64) ** 2).sum()))
            if norm:
                row /= norm
        return out


def with_embeddings(rows: DataFrame, make: Callable[[], Embedder] = HashingEmbedder, text: str = "text", into: str = "embedding", batch_rows: int = 256) -> DataFrame:
    """rows with a vector (array<float>) of each text; null texts count as empty. Narrow: no shuffle."""
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or make()
            for low in range(0, batch.num_rows, batch_rows):
                part = batch.slice(low, batch_rows)
                vectors = model.embed([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(vectors), pa.list_(pa.float32()))], names=[*part.schema.names, into])

    return rows.mapInArrow(run, schema)
