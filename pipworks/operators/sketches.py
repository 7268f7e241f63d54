"""A Bloom filter over a column, built by a distributed aggregation and applied by an Arrow predicate."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_ITEM = 10
LEAST_BITS = 256
HASHES = 5
#: Largest filter that is shipped to the tasks; beyond it membership is decided by the exact join alone.
LARGEST_BYTES = 64 << 20


@dataclass(frozen=True)
class Bloom:
    bits: int
    hashes: int
    data: bytes

    def to_text(self) -> str:
        return base64.b64encode(self.data).decode()


def bits_for(items: int) -> int:
    return max(LEAST_BITS, -(-BITS_PER_ITEM * items // 8) * 8)


def fnv1a(data: bytes, seed: int = 0x811C9DC5) -> int:
    """The 32-bit FNV-1a hash, from a start value."""
    for byte in data:
        seed = (seed ^ byte) * 0x01000193 & 0xFFFFFFFF
    return seed


def _positions(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """Double hashing: HASHES positions per item."""
    step = h2 % np.uint64(bits) | np.uint64(1)
    return (h1[:, None] % np.uint64(bits) + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def _hashed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({"_h1": F.xxhash64(column), "_h2": F.xxhash64(F.lit(1), column)})


def bloom_filter(items: DataFrame, column: str) -> Bloom | None:
    """A filter of the distinct non-null values of `column`, or None where it would exceed LARGEST_BYTES. Tasks send whole bit arrays, which are merged with or."""
    values = items.select(column).filter(F.col(column).isNotNull()).distinct()
    bits = bits_for(values.count())
    if bits // 8 > LARGEST_BYTES:
        return None

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = np.zeros(bits, dtype=bool)
        for b in batches:
            if len(b):
                field[_positions(b["_h1"].to_numpy().view(np.uint64), b["_h2"].to_numpy().view(np.uint64), bits).ravel()] = True
        yield pd.DataFrame({"field": [np.packbits(field).tobytes()]})

    parts = _hashed(values, column).select("_h1", "_h2").coalesce(16).mapInPandas(fill, "field binary")
    merged = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():  # at most 16 arrays of a bounded size, one at a time
        merged |= np.frombuffer(bytes(row["field"]), dtype=np.uint8)
    return Bloom(bits, HASHES, merged.tobytes())


def bloom_might_contain(df: DataFrame, column: str, bloom: Bloom | None) -> DataFrame:
    """The rows of `df` whose value may be in the filter: all that are, and few that are not."""
    if bloom is None:
        return df
    field = df.sparkSession.sparkContext.broadcast(np.frombuffer(bloom.data, dtype=np.uint8))
    bits = bloom.bits

    @F.pandas_udf("boolean")
    def contained(h1: pd.Series, h2: pd.Series) -> pd.Series:
        at = _positions(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64), bits)
        return pd.Series((field.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=1))

    return df.filter(F.col(column).isNotNull() & contained(F.xxhash64(column), F.xxhash64(F.lit(1), column)))
