"""Hashes of sliding windows over integer sequences, and bitmaps of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class CodeHash:
    """A 64-bit value for each code point, the common ones from a table."""

    def __init__(self, seed: int):
        self.seed = np.uint64((seed * _ODD + 1) & _ALL)
        self.table = mix(np.arange(1 << 16, dtype=np.uint64) + self.seed)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) and codes.max() >= 1 << 16:
            return mix(codes.astype(np.uint64) + self.seed)
        return self.table[codes]


def window_hashes(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Polynomial hash of every window of ``width`` values, in about 2 log2(width) passes.

    Windows of twice a size come from two of that size; the binary digits of
    ``width`` say which sizes make up the window.
    """
    if len(values) < width:
        return np.zeros(0, dtype=np.uint64)
    base = ((2 * seed + 1) * _ODD) & _ALL | 1
    part, size, whole, have = values, 1, None, 0
    while True:
        if width & size:
            if whole is None:
                whole, have = part, size
            else:
                n = len(values) - have - size + 1
                whole = whole[:n] * np.uint64(pow(base, size, 1 << 64)) + part[have : have + n]
                have += size
        if have == width:
            return whole
        part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    if len(values) < width:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


#: Bits of the largest bitmap: 8 MB, whatever the input.
MOST_BITS = 26


def bitmap(hashes: DataFrame, column: str, many: int) -> np.ndarray:
    """A bitmap that has the hashes of ``column`` (bigint), sized for ``many`` of them.

    It never has more than 2**MOST_BITS bits, so that it may be broadcast at any size of
    the input; a full one only lets more rows pass.  What passes must be checked exactly later.
    The low bits say the place: minima of hashes are small numbers, so their high bits differ little.
    """
    bits = min(MOST_BITS, max(16, (64 * max(many, 1)).bit_length()))
    words = (
        hashes.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("place"))
        .select(F.expr("shiftright(place, 5)").alias("word"), F.expr("shiftleft(1L, cast(place & 31 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toPandas()  # at most 2**(MOST_BITS - 5) rows
    )
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bit"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes the bitmap has."""
    place = hashes & np.uint64(32 * len(bits) - 1)
    return (bits[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
