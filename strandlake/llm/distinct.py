"""Distinct counts in mergeable registers (HyperLogLog).

A register holds the largest rank, leading zeros plus one, of the hashes that fall into
it.  The registers of a group and measure travel packed in one binary value, Spark's HLL
sketch: a short list of hashes while the group is small, one byte for each register above
that.  Partial results of days and groups merge by the maximum of each register, so
coarser groups come from finer ones and the rows are read once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import stage

#: 2**PRECISION registers; the standard error is 1.04 / sqrt(2**PRECISION).
PRECISION = 12


def standard_error(precision: int = PRECISION) -> float:
    """The relative standard error of an estimate; it is less for counts below about 2**precision / 10."""
    return 1.04 / math.sqrt(1 << precision)


def _checked(keys: Sequence[str], measures: Iterable[str]) -> None:
    names = [*keys, *measures]
    if clash := {n for n in names if names.count(n) > 1} | {"measure", "n_distinct", "standard_error", "grouping", "__mask"} & set(names):
        raise ValueError(f"rename the keys or measures {sorted(clash)}: the result has columns of that name")


def registers(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], precision: int = PRECISION) -> DataFrame:
    """Packed registers of the distinct values of each measure, one row for each combination of ``keys``.

    Rows: the keys and a binary column for each measure, which ``merge`` and ``estimate`` read.
    A null value of a measure doesn't count; null keys are a key of their own; repeated rows
    change nothing; an empty table gives no rows.  Each task packs its rows before the shuffle.
    """
    _checked(keys, measures)
    # One 64-bit hash of the value goes in, so that values of any type, structs included, may be counted.
    rows = df.select(*keys, *(F.when(value.isNotNull(), F.xxhash64(value)).alias(name) for name, value in measures.items()))
    return rows.groupBy(*keys).agg(*(F.hll_sketch_agg(name, precision).alias(name) for name in measures))


def merge(parts: DataFrame, keys: Sequence[str], measures: Iterable[str]) -> DataFrame:
    """Registers of fewer keys, or of several partial results: the maximum of each register."""
    return parts.groupBy(*keys).agg(*(F.hll_union_agg(name).alias(name) for name in measures))


def estimate(parts: DataFrame, keys: Sequence[str], measures: Iterable[str], precision: int = PRECISION) -> DataFrame:
    """Keys, ``measure``, ``n_distinct`` and ``standard_error`` (relative) of each count that isn't 0."""
    counts = F.array(*(F.struct(F.lit(name).alias("measure"), F.hll_sketch_estimate(name).alias("n_distinct")) for name in measures))
    rows = parts.select(*keys, F.explode(counts).alias("__x")).select(*keys, "__x.*").filter("n_distinct > 0")
    return rows.withColumn("standard_error", F.lit(standard_error(precision)))


def _coarser(level: DataFrame, keys: Sequence[str], measures: Sequence[str], children: dict[int, int]) -> DataFrame:
    """Merge the rows of ``level`` into combinations with one key less; ``children`` says from which one each comes."""
    options = [
        F.when(
            F.col("__mask") == parent,
            F.struct(F.lit(child).alias("__mask"), *((F.col(k) if child >> i & 1 else F.lit(None).cast(level.schema[k].dataType)).alias(k) for i, k in enumerate(keys))),
        )
        for child, parent in children.items()
    ]
    spread = level.select(F.explode(F.array_compact(F.array(*options))).alias("__x"), *measures).select("__x.*", *measures)
    return merge(spread, ["__mask", *keys], measures)


def distinct_by_combination(parts: DataFrame, keys: Sequence[str], measures: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """Estimates for every combination of ``keys``, the empty one included, from packed registers.

    ``grouping`` names the keys that count, joined by ``+`` (``total`` for none); the others are
    null.  Combinations are merged level by level: one of n keys comes from that combination
    of n + 1 keys, one more, that has the fewest rows.  So a level is one shuffle of what the
    level before left over, with a merge in each task before it, and the rows are not read again.
    """
    keys, measures = list(keys), list(measures)
    _checked(keys, measures)
    mask_of = {c: sum(1 << keys.index(k) for k in c) for n in range(len(keys) + 1) for c in combinations(keys, n)}
    levels = [parts.withColumn("__mask", F.lit((1 << len(keys)) - 1)).select("__mask", *keys, *measures)]
    for n in range(len(keys) - 1, -1, -1):
        levels[-1] = stage(levels[-1], "registers")
        rows = {r["__mask"]: r["count"] for r in levels[-1].groupBy("__mask").count().collect()}  # one row for each combination
        if not rows:
            break
        children = {mask_of[c]: min((m for m in rows if m & mask_of[c] == mask_of[c]), key=lambda m: (rows[m], m)) for c in combinations(keys, n)}
        levels.append(_coarser(levels[-1], keys, measures, children))
    found = reduce(DataFrame.unionByName, (estimate(x, ["__mask", *keys], measures, precision) for x in levels))
    names = F.element_at(F.create_map(*(F.lit(x) for c, m in mask_of.items() for x in (m, "+".join(c) or "total"))), F.col("__mask"))
    return found.select(names.alias("grouping"), *keys, "measure", "n_distinct", "standard_error")
