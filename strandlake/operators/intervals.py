"""Interval operators: islands, overlap joins, elementary segments and nearest matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.sweep import constant_segments, periods_and_gaps


def islands(
    df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", touching: bool = True, island: str = "island", bin_size: int = 10_000
) -> DataFrame:
    """Number the clusters of overlapping intervals of each key from 1, in order of place.

    Intervals that touch belong together unless ``touching`` is false.  A null key is a
    key of its own; intervals with a null end get a null number; an empty interval counts as
    its place; ties and repeated rows are in one cluster; all columns stay.  The clusters come
    from the range-partitioned sweep and each row finds its own by the bin of its start, so
    no task has a whole key.  For keys that have few intervals by nature, such as reads, use
    ``islands_of_small_keys``.
    """
    rows, periods = _doubled(df, keys, start, end, touching, island)
    return locate(rows, periods, keys, "__low", ("__from", "__to"), 2 * bin_size).drop("__low", "__high", "__from", "__to")


def _doubled(df: DataFrame, keys: Sequence[str], start: str, end: str, touching: bool, island: str) -> tuple[DataFrame, DataFrame]:
    """The rows with doubled ends, so that touching ones may be joined or kept apart, and the numbered clusters of these."""
    low = F.least(start, end) * 2 + F.lit(0 if touching else 1)
    high = F.greatest(F.greatest(start, end) * 2 + F.lit(1 if touching else 0), low + 1)
    rows = df.withColumns({"__low": F.when(F.col(start).isNotNull() & F.col(end).isNotNull(), low), "__high": high})
    periods = periods_and_gaps(rows, keys, "__low", "__high", number=island).filter("kind = 'period'")
    return rows, periods.select(*keys, island, F.col("start_pos").alias("__from"), F.col("end_pos").alias("__to"))


def island_ends(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", island: str = "island") -> DataFrame:
    """The clusters of overlapping or touching intervals of each key: keys, ``island``, ``island_start``, ``island_end``.

    The numbers are those of ``islands``; rows find their cluster by ``locate``.
    """
    periods = _doubled(df, keys, start, end, True, island)[1]
    return periods.select(*keys, island, F.expr("__from div 2").alias("island_start"), F.expr("(__to - 1) div 2").alias("island_end"))


def locate(rows: DataFrame, periods: DataFrame, keys: Sequence[str], at: str, ends: tuple[str, str], bin_size: int = 10_000) -> DataFrame:
    """Each row with the period of its key that holds the place ``at``; null where there is none.

    The periods of a key are disjoint.  A row lies in one bin, a period in all that it touches, so
    a bin with very many rows has few periods: bins with a large share of the rows meet them by
    broadcast, all others by a shuffle.  Null keys are equal; the columns of ``periods`` that
    are no keys must have other names than those of ``rows``.
    """
    from strandlake.operators.skew import join_unique_rows

    left = rows.withColumn("__bin", F.floor(F.col(at) / bin_size))
    first, last = (F.floor(c / bin_size) for c in (F.col(ends[0]), F.col(ends[1]) - 1))
    right = periods.withColumn("__bin", F.explode(F.sequence(first, last))).withColumnsRenamed({k: f"__right_{k}" for k in keys} | {"__bin": "__right_bin"})
    inside = (F.col(at) >= F.col(ends[0])) & (F.col(at) < F.col(ends[1]))
    return join_unique_rows(left, right, [*keys, "__bin"], [*(f"__right_{k}" for k in keys), "__right_bin"], inside).drop("__bin", *(f"__right_{k}" for k in keys), "__right_bin")


def islands_of_small_keys(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", touching: bool = True, island: str = "island") -> DataFrame:
    """``islands`` by one window for each key: for keys such as reads, whose intervals are few by nature."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    whole = F.col(start).isNotNull() & F.col(end).isNotNull()
    reach = F.max(F.when(whole, F.col(end))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > reach if touching else F.col(start) >= reach
    new = F.when(whole & (reach.isNull() | apart), 1).otherwise(0)
    marked = df.withColumn("_new", new)
    number = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(island, F.when(whole, number)).drop("_new")


def loci(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", bin_size: int = 10_000) -> DataFrame:
    """Each interval with the period that holds it, as ``locus_start`` and ``locus_end``.

    Empty intervals and those with a null end are left out.
    """
    periods = periods_and_gaps(df, keys, start, end).filter("kind = 'period'").select(*keys, F.col("start_pos").alias("locus_start"), F.col("end_pos").alias("locus_end"))
    return locate(df.filter(F.col(start) < F.col(end)), periods, keys, start, ("locus_start", "locus_end"), bin_size)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ends: tuple[str, str],
    right_ends: tuple[str, str],
    bin_size: int = 1000,
    how: str = "inner",
) -> DataFrame:
    """Pairs of intervals with equal keys that share at least one place (half-open ends).

    ``how`` is inner, left, left_semi or left_anti.  Intervals are put into the bins they
    touch; a pair counts in its first common bin only, so nothing is deduplicated.  Keys
    are joined by equality and occur once in the result; other column names must differ.
    Null keys, null ends and empty intervals match nothing.  A bin that holds a large share of
    one side is a skewed partition of one join by equality, which adaptive execution splits.
    """
    ls, le = left_ends
    rs, re = right_ends
    renamed = {k: f"__right_{k}" for k in keys}

    def binned(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        first, last = F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size)
        spread = F.when(F.col(s) < F.col(e), F.sequence(first, last))
        return df.withColumn(name, F.explode(spread)).withColumn(name.replace("_bin", "_first"), first)

    if how == "inner":
        a, b = binned(left, ls, le, "__left_bin"), binned(right.withColumnsRenamed(renamed), rs, re, "__right_bin")
        on = (F.col("__left_bin") == F.col("__right_bin")) & (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.col("__left_bin") == F.greatest("__left_first", "__right_first"))
        for k in keys:
            on = on & (F.col(k) == F.col(renamed[k]))
        return a.join(b, on).drop("__left_bin", "__left_first", "__right_bin", "__right_first", *renamed.values())
    # Rows with equal keys and ends meet the same, so the different ones are looked at and joined back by equality.
    place = {**{k: f"__met_{k}" for k in keys}, ls: "__met_s", le: "__met_e"}
    hits = overlap_join(left.select(*place).distinct(), right.select(*keys, rs, re).distinct(), keys, left_ends, right_ends, bin_size)
    hits = hits.select(*(F.col(c).alias(n) for c, n in place.items())).distinct()
    same = [F.col(c) == F.col(n) for c, n in place.items()]
    if how != "left":
        return left.join(hits, same, how)
    alone = left.join(hits, same, "left_anti")
    return overlap_join(left, right, keys, left_ends, right_ends, bin_size).unionByName(alone, allowMissingColumns=True)


def elementary_segments(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """Maximal stretches of constant cover, split at every start and end: ``seg_start``, ``seg_end``, ``depth``.

    Starts count +1 and ends -1; places where these cancel still split.  Uncovered
    stretches, empty intervals and null ends are left out; repeated rows add to the depth.
    """
    return constant_segments(df, keys, start, end)


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ends: tuple[str, str], right_ends: tuple[str, str], max_diff: int, by: Sequence[str]) -> DataFrame:
    """For each left row (known by the columns ``by``) the right row whose two ends lie nearest, each within ``max_diff``.

    Distance is the sum of both absolute differences; ties go to the lower ends.  Left
    rows without a match are left out; null keys and ends match nothing.
    """
    ls, le = left_ends
    rs, re = right_ends
    # Ends within max_diff lie in equal or neighbouring bins of that size.
    size = max(1, max_diff)
    near = left.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(ls) / size) + i for i in (-1, 0, 1)))))
    other = right.withColumn("_bin", F.floor(F.col(rs) / size))
    pairs = near.join(other, [*keys, "_bin"]).withColumn("_d1", F.abs(F.col(ls) - F.col(rs))).withColumn("_d2", F.abs(F.col(le) - F.col(re)))
    best = Window.partitionBy(*by).orderBy(F.col("_d1") + F.col("_d2"), rs, re)
    kept = pairs.filter((F.col("_d1") <= max_diff) & (F.col("_d2") <= max_diff)).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return kept.withColumn("distance", F.col("_d1") + F.col("_d2")).drop("_n", "_bin", "_d1", "_d2")


def covered_length(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", small_keys: bool = False) -> DataFrame:
    """Number of places that the intervals of each key cover together: ``covered``.

    Empty intervals and null ends are left out.  With ``small_keys`` a key has few intervals by
    nature, such as a read, and is handled by a window.
    """
    rows = df.filter(F.col(start) < F.col(end))
    if small_keys:
        merged = islands_of_small_keys(rows, keys, start, end).groupBy(*keys, "island").agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    else:
        merged = periods_and_gaps(rows, keys, start, end).filter("kind = 'period'").withColumnsRenamed({"start_pos": "_s", "end_pos": "_e"})
    return merged.groupBy(*keys).agg(F.sum(F.col("_e") - F.col("_s")).alias("covered"))


def windows(df: DataFrame, keys: Sequence[str], at: str, size: int) -> DataFrame:
    """Rows by fixed windows of ``size`` places: ``window_start`` and ``n``."""
    start: Column = (F.floor(F.col(at) / size) * size).alias("window_start")
    return df.filter(F.col(at).isNotNull()).groupBy(*keys, start).agg(F.count("*").alias("n"))
