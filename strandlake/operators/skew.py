"""Joins that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot; there are at most so many hot keys.
HOT_SHARE = 256
#: Rows below which no key can make a task long.
LEAST_ROWS = 1 << 20


def hot_keys(df: DataFrame, keys: list[str], rows: int, share: int = HOT_SHARE, least: int = 1 << 12) -> DataFrame:
    """The keys with more than ``rows / share`` rows: at most ``share`` rows, whatever the input."""
    return df.groupBy(*keys).count().filter(F.col("count") > max(rows // share, least)).select(*keys)


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", least_rows: int = LEAST_ROWS, least: int = 1 << 12, rows: int | None = None) -> DataFrame:
    """Join ``left`` with ``right``, whose keys are unique, by ``how`` (inner, left, left_semi or left_anti).

    Hot keys of ``left`` meet their rows of ``right`` by broadcast, at most HOT_SHARE rows;
    all others are shuffled.  Null keys match nothing and, for left and left_anti, stay.
    ``left`` is read three times, so give a staged table or a scan.  ``rows``, if given, is about
    the number of its rows and saves counting them.
    """
    rows = left.count() if rows is None else rows
    if rows < least_rows:
        return left.join(right, keys, how)
    hot = F.broadcast(hot_keys(left.dropna(subset=keys), keys, rows, least=least))
    even = left.join(hot, keys, "left_anti").join(right, keys, how)
    hot_rows = left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    return even.unionByName(hot_rows)


def join_unique_rows(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], condition, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Left join by null-safe equality of keys and a condition, where a key has few rows on the right.

    Keys that hold a large share of ``left`` meet their rows by broadcast: at most HOT_SHARE keys;
    all others are shuffled.  ``left`` is read up to three times.
    """

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        on = condition
        for x, y in zip(left_keys, right_keys):
            on = on & F.col(x).eqNullSafe(F.col(y))
        return a.join(b, on, "left")

    def among(df: DataFrame, keys: list[str], hot: DataFrame, how: str) -> DataFrame:
        listed = hot.toDF(*(f"__hot_{i}" for i in range(len(keys))))
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__hot_{i}"))
        return df.join(F.broadcast(listed), on, how)

    rows = left.count()
    if rows < least_rows:
        return joined(left, right)
    hot = hot_keys(left, left_keys, rows)
    even = joined(among(left, left_keys, hot, "left_anti"), right)
    return even.unionByName(joined(among(left, left_keys, hot, "left_semi"), F.broadcast(among(right, right_keys, hot, "left_semi"))))
