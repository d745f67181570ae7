"""References to records that do not exist, or not at the time of the reference.

References are first reduced to one row for each key and day, with their number and the
first and last time.  By these numbers the keys that hold a large share of all references
are heavy.  A heavy key whose target rows are few, which is checked, meets them by
broadcast, reference by reference where these are read, so none of them is shuffled.  All
other keys meet their target rows by a shuffle, a day at a time; only the days on which a
target comes or goes between two references are looked at one reference at a time, by key
and day.  The orphans of both ways are put together.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.sweep import periods_and_gaps
from strandlake.session import stage, unstage

#: A target row that was never removed holds up to this time, in microseconds.
FOREVER = 1 << 62
#: A key with more than one in so many references is heavy; there are at most so many heavy keys.
HEAVY_SHARE = 256
#: References up to which no key is heavy.
LEAST_REFERENCES = 256
#: Periods of the target rows of a heavy key up to which they are broadcast: at most HEAVY_SHARE times as many rows.
BROADCAST_PERIODS = 1000
#: Slices of the references of one key and day, where these are a large share and could not be met by broadcast.
SLICES = 64

_KEY = ["ref", "key"]
_DAY = [*_KEY, "day"]


def micros(c: Column | str) -> Column:
    """A timestamp, with or without zone, as microseconds since 1970 UTC."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", epoch, F.col(c) if isinstance(c, str) else c)


def validity(targets: DataFrame) -> DataFrame:
    """When a target row of a key holds: ``ref``, ``key``, ``first_loaded``, ``s`` and ``e`` of each period.

    ``targets`` has ``ref``, ``key``, ``loaded`` and ``removed`` (microseconds).  A key whose rows
    never hold has one row with null ``s`` and ``e``.
    """
    known = targets.filter("key is not null").select(*_KEY, "loaded", F.coalesce("removed", F.lit(FOREVER)).alias("removed"))
    first = known.groupBy(*_KEY).agg(F.min("loaded").alias("first_loaded"))
    periods = periods_and_gaps(known.filter("loaded < removed"), _KEY, "loaded", "removed").filter("kind = 'period'")
    return first.join(periods.select(*_KEY, F.col("start_pos").alias("s"), F.col("end_pos").alias("e")), _KEY, "left")


def _day(t: str) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(t) / 86_400_000_000).cast("int"))


def heavy_keys(daily: DataFrame, periods: DataFrame, limit: int) -> list[tuple]:
    """Keys with more than ``limit`` references and few target periods: at most HEAVY_SHARE, as (ref, key)."""
    many = daily.groupBy(*_KEY).agg(F.sum("n").alias("_n")).filter(F.col("_n") > limit).select(*_KEY)
    held = periods.join(F.broadcast(many), _KEY, "left_semi").groupBy(*_KEY).count()
    few = many.join(held, _KEY, "left").filter(F.coalesce("count", F.lit(0)) <= BROADCAST_PERIODS)
    return [tuple(r) for r in few.select(*_KEY).collect()]  # at most HEAVY_SHARE rows


def _by_broadcast(timed: DataFrame, periods: DataFrame, heavy: DataFrame) -> DataFrame:
    """Orphans of heavy keys: every reference meets the periods of its key where it is read."""
    period = F.when(F.col("s").isNotNull(), F.struct("s", "e"))
    known = periods.withColumn("known", F.lit(True))
    lookup = heavy.join(known, _KEY, "left").groupBy(*_KEY).agg(F.min("first_loaded").alias("first"), F.max("known").alias("known"), F.collect_list(period).alias("periods"))
    holds = F.exists("periods", lambda p: (p["s"] <= F.col("t")) & (p["e"] > F.col("t")))
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("t") < F.col("first"), "late").when(~holds, "deleted")
    met = timed.join(F.broadcast(lookup), _KEY).select(*_DAY, reason.alias("reason")).filter("reason is not null")
    return met.groupBy(*_DAY, "reason").agg(F.count("*").alias("n"))


def _by_shuffle(timed: DataFrame, daily: DataFrame, periods: DataFrame, limit: int, scratch: list[DataFrame]) -> DataFrame:
    """Orphans of all other keys: days first, then the references of days within which a target comes or goes."""
    known = periods.groupBy(*_KEY).agg(F.min("first_loaded").alias("first"), F.lit(True).alias("known"))
    spans = periods.filter("s is not null").select(*_KEY, "s", "e")
    other = spans.withColumnsRenamed({"ref": "t_ref", "key": "t_key"})
    touches = (F.col("ref") == F.col("t_ref")) & (F.col("key") == F.col("t_key")) & (F.col("s") <= F.col("t1")) & (F.col("e") > F.col("t0"))
    states = daily.join(other, touches, "left").groupBy(*_DAY, "t0", "t1", "n").agg(
        F.max(F.coalesce((F.col("s") <= F.col("t0")) & (F.col("e") > F.col("t1")), F.lit(False))).alias("covered"), F.count("s").alias("touched")
    )
    states = states.filter("not covered").join(known, _KEY, "left")
    # All references of such a day have one reason.
    whole = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("t1") < F.col("first"), "late")
        .when((F.col("touched") == 0) & (F.col("first").isNull() | (F.col("t0") >= F.col("first"))), "deleted")
    )
    states = stage(states.select(*_DAY, "n", "first", whole.alias("reason")), "uncovered-days")
    scratch.append(states)
    by_day = states.filter("reason is not null").select(*_DAY, "reason", "n")

    mixed = states.filter("reason is null").select(*_DAY, "first", "n")
    large = F.broadcast(mixed.filter(F.col("n") > limit).drop("n").withColumn("large", F.lit(True)))  # at most HEAVY_SHARE rows
    small = mixed.filter(F.col("n") <= limit).drop("n").withColumn("large", F.lit(False))
    rows = timed.join(large, _DAY).unionByName(timed.join(large, _DAY, "left_anti").join(small, _DAY))
    single = stage(rows.groupBy(*_DAY, "t", "first", "large").agg(F.count("*").alias("n")), "single-references")
    scratch.append(single)
    late = single.filter("t < first").groupBy(*_DAY).agg(F.sum("n").alias("n")).select(*_DAY, F.lit("late").alias("reason"), "n")
    # No period covers all references of such a day, so each one that holds for some of them begins or ends on that day.
    ends = spans.select(*_KEY, F.explode(F.array_distinct(F.array(_day("s"), F.when(F.col("e") < FOREVER, _day("e"))))).alias("day"), "s", "e").filter("day is not null")
    slices = F.when(F.coalesce("large", F.lit(False)), F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0)))
    ends = ends.join(large.drop("first"), _DAY, "left").withColumn("slice", F.explode(slices)).drop("large")
    sliced = single.filter("first is null or t >= first").withColumn("slice", F.when(F.col("large"), F.pmod(F.hash("t"), F.lit(SLICES))).otherwise(0))
    on = [sliced[c].eqNullSafe(ends[c]) if c == "ref" else sliced[c] == ends[c] for c in (*_DAY, "slice")]
    deleted = sliced.join(ends, [*on, F.col("s") <= F.col("t"), F.col("e") > F.col("t")], "left_anti")
    deleted = deleted.groupBy(*_DAY).agg(F.sum("n").alias("n")).select(*_DAY, F.lit("deleted").alias("reason"), "n")
    return by_day.unionByName(late).unionByName(deleted)


def orphan_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """The references for which no target row with their key holds.

    ``references``: ``ref`` (which reference it is), ``key``, ``t`` (microseconds).
    ``targets``: ``ref``, ``key``, ``loaded``, ``removed`` (microseconds).  A target row holds if
    loaded <= t and it is not removed or removed later than t.

    Rows: ``ref``, ``day`` (a date, UTC), ``key``, ``reason`` (``missing``: no target row has the
    key; ``late``: all are loaded after t; else ``deleted``) and ``n``, the number of references,
    repeated ones included; each combination of the first four once.  Null keys are no
    references and no targets; a reference with a null time has no day and is left out; a
    target row with a null ``loaded`` never holds, but its key is not missing; repeated target
    rows change nothing; empty tables are allowed; other columns are not read.
    """
    spark = references.sparkSession
    timed = references.filter("ref is not null and key is not null and t is not null").select(*_KEY, "t", _day("t").alias("day"))
    daily = stage(timed.groupBy(*_DAY).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n")), "references-by-day")
    periods = stage(validity(targets), "validity")
    scratch = [daily, periods]
    limit = max((daily.agg(F.sum("n")).first()[0] or 0) // HEAVY_SHARE, LEAST_REFERENCES)
    heavy = heavy_keys(daily, periods, limit)
    if heavy:
        listed = F.broadcast(spark.createDataFrame(heavy, daily.select(*_KEY).schema))
        cold = timed.join(listed, _KEY, "left_anti"), daily.join(listed, _KEY, "left_anti")
        found = _by_shuffle(*cold, periods, limit, scratch).unionByName(_by_broadcast(timed, periods, listed))
    else:
        found = _by_shuffle(timed, daily, periods, limit, scratch)
    found = stage(found.select("ref", "day", "key", "reason", "n"), "orphans")
    for df in scratch:
        unstage(df)
    return found


def orphan_counts(orphans: DataFrame, by: Iterable[str] = ("ref", "day", "reason")) -> DataFrame:
    """Orphans for each reference, day and reason: ``n_keys`` (distinct keys) and ``n_references``."""
    return orphans.groupBy(*by).agg(F.countDistinct("key").alias("n_keys"), F.sum("n").alias("n_references"))
