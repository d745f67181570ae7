"""Range partitions of ordered rows, and what is stitched at their boundaries.

Rows are partitioned by ranges of a composite key and a secondary order, with quantiles
that Spark samples, so that a key with very many rows spreads over several partitions.
Each partition is folded in order; the partial states of the keys at its ends are
stitched afterwards.  There are at most as many such states as partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import checkpoint_root, prepare, stage

#: Bytes of the scanned input, compressed as it is, that one range partition stands for.
RANGE_BYTES = 32 << 20
#: A source whose size Spark doesn't know counts as larger than this.
UNKNOWN_BYTES = 1 << 60
#: Range partitions at most; each gives one state to the driver.
MOST_RANGES = 1 << 14


def range_count(df: DataFrame) -> int:
    """Range partitions for ``df``: ``spark.sql.shuffle.partitions``, or more if its sources are large."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < UNKNOWN_BYTES)
    return max(least, min(MOST_RANGES, -(-size // RANGE_BYTES)))


def by_range(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` in range partitions of ``order``, each one sorted."""
    return df.repartitionByRange(range_count(df), *order).sortWithinPartitions(*order)


_STATE = "part int, edge boolean, field string, key string, n_rows bigint, n_tags bigint, first_tag string, last_tag string"


def changes(column):
    """Which values of an Arrow array differ from the one before them; nulls are equal."""
    import numpy as np
    import pyarrow.compute as pc

    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        differ = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        out[1:] = differ | (nulls[1:] != nulls[:-1])
    return out


def part_of(batches: Iterator, column: int) -> tuple[int | None, Iterator]:
    """The number of the range partition, which all its rows have in a column, and its batches with rows."""
    rest = (batch for batch in batches if batch.num_rows)
    first = next(rest, None)
    return (None, rest) if first is None else (first.column(column)[0].as_py(), chain([first], rest))


def key_states(rows: DataFrame) -> DataFrame:
    """Partial states of sorted rows (``field``, ``key``, ``tag``): one for each partition and key."""
    prepare(rows.sparkSession)

    def fold(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["field", "key", "n_rows", "n_tags", "first_tag", "last_tag"]
        kept: list | None = None  # the state of the last key so far

        begun = False

        def batch_of(states: list, last: bool = False) -> pa.RecordBatch:
            nonlocal begun
            edge = [False] * len(states)
            edge[0], begun = not begun, True
            edge[-1] = edge[-1] or last
            columns = zip(*states)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(states), pa.int32()), pa.array(edge), *arrays], names=["part", "edge", *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            field, key, tag = (batch.column(i) for i in range(3))
            new_key = changes(field) | changes(key)
            has_tag = tag.is_valid().to_numpy(zero_copy_only=False)
            new_tag = (new_key | changes(tag)) & has_tag
            starts = np.flatnonzero(new_key)
            stops = np.append(starts[1:], batch.num_rows) - 1
            tags = np.add.reduceat(new_tag.astype(np.int64), starts)
            states = [
                list(x)
                for x in zip(
                    field.take(pa.array(starts)).to_pylist(),
                    key.take(pa.array(starts)).to_pylist(),
                    (stops - starts + 1).tolist(),
                    tags.tolist(),
                    # Null tags sort first, so the last tag of a key is null only if all are.
                    _first_valid(tag, has_tag, starts, stops),
                    tag.take(pa.array(stops)).to_pylist(),
                )
            ]
            if kept is not None:
                states = [kept, *states] if kept[:2] != states[0][:2] else [_join(kept, states[0]), *states[1:]]
            kept = states.pop()
            if states:
                yield batch_of(states)
        if kept is not None:
            yield batch_of([kept], last=True)

    return rows.select("field", "key", "tag").mapInArrow(fold, _STATE)


def _first_valid(tag, has_tag, starts, stops) -> list:
    import numpy as np
    import pyarrow as pa

    valid = np.flatnonzero(has_tag)
    at = np.searchsorted(valid, starts)
    first = np.append(valid, len(tag))[np.minimum(at, len(valid))]
    inside = first <= stops
    return tag.take(pa.array(np.where(inside, np.minimum(first, len(tag) - 1), 0), mask=~inside)).to_pylist()


def _join(a: list, b: list) -> list:
    """The state of two neighbouring stretches of one key."""
    same = a[5] is not None and a[5] == b[4]
    return [a[0], a[1], a[2] + b[2], a[3] + b[3] - same, a[4] if a[4] is not None else b[4], b[5] if b[5] is not None else a[5]]


def stitch_keys(states: DataFrame) -> DataFrame:
    """Counts of each key: partial states in the order of partitions, a tag on both sides of a boundary counting once.

    ``edge`` marks the first and last state of a partition, at most two for each; only these
    may have parts elsewhere, so only these are shuffled.
    """
    order = Window.partitionBy("field", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("last_tag", ignorenulls=True).over(order)
    again = F.coalesce((before == F.col("first_tag")).cast("int"), F.lit(0))
    edges = states.filter("edge").withColumn("again", again).groupBy("field", "key")
    stitched = edges.agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_tags") - F.col("again")).alias("n_tags"))
    return states.filter("NOT edge").select("field", "key", "n_rows", "n_tags").unionByName(stitched)


def counts_by_key(df: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows and distinct tags of every key, without long tasks for keys with very many rows.

    ``fields`` gives for each field name the expressions of its key and its tag.  Rows:
    ``field``, ``key_value``, ``n_rows``, ``n_tags``, ``share`` (of the ``total`` rows with a key in
    that field), ``total``.  A null key is left out, a null tag counts as a row but not as a tag;
    repeated rows all count; an empty table gives an empty result; other columns are not
    read.  Even one (key, tag) pair with most rows is spread, by the number of the row.
    """
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), k.cast("string").alias("key"), t.cast("string").alias("tag")) for f, (k, t) in fields.items())))
    rows = df.select(one.alias("x"), F.monotonically_increasing_id().alias("row")).select("x.*", "row").filter("key is not null")
    states = stage(key_states(by_range(rows, "field", "key", "tag", "row")), "key-states")  # one row for each key and partition
    counts = stitch_keys(states)
    totals = counts.groupBy("field").agg(F.sum("n_rows").alias("total"))  # one row for each field
    return counts.join(F.broadcast(totals), "field").select(
        "field", F.col("key").alias("key_value"), "n_rows", "n_tags", (F.col("n_rows") / F.col("total")).alias("share"), "total"
    )


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 1 in an order that should be total; no task sees more than its range partition."""
    ranged = stage(by_range(df, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").count()  # one row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, (within + F.col("_before")).cast("bigint")).drop("_part", "_before")


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` (bigint, not null) over the rows of the same key that come before in ``order``.

    Rows are range-partitioned by key and order, so that a key with very many rows spreads
    over partitions; each gives the sum of its last key to the driver, which stitches them.  The
    order should be total; a null key is a key of its own; all columns stay.
    """
    prepare(df.sparkSession)
    checkpoint_root(df.sparkSession)
    columns = df.columns
    at, where, n = columns.index(value), [columns.index(k) for k in keys], len(keys)
    # Both passes must see the same partitions, so these are kept in the shared folder, and each row has the number of its own.
    ordered = by_range(df, *keys, *order).withColumn("__part", F.spark_partition_id()).checkpoint()

    def starts_of(batch) -> list[int]:
        import numpy as np

        new = np.logical_or.reduce([changes(batch.column(i)) for i in where]) if n else np.arange(batch.num_rows) == 0
        return np.flatnonzero(new).tolist()

    def key_at(batch, row: int) -> tuple:
        return tuple(batch.column(i)[row].as_py() for i in where)

    def states(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        first = last = None
        total = 0
        part, batches = part_of(batches, len(columns))
        for batch in batches:
            if batch.num_rows:
                head = starts_of(batch)[-1]
                values = batch.column(at).to_numpy()
                if first is None:
                    first = key_at(batch, 0)
                own = key_at(batch, batch.num_rows - 1)
                total = (total if own == last and head == 0 else 0) + int(values[head:].sum())
                last = own
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps((first, last, total))])], names=["part", "state"])

    import pickle

    carry: dict[int, tuple] = {}
    done: tuple | None = None  # the last key so far and its sum
    found = ordered.mapInArrow(states, "part int, state binary").collect()  # one row for each partition
    for part, (first, last, total) in sorted((r.part, pickle.loads(r.state)) for r in found):
        if done is not None and done[0] == first:
            carry[part] = done
        done = (last, total + (done[1] if done is not None and done[0] == last == first else 0))

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        part, batches = part_of(batches, len(columns))
        last, total = carry.get(part, (None, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(at).to_numpy()
            before = np.concatenate([[0], np.cumsum(values)[:-1]])
            starts = np.array(starts_of(batch))
            sizes = np.diff(np.append(starts, batch.num_rows))
            base = -before[starts]
            if key_at(batch, 0) == last:
                base[0] += total
            before = before + np.repeat(base, sizes)
            last, total = key_at(batch, batch.num_rows - 1), int(before[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(before.astype(np.int64))], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` bigint"
    return ordered.mapInArrow(work, schema)
