"""Functions over whole groups without a call of pandas for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

from strandlake.operators.ranges import changes
from strandlake.session import prepare

#: Rows of a batch that is handed back.
BATCH = 5_000


def map_groups(df: DataFrame, keys: Sequence[str], function: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str, parts: int | None = None) -> DataFrame:
    """Rows that ``function(key, rows)`` gives for each group, in the columns of ``schema``.

    Rows come as tuples of the columns that are no keys, in the order of ``df``.  Groups
    are shuffled together and sorted, and a partition is read as a stream, so very many
    small groups cost little.  One group is in memory at a time.  ``parts`` is the number of
    partitions where groups take long for their size, so that none are put together.
    """
    prepare(df.sparkSession)
    others = [c for c in df.columns if c not in keys]
    n = len(keys)
    kinds = StructType.fromDDL(schema)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(kinds)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        stream = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
        out: list[tuple] = []
        for key, rows in groupby(stream, key=lambda row: row[:n]):
            out += function(key, [row[n:] for row in rows])
            if len(out) >= BATCH:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    ordered = df.select(*keys, *others).repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(work, kinds)


def keep_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], read: Sequence[str], function: Callable[[tuple, list[tuple]], Sequence[int]], drop: Sequence[str] = ()) -> DataFrame:
    """The rows of each group at the places that ``function(key, rows)`` gives, without the columns in ``drop``.

    Rows come in ``order``, as tuples of the columns in ``read``; the other columns never become Python objects.
    One group is in memory at a time; a null key is a key of its own.
    """
    prepare(df.sparkSession)
    columns = df.columns
    at_key, at_read, out = ([columns.index(c) for c in some] for some in (keys, read, [c for c in columns if c not in drop]))

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list = []
        last: tuple = ()

        def kept() -> Iterator:
            table = pa.Table.from_batches(held)
            rows = list(zip(*(table.column(i).to_pylist() for i in at_read)))
            yield from table.select(out).take(pa.array(function(last, rows), pa.int64())).to_batches(BATCH)

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(np.logical_or.reduce([changes(batch.column(i)) for i in at_key])).tolist()
            for first, stop in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(batch.column(i)[first].as_py() for i in at_key)
                if held and key != last:
                    yield from kept()
                    held = []
                held.append(batch.slice(first, stop - first))
                last = key
        if held:
            yield from kept()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(work, StructType([df.schema[c] for c in columns if c not in drop]))
