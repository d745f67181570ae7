"""Sweep line over intervals: continuous periods and the gaps between them.

Each interval gives a plus event at its start and a minus event at its end.  Equal
places are added up first, then the events are range-partitioned by entity and place, so
that an entity with very many intervals spreads over several partitions.  A partition
counts the active intervals from its first event on; what it needs to know of the
partitions before it is stitched from one state of each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.ranges import by_range, changes, part_of
from strandlake.session import checkpoint_root, prepare


def events(df: DataFrame, keys: Sequence[str], start: Column, end: Column, cancel: bool = True) -> DataFrame:
    """``keys``, ``__pos`` and ``__delta``, the change of the number of active intervals there; with ``cancel``
    places without a change are left out."""
    marks = F.array(*(F.struct(at.cast("bigint").alias("__pos"), F.lit(d).cast("bigint").alias("__delta")) for at, d in ((start, 1), (end, -1))))
    rows = df.filter(start < end).select(*keys, F.explode(marks).alias("__mark")).select(*keys, "__mark.*")
    changes_of = rows.groupBy(*keys, "__pos").agg(F.sum("__delta").alias("__delta"))
    return changes_of.filter("__delta != 0") if cancel else changes_of


def _segments(batches: Iterator, n_keys: int) -> Iterator[tuple]:
    """Runs of events of one entity: its key, whether it goes on from the run before, places and deltas."""
    import numpy as np

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.logical_or.reduce([changes(batch.column(i)) for i in range(n_keys)])
        pos, delta = (batch.column(n_keys + i).to_numpy() for i in range(2))
        starts = np.flatnonzero(new)
        for first, stop in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            key = tuple(batch.column(i)[first].as_py() for i in range(n_keys))
            yield key, key == last, pos[first:stop], delta[first:stop]
            last = key


def _end_state(batches: Iterator, n_keys: int) -> tuple | None:
    """Of a partition: its first and last entity, and of the last one the sum of deltas, the least
    running sum (0 at the start), how many events lead to that, the place of the last boundary
    if that least sum means zero, and the place of the partition's first event."""
    import numpy as np

    first = state = begin = None
    for key, more, pos, delta in _segments(batches, n_keys):
        if first is None:
            first, begin = key, int(pos[0])
        total, least, hits, boundary = state[1:] if more and state else (0, 0, 0, None)
        running = total + np.concatenate([[0], np.cumsum(delta)])
        lowest = int(running.min())
        if lowest <= least:
            hits = (hits if lowest == least else 0) + int((running[1:] == lowest).sum())
            least = lowest
            at = len(running) - 1 - int(np.argmin(running[::-1]))
            boundary = int(pos[min(at, len(pos) - 1)])
        state = (key, int(running[-1]), least, hits, boundary)
    return None if state is None else (first, *state, begin)


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: Column | str, end: Column | str, number: str | None = None) -> DataFrame:
    """The periods that the intervals of each entity cover, and the gaps between them.

    Rows: ``keys``, ``kind`` (``period`` or ``gap``), ``start_pos`` and ``end_pos``
    (exclusive).  Intervals that overlap or touch form one period.  The lower end is the
    start; empty intervals and those with a null end are left out; a null key is a key of
    its own; repeated rows change nothing; an empty table gives an empty result; columns
    other than the keys and ends are not read.  ``number`` names a further column, the
    number of the period within its entity from 1; a gap has that of the period before it.
    """
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    keys, n = list(keys), len(keys)
    prepare(df.sparkSession)
    checkpoint_root(df.sparkSession)
    kinds = [df.schema[k].dataType for k in keys]
    if clash := {"kind", "start_pos", "end_pos", number} & set(keys):
        raise ValueError(f"rename the keys {sorted(clash)}: the result has columns of that name")
    low, high = F.least(start, end), F.greatest(start, end)
    whole = start.isNotNull() & end.isNotNull()
    ordered, found = _ordered_states(events(df.filter(whole), keys, low, high), keys)
    carry: dict[int, tuple] = {}
    at_end: tuple | None = None  # entity, active intervals, last boundary and periods so far
    for part, (first, last, total, least, hits, boundary, _) in found:
        carry[part] = at_end if at_end is not None and at_end[0] == first else (first, 0, None, 0)
        active, before, done = carry[part][1:] if first == last else (0, None, 0)
        at_zero = active + least == 0
        at_end = (last, active + total, boundary if at_zero else before, done + hits if at_zero else done)

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [to_arrow_type(k) for k in kinds] + [pa.string(), pa.int64(), pa.int64()] + [pa.int64()] * bool(number)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*keys, "kind", "start_pos", "end_pos", number][: len(types)])

        part, batches = part_of(batches, n + 2)
        known = carry.get(part)
        begun = False
        active, boundary, done = 0, None, 0
        for key, more, pos, delta in _segments(batches, n):
            if not more:
                active, boundary, done = known[1:] if not begun else (0, None, 0)
            begun = True
            after = active + np.cumsum(delta)
            before = after - delta
            marks = np.flatnonzero((before == 0) != (after == 0))
            for at, opens in zip(pos[marks].tolist(), (before[marks] == 0).tolist()):
                done += not opens
                if boundary is not None:
                    out.append((*key, "gap" if opens else "period", boundary, at, done))
                boundary = at
            active = int(after[-1])
            if len(out) >= 10_000:
                yield batch_of()
                out.clear()
        if out:
            yield batch_of()

    schema = ", ".join(f"`{k}` {t.simpleString()}" for k, t in zip(keys, kinds))
    return ordered.mapInArrow(work, f"{schema}, kind string, start_pos bigint, end_pos bigint" + (f", `{number}` bigint" if number else ""))


def _ordered_states(changes_of: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[tuple[int, tuple]]]:
    """Events in range partitions, and the end state of each partition, in order."""
    n = len(keys)
    # Both passes must see the same partitions, so these are kept in the shared folder, and each row has the number
    # of its own: that of a task is another one where the result is united with others.
    ordered = by_range(changes_of, *keys, "__pos").withColumn("__part", F.spark_partition_id()).checkpoint()

    def states(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, rest = part_of(batches, n + 2)
        state = _end_state(rest, n)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(state)])], names=["part", "state"])

    found = ordered.mapInArrow(states, "part int, state binary").collect()  # one row for each partition
    return ordered, sorted((r.part, pickle.loads(r.state)) for r in found)


def constant_segments(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Stretches of constant cover, split at every start and end: keys, ``seg_start``, ``seg_end``, ``depth``.

    Uncovered stretches, empty intervals and null ends are left out; repeated rows add to the
    depth; a null key is a key of its own.  Range partitions as in ``periods_and_gaps``.
    """
    keys, n = list(keys), len(keys)
    prepare(df.sparkSession)
    checkpoint_root(df.sparkSession)
    ordered, found = _ordered_states(events(df, keys, F.col(start), F.col(end), cancel=False), keys)
    carry: dict[int, int] = {}
    after: dict[int, tuple] = {}  # the first entity and place of the next partition
    at_end: tuple | None = None
    for i, (part, (first, last, total, _, _, _, _)) in enumerate(found):
        carry[part] = at_end[1] if at_end is not None and at_end[0] == first else 0
        at_end = (last, total + (carry[part] if first == last else 0))
        if i + 1 < len(found):
            after[part] = (found[i + 1][1][0], found[i + 1][1][-1])

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        part, batches = part_of(batches, n + 2)
        depth, held = carry.get(part, 0), None  # the last event so far: entity, place and depth after it

        def batch_of(batch, places, ends, depths) -> pa.RecordBatch:
            keep = np.flatnonzero((depths > 0) & (ends >= 0))
            columns = [batch.column(i).take(pa.array(keep)) for i in range(n)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(x[keep]) for x in (places, ends, depths))], names=[*keys, "seg_start", "seg_end", "depth"])

        waiting = None  # the row of ``held``, as a batch of one
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.logical_or.reduce([changes(batch.column(i)) for i in range(n)]) if n else np.arange(batch.num_rows) == 0
            pos, delta = (batch.column(n + i).to_numpy() for i in range(2))
            starts = np.flatnonzero(new)
            first = tuple(batch.column(i)[0].as_py() for i in range(n))
            sums = np.cumsum(delta)
            base = np.concatenate([[0], sums])[starts] * -1
            if held is None:
                base[0] += depth
            elif held[0] == first:
                base[0] += held[2]
                yield batch_of(waiting, np.array([held[1]]), pos[:1], np.array([held[2]]))
            depths = sums + np.repeat(base, np.diff(np.append(starts, len(pos))))
            ends = np.append(np.where(new[1:], -1, pos[1:]), -1)
            yield batch_of(batch, pos, ends, depths)
            last = batch.num_rows - 1
            held, waiting = (tuple(batch.column(i)[last].as_py() for i in range(n)), int(pos[-1]), int(depths[-1])), batch.slice(last, 1)
        if held is not None and part in after and after[part][0] == held[0]:
            yield batch_of(waiting, np.array([held[1]]), np.array([after[part][1]]), np.array([held[2]]))

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return ordered.mapInArrow(work, f"{schema}, seg_start bigint, seg_end bigint, depth bigint")

