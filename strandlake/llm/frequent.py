"""Most frequent values of huge columns in bounded memory, by error-correcting codes.

A value's 64-bit id is hashed to a group and written as a Reed-Solomon codeword.  Each
partition counts, for each group and position of the codeword, how often each symbol came.
A frequent value dominates its group at every position, so its id is decoded from the
symbols that are heavy there, wrong or missing ones being corrected.  The candidates are
then counted exactly.  What the counts leave unexplained proves whether a frequent value
may still hide; rows of such groups, if any, are counted exactly too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.rolling import mix
from strandlake.session import prepare, stage

#: Code over the integers modulo 257: 8 data symbols, the bytes of an id, in 16 positions.
PRIME, DATA, LENGTH = 257, 8, 16
#: Independent assignments of ids to groups, and groups of each.
TURNS, GROUPS = 2, 256
#: Ids that are counted at once.
AT_ONCE = 1 << 17

_POINTS = np.array([[pow(x, d, PRIME) for x in range(1, LENGTH + 1)] for d in range(DATA)], dtype=np.int64)


def codewords(ids: np.ndarray) -> np.ndarray:
    """The symbols of unsigned 64-bit ids, one row each."""
    data = ids.astype("<u8").view(np.uint8).reshape(-1, DATA).astype(np.int64)
    return (data @ _POINTS) % PRIME


def group_of(ids: np.ndarray, turn: int) -> np.ndarray:
    return (mix(ids + np.uint64(turn + 1)) % np.uint64(GROUPS)).astype(np.int64)


def decode(symbols: list[int | None]) -> int | None:
    """The id whose codeword is nearest to the symbols (None: missing); None if too many are wrong."""
    known = [(x, y) for x, y in enumerate(symbols, 1) if y is not None]
    for wrong in range((len(known) - DATA) // 2 + 1):
        # Find E of degree `wrong` with leading 1 and Q of degree below DATA + wrong, so that Q(x) = y E(x) everywhere.
        rows = [
            [pow(x, d, PRIME) for d in range(DATA + wrong)] + [-y * pow(x, d, PRIME) % PRIME for d in range(wrong)] + [y * pow(x, wrong, PRIME) % PRIME]
            for x, y in known
        ]
        solved = _solve(rows, DATA + 2 * wrong)
        if solved is None:
            continue
        quotient = _divide(solved[: DATA + wrong], [*solved[DATA + wrong :], 1])
        if quotient is not None and all(c < 256 for c in quotient):
            return int.from_bytes(bytes(quotient), "little")
    return None


def _solve(rows: list[list[int]], unknown: int) -> list[int] | None:
    """One solution of linear equations modulo PRIME, free unknowns being 0."""
    rows, pivots = [r[:] for r in rows], []
    for column in range(unknown):
        at = next((i for i in range(len(pivots), len(rows)) if rows[i][column]), None)
        if at is None:
            continue
        top = len(pivots)
        rows[top], rows[at] = rows[at], rows[top]
        inverse = pow(rows[top][column], -1, PRIME)
        rows[top] = [v * inverse % PRIME for v in rows[top]]
        for i, row in enumerate(rows):
            if i != top and row[column]:
                factor = row[column]
                rows[i] = [(v - factor * w) % PRIME for v, w in zip(row, rows[top])]
        pivots.append(column)
    if any(row[-1] for row in rows[len(pivots) :]):
        return None
    out = [0] * unknown
    for row, column in zip(rows, pivots):
        out[column] = row[-1]
    return out


def _divide(top: list[int], by: list[int]) -> list[int] | None:
    """Quotient of two polynomials, lowest power first and ``by`` with leading 1, if nothing is left over."""
    top, out = top[:], [0] * (len(top) - len(by) + 1)
    for at in range(len(out) - 1, -1, -1):
        out[at] = top[at + len(by) - 1]
        for i, c in enumerate(by):
            top[at + i] = (top[at + i] - out[at] * c) % PRIME
    return None if any(top[: len(by) - 1]) else out


def _sketch(ids: DataFrame, share: float, fields: int) -> DataFrame:
    """Merged counters ``field, turn, group, place, symbol, n``; rows of ``turn`` -1 have the number of values.

    A partition leaves out counters below a quarter of ``share`` of its values, so that it gives
    at most 4 / share of them for each turn and place, and no counter loses more than that in all.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cells = GROUPS * PRIME
        counts = np.zeros((fields, TURNS, LENGTH, cells), dtype=np.int32)
        seen = np.zeros(fields, dtype=np.int64)

        def add(held: list) -> None:
            field = np.concatenate([x.column(0).to_numpy() for x in held])
            ids = np.concatenate([x.column(1).to_numpy() for x in held]).view(np.uint64)
            for f in range(fields):
                own = ids[field == f]
                seen[f] += len(own)
                symbols = codewords(own)
                for turn in range(TURNS):
                    base = group_of(own, turn) * PRIME
                    for place in range(LENGTH):
                        counts[f, turn, place] += np.bincount(base + symbols[:, place], minlength=cells).astype(np.int32)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= AT_ONCE:
                add(held)
                held, rows = [], 0
        if held:
            add(held)
        names = ["field", "turn", "grp", "place", "symbol", "n"]
        for f in range(fields):
            if seen[f]:
                turn, place, cell = np.nonzero(counts[f] >= max(1.0, share * seen[f] / 4))
                kept = [np.full(len(cell), f), turn, cell // PRIME, place, cell % PRIME, counts[f][turn, place, cell]]
                total = [f, -1, 0, 0, 0, seen[f]]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(x, t).astype(np.int64)) for x, t in zip(kept, total)], names=names)

    parts = ids.mapInArrow(work, "field bigint, turn bigint, grp bigint, place bigint, symbol bigint, n bigint")
    return parts.groupBy("field", "turn", "grp", "place", "symbol").agg(F.sum("n").alias("n"))


class _Heavy:
    """The heavy symbols of one field, at most 4 / (3 share) for each turn and place."""

    def __init__(self, total: int, share: float):
        self.least = 0.75 * share * total
        self.n: dict[tuple[int, int], list[dict[int, int]]] = {}

    def add(self, turn: int, group: int, place: int, symbol: int, n: int) -> None:
        self.n.setdefault((turn, group), [{} for _ in range(LENGTH)])[place][symbol] = n

    def full(self, key: tuple[int, int]) -> bool:
        """Whether a frequent value may be in this group: every place has a heavy symbol."""
        return all(any(n >= self.least for n in place.values()) for place in self.n[key])

    def take(self, one: int, n: int | None = None) -> int:
        """Subtract a value from its groups, ``n`` times or as often as its rarest symbol came."""
        word = codewords(np.array([one], dtype=np.uint64))[0].tolist()
        keys = [(turn, int(group_of(np.array([one], dtype=np.uint64), turn)[0])) for turn in range(TURNS)]
        if n is None:
            n = max(sorted(place.get(s, 0) for place, s in zip(self.n.get(key, [{}] * LENGTH), word))[LENGTH // 4] for key in keys)
        for key in keys:
            for place, symbol in zip(self.n.get(key, []), word):
                if symbol in place:
                    place[symbol] -= n
        return n

    def candidates(self) -> dict[int, int]:
        """Ids decoded, with a count; a found one is subtracted, which may clear a group of several."""
        found: dict[int, int] = {}
        again = True
        while again:
            again = False
            for key in sorted(self.n):
                while self.full(key):
                    tops = [max(place.items(), key=lambda x: x[1], default=(0, 0)) for place in self.n[key]]
                    one = decode([symbol if n >= self.least else None for symbol, n in tops])
                    if one is None or one in found or group_of(np.array([one], dtype=np.uint64), key[0])[0] != key[1]:
                        break
                    found[one] = self.take(one)
                    again = True
        return found


def frequent_values(df: DataFrame, columns: dict[str, object], share: float) -> DataFrame:
    """The values that at least ``share`` of the rows with a value in a column have.

    ``columns`` gives a string expression for each field name.  Rows: ``field``,
    ``key_value``, ``n`` (exact), ``n_sketch`` (the count by the sketch alone, null for a
    value that only the exact fallback found) and ``n_values``.  Null is no value; the
    empty string is one; repeated rows all count; an empty table gives an empty result;
    other columns are not read.  The result is whole: see the module's text.

    ``df`` is read twice.  Memory: a task has TURNS x LENGTH x GROUPS x PRIME counters for
    each field; the driver gets at most 6 / share of them for each field, turn and place.
    """
    prepare(df.sparkSession)
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    spark, names = df.sparkSession, list(columns)
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("field"), c.alias("value")) for i, c in enumerate(columns.values())))).alias("x"))
    values = stacked.select("x.field", "x.value").filter("value is not null").withColumn("id", F.xxhash64("value"))

    # Staged, as its totals and its heavy counters are read apart; at most 6 / share rows a partition, field, turn and place.
    merged = stage(_sketch(values.select("field", "id"), share, len(names)), "sketch")
    totals_of = merged.filter("turn = -1").select("field", F.col("n").alias("total"))
    heavy_rows = merged.filter("turn >= 0").join(F.broadcast(totals_of), "field").filter(F.col("n") >= F.lit(0.75 * share) * F.col("total"))
    rows = merged.filter("turn = -1").unionByName(heavy_rows.drop("total")).collect()  # bounded by the share, see above
    totals = {r.field: r.n for r in rows if r.turn == -1}

    def heavy() -> dict[int, _Heavy]:
        out = {f: _Heavy(n, share) for f, n in totals.items()}
        for r in rows:
            if r.turn >= 0:
                out[r.field].add(r.turn, r.grp, r.place, r.symbol, r.n)
        return out

    found = {(f, one): n for f, x in heavy().items() for one, n in x.candidates().items()}
    signed = lambda one: one - (1 << 64) if one >= 1 << 63 else one
    chosen = spark.createDataFrame([(f, signed(one), n) for (f, one), n in found.items()], "field bigint, id bigint, n_sketch bigint")
    counted = values.join(F.broadcast(chosen), ["field", "id"]).groupBy("field", "id", "n_sketch", "value").agg(F.count("*").alias("n"))
    # Equal ids of several values would only add rows; the frequent ones among them are at most 1 / share.
    least = F.create_map(*(F.lit(x) for f, n in totals.items() for x in (f, float(share * n)))) if totals else None
    exact = [] if least is None else counted.filter(F.col("n") >= F.element_at(least, F.col("field")) * (1 - 1e-12)).collect()

    # What the exact counts don't explain shows the groups in which a frequent value may still hide.
    left = heavy()
    for r in exact:
        left[r.field].take(r.id & ((1 << 64) - 1), r.n)
    open_groups = {f: min(([g for t, g in x.n if t == turn and x.full((t, g))] for turn in range(TURNS)), key=len) for f, x in left.items()}
    turn_of = {f: next(t for t in range(TURNS) if [g for u, g in x.n if u == t and x.full((u, g))] == open_groups[f]) for f, x in left.items()}
    if any(open_groups.values()):
        exact += _count_groups(values, open_groups, turn_of, {(r.field, r.value) for r in exact}, totals, share)
    result = [(names[r[0]], r.value, r.n, r.n_sketch, totals[r[0]]) for r in exact if r.n >= share * totals[r[0]] * (1 - 1e-12)]
    return spark.createDataFrame(result, "field string, key_value string, n bigint, n_sketch bigint, n_values bigint")


def _count_groups(values: DataFrame, groups: dict[int, list[int]], turn_of: dict[int, int], known: set, totals: dict[int, int], share: float) -> list:
    """Exact counts of the frequent values of some groups, but those that are known."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            field, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for f, some in groups.items():
                if some:
                    keep |= (field == f) & np.isin(group_of(ids, turn_of[f]), some)
            yield batch.filter(pa.array(keep))

    counts = values.mapInArrow(work, values.schema).groupBy("field", "value").agg(F.count("*").alias("n"))
    out = []
    for f, total in totals.items():
        rows = counts.filter((F.col("field") == f) & (F.col("n") >= share * total * (1 - 1e-12)))
        out += [r for r in rows.withColumn("n_sketch", F.lit(None).cast("bigint")).collect() if (f, r.value) not in known]  # at most 1 / share
    return out
