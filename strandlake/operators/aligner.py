"""Semi-global alignment of a short sequence to a read, and the tools that need it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import prepare

# Scores of the alignment and limits of the splitting.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 2, -5, 3, 1
MIN_SCORE, MIN_PIECE, MIN_REST, PADDING = 60, 50, 150, 3

_LOW = -(1 << 30)


def best_placement(read: str, probe: str) -> tuple[int, int, int] | None:
    """Start, end and score of the best alignment of the whole ``probe`` within ``read``, whose ends are free.

    A gap of n bases costs GAP_OPEN + (n - 1) GAP_EXTEND.  Ties go to the earliest end, then
    the latest start.  One row of the matrix for each base of the probe, computed at once
    but for gaps in the probe, which are a running maximum.
    """
    if not read or not probe:
        return None
    text = np.frombuffer(read.upper().encode(), dtype=np.uint8)
    n = len(text)
    at = np.arange(n + 1)
    best, gap = np.zeros(n + 1, dtype=np.int64), np.full(n + 1, _LOW, dtype=np.int64)
    start, gap_start = at.copy(), at.copy()
    for base in probe.upper().encode():
        opened = best - GAP_OPEN > gap - GAP_EXTEND
        gap = np.where(opened, best - GAP_OPEN, gap - GAP_EXTEND)
        gap_start = np.where(opened, start, gap_start)
        row, row_start = gap.copy(), gap_start.copy()
        diagonal = best[:-1] + np.where(text == base, MATCH, MISMATCH)
        better = diagonal >= row[1:]
        row[1:] = np.where(better, diagonal, row[1:])
        row_start[1:] = np.where(better, start[:-1], row_start[1:])
        # Extra bases of the read: the best earlier cell, less the cost of the way from it.
        lifted = row + GAP_EXTEND * at
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, at, 0))
        extra = np.append(_LOW, reach[:-1] - GAP_OPEN + GAP_EXTEND - GAP_EXTEND * at[1:])
        use = extra > row
        row_start = np.where(use, row_start[np.append(0, source[:-1])], row_start)
        best, start = np.where(use, extra, row), row_start
    end = int(best.argmax())
    return int(start[end]), end, int(best[end])


def _find(read: str, linkers: list[tuple[str, str]]) -> tuple[int, int, str] | None:
    hits = [(hit[2], flag, hit) for flag, probe in linkers if (hit := best_placement(read, probe)) and hit[2] >= MIN_SCORE]
    if not hits:
        return None
    _, flag, (s, e, _) = max(hits, key=lambda x: x[0])
    return s, e, flag


def split_read(read: str, flag: str, linkers: dict[str, list[tuple[str, str]]]) -> Iterator[tuple[int, int, str]]:
    """Pieces (start, end, flag) of a read between linkers, the earliest linker that is good enough first.

    ``linkers`` gives, for the flag of a piece, the linkers that may end it with the flag of the next one.
    """
    offset, rest = 0, read
    while len(rest) > MIN_REST:
        hit = _find(rest, linkers[flag])
        while hit and hit[0] > MIN_REST and (earlier := _find(rest[: hit[0]], linkers[flag])):
            hit = earlier
        if hit is None:
            yield offset, offset + len(rest), flag
            return
        s, e, after = hit
        yield offset, offset + min(len(rest), s + PADDING), flag
        cut = max(1, e - PADDING)
        offset, rest, flag = offset + cut, rest[cut:], after


def split_reads(reads: DataFrame, linkers: dict[str, list[tuple[str, str]]], seq: str = "seq", flag: str = "flag") -> DataFrame:
    """Split concatenated reads at linkers: ``id``, ``split`` (from 1), ``start``, ``end``, ``flag``, ``piece``.

    Short pieces are dropped before they are numbered.  A read with a null or unknown flag or a
    null or short sequence gives no row.
    """
    prepare(reads.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for read_id, read, first in zip(pdf["id"], pdf[seq], pdf[flag]):
                if not read or first not in linkers:
                    continue
                kept = [x for x in split_read(read, first, linkers) if x[1] - x[0] >= MIN_PIECE]
                rows += [(read_id, i, s, e, f, read[s:e]) for i, (s, e, f) in enumerate(kept, 1)]
            yield pd.DataFrame(rows, columns=["id", "split", "start", "end", "flag", "piece"])

    kind = reads.schema["id"].dataType.simpleString()
    return reads.select("id", seq, flag).mapInPandas(run, f"id {kind}, split bigint, start bigint, end bigint, flag string, piece string")


def error_runs(bits: str, penalty: int = 4, least: int = 10, plus: int = 1) -> list[tuple[int, int]]:
    """All longest stretches (first and last place, from 1) whose score isn't negative, of at least ``least`` places.

    A one scores ``plus``, any other place ``-penalty``.
    """
    scores = np.where(np.frombuffer(bits.encode(), dtype=np.uint8) == ord("1"), plus, -penalty)
    sums = np.concatenate([[0], np.cumsum(scores)])
    ahead = np.maximum.accumulate(sums[::-1])[::-1]  # the highest sum from here on
    lowest = np.minimum.accumulate(sums)
    records = np.flatnonzero(np.append(True, sums[1:] < lowest[:-1]))
    # ``ahead`` falls, so the last place with a sum of at least x is found by bisection.
    last = len(sums) - np.searchsorted(ahead[::-1], sums[records], side="left") - 1
    out: dict[int, int] = {}
    for i, j in zip(records.tolist(), last.tolist()):
        if j not in out and j - i >= least:
            out[j] = i
    return [(i + 1, j) for j, i in sorted(out.items(), key=lambda x: x[1])]


def with_error_runs(df: DataFrame, bits: str, penalty: int = 4, least: int = 10) -> DataFrame:
    """Add ``error_runs``, the stretches of ``bits`` as text ``first-last`` joined by commas; null for null."""
    prepare(df.sparkSession)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else ",".join(f"{i}-{j}" for i, j in error_runs(x, penalty, least)) for x in s], dtype=object)

    return df.withColumn("error_runs", run(bits))


def error_bits(alignment: Column | str, expected: Column | str | None = None) -> Column:
    """Error bits of an alignment string (``|`` match, ``*`` not): 1 for an error, 0 for a match.

    With ``expected``, a string of the same length with 1 where base qualities explain an
    error, such places count as matches.
    """
    alignment = F.col(alignment) if isinstance(alignment, str) else alignment
    plain = F.translate(alignment, "|*", "01")
    if expected is None:
        return plain
    expected = F.col(expected) if isinstance(expected, str) else expected
    pairs = F.zip_with(F.split(plain, ""), F.split(expected, ""), lambda a, b: F.when((a == "1") & (b.isNull() | (b != "1")), "1").otherwise("0"))
    return F.when(F.length(plain) > 0, F.array_join(pairs, "")).otherwise("")


def alignment_ops(alignment: Column | str, query: Column | str, target: Column | str) -> Column:
    """Operations of an alignment, one letter each: M, S, I (gap in the target) or D (gap in the query)."""
    q, t = (F.split(F.col(c) if isinstance(c, str) else c, "") for c in (query, target))
    letters = F.zip_with(q, t, lambda a, b: F.when(a == "-", "D").when(b == "-", "I").when(F.upper(a) == F.upper(b), "M").otherwise("S"))
    return F.array_join(letters, "")


def spare_homopolymers(bits: Column | str, query: Column | str, target: Column | str) -> Column:
    """Error bits without those of gaps within a run of one base: an inserted or missing base that equals
    the one before or behind it in the same sequence counts as a match."""
    bits, q, t = (F.col(c) if isinstance(c, str) else c for c in (bits, query, target))
    base = F.upper(F.when(F.substring(q, 1, 1) == "", F.lit("")).otherwise(q))
    other = F.upper(t)
    letters = F.filter(F.split(bits, ""), lambda x: x != "")
    at = lambda c, i: F.substring(c, i.cast("int"), F.lit(1))

    def same(c: Column, i: Column) -> Column:
        return (at(c, i) == at(c, i + 1)) | ((i > 1) & (at(c, i) == at(c, F.greatest(i - 1, F.lit(1)))))

    spared = F.transform(letters, lambda x, i: F.when((at(other, i + 1) == "-") & same(base, i + 1) | (at(base, i + 1) == "-") & same(other, i + 1), F.lit("0")).otherwise(x))
    return F.when(bits.isNotNull(), F.array_join(spared, ""))


def has_error_run(df: DataFrame, bits: str, penalty: int = 4, least: int = 10) -> DataFrame:
    """Add ``has_run``: whether a stretch of at least ``least`` places has a score that isn't negative."""
    parts = F.filter(F.split(F.col(bits), ""), lambda x: x != "")
    step = lambda x: F.when(x == "1", 1).otherwise(-penalty)
    # The sums so far; a place fits if the sum there is at least the lowest one that lies ``least`` places back.
    sums = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + step(x))))
    low = F.transform(sums, lambda x, i: F.when(i >= least, F.array_min(F.slice(sums, F.lit(1), F.greatest(i - least + 1, F.lit(1)))) <= x).otherwise(False))
    return df.withColumn("has_run", F.exists(low, lambda x: x))
