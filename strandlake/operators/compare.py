"""Structural comparison of two transcripts on the same strand.

Exons are lists of (start, end), 0-based and half-open, in ascending order.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.session import prepare_active

Exons = Sequence[tuple[int, int]]

#: No limit on the difference of the outer ends.
ANY = 999_999


def _overlap(x: tuple[int, int], y: tuple[int, int]) -> bool:
    return min(x[1], y[1]) > max(x[0], y[0])


def _anchor(a: Exons, b: Exons) -> tuple[int, int] | None:
    """The first overlapping pair of exons of which one is the first of its transcript."""
    pairs = [(0, j) for j in range(len(b))] + [(i, 0) for i in range(1, len(a))]
    return next(((i, j) for i, j in pairs if _overlap(a[i], b[j])), None)


def _alone(one: tuple[int, int], others: Exons, at: int) -> bool:
    """Whether a single exon lies clear of the neighbours of the exon it matches."""
    return (at == 0 or others[at - 1][1] < one[0]) and (at == len(others) - 1 or one[1] < others[at + 1][0])


def relation(a: Exons, b: Exons, strand: str = "+", fuzzy: int = 0, max_5_diff: int = ANY, max_3_diff: int = ANY) -> str:
    """How ``a`` relates to ``b``: exact, super, subset, concordant, partial or nomatch.

    The limits hold at the 5' and 3' end of the strand, also for single exons; inner
    junctions may differ by ``fuzzy``.
    """
    anchor = _anchor(a, b)
    if anchor is None:
        return "nomatch"
    i, j = anchor
    low, high = (max_5_diff, max_3_diff) if strand == "+" else (max_3_diff, max_5_diff)
    if abs(a[i][0] - b[j][0]) > low or abs(a[i][1] - b[j][1]) > high:
        return "partial"
    if len(a) == 1 or len(b) == 1:
        if len(a) == len(b):
            return "exact"
        if len(a) == 1:
            return "subset" if _alone(a[0], b, j) else "partial"
        return "super" if _alone(b[0], a, i) else "partial"
    shared = min(len(a) - i, len(b) - j)
    for x, y in zip(zip(a[i:], a[i + 1 :]), zip(b[j:], b[j + 1 :])):
        if abs(x[0][1] - y[0][1]) > fuzzy or abs(x[1][0] - y[1][0]) > fuzzy:
            return "partial"
    if abs(a[i + shared - 1][1] - b[j + shared - 1][1]) > high:
        return "partial"
    # What each transcript has beyond the shared exons, on the left and on the right.
    more_a = i > 0, i + shared < len(a)
    more_b = j > 0, j + shared < len(b)
    if any(more_a) and any(more_b):
        return "concordant"
    return "super" if any(more_a) else "subset" if any(more_b) else "exact"


def same_three_prime(long: Exons, short: Exons, strand: str, fuzzy: int) -> bool:
    """Whether ``short`` ends on the 3' exon of ``long`` and begins within the exon it matches there."""
    n = len(short)
    if n > len(long):
        return False
    if strand == "+":
        return abs(long[-1][0] - short[-1][0]) <= fuzzy and long[-n][0] <= short[0][0] < long[-n][1]
    return abs(long[0][1] - short[0][1]) <= fuzzy and long[n - 1][0] <= short[-1][1] < long[n - 1][1]


def is_degraded(long: Exons, short: Exons, strand: str, fuzzy: int) -> bool:
    """Whether ``short`` may be a 5'-degraded copy of ``long``; one exon may begin within its last exon."""
    if len(short) == 1:
        return long[-1][0] - short[0][0] <= fuzzy if strand == "+" else short[0][1] - long[0][1] <= fuzzy
    return same_three_prime(long, short, strand, fuzzy)


class ThreePrime:
    """Numbered structures in a tree of their inner ends, from the 3' end on, so that those which agree there are found.

    ``near`` gives all that may be ``exact``, or ``super`` or ``subset`` with ``same_three_prime``, but two single exons.  Where
    exons lie so close that one may be taken for the next, the inner end of the 3' exon alone counts.
    """

    def __init__(self, strand: str, fuzzy: int):
        self.strand, self.fuzzy = strand, fuzzy
        self.root: tuple[dict, list] = ({}, [])  # children by the next end, numbers of what ends here
        self.close: dict[int, list[int]] = {}
        self.every: dict[int, list[int]] = {}

    def ends(self, exons: Exons) -> list[int]:
        flat = [x for exon in exons for x in exon]
        flat = flat[-2::-1] if self.strand == "+" else flat[1:]
        return flat[: max(1, len(flat) - 1)]

    def is_close(self, exons: Exons) -> bool:
        return any(y[0] - x[0] <= 2 * self.fuzzy or y[1] - x[1] <= 2 * self.fuzzy for x, y in zip(exons, exons[1:]))

    def add(self, number: int, exons: Exons) -> None:
        ends = self.ends(exons)
        place = ends[0] // (self.fuzzy + 1)
        self.every.setdefault(place, []).append(number)
        if self.is_close(exons):
            self.close.setdefault(place, []).append(number)
            return
        node = self.root
        for end in ends:
            node = node[0].setdefault(end, ({}, []))
        node[1].append(number)

    def near(self, exons: Exons) -> set[int]:
        ends = self.ends(exons)
        place = ends[0] // (self.fuzzy + 1)
        among = self.every if self.is_close(exons) else self.close
        found = {i for p in (place - 1, place, place + 1) for i in among.get(p, ())} if among else set()
        if among is self.every:
            return found
        nodes = [self.root]
        for end in ends:
            low, high = end - self.fuzzy, end + self.fuzzy
            nodes = [
                child
                for children, _ in nodes
                for child in (
                    (c for at, c in children.items() if low <= at <= high)
                    if len(children) <= 2 * self.fuzzy + 1
                    else (children[at] for at in range(low, high + 1) if at in children)
                )
            ]
            if not nodes:
                return found
            for _, here in nodes:
                found.update(here)
        while nodes:
            children, here = nodes.pop()
            found.update(here)
            nodes += children.values()
        return found


def as_exons(value) -> list[tuple[int, int]]:
    """Exons from an array of structs, or from one of ``flat``, as it comes to Python."""
    if len(value) and isinstance(value[0], (dict, tuple)):
        return [(x["start"], x["end"]) if isinstance(x, dict) else tuple(x) for x in value]
    ends = value.tolist() if hasattr(value, "tolist") else value
    return list(zip(ends[::2], ends[1::2]))


def flat(exons: Column | str) -> Column:
    """An exon array as one array of starts and ends, which passes to Python faster; null for null."""
    exons = F.col(exons) if isinstance(exons, str) else exons
    return F.flatten(F.transform(exons, lambda x: F.array(x["start"].cast("bigint"), x["end"].cast("bigint"))))


def relation_of(a: Column | str, b: Column | str, strand: Column | str, fuzzy: int = 0, max_5_diff: int = ANY, max_3_diff: int = ANY) -> Column:
    """``relation`` of two columns of exon arrays; null if one of them is null or empty."""
    prepare_active()

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series, s: pd.Series) -> pd.Series:
        rows = zip(x, y, s)
        return pd.Series(
            [relation(as_exons(p), as_exons(q), t, fuzzy, max_5_diff, max_3_diff) if p is not None and q is not None and len(p) and len(q) else None for p, q, t in rows],
            dtype=object,
        )

    return run(flat(a), flat(b), strand)


def junctions(exons: Column | str) -> Column:
    """Junctions of an exon array: structs of ``donor`` (last base of an exon) and ``acceptor`` (first of the next)."""
    exons = F.col(exons) if isinstance(exons, str) else exons
    before, after = F.slice(exons, F.lit(1), F.size(exons) - 1), F.slice(exons, F.lit(2), F.size(exons) - 1)
    pairs = F.zip_with(before, after, lambda x, y: F.struct((x["end"] - 1).alias("donor"), y["start"].alias("acceptor")))
    return F.when(F.size(exons) > 1, pairs).otherwise(F.filter(pairs, lambda x: F.lit(False)))


def exon_text(exons: Column | str) -> Column:
    """An exon array as text: ``start-end`` joined by commas."""
    exons = F.col(exons) if isinstance(exons, str) else exons
    return F.array_join(F.transform(exons, lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
