"""Structures of a large locus meet only those that agree with them from the 3' end on."""

import itertools

import pytest

from strandlake.operators import collapse, compare


def structures():
    """125 structures of one locus, of other junctions all but for the last exon, and short copies of them."""
    long = [[(0, 100 + 20 * a), (1000 + 20 * b, 1200 + 20 * c), (3000, 3200)] for a, b, c in itertools.product(range(5), repeat=3)]
    return long, [[(x[1][0] + 5, x[1][1]), x[2]] for x in long[:25]] + [[(3000, 3150)]]


@pytest.fixture
def compared(monkeypatch):
    calls, plain = [], compare.relation
    monkeypatch.setattr(compare, "relation", lambda *args: calls.append(1) or plain(*args))
    return calls


def mirrored(exons):
    return [(5000 - e, 5000 - s) for s, e in reversed(exons)]


@pytest.mark.parametrize("strand", "+-")
def test_few_are_compared_for_subsets(compared, strand):
    long, short = structures()
    rows = sorted(x if strand == "+" else mirrored(x) for x in long + short)
    kept = collapse._without_subsets(rows, strand, 5)
    assert [rows[i] for i in kept] == sorted(x if strand == "+" else mirrored(x) for x in long)
    assert len(compared) < 4 * len(rows)


@pytest.mark.parametrize("strand", "+-")
def test_few_heads_are_compared(compared, strand):
    long, short = structures()
    rows = [(i, x if strand == "+" else mirrored(x), 1) for i, x in enumerate(long + short, 1)]
    kept = dict(collapse.merge_fuzzy(rows, strand, 5, True, 1000, 100))
    assert len({kept[i] for i in range(1, 126)}) == 125 and {kept[i] for i in range(126, 151)} < set(range(1, 126))
    assert len(compared) < 4 * len(rows)
