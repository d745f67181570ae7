"""Column functions over sequences and qualities; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements, IUPAC codes included.
_BASES = "ACGTUacgtuRYKMBVDHrykmbvdh"
_COMPLEMENTS = "TGCAAtgcaaYRMKVBHDyrmkvbhd"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(F.translate(_col(c), _BASES, _COMPLEMENTS))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of places that differ; null unless both have one length."""
    a, b = _col(a), _col(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)).cast("bigint")


def phred_scores(quality: Column | str) -> Column:
    """Quality string to scores, the code of each character less 33."""
    return F.transform(F.filter(F.split(_col(quality), ""), lambda x: x != ""), lambda x: F.ascii(x) - 33)


def expected_accuracy(quality: Column | str, trim_start: int = 100, trim_end: int = 30) -> Column:
    """1 less the summed error probability of the untrimmed scores over their number; null if none is left."""
    scores = phred_scores(quality)
    kept = F.slice(scores, trim_start + 1, F.greatest(F.size(scores) - trim_start - trim_end, F.lit(0)))
    errors = F.aggregate(kept, F.lit(0.0), lambda acc, q: acc + F.pow(F.lit(10.0), -q / 10.0))
    return F.when(F.size(kept) > 0, 1 - errors / F.size(kept))


def overlap_length(s1: Column | str, e1: Column | str, s2: Column | str, e2: Column | str) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(_col(e1), _col(e2)) - F.greatest(_col(s1), _col(s2)))


def a_tail(seq: Column | str, least: int = 8, last: int = 200) -> Column:
    """The last run of at least ``least`` A in the last ``last`` bases: ``start`` (the base before it) and ``end``; -1 if none.

    The end is counted from the true length, also for reads shorter than ``last``.
    """
    seq = _col(seq)
    tail = F.when(F.length(seq) > last, F.right(seq, F.lit(last))).otherwise(seq)
    found = F.locate("A" * least, F.reverse(tail))
    end = F.length(seq) - found + 1
    before = F.substring(seq, F.lit(1), end)
    run = F.length(before) - F.length(F.rtrim(before, F.lit("A")))
    none = F.lit(-1)
    return F.struct(F.when(found > 0, end - run - 1).otherwise(none).alias("start"), F.when(found > 0, end).otherwise(none).alias("end"))


def g_run(seq: Column | str, least: int = 3) -> Column:
    """The first run of at least ``least`` G: ``start`` and ``end``; -1 if none."""
    seq = _col(seq)
    found = F.locate("G" * least, seq)
    rest = F.substring(seq, found, F.length(seq))
    run = F.length(rest) - F.length(F.ltrim(rest, F.lit("G")))
    none = F.lit(-1)
    return F.struct(F.when(found > 0, found - 1).otherwise(none).alias("start"), F.when(found > 0, found - 1 + run).otherwise(none).alias("end"))


def splice_motif(donor: Column | str, acceptor: Column | str, strand: Column | str) -> Column:
    """Motif such as ``GT-AG`` from the two bases after an exon and the two before the next one, on the reference strand."""
    first, second = F.upper(_col(donor)), F.upper(_col(acceptor))
    plus = F.concat(first, F.lit("-"), second)
    minus = F.concat(reverse_complement(second), F.lit("-"), reverse_complement(first))
    return F.when(_col(strand) == "-", minus).otherwise(plus)


def shade_index(highest: Column | str, cpm: Column | str) -> Column:
    """Shade of an isoform by how far its CPM lies below the highest of its gene: 0 to 19."""
    highest, cpm = _col(highest), _col(cpm)
    return F.when(cpm <= 0, 19).otherwise(F.least(F.lit(19), F.ceil(3 * F.log2(highest / cpm)))).cast("bigint")


def recover_quality(full: Column | str, quality: Column | str, part: Column | str) -> Column:
    """The quality of ``part`` within ``full`` or within its reverse complement; null if it isn't there."""
    full, quality, part = _col(full), _col(quality), _col(part)
    forward, backward = F.instr(full, part), F.instr(reverse_complement(full), part)
    n = F.length(part)
    return F.when(forward > 0, F.substring(quality, forward, n)).when(backward > 0, F.substring(F.reverse(quality), backward, n))
