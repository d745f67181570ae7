"""Column functions over CIGAR strings, SAM flags and composite ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = "([0-9]+)([MIDNSHP=X])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cigar_ops(cigar: Column | str) -> Column:
    """Array of ``n`` and ``op``."""
    cigar = _col(cigar)
    sizes, ops = F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(1)), F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(2))
    return F.zip_with(sizes, ops, lambda n, op: F.struct(n.cast("bigint").alias("n"), op.alias("op")))


def _total(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])


def cigar_summary(cigar: Column | str) -> Column:
    """Struct of num_ins, num_del, num_match (M, = and X), clip_start and query_span of an alignment."""
    ops = cigar_ops(cigar)
    first = F.try_element_at(ops, F.lit(1))
    return F.struct(
        _total(ops, "I").alias("num_ins"),
        _total(ops, "D").alias("num_del"),
        _total(ops, "M=X").alias("num_match"),
        F.coalesce(F.when(first["op"].isin("S", "H"), first["n"]), F.lit(0)).alias("clip_start"),
        _total(ops, "MI=X").alias("query_span"),
        _total(ops, "MI=XSH").alias("query_length"),
    )


def cigar_segments(cigar: Column | str, start: Column | str) -> Column:
    """The aligned segments on the reference (0-based start, exclusive end): N opens a new one, empty ones go."""
    zero = F.struct(
        _col(start).cast("bigint").alias("at"), _col(start).cast("bigint").alias("begin"), F.expr("array_remove(array(struct(0L AS start, 0L AS end)), struct(0L AS start, 0L AS end))").alias("done")
    )

    def step(acc: Column, x: Column) -> Column:
        skip = x["op"] == "N"
        moves = x["op"].isin("M", "D", "=", "X", "N")
        at = acc["at"] + F.when(moves, x["n"]).otherwise(0)
        closed = F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("start"), acc["at"].alias("end"))))
        return F.struct(at.alias("at"), F.when(skip, at).otherwise(acc["begin"]).alias("begin"), F.when(skip, closed).otherwise(acc["done"]).alias("done"))

    def finish(acc: Column) -> Column:
        all_of = F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("start"), acc["at"].alias("end"))))
        return F.filter(all_of, lambda x: x["end"] > x["start"])

    return F.aggregate(cigar_ops(cigar), zero, step, finish)


def sam_flag(flag: Column | str) -> Column:
    """Struct of is_paired, strand, read_number, is_secondary and is_supplementary."""
    bit = lambda n: _col(flag).bitwiseAND(F.lit(n)) > 0
    return F.struct(
        bit(1).alias("is_paired"),
        F.when(bit(16), "-").otherwise("+").alias("strand"),
        F.when(bit(64), 1).when(bit(128), 2).otherwise(0).alias("read_number"),
        bit(256).alias("is_secondary"),
        bit(2048).alias("is_supplementary"),
    )


def is_unmapped(flag: Column | str) -> Column:
    return _col(flag).bitwiseAND(F.lit(4)) > 0


def coverage(aligned: Column | str, length: Column | str) -> Column:
    """Aligned share of a sequence; null for an empty or unknown one."""
    return F.when(_col(length) > 0, _col(aligned) / _col(length))


def identity(nonmatches: Column | str, columns: Column | str) -> Column:
    return F.when(_col(columns) > 0, 1 - _col(nonmatches) / _col(columns))


def isoform_id(c: Column | str) -> Column:
    """Gene and isoform number of an id such as PB.12.3 or PBfusion.4.1, as ``gene_idx`` and ``isoform_idx``."""
    pattern = r"^[A-Za-z]+\.([0-9]+)\.([0-9]+)(?:\||$)"
    number = lambda i: F.when(F.regexp_like(_col(c), F.lit(pattern)), F.regexp_extract(_col(c), pattern, i).cast("bigint"))
    return F.struct(number(1).alias("gene_idx"), number(2).alias("isoform_idx"))


def movie_and_zmw(read_id: Column | str) -> Column:
    """``movie`` and ``zmw`` of a read id ``movie/zmw/...``."""
    parts = F.split(_col(read_id), "/")
    return F.struct(parts[0].alias("movie"), F.concat_ws("/", parts[0], F.try_element_at(parts, F.lit(2))).alias("zmw"))
