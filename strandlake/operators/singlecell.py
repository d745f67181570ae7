"""Molecular tags of single cells: clipping, correction, deduplication, clustering."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import a_tail, g_run, reverse_complement
from strandlake.operators.grouped import map_groups
from strandlake.operators.intervals import islands
from strandlake.session import prepare


def _part(c: Column, first: Column | int, n: Column | int) -> Column:
    """Substring from a 0-based place; a negative size gives an empty string."""
    first, n = (F.lit(x) if isinstance(x, int) else x for x in (first, n))
    return F.substring(c, (first + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))


def with_whitelist(clipped: DataFrame, ranks: DataFrame | None) -> DataFrame:
    """Add ``bc_match`` and ``bc_top_rank`` (Y or N) of ``bc_rev``, from ``cell_barcode`` and ``top_ranked``."""
    if ranks is None:
        return clipped.withColumns({"bc_match": F.lit("N"), "bc_top_rank": F.lit("N")})
    known = ranks.groupBy(F.col("cell_barcode").alias("bc_rev")).agg(F.max("top_ranked").alias("_top"))
    rows = clipped.join(known, "bc_rev", "left")
    return rows.withColumns({"bc_match": F.when(F.col("_top").isNull(), "N").otherwise("Y"), "bc_top_rank": F.when(F.col("_top") == "Y", "Y").otherwise("N")}).drop("_top")


def clip_tail(reads: DataFrame, umi_len: int, bc_len: int, seq: str = "seq") -> DataFrame:
    """Tags behind the poly-A tail (design A3): UMI, then barcode.

    Rows for reads with a tail: ``id``, ``clip_len``, ``extra`` (bases before the tags, else null),
    ``umi``, ``bc``, ``bc_rev`` and ``insert``, the read up to the end of its tail.
    """
    size = umi_len + bc_len
    rows = reads.withColumn("_end", a_tail(seq)["end"]).filter("_end > 0")
    whole, n = F.col(seq), F.length(seq)
    # A UMI that starts with A lies partly in the tail.
    start = F.when(n - F.col("_end") < size, F.greatest(n - size, F.lit(0))).otherwise(F.col("_end"))
    tags = _part(whole, start, n - start)
    extra = F.length(tags) - size
    rows = rows.withColumns({"_tags": tags, "_extra": F.greatest(extra, F.lit(0))})
    umi = _part(F.col("_tags"), F.col("_extra"), umi_len)
    bc = _part(F.col("_tags"), F.col("_extra") + umi_len, bc_len)
    return rows.select(
        "id",
        F.length("_tags").alias("clip_len"),
        F.when(F.col("_extra") > 0, _part(F.col("_tags"), 0, F.col("_extra"))).alias("extra"),
        umi.alias("umi"),
        bc.alias("bc"),
        reverse_complement(bc).alias("bc_rev"),
        _part(whole, 0, F.col("_end")).alias("insert"),
    )


def clip_head(reads: DataFrame, umi_len: int, seq: str = "seq") -> DataFrame:
    """A UMI before a run of G at the 5' end (design G5): as ``clip_tail``, without barcode."""
    g = g_run(seq)
    rows = reads.withColumns({"_g": g["start"], "_end": g["end"]}).filter("_g > 0")
    whole = F.col(seq)
    # A UMI that ends with G lies partly in the run.
    stop = F.greatest(F.col("_g"), F.lit(umi_len))
    extra = F.greatest(F.col("_g") - umi_len, F.lit(0))
    none = F.lit(None).cast("string")
    umi = _part(whole, extra, stop - extra)
    return rows.select(
        "id",
        F.length(umi).alias("clip_len"),
        F.when(extra > 0, _part(whole, 0, extra)).alias("extra"),
        umi.alias("umi"),
        none.alias("bc"),
        none.alias("bc_rev"),
        _part(whole, F.col("_end"), F.length(whole) - F.col("_end")).alias("insert"),
    )


def clip_droplet(reads: DataFrame, umi_len: int, bc_len: int, tso_len: int, seq: str = "seq") -> DataFrame:
    """Barcode, UMI and template switch oligo before a run of G at the end of the reverse strand (design G5-10X)."""
    size = bc_len + umi_len + tso_len
    rows = reads.withColumn("_seq", reverse_complement(seq))
    g = g_run(_part(F.col("_seq"), size, 10))
    rows = rows.withColumns({"_g": g["start"] + size, "_end": g["end"] + size, "_found": g["start"]}).filter("_found >= 0")
    extra = F.greatest(F.col("_g") - size, F.lit(0))
    whole = F.col("_seq")
    bc, umi = _part(whole, extra, bc_len), _part(whole, extra + bc_len, umi_len)
    tso = F.concat(_part(whole, F.col("_g") - tso_len, tso_len), _part(whole, F.col("_g"), F.col("_end") - F.col("_g")))
    return rows.select(
        "id",
        (F.col("_end") - extra).alias("clip_len"),
        F.when(extra > 0, _part(whole, 0, extra)).alias("extra"),
        umi.alias("umi"),
        bc.alias("bc"),
        reverse_complement(bc).alias("bc_rev"),
        tso.alias("tso"),
        _part(whole, F.col("_end"), F.length(whole) - F.col("_end")).alias("insert"),
    )


def clip_adapter(reads: DataFrame, umi_len: int, adapter: str, seq: str = "seq", search: int = 100, min_score: int = 10) -> DataFrame:
    """A UMI before an adapter that may have errors (design G5-clip): the adapter is aligned to the read's
    first ``search`` bases, end gaps of the read being free."""
    from strandlake.operators.aligner import best_placement

    prepare(reads.sparkSession)

    @F.pandas_udf("bigint")
    def place(s: pd.Series) -> pd.Series:
        found = [best_placement(x[:search], adapter) if x else None for x in s]
        return pd.Series([hit[0] if hit and hit[2] >= min_score else -1 for hit in found])

    rows = reads.withColumn("_at", place(seq)).filter("_at > 0")
    whole = F.col(seq)
    extra = F.greatest(F.col("_at") - umi_len, F.lit(0))
    umi = _part(whole, extra, F.col("_at") - extra)
    none = F.lit(None).cast("string")
    return rows.select(
        "id", F.length(umi).alias("clip_len"), F.when(extra > 0, _part(whole, 0, extra)).alias("extra"), umi.alias("umi"), none.alias("bc"), none.alias("bc_rev"),
        _part(whole, F.col("_at"), F.length(whole) - F.col("_at")).alias("insert"),
    )


def absorb(values: Sequence[str], counts: Sequence[int]) -> dict[str, str]:
    """Map a value to the more frequent one that takes it: frequent ones first, each takes what
    differs from it in at most one place and isn't taken yet.  Ties go by value."""
    order = [v for _, v in sorted(zip([-n for n in counts], values))]
    masked: dict[tuple[int, str, str], list[str]] = {}
    for v in order:
        for i in range(len(v)):
            masked.setdefault((i, v[:i], v[i + 1 :]), []).append(v)
    taken: dict[str, str] = {}
    heads: set[str] = set()
    for v in order:
        if v in taken:
            continue
        heads.add(v)
        for i in range(len(v)):
            for other in masked[(i, v[:i], v[i + 1 :])]:
                if other not in taken and other not in heads:
                    taken[other] = v
    return taken


def corrections(rows: DataFrame, by: Sequence[str], tag: str) -> DataFrame:
    """Corrected tags within each group: ``by``, tag and ``corrected``, for tags that another one takes.

    Tags are counted first, so a group's task holds its different tags, not its rows.
    """
    counts = rows.filter(F.col(tag).isNotNull()).groupBy(*by, tag).agg(F.count("*").alias("n"))

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*key, old, new) for old, new in absorb([r[0] for r in rows], [r[1] for r in rows]).items()]

    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in [*by, tag]) + ", corrected string"
    return map_groups(counts, by, run, schema)


def correct_tags(molecules: DataFrame, gene: str = "gene", bc: str = "bc", umi: str = "umi") -> DataFrame:
    """Correct barcodes within each gene, then UMIs within each gene and corrected barcode: adds ``bc_ed`` and ``umi_ed``.

    A tag differs from the one that takes it in one place at most.  Null tags stay null.
    """
    prepare(molecules.sparkSession)
    null_safe = lambda a, b: a.eqNullSafe(b)
    fix = corrections(molecules, [gene], bc).select(F.col(gene).alias("_g"), F.col(bc).alias("_b"), F.col("corrected").alias("_bc"))
    rows = molecules.join(fix, null_safe(F.col(gene), F.col("_g")) & (F.col(bc) == F.col("_b")), "left")
    rows = rows.withColumn("bc_ed", F.coalesce("_bc", bc)).drop("_g", "_b", "_bc")
    fix = corrections(rows, [gene, "bc_ed"], umi).select(F.col(gene).alias("_g"), F.col("bc_ed").alias("_b"), F.col(umi).alias("_u"), F.col("corrected").alias("_umi"))
    on = null_safe(F.col(gene), F.col("_g")) & null_safe(F.col("bc_ed"), F.col("_b")) & (F.col(umi) == F.col("_u"))
    return rows.join(fix, on, "left").withColumn("umi_ed", F.coalesce("_umi", umi)).drop("_g", "_b", "_u", "_umi")


def deduplicate(molecules: DataFrame, order: Sequence[str], keys: Sequence[str] = ("bc_ed", "umi_ed", "gene")) -> DataFrame:
    """One row for each molecule: the last in ``order`` stands for all, ``num_dups`` says how many there are."""
    columns = [c for c in molecules.columns if c not in keys]
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    return molecules.groupBy(*keys).agg(last, F.count("*").alias("num_dups")).select(*keys, "_last.*", "num_dups")


def annotate(molecules: DataFrame, classes: DataFrame, orfs: DataFrame, no_extra: DataFrame | None = None) -> DataFrame:
    """Molecules (``id``, ``pbid``, ...) with the class of their isoform (inner) and its ORF group, ``NoORF`` without one.
    With ``no_extra`` (clipped reads) those with extra bases are left out."""
    rows = molecules.join(classes, "pbid").join(orfs, "pbid", "left").fillna("NoORF", ["orfgroup"])
    if no_extra is not None:
        rows = rows.join(no_extra.filter("extra is null").select("id"), "id", "left_semi")
    return rows


def link_cells(molecules: DataFrame, cells: DataFrame) -> DataFrame:
    """Molecules whose ``bc_rev`` has a cell type (``bc_rev``, ``celltype``)."""
    return molecules.join(cells, "bc_rev")


def repair_map(clean: DataFrame, synthesis: DataFrame) -> DataFrame:
    """Barcode repairs from both reports, in the orientation of reads: ``from_bc``, ``to_bc``.

    ``clean``: ``cell_barcode``, ``repaired_to``, ``repaired`` (TRUE); ``synthesis``: ``intended_sequence``,
    ``related_sequences`` (joined by colons).
    """
    a = clean.filter(F.col("repaired") == "TRUE").select("cell_barcode", F.col("repaired_to").alias("to"))
    b = synthesis.filter(F.col("intended_sequence").isNotNull() & (F.col("intended_sequence") != "NA"))
    b = b.select(F.explode(F.split("related_sequences", ":")).alias("cell_barcode"), F.col("intended_sequence").alias("to"))
    return a.unionByName(b).select(reverse_complement("cell_barcode").alias("from_bc"), reverse_complement("to").alias("to_bc")).distinct()


def parse_dedup_header(headers: DataFrame, header: str = "header") -> DataFrame:
    """Fields of ``id full_length_coverage=N;length=N;XM=umi[;XC=bc]``: ``id``, ``umi``, ``umi_rev``, ``bc``, ``bc_rev``, ``length``, ``n``."""
    field = lambda name: F.nullif(F.regexp_extract(header, rf"[ ;]{name}=([^;\s]*)", 1), F.lit(""))
    umi, bc = field("XM"), field("XC")
    return headers.select(
        F.substring_index(header, " ", 1).alias("id"), umi.alias("umi"), reverse_complement(umi).alias("umi_rev"), bc.alias("bc"), reverse_complement(bc).alias("bc_rev"),
        field("length").cast("bigint").alias("length"), field("full_length_coverage").cast("bigint").alias("n"),
    )


def umi_groups(alignments: DataFrame, use_barcode: bool = True, members: bool = False) -> DataFrame:
    """Reads by locus and tags: ``chr``, ``island``, ``umi``, [``bc``,] ``size`` and ``n_reads_total`` of the locus.

    Loci are clusters of overlapping alignments on both strands; a read counts in its first
    locus only.  With ``members``, ``members`` has the read ids of the group, sorted; a group that
    holds very many reads is then one large row.
    """
    keys = ["umi", "bc"] if use_barcode else ["umi"]
    placed = islands(alignments, ["chr"])
    place = F.struct("chr", "island", "s", "e")
    once = placed.filter("island is not null").groupBy("read_id").agg(*(F.min_by(c, place).alias(c) for c in ("chr", "island", *keys)))
    counts = [F.count("*").alias("size")] + ([F.array_sort(F.collect_list("read_id")).alias("members")] if members else [])
    sizes = once.groupBy("chr", "island", *keys).agg(*counts)
    total = once.groupBy("chr", "island").agg(F.count("*").alias("n_reads_total"))
    same = [F.col("chr").eqNullSafe(F.col("_chr")), F.col("island") == F.col("_island")]
    return sizes.join(total.withColumnsRenamed({"chr": "_chr", "island": "_island"}), same, "left").drop("_chr", "_island")


def tag_report(molecules: DataFrame) -> DataFrame:
    """One row: loci, UMIs, barcodes, reads and molecules."""
    return molecules.agg(
        F.countDistinct("gene").alias("n_loci"), F.countDistinct("umi_ed").alias("n_umi"), F.countDistinct("bc_ed").alias("n_bc"),
        F.sum("num_dups").alias("n_reads"), F.count("*").alias("n_molecules"),
    )


def duplicate_histogram(molecules: DataFrame) -> DataFrame:
    """Molecules by the binary logarithm of their copies: ``log2_dups``, ``n``."""
    return molecules.filter("num_dups > 0").groupBy(F.floor(F.log2("num_dups")).alias("log2_dups")).agg(F.count("*").alias("n"))


def top_loci(molecules: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` genes with most molecules (ties by name)."""
    return molecules.groupBy("gene").agg(F.count("*").alias("n_molecules")).orderBy(F.desc("n_molecules"), F.asc_nulls_last("gene")).limit(n)
