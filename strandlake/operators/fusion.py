"""Fusion transcripts: reads whose parts align to distant loci."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.alignment import is_unmapped
from strandlake.functions.sequence import reverse_complement
from strandlake.operators import compare
from strandlake.operators.intervals import covered_length, islands
from strandlake.operators.ranges import number_rows
from strandlake.operators.seqtools import cut_sequences
from strandlake.session import prepare, stage

#: Bases on one side of a breakpoint.
FLANK = 50
#: Neighbouring loci that one call of a grouped function takes; it saves calls and changes nothing else.
LOCI_AT_ONCE = 256


def candidates(
    alignments: DataFrame, min_identity: float = 0.95, min_coverage: float = 0.05, min_bases: int = 1, min_total: float = 0.99, min_distance: int = 10_000
) -> DataFrame:
    """Reads with at least two alignments that all pass and together cover the read, any two on one
    chromosome being far apart: ``read_id``, ``n_loci``.

    ``alignments``: ``read_id``, ``chr``, ``s``, ``e``, ``q_start``, ``q_end``, ``q_len``, ``q_coverage``, ``identity``, ``flag``.
    """
    rows = alignments.filter(~is_unmapped("flag"))
    passes = (F.col("identity") >= min_identity) & (F.col("q_coverage") >= min_coverage) & (F.col("q_end") - F.col("q_start") >= min_bases)
    reads = rows.groupBy("read_id").agg(F.count("*").alias("n_loci"), F.min(passes.cast("int")).alias("_ok"), F.max("q_len").alias("_len"))
    reads = reads.filter("n_loci >= 2 AND _ok = 1")
    order = Window.partitionBy("read_id", "chr").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    close = rows.withColumn("_gap", F.col("s") - reach).filter(F.col("_gap") < min_distance).select("read_id").distinct()
    total = covered_length(rows, ["read_id"], "q_start", "q_end", small_keys=True)
    return reads.join(total, "read_id").filter(F.col("covered") >= min_total * F.col("_len")).join(close, "read_id", "left_anti").select("read_id", "n_loci")


def compatible(a: dict, b: dict, max_point_dist: int, max_exon_dist: int, allow_5: bool) -> bool:
    """Whether two fusion parts on one strand are the same half of a read with the same structure."""
    first_half = a["q_start"] * 2 <= a["q_len"]
    if first_half != (b["q_start"] * 2 <= b["q_len"]):
        return False
    strand, x, y = a["strand"], a["exons"], b["exons"]
    how = compare.relation(x, y, strand)
    # The fusion point is the 3' end of a read's first half and the 5' end of its second.
    right = first_half == (strand == "+")
    point = lambda exons: exons[-1][1] if right else exons[0][0]
    if how == "exact":
        return len(x) > 1 or abs(point(x) - point(y)) <= max_point_dist
    if not allow_5 or not first_half or how not in ("super", "subset"):
        return False
    long, short = (x, y) if how == "super" else (y, x)
    return compare.same_three_prime(long, short, strand, max_exon_dist) and abs(point(long) - point(short)) <= max_point_dist


def merge_parts(parts: DataFrame, max_point_dist: int = 100, max_exon_dist: int = 0, allow_5: bool = True) -> DataFrame:
    """Group the parts of candidates that are alike: adds ``locus`` and ``part_group`` within chr, strand and locus.

    ``parts``: ``read_id``, ``chr``, ``strand``, ``s``, ``e``, ``q_start``, ``q_len``, ``exons``.  In the order of
    place and id a part joins the first group with all of whose members it is compatible.
    A locus is grouped within one task, equal parts being compared once.
    """
    prepare(parts.sparkSession)
    placed = islands(parts, ["chr", "strand"], island="locus").withColumn("_some", F.floor(F.col("locus") / LOCI_AT_ONCE))
    columns = [c for c in placed.columns if c != "_some"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["locus", "s", "e", "read_id"])
        groups: list[list[dict]] = []
        locus, number = None, []
        for row in zip(pdf["locus"].tolist(), *(pdf[c].tolist() for c in ("strand", "q_start", "q_len", "exons"))):
            if row[0] != locus:
                locus, groups = row[0], []
            part = {"strand": row[1], "q_start": row[2], "q_len": row[3], "exons": compare.as_exons(row[4])}
            at = next((i for i, g in enumerate(groups) if all(compatible(part, x, max_point_dist, max_exon_dist, allow_5) for x in g)), None)
            if at is None:
                groups.append([])
                at = len(groups) - 1
            # A part that equals a member would be compared with the same result.
            if part not in groups[at]:
                groups[at].append(part)
            number.append(at + 1)
        return pd.DataFrame({c: pdf[c].tolist() for c in columns} | {"part_group": number})

    schema = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in columns) + ", part_group bigint"
    return stage(placed.groupBy("chr", "strand", "_some").applyInPandas(run, schema), "fusion-parts")


def assemble(grouped: DataFrame) -> DataFrame:
    """Fusions from grouped parts: ``fusion_id`` (PBfusion.N), ``n_parts``, ``n_reads`` and a ``read_id`` each.

    The reads of a fusion share the groups of all their parts, in the order along the read.
    """
    name = F.concat_ws(":", "chr", "strand", "locus", "part_group")
    paths = grouped.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("q_start", name.alias("g")))).alias("_p"))
    paths = paths.select("read_id", F.array_join(F.transform("_p", lambda x: x["g"]), "|").alias("path"), F.size("_p").cast("bigint").alias("n_parts")).filter("n_parts > 1")
    kinds = paths.groupBy("path").agg(F.count("*").alias("n_reads"))
    numbered = number_rows(kinds, ["path"], "_n").select("path", "n_reads", F.concat(F.lit("PBfusion."), "_n").alias("fusion_id"))
    return paths.join(numbered, "path").select("fusion_id", "n_parts", "n_reads", "read_id", "path")


def shared_members(parts: DataFrame) -> DataFrame:
    """Reads that support all parts of a fusion: ``fusion_id``, ``member``.  ``parts``: ``fusion_id``, ``part``, ``member``."""
    rows = parts.select("fusion_id", "part", "member").distinct()
    all_parts = rows.groupBy("fusion_id").agg(F.countDistinct("part").alias("_all"))
    of_member = rows.groupBy("fusion_id", "member").agg(F.count("*").alias("_n"))
    return of_member.join(all_parts, "fusion_id").filter("_n = _all").select("fusion_id", "member")


def fusion_records(grouped: DataFrame, fusions: DataFrame, lengths: DataFrame) -> DataFrame:
    """The parts of the read that stands for each fusion, the longest (ties: the largest id): ``fusion_id``, ``part``
    (from 1, along the read), ``chr``, ``strand``, ``exons``, ``representative``, ``n_reads``.

    ``grouped`` as ``merge_parts``, ``fusions`` as ``assemble`` gives them; ``lengths``: ``read_id``, ``length``.
    """
    best = F.struct("length", "read_id")
    chosen = fusions.join(lengths, "read_id").groupBy("fusion_id").agg(F.max_by("read_id", best).alias("read_id"), F.max("n_reads").alias("n_reads"))
    rows = grouped.join(chosen, "read_id")
    part = F.row_number().over(Window.partitionBy("fusion_id").orderBy("q_start", "chr", "s", "e"))  # a read has few parts
    return rows.select("fusion_id", part.cast("bigint").alias("part"), "chr", "strand", "exons", F.col("read_id").alias("representative"), "n_reads")


def ends_of(parts: DataFrame) -> DataFrame:
    """The first and last part of each fusion with its breakpoint: ``fusion_id``, and for ``left`` and ``right`` ``_chr``,
    ``_strand``, ``_break``, ``_exons`` (number), ``_cds`` (number, null without a ``cds`` column), ``_from`` and ``_to`` (the flank).

    ``parts``: ``fusion_id``, ``part``, ``chr``, ``strand``, ``exons``.  Breakpoints are the end of the left part (on the minus
    strand its start, from 1) and the start of the right part (on the minus strand its end).
    """
    start, end, plus = F.col("exons")[0]["start"], F.element_at("exons", -1)["end"], F.col("strand") == "+"
    cds = F.size("cds").cast("bigint") if "cds" in parts.columns else F.lit(None).cast("bigint")

    def side(name: str, at_end: Column, point: Column) -> Column:
        low = F.when(at_end, F.greatest(end - FLANK, F.lit(0))).otherwise(start)
        high = F.when(at_end, end).otherwise(start + FLANK)
        values = {"chr": F.col("chr"), "strand": F.col("strand"), "break": point, "exons": F.size("exons").cast("bigint"), "cds": cds, "from": low, "to": high}
        return F.struct(*(v.alias(f"{name}_{k}") for k, v in values.items()))

    left, right = side("left", plus, F.when(plus, end).otherwise(start + 1)), side("right", ~plus, F.when(plus, start).otherwise(end))
    return parts.groupBy("fusion_id").agg(F.min_by(left, "part").alias("_l"), F.max_by(right, "part").alias("_r")).select("fusion_id", "_l.*", "_r.*")


def with_verdict(fusions: DataFrame, min_count: int = 2, min_distance: int = 10_000, mitochondrial: str | None = "MT-") -> DataFrame:
    """Add ``verdict``: FAIL with the first reason that holds, else PASS; a null count is never too few.

    ``fusions``: ``left_gene``, ``right_gene`` (null, empty or novel...: no known gene), ``count_fl``, chromosomes and
    breakpoints.  ``mitochondrial`` is how the names of such genes begin; None lets them pass.
    """
    novel = lambda c: F.col(c).isNull() | (F.col(c) == "") | F.lower(F.col(c)).startswith("novel")
    near = (F.col("left_chr") == F.col("right_chr")) & (F.abs(F.col("left_break") - F.col("right_break")) <= min_distance)
    organelle = F.lit(False) if mitochondrial is None else F.col("left_gene").startswith(mitochondrial) | F.col("right_gene").startswith(mitochondrial)
    any_novel = novel("left_gene") | novel("right_gene")
    if "any_novel" in fusions.columns:
        any_novel = any_novel | F.col("any_novel")
    verdict = (
        F.when(any_novel, "FAIL:NovelGene")
        .when(F.col("left_gene") == F.col("right_gene"), "FAIL:SameGene")
        .when(F.col("count_fl") < min_count, "FAIL:TooFewFLReads")
        .when(organelle, "FAIL:MtGenes")
        .when(near, "FAIL:BreakpointTooClose")
        .otherwise("PASS")
    )
    return fusions.withColumn("verdict", verdict)


def collate(
    parts: DataFrame, classes: DataFrame, counts: DataFrame | None = None, genome: DataFrame | None = None, sequences: DataFrame | None = None,
    gene_ids: DataFrame | None = None, total: int | None = None, **limits,
) -> DataFrame:
    """One row for each fusion with all that is known of it.

    ``parts`` as for ``ends_of``; ``classes``: ``fusion_id``, ``part``, ``gene``, ``orf``; ``counts``: ``fusion_id``, ``count_fl``;
    ``genome``: ``chr``, ``sequence`` or windows of it; ``sequences``: ``fusion_id``, ``sequence``; ``gene_ids``: ``gene``, ``gene_id`` (several
    are joined by ``_``).  Columns: ``fusion_id``, ``fusion_name`` (all genes joined by ``--``), and for left and right ``_gene``,
    ``_gene_id``, ``_breakpoint`` (``chr:place:strand``), ``_flank`` (FLANK bases along the strand), ``_orf``, ``_exons``, ``_cds``;
    ``count_fl``, ``score`` (reads of a million of ``total``, which is the sum of all counts if not given), ``sequence``
    and ``verdict``.  What isn't given is null.  ``limits`` go to ``with_verdict``.
    """
    novel = F.col("gene").isNull() | (F.col("gene") == "") | F.lower("gene").startswith("novel")
    named = F.array_sort(F.collect_list(F.struct("part", F.coalesce("gene", F.lit("")).alias("g"))))
    of_class = classes.groupBy("fusion_id").agg(
        F.array_join(F.transform(named, lambda x: x["g"]), "--").alias("fusion_name"), F.max(novel).alias("any_novel"),
        F.min_by("gene", "part").alias("left_gene"), F.max_by("gene", "part").alias("right_gene"), F.min_by("orf", "part").alias("left_orf"), F.max_by("orf", "part").alias("right_orf"),
    )
    rows = of_class.join(ends_of(parts), "fusion_id")
    none = F.lit(None).cast("string")
    for side in ("left", "right"):
        rows = rows.withColumn(f"{side}_breakpoint", F.concat_ws(":", f"{side}_chr", F.col(f"{side}_break").cast("string"), f"{side}_strand"))
        if genome is None:
            rows = rows.withColumn(f"{side}_flank", none)
        else:
            cut = cut_sequences(rows.withColumn("chr", F.col(f"{side}_chr")), genome, f"{side}_from", f"{side}_to", whole=False).drop("chr")
            rows = cut.withColumn(f"{side}_flank", F.when(F.col(f"{side}_strand") == "-", reverse_complement("piece")).otherwise(F.col("piece"))).drop("piece")
        if gene_ids is None:
            rows = rows.withColumn(f"{side}_gene_id", none)
        else:
            ids = gene_ids.groupBy(F.col("gene").alias(f"{side}_gene")).agg(F.array_join(F.array_sort(F.collect_set("gene_id")), "_").alias(f"{side}_gene_id"))
            rows = rows.join(ids, f"{side}_gene", "left")
    rows = rows.join(sequences.select("fusion_id", "sequence"), "fusion_id", "left") if sequences is not None else rows.withColumn("sequence", none)
    if counts is None:
        rows = rows.withColumns({"count_fl": F.lit(None).cast("bigint"), "score": F.lit(None).cast("double")})
    else:
        of_all = F.lit(float(total)) if total is not None else F.lit(float(counts.agg(F.sum("count_fl")).first()[0] or 0))
        rows = rows.join(counts.select("fusion_id", "count_fl"), "fusion_id", "left").withColumn("score", F.try_divide(F.col("count_fl") * 1e6, of_all))
    rows = with_verdict(rows, **limits)
    sides = [f"{side}_{c}" for side in ("left", "right") for c in ("gene", "gene_id", "breakpoint", "flank", "orf", "exons", "cds")]
    return rows.select("fusion_id", "fusion_name", *sides, "count_fl", "score", "sequence", "verdict")
