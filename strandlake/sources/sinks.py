"""Text forms of results, as DataFrames of lines, and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shades of red from the strongest to the weakest isoform of a gene.
SHADES = [
    "0,0,0", "26,0,0", "51,0,0", "77,0,0", "102,0,0", "128,0,0", "153,0,0", "179,0,0", "204,0,0", "230,0,0",
    "255,0,0", "255,26,26", "255,51,51", "255,77,77", "255,102,102", "255,128,128", "255,153,153", "255,179,179", "255,204,204", "255,230,230",
]


def gff_lines(records: DataFrame, source: str = "strandlake", key: str = "pbid", gene: str = "gene") -> DataFrame:
    """A transcript line, then its exon and CDS lines: ``id``, ``line_no``, ``value``.  Starts count from 1.

    ``records``: key, gene, ``chr``, ``strand``, ``exons`` and, if it has them, ``cds``.
    """
    tail = F.concat(F.lit('gene_id "'), F.col(gene), F.lit('"; transcript_id "'), F.col(key), F.lit('";'))

    def line(feature: str, start: Column, end: Column) -> Column:
        return F.concat_ws("\t", "chr", F.lit(source), F.lit(feature), (start + 1).cast("string"), end.cast("string"), F.lit("."), "strand", F.lit("."), tail)

    lines = F.concat(
        F.array(line("transcript", F.col("exons")[0]["start"], F.element_at("exons", -1)["end"])),
        F.transform("exons", lambda x: line("exon", x["start"], x["end"])),
        F.transform("cds", lambda x: line("CDS", x["start"], x["end"])) if "cds" in records.columns else F.array().cast("array<string>"),
    )
    return records.select(F.col(key).alias("id"), F.posexplode(lines).alias("line_no", "value"))


def gff3_lines(alignments: DataFrame, source: str = "strandlake", key: str = "name") -> DataFrame:
    """A gene line and exon lines of each alignment, in GFF3: ``id``, ``line_no``, ``value``."""

    def line(feature: str, start: Column, end: Column, attributes: Column) -> Column:
        return F.concat_ws("\t", "chr", F.lit(source), F.lit(feature), (start + 1).cast("string"), end.cast("string"), F.lit("."), "strand", F.lit("."), attributes)

    gene = F.concat(F.lit("ID="), F.col(key), F.lit(";Name="), F.col(key))
    exon = lambda i: F.concat(F.lit("ID="), F.col(key), F.lit(".exon"), i + 1, F.lit(";Parent="), F.col(key))
    lines = F.concat(
        F.array(line("gene", F.col("exons")[0]["start"], F.element_at("exons", -1)["end"], gene)), F.transform("exons", lambda x, i: line("exon", x["start"], x["end"], exon(i)))
    )
    return alignments.select(F.col(key).alias("id"), F.posexplode(lines).alias("line_no", "value"))


def bed12_lines(records: DataFrame, key: str = "pbid", gene: str = "gene") -> DataFrame:
    """BED12 lines coloured by ``shade``, named ``gene|id|cpm``; starts count from 0: ``id``, ``value``."""
    start = F.col("exons")[0]["start"]
    end = F.element_at("exons", -1)["end"]
    sizes = F.array_join(F.transform("exons", lambda x: (x["end"] - x["start"]).cast("string")), ",")
    starts = F.array_join(F.transform("exons", lambda x: (x["start"] - start).cast("string")), ",")
    colour = F.element_at(F.array(*map(F.lit, SHADES)), (F.col("shade") + 1).cast("int"))
    name = F.concat_ws("|", F.col(gene), F.col(key), F.floor("cpm").cast("string"))
    fields = ["chr", start, end, name, F.lit("0"), "strand", start, end, colour, F.size("exons"), sizes, starts]
    return records.select(F.col(key).alias("id"), F.concat_ws("\t", *(F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields)).alias("value"))


def bed_lines(df: DataFrame, columns: Sequence[str] = ("chr", "s", "e", "name")) -> DataFrame:
    return df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns)).alias("value"))


def junction_bed_lines(report: DataFrame) -> DataFrame:
    """Junctions as BED: the end is the base after the acceptor's first."""
    name = F.concat_ws("_", F.lit("n"), F.col("num_transcript").cast("string"))
    return report.select(F.concat_ws("\t", "chr", F.col("left").cast("string"), (F.col("right") + 1).cast("string"), name, F.lit("0"), "strand").alias("value"))


def fasta_lines(records: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    return records.select(F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col(seq)).alias("value"))


def fastq_lines(records: DataFrame, key: str = "id", seq: str = "seq", qual: str = "qual", constant: int = 60) -> DataFrame:
    """Four-line records; without a quality each base gets the constant one."""
    quality = F.coalesce(F.col(qual), F.repeat(F.lit(chr(constant + 33)), F.length(seq))) if qual in records.columns else F.repeat(F.lit(chr(constant + 33)), F.length(seq))
    return records.select(F.concat(F.lit("@"), F.col(key), F.lit("\n"), F.col(seq), F.lit("\n+\n"), quality).alias("value"))


def vcf_header(samples: Sequence[str]) -> list[str]:
    """Header lines of a variant file with the given samples."""
    # The fields of the lines that ``vcf_lines`` gives.
    return [
        "##fileformat=VCFv4.2",
        '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele Frequency">',
        '##INFO=<ID=DP,Number=1,Type=Integer,Description="Total Depth">',
        '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
        '##FORMAT=<ID=HQ,Number=2,Type=Integer,Description="Haplotype Quality">',
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]),
    ]


def vcf_lines(alleles: DataFrame, of_haplotypes: DataFrame, tally: DataFrame, by: str = "chr") -> DataFrame:
    """Variant lines of phased loci: by, ``pos``, ``value``; and so the samples of a locus are its isoforms by name.

    ``alleles`` and ``of_haplotypes`` as ``phasing.alleles`` and ``phasing.haplotype_alleles`` give them;
    ``tally``: by, ``pbid``, ``hap_idx``, ``n``.  A line has REF, the other bases by allele number,
    their shares of the called reads, the depth, and for each isoform the alleles of its
    haplotypes joined by ``|`` in their order (a point for none) and their reads joined by commas.
    """
    called = F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(by, "pos"))
    rows = alleles.select(by, "pos", "ref", "allele", "base", "n", F.format_string("%.2f", called).alias("_share"))
    others = F.array_sort(F.collect_list(F.when(F.col("allele") > 0, F.struct("allele", "base", "_share"))))
    site = rows.groupBy(by, "pos", "ref").agg(others.alias("_o"), F.sum("n").alias("_dp"))
    text = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    calls = of_haplotypes.join(tally, [by, "hap_idx"])
    gt = F.struct("hap_idx", F.coalesce(F.col("allele").cast("string"), F.lit(".")).alias("g"), "n")
    calls = calls.groupBy(by, "pos", "pbid").agg(F.array_sort(F.collect_list(gt)).alias("_a"))
    sample = F.concat(F.array_join(F.transform("_a", lambda x: x["g"]), "|"), F.lit(":"), text("_a", "n"))
    samples = calls.select(by, "pos", "pbid", sample.alias("_s")).groupBy(by, "pos").agg(F.array_sort(F.collect_list(F.struct("pbid", "_s"))).alias("_l"))
    info = F.concat(F.lit("AF="), text("_o", "_share"), F.lit(";DP="), F.col("_dp").cast("string"))
    alt = F.when(F.size("_o") > 0, text("_o", "base")).otherwise(".")
    fields = [F.col(by).cast("string"), (F.col("pos") + 1).cast("string"), F.lit("."), F.col("ref"), alt, F.lit("."), F.lit("PASS"), info, F.lit("GT:HQ"), F.array_join(F.transform("_l", lambda x: x["_s"]), "\t")]
    return site.join(samples, [by, "pos"]).select(by, "pos", F.concat_ws("\t", *fields).alias("value"))


def snp_vcf(snps: DataFrame, genome: DataFrame) -> DataFrame:
    """Merge consecutive SNP rows into substitutions, insertions and deletions with an anchor base:
    ``chr``, ``pos1``, ``ref``, ``alt``.

    ``snps`` as ``parse_snps`` gives them.  Gap rows of one kind belong together if the places
    with bases follow each other and the others stand still.  The anchor is N where the genome
    (``chr``, ``sequence``, or windows of it) doesn't have it.
    """
    from strandlake.operators.seqtools import cut_sequences

    kind = F.when(F.col("ref_base") == ".", "ins").when(F.col("query_base") == ".", "del").otherwise("snp")
    rows = snps.withColumn("_kind", kind)
    # What stands still is part of the key, so that a group has the rows of few runs.
    still = F.when(F.col("_kind") == "ins", F.col("ref_pos")).when(F.col("_kind") == "del", F.col("query_pos"))
    moving = F.when(F.col("_kind") == "ins", F.col("query_pos")).otherwise(F.col("ref_pos"))
    rows = rows.withColumns({"_still": still, "_moving": moving, "_alone": F.when(F.col("_kind") == "snp", F.struct("ref_pos", "query_pos", "query_base"))})
    order = Window.partitionBy("ref_name", "query_name", "_kind", "_still", "_alone").orderBy("_moving")
    goes_on = (F.col("_kind") != "snp") & (F.col("_moving") - F.lag("_moving").over(order) == 1)
    rows = rows.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_pos", "query_pos", F.col(c).alias("b")))), lambda x: x["b"]), "")
    merged = rows.groupBy("ref_name", "query_name", "_kind", "_still", "_alone", "_g").agg(F.min("ref_pos").alias("_at"), in_order("ref_base").alias("_r"), in_order("query_base").alias("_q"))
    # The anchor is the base before a deletion and the base at an insertion's place.
    anchor = F.when(F.col("_kind") == "del", F.col("_at") - 1).otherwise(F.col("_at"))
    merged = merged.select(F.col("ref_name").alias("chr"), "_kind", "_at", "_r", "_q", anchor.alias("_anchor"), (anchor + 1).alias("_next"))
    rows = cut_sequences(merged, genome, "_anchor", "_next")
    base = F.coalesce(F.nullif("piece", F.lit("")), F.lit("N"))
    gap = lambda c: F.replace(F.col(c), F.lit("."), F.lit(""))
    snp = F.col("_kind") == "snp"
    return rows.select(
        "chr", (F.when(snp, F.col("_at")).otherwise(F.col("_anchor")) + 1).alias("pos1"),
        F.when(snp, F.col("_r")).otherwise(F.concat(base, gap("_r"))).alias("ref"), F.when(snp, F.col("_q")).otherwise(F.concat(base, gap("_q"))).alias("alt"),
    )


def ucsc_lines(records: DataFrame, key: str = "pbid") -> DataFrame:
    """Exon lines for a genome browser, named by the last field, and ``###`` after them: ``id``, ``line_no``, ``value``.

    ``records``: key, ``chr``, ``strand``, ``exons`` and, if it has one, ``score``.  On the minus strand the last exon comes first.
    """
    score = F.coalesce(F.col("score").cast("string"), F.lit(".")) if "score" in records.columns else F.lit(".")
    along = F.when(F.col("strand") == "-", F.reverse("exons")).otherwise(F.col("exons"))
    lines = F.transform(along, lambda x: F.concat_ws("\t", "chr", F.lit("NA"), F.lit("exon"), (x["start"] + 1).cast("string"), x["end"].cast("string"), F.lit("."), "strand", score, key))
    return records.select(F.col(key).alias("id"), F.posexplode(F.concat(lines, F.array(F.lit("###")))).alias("line_no", "value"))


def exon_picture_lines(records: DataFrame, key: str = "pbid") -> DataFrame:
    """A line ``<id> exon <start> <end>`` for each exon, for drawing: ``id``, ``line_no``, ``value``.

    The start counts from 1 and the end is one more than the last base, as readers of this format expect.
    """
    lines = F.transform("exons", lambda x: F.concat_ws(" ", key, F.lit("exon"), (x["start"] + 1).cast("string"), (x["end"] + 1).cast("string")))
    return records.select(F.col(key).alias("id"), F.posexplode(lines).alias("line_no", "value"))


def hits_to_records(hits: DataFrame) -> DataFrame:
    """Transcripts from tabular search hits (``query``, ``chr``, ``strand``, ``s``, ``e``): ``pbid``, ``chr``, ``strand``, ``exons`` ascending.

    All hits of a query must lie on one chromosome and strand; else it is an error of the input.
    """
    exon = F.struct(F.col("s").cast("bigint").alias("start"), F.col("e").cast("bigint").alias("end"))
    rows = hits.groupBy(F.col("query").alias("pbid")).agg(
        F.min("chr").alias("chr"), F.min("strand").alias("strand"), F.array_sort(F.collect_list(exon)).alias("exons"), F.countDistinct("chr", "strand").alias("_n")
    )
    checked = F.when(F.col("_n") == 1, F.col("exons")).otherwise(F.raise_error(F.concat(F.lit("hits of several places: "), "pbid")))
    return rows.select("pbid", "chr", "strand", checked.alias("exons"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Write ``value`` as text; with an order, in range partitions, so that no task writes all lines."""
    ordered = lines.orderBy(*order) if order else lines
    ordered.select("value").write.text(path)


def write_groups(rows: DataFrame, membership: DataFrame, key: str, path: str, group: str = "grp") -> None:
    """Write the rows of each group below ``<path>/<group>=...``; a row may belong to several groups."""
    rows.join(membership.select(key, group).distinct(), key).write.partitionBy(group).parquet(path)


def with_na(df: DataFrame) -> DataFrame:
    """All columns as text with ``NA`` for null, as the delimited tables have it."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in df.columns))
