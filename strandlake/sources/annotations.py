"""GFF and GTF dialects, BED and other tables with places on a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes of junction tables.
STAR_STRANDS = ["NA", "+", "-"]
STAR_MOTIFS = ["non-canonical", "GT/AG", "CT/AC", "GC/AG", "CT/GC", "AT/AC", "GT/AT"]

_GFF = ("chr", "source", "feature", "s", "e", "score", "strand", "frame", "attributes")


def _columns(lines: DataFrame, names: tuple[str, ...], sep: str = "\t") -> DataFrame:
    parts = F.split("value", sep)
    return lines.select(*(F.nullif(F.try_element_at(parts, F.lit(i + 1)), F.lit(".")).alias(n) for i, n in enumerate(names)))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Feature lines of GFF or GTF: ``s`` from 0, ``e`` exclusive, ``.`` as null."""
    return parse_gff(spark.read.text(path))


def parse_gff(lines: DataFrame) -> DataFrame:
    rows = _columns(lines.filter("value <> '' AND NOT startswith(value, '#')"), _GFF)
    return rows.withColumns({"s": F.col("s").cast("bigint") - 1, "e": F.col("e").cast("bigint")})


def attribute(name: str, dialect: str = "gtf"):
    """An attribute: ``name "value";`` in GTF, ``name=value;`` in GFF3 and the variant dialect."""
    pattern = rf'(?:^|[; ]){name} "([^"]*)"' if dialect == "gtf" else rf"(?:^|;) *{name}=([^;]*)"
    return F.nullif(F.regexp_extract("attributes", pattern, 1), F.lit(""))


# How each dialect names the parts of a transcript and the attribute that ties them together.
DIALECTS = {
    "collapsed": {"style": "gtf", "id": "transcript_id", "gene": "gene_id", "exon": "exon"},
    "ucsc": {"style": "gtf", "id": "transcript_id", "gene": "gene_id", "exon": "exon"},
    "gmap": {"style": "gff3", "id": "Parent", "gene": "Parent", "exon": "exon"},
    "pasa": {"style": "gtf", "id": "transcript_id", "gene": "gene_id", "exon": "exon"},
    "maize": {"style": "gff3", "id": "Parent", "gene": "Parent", "exon": "exon"},
    "exonerate": {"style": "gff2", "id": "Query", "gene": "sequence", "exon": "exon"},
}


def transcripts(features: DataFrame, dialect: str = "collapsed") -> DataFrame:
    """Transcripts with ascending ``exons`` and ``cds``: ``id``, ``gene``, ``chr``, ``strand``, ``start``, ``end``.

    Lines belong together by their attribute, so their order doesn't matter.  Transcripts on
    both strands or on two chromosomes, as non-colinear alignments give, are left out.
    """
    d = DIALECTS[dialect]
    style = "gff3" if d["style"] == "gff3" else "gtf"
    key = attribute(d["id"], style) if d["style"] != "gff2" else F.nullif(F.regexp_extract("attributes", r"(?:sequence|Query) (\S+)", 1), F.lit(""))
    gene = attribute(d["gene"], style) if d["style"] != "gff2" else key
    rows = features.filter(F.col("feature").isin(d["exon"], "CDS")).select(key.alias("id"), gene.alias("gene"), "chr", "strand", "feature", "s", "e").filter("id is not null")
    spans = lambda kind: F.array_sort(F.collect_list(F.when(F.col("feature") == kind, F.struct(F.col("s").alias("start"), F.col("e").alias("end")))))
    out = rows.groupBy("id").agg(
        F.max("gene").alias("gene"), F.min("chr").alias("chr"), F.max("chr").alias("_c"), F.min("strand").alias("strand"), F.max("strand").alias("_t"),
        spans(d["exon"]).alias("exons"), spans("CDS").alias("cds"),
    )
    out = out.filter("chr = _c AND strand = _t AND size(exons) > 0").drop("_c", "_t")
    return out.withColumns({"start": F.col("exons")[0]["start"], "end": F.element_at("exons", -1)["end"]})


# The dialect that a program's name in the second column stands for.
PROGRAMS = {"GMAP": "gmap", "PASA": "pasa"}


def dialect_of(features: DataFrame) -> str:
    """The dialect that the program of the first feature has; another program is an error."""
    first = features.select("source").first()
    if first is None or first[0] not in PROGRAMS:
        raise ValueError(f"no dialect for the program {first and first[0]}")
    return PROGRAMS[first[0]]


def gmap_transcripts(features: DataFrame, colinear: bool = True) -> DataFrame:
    """Aligned transcripts of GFF3: those of ``transcripts`` with ``name``, ``coverage``, ``identity``, ``cds_start``, ``cds_end`` and
    ``q_exons``, the part of the read of each exon, in the order of ``exons``; read places from 0, exclusive.

    An mRNA line has the attributes ID, Name, coverage and identity; exon and CDS lines name it as Parent
    and have ``Target=<read> <start> <end> [strand]``.  Exons are colinear if their places on the read ascend
    along the strand; with ``colinear`` other records are left out.
    """
    def target(i: int):
        return F.regexp_extract("attributes", r"(?:^|;) *Target=\S+ ([0-9]+) ([0-9]+)", i)

    head = features.filter("feature = 'mRNA'").select(
        attribute("ID", "gff3").alias("id"), attribute("Name", "gff3").alias("name"),
        attribute("coverage", "gff3").cast("double").alias("coverage"), attribute("identity", "gff3").cast("double").alias("identity"),
    )
    rows = features.filter("feature IN ('exon', 'CDS')").withColumns({"id": attribute("Parent", "gff3"), "_q": F.when(target(1) != "", target(1).cast("bigint") - 1), "_r": F.when(target(2) != "", target(2).cast("bigint"))})
    is_exon = F.col("feature") == "exon"
    pairs = F.array_sort(F.collect_list(F.when(is_exon, F.struct("s", F.struct(F.col("_q").alias("start"), F.col("_r").alias("end")).alias("q")))))
    ends = rows.groupBy("id").agg(F.transform(pairs, lambda x: x["q"]).alias("q_exons"), F.min(F.when(~is_exon, F.col("_q"))).alias("cds_start"), F.max(F.when(~is_exon, F.col("_r"))).alias("cds_end"))
    out = transcripts(features, "gmap").drop("gene").join(ends, "id").join(head, "id", "left")
    if not colinear:
        return out
    along = F.when(F.col("strand") == "-", F.reverse("q_exons")).otherwise(F.col("q_exons"))
    behind = F.zip_with(F.slice(along, F.lit(1), F.size(along) - 1), F.slice(along, F.lit(2), F.size(along) - 1), lambda x, y: F.coalesce(y["start"] < x["end"], F.lit(False)))
    return out.filter((F.size("q_exons") < 2) | ~F.exists(behind, lambda x: x))


def transcripts_of_exons(features: DataFrame) -> DataFrame:
    """Annotated transcripts of each exon (GTF): ``chr``, ``strand``, ``s``, ``e``, ``transcripts`` sorted."""
    rows = features.filter("feature = 'exon'").withColumn("_t", attribute("transcript_id")).filter("_t is not null")
    return rows.groupBy("chr", "strand", "s", "e").agg(F.array_sort(F.collect_set("_t")).alias("transcripts"))


def transcript_info(features: DataFrame) -> DataFrame:
    """Gene of each annotated transcript (GTF): ``transcript``, ``gene_id``, ``gene_name``, ``transcript_name``, ``gene_type``."""
    names = {"gene_id": "gene_id", "gene_name": "gene_name", "transcript_name": "transcript_name", "gene_type": "gene_type"}
    rows = features.select(attribute("transcript_id").alias("transcript"), *(attribute(a).alias(n) for n, a in names.items())).filter("transcript is not null")
    return rows.groupBy("transcript").agg(*(F.max(n).alias(n) for n in names))


def ends_of_transcripts(features: DataFrame, five_prime: bool) -> DataFrame:
    """The 5' or 3' end of each annotated transcript (GTF): ``transcript``, ``chr``, ``strand``, ``pos`` (from 0)."""
    rows = features.filter("feature = 'exon'").withColumn("transcript", attribute("transcript_id")).filter("transcript is not null")
    out = rows.groupBy("transcript", "chr", "strand").agg(F.min("s").alias("_s"), F.max("e").alias("_e"))
    first = (F.col("strand") == "+") if five_prime else (F.col("strand") == "-")
    return out.select("transcript", "chr", "strand", F.when(first, F.col("_s")).otherwise(F.col("_e") - 1).alias("pos"))


def parse_variant_gff(lines: DataFrame) -> DataFrame:
    """Variant features with ``attrs``, a map of their ``key=value`` attributes."""
    return parse_gff(lines).withColumn("attrs", F.str_to_map("attributes", F.lit(";"), F.lit("=")))


def fusion_parts(records: DataFrame, key: str = "id") -> DataFrame:
    """Fusions from transcripts named ``<fusion>.<part>``: ``id`` of the fusion and ``parts`` in order."""
    pattern = r"^(\S+\.[0-9]+)\.([0-9]+)$"
    rows = records.select(F.regexp_extract(key, pattern, 1).alias("id"), F.regexp_extract(key, pattern, 2).cast("bigint").alias("_n"), "chr", "strand", "exons").filter("id <> ''")
    array = F.array_sort(F.collect_list(F.struct("_n", "chr", "strand", "exons")))
    return rows.groupBy("id").agg(array.alias("_a")).select("id", F.transform("_a", lambda x: F.struct(x["chr"].alias("chr"), x["strand"].alias("strand"), x["exons"].alias("exons"))).alias("parts"))


def find_transcripts(exons: DataFrame, regions: DataFrame) -> DataFrame:
    """Annotated transcripts with an exon in each region: region columns and ``transcript``, each once."""
    from strandlake.operators.intervals import overlap_join

    met = overlap_join(regions, exons.select("chr", F.col("s").alias("_xs"), F.col("e").alias("_xe"), "transcript"), ["chr"], ("s", "e"), ("_xs", "_xe"))
    return met.select(*regions.columns, "transcript").distinct()


def read_variant_gff(spark: SparkSession, path: str) -> DataFrame:
    """Variant features with ``attrs``, a map of their ``key=value`` attributes."""
    return parse_variant_gff(spark.read.text(path))


def parse_bed(lines: DataFrame, start_base: int = 0, end_base: int = 1) -> DataFrame:
    """BED lines as ``chr``, ``s`` (from 0), ``e`` (exclusive), ``name``, ``score``, ``strand``; missing columns are null."""
    rows = _columns(lines.filter("value <> '' AND NOT value RLIKE '^(#|track|browser)'"), ("chr", "s", "e", "name", "score", "strand"))
    return rows.withColumns({"s": F.col("s").cast("bigint") - start_base, "e": F.col("e").cast("bigint") + (1 - end_base)})


def read_bed(spark: SparkSession, path: str, **bases: int) -> DataFrame:
    return parse_bed(spark.read.text(path), **bases)


def point_lookup(points: DataFrame, bed: DataFrame) -> DataFrame:
    """Names of points (``chr``, ``pos``) that start a BED line; ``NA`` for others, the least of several."""
    names = bed.groupBy("chr", F.col("s").alias("pos")).agg(F.min("name").alias("name"))
    return points.join(names, ["chr", "pos"], "left").fillna("NA", ["name"])


def parse_star_junctions(lines: DataFrame) -> DataFrame:
    """Junction lines of nine columns, strand and motif as text."""
    names = ("chr", "s", "e", "strand", "motif", "annotated", "n_unique", "n_multi", "overhang")
    rows = _columns(lines.filter("value <> ''"), names, r"\s+")
    for name in names[1:]:
        rows = rows.withColumn(name, F.col(name).cast("bigint"))
    code = lambda texts, c: F.try_element_at(F.array(*map(F.lit, texts)), (F.col(c) + 1).cast("int"))
    return rows.withColumns({"s": F.col("s") - 1, "strand": code(STAR_STRANDS, "strand"), "motif": code(STAR_MOTIFS, "motif"), "annotated": F.col("annotated") == 1})


def read_star_junctions(spark: SparkSession, path: str) -> DataFrame:
    return parse_star_junctions(spark.read.text(path))


def parse_snps(lines: DataFrame) -> DataFrame:
    """SNP lines of twelve columns: places from 0, strands from frames, ``.`` bases for gaps; other lines are left out."""
    names = ("ref_pos", "ref_base", "query_base", "query_pos", "_5", "_6", "ref_len", "query_len", "ref_strand", "query_strand", "ref_name", "query_name")
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.size(parts) == 12).select(*(parts[i].alias(n) for i, n in enumerate(names))).drop("_5", "_6")
    strand = lambda c: F.when(F.col(c) == "1", "+").otherwise("-")
    numbers = {c: F.col(c).cast("bigint") for c in ("ref_len", "query_len")}
    return rows.withColumns(
        {**numbers, "ref_pos": F.col("ref_pos").cast("bigint") - 1, "query_pos": F.col("query_pos").cast("bigint") - 1, "ref_strand": strand("ref_strand"), "query_strand": strand("query_strand")}
    )


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    return parse_snps(spark.read.text(path))


def parse_pileup(lines: DataFrame) -> DataFrame:
    """Pileup lines: ``chr``, ``pos`` (from 0), ``ref``, ``cov``, ``read_bases``, ``base_quals``, ``aln_quals``.

    Lines have 7 or 15 columns, or 4 with no coverage; any other number is an error.
    """
    parts = F.split("value", "\t")
    n = F.size(parts)
    known = F.when(n.isin(4, 7, 15), parts).otherwise(F.raise_error(F.concat(F.lit("pileup line of "), n, F.lit(" columns"))).cast("array<string>"))
    rows = lines.filter("value <> ''").select(known.alias("p"))
    at = lambda i: F.try_element_at("p", F.lit(i))
    full = F.size("p") >= 7
    return rows.select(
        at(1).alias("chr"), (at(2).cast("bigint") - 1).alias("pos"), at(3).alias("ref"), F.when(full, at(4).cast("bigint")).otherwise(0).alias("cov"),
        F.when(full, at(5)).alias("read_bases"), F.when(full, at(6)).alias("base_quals"), F.when(full, at(7)).alias("aln_quals"),
    )


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    return parse_pileup(spark.read.text(path))


def parse_btab(lines: DataFrame) -> DataFrame:
    """Lines of a 15-column aligner table as blocks: ends in ascending order, ``s`` from 0, strand by their order."""
    p = F.split("value", "\t")
    lo, hi = p[6].cast("bigint"), p[7].cast("bigint")
    q1, q2 = p[8].cast("bigint"), p[9].cast("bigint")
    return lines.filter(F.size(p) >= 15).select(
        p[0].alias("chr"), p[5].alias("name"), (F.least(lo, hi) - 1).alias("s"), F.greatest(lo, hi).alias("e"), F.least(q1, q2).alias("q_from"), F.greatest(q1, q2).alias("q_to"),
        p[10].cast("double").alias("identity"), p[13].cast("bigint").alias("block"), F.when(lo <= hi, "+").otherwise("-").alias("strand"),
    )


def btab_blocks(rows: DataFrame) -> DataFrame:
    """Intervals of each block in order: ``chr``, ``name``, ``block``, ``exons``."""
    array = F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end"))))
    return rows.groupBy("chr", "name", "block").agg(array.alias("exons"))
