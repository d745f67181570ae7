"""Queries over formats, structures, phasing and molecular tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequence as fs
from strandlake.functions.alignment import cigar_segments, cigar_summary, sam_flag
from strandlake.functions.tags import plain_value, tag_value
from strandlake.operators import aligner, chain, collapse, compare, counts, fusion, junctions, phasing, seqtools, singlecell
from strandlake.plans.registry import Tables, query
from strandlake.session import stage
from strandlake.sources import alignments, annotations, sinks, tables

# --- formats ---------------------------------------------------------------------------------------

_OPS = """SELECT read_id, part, pos, cigar, i, CAST(n AS BIGINT) AS n, op FROM (SELECT *, unnest(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 1)) AS n,
  unnest(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 2)) AS op, generate_subscripts(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 1), 1) AS i FROM (SELECT DISTINCT * FROM x_cigar))"""


@query(
    f"""SELECT read_id, part, pos, cigar, CAST(sum(CASE WHEN op = 'I' THEN n ELSE 0 END) AS BIGINT) AS num_ins, CAST(sum(CASE WHEN op = 'D' THEN n ELSE 0 END) AS BIGINT) AS num_del,
  CAST(sum(CASE WHEN op = 'M' THEN n ELSE 0 END) AS BIGINT) AS num_match, CAST(sum(CASE WHEN op IN ('S', 'H') AND i = 1 THEN n ELSE 0 END) AS BIGINT) AS clip_start,
  CAST(sum(CASE WHEN op IN ('M', 'I') THEN n ELSE 0 END) AS BIGINT) AS query_span FROM ({_OPS}) GROUP BY read_id, part, pos, cigar"""
)
def f01_cigar_summary(t: Tables) -> DataFrame:
    s = cigar_summary("cigar")
    return t.x_cigar.distinct().select("read_id", "part", "pos", "cigar", *(s[c].alias(c) for c in ("num_ins", "num_del", "num_match", "clip_start", "query_span")))


@query(
    f"""WITH o AS ({_OPS}), r AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END) OVER w, 0) AS rs,
    sum(CASE WHEN op = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY read_id, part, pos, cigar ORDER BY i ROWS UNBOUNDED PRECEDING) AS seg FROM o
    WINDOW w AS (PARTITION BY read_id, part, pos, cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  g AS (SELECT read_id, part, pos, cigar, seg, min(rs) AS s, max(rs + n) AS e FROM r WHERE op IN ('M', 'D') GROUP BY ALL)
  SELECT read_id, part, pos, cigar, string_agg(CAST(CAST(s AS BIGINT) AS STRING) || '-' || CAST(CAST(e AS BIGINT) AS STRING), ',' ORDER BY s) AS exons FROM g GROUP BY read_id, part, pos, cigar"""
)
def f01_cigar_segments(t: Tables) -> DataFrame:
    return t.x_cigar.distinct().select("read_id", "part", "pos", "cigar", compare.exon_text(cigar_segments("cigar", "pos")).alias("exons"))


@query("SELECT flag, flag & 1 > 0 AS is_paired, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS strand, flag & 256 > 0 AS is_secondary, flag & 2048 > 0 AS is_supplementary FROM (SELECT DISTINCT l_partkey % 4096 AS flag FROM lineitem)")
def f02_sam_flags(t: Tables) -> DataFrame:
    f = sam_flag("flag")
    return t.lineitem.select((F.col("l_partkey") % 4096).alias("flag")).distinct().select("flag", *(f[c].alias(c) for c in ("is_paired", "strand", "is_secondary", "is_supplementary")))


def _sam_lines(t: Tables) -> DataFrame:
    fields = [F.concat(F.lit("r"), "read_id"), (F.col("read_id") % 2 * 16), F.lit("chr1"), F.col("pos") + 1, F.lit(60), F.col("cigar"), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.concat(F.lit("NM:i:"), "part")]
    return t.x_cigar.distinct().select(F.concat_ws("\t", *(f.cast("string") for f in fields)).alias("value"))


@query(
    f"""WITH o AS ({_OPS}), a AS (SELECT read_id, part, pos, cigar, sum(CASE WHEN op IN ('M', 'I') THEN n ELSE 0 END) AS span, sum(CASE WHEN op IN ('M', 'I', 'D') THEN n ELSE 0 END) AS cols,
    sum(CASE WHEN op = 'S' THEN n ELSE 0 END) AS clip, sum(CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END) AS ref FROM o GROUP BY ALL)
  SELECT 'r' || read_id AS read_id, pos AS s, CAST(pos + ref AS BIGINT) AS e, CASE WHEN read_id % 2 = 1 THEN '-' ELSE '+' END AS strand, CAST(CASE WHEN read_id % 2 = 1 THEN 0 ELSE clip END AS BIGINT) AS q_start,
  round(span / (span + clip), 6) AS q_coverage, round(1 - part / cols, 6) AS identity FROM a"""
)
def s02_sam_alignments(t: Tables) -> DataFrame:
    rows = alignments.with_alignment(alignments.parse_sam(_sam_lines(t)))
    return rows.select("read_id", "s", "e", "strand", "q_start", F.round("q_coverage", 6).alias("q_coverage"), F.round("identity", 6).alias("identity"))


@query(
    f"""SELECT read_id, part, pos, cigar FROM (SELECT read_id, part, pos, cigar, sum(CASE WHEN op IN ('M', 'I') THEN n ELSE 0 END) / sum(CASE WHEN op IN ('M', 'I', 'S') THEN n ELSE 0 END) AS c FROM ({_OPS}) GROUP BY ALL) WHERE c >= 0.9"""
)
def pr05_by_coverage(t: Tables) -> DataFrame:
    return seqtools.by_coverage(t.x_cigar.distinct().withColumn("flag", F.lit(0)), 0.9).select("read_id", "part", "pos", "cigar")


_TX = "SELECT tid, chr, strand, string_agg(s || '-' || e, ',' ORDER BY s) AS exons FROM x_exon GROUP BY tid, chr, strand"


def _transcripts(t: Tables) -> DataFrame:
    return collapse.transcripts(t.x_exon, ["tid", "chr", "strand"]).withColumns({"pbid": F.concat(F.lit("PB."), F.col("tid") % 97, F.lit("."), "tid"), "gene": F.concat(F.lit("PB."), F.col("tid") % 97)})


@query(
    """SELECT id, CAST(line_no AS INT) AS line_no, value FROM (
  SELECT concat('PB.', tid % 97, '.', tid) AS id, row_number() OVER (PARTITION BY tid ORDER BY s) AS line_no,
    concat_ws(chr(9), chr, 'strandlake', 'exon', s + 1, e, '.', strand, '.', concat('gene_id "PB.', tid % 97, '"; transcript_id "PB.', tid % 97, '.', tid, '";')) AS value FROM x_exon
  UNION ALL SELECT concat('PB.', tid % 97, '.', tid), 0, concat_ws(chr(9), chr, 'strandlake', 'transcript', min(s) + 1, max(e), '.', strand, '.', concat('gene_id "PB.', tid % 97, '"; transcript_id "PB.', tid % 97, '.', tid, '";'))
  FROM x_exon GROUP BY tid, chr, strand)"""
)
def k01_gff_lines(t: Tables) -> DataFrame:
    return sinks.gff_lines(_transcripts(t))


@query("SELECT concat('PB.', tid % 97, '.', tid) AS id, concat('PB.', tid % 97) AS gene, chr, strand, exons FROM (" + _TX + ")")
def s07_gff_round_trip(t: Tables) -> DataFrame:
    """Transcripts written as lines and read again."""
    return annotations.transcripts(annotations.parse_gff(sinks.gff_lines(_transcripts(t)))).select("id", "gene", "chr", "strand", compare.exon_text("exons").alias("exons"))


@query("SELECT concat('PBfusion.', tid // 2) AS id, count(*) AS n_parts, string_agg(chr || strand, ',' ORDER BY tid % 2) AS places FROM (SELECT DISTINCT tid, chr, strand FROM x_exon) GROUP BY 1")
def s08_fusion_parts(t: Tables) -> DataFrame:
    rows = _transcripts(t).withColumn("id", F.concat(F.lit("PBfusion."), F.floor(F.col("tid") / 2), F.lit("."), F.col("tid") % 2 + 1))
    parts = annotations.fusion_parts(rows)
    return parts.select("id", F.size("parts").cast("bigint").alias("n_parts"), F.array_join(F.transform("parts", lambda x: F.concat(x["chr"], x["strand"])), ",").alias("places"))


@query("SELECT DISTINCT c.chr, c.s, c.e, tid AS transcript FROM (SELECT DISTINCT chr, s, s + 5 AS e FROM x_exon) c JOIN x_exon x ON c.chr = x.chr AND x.s < c.e AND c.s < x.e")
def s11_find_transcripts(t: Tables) -> DataFrame:
    regions = t.x_exon.select("chr", "s", (F.col("s") + 5).alias("e")).distinct()
    return annotations.find_transcripts(t.x_exon.withColumn("transcript", F.col("tid")), regions)


def _bed(t: Tables) -> DataFrame:
    return sinks.bed_lines(t.x_exon.withColumn("name", F.concat(F.lit("x"), "tid")))


@query("SELECT chr, s, e, 'x' || tid AS name FROM x_exon")
def s17_bed_round_trip(t: Tables) -> DataFrame:
    return annotations.parse_bed(_bed(t)).select("chr", "s", "e", "name")


@query(
    """WITH p AS (SELECT DISTINCT chr, s AS pos FROM x_exon UNION SELECT DISTINCT chr, s + 5 FROM x_exon)
  SELECT p.chr, p.pos, coalesce(min(name), 'NA') AS name FROM p LEFT JOIN (SELECT chr, s, 'x' || tid AS name FROM x_exon) b ON p.chr = b.chr AND p.pos = b.s GROUP BY 1, 2"""
)
def s18_point_lookup(t: Tables) -> DataFrame:
    """All starts against all lines; starts moved by five have no line of their own."""
    points = t.x_exon.select("chr", F.explode(F.array("s", F.col("s") + 5)).alias("pos")).distinct()
    return annotations.point_lookup(points, annotations.parse_bed(_bed(t)))


@query(
    """SELECT chr, s, e, CASE strand WHEN '+' THEN '+' ELSE '-' END AS strand, list_extract(['non-canonical', 'GT/AG', 'CT/AC', 'GC/AG', 'CT/GC', 'AT/AC', 'GT/AT'], CAST(1 + tid % 7 AS INT)) AS motif, tid % 2 = 1 AS annotated, exon_no AS n_unique FROM x_exon"""
)
def s19_star_junctions(t: Tables) -> DataFrame:
    fields = ["chr", F.col("s") + 1, "e", F.when(F.col("strand") == "+", 1).otherwise(2), F.col("tid") % 7, F.col("tid") % 2, "exon_no", F.lit(0), F.lit(9)]
    lines = t.x_exon.select(F.concat_ws("\t", *((F.col(f) if isinstance(f, str) else f).cast("string") for f in fields)).alias("value"))
    return annotations.parse_star_junctions(lines).select("chr", "s", "e", "strand", "motif", "annotated", "n_unique")


@query("SELECT concat('c', user_id) AS chr, event_id AS pos, 'A' AS ref, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5 END AS cov, CASE WHEN event_id % 3 > 0 THEN event_type END AS read_bases FROM events")
def s20_pileup(t: Tables) -> DataFrame:
    base = [F.concat(F.lit("c"), "user_id"), (F.col("event_id") + 1).cast("string"), F.lit("A")]
    short = F.concat_ws("\t", *base, F.lit("0"))
    full = F.concat_ws("\t", *base, (F.col("event_id") % 5).cast("string"), "event_type", F.lit("I"), F.lit("]"))
    return annotations.parse_pileup(t.events.select(F.when(F.col("event_id") % 3 == 0, short).otherwise(full).alias("value"))).select("chr", "pos", "ref", "cov", "read_bases")


#: Bases of the genome repeat this pattern.
_PATTERN = "ACGGTCA"

# Runs of one to three rows: insertions stand still on the reference, deletions on the query.
_SNPS = """SELECT p, k, CASE WHEN p % 5 = 0 THEN 'ins' WHEN p % 7 = 0 THEN 'del' ELSE 'snp' END AS kind,
    p * 30 + CASE WHEN p % 5 > 0 AND p % 7 = 0 THEN k ELSE 0 END AS ref0, p * 20 + CASE WHEN p % 5 = 0 THEN k ELSE 0 END AS query0,
    CASE WHEN p % 5 = 0 THEN '.' ELSE substr('ACGGTCA', CAST((p * 30 + CASE WHEN p % 7 = 0 THEN k ELSE 0 END) % 7 + 1 AS INT), 1) END AS r,
    CASE WHEN p % 5 > 0 AND p % 7 = 0 THEN '.' ELSE substr('TGCA', CAST((p + k) % 4 + 1 AS INT), 1) END AS q
  FROM (SELECT p_partkey AS p, k FROM {part} CROSS JOIN (VALUES (0), (1), (2)) AS x(k) WHERE k = 0 OR (p_partkey % 5 = 0 OR p_partkey % 7 = 0) AND k <= p_partkey % 3)"""


def _snp_lines(t: Tables) -> DataFrame:
    rows = t.spark.sql(_SNPS, part=t.part)
    fields = [F.col("ref0") + 1, "r", "q", F.col("query0") + 1, F.lit(0), F.lit(0), F.lit(10), F.lit(20), F.when(F.col("p") % 2 == 0, 1).otherwise(-1), F.lit(1), F.lit("ref"), F.lit("q")]
    return rows.select(F.concat_ws("\t", *((F.col(f) if isinstance(f, str) else f).cast("string") for f in fields)).alias("value"))


@query(f"SELECT ref0 AS ref_pos, r AS ref_base, query0 AS query_pos, CASE WHEN p % 2 = 0 THEN '+' ELSE '-' END AS ref_strand FROM ({_SNPS.format(part='part')})")
def s21_snps(t: Tables) -> DataFrame:
    return annotations.parse_snps(_snp_lines(t)).select("ref_pos", "ref_base", "query_pos", "ref_strand")


@query(
    f"""WITH x AS ({_SNPS.format(part='part')}), g AS (SELECT p, kind, min(ref0) AS spot, string_agg(r, '' ORDER BY k) AS r, string_agg(q, '' ORDER BY k) AS q FROM x GROUP BY p, kind),
  b AS (SELECT *, substr('{_PATTERN}', CAST(CASE kind WHEN 'del' THEN spot - 1 ELSE spot END % 7 + 1 AS INT), 1) AS b FROM g)
  SELECT 'ref' AS chr, CASE kind WHEN 'del' THEN spot ELSE spot + 1 END AS pos1, CASE kind WHEN 'snp' THEN r WHEN 'ins' THEN b ELSE b || r END AS ref, CASE kind WHEN 'snp' THEN q WHEN 'ins' THEN b || q ELSE b END AS alt FROM b"""
)
def k08_snp_vcf(t: Tables) -> DataFrame:
    """Substitutions, and runs of insertions and deletions with the base before them."""
    last = F.expr("max(p_partkey) * 30 + 40")
    genome = t.part.agg(F.repeat(F.lit(_PATTERN), F.ceil(last / 7).cast("int")).alias("sequence")).select(F.lit("ref").alias("chr"), "sequence")
    return sinks.snp_vcf(annotations.parse_snps(_snp_lines(t)), genome)


@query("SELECT pbid, member FROM x_group")
def s23_groups(t: Tables) -> DataFrame:
    packed = t.x_group.groupBy("pbid").agg(F.concat_ws(",", F.collect_list(F.concat(F.lit("s|"), "member"))).alias("members"))
    return tables.explode_groups(packed).select("pbid", "member")


_TAG = "CASE WHEN upper(trim({0})) NOT IN ('', 'NA') THEN upper(trim({0})) END"


@query(f"SELECT DISTINCT id, {_TAG.format('umi')} AS umi, CASE WHEN length > 2000 THEN {_TAG.format('bc')} END AS bc, length, 3 AS n FROM umi_bc_error_correct WHERE id IS NOT NULL")
def s27_dedup_headers(t: Tables) -> DataFrame:
    rows = t.umi_bc_error_correct.filter("id is not null").select("id", tag_value("umi").alias("umi"), tag_value("bc").alias("bc"), "length").distinct()
    fields = F.concat_ws(";", F.lit("full_length_coverage=3"), F.concat(F.lit("length="), "length"), F.concat(F.lit("XM="), "umi"), F.when(F.col("length") > 2000, F.concat(F.lit("XC="), "bc")))
    return singlecell.parse_dedup_header(rows.select(F.concat_ws(" ", "id", fields).alias("header"))).select("id", "umi", "bc", "length", "n").distinct()


@query("SELECT chr, name, block, count(*) AS n, string_agg(s || '-' || e, ',' ORDER BY s, e) AS exons FROM (SELECT chr, 't' || tid AS name, 1 AS block, s, e FROM x_exon) GROUP BY 1, 2, 3")
def s14_btab_blocks(t: Tables) -> DataFrame:
    e = [F.col("s") + 1, F.col("e")]
    lo, hi = (F.when(F.col("strand") == "-", a).otherwise(b) for a, b in ((e[1], e[0]), (e[0], e[1])))
    fields = [F.col("chr"), *[F.lit("-")] * 4, F.concat(F.lit("t"), "tid"), lo, hi, F.lit(1), F.lit(9), F.lit(99.0), F.lit("-"), F.lit("-"), F.lit(1), F.lit("-")]
    rows = annotations.parse_btab(t.x_exon.select(F.concat_ws("\t", *(f.cast("string") for f in fields)).alias("value")))
    return annotations.btab_blocks(rows).select("chr", "name", "block", F.size("exons").cast("bigint").alias("n"), compare.exon_text("exons").alias("exons"))


@query("SELECT '@' || doc_id || chr(10) || raw || chr(10) || '+' || chr(10) || repeat(']', length(raw)) AS value FROM (SELECT doc_id, regexp_replace(raw, '[^ACGT]', '', 'g') AS raw FROM x_seq)")
def k03_fastq_lines(t: Tables) -> DataFrame:
    rows = t.x_seq.select(F.col("doc_id").cast("string").alias("id"), F.regexp_replace("raw", "[^ACGT]", "").alias("seq"))
    return sinks.fastq_lines(rows)


@query("SELECT tid, concat('r', tid % 1000, CASE WHEN n > 1 THEN concat('.dup', n) ELSE '' END) AS name FROM (SELECT tid, row_number() OVER (PARTITION BY tid % 1000 ORDER BY tid) AS n FROM (SELECT DISTINCT tid FROM x_exon))")
def k04_numbered_duplicates(t: Tables) -> DataFrame:
    rows = _transcripts(t).withColumns({"read_id": F.concat(F.lit("r"), F.col("tid") % 1000), "flag": F.lit(0)})
    return seqtools.number_duplicates(rows, ["tid"]).select("tid", "name")


@query(
    """SELECT id, CAST(line_no AS INT) AS line_no, value FROM (SELECT 'r' || tid AS id, 0 AS line_no, concat_ws(chr(9), chr, 'strandlake', 'gene', min(s) + 1, max(e), '.', strand, '.', 'ID=r' || tid || ';Name=r' || tid) AS value FROM x_exon GROUP BY tid, chr, strand
  UNION ALL SELECT 'r' || tid, n, concat_ws(chr(9), chr, 'strandlake', 'exon', s + 1, e, '.', strand, '.', 'ID=r' || tid || '.exon' || n || ';Parent=r' || tid) FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY s) AS n FROM x_exon))"""
)
def k05_gff3_lines(t: Tables) -> DataFrame:
    return sinks.gff3_lines(_transcripts(t).withColumn("name", F.concat(F.lit("r"), "tid")))


@query("SELECT 'x' || tid AS id, CAST(n - 1 AS INT) AS line_no, concat_ws(' ', 'x' || tid, 'exon', s + 1, e + 1) AS value FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY s) AS n FROM x_exon)")
def k02_exon_pictures(t: Tables) -> DataFrame:
    return sinks.exon_picture_lines(_transcripts(t).withColumn("pbid", F.concat(F.lit("x"), "tid")))


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY CASE strand WHEN '-' THEN -s ELSE s END) AS n FROM x_exon)
  SELECT 'x' || tid AS id, CAST(n - 1 AS INT) AS line_no, concat_ws(chr(9), chr, 'NA', 'exon', s + 1, e, '.', strand, '.', 'x' || tid) AS value FROM n
  UNION ALL SELECT 'x' || tid, CAST(count(*) AS INT), '###' FROM n GROUP BY tid"""
)
def k02_browser_lines(t: Tables) -> DataFrame:
    return sinks.ucsc_lines(_transcripts(t).withColumn("pbid", F.concat(F.lit("x"), "tid")))


@query(
    """WITH f AS (SELECT pbid, gene, fl_count * 1e6 / sum(fl_count) OVER () AS cpm FROM x_fl), s AS (SELECT *, max(cpm) OVER (PARTITION BY gene) AS top FROM f),
  i AS (SELECT pbid, gene, cpm, CAST(CASE WHEN cpm <= 0 THEN 19 ELSE least(19, ceil(3 * log2(top / cpm))) END AS INT) AS shade FROM s)
  SELECT pbid AS id, concat_ws(chr(9), 'chr1', 0, 100, concat(gene, '|', pbid, '|', CAST(floor(cpm) AS BIGINT)), '0', '+', 0, 100,
    CASE WHEN shade <= 10 THEN list_extract([0,26,51,77,102,128,153,179,204,230,255], shade + 1) || ',0,0' ELSE '255,' || list_extract([26,51,77,102,128,153,179,204,230], shade - 10) || ',' || list_extract([26,51,77,102,128,153,179,204,230], shade - 10) END, 2, '40,30', '0,70') AS value FROM i"""
)
def k11_bed12(t: Tables) -> DataFrame:
    exons = F.expr("array(named_struct('start', 0L, 'end', 40L), named_struct('start', 70L, 'end', 100L))")
    return sinks.bed12_lines(counts.cpm(t.x_fl).withColumns({"chr": F.lit("chr1"), "strand": F.lit("+"), "exons": exons}))


@query("SELECT id AS read_id, umi, coalesce(rg, 'NA') AS rg FROM (SELECT id, umi FROM clip_out_umi_cellbc) LEFT JOIN (SELECT id, CAST(min(length) AS STRING) AS rg FROM umi_bc_error_correct WHERE length % 3 = 0 GROUP BY 1) USING (id)")
def k13_tagged_reads(t: Tables) -> DataFrame:
    tags = t.umi_bc_error_correct.filter("length % 3 = 0").groupBy(F.col("id").alias("read_id")).agg(F.min("length").alias("hap_idx"))
    return phasing.tag_reads(t.clip_out_umi_cellbc.select(F.col("id").alias("read_id"), "umi"), tags)


# --- structures ------------------------------------------------------------------------------------


@query()
def e08_collapse(t: Tables) -> DataFrame:
    """Isoforms of all transcripts, by greedy merging within each locus."""
    rows = _transcripts(t).select(F.col("tid").alias("read_id"), "chr", "strand", "exons")
    found = collapse.isoforms_of(collapse.collapse(rows))
    return found.select("pbid", "chr", "strand", compare.exon_text("exons").alias("exons"), "n_reads")


@query(
    """WITH d AS (SELECT chr, strand, gene, exons, min(pbid) AS pbid FROM (SELECT tid, chr, strand, concat('PB.', tid % 97) AS gene, concat('PB.', tid % 97, '.', tid) AS pbid, list([s, e] ORDER BY s) AS exons FROM x_exon GROUP BY tid, chr, strand) GROUP BY ALL),
  t AS (SELECT *, len(exons) AS n, array_to_string(list_transform(range(1, len(exons)), lambda k: exons[k][2] || '-' || exons[k + 1][1]), ',') AS chain FROM d),
  gone AS (SELECT DISTINCT j.pbid FROM t i JOIN t j ON i.gene = j.gene AND i.strand = j.strand AND i.n > j.n WHERE CASE
    WHEN j.n > 1 AND i.strand = '+' THEN (',' || i.chain) LIKE '%,' || j.chain AND j.exons[1][1] >= i.exons[i.n - j.n + 1][1] AND j.exons[1][1] < i.exons[i.n - j.n + 1][2]
    WHEN j.n > 1 THEN (i.chain || ',') LIKE j.chain || ',%' AND j.exons[j.n][2] >= i.exons[j.n][1] AND j.exons[j.n][2] < i.exons[j.n][2]
    WHEN i.strand = '+' THEN j.exons[1][1] >= i.exons[i.n][1] - 5 AND j.exons[1][1] < i.exons[i.n][2] AND i.exons[i.n - 1][2] < j.exons[1][1]
    ELSE j.exons[1][2] <= i.exons[1][2] + 5 AND j.exons[1][2] > i.exons[1][1] AND j.exons[1][2] < i.exons[2][1] END)
  SELECT pbid, array_to_string(list_transform(exons, lambda x: x[1] || '-' || x[2]), ',') AS exons FROM t WHERE pbid NOT IN (SELECT pbid FROM gone)"""
)
def e09_without_subsets(t: Tables) -> DataFrame:
    """The junctions of all structures lie ten bases apart at least, so that a tolerance of five is equality."""
    return collapse.without_subsets(_distinct(t)).select("pbid", compare.exon_text("exons").alias("exons"))


def _distinct(t: Tables) -> DataFrame:
    """Transcripts with different exons, each once."""
    rows = _transcripts(t).groupBy("chr", "strand", "gene", "exons").agg(F.min("pbid").alias("pbid"))
    return rows.withColumns({"start": F.col("exons")[0]["start"], "end": F.element_at("exons", -1)["end"]})


@query(
    f"""WITH a AS (SELECT DISTINCT chr, strand, exons, n FROM (SELECT tid, chr, strand, string_agg(s || '-' || e, ',' ORDER BY s) AS exons, count(*) AS n FROM x_exon GROUP BY tid, chr, strand))
  SELECT chr, strand, exons, kind, CASE kind WHEN 'same' THEN 'exact' WHEN 'longer ends' THEN 'exact' WHEN 'far' THEN 'nomatch' WHEN 'without first' THEN 'super' WHEN 'of without first' THEN 'subset' WHEN 'moved' THEN 'partial' WHEN 'both' THEN 'concordant' END AS how
  FROM a CROSS JOIN (VALUES ('same', 1), ('longer ends', 1), ('far', 1), ('without first', 2), ('of without first', 2), ('moved', 2), ('both', 4)) AS v(kind, least) WHERE n >= least"""
)
def u01_relations(t: Tables) -> DataFrame:
    """Each structure against altered ones: how they relate is known from the change."""
    x, n = F.col("exons"), F.size("exons")
    moved = lambda d, keep=None: F.transform(x, lambda e, i: F.struct((e["start"] + (d if keep is None else F.when(i == keep, d).otherwise(0))).alias("start"), (e["end"] + (d if keep is None else 0)).alias("end")))
    longer = F.transform(x, lambda e, i: F.struct((e["start"] - F.when(i == 0, 5).otherwise(0)).alias("start"), (e["end"] + F.when(i == n - 1, 5).otherwise(0)).alias("end")))
    rest, head = F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0)))
    cases = [("same", 1, x, x), ("longer ends", 1, x, longer), ("far", 1, x, moved(100_000_000)), ("without first", 2, x, rest), ("of without first", 2, rest, x), ("moved", 2, x, moved(3, 1)), ("both", 4, head, rest)]
    options = F.array(*(F.when(n >= least, F.struct(F.lit(k).alias("kind"), p.cast(collapse.EXONS).alias("p"), q.cast(collapse.EXONS).alias("q"))) for k, least, p, q in cases))
    rows = _distinct(t).select("chr", "strand", "exons", F.explode(F.array_compact(options)).alias("_o")).select("chr", "strand", compare.exon_text("exons").alias("exons"), "_o.*")
    return rows.select("chr", "strand", "exons", "kind", compare.relation_of("p", "q", "strand").alias("how"))


def _samples(t: Tables) -> dict[str, DataFrame]:
    rows = stage(_distinct(t), "structures").withColumn("k", F.regexp_extract("pbid", r"([0-9]+)$", 1).cast("bigint"))
    return {f"S{i}": rows.filter((F.col("k") + i) % 3 > 0).select(F.col("pbid").alias("id"), "chr", "strand", "exons", "start", "end") for i in range(3)}


@query()
def e18_chain(t: Tables) -> DataFrame:
    """Three samples that overlap, each structure in two of them."""
    return chain.chain(_samples(t)).select("superpbid", "chr", "strand", compare.exon_text("exons").alias("exons"), "S0", "S1", "S2")


@query(
    """SELECT superpbid, sample, sum(c) AS count_fl FROM (SELECT DISTINCT superpbid, sample, pbid FROM chain_samples WHERE superpbid IS NOT NULL) JOIN
  (SELECT sample, pbid, max(count_fl) AS c FROM sample_abundance GROUP BY 1, 2) USING (sample, pbid) GROUP BY 1, 2"""
)
def j07_chained_counts(t: Tables) -> DataFrame:
    names = [f"S00{c}" for c in "ABCDEFGHIJKL"]
    rows = t.chain_samples.filter("superpbid is not null").select("superpbid", "sample", "pbid").distinct()
    chained = rows.select("superpbid", *(F.when(F.col("sample") == n, F.col("pbid")).alias(n) for n in names))
    best = t.sample_abundance.groupBy("sample", "pbid").agg(F.max("count_fl").alias("count_fl"))
    # A super isoform may have several isoforms of a sample here, so each row is looked up by itself.
    keyed = chained.withColumn("superpbid", F.concat_ws("#", "superpbid", F.to_json(F.struct(*names))))
    wide = chain.chained_counts(keyed, best, names)
    long = wide.select(F.substring_index("superpbid", "#", 1).alias("superpbid"), F.explode(F.array(*(F.struct(F.lit(n).alias("sample"), F.col(n).alias("c")) for n in names))).alias("x"))
    return long.filter("x.c is not null").groupBy("superpbid", "x.sample").agg(F.sum("x.c").alias("count_fl"))


@query()
def e15_labelled_junctions(t: Tables) -> DataFrame:
    rows = t.scrub_sample_gff_junctions.select("chr", "strand", "left", "right").dropna().distinct()
    return junctions.labelled(rows)


@query(
    """WITH r AS (SELECT label, chr, strand, "left", "right", sum(num_transcript) AS num_transcript, max(num_sample) AS num_sample, max(genome) AS genome FROM scrub_sample_gff_junctions
    WHERE label IS NOT NULL AND chr IS NOT NULL AND strand IS NOT NULL AND "left" IS NOT NULL AND "right" IS NOT NULL GROUP BY ALL),
  p AS (SELECT *, (num_sample >= 2 AND num_transcript >= 5) OR coalesce(genome = 'GT-AG', false) AS ok FROM r),
  q AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, bool_or(coalesce(ok, false)) OVER (PARTITION BY label) AS anyok, row_number() OVER (PARTITION BY label ORDER BY num_transcript DESC NULLS LAST, "left", "right") AS rk FROM p)
  SELECT label, chr, strand, "left", "right" FROM q WHERE n = 1 OR ok OR (NOT anyok AND rk = 1)"""
)
def e16_scrubbed_junctions(t: Tables) -> DataFrame:
    key = ["label", "chr", "strand", "left", "right"]
    rows = t.scrub_sample_gff_junctions.dropna(subset=key).groupBy(*key).agg(F.sum("num_transcript").alias("num_transcript"), F.max("num_sample").alias("num_sample"), F.max("genome").alias("genome"))
    return junctions.scrub_by_label(rows, 2, 5).select(*key)


@query(
    """WITH j AS (SELECT tid, chr, strand, row_number() OVER w AS k, e - 1 AS l, lead(s) OVER w AS r FROM x_exon WINDOW w AS (PARTITION BY tid ORDER BY s)),
  i AS (SELECT * FROM j WHERE r IS NOT NULL), kept AS (SELECT DISTINCT chr, strand, l + 3 AS kl, r - 2 AS kr FROM i WHERE (l + r) % 3 = 0),
  d AS (SELECT DISTINCT chr, strand, l, r FROM i),
  m AS (SELECT chr, strand, l, r, kl, kr FROM d JOIN kept USING (chr, strand) WHERE abs(l - kl) <= 20 AND abs(r - kr) <= 20 QUALIFY row_number() OVER (PARTITION BY chr, strand, l, r ORDER BY abs(l - kl) + abs(r - kr), kl, kr) = 1),
  c AS (SELECT tid, count(*) AS n, count(kl) AS found FROM i LEFT JOIN m USING (chr, strand, l, r) GROUP BY tid),
  t AS (SELECT x.tid, coalesce(c.n > 0 AND c.n = c.found, false) AS ok, list([s, e] ORDER BY s) AS exons FROM x_exon x LEFT JOIN c USING (tid) GROUP BY x.tid, c.n, c.found),
  z AS (SELECT tid, list(kl ORDER BY k) AS kl, list(kr ORDER BY k) AS kr FROM i LEFT JOIN m USING (chr, strand, l, r) GROUP BY tid)
  SELECT tid, array_to_string(list_transform(range(1, len(exons) + 1), lambda k: CASE WHEN ok AND k > 1 THEN kr[k - 1] ELSE exons[k][1] END || '-' || CASE WHEN ok AND k < len(exons) THEN kl[k] + 1 ELSE exons[k][2] END), ',') AS exons, ok AS scrubbed
  FROM t LEFT JOIN z USING (tid)"""
)
def e17_scrub_transcripts(t: Tables) -> DataFrame:
    """A third of the junctions, moved a little, are kept: transcripts whose junctions all have one nearby are rebuilt."""
    rows = _transcripts(t).select("tid", "chr", "strand", "exons")
    report = junctions.junction_report(rows.withColumn("sample", F.lit(1))).filter((F.col("left") + F.col("right")) % 3 == 0)
    kept = report.withColumns({"left": F.col("left") + 3, "right": F.col("right") - 2})
    return junctions.scrub_transcripts(rows, kept, key="tid").select("tid", compare.exon_text("exons").alias("exons"), "scrubbed")


def _parts(t: Tables) -> DataFrame:
    return t.x_aln.withColumns({"q_start": F.col("part") * 100, "q_end": F.col("part") * 100 + 100, "q_len": F.lit(700)})


@query(
    """WITH r AS (SELECT read_id, chr, s, e, part * 100 AS qs, part * 100 + 100 AS qe FROM x_aln WHERE flag <> 4),
  k AS (SELECT read_id, count(*) AS n_loci, min(CASE WHEN identity >= 0.90 AND q_coverage >= 0.05 THEN 1 ELSE 0 END) AS ok FROM x_aln WHERE flag <> 4 GROUP BY 1),
  g AS (SELECT *, s - max(e) OVER (PARTITION BY read_id, chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM r),
  c AS (SELECT read_id, 100 * count(DISTINCT qs) AS cov FROM r GROUP BY 1)
  SELECT read_id, n_loci FROM k JOIN c USING (read_id) WHERE n_loci >= 2 AND ok = 1 AND cov >= 0.5 * 700 AND read_id NOT IN (SELECT read_id FROM g WHERE gap < 10000)"""
)
def e10_fusion_candidates(t: Tables) -> DataFrame:
    return fusion.candidates(_parts(t), min_identity=0.90, min_total=0.5)


@query()
def e12_fusions(t: Tables) -> DataFrame:
    exons = F.array(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))
    parts = _parts(t).join(fusion.candidates(_parts(t), min_identity=0.90, min_total=0.3).select("read_id"), "read_id", "left_semi").filter("flag <> 4")
    parts = parts.select("read_id", "chr", "strand", "s", "e", "q_start", "q_len", exons.alias("exons"))
    return fusion.assemble(fusion.merge_parts(parts)).select("fusion_id", "n_parts", "n_reads", "read_id")


@query("SELECT fusion_id, member FROM (SELECT o_custkey % 50 AS fusion_id, o_orderkey // 2 % 300 AS member, count(DISTINCT o_orderkey % 2) AS k FROM orders GROUP BY 1, 2) JOIN (SELECT o_custkey % 50 AS fusion_id, count(DISTINCT o_orderkey % 2) AS n FROM orders GROUP BY 1) USING (fusion_id) WHERE k = n")
def o01_shared_members(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_custkey") % 50).alias("fusion_id"), (F.col("o_orderkey") % 2).alias("part"), (F.floor(F.col("o_orderkey") / 2) % 300).alias("member"))
    return fusion.shared_members(rows)


@query(
    """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN lg IS NULL THEN 'FAIL:NovelGene' WHEN lg = rg THEN 'FAIL:SameGene' WHEN c < 2 THEN 'FAIL:TooFewFLReads' WHEN lg LIKE 'MT-%' OR rg LIKE 'MT-%' THEN 'FAIL:MtGenes'
    WHEN lc = rc AND abs(lb - rb) <= 10000 THEN 'FAIL:BreakpointTooClose' ELSE 'PASS' END AS verdict
  FROM (SELECT CASE WHEN p_partkey % 13 = 0 THEN 'MT-' || p_partkey % 5 WHEN p_partkey % 11 > 0 THEN 'g' || p_partkey % 5 END AS lg, 'g' || p_size % 5 AS rg, p_partkey % 9 AS c, 'chr' || p_partkey % 3 AS lc, 'chr' || p_size % 3 AS rc, p_partkey * 10 AS lb, p_size * 100 AS rb FROM part)) GROUP BY 1"""
)
def pr14_fusion_verdicts(t: Tables) -> DataFrame:
    p, z = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select(
        F.when(p % 13 == 0, F.concat(F.lit("MT-"), p % 5)).when(p % 11 > 0, F.concat(F.lit("g"), p % 5)).alias("left_gene"), F.concat(F.lit("g"), z % 5).alias("right_gene"), (p % 9).alias("count_fl"),
        F.concat(F.lit("chr"), p % 3).alias("left_chr"), F.concat(F.lit("chr"), z % 3).alias("right_chr"), (p * 10).alias("left_break"), (z * 100).alias("right_break"),
    )
    return fusion.with_verdict(rows).groupBy("verdict").agg(F.count("*").alias("n"))


def _annotation(t: Tables) -> DataFrame:
    """One known transcript for each gene, strand and number of exons: the structure with the least id."""
    rows = _distinct(t).groupBy("gene", "chr", "strand", F.size("exons").alias("n")).agg(F.min_by("exons", "pbid").alias("exons"), F.min("pbid").alias("transcript"))
    return rows.select("transcript", "chr", "strand", "exons")


@query()
def j14_best_annotation(t: Tables) -> DataFrame:
    """All structures against the annotation, by the score of their exon paths."""
    found = seqtools.exon_path_score(_distinct(t).select(F.col("pbid").alias("id"), "chr", "strand", "exons"), _annotation(t), ["chr", "strand"])
    return found.select("id", "transcript", F.round("score", 9).alias("score"), "n_known", F.size("matched").alias("n_matched"))


@query(
    """WITH d AS (SELECT chr, strand, gene, exons, min(pbid) AS pbid, len(exons) AS n FROM (SELECT tid, chr, strand, concat('PB.', tid % 97) AS gene, concat('PB.', tid % 97, '.', tid) AS pbid, list([s, e] ORDER BY s) AS exons FROM x_exon GROUP BY tid, chr, strand) GROUP BY ALL)
  SELECT pbid AS id, CASE WHEN n = 1 THEN 'full' WHEN strand = '+' THEN '5miss1' ELSE '3miss1' END AS category, 0 AS off FROM d"""
)
def a28_mapping_evaluation(t: Tables) -> DataFrame:
    """Each structure without its first exon against itself alone: what is missing is known."""
    rows = _distinct(t)
    n = F.size("exons")
    kept = F.when(n > 1, F.slice("exons", F.lit(2), F.greatest(n - 1, F.lit(1)))).otherwise(F.col("exons"))
    own = rows.select(F.col("pbid").alias("id"), "strand", F.col("pbid").alias("own"), kept.alias("exons"))
    found = seqtools.evaluate_mapping(own, rows.select(F.col("pbid").alias("transcript"), F.col("pbid").alias("own"), "exons"), ["own"])
    off = F.aggregate("boundary", F.lit(0).cast("bigint"), lambda acc, x: acc + F.abs(x["head"]) + F.abs(x["tail"]))
    return found.select("id", "category", off.alias("off"))


# --- phasing ---------------------------------------------------------------------------------------

_COUNTS = "SELECT chr_no AS chr, pos, ref, upper(base) AS base, count(*) AS n FROM x_pile GROUP BY ALL"


def _clean(t: Tables) -> DataFrame:
    return phasing.clean_counts(phasing.base_counts(t.x_pile.withColumnRenamed("chr_no", "chr")))


@query(_COUNTS)
def pr10_clean_counts(t: Tables) -> DataFrame:
    return _clean(t)


@query(
    """WITH d AS (SELECT DISTINCT l_suppkey % 7 AS chr, l_partkey % 3000 AS pos FROM lineitem), r AS (SELECT *, substr('AAACCGTTTT', CAST(1 + (pos // 3) % 10 AS INT), 1) AS ref FROM d),
  n AS (SELECT *, CASE WHEN lag(ref) OVER w = ref AND lag(pos) OVER w = pos - 1 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY chr ORDER BY pos)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM n), h AS (SELECT *, count(*) OVER (PARTITION BY chr, run) >= 4 AS hp FROM g)
  SELECT chr, pos, hp OR coalesce(lag(pos) OVER w = pos - 1 AND lag(hp) OVER w, false) OR coalesce(lead(pos) OVER w = pos + 1 AND lead(hp) OVER w, false) AS near_hp FROM h WINDOW w AS (PARTITION BY chr ORDER BY pos)"""
)
def pr11_near_homopolymers(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_suppkey") % 7).alias("chr"), (F.col("l_partkey") % 3000).alias("pos")).distinct()
    ref = F.substring(F.lit("AAACCGTTTT"), (F.floor(F.col("pos") / 3) % 10 + 1).cast("int"), F.lit(1))
    return phasing.near_homopolymer(rows.withColumn("ref", ref)).select("chr", "pos", "near_hp")


@query(f"SELECT chr, pos, ref, CAST(sum(n) AS BIGINT) AS cov, count(*) AS n_types FROM ({_COUNTS}) GROUP BY ALL HAVING count(*) >= 2 AND sum(n) >= 2")
def pr12_callable_positions(t: Tables) -> DataFrame:
    return phasing.callable_positions(_clean(t), t.x_pile.select(F.col("chr_no").alias("chr"), "pos", "ref"), min_cov=2)


@query(f"SELECT chr, pos, ref, base, n, row_number() OVER (PARTITION BY chr, pos ORDER BY n DESC, base) AS rank FROM ({_COUNTS})")
def t08_ranked_bases(t: Tables) -> DataFrame:
    return phasing.ranked_bases(_clean(t))


def _sites(t: Tables) -> DataFrame:
    return phasing.callable_positions(_clean(t), t.x_pile.select(F.col("chr_no").alias("chr"), "pos", "ref"))


# Bases over 20 positions; at some of them up to a quarter of the reads have another base.
_STACKED = """SELECT chr, pos, substr('ACGT', CAST(pos % 4 + 1 AS INT), 1) AS ref, substr('ACGT', CAST((pos + CASE WHEN e < pos % 10 * 3 THEN 1 + e % 3 ELSE 0 END) % 4 + 1 AS INT), 1) AS base, count(*) AS n
  FROM (SELECT user_id % 2 AS chr, event_id * 7919 % 10 AS pos, (event_id * 31 + user_id * 17) % 100 AS e FROM {events}) GROUP BY ALL"""

_TESTED = f"""c AS ({_STACKED.format(events="events")}), s AS (SELECT chr, pos, ref, sum(n) AS cov, count(*) AS n_types FROM c GROUP BY ALL HAVING count(*) >= 2 AND sum(n) >= 10),
  r AS (SELECT c.*, row_number() OVER (PARTITION BY c.chr, c.pos ORDER BY n DESC, base) AS rank, CAST(cov AS BIGINT) AS cov, CAST(floor(cov * 0.005) AS BIGINT) AS x, CAST(floor(cov * 0.995) AS BIGINT) AS y FROM c JOIN s USING (chr, pos)),
  d AS (SELECT DISTINCT n, cov, x, y FROM r WHERE rank > 1), t AS (SELECT *, unnest(range(greatest(n, n + x - (x + y)), least(cov, n + x) + 1)) AS k FROM d),
  p AS (SELECT n, cov, least(1, sum(exp(lgamma(cov + 1) - lgamma(k + 1) - lgamma(cov - k + 1) + lgamma(x + y + 1) - lgamma(n + x - k + 1) - lgamma(y - n + k + 1) - lgamma(cov + x + y + 1) + lgamma(n + x + 1) + lgamma(cov + y - n + 1)))) AS p
    FROM t WHERE n + x - k <= x + y GROUP BY n, cov),
  q AS (SELECT r.chr, r.pos, r.ref, r.base, r.n, r.rank, p.p FROM r LEFT JOIN p ON r.rank > 1 AND r.n = p.n AND r.cov = p.cov)"""


def _stacked(t: Tables) -> tuple[DataFrame, DataFrame]:
    clean = t.spark.sql(_STACKED, events=t.events)
    return clean, phasing.callable_positions(clean, clean)


@query(
    f"""WITH {_TESTED}, o AS (SELECT *, coalesce(p * (SELECT sum(n_types) FROM s) < 0.01, false) AS ok FROM q)
  SELECT chr, pos, ref, base, n, rank, round(p, 9) AS pvalue FROM (SELECT *, bool_or(ok) OVER (PARTITION BY chr, pos) AS called FROM o) WHERE called AND (ok OR rank = 1)"""
)
def e19_called_variants(t: Tables) -> DataFrame:
    return phasing.call_variants(*_stacked(t)).withColumn("pvalue", F.round("pvalue", 9))


@query(
    f"""WITH {_TESTED}, g AS (SELECT round(p, 13) AS pr, max(p) AS p, count(*) AS k FROM q WHERE p <= 0.2 GROUP BY 1),
  l AS (SELECT max(p) AS last FROM (SELECT p, sum(k) OVER (ORDER BY p) AS place, sum(k) OVER () AS m FROM g) WHERE p < place / m * 0.05),
  o AS (SELECT q.*, coalesce(p <= last * (1 + 1e-9), false) AS ok FROM q CROSS JOIN l)
  SELECT chr, pos, ref, base, n, rank, round(p, 9) AS pvalue FROM (SELECT *, bool_or(ok) OVER (PARTITION BY chr, pos) AS called FROM o) WHERE called AND (ok OR rank = 1)"""
)
def e19_called_by_rank(t: Tables) -> DataFrame:
    """By the rank of the p value among those of at most 0.2, at a false discovery rate of 5 %."""
    return phasing.call_variants(*_stacked(t), p_cut=0.2, fdr=0.05).withColumn("pvalue", F.round("pvalue", 9))


@query(f"SELECT chr, pos + 1 AS pos1, string_agg(base, '/' ORDER BY n DESC, base) AS bases, string_agg(CAST(n AS STRING), '/' ORDER BY n DESC, base) AS counts FROM ({_COUNTS}) GROUP BY chr, pos")
def k15_snp_table(t: Tables) -> DataFrame:
    return phasing.snp_table(phasing.ranked_bases(_clean(t)))


def _haps(t: Tables) -> DataFrame:
    seq = F.translate(F.conv(F.col("o_orderkey").cast("string"), 10, 4), "0123", "ACGT")
    return t.orders.select(F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 40).alias("chr"), F.substring(seq, -3, 3).alias("hap")).filter("length(hap) = 3").distinct()


_HAP = """SELECT DISTINCT o_orderkey AS read_id, o_custkey % 40 AS chr, concat(substr('ACGT', CAST(o_orderkey // 16 % 4 + 1 AS INT), 1), substr('ACGT', CAST(o_orderkey // 4 % 4 + 1 AS INT), 1), substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1)) AS hap
  FROM orders WHERE o_orderkey >= 16"""


@query(
    f"""WITH h AS ({_HAP}), s AS (SELECT chr, hap, row_number() OVER (PARTITION BY chr ORDER BY min(read_id)) - 1 AS hap_idx FROM h GROUP BY chr, hap) SELECT read_id, h.chr, h.hap, hap_idx FROM h JOIN s ON h.chr = s.chr AND h.hap = s.hap"""
)
def e20_phased_reads(t: Tables) -> DataFrame:
    haps = _haps(t)
    called = t.spark.createDataFrame([(p, b) for p in range(3) for b in "ACGT"], "pos bigint, base string")
    return phasing.phase(haps, haps.select("chr").distinct().crossJoin(F.broadcast(called)))


@query(f"""WITH h AS (SELECT DISTINCT chr, hap FROM ({_HAP})), c(rank, corrected) AS (VALUES (0, 'AAA'), (1, 'CGT'), (2, 'TTT')),
  p AS (SELECT chr, hap, corrected, hamming(hap, corrected) AS distance, row_number() OVER (PARTITION BY chr, hap ORDER BY hamming(hap, corrected), rank) AS n FROM h CROSS JOIN c)
  SELECT chr, hap, corrected, distance FROM p WHERE n = 1""")
def e26_corrected_haplotypes(t: Tables) -> DataFrame:
    haps = _haps(t).select("chr", "hap")
    chosen = haps.select("chr").distinct().crossJoin(F.broadcast(t.spark.createDataFrame([(0, "AAA"), (1, "CGT"), (2, "TTT")], "rank bigint, hap string")))
    return phasing.correct_haplotypes(haps, chosen)


@query(f"SELECT chr, place, base, next_base, count(*) AS n FROM (SELECT chr, unnest([0, 1]) AS place, hap FROM ({_HAP})), LATERAL (SELECT substr(hap, CAST(place + 1 AS INT), 1) AS base, substr(hap, CAST(place + 2 AS INT), 1) AS next_base) GROUP BY 1, 2, 3, 4")
def f12_adjacent_bases(t: Tables) -> DataFrame:
    return phasing.adjacent_bases(_haps(t))


@query(f"WITH g AS (SELECT o_custkey % 40 AS chr, o_orderkey AS read_id, concat('PB.', o_custkey % 9) AS pbid FROM orders), h AS ({_HAP}), s AS (SELECT chr, hap, row_number() OVER (PARTITION BY chr ORDER BY min(read_id)) - 1 AS hap_idx FROM h GROUP BY chr, hap) SELECT h.chr, pbid, hap_idx, count(*) AS n FROM h JOIN s ON h.chr = s.chr AND h.hap = s.hap JOIN g ON h.read_id = g.read_id GROUP BY 1, 2, 3")
def a22_isoform_haplotypes(t: Tables) -> DataFrame:
    members = t.orders.select(F.concat(F.lit("PB."), F.col("o_custkey") % 9).alias("pbid"), F.col("o_orderkey").alias("member"))
    haps = _haps(t)
    called = t.spark.createDataFrame([(p, b) for p in range(3) for b in "ACGT"], "pos bigint, base string")
    return phasing.tally(phasing.phase(haps, haps.select("chr").distinct().crossJoin(F.broadcast(called))), members)


_GT = "SELECT DISTINCT o_custkey % 30 AS chr, o_orderkey AS pos, concat('s', o_custkey % 4) AS sample, concat(o_orderkey % 3, '|', o_orderkey % 2) AS gt, concat(o_orderkey % 7, ',', o_orderkey % 5) AS hq FROM orders"


def _genotypes(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select((c % 30).alias("chr"), k.alias("pos"), F.concat(F.lit("s"), c % 4).alias("sample"), F.concat(k % 3, F.lit("|"), k % 2).alias("gt"), F.concat(k % 7, F.lit(","), k % 5).alias("hq")).distinct()


@query(f"SELECT chr, pos, allele, CAST(sum(hq) AS BIGINT) AS hq FROM (SELECT chr, pos, split_part(gt, '|', i) AS allele, CAST(split_part(hq, ',', i) AS BIGINT) AS hq FROM (SELECT *, unnest([1, 2]) AS i FROM ({_GT}))) GROUP BY ALL")
def a23_merged_genotypes(t: Tables) -> DataFrame:
    return phasing.merge_genotypes(_genotypes(t))


@query(
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY chr, sample ORDER BY pos) AS k FROM ({_GT})),
  h AS (SELECT *, k > 1 AND lag(gt) OVER (PARTITION BY chr, sample ORDER BY pos) <> gt AS c FROM g WHERE k = 1 OR split_part(gt, '|', 1) <> split_part(gt, '|', 2))
  SELECT chr, sample, CAST(sum(CASE WHEN c THEN 1 ELSE 0 END) AS BIGINT) AS n_switch FROM h GROUP BY 1, 2"""
)
def a25_phase_switches(t: Tables) -> DataFrame:
    return phasing.phase_switches(_genotypes(t))


@query(
    f"""WITH h AS (SELECT chr, CASE WHEN read_id % 7 = 0 THEN substr(hap, 1, 1) || '?' || substr(hap, 3, 1) ELSE hap END AS hap FROM ({_HAP})),
  v AS (SELECT chr, count(*) AS num_snp FROM (SELECT chr, pos FROM ({_COUNTS}) GROUP BY chr, pos, ref HAVING count(*) >= 2 AND sum(n) >= 10) GROUP BY 1),
  l AS (SELECT chr, count(*) AS size, count(DISTINCT CASE WHEN hap NOT LIKE '%?%' THEN hap END) AS num_hap, count(DISTINCT CASE WHEN hap LIKE '%?%' THEN hap END) AS num_hap_partial FROM h GROUP BY 1)
  SELECT chr, size, coalesce(num_snp, 0) AS num_snp, num_hap, num_hap_partial FROM l LEFT JOIN v USING (chr)"""
)
def a24_locus_summary(t: Tables) -> DataFrame:
    """Loci with variant positions, and partial haplotypes where a base is missing."""
    partial = F.concat(F.substring("hap", 1, 1), F.lit("?"), F.substring("hap", 3, 1))
    haps = _haps(t).withColumn("hap", F.when(F.col("read_id") % 7 == 0, partial).otherwise(F.col("hap")))
    return phasing.locus_summary(haps.groupBy("chr").agg(F.count("*").alias("size")), _sites(t), haps)


_REGIONS = """SELECT chr, CASE WHEN g = 1 THEN greatest(ref_start - 10, 0) ELSE ref_start END AS ref_start, CASE WHEN g = max(g) OVER (PARTITION BY chr) THEN ref_end + 10 ELSE ref_end END AS ref_end
  FROM (SELECT chr, g, min(s) AS ref_start, max(e) AS ref_end FROM (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
  FROM (SELECT chr, greatest(s - 50, 0) AS s, e + 50 AS e FROM x_exon))) GROUP BY chr, g)"""


@query(f"SELECT chr, CAST(coalesce(sum(ref_end - ref_start) OVER (PARTITION BY chr ORDER BY ref_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS fake_start, ref_start, ref_end FROM ({_REGIONS})")
def e27_fake_genome(t: Tables) -> DataFrame:
    return phasing.fake_genome(t.x_exon, ["chr"])


@query(f"WITH f AS (SELECT chr, coalesce(sum(ref_end - ref_start) OVER (PARTITION BY chr ORDER BY ref_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f0, ref_start, ref_end FROM ({_REGIONS})), p AS (SELECT DISTINCT chr, s // 3 AS pos FROM x_exon) SELECT p.chr, pos, CAST(ref_start + pos - f0 AS BIGINT) AS ref_pos FROM p JOIN f ON p.chr = f.chr AND pos >= f0 AND pos < f0 + ref_end - ref_start")
def j13_lifted_positions(t: Tables) -> DataFrame:
    points = t.x_exon.select("chr", F.floor(F.col("s") / 3).alias("pos")).distinct()
    return phasing.lift(points, phasing.fake_genome(t.x_exon, ["chr"]), ["chr"])


@query("SELECT coalesce(a.chr, b.chr) AS chr, coalesce(a.pos, b.pos) AS pos, CASE WHEN a.pos IS NULL THEN 'only_truth' WHEN b.pos IS NULL THEN 'only_ours' ELSE 'both' END AS status FROM (SELECT DISTINCT l_suppkey % 7 AS chr, l_partkey AS pos FROM lineitem WHERE l_partkey % 2 = 0) a FULL JOIN (SELECT DISTINCT l_suppkey % 7 AS chr, l_partkey AS pos FROM lineitem WHERE l_partkey % 3 = 0) b ON a.chr = b.chr AND a.pos = b.pos")
def j12_compared_variants(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_suppkey") % 7).alias("chr"), F.col("l_partkey").alias("pos"))
    return phasing.compare_variants(rows.filter("pos % 2 = 0"), rows.filter("pos % 3 = 0"), rows.groupBy("chr", "pos").agg(F.count("*").alias("cov"))).select("chr", "pos", "status")


@query(
    f"""WITH o AS ({_OPS}), r AS (SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN n ELSE 0 END) OVER w, 0) AS BIGINT) AS q_from, CAST(pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END) OVER w, 0) AS BIGINT) AS r_from FROM o
    WINDOW w AS (PARTITION BY read_id, part, pos, cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT read_id || '_' || part || '_' || pos || '_' || cigar AS name, q_from, r_from, n FROM r WHERE op = 'M'"""
)
def e34_base_map(t: Tables) -> DataFrame:
    rows = t.x_cigar.distinct().select(F.concat_ws("_", "read_id", "part", "pos", "cigar").alias("name"), F.lit("c").alias("chr"), F.col("pos").alias("s"), "cigar")
    return seqtools.base_map(rows, "name").select("name", "q_from", "r_from", "n")


@query(
    """WITH x AS (SELECT tid, strand, s - tid % 97 * 5000 AS s, e - tid % 97 * 5000 AS e FROM x_exon), g AS (SELECT repeat('ACGGTCA', CAST(ceil(max(e) / 7.0) AS INT)) AS sequence FROM x)
  SELECT tid, CASE WHEN strand = '-' THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END AS seq
  FROM (SELECT tid, strand, string_agg(substr(sequence, CAST(s + 1 AS INT), CAST(e - s AS INT)), '' ORDER BY s) AS q FROM x CROSS JOIN g GROUP BY tid, strand)"""
)
def e35_reference_sequence(t: Tables) -> DataFrame:
    """Sequences of all exons, over a genome as long as the longest transcript."""
    shifted = t.x_exon.withColumns({"s": F.col("s") - F.col("tid") % 97 * 5000, "e": F.col("e") - F.col("tid") % 97 * 5000, "chr": F.lit("c")})
    genome = shifted.agg(F.repeat(F.lit("ACGGTCA"), F.ceil(F.max("e") / 7).cast("int")).alias("sequence")).select(F.lit("c").alias("chr"), "sequence")
    return seqtools.reference_sequence(collapse.transcripts(shifted, ["tid", "chr", "strand"]), genome).select("tid", "seq")


@query(
    f"""WITH t AS (SELECT DISTINCT id, {_TAG.format("umi")} || {_TAG.format("bc")} AS tag FROM clip_out_umi_cellbc), b AS (SELECT id, tag, translate(tag, 'ACGT', '1101') AS bits FROM t WHERE tag IS NOT NULL),
  u AS (SELECT DISTINCT bits FROM b), p AS (SELECT bits, unnest(range(0, length(bits) + 1)) AS i FROM u),
  s AS (SELECT bits, i, CAST(coalesce(sum(CASE WHEN i = 0 THEN 0 WHEN substr(bits, i, 1) = '1' THEN 1 ELSE -2 END) OVER (PARTITION BY bits ORDER BY i), 0) AS BIGINT) AS s FROM p),
  r AS (SELECT *, min(s) OVER (PARTITION BY bits ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowest FROM s),
  l AS (SELECT a.bits, a.i, max(z.i) AS j FROM (SELECT * FROM r WHERE lowest IS NULL OR s < lowest) a JOIN s z ON a.bits = z.bits AND z.s >= a.s GROUP BY a.bits, a.i),
  k AS (SELECT bits, j, min(i) AS i FROM l WHERE j - i >= 8 GROUP BY bits, j), g AS (SELECT bits, string_agg((i + 1) || '-' || j, ',' ORDER BY i) AS runs FROM k GROUP BY bits)
  SELECT DISTINCT id, bits, coalesce(runs, '') AS error_runs FROM b LEFT JOIN g USING (bits)"""
)
def e33_error_runs(t: Tables) -> DataFrame:
    rows = t.clip_out_umi_cellbc.select("id", F.translate(F.concat(tag_value("umi"), tag_value("bc")), "ACGT", "1101").alias("bits")).filter("bits is not null").distinct()
    return aligner.with_error_runs(rows, "bits", 2, 8)


# --- molecular tags --------------------------------------------------------------------------------


# Tags of each read from the digest of its id, without A and with a fixed first base for the tail, without G before a run of G.
_NO_A, _NO_G = ("translate(substr(md5(CAST(doc_id AS STRING)), {0}, {1}), '0123456789abcdef', '" + letters + "')" for letters in ("CGTCGTCGTCGTCGTC", "ACTACTACTACTACTA"))


@query(
    f"""SELECT doc_id AS id, CAST(20 + doc_id % 8 AS INT) AS clip_len, CASE WHEN doc_id % 8 > 0 THEN substr('GTCAGTC', 1, CAST(doc_id % 8 AS INT)) END AS extra, 'G' || {_NO_A.format(1, 7)} AS umi, {_NO_A.format(8, 12)} AS bc FROM x_seq"""
)
def e30_clip_tail(t: Tables) -> DataFrame:
    tail = F.concat(F.lit("C"), F.repeat(F.lit("A"), (F.col("doc_id") % 5 + 12).cast("int")), F.substring(F.lit("GTCAGTC"), F.lit(1), (F.col("doc_id") % 8).cast("int")), F.lit("G"), F.expr(_NO_A.format(1, 19)))
    reads = t.x_seq.select(F.col("doc_id").alias("id"), F.concat(F.regexp_replace("raw", "[^ACGT]", ""), tail).alias("seq"))
    return singlecell.clip_tail(reads, 8, 12).select("id", "clip_len", "extra", "umi", "bc")


@query(f"SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN repeat('C', CAST(doc_id % 4 AS INT)) END AS extra, {_NO_G.format(1, 8)} AS umi FROM x_seq")
def e30_clip_head(t: Tables) -> DataFrame:
    head = F.concat(F.repeat(F.lit("C"), (F.col("doc_id") % 4).cast("int")), F.expr(_NO_G.format(1, 8)), F.lit("GGGT"))
    reads = t.x_seq.select(F.col("doc_id").alias("id"), F.concat(head, F.regexp_replace("raw", "[^ACGT]", "")).alias("seq"))
    return singlecell.clip_head(reads, 8).select("id", "extra", "umi")


_DROPLET = f"SELECT doc_id AS id, CASE WHEN doc_id % 3 > 0 THEN repeat('T', CAST(doc_id % 3 AS INT)) END AS extra, {_NO_G.format(1, 10)} AS bc, {_NO_G.format(11, 6)} AS umi, 'CATCGGG' AS tso FROM x_seq"


def _droplets(t: Tables) -> DataFrame:
    head = F.concat(F.repeat(F.lit("T"), (F.col("doc_id") % 3).cast("int")), F.expr(_NO_G.format(1, 16)), F.lit("CATCGGGT"))
    reads = t.x_seq.select(F.col("doc_id").alias("id"), fs.reverse_complement(F.concat(head, F.regexp_replace("raw", "[^ACGT]", ""))).alias("seq"))
    return singlecell.clip_droplet(reads, 6, 10, 4)


@query(_DROPLET)
def e30_clip_droplet(t: Tables) -> DataFrame:
    return _droplets(t).select("id", "extra", "bc", "umi", "tso")


@query(
    f"""WITH d AS ({_DROPLET}), r AS (SELECT DISTINCT reverse(translate(bc, 'ACGT', 'TGCA')) AS b, CASE WHEN id % 4 = 0 THEN 'Y' ELSE 'N' END AS top FROM d WHERE id % 2 = 0)
  SELECT id, reverse(translate(bc, 'ACGT', 'TGCA')) AS bc_rev, CASE WHEN max(top) IS NULL THEN 'N' ELSE 'Y' END AS bc_match, coalesce(max(top), 'N') AS bc_top_rank FROM d LEFT JOIN r ON b = reverse(translate(bc, 'ACGT', 'TGCA')) GROUP BY id, bc"""
)
def e30_whitelist(t: Tables) -> DataFrame:
    """A list of known barcodes, half of them of top rank, against all."""
    clipped = _droplets(t)
    known = clipped.filter("id % 2 = 0").select(F.col("bc_rev").alias("cell_barcode"), F.when(F.col("id") % 4 == 0, "Y").otherwise("N").alias("top_ranked"))
    return singlecell.with_whitelist(clipped, known).select("id", "bc_rev", "bc_match", "bc_top_rank")


@query()
def e29_corrected_tags(t: Tables) -> DataFrame:
    rows = t.umi_bc_error_correct.select("id", plain_value("gene").alias("gene"), tag_value("bc").alias("bc"), tag_value("umi").alias("umi")).distinct()
    return singlecell.correct_tags(rows).select("id", "gene", "bc", "umi", "bc_ed", "umi_ed")


@query(
    """SELECT bc_ed, umi_ed, gene, last(id ORDER BY deduped_at NULLS FIRST, id NULLS FIRST, pbid NULLS FIRST, cluster NULLS FIRST) AS id, count(*) AS num_dups FROM dedup_flnc_per_cluster GROUP BY 1, 2, 3"""
)
def a20_deduplicated(t: Tables) -> DataFrame:
    rows = t.dedup_flnc_per_cluster.select("bc_ed", "umi_ed", "gene", "id", "pbid", "cluster", "deduped_at")
    return singlecell.deduplicate(rows, ["deduped_at", "id", "pbid", "cluster"]).select("bc_ed", "umi_ed", "gene", "id", "num_dups")


@query("SELECT count(DISTINCT gene) AS n_loci, count(DISTINCT umi_ed) AS n_umi, count(DISTINCT bc_ed) AS n_bc, CAST(sum(num_dups) AS BIGINT) AS n_reads, count(*) AS n_molecules FROM dedup_flnc_per_cluster")
def a21_tag_report(t: Tables) -> DataFrame:
    return singlecell.tag_report(t.dedup_flnc_per_cluster)


@query("SELECT CAST(floor(log2(num_dups)) AS BIGINT) AS log2_dups, count(*) AS n FROM dedup_flnc_per_cluster WHERE num_dups > 0 GROUP BY 1")
def a21_duplicate_histogram(t: Tables) -> DataFrame:
    return singlecell.duplicate_histogram(t.dedup_flnc_per_cluster)


@query("SELECT gene, count(*) AS n_molecules FROM dedup_flnc_per_cluster GROUP BY 1 ORDER BY 2 DESC, gene NULLS LAST LIMIT 10")
def a21_top_loci(t: Tables) -> DataFrame:
    return singlecell.top_loci(t.dedup_flnc_per_cluster)


@query(
    """WITH i1 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x_aln),
  i2 AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i1),
  f AS (SELECT chr, island, concat('u', read_id % 3) AS umi, row_number() OVER (PARTITION BY read_id ORDER BY chr, island, s, e) AS n FROM i2)
  SELECT chr, island, umi, count(*) AS size, CAST(sum(count(*)) OVER (PARTITION BY chr, island) AS BIGINT) AS n_reads_total FROM f WHERE n = 1 GROUP BY 1, 2, 3"""
)
def a19_umi_groups(t: Tables) -> DataFrame:
    return singlecell.umi_groups(t.x_aln.withColumn("umi", F.concat(F.lit("u"), F.col("read_id") % 3)), use_barcode=False)


@query(
    """SELECT m.id, m.pbid, c.structural_category, coalesce(o.orfgroup, 'NoORF') AS orfgroup FROM (SELECT DISTINCT id, isoform AS pbid FROM collate_flnc_gene_info WHERE isoform IS NOT NULL) m
  JOIN (SELECT isoform AS pbid, max(structural_category) AS structural_category FROM classification GROUP BY 1) c ON m.pbid = c.pbid
  LEFT JOIN (SELECT isoform AS pbid, max(orf_seq) AS orfgroup FROM classification GROUP BY 1 HAVING max(orf_seq) IS NOT NULL) o ON m.pbid = o.pbid"""
)
def j10_annotated_molecules(t: Tables) -> DataFrame:
    rows = t.collate_flnc_gene_info.filter("isoform is not null").select("id", F.col("isoform").alias("pbid")).distinct()
    by = t.classification.groupBy(F.col("isoform").alias("pbid"))
    orfs = by.agg(F.max("orf_seq").alias("orfgroup")).filter("orfgroup is not null")
    return singlecell.annotate(rows, by.agg(F.max("structural_category").alias("structural_category")), orfs)


@query("SELECT id, bcrev AS bc_rev, celltype FROM umi_bc_error_correct JOIN (SELECT bcrev, min(category) AS celltype FROM collate_flnc_gene_info WHERE bcrev IS NOT NULL AND length > 3000 GROUP BY 1) USING (bcrev)")
def j10_linked_cells(t: Tables) -> DataFrame:
    cells = t.collate_flnc_gene_info.filter("bcrev is not null AND length > 3000").groupBy(F.col("bcrev").alias("bc_rev")).agg(F.min("category").alias("celltype"))
    return singlecell.link_cells(t.umi_bc_error_correct.select("id", F.col("bcrev").alias("bc_rev")), cells)


@query(
    f"""WITH r AS (SELECT DISTINCT {_TAG.format("bc")} AS bc, {_TAG.format("bc_ed")} AS ed, coalesce(bc_match = 'Y', false) AS matched FROM umi_bc_error_correct)
  SELECT DISTINCT reverse(translate(bc, 'ACGT', 'TGCA')) AS from_bc, reverse(translate(ed, 'ACGT', 'TGCA')) AS to_bc FROM r WHERE bc IS NOT NULL AND ed IS NOT NULL AND (matched OR bc <> ed)"""
)
def s24_repair_map(t: Tables) -> DataFrame:
    """Both reports: matched rows as the clean one; of the others, the tags corrected to each as the synthesis one."""
    rows = t.umi_bc_error_correct.select(tag_value("bc").alias("bc"), tag_value("bc_ed").alias("ed"), F.coalesce(F.col("bc_match") == "Y", F.lit(False)).alias("matched")).filter("bc is not null")
    clean = rows.filter("ed is not null").select(F.col("bc").alias("cell_barcode"), F.col("ed").alias("repaired_to"), F.when(F.col("matched"), "TRUE").otherwise("FALSE").alias("repaired"))
    others = rows.filter(~F.col("matched") & ~F.col("bc").eqNullSafe(F.col("ed")))
    synthesis = others.groupBy(F.coalesce("ed", F.lit("NA")).alias("intended_sequence")).agg(F.concat_ws(":", F.collect_set("bc")).alias("related_sequences"))
    return singlecell.repair_map(clean, synthesis)
