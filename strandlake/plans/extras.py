"""Queries over dialects, qualities, representatives, fusions and other operators that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequence as fs
from strandlake.functions.tags import plain_value
from strandlake.operators import aligner, chain, collapse, fusion, junctions, phasing, seqtools, singlecell
from strandlake.plans.registry import Tables, query
from strandlake.sources import alignments, annotations

# --- dialects --------------------------------------------------------------------------------------


def _gff(t: Tables, source: str, attributes, feature: str = "exon", rows: DataFrame | None = None) -> DataFrame:
    rows = t.x_exon if rows is None else rows
    fields = [F.col("chr"), F.lit(source), F.lit(feature), F.col("s") + 1, F.col("e"), F.lit("."), F.col("strand"), F.lit("."), attributes]
    return rows.select(F.concat_ws("\t", *(f.cast("string") for f in fields)).alias("value"))


@query(
    """WITH n AS (SELECT *, sum(e - s) OVER w - (e - s) AS q, sum(e - s) OVER (PARTITION BY tid) AS total FROM x_exon WINDOW w AS (PARTITION BY tid ORDER BY CASE strand WHEN '-' THEN -s ELSE s END ROWS UNBOUNDED PRECEDING))
  SELECT 'm' || tid AS id, 'r' || tid AS name, chr, strand, CAST(90 + tid % 10 AS DOUBLE) AS coverage, CAST(95 + tid % 5 AS DOUBLE) AS identity, string_agg(s || '-' || e, ',' ORDER BY s) AS exons,
    string_agg(CAST(q AS BIGINT) || '-' || CAST(q + e - s AS BIGINT), ',' ORDER BY s) AS q_exons FROM n WHERE NOT (tid % 7 = 0) OR tid IN (SELECT tid FROM x_exon GROUP BY tid HAVING count(*) = 1) GROUP BY tid, chr, strand"""
)
def s09_gmap_records(t: Tables) -> DataFrame:
    """Records with coverage, identity and places on the read; every seventh has its exons in the wrong order on the read."""
    from pyspark.sql import Window

    size = F.col("e") - F.col("s")
    along = Window.partitionBy("tid").orderBy(F.when(F.col("strand") == "-", -F.col("s")).otherwise(F.col("s")))
    rows = t.x_exon.withColumns({"_q": F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, 0)) - size, "_total": F.sum(size).over(Window.partitionBy("tid"))})
    rows = rows.withColumn("_q", F.when(F.col("tid") % 7 == 0, F.col("_total") - F.col("_q") - size).otherwise(F.col("_q")))
    exons = _gff(t, "GMAP", F.concat(F.lit("ID=e;Parent=m"), "tid", F.lit(";Target=r"), "tid", F.lit(" "), F.col("_q") + 1, F.lit(" "), F.col("_q") + size, F.lit(" +")), rows=rows)
    heads = t.x_exon.groupBy("tid", "chr", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    mrna = _gff(t, "GMAP", F.concat(F.lit("ID=m"), "tid", F.lit(";Name=r"), "tid", F.lit(";coverage="), F.lit(90) + F.col("tid") % 10, F.lit(".0;identity="), F.lit(95) + F.col("tid") % 5, F.lit(".0")), "mRNA", heads)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    found = annotations.gmap_transcripts(annotations.parse_gff(mrna.unionByName(exons)))
    return found.select("id", "name", "chr", "strand", F.round("coverage", 1).alias("coverage"), F.round("identity", 1).alias("identity"), text("exons").alias("exons"), text("q_exons").alias("q_exons"))


@query("SELECT 'asmbl_' || tid AS id, 'S' || tid % 97 AS gene, chr, strand, string_agg(s || '-' || e, ',' ORDER BY s) AS exons FROM x_exon GROUP BY tid, chr, strand")
def s10_pasa_records(t: Tables) -> DataFrame:
    """The dialect is that of the program in the second column."""
    features = annotations.parse_gff(_gff(t, "PASA", F.concat(F.lit('gene_id "S'), F.col("tid") % 97, F.lit('"; transcript_id "asmbl_'), "tid", F.lit('";'))))
    found = annotations.transcripts(features, annotations.dialect_of(features))
    return found.select("id", "gene", "chr", "strand", F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("exons"))


def _gtf(t: Tables) -> DataFrame:
    names = F.concat(F.lit('gene_id "G'), F.col("tid") % 97, F.lit('"; transcript_id "T'), "tid", F.lit('"; gene_name "N'), F.col("tid") % 13, F.lit('";'))
    return annotations.parse_gff(_gff(t, "known", names))


@query("SELECT chr, strand, s, e, string_agg(DISTINCT 'T' || tid, ',' ORDER BY 'T' || tid) AS transcripts FROM x_exon GROUP BY ALL")
def s11_transcripts_of_exons(t: Tables) -> DataFrame:
    return annotations.transcripts_of_exons(_gtf(t)).withColumn("transcripts", F.array_join("transcripts", ","))


@query("SELECT DISTINCT 'T' || tid AS transcript, 'G' || tid % 97 AS gene_id, 'N' || tid % 13 AS gene_name FROM x_exon")
def s11_transcript_info(t: Tables) -> DataFrame:
    return annotations.transcript_info(_gtf(t)).select("transcript", "gene_id", "gene_name")


@query("SELECT 'T' || tid AS transcript, chr, strand, CASE strand WHEN '-' THEN min(s) ELSE max(e) - 1 END AS pos FROM x_exon GROUP BY tid, chr, strand")
def s11_three_prime_ends(t: Tables) -> DataFrame:
    return annotations.ends_of_transcripts(_gtf(t), five_prime=False)


@query("SELECT 'c' || p_partkey % 5 AS chr, p_partkey - 1 AS s, p_partkey + p_size AS e, 'G' AS reference, p_size % 9 AS coverage FROM part")
def s13_variant_features(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    fields = [F.concat(F.lit("c"), p % 5), F.lit("."), F.lit("substitution"), p, p + F.col("p_size"), F.lit("."), F.lit("."), F.lit("."), F.concat(F.lit("reference=G;variantSeq=A;coverage="), F.col("p_size") % 9)]
    rows = annotations.parse_variant_gff(t.part.select(F.concat_ws("\t", *(f.cast("string") for f in fields)).alias("value")))
    return rows.select("chr", "s", "e", F.col("attrs")["reference"].alias("reference"), F.col("attrs")["coverage"].cast("bigint").alias("coverage"))


def _tagged_sam(t: Tables, tags) -> DataFrame:
    fields = [F.concat_ws("_", "read_id", "part", "pos", "cigar"), F.col("read_id") % 2 * 16, F.lit("chr1"), F.col("pos") + 1, F.lit(60), F.col("cigar"), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), tags]
    return alignments.parse_sam(t.x_cigar.distinct().select(F.concat_ws("\t", *(f.cast("string") for f in fields)).alias("value")))


@query("SELECT read_id || '_' || part || '_' || pos || '_' || cigar AS read_id, CASE part % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE CASE WHEN read_id % 2 = 1 THEN '-' ELSE '+' END END AS strand FROM (SELECT DISTINCT * FROM x_cigar)")
def s03_strand_by_tag(t: Tables) -> DataFrame:
    tag = F.concat(F.lit("XS:A:"), F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("?")), (F.col("part") % 3 + 1).cast("int")))
    return alignments.with_alignment(_tagged_sam(t, tag)).select("read_id", "strand")


@query("SELECT read_id || '_' || part || '_' || pos || '_' || cigar AS read_id, 5000 AS q_len, CASE WHEN read_id % 2 = 1 THEN 5000 - (part + 700) ELSE q0 + part + 10 END AS q_start, CASE WHEN read_id % 2 = 1 THEN 5000 - (q0 + part + 10) ELSE part + 700 END AS q_end FROM (SELECT DISTINCT *, CAST(regexp_extract(cigar, '^([0-9]+)S', 1) AS BIGINT) AS q0 FROM x_cigar)")
def s06_part_by_tags(t: Tables) -> DataFrame:
    """The aligned part of the read, of 5000 bases, from the tags XS, XE and XQ."""
    tags = F.concat(F.lit("XS:i:"), F.col("part") + 11, F.lit("\tXE:i:"), F.col("part") + 701, F.lit("\tXQ:i:5000"))
    return alignments.with_alignment(_tagged_sam(t, tags), blasr=True).select("read_id", "q_len", "q_start", "q_end")


# --- sequences -------------------------------------------------------------------------------------


@query("SELECT concat('r', p_partkey) AS id FROM part WHERE p_size % 5 >= 2 AND p_partkey % 10 >= 5")
def pr04_high_quality(t: Tables) -> DataFrame:
    header = F.concat(F.lit("r"), "p_partkey", F.lit(" full_length_coverage="), F.col("p_size") % 5, F.lit(";expected_accuracy=0.9"), F.col("p_partkey") % 10, F.lit("5"))
    return seqtools.high_quality(t.part.select(header.alias("header")), 2, 0.95).select("id")


@query("SELECT id, pbid, structural_category FROM (SELECT DISTINCT id, isoform AS pbid FROM collate_flnc_gene_info WHERE isoform IS NOT NULL) JOIN (SELECT isoform AS pbid, max(structural_category) AS structural_category FROM classification GROUP BY 1) USING (pbid) WHERE id IN (SELECT id FROM clip_out_umi_cellbc WHERE extra IS NULL OR extra = '' OR upper(trim(extra)) = 'NA')")
def pr17_without_extra_bases(t: Tables) -> DataFrame:
    rows = t.collate_flnc_gene_info.filter("isoform is not null").select("id", F.col("isoform").alias("pbid")).distinct()
    by = t.classification.groupBy(F.col("isoform").alias("pbid"))
    none = by.agg(F.max("orf_seq").alias("orfgroup")).filter("false")
    return singlecell.annotate(rows, by.agg(F.max("structural_category").alias("structural_category")), none, t.clip_out_umi_cellbc.withColumn("extra", plain_value("extra"))).select("id", "pbid", "structural_category")


@query("SELECT pbid, arg_max(member, (k % 50, member)) AS representative FROM (SELECT pbid, member, CAST(substr(member, 6) AS BIGINT) AS k FROM x_group) GROUP BY pbid")
def t10_representatives(t: Tables) -> DataFrame:
    rows = t.x_group.select("pbid", F.col("member").alias("read_id"), (F.substring("member", 6, 20).cast("bigint") % 50).alias("length"))
    return collapse.representative(rows, "pbid", "length")


@query("SELECT p_partkey AS id, round(1 - (pow(10, -(p_partkey % 40) / 10.0) * n + pow(10, -1.5) * n) / (2 * n), 9) AS accuracy FROM (SELECT p_partkey, p_size + 1 AS n FROM part)")
def f05_accuracy(t: Tables) -> DataFrame:
    """Qualities of two kinds between trimmed ends of the worst one."""
    n, p = F.col("p_size") + 1, F.col("p_partkey")
    quality = F.concat(F.repeat(F.lit("!"), F.lit(100)), F.repeat(F.char(p % 40 + 33), n), F.repeat(F.lit("0"), n), F.repeat(F.lit("!"), F.lit(30)))
    return t.part.select(p.alias("id"), F.round(fs.expected_accuracy(quality), 9).alias("accuracy"))


_PIECE = "SELECT doc_id, substr(s, 1, 400) AS s FROM (SELECT doc_id, regexp_replace(raw, '[^ACGT]', ''{0}) AS s FROM x_seq) WHERE length(s) >= 60"


@query(
    f"""WITH p AS ({_PIECE.format(", 'g'")}), q AS (SELECT doc_id, s, repeat('abcdefghij', 40)[1:length(s)] AS qual, substr(s, 11, 40) AS part FROM p),
  f AS (SELECT doc_id, qual, part, instr(s, part) AS fw FROM q) SELECT doc_id, substr(qual, fw, 40) AS quality FROM f"""
)
def f15_recovered_quality(t: Tables) -> DataFrame:
    """The quality of a piece of each read, of the first place where it stands."""
    rows = t.x_seq.select("doc_id", F.substring(F.regexp_replace("raw", "[^ACGT]", ""), 1, 400).alias("s")).filter("length(s) >= 60")
    rows = rows.select("doc_id", "s", F.expr("substr(repeat('abcdefghij', 40), 1, length(s))").alias("qual"), F.substring("s", 11, 40).alias("part"))
    return rows.select("doc_id", fs.recover_quality("s", "qual", "part").alias("quality"))


@query("""WITH j AS (SELECT DISTINCT chr, strand, "left", "right" FROM (SELECT chr, strand, e - 1 AS "left", lead(s) OVER (PARTITION BY tid ORDER BY s, e) AS "right" FROM x_exon) WHERE "right" IS NOT NULL),
  m AS (SELECT *, substr(repeat('ACGGTCA', 2), CAST(("left" + 1) % 7 + 1 AS INT), 2) AS a, substr(repeat('ACGGTCA', 2), CAST(("right" - 2) % 7 + 1 AS INT), 2) AS b FROM j)
  SELECT chr, strand, "left", "right", CASE strand WHEN '-' THEN reverse(translate(b, 'ACGT', 'TGCA')) || '-' || reverse(translate(a, 'ACGT', 'TGCA')) ELSE a || '-' || b END AS genome FROM m""")
def f13_motifs(t: Tables) -> DataFrame:
    """Bases at the junctions, from a genome of every chromosome."""
    report = junctions.junction_report(collapse.transcripts(t.x_exon, ["tid", "chr", "strand"]).withColumn("sample", F.lit(1))).select("chr", "strand", "left", "right")
    genome = t.x_exon.groupBy("chr").agg(F.repeat(F.lit("ACGGTCA"), F.ceil(F.max("e") / 7).cast("int")).alias("sequence"))
    return junctions.with_motif(report, genome)


@query("SELECT doc_id, translate(a, '|*', '01') AS bits FROM (SELECT doc_id, translate(substr(s, 1, 50), 'ACGT', '|||*') AS a FROM (" + _PIECE.format(", 'g'") + "))")
def e32_error_bits(t: Tables) -> DataFrame:
    rows = t.x_seq.select("doc_id", F.substring(F.regexp_replace("raw", "[^ACGT]", ""), 1, 400).alias("s")).filter("length(s) >= 60")
    return rows.select("doc_id", aligner.error_bits(F.translate(F.substring("s", 1, 50), "ACGT", "|||*")).alias("bits"))


@query(
    """WITH o AS (SELECT *, unnest(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 1)) AS n, unnest(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 2)) AS op, generate_subscripts(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 1), 1) AS i FROM (SELECT DISTINCT * FROM x_cigar)),
  c AS (SELECT *, CAST(n AS BIGINT) AS k, CAST(coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN CAST(n AS BIGINT) END) OVER w, 0) AS BIGINT) AS q0, CAST(pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN CAST(n AS BIGINT) END) OVER w, 0) AS BIGINT) AS r0 FROM o
    WINDOW w AS (PARTITION BY read_id, part, pos, cigar ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT read_id || '_' || part || '_' || pos || '_' || cigar AS name, x.q, r0 + x.q - q0 AS r FROM c, (VALUES (5), (20), (60)) AS x(q) WHERE op = 'M' AND x.q >= q0 AND x.q < q0 + k"""
)
def e34_to_reference(t: Tables) -> DataFrame:
    """Three places of each read on the reference."""
    rows = t.x_cigar.distinct().select(F.concat_ws("_", "read_id", "part", "pos", "cigar").alias("name"), F.lit("c").alias("chr"), F.col("pos").alias("s"), "cigar")
    points = rows.select("name", F.explode(F.expr("array(5L, 20L, 60L)")).alias("q"))
    return seqtools.to_reference(points, seqtools.base_map(rows, "name"), "name").select("name", "q", "r")


# --- fusions ---------------------------------------------------------------------------------------


def _fusion_parts(t: Tables) -> DataFrame:
    rows = collapse.transcripts(t.x_exon, ["tid", "chr", "strand"])
    return rows.select(F.floor(F.col("tid") / 2).alias("fusion_id"), (F.col("tid") % 2 + 1).alias("part"), "chr", "strand", "exons")


_ENDS = """p AS (SELECT tid // 2 AS f, tid % 2 + 1 AS part, chr, strand, min(s) AS s, max(e) AS e, count(*) AS n FROM x_exon GROUP BY tid, chr, strand),
  l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY f ORDER BY part) = 1), r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY f ORDER BY part DESC) = 1),
  b AS (SELECT l.f, l.chr AS lc, CASE l.strand WHEN '+' THEN l.e ELSE l.s + 1 END AS lb, l.strand AS ls, r.chr AS rc, CASE r.strand WHEN '+' THEN r.s ELSE r.e END AS rb, r.strand AS rs, l.n AS ln, r.n AS rn,
    'g' || l.f % 9 AS lg, CASE WHEN r.f % 11 = 0 THEN 'novelGene_' || r.f ELSE 'g' || r.f % 8 END AS rg, l.f % 6 AS c FROM l JOIN r USING (f))"""


@query(
    f"""WITH {_ENDS} SELECT f AS fusion_id, lg || '--' || rg AS fusion_name, lc || ':' || lb || ':' || ls AS left_breakpoint, rc || ':' || rb || ':' || rs AS right_breakpoint, ln AS left_exons, rn AS right_exons, c AS count_fl,
    round(c * 1e6 / sum(c) OVER (), 6) AS score, CASE WHEN rg LIKE 'novel%' THEN 'FAIL:NovelGene' WHEN lg = rg THEN 'FAIL:SameGene' WHEN c < 2 THEN 'FAIL:TooFewFLReads' WHEN lc = rc AND abs(lb - rb) <= 10000 THEN 'FAIL:BreakpointTooClose' ELSE 'PASS' END AS verdict FROM b"""
)
def e14_collated_fusions(t: Tables) -> DataFrame:
    """Breakpoints, names, counts, scores and verdicts of two-part fusions."""
    f = F.col("fusion_id")
    ids = _fusion_parts(t).groupBy("fusion_id").agg(F.lit(1).alias("_x")).select("fusion_id")
    left = ids.select(f, F.lit(1).alias("part"), F.concat(F.lit("g"), f % 9).alias("gene"))
    right = ids.select(f, F.lit(2).alias("part"), F.when(f % 11 == 0, F.concat(F.lit("novelGene_"), f)).otherwise(F.concat(F.lit("g"), f % 8)).alias("gene"))
    classes = left.unionByName(right).withColumn("orf", F.lit(None).cast("string"))
    out = fusion.collate(_fusion_parts(t), classes, ids.select("fusion_id", (f % 6).alias("count_fl")))
    return out.select("fusion_id", "fusion_name", "left_breakpoint", "right_breakpoint", "left_exons", "right_exons", "count_fl", F.round("score", 6).alias("score"), "verdict")


def _whole_fusions(t: Tables, moved: int) -> DataFrame:
    """Fusions of single-exon parts far apart, each with a key of its own."""
    k = F.col("p_partkey")
    exon = lambda at: F.array(F.struct(at.cast("bigint").alias("start"), (at + 100).cast("bigint").alias("end")))
    part = lambda c, at: F.struct(c.alias("chr"), F.lit("+").alias("strand"), exon(at).alias("exons"))
    shift = F.when(k % 3 == 0, moved).otherwise(0)
    return t.part.select(k.alias("id"), F.array(part(F.concat(F.lit("c"), k), F.lit(1000) + shift), part(F.concat(F.lit("d"), k), F.lit(5000) + shift)).alias("parts"))


@query("SELECT p_partkey AS ref_id, p_partkey AS addon_id FROM part WHERE p_partkey % 3 > 0")
def j08_matched_fusions(t: Tables) -> DataFrame:
    """A third of the fusions has its breakpoints too far away."""
    return chain.match_fusions(_whole_fusions(t, 0), _whole_fusions(t, 20))


@query("SELECT CASE WHEN p_partkey % 3 > 0 THEN 2 ELSE 1 END AS n_samples, count(*) * CASE WHEN p_partkey % 3 > 0 THEN 1 ELSE 2 END AS n FROM part GROUP BY p_partkey % 3 > 0")
def j09_chained_fusions(t: Tables) -> DataFrame:
    rows = chain.chain_fusions(_whole_fusions(t, 0), _whole_fusions(t, 20))
    both = F.when(F.col("ref_id").isNotNull() & F.col("addon_id").isNotNull(), 2).otherwise(1)
    return rows.groupBy(both.alias("n_samples")).agg(F.count("*").alias("n"))


# --- selection -------------------------------------------------------------------------------------


@query("SELECT tid FROM x_exon GROUP BY tid, chr, strand HAVING chr = 'chr1' AND strand = '+' AND count(*) > 1 AND min(s) >= 100000 AND max(e) <= 300000")
def pr13_contained_transcripts(t: Tables) -> DataFrame:
    return phasing.strictly_within(collapse.transcripts(t.x_exon, ["tid", "chr", "strand"]), "chr1", 100_000, 300_000, "+").select("tid")


_LOCI = """s AS (SELECT concat('PB.', o_custkey % 400) AS locus, concat('PB.', o_custkey % 400, '.', o_custkey % 3) AS pbid, 'm/' || o_orderkey // 2 AS zmw FROM orders WHERE o_orderkey // 2 % 5 > 0),
  l AS (SELECT locus, count(*) AS n_reads, count(DISTINCT zmw) AS n_zmw FROM s GROUP BY locus HAVING count(*) >= 20)"""


def _loci(t: Tables) -> tuple[DataFrame, DataFrame]:
    zmw = F.floor(F.col("o_orderkey") / 2)
    stat = t.orders.select(F.concat(F.lit("m/"), zmw, F.lit("/"), F.col("o_orderkey") % 2, F.lit("_99")).alias("id"), F.concat(F.lit("PB."), F.col("o_custkey") % 400, F.lit("."), F.col("o_custkey") % 3).alias("pbid"))
    reads = t.orders.select(zmw.alias("z")).distinct().filter("z % 5 > 0").select(F.concat(F.lit("m/"), "z", F.lit("/ccs")).alias("id"), F.lit("ACGT").alias("seq"))
    return phasing.loci_to_phase(stat, reads, 20)


@query(f"WITH {_LOCI} SELECT locus, n_reads, n_zmw FROM l")
def e28_loci_to_phase(t: Tables) -> DataFrame:
    return _loci(t)[0]


@query(f"WITH {_LOCI} SELECT locus, zmw, min(pbid) AS pbid FROM s JOIN l USING (locus) GROUP BY locus, zmw")
def e28_reads_of_loci(t: Tables) -> DataFrame:
    return _loci(t)[1].select("locus", "zmw", "pbid")


@query(f"WITH p AS (SELECT concat('chr', p_partkey % 5) AS chr, p_partkey * 1000 + 200 AS p_s, p_partkey * 1000 + 500 AS p_e FROM part), h AS (SELECT DISTINCT read_id FROM x_aln JOIN p ON x_aln.chr = p.chr AND s < p_e AND p_s < e) SELECT (SELECT count(DISTINCT read_id) FROM x_aln) AS n_reads, count(*) AS n_on_target, round(count(*) / (SELECT count(DISTINCT read_id) FROM x_aln), 9) AS rate FROM h")
def j02_on_target_rate(t: Tables) -> DataFrame:
    probes = t.part.select(F.col("p_partkey").alias("probe"), F.col("p_brand").alias("gene"), F.concat(F.lit("chr"), F.col("p_partkey") % 5).alias("chr"), (F.col("p_partkey") * 1000 + 200).alias("p_s"), (F.col("p_partkey") * 1000 + 500).alias("p_e"))
    return seqtools.on_target_rate(seqtools.probe_hits(t.x_aln, probes)).withColumn("rate", F.round("rate", 9))
