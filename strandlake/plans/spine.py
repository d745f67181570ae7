"""Queries over loci, segments, counts, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequence as fs
from strandlake.functions.alignment import isoform_id
from strandlake.operators import collapse, compare, counts, intervals, junctions, rarefaction, seqtools
from strandlake.plans.registry import Tables, query
from strandlake.session import stage

_GOOD = "SELECT * FROM x_aln WHERE flag <> 4 AND q_coverage >= 0.95 AND identity >= 0.95"
_ISLANDS = f"""good AS ({_GOOD}),
  i1 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chr, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM good),
  i2 AS (SELECT *, sum(new) OVER (PARTITION BY chr, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i1)"""


def _good(t: Tables) -> DataFrame:
    return collapse.quality_alignments(t.x_aln, min_coverage=0.95)


@query(
    f"""WITH {_ISLANDS},
  l AS (SELECT chr, strand, island, min(s) AS locus_start, max(e) AS locus_end, count(*) AS n_reads FROM i2 GROUP BY ALL),
  p AS (SELECT chr, strand, island, s AS pt FROM i2 UNION SELECT chr, strand, island, e FROM i2),
  q AS (SELECT chr, strand, island, pt, lead(pt) OVER (PARTITION BY chr, strand, island ORDER BY pt) AS nxt FROM p),
  g AS (SELECT chr, strand, island, count(*) AS n_segments FROM q WHERE nxt IS NOT NULL GROUP BY ALL)
  SELECT chr, strand, island, locus_start, locus_end, n_reads, n_segments FROM l JOIN g USING (chr, strand, island)"""
)
def locus_catalogue(t: Tables) -> DataFrame:
    """Quality filter, loci by strand, atomic segments and counts of each locus."""
    good, key = _good(t), ["chr", "strand"]
    places = stage(intervals.island_ends(good, key), "islands")
    found = places.select(*key, "island", F.col("island_start").alias("_from"), (F.col("island_end") + 1).alias("_to"))
    segments = stage(intervals.elementary_segments(good, key).select(*key, "seg_start"), "segments")
    counted = {"n_reads": (good.select(*key, "s"), "s"), "n_segments": (segments, "seg_start")}
    rows = [intervals.locate(df, found, key, at, ("_from", "_to")).select(*key, "island", *(F.lit(int(c == name)).alias(c) for c in counted)) for name, (df, at) in counted.items()]
    sums = rows[0].unionByName(rows[1]).groupBy(*key, "island").agg(*(F.sum(c).alias(c) for c in counted))
    return places.withColumnsRenamed({"island_start": "locus_start", "island_end": "locus_end"}).join(sums, [*key, "island"])


@query("SELECT CASE WHEN flag = 4 THEN 'unmapped' WHEN q_coverage < 0.99 THEN 'coverage' WHEN identity < 0.95 THEN 'identity' END AS reason, count(*) AS n FROM x_aln GROUP BY 1")
def pr01_quality_reasons(t: Tables) -> DataFrame:
    return collapse.with_reason(t.x_aln).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_ISLANDS} SELECT chr, strand, island, min(s) AS locus_start, max(e) AS locus_end, count(*) AS n_reads FROM i2 GROUP BY ALL"""
)
def t02_islands_by_strand(t: Tables) -> DataFrame:
    return intervals.islands(_good(t), ["chr", "strand"]).groupBy("chr", "strand", "island").agg(F.min("s").alias("locus_start"), F.max("e").alias("locus_end"), F.count("*").alias("n_reads"))


@query(
    """WITH i1 AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x_aln),
  i2 AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i1)
  SELECT chr, island, min(s) AS locus_start, max(e) AS locus_end, count(*) AS n FROM i2 GROUP BY ALL"""
)
def t01_islands_strict(t: Tables) -> DataFrame:
    return intervals.islands(t.x_aln, ["chr"], touching=False).groupBy("chr", "island").agg(F.min("s").alias("locus_start"), F.max("e").alias("locus_end"), F.count("*").alias("n"))


@query(
    """WITH i1 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x_aln),
  i2 AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i1)
  SELECT chr, min(s) AS locus_start, max(e) AS locus_end, count(*) AS n FROM i2 GROUP BY chr, island"""
)
def t01_loci_by_sweep(t: Tables) -> DataFrame:
    """The same loci from range partitions, for keys with very many intervals."""
    return intervals.loci(t.x_aln, ["chr"]).groupBy("chr", "locus_start", "locus_end").agg(F.count("*").alias("n")).select("chr", "locus_start", "locus_end", "n")


@query(
    """WITH p AS (SELECT chr, s AS pt FROM x_aln UNION SELECT chr, e FROM x_aln),
  d AS (SELECT chr, pt, sum(d) AS d FROM (SELECT chr, s AS pt, 1 AS d FROM x_aln UNION ALL SELECT chr, e, -1 FROM x_aln) GROUP BY chr, pt),
  q AS (SELECT chr, pt AS seg_start, lead(pt) OVER w AS seg_end, sum(d) OVER (PARTITION BY chr ORDER BY pt ROWS UNBOUNDED PRECEDING) AS depth FROM p JOIN d USING (chr, pt) WINDOW w AS (PARTITION BY chr ORDER BY pt))
  SELECT chr, seg_start, seg_end, depth FROM q WHERE depth > 0"""
)
def e02_elementary_segments(t: Tables) -> DataFrame:
    return intervals.elementary_segments(t.x_aln, ["chr"])


@query("SELECT read_id, sum(covered) AS covered FROM (SELECT read_id, chr, max(e) - min(s) AS covered FROM (SELECT *, sum(new) OVER (PARTITION BY read_id, chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY read_id, chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x_aln)) GROUP BY read_id, chr, g) GROUP BY read_id")
def t04_covered_length(t: Tables) -> DataFrame:
    return intervals.covered_length(t.x_aln, ["read_id", "chr"], small_keys=True).groupBy("read_id").agg(F.sum("covered").alias("covered"))


_PROBES = "SELECT concat('probe', p_partkey) AS probe, p_brand AS gene, concat('chr', p_partkey % 5) AS chr, p_partkey * 1000 + 200 AS p_s, p_partkey * 1000 + 500 AS p_e FROM {part}"


def _probes(t: Tables) -> DataFrame:
    return t.spark.sql(_PROBES, part=t.part)


@query(f"WITH p AS ({_PROBES.format(part='part')}) SELECT read_id, part, s, e, probe FROM x_aln JOIN p ON x_aln.chr = p.chr AND s < p_e AND p_s < e")
def j01_overlap_join(t: Tables) -> DataFrame:
    return intervals.overlap_join(t.x_aln, _probes(t), ["chr"], ("s", "e"), ("p_s", "p_e")).select("read_id", "part", "s", "e", "probe")


@query(f"WITH p AS ({_PROBES.format(part='part')}) SELECT read_id, part, s, e FROM x_aln WHERE NOT EXISTS (SELECT 1 FROM p WHERE x_aln.chr = p.chr AND s < p_e AND p_s < e)")
def j01_overlap_anti(t: Tables) -> DataFrame:
    return intervals.overlap_join(t.x_aln, _probes(t), ["chr"], ("s", "e"), ("p_s", "p_e"), how="left_anti").select("read_id", "part", "s", "e")


@query(
    f"""WITH p AS ({_PROBES.format(part='part')}), h AS (SELECT read_id, count(DISTINCT probe) AS n_probes, sum(least(e, p_e) - greatest(s, p_s)) AS overlap_bp, count(DISTINCT gene) AS n_genes
  FROM x_aln JOIN p ON x_aln.chr = p.chr AND s < p_e AND p_s < e GROUP BY 1)
  SELECT read_id, coalesce(n_probes, 0) AS n_probes, coalesce(overlap_bp, 0) AS overlap_bp, coalesce(n_genes, 0) AS n_genes FROM (SELECT DISTINCT read_id FROM x_aln) LEFT JOIN h USING (read_id)"""
)
def j02_probe_hits(t: Tables) -> DataFrame:
    return seqtools.probe_hits(t.x_aln, _probes(t))


_KNOWN = "SELECT DISTINCT chr, strand, \"left\" AS k_left, \"right\" AS k_right FROM scrub_sample_gff_junctions WHERE annotation = 'Y' AND chr IS NOT NULL AND strand IS NOT NULL AND \"left\" < \"right\""


def _known_junctions(t: Tables) -> DataFrame:
    """Junctions that some report calls annotated."""
    return t.scrub_sample_gff_junctions.filter("annotation = 'Y' AND left < right").select("chr", "strand", "left", "right").dropna().distinct()


@query(
    f"""WITH a AS (SELECT DISTINCT chr, strand, "left", "right" FROM scrub_sample_gff_junctions), k AS ({_KNOWN}),
  m AS (SELECT a.chr, a.strand, "left", "right", k_left, k_right, abs("left" - k_left) + abs("right" - k_right) AS distance,
    row_number() OVER (PARTITION BY a.chr, a.strand, "left", "right" ORDER BY abs("left" - k_left) + abs("right" - k_right), k_left, k_right) AS n
    FROM a JOIN k ON a.chr = k.chr AND a.strand = k.strand AND abs("left" - k_left) <= 20 AND abs("right" - k_right) <= 20)
  SELECT chr, strand, "left", "right", k_left, k_right, distance FROM m WHERE n = 1"""
)
def j03_nearest_junction(t: Tables) -> DataFrame:
    """The nearest annotated junction of the distinct junctions of all samples."""
    key = ["chr", "strand"]
    known = _known_junctions(t).withColumnsRenamed({"left": "k_left", "right": "k_right"})
    return intervals.nearest(t.scrub_sample_gff_junctions.select(*key, "left", "right").distinct(), known, key, ("left", "right"), ("k_left", "k_right"), 20, [*key, "left", "right"])


@query(
    f"""WITH k AS ({_KNOWN}) SELECT a.chr, a.strand, a."left", a."right", CASE WHEN k.chr IS NULL THEN 'N' ELSE 'Y' END AS annotation
  FROM (SELECT DISTINCT chr, strand, "left", "right" FROM scrub_sample_gff_junctions) a
  LEFT JOIN k ON a.chr = k.chr AND a.strand = k.strand AND a."left" = k.k_left AND a."right" = k.k_right"""
)
def j11_known_junctions(t: Tables) -> DataFrame:
    return junctions.with_annotation(t.scrub_sample_gff_junctions.select("chr", "strand", "left", "right").distinct(), _known_junctions(t))


_TRANSCRIPTS = "SELECT tid, chr, strand, string_agg(s || '-' || e, ',' ORDER BY s) AS exons, sum(e - s) AS exonic_length, max(e) - min(s) AS span, count(*) AS n_exons FROM x_exon GROUP BY tid, chr, strand"


def _transcripts(t: Tables) -> DataFrame:
    return collapse.transcripts(t.x_exon, ["tid", "chr", "strand"])


@query(f"SELECT tid, exonic_length, span, n_exons FROM ({_TRANSCRIPTS})")
def a13_transcript_stats(t: Tables) -> DataFrame:
    return collapse.transcript_stats(_transcripts(t), "tid")


@query("SELECT tid, row_number() OVER w AS exon_no, e - s AS exon_size, s - lag(e) OVER w AS intron_size FROM x_exon WINDOW w AS (PARTITION BY tid ORDER BY s, e)")
def a13_exon_stats(t: Tables) -> DataFrame:
    return collapse.exon_stats(t.x_exon, "tid")


@query(f"SELECT tid, exons FROM ({_TRANSCRIPTS}) WHERE n_exons > 1")
def pr03_multi_exon(t: Tables) -> DataFrame:
    return collapse.multi_exon(_transcripts(t)).select("tid", compare.exon_text("exons").alias("exons"))


_JUNCTIONS = "SELECT tid, chr, strand, e - 1 AS \"left\", lead(s) OVER (PARTITION BY tid ORDER BY s, e) AS \"right\" FROM x_exon"


@query(
    f"""SELECT chr, "left", "right", strand, count(*) AS num_transcript, count(DISTINCT sample) AS num_sample
  FROM (SELECT *, tid % 3 AS sample FROM ({_JUNCTIONS})) WHERE "right" IS NOT NULL GROUP BY ALL"""
)
def a14_junction_report(t: Tables) -> DataFrame:
    return junctions.junction_report(_transcripts(t).withColumn("sample", F.col("tid") % 3))


@query(
    f"""WITH g AS (SELECT tid, chr, strand, max(e) - min(s) AS span, min(s) AS lo, max(e) AS hi, string_agg(s || '-' || e, ',' ORDER BY s) AS exons, count(*) AS k FROM x_exon GROUP BY tid, chr, strand),
  j AS (SELECT tid, string_agg("left" || '-' || "right", ',' ORDER BY "left") AS shape FROM ({_JUNCTIONS}) WHERE "right" IS NOT NULL GROUP BY tid),
  a AS (SELECT g.*, coalesce(j.shape, exons) AS shape FROM g LEFT JOIN j USING (tid))
  SELECT chr, strand, first(tid ORDER BY span DESC, tid) AS pbid, first(exons ORDER BY span DESC, tid) AS exons, sum(tid % 5) AS count_fl, count(*) AS n_merged FROM a GROUP BY chr, strand, k > 1, shape"""
)
def a15_merge_equal(t: Tables) -> DataFrame:
    rows = _transcripts(t).withColumn("pbid", F.col("tid")).withColumn("count_fl", F.col("tid") % 5)
    return junctions.merge_equal(rows).withColumn("exons", compare.exon_text("exons"))


@query("SELECT chr, strand, s, e, count(*) AS n FROM x_exon GROUP BY ALL")
def a27_exon_coverage(t: Tables) -> DataFrame:
    return seqtools.exon_coverage(t.x_exon)


@query(
    """WITH seg AS (SELECT chr, strand, pt AS seg_start, lead(pt) OVER (PARTITION BY chr, strand ORDER BY pt) AS seg_end
    FROM (SELECT chr, strand, s AS pt FROM x_exon UNION SELECT chr, strand, e FROM x_exon))
  SELECT chr, strand, tid, string_agg(CAST(seg_start AS STRING), ',' ORDER BY seg_start) AS segment_path
  FROM (SELECT DISTINCT x.chr, x.strand, x.tid, seg_start FROM x_exon x JOIN seg ON x.chr = seg.chr AND x.strand = seg.strand AND x.s <= seg_start AND seg_end <= x.e) GROUP BY chr, strand, tid"""
)
def e03_segment_paths(t: Tables) -> DataFrame:
    exons = t.x_exon
    return collapse.exon_segments_of(exons, intervals.elementary_segments(exons, ["chr", "strand"]), ["chr", "strand"], "tid")


# --- counts ----------------------------------------------------------------------------------------

_STAT = """WITH p AS (SELECT DISTINCT read_id, read_type, pbid FROM x_cluster LEFT JOIN (SELECT pbid, concat('c', CAST(substr(member, 6) AS BIGINT) % 700) AS cluster_id FROM x_group) g USING (cluster_id)),
  n AS (SELECT *, count(pbid) OVER (PARTITION BY read_id, read_type) AS k FROM p)
  SELECT read_id AS id, CASE WHEN read_type = 'FL' THEN 'Y' ELSE 'N' END AS is_fl,
    CASE WHEN pbid IS NULL THEN 'unmapped' WHEN read_type = 'FL' OR k = 1 THEN 'unique' ELSE 'ambiguous' END AS stat, pbid
  FROM n WHERE read_type = 'FL' OR pbid IS NOT NULL OR k = 0"""


def _cluster_groups(t: Tables) -> DataFrame:
    return t.x_group.select("pbid", F.concat(F.lit("c"), F.substring("member", 6, 20).cast("bigint") % 700).alias("member"))


def _read_stat(t: Tables) -> DataFrame:
    return counts.read_stat(_cluster_groups(t), t.x_cluster)


@query(_STAT)
def a02_read_stat(t: Tables) -> DataFrame:
    return _read_stat(t)


@query(f"SELECT pbid, count(*) AS count_fl, round(count(*) / sum(count(*)) OVER (), 9) AS norm_fl FROM ({_STAT}) WHERE is_fl = 'Y' AND pbid IS NOT NULL GROUP BY pbid")
def a01_abundance(t: Tables) -> DataFrame:
    return counts.cluster_abundance(_cluster_groups(t), t.x_cluster).withColumn("norm_fl", F.round("norm_fl", 9))


@query("SELECT pbid, count(*) AS n_members FROM x_group GROUP BY 1")
def a03_group_sizes(t: Tables) -> DataFrame:
    return counts.group_sizes(t.x_group)


PRIMERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT pbid, " + ", ".join(f"count(*) FILTER (WHERE primer = '{p}') AS \"{p}\"" for p in PRIMERS) + " FROM x_group JOIN x_primer ON member = id GROUP BY pbid")
def a04_demux_matrix(t: Tables) -> DataFrame:
    return counts.demux(t.x_group.select("pbid", F.col("member").alias("id")), t.x_primer, PRIMERS)


@query("SELECT cluster_id AS pbid, primer, count(*) AS n FROM x_cluster JOIN x_primer ON read_id = id WHERE read_type = 'FL' GROUP BY ALL")
def a05_demux_clusters(t: Tables) -> DataFrame:
    return counts.demux_long(t.x_cluster.filter("read_type = 'FL'").select(F.col("cluster_id").alias("pbid"), F.col("read_id").alias("id")), t.x_primer)


@query("SELECT pbid, " + ", ".join(f"count(*) FILTER (WHERE CAST(substr(member, 6) AS BIGINT) % 7 = {i}) AS primer_{i}" for i in range(6)) + " FROM x_group GROUP BY pbid")
def a05_demux_dense(t: Tables) -> DataFrame:
    """Primer numbers within older cluster ids; the seventh is beyond the dense columns."""
    number = F.substring("member", 6, 20).cast("bigint")
    return counts.demux_dense(t.x_group.select("pbid", F.concat_ws("|", F.lit("i0"), number % 7, F.concat(F.lit("c"), number)).alias("id")), 6)


@query("SELECT DISTINCT member AS id, 'Y' AS is_fl, 'unique' AS stat, pbid FROM x_group")
def a29_group_read_stat(t: Tables) -> DataFrame:
    return counts.group_read_stat(t.x_group.unionByName(t.x_group))


@query("SELECT pbid, primer, count(*) AS n FROM x_group JOIN x_cluster ON concat('read/', substr(member, 6)) = read_id JOIN x_primer ON read_id = id WHERE read_type = 'FL' GROUP BY ALL")
def a06_barcode_counts(t: Tables) -> DataFrame:
    fl = t.x_group.join(t.x_cluster.filter("read_type = 'FL'"), F.col("member") == F.col("read_id"))
    return counts.demux_long(fl.select("pbid", F.col("read_id").alias("id")), t.x_primer)


_GROUPS = {"high": PRIMERS[:2], "rest": PRIMERS[2:]}
_GROUPED = """SELECT pbid, CASE WHEN primer IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'rest' END AS grp, count(*) AS n FROM x_group JOIN x_primer ON member = id GROUP BY ALL"""


@query(f"WITH a AS ({_GROUPED}), g AS (SELECT unnest(['high', 'rest']) AS grp), b AS (SELECT DISTINCT pbid FROM a) SELECT pbid, grp, coalesce(n, 0) AS n FROM b CROSS JOIN g LEFT JOIN a USING (pbid, grp)")
def a07_grouped_demux(t: Tables) -> DataFrame:
    matrix = counts.demux(t.x_group.select("pbid", F.col("member").alias("id")), t.x_primer, PRIMERS)
    return counts.group_barcodes(matrix, "pbid", _GROUPS)


@query(f"SELECT pbid, string_agg(grp, ',' ORDER BY grp) AS groups FROM ({_GROUPED}) GROUP BY pbid")
def a08_present_groups(t: Tables) -> DataFrame:
    matrix = counts.demux(t.x_group.select("pbid", F.col("member").alias("id")), t.x_primer, PRIMERS)
    return counts.present_groups(counts.group_barcodes(matrix, "pbid", _GROUPS), "pbid")


@query("SELECT count(length) AS n, min(length) AS min_len, max(length) AS max_len, round(avg(length), 6) AS avg_len, round(quantile_cont(length, 0.05), 6) AS p5, round(quantile_cont(length, 0.95), 6) AS p95 FROM collate_flnc_gene_info")
def a09_length_stats(t: Tables) -> DataFrame:
    out = counts.length_stats(t.collate_flnc_gene_info)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_len", "p5", "p95")})


@query("SELECT CAST(floor(length / 1000) * 1000 AS BIGINT) AS bin_start, count(*) AS n FROM collate_flnc_gene_info WHERE length IS NOT NULL GROUP BY 1")
def a09_length_histogram(t: Tables) -> DataFrame:
    return counts.length_histogram(t.collate_flnc_gene_info)


@query("SELECT pbid, count(*) AS count_fl FROM x_group GROUP BY pbid HAVING count(*) >= 10 AND max(CAST(substr(member, 6) AS BIGINT) % 12) >= 10")
def pr02_filter_by_count(t: Tables) -> DataFrame:
    """By the count of an isoform and the best count of a member, which its id has."""
    number = F.substring("member", 6, 20).cast("bigint")
    groups = t.x_group.select("pbid", F.concat(F.lit("i1/c"), number, F.lit("/f"), number % 12, F.lit("p"), number % 5).alias("member"))
    return counts.filter_by_count(groups.groupBy("pbid").agg(F.count("*").alias("count_fl")), groups, min_count=10)


@query("SELECT pbid, 'abundance' AS missing_in FROM (SELECT DISTINCT pbid FROM x_group) WHERE pbid NOT IN (SELECT pbid FROM sample_abundance WHERE pbid IS NOT NULL)")
def pr16_consistent_ids(t: Tables) -> DataFrame:
    return counts.consistent_ids(t.x_group, {"abundance": t.sample_abundance})


@query("SELECT isoform, count(*) AS n FROM classification GROUP BY 1 HAVING count(*) > 1")
def pr15_duplicate_ids(t: Tables) -> DataFrame:
    return counts.duplicate_ids(t.classification, "isoform")


@query("SELECT read_id, count(*) AS n, CASE WHEN count(*) = 1 THEN 'Y' ELSE 'N' END AS is_unique FROM x_aln GROUP BY 1")
def a17_multimapping(t: Tables) -> DataFrame:
    return counts.multimapping(t.x_aln)


_CPM = "SELECT pbid, gene, fl_count * 1e6 / sum(fl_count) OVER () AS cpm FROM x_fl"


@query(
    f"""SELECT pbid, gene, round(cpm, 6) AS cpm, round(max(cpm) OVER (PARTITION BY gene), 6) AS gene_cpm,
  CAST(CASE WHEN cpm <= 0 THEN 19 ELSE least(19, ceil(3 * log2(max(cpm) OVER (PARTITION BY gene) / cpm))) END AS BIGINT) AS shade FROM ({_CPM})"""
)
def a18_cpm_shades(t: Tables) -> DataFrame:
    return counts.cpm(t.x_fl).select("pbid", "gene", F.round("cpm", 6).alias("cpm"), F.round("gene_cpm", 6).alias("gene_cpm"), "shade")


@query(
    """WITH d AS (SELECT DISTINCT isoform, upper(orf_seq) AS q FROM classification WHERE orf_seq IS NOT NULL AND isoform IS NOT NULL),
  f AS (SELECT q, row_number() OVER (ORDER BY min(isoform), q) AS n FROM d GROUP BY q)
  SELECT isoform, 'ORFgroup_' || n AS orf_group FROM d JOIN f USING (q)"""
)
def a16_orf_groups(t: Tables) -> DataFrame:
    return counts.identical_sequences(t.classification.filter("isoform is not null"), "orf_seq", "isoform")


@query("SELECT chr, CAST(floor(s / 5000) * 5000 AS BIGINT) AS window_start, count(*) AS n FROM x_aln GROUP BY ALL")
def a26_window_depth(t: Tables) -> DataFrame:
    return intervals.windows(t.x_aln, ["chr"], "s", 5000)


@query("SELECT chr, strand, count(DISTINCT read_id) AS n_reads FROM x_aln GROUP BY ALL HAVING count(DISTINCT read_id) >= 40")
def pr18_locus_reads(t: Tables) -> DataFrame:
    return counts.locus_reads(t.x_aln, ["chr", "strand"])


@query(
    """WITH r AS (SELECT gene, sum(fl_count) AS n FROM x_fl WHERE fl_count >= 2 GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM r),
  z AS (SELECT unnest(range(0, total + 1, 2000)) AS size FROM t)
  SELECT size, round(sum(CASE WHEN total - n < size THEN 1 ELSE 1 - exp(lgamma(total - n + 1) - lgamma(total - n - size + 1) - lgamma(total + 1) + lgamma(total - size + 1)) END), 4) AS expected
  FROM z, t, r GROUP BY size"""
)
def a10_expected_richness(t: Tables) -> DataFrame:
    by_gene = rarefaction.counted(t.x_fl, ["gene"], min_count=2)
    return rarefaction.expected_richness(by_gene, step=2000).withColumn("expected", F.round("expected", 4))


@query()
def a10_rarefaction(t: Tables) -> DataFrame:
    return rarefaction.subsample(rarefaction.counted(t.x_fl, ["gene"], min_count=2), "gene", step=2000)


@query()
def a11_rarefaction_by_category(t: Tables) -> DataFrame:
    return rarefaction.subsample(rarefaction.counted(t.x_fl, ["gene", "category"]), "gene", step=2000, category="category", first=100)


@query(
    """SELECT a.pbid, 'PB.' || split_part(a.pbid, '.', 2) AS pbgene, a.length, CASE WHEN lower(coalesce(associated_transcript, 'novel')) = 'novel' THEN 'novel_' || a.pbid ELSE associated_transcript END AS refisoform,
  CASE WHEN lower(coalesce(associated_gene, 'novel')) = 'novel' THEN 'novel_' || a.pbid ELSE associated_gene END AS refgene, structural_category AS category, count_fl AS fl_count
  FROM (SELECT isoform AS pbid, max(length) AS length, sum(fl) AS count_fl FROM classification GROUP BY 1) a JOIN classification c ON a.pbid = c.isoform"""
)
def a12_subsampling_input(t: Tables) -> DataFrame:
    rows = t.classification.groupBy(F.col("isoform").alias("pbid")).agg(F.max("length").alias("length"), F.sum("fl").alias("count_fl"))
    return rarefaction.subsampling_input(rows.select("pbid", "count_fl"), rows, t.classification)


# --- sequences -------------------------------------------------------------------------------------


@query("SELECT doc_id, reverse(translate(regexp_replace(raw, '[^ACGT]', '-', 'g'), 'ACGT', 'TGCA')) AS rc FROM x_seq")
def f04_reverse_complement(t: Tables) -> DataFrame:
    return t.x_seq.select("doc_id", fs.reverse_complement(F.regexp_replace("raw", "[^ACGT]", "-")).alias("rc"))


@query("SELECT umi, umi_ed, CASE WHEN length(umi) = length(umi_ed) THEN hamming(umi, umi_ed) END AS distance FROM (SELECT DISTINCT umi, umi_ed FROM umi_bc_error_correct WHERE umi IS NOT NULL AND umi_ed IS NOT NULL)")
def f06_hamming(t: Tables) -> DataFrame:
    rows = t.umi_bc_error_correct.select("umi", "umi_ed").dropna().distinct()
    return rows.select("umi", "umi_ed", fs.hamming("umi", "umi_ed").alias("distance"))


@query(
    """SELECT pbid, CASE WHEN regexp_matches(pbid, '^[A-Za-z]+[.][0-9]+[.][0-9]+([|]|$)') THEN CAST(regexp_extract(pbid, '^[A-Za-z]+[.]([0-9]+)[.]([0-9]+)', 1) AS BIGINT) END AS gene_idx,
  CASE WHEN regexp_matches(pbid, '^[A-Za-z]+[.][0-9]+[.][0-9]+([|]|$)') THEN CAST(regexp_extract(pbid, '^[A-Za-z]+[.]([0-9]+)[.]([0-9]+)', 2) AS BIGINT) END AS isoform_idx
  FROM (SELECT DISTINCT pbid FROM collate_flnc_gene_info)"""
)
def f08_isoform_ids(t: Tables) -> DataFrame:
    rows = t.collate_flnc_gene_info.select("pbid").distinct()
    return rows.select("pbid", isoform_id("pbid")["gene_idx"].alias("gene_idx"), isoform_id("pbid")["isoform_idx"].alias("isoform_idx"))


@query("SELECT id, umi FROM clip_out_umi_cellbc WHERE split_part(id, '|', 1) IN (SELECT id FROM umi_bc_error_correct WHERE gene LIKE 'Z%')")
def pr06_select_by_id(t: Tables) -> DataFrame:
    ids = t.umi_bc_error_correct.filter("gene LIKE 'Z%'").select("id").distinct()
    return seqtools.select_by_id(t.clip_out_umi_cellbc.select("id", "umi"), ids)


@query("SELECT id, umi FROM clip_out_umi_cellbc WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM umi_bc_error_correct WHERE id IS NOT NULL)")
def pr06_exclude_by_id(t: Tables) -> DataFrame:
    rows = t.clip_out_umi_cellbc.select("id", "umi").filter("id is not null")
    return seqtools.select_by_id(rows, t.umi_bc_error_correct.select("id").distinct(), exclude=True)


@query("SELECT isoform FROM (SELECT DISTINCT isoform FROM classification WHERE isoform IS NOT NULL) WHERE isoform LIKE 'PB.1%' OR isoform LIKE 'PB.23%'")
def pr07_select_by_prefix(t: Tables) -> DataFrame:
    ids = t.spark.createDataFrame([("PB.1",), ("PB.23",)], "id string")
    return seqtools.select_by_id(t.classification.select("isoform").dropna().distinct(), ids, partial=True, key="isoform")


@query("SELECT split_part(id, '/', 1) AS movie, count(*) AS n FROM clip_out_umi_cellbc WHERE split_part(id, '/', 1) IN ('mz0005_250106') GROUP BY 1")
def pr08_restricted_movies(t: Tables) -> DataFrame:
    movie = F.substring_index("id", "/", 1)
    return t.clip_out_umi_cellbc.filter(movie.isin("mz0005_250106")).groupBy(movie.alias("movie")).agg(F.count("*").alias("n"))


@query("SELECT gene, sum(fl_count) AS n FROM x_fl WHERE fl_count >= 2 AND length BETWEEN 310 AND 340 GROUP BY 1")
def pr09_length_filter(t: Tables) -> DataFrame:
    return rarefaction.counted(t.x_fl, ["gene"], min_count=2, length=(310, 340))


@query("SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_different, least(100, count(*)) AS n_known FROM (SELECT DISTINCT id, umi FROM clip_out_umi_cellbc)")
def t09_random_sample(t: Tables) -> DataFrame:
    """A sample of 100 rows, counted: how many, how many different ones, and how many are rows of the table."""
    rows = t.clip_out_umi_cellbc.select("id", "umi").distinct()
    taken = seqtools.random_sample(rows, 100)
    met = taken.join(rows.withColumnsRenamed({"id": "_id", "umi": "_umi"}), F.col("id").eqNullSafe(F.col("_id")) & F.col("umi").eqNullSafe(F.col("_umi")), "left_semi")
    counted = taken.agg(F.count("*").alias("n"), F.count_distinct(F.struct("id", "umi")).alias("n_different"))
    return counted.crossJoin(met.agg(F.count("*").alias("n_known")))
