import datetime
import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandlake.operators import collapse, counts, fusion, junctions, phasing, seqtools, singlecell
from strandlake.sources import alignments, annotations, sinks, tables
from strandlake.streaming import counts as stream_counts


def bam_bytes(records, per_block):
    header = b"@HD\tVN:1.6\n"
    data = b"BAM\1" + struct.pack("<i", len(header)) + header + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, pos, cigar, seq, tags in records:
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        body = struct.pack("<iiBBHHHiiii", 0 if pos >= 0 else -1, pos, len(name) + 1, 60, 0, len(cigar), 0 if pos >= 0 else 4, len(seq), -1, -1, 0)
        body += name.encode() + b"\0" + ops + packed + bytes([30] * len(seq)) + tags
        data += struct.pack("<i", len(body)) + body
    out = b""
    for i in [*range(0, len(data), per_block), None]:
        chunk = b"" if i is None else data[i : i + per_block]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(chunk) + packer.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(chunk), len(chunk))
    return out


def test_bam_in_parts(spark, tmp_path):
    tags = b"NMC\x02" + b"XSA-" + b"XMZACGT\0" + b"bcBS" + struct.pack("<iHH", 2, 7, 9)
    records = [(f"read{i}", i * 10, [(2, "S"), (5, "M"), (100, "N"), (3, "M")], "ACGTACGTAC", tags) for i in range(40)] + [("none", -1, [], "ACG", b"")]
    path = tmp_path / "x.bam"
    path.write_bytes(bam_bytes(records, 333))
    df = alignments.read_bam(spark, str(path), splitBytes=500)
    assert df.rdd.getNumPartitions() > 3
    rows = df.orderBy("pos", "read_id").collect()
    assert [r.read_id for r in rows] == ["none"] + [f"read{i}" for i in range(40)]
    assert (rows[1].cigar, rows[1].seq, rows[1].qual, rows[1].chr) == ("2S5M100N3M", "ACGTACGTAC", "?" * 10, "chr1")
    assert rows[1].tags == {"NM": "2", "XS": "-", "XM": "ACGT", "bc": "S,7,9"}
    one = alignments.with_alignment(df.filter("read_id = 'read3'")).first()
    assert (one.strand, one.s, one.e, one.q_start, one.q_end, one.identity) == ("-", 30, 138, 0, 8, 0.75)
    assert [(x.start, x.end) for x in one.exons] == [(30, 35), (135, 138)]


def test_bam_ranges_hold_each_record_once(tmp_path):
    rng = random.Random(9)
    records = [(f"m/{i}/ccs", rng.randrange(900), [(rng.randrange(1, 40), "M")], "ACGTTGCA" * rng.randrange(1, 60), b"XAZ" + bytes(rng.choice(b"\x41\x42\x43") for _ in range(rng.randrange(30))) + b"\0") for i in range(300)]
    path = tmp_path / "y.bam"
    for per_block in (200, 5000):  # shorter and longer than a record
        path.write_bytes(bam_bytes(records, per_block))
        for split in (90, 1000, 7777, 1 << 20):
            reader = alignments._BamReader({"path": str(path), "splitBytes": str(split)})
            assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [r[0] for r in records], (per_block, split)
    reader = alignments._BamReader({"path": str(path), "start": "5", "end": "8"})
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [f"m/{i}/ccs" for i in (5, 6, 7)]


def test_bam_parts_are_cut_without_inflating(tmp_path, monkeypatch):
    path = tmp_path / "z.bam"
    path.write_bytes(bam_bytes([("a", 1, [(3, "M")], "ACG", b"")] * 100, 300))
    monkeypatch.setattr(alignments.zlib, "decompress", None)
    assert len(alignments._BamReader({"path": str(path), "splitBytes": "100"}).partitions()) > 5


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACG\nT\n>two\n\n>three x\nGG\n")
    got = {r.id: (r.header, r.seq) for r in tables.read_sequences(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"one": ("one first", "ACGT"), "two": ("two", ""), "three": ("three x", "GG")}
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as out:
        out.write("@r1 x\nACGT\n+\n@@@@\n@r2\nA\n+r2\n!\n")
    got = [(r.id, r.seq, r.qual) for r in tables.read_sequences(spark, str(tmp_path / "b.fastq.gz")).collect()]
    assert got == [("r1", "ACGT", "@@@@"), ("r2", "A", "!")]
    with pytest.raises(ValueError):
        tables.sequences_by_id(spark.createDataFrame([("a",), ("a",)], "id string"), ["a"])


def test_config():
    c = tables.parse_config("tmpSAMPLE=A;x\nSAMPLE=B;y\nGFF_FILENAME=t.gff\n")
    assert (c.done, c.samples, c.files) == ({"A": "x"}, {"B": "y"}, {"gff": "t.gff"})
    for bad in ("SAMPLE=B;y\ntmpSAMPLE=A;x", "SAMPLE=tmp_A;x", "SAMPLE=A;x\nSAMPLE=A;y", "", "what"):
        with pytest.raises(ValueError):
            tables.parse_config(bad)


def test_gff_dialects_and_count_files(spark, tmp_path):
    (tmp_path / "g.gff3").write_text("##gff-version 3\nc\tx\tmRNA\t1\t90\t.\t+\t.\tID=m1\nc\tx\texon\t51\t90\t.\t+\t.\tID=e2;Parent=m1\nc\tx\texon\t1\t30\t.\t+\t.\tID=e1;Parent=m1\nc\tx\tCDS\t5\t30\t.\t+\t.\tParent=m1\n###\n")
    row = annotations.transcripts(annotations.read_gff(spark, str(tmp_path / "g.gff3")), "gmap").first()
    assert [(x.start, x.end) for x in row.exons] == [(0, 30), (50, 90)] and [(x.start, x.end) for x in row.cds] == [(4, 30)]
    (tmp_path / "c.txt").write_text("# a\n# b\npbid\tcount_fl\nPB.1.1\t3\nPB.2.1\tNA\n")
    assert [tuple(r) for r in tables.read_counts(spark, str(tmp_path / "c.txt")).collect()] == [("PB.1.1", "3"), ("PB.2.1", None)]
    with pytest.raises(Exception, match="columns"):
        annotations.parse_pileup(spark.createDataFrame([("a\t1\tA\t2\tx",)], "value string")).collect()


def test_deletions_and_insertions_get_anchors(spark):
    lines = ["5 A C 5 0 0 9 9 1 1 g q", "7 . T 8 0 0 9 9 1 1 g q", "7 . G 9 0 0 9 9 1 1 g q", "10 C . 11 0 0 9 9 1 1 g q", "11 A . 11 0 0 9 9 1 1 g q"]
    snps = annotations.parse_snps(spark.createDataFrame([(x,) for x in lines], "value string"))
    genome = spark.createDataFrame([("g", "TTTTATGTGCAT")], "chr string, sequence string")
    got = sorted((r.pos1, r.ref, r.alt) for r in sinks.snp_vcf(snps, genome).collect())
    assert got == [(5, "A", "C"), (7, "G", "GTG"), (9, "GCA", "G")]


def test_vcf_lines(spark):
    haps = spark.createDataFrame([("c", 0, "AC"), ("c", 1, "GC"), ("c", 2, "?G")], "chr string, hap_idx bigint, hap string")
    called = [("c", 9, "A", "A", 6), ("c", 9, "A", "T", 1), ("c", 9, "A", "G", 1), ("c", 20, "T", "C", 7), ("c", 20, "T", "G", 1)]
    found = phasing.alleles(haps, spark.createDataFrame(called, "chr string, pos bigint, ref string, base string, n bigint"))
    # The reference is 0 even if no read has it; a called base that no haplotype has comes last.
    assert sorted((r.pos, r.allele, r.base) for r in found.collect()) == [(9, 0, "A"), (9, 1, "G"), (9, 2, "T"), (20, 0, "T"), (20, 1, "C"), (20, 2, "G")]
    tally = spark.createDataFrame([("c", "PB.1.1", 0, 3), ("c", "PB.1.1", 1, 1), ("c", "PB.1.2", 2, 4)], "chr string, pbid string, hap_idx bigint, n bigint")
    got = [r.value.split("\t") for r in sinks.vcf_lines(found, phasing.haplotype_alleles(haps, found), tally).orderBy("pos").collect()]
    assert got[0] == ["c", "10", ".", "A", "G,T", ".", "PASS", "AF=0.13,0.13;DP=8", "GT:HQ", "0|1:3,1", ".:4"]
    assert got[1][3:5] == ["T", "C,G"] and got[1][7:] == ["AF=0.88,0.13;DP=8", "GT:HQ", "1|1:3,1", "2:4"]
    assert sinks.vcf_header(["a"])[-1].endswith("FORMAT\ta")
    tables_ = phasing.haplotype_tables(haps, found, spark.createDataFrame([(7, "AC", 0, "c"), (8, "AC", 0, "c")], "read_id bigint, hap string, hap_idx bigint, chr string"))
    assert sorted((r.hap_idx, r.n_reads) for r in tables_["by_hap"].collect()) == [(0, 2), (1, 0), (2, 0)]
    assert ("GC", 1, "c", 10, 1, "ALT0", "G", 1) in {tuple(r) for r in tables_["by_pos"].collect()} and tables_["by_read"].count() == 2


def test_lines_for_browsers_and_hits(spark):
    x = [{"start": 4, "end": 9}, {"start": 20, "end": 30}]
    df = spark.createDataFrame([("a", "c", "-", x)], f"pbid string, chr string, strand string, exons {collapse.EXONS}")
    assert [r.value for r in sinks.ucsc_lines(df).orderBy("line_no").collect()] == ["c\tNA\texon\t21\t30\t.\t-\t.\ta", "c\tNA\texon\t5\t9\t.\t-\t.\ta", "###"]
    assert [r.value for r in sinks.exon_picture_lines(df).orderBy("line_no").collect()] == ["a exon 5 10", "a exon 21 31"]
    hits = spark.createDataFrame([("a", "c", "-", 20, 30), ("a", "c", "-", 4, 9)], "query string, chr string, strand string, s bigint, e bigint")
    assert [tuple(map(tuple, r.exons)) for r in sinks.hits_to_records(hits).collect()] == [((4, 9), (20, 30))]
    with pytest.raises(Exception, match="several places"):
        sinks.hits_to_records(hits.union(hits.selectExpr("query", "'d'", "strand", "s", "e"))).collect()


def test_repeated_tags(spark):
    line = "r\t0\tc\t1\t9\t2M\t*\t0\t0\tAC\t*\tNM:i:1\tXS:A:+\tNM:i:7"
    assert alignments.parse_sam(spark.createDataFrame([(line,)], "value string")).first().tags == {"NM": "1", "XS": "+"}


def test_groups_are_written_apart(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    members = spark.createDataFrame([("a", "g1"), ("a", "g2"), ("b", "g2"), ("b", "g2")], "id string, grp string")
    sinks.write_groups(rows, members, "id", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "grp=g2")).count() == 2
    sinks.write_lines(sinks.fasta_lines(spark.createDataFrame([("b", "C"), ("a", "A")], "id string, seq string")).withColumn("n", F.lit(1)), str(tmp_path / "t"), "value")
    assert "".join(sorted((p.read_text() for p in (tmp_path / "t").glob("part*")))).startswith(">a\nA\n>b\nC\n")


def plain_path_score(found, known):
    """The best total over all ways to go through both paths, by recursion from the start."""
    from functools import cache

    @cache
    def best(i, j):
        if i == 0 or j == 0:
            return 0.0
        (s, e), (lo, hi) = found[i - 1], known[j - 1]
        if min(e, hi) > max(s, lo):
            return best(i - 1, j - 1) + (min(e, hi) - max(s, lo)) / (hi - lo)
        return best(i - 1, j) - 2 if hi <= s else best(i, j - 1) - 1

    ends = [best(len(found), j) for j in range(len(known) + 1)]
    at = max(range(len(known), -1, -1), key=lambda j: ends[j])
    return ends[at] - (len(known) - at)


def test_path_scores():
    rng = random.Random(3)
    path = lambda: [(s := at + rng.randrange(0, 15), s + rng.randrange(1, 30)) for at in range(0, 50 * rng.randrange(1, 7), 50)]
    for _ in range(200):
        a, b = path(), path()
        score, pairs = seqtools.path_score(a, b)
        assert score == pytest.approx(plain_path_score(tuple(a), tuple(b)))
        assert all(min(a[i][1], b[j][1]) > max(a[i][0], b[j][0]) for j, i in pairs) and pairs == sorted(pairs)


def test_mapping_categories(spark):
    x = lambda *p: [{"start": a, "end": b} for a, b in p]
    schema = f"id string, chr string, strand string, exons {collapse.EXONS}"
    full = ((0, 10), (20, 30), (40, 50))
    found = spark.createDataFrame(
        [("a", "c", "+", x(*full)), ("b", "c", "+", x((21, 30), (40, 50))), ("c", "c", "-", x((20, 30), (40, 50))), ("d", "c", "+", x((0, 10), (40, 50))), ("e", "d", "+", x(*full)), ("f", "c", "+", x((-30, -20), *full)), ("g", "c", "+", x((20, 30)))], schema
    )
    known = spark.createDataFrame([("t", "c", x(*full))], f"transcript string, chr string, exons {collapse.EXONS}")
    rows = {r.id: r for r in seqtools.evaluate_mapping(found, known).collect()}
    assert {k: r.category for k, r in rows.items()} == {"a": "full", "b": "5miss1", "c": "3miss1", "d": "skipped", "e": "bad", "f": "fused", "g": "bad"}
    assert [tuple(p) for p in rows["b"].boundary] == [(1, 0), (0, 0)]


def test_fusions_are_collated(spark):
    x = lambda *p: [{"start": a, "end": b} for a, b in p]
    genome = spark.createDataFrame([("c", "A" * 60 + "C" * 60 + "G" * 60 + "T" * 60)], "chr string, sequence string")
    parts = spark.createDataFrame([("f1", 1, "c", "+", x((0, 20), (40, 63))), ("f1", 2, "c", "-", x((150, 183))), ("f2", 1, "c", "-", x((10, 30))), ("f2", 2, "d", "+", x((5, 9)))], f"fusion_id string, part int, chr string, strand string, exons {collapse.EXONS}")
    classes = spark.createDataFrame([("f1", 1, "ga", "MK"), ("f1", 2, "gb", None), ("f2", 1, "novelGene_1", None), ("f2", 2, "gb", "MM")], "fusion_id string, part int, gene string, orf string")
    counts_ = spark.createDataFrame([("f1", 3), ("f2", 1)], "fusion_id string, count_fl bigint")
    ids = spark.createDataFrame([("gb", "E2"), ("gb", "E1"), ("ga", "E0")], "gene string, gene_id string")
    got = {r.fusion_id: r for r in fusion.collate(parts, classes, counts_, genome, gene_ids=ids, min_distance=50).collect()}
    f1, f2 = got["f1"], got["f2"]
    assert (f1.fusion_name, f1.left_breakpoint, f1.right_breakpoint, f1.left_exons, f1.right_exons) == ("ga--gb", "c:63:+", "c:183:-", 2, 1)
    assert (f1.left_flank, f1.right_flank) == ("A" * 47 + "C" * 3, "A" * 3 + "C" * 47)
    assert (f1.score, f1.verdict, f1.left_gene_id, f1.right_gene_id, f1.left_orf, f1.left_cds) == (750_000.0, "PASS", "E0", "E1_E2", "MK", None)
    assert (f2.verdict, f2.left_breakpoint, f2.right_breakpoint, f2.right_flank) == ("FAIL:NovelGene", "c:11:-", "d:5:+", None)
    assert fusion.collate(parts, classes, min_distance=200).filter("fusion_id = 'f1'").first().verdict == "FAIL:BreakpointTooClose"


def test_loci_to_phase(spark):
    stat = spark.createDataFrame([(f"m/{i % 30}/0_9", f"PB.1.{i % 2 + 1}") for i in range(40)] + [("m/99/ccs", "PB.2.1"), ("m/77/ccs", "PB.1.1")], "id string, pbid string")
    reads = spark.createDataFrame([(f"m/{i}/ccs", "ACGT") for i in range(30)] + [("m/99/ccs", "AC")], "id string, seq string")
    loci, rows = phasing.loci_to_phase(stat, reads, min_reads=40)
    assert [tuple(r) for r in loci.collect()] == [("PB.1", 40, 30)] and rows.count() == 30
    x = [{"start": 100, "end": 200}, {"start": 300, "end": 990}]
    records = spark.createDataFrame([("PB.1.1", "c", "+", x), ("PB.2.1", "c", "+", x)], f"pbid string, chr string, strand string, exons {collapse.EXONS}")
    config = phasing.locus_configs(loci, records, spark.createDataFrame([("c", 1000)], "chr string, length bigint"))
    assert [tuple(r) for r in config.collect()] == [("PB.1", "c", "+", 40, 1000)]
    assert [r.pbid for r in phasing.strictly_within(records, "c", 100, 990, "+").collect()] == ["PB.1.1", "PB.2.1"]
    assert phasing.strictly_within(records, "c", 101, 990, "+").count() == 0
    regions = phasing.fake_genome(records.selectExpr("'c' AS chr", "explode(exons) AS x").selectExpr("chr", "x.start AS s", "x.end AS e"), ["chr"], flank=5)
    genome = spark.createDataFrame([("c", "ACGT" * 250)], "chr string, sequence string")
    assert sorted(tuple(r) for r in regions.collect()) == [("c", 0, 85, 205), ("c", 120, 295, 1005)]
    regions = regions.withColumn("ref_end", F.least("ref_end", F.lit(1000)))
    text = "ACGT" * 250
    assert phasing.fake_sequence(regions, genome, ["chr"]).first().sequence == text[85:205] + text[295:1000]


def test_motifs_over_windows(spark):
    genome = spark.createDataFrame([("c", "AAAAGTTTTTTAGCC")], "chr string, sequence string")
    report = spark.createDataFrame([("c", 3, 13, "+"), ("c", 3, 13, "-"), ("d", 3, 13, "+"), ("c", 3, 40, "+")], "chr string, left bigint, right bigint, strand string")
    got = [(r.chr, r.right, r.strand, r.genome) for r in junctions.with_motif(report, genome).collect()]
    assert sorted(got, key=str) == sorted([("c", 13, "+", "GT-AG"), ("c", 13, "-", "CT-AC"), ("d", 13, "+", None), ("c", 40, "+", None)], key=str)
    spans = spark.createDataFrame([("c", 2, 11), ("c", 12, 15), ("c", 14, 99), ("c", None, 2), ("c", 5, 5)], "chr string, s bigint, e bigint")
    cut = [(r.s, r.piece) for r in seqtools.cut_sequences(spans, genome, "s", "e", size=4).collect()]
    assert sorted(cut, key=str) == sorted([(2, "AAGTTTTTT"), (12, "GCC"), (14, None), (None, None), (5, None)], key=str)


def test_abundance_of_clusters_equals_that_of_reads(spark):
    rng = random.Random(6)
    groups = spark.createDataFrame([(f"p{rng.randrange(5)}", f"c{rng.randrange(8)}") for _ in range(30)] + [(None, "c1"), ("p1", None)], "pbid string, member string")
    clusters = spark.createDataFrame([(f"c{rng.randrange(10)}", f"r{rng.randrange(60)}", rng.choice(["FL", "FL", "NonFL"])) for _ in range(150)] + [(None, "r1", "FL")], "cluster_id string, read_id string, read_type string")
    one = {(r.pbid, r.count_fl, round(r.norm_fl, 9)) for r in counts.abundance(counts.read_stat(groups.dropna(), clusters.dropna())).collect()}
    assert one == {(r.pbid, r.count_fl, round(r.norm_fl, 9)) for r in counts.cluster_abundance(groups, clusters).collect()}
    assert counts.cluster_abundance(groups.limit(0), clusters).count() == 0


def test_adapter_clip(spark):
    reads = spark.createDataFrame([("a", "GGACGTACGTTTGCATGCATGCATGCATTTTT"), ("n", None), ("x", "AAAAAAAA")], "id string, seq string")
    got = singlecell.clip_adapter(reads, 8, "TTGCATGCATGCATGCA").collect()
    assert [(r.id, r.extra, r.umi) for r in got] == [("a", "GG", "ACGTACGT")]


def test_stream_counts(spark, tmp_path):
    day = lambda d: datetime.datetime(2025, 1, d, 5)
    rows = spark.createDataFrame([("a", day(1)), ("a", day(1)), ("b", day(9)), ("a", None)], "k string, t timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_counts.windowed_counts(stream, "t", ["k"]).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.n) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]
