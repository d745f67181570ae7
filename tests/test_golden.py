"""Cases worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import alignment as fa
from strandlake.functions import pileup
from strandlake.functions import sequence as fs
from strandlake.operators import aligner, chain, collapse, compare, counts, fusion, intervals, junctions, phasing, rarefaction, seqtools, singlecell


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def exons(*pairs):
    return [{"start": s, "end": e} for s, e in pairs]


def test_cigar(spark):
    s = fa.cigar_summary(F.lit("1S105M407N548M"))
    row = one(spark, s.alias("s"), fa.cigar_segments(F.lit("1S105M407N548M"), F.lit(948851)).alias("x"))
    assert [(x.start, x.end) for x in row.x] == [(948851, 948956), (949363, 949911)]
    assert (row.s.clip_start, row.s.clip_start + row.s.query_span) == (1, 654)
    row = one(spark, fa.cigar_segments(F.lit("10M5N"), F.lit(0)).alias("x"), fa.cigar_segments(F.lit(None).cast("string"), F.lit(0)).alias("y"))
    assert [(x.start, x.end) for x in row.x] == [(0, 10)]


def test_error_runs(spark):
    bits = "0111011111011011101101"
    assert aligner.error_runs(bits) == [(1, 10), (2, 17), (6, 20)]
    df = spark.createDataFrame([(bits,), ("0000000000",), ("",), (None,)], "bits string")
    assert [r.has_run for r in aligner.has_error_run(df, "bits").collect()][:3] == [True, False, False]
    assert aligner.with_error_runs(df, "bits").collect()[0].error_runs == "1-10,2-17,6-20"


def test_transcript_and_exon_statistics(spark):
    rows = spark.createDataFrame([("a", "c", "+", s, e) for s, e in [(0, 30), (49, 70), (89, 95)]], "tid string, chr string, strand string, s bigint, e bigint")
    stats = collapse.transcript_stats(collapse.transcripts(rows, ["tid"]), "tid").first()
    assert (stats.exonic_length, stats.span, stats.n_exons) == (57, 95, 3)
    got = sorted((r.exon_no, r.exon_size, r.intron_size) for r in collapse.exon_stats(rows, "tid").collect())
    assert got == [(1, 30, None), (2, 21, 19), (3, 6, 19)]
    report = junctions.junction_report(collapse.transcripts(rows, ["tid", "chr", "strand"]).withColumn("sample", F.lit(1)))
    assert sorted((r.left, r.right) for r in report.collect()) == [(29, 49), (69, 89)]


def test_relation():
    a, b = [(10, 30), (49, 70), (89, 95)], [(10, 30), (49, 70), (89, 100), (120, 170)]
    assert compare.relation(a, a, "+") == "exact"
    assert compare.relation(a, b, "-") == "subset"
    assert compare.relation(b, a, "-") == "super"
    assert compare.relation(a, [(200, 300)], "+") == "nomatch"
    assert compare.relation([(10, 30), (50, 70)], [(10, 31), (50, 70)], "+") == "partial"
    assert compare.relation([(10, 30), (50, 70)], [(10, 31), (50, 70)], "+", fuzzy=1) == "exact"
    assert compare.relation([(12, 28)], [(10, 30), (50, 70)], "+") == "subset"
    assert compare.relation([(12, 55)], [(10, 30), (50, 70)], "+") == "partial"


def test_islands_touch_or_not(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 10, 12), ("c", 13, 20), (None, 1, 2), ("c", None, 3)], "chr string, s bigint, e bigint")
    got = lambda t: sorted((r.chr or "", r.s, r.island) for r in intervals.islands(df, ["chr"], touching=t).collect() if r.s is not None)
    assert got(True) == [("", 1, 1), ("c", 0, 1), ("c", 10, 1), ("c", 13, 2)]
    assert [x[2] for x in got(False)] == [1, 1, 2, 3]


def test_elementary_segments(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 20, 30), ("c", 5, 10), ("c", 20, 25)], "chr string, s bigint, e bigint")
    got = sorted((r.seg_start, r.seg_end, r.depth) for r in intervals.elementary_segments(df, ["chr"]).collect())
    assert got == [(0, 5, 1), (5, 10, 2), (20, 25, 2), (25, 30, 1)]


def test_collapse_merges_three_prime_extensions_only(spark):
    rows = [
        ("r1", "c", "+", exons((0, 100), (200, 300))),
        ("r2", "c", "+", exons((0, 100), (200, 350))),  # longer 3' end, merged
        ("r3", "c", "+", exons((0, 100), (200, 900))),  # too long
        ("r4", "c", "+", exons((200, 300))),  # 5'-shortened, merged with merge_5
        ("r5", "c", "-", exons((0, 100), (200, 300))),
        ("r1", "c", "+", exons((0, 100), (200, 300))),  # repeated
        ("r6", "c", "+", None),
    ]
    df = spark.createDataFrame(rows, f"read_id string, chr string, strand string, exons {collapse.EXONS}")
    found = collapse.isoforms_of(collapse.collapse(df)).collect()
    got = sorted((r.strand, [(x.start, x.end) for x in r.exons], r.n_reads) for r in found)
    assert got == [("+", [(0, 100), (200, 350)], 3), ("+", [(0, 100), (200, 900)], 1), ("-", [(0, 100), (200, 300)], 1)]
    strict = collapse.isoforms_of(collapse.collapse(df, merge_5=False)).filter("strand = '+'").count()
    assert strict == 3
    again = collapse.isoforms_of(collapse.collapse(df.orderBy(F.desc("read_id")))).collect()
    assert {r.pbid for r in again} == {r.pbid for r in found}


def test_subsets_are_dropped(spark):
    rows = [("a", "g", "+", exons((0, 50), (100, 200), (300, 400))), ("b", "g", "+", exons((120, 200), (300, 400))), ("c", "g", "+", exons((0, 50), (100, 210), (300, 400)))]
    df = spark.createDataFrame(rows, f"pbid string, gene string, strand string, exons {collapse.EXONS}")
    assert sorted(r.pbid for r in collapse.without_subsets(df).collect()) == ["a", "c"]


def test_chain_two_samples(spark):
    schema = f"id string, chr string, strand string, exons {collapse.EXONS}"
    a = spark.createDataFrame([("A.1", "chr1", "+", exons((0, 100))), ("A.2", "chr1", "-", exons((1000, 1030), (1049, 1070), (1089, 1095)))], schema)
    b = spark.createDataFrame([("B.1", "chr1", "+", exons((0, 100))), ("B.2", "chr1", "-", exons((1000, 1030), (1049, 1070), (1089, 1100), (1140, 1170)))], schema)
    off = chain.chain({"A": a, "B": b}, allow_5=False).collect()
    assert sorted((r.superpbid, r.A, r.B) for r in off) == [("PB.1.1", "A.1", "B.1"), ("PB.2.1", "A.2", None), ("PB.2.2", None, "B.2")]
    on = chain.chain({"A": a, "B": b}).collect()
    assert sorted((r.superpbid, r.A, r.B, len(r.exons)) for r in on) == [("PB.1.1", "A.1", "B.1", 1), ("PB.2.1", "A.2", "B.2", 4)]


def test_fusion_chain(spark):
    part = lambda s, e, c="c1": {"chr": c, "strand": "+", "exons": exons((s, e))}
    schema = f"id string, parts array<struct<chr:string,strand:string,exons:{collapse.EXONS}>>"
    a = spark.createDataFrame([("a1", [part(0, 100), part(500, 600)]), ("a2", [part(0, 100), part(500, 600, "c2")])], schema)
    b = spark.createDataFrame([("b1", [part(30, 105), part(505, 900)]), ("b2", [part(0, 130), part(500, 600, "c2")])], schema)
    got = chain.chain_fusions(a, b).collect()
    assert sorted((r.ref_id or "", r.addon_id or "") for r in got) == [("", "b2"), ("a1", "b1"), ("a2", "")]


def test_fusion_verdict_order(spark):
    df = spark.createDataFrame([(None, None, 1, "c", "c", 1, 2), ("g", "h", 5, "c", "c", 1, 20000)], "left_gene string, right_gene string, count_fl int, left_chr string, right_chr string, left_break int, right_break int")
    assert [r.verdict for r in fusion.with_verdict(df).collect()] == ["FAIL:NovelGene", "PASS"]


def test_barcodes_are_absorbed_once():
    assert singlecell.absorb(["ACGT", "ACGA", "TCGA"], [3, 1, 1]) == {"ACGA": "ACGT"}
    assert singlecell.absorb([], []) == {}


def test_correct_tags_with_nulls(spark):
    rows = [("g", "ACGT", "AAAA")] * 3 + [("g", "ACGA", "AAAT"), ("g", None, "AAAA"), (None, "ACGA", None)]
    got = singlecell.correct_tags(spark.createDataFrame(rows, "gene string, bc string, umi string")).collect()
    assert len(got) == 6
    assert ("g", "ACGA", "ACGT", "AAAA") in {(r.gene, r.bc, r.bc_ed, r.umi_ed) for r in got}


def test_tails(spark):
    row = one(spark, fs.g_run(F.lit("AAGGGGTT")).alias("g"), fs.a_tail(F.lit("CCAAAAAAAAAAGT")).alias("a"), fs.a_tail(F.lit("CCC")).alias("n"), fs.a_tail(F.lit("C" * 300 + "A" * 9)).alias("l"))
    assert tuple(row.g) == (2, 6)
    assert tuple(row.a) == (1, 12)
    assert tuple(row.n) == (-1, -1)
    assert tuple(row.l) == (299, 309)


def test_shade_and_revcomp(spark):
    row = one(spark, fs.shade_index(F.lit(100.0), F.lit(50.0)).alias("i"), fs.shade_index(F.lit(1.0), F.lit(0.0)).alias("z"), fs.reverse_complement(F.lit("ACGTNr")).alias("r"))
    assert (row.i, row.z, row.r) == (3, 19, "yNACGT")


def test_pileup_counts_first_bases():
    assert pileup.bases_of("^]..+2AC,$a*", "G") == ["G", "G", "g", "a", "*"]


def test_fisher():
    assert phasing.fisher_greater(0, 10, 0, 10) == pytest.approx(1.0)
    assert phasing.fisher_greater(10, 0, 0, 10) == pytest.approx(1 / 184756)


def test_variants_by_rank(spark):
    clean = spark.createDataFrame([("a", p, "A", b, n) for p, m in ((1, 1), (2, 3), (3, 8), (4, 20)) for b, n in (("A", 40), ("C", m))], "chr string, pos bigint, ref string, base string, n bigint")
    sites = clean.groupBy("chr", "pos").agg(F.sum("n").alias("cov"), F.count("*").alias("n_types"))
    called = lambda **o: {r.pos for r in phasing.call_variants(clean, sites, **o).filter("rank > 1").collect()}
    # p values: 0.5 (1 of 41), 0.12 (3 of 43), 0.003 (8 of 48), 2e-7 (20 of 60); eight tests.
    assert called() == {4}
    assert called(p_cut=0.2, fdr=0.05) == {3, 4}
    assert called(p_cut=0.2, fdr=0.5) == {2, 3, 4}
    # Below the cut-off only, so that one alone is ranked: equal to its level doesn't pass.
    assert called(p_cut=0.001, fdr=1e-9) == set()


def test_diploid_pair(spark):
    assert phasing.diploid_pair(["AC", "GT", "AT"], [["A", "G"], ["C", "T"]]) == ("AC", "GT", 1)
    assert phasing.diploid_pair(["A?"], [["A", "G"], ["C", "T"]]) is None
    haps = spark.createDataFrame([("x", 0, "AT"), ("x", 1, "AC"), ("x", 2, "GT"), ("x", 3, "G?"), ("y", 0, "?C")], "chr string, hap_idx bigint, hap string")
    variants = spark.createDataFrame([(c, p, b, r) for c in "xy" for p, two in ((5, "AG"), (9, "CT")) for r, b in enumerate(two, 1)], "chr string, pos bigint, base string, rank bigint")
    # AT with GC is 1 off AC, 1 off GT and 1 off G?; AC with GT is 1 off AT and 1 off G?.
    assert [tuple(r) for r in phasing.diploid_pairs(haps, variants).collect()] == [("x", "AC", "GT", 2)]


def test_haplotypes_are_chosen_by_gain(spark):
    choose = phasing.choose_haplotypes
    assert choose({"AAAAAA": 10, "TTTTTT": 8, "AAAAAT": 5}, 2) == ["AAAAAA", "TTTTTT"]
    assert choose({"AAAAAA": 10, "AAAAAT": 5}, 2) == ["AAAAAA"]
    # The distances of all haplotypes count: they fall from 2 + 3 to 1, by 4.
    assert choose({"AAAAAA": 10, "AAAATT": 8, "TAAATT": 6}, 2) == ["AAAAAA", "AAAATT"]
    # Partial ones are no share of the total: 3 of 13 is more than 1/6.
    assert choose({"AAAAAA": 10, "TTTTTT": 3, "AAAAA?": 12}, 2) == ["AAAAAA", "TTTTTT"]
    assert choose({"AAAAAA": 10, "TTTTTT": 9, "CCCCCC": 8}, 3) == ["AAAAAA", "TTTTTT", "CCCCCC"]
    assert choose({"AAAAAA": 10, "TTTTTT": 9, "CCCCCC": 1}, 3) == ["AAAAAA", "TTTTTT"]
    # Short haplotypes need a gain of one only.
    assert choose({"AAA": 10, "AAT": 5}, 2) == ["AAA", "AAT"]
    assert choose({"A?": 3}, 2) == choose({}, 2) == []
    assigned = spark.createDataFrame([(i, "c", h) for i, h in enumerate(["AAA"] * 10 + ["AAT"] * 5 + ["CAT", "A?T"])] + [(99, "d", "A?")], "read_id bigint, chr string, hap string")
    got = {(r.chr, r.hap, r.corrected, r.distance) for r in phasing.clean_phasing(assigned).collect()}
    assert got == {("c", "AAA", "AAA", 0), ("c", "AAT", "AAT", 0), ("c", "CAT", "AAT", 1), ("c", "A?T", "AAT", 1)}
    members = spark.createDataFrame([("p", 0), ("p", 15), ("q", 16)], "pbid string, member bigint")
    assert {tuple(r) for r in phasing.retally(phasing.clean_phasing(assigned), members).collect()} == {("c", "p", "AAA", 1), ("c", "p", "AAT", 1), ("c", "q", "AAT", 1)}


def test_imputation():
    assert phasing.impute("ACGTA", ["ACGTT", "TTTTT"]) == 0
    assert phasing.impute("ACGTA", ["ACGTT", "ACGTC"]) is None
    assert phasing.impute("ACG", []) is None


READS = "read_id string, chr string, flag bigint, s bigint, e bigint, cigar string, seq string"


def phased(spark, reads, variants, **options):
    v = spark.createDataFrame([("c", p, b) for p, two in variants for b in two], "chr string, pos bigint, base string")
    return {r.read_id: (r.hap, r.hap_idx, r.reason) for r in phasing.phase_reads(spark.createDataFrame(reads, READS), v, **options).collect()}


def test_phasing_from_reads(spark):
    reads = [(f"r{i}", "c", 0, 0, 6, "6M", "ACGTAC" if i % 2 else "ATGTGC") for i in range(6)]
    reads += [
        ("s", "c", 4, 0, 6, "6M", "ACGTAC"), ("t", "c", 16, 0, 6, "6M", "ACGTAC"), ("u", "c", 0, 2, 6, "4M", "GTAC"), ("v", "c", 0, 0, 6, "3M2D1M", "ACGC"),
        ("w", "c", 0, 0, 6, "1S6M", "TACGTAC"), ("x", "c", 0, 0, 6, "6M", "AAGTAC"), ("y", "c", 0, 0, 6, "6M", None), ("z", "c", 0, 0, 6, "2M2I4M", "ACTTGTAC"),
    ]
    got = phased(spark, reads, ((1, "CT"), (4, "AG")))
    assert got == {f"r{i}": ("CA", 1, None) if i % 2 else ("TG", 0, None) for i in range(6)} | {
        "s": (None, None, "unmapped"), "t": (None, None, "strand is -"), "u": (None, None, "aln too short"), "v": ("C?", None, "no base at 4"),
        "w": ("CA", 1, None), "x": ("AA", None, "not called"), "y": (None, None, "no base at 1"), "z": ("CA", 1, None),
    }
    partial = phased(spark, reads, ((1, "CT"), (4, "AG")), partial=True, strand=None)
    assert partial["v"] == ("C?", 3, None) and partial["u"] == ("?A", 2, None) and partial["t"] == ("CA", 1, None) and partial["y"] == (None, None, "no variant base")


def test_imputed_reads_see_the_haplotypes_before_them(spark):
    sites = tuple((i, "AC") for i in range(5))
    reads = [("a", "c", 0, 0, 5, "5M", "AAAAT"), ("b", "c", 0, 0, 5, "5M", "AAAAC"), ("c", "c", 0, 0, 5, "5M", "AAAAT"), ("d", "c", 0, 0, 5, "5M", "AAAAA"), ("e", "c", 0, 0, 5, "5M", "AAAAT")]
    got = phased(spark, reads, sites)
    assert [got[x][1:] for x in "abcde"] == [(None, "not called"), (0, None), (0, None), (1, None), (None, "not called")]
    assert got["c"][0] == "AAAAC"


def test_reads_in_their_own_direction(spark):
    reads = [("a", "c", 16, 0, 4, "4M", "TTGC")]  # GCAA along the reference
    assert phased(spark, reads, ((0, "GT"), (2, "AC")), strand="-", read_direction=True)["a"] == ("GA", 0, None)
    assert phased(spark, reads, ((0, "GT"), (2, "GC")), strand="-")["a"] == ("TG", 0, None)


def test_rarefaction_meets_its_expectation(spark):
    counts_ = spark.createDataFrame([("a", 60), ("b", 30), ("c", 9), ("d", 1)], "k string, n bigint")
    drawn = {r["size"]: r for r in rarefaction.subsample(counts_, "k", step=20, iterations=200).collect()}
    exact = {r["size"]: r.expected for r in rarefaction.expected_richness(counts_, step=20).collect()}
    assert drawn[100]["mean"] == 4 and drawn[100]["sd"] == 0 and drawn[0]["max"] == 0
    for size in (20, 40, 60, 80):
        assert drawn[size]["mean"] == pytest.approx(exact[size], abs=0.15)


def test_abundance(spark):
    stat = spark.createDataFrame([("r", "Y", "p1"), ("s", "Y", "p1"), ("t", "Y", None), ("u", "N", "p2")], "id string, is_fl string, pbid string")
    assert counts.abundance(stat, 1065).first().norm_fl == pytest.approx(1.8779e-03, abs=1e-7)


def test_split_reads(spark):
    link = "CATTGACCAGGTTCAAGCTGACTTGGCACTGATCAACGTTGCAT"
    read = "A" * 200 + link + "C" * 200
    linkers = {"F5": [("R3", link)], "R3": [("F5", link)]}
    df = spark.createDataFrame([("r", read, "F5"), ("n", None, "F5"), ("x", read, "?")], "id string, seq string, flag string")
    got = [(r.split, r.start, r.end, r.flag) for r in aligner.split_reads(df, linkers).collect()]
    assert got == [(1, 0, 203, "F5"), (2, 200 + len(link) - 3, len(read), "R3")]


def test_simulators_are_seeded(spark):
    df = spark.createDataFrame([("a", "ACGT" * 100)], "id string, seq string")
    x, y = (seqtools.simulate_errors(df, 0.05, 0.05, 0.05, seed=7).first().seq for _ in range(2))
    assert x == y != "ACGT" * 100
    alleles = [r.seq for r in seqtools.simulate_alleles(df, 3).orderBy("allele").collect()]
    assert alleles[0] == "ACGT" * 100 and all(1 <= sum(a != b for a, b in zip(x, alleles[0])) <= 2 for x in alleles[1:])


def plain_labels(rows, radius=3):
    out, heads = {}, {}
    for chr_, strand, left, right in sorted(set(rows)):
        own = heads.setdefault((chr_, strand), [])
        at = next((i for i, (lo, hi) in enumerate(own) if left - lo <= radius and abs(right - hi) <= radius), None)
        if at is None:
            own.append((left, right))
            at = len(own) - 1
        out[chr_, strand, left, right] = f"{chr_}_{strand}_{at}"
    return out


def test_labels_by_first_fit(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["c", "d"]), rng.choice("+-"), rng.randrange(120), 500 + rng.randrange(12)) for _ in range(300)]
    report = spark.createDataFrame(rows + [(None, "+", 1, 2), ("c", "+", None, 2)], "chr string, strand string, left bigint, right bigint")
    got = {(r.chr, r.strand, r.left, r.right): r.label for r in junctions.labelled(report).collect()}
    assert got == plain_labels(rows)
    assert junctions.labelled(report.limit(0)).count() == 0


def test_fusions_are_assembled(spark):
    x = lambda *p: [{"start": a, "end": b} for a, b in p]
    first, other = x((100, 200), (300, 400)), x((1000, 1100), (1200, 1300))
    rows = [(r, "a", "+", 100, 400, 0, 1000, first) for r in ("r1", "r2", "r3")] + [(r, "b", "+", 1000, 1300, 600, 1000, other) for r in ("r1", "r2")]
    rows += [("r3", "d", "-", 1000, 1300, 600, 1000, other), ("r4", "a", "+", 300, 400, 0, 1000, x((300, 400))), ("r4", "b", "+", 1000, 1300, 600, 1000, other)]
    parts = spark.createDataFrame(rows, f"read_id string, chr string, strand string, s bigint, e bigint, q_start bigint, q_len bigint, exons {collapse.EXONS}")
    grouped = fusion.merge_parts(parts)
    fusions = fusion.assemble(grouped)
    by_fusion = {}
    for r in fusions.collect():
        by_fusion.setdefault(r.fusion_id, set()).add((r.read_id, r.n_parts, r.n_reads))
    # The first part of r4 is a shortened copy that ends at the same fusion point.
    assert sorted(by_fusion.values(), key=len) == [{("r3", 2, 1)}, {("r1", 2, 3), ("r2", 2, 3), ("r4", 2, 3)}]
    lengths = spark.createDataFrame([("r1", 900), ("r2", 950), ("r3", 10), ("r4", 950)], "read_id string, length bigint")
    records = {(r.part, r.chr, r.representative) for r in fusion.fusion_records(grouped, fusions, lengths).collect()}
    assert records == {(1, "a", "r4"), (2, "b", "r4"), (1, "a", "r3"), (2, "d", "r3")}


def test_gaps_within_runs_of_one_base(spark):
    rows = [("0100", "AAAC", "A-AC"), ("0100", "AGAC", "A-AC"), ("0010", "AC-T", "ACCT"), ("1000", "GAAC", "TAAC"), ("", "", "")]
    df = spark.createDataFrame(rows, "bits string, q string, t string")
    assert [r.b for r in df.select(aligner.spare_homopolymers("bits", "q", "t").alias("b")).collect()] == ["0000", "0100", "0000", "1000", ""]
