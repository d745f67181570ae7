"""Queries do their whole job: no row, sample or draw is left out."""

from collections import Counter

import pytest

import __spark_entry__ as entry
from strandlake.operators import phasing, rarefaction
from strandlake.plans import genomics
from strandlake.plans.registry import Tables
from tests.test_queries import SF


def run(spark, name):
    return entry.queries()[name](spark, SF)


def test_sequences_have_every_exon(spark):
    exons = Tables(spark, SF).x_exon
    assert exons.filter("exon_no > 6").count() > 0
    lengths = {r.tid: r.n for r in exons.selectExpr("tid", "e - s AS n").groupBy("tid").sum("n").toDF("tid", "n").collect()}
    assert {r.tid: len(r.seq) for r in run(spark, "e35_reference_sequence").collect()} == lengths


def test_junctions_of_every_sample_get_their_nearest(spark):
    rows = Tables(spark, SF).scrub_sample_gff_junctions
    key = ["chr", "strand", "left", "right"]
    # An annotated junction lies nearest to itself.
    own = {tuple(r) for r in rows.filter("annotation = 'Y' AND left < right").select(*key).dropna().collect()}
    got = {tuple(r[c] for c in key): r for r in run(spark, "j03_nearest_junction").collect()}
    assert own and own <= got.keys()
    assert all(got[k].distance == 0 for k in own)
    every = {tuple(r) for r in rows.select(*key).dropna().collect()}
    near = {a for a in every if any(a[:2] == k[:2] and abs(a[2] - k[2]) <= 20 and abs(a[3] - k[3]) <= 20 for k in own)}
    assert got.keys() == near


def test_every_structure_is_chained(spark):
    every = {r.pbid for r in genomics._distinct(Tables(spark, SF)).collect()}
    found = run(spark, "e18_chain")
    names = [c for c in found.columns if c.startswith("S")]
    assert len(names) >= 3
    assert {r[c] for r in found.collect() for c in names} - {None} == every


def test_all_points_meet_all_lines(spark):
    exons = Tables(spark, SF).x_exon
    got = {(r.chr, r.pos): r.name for r in run(spark, "s18_point_lookup").collect()}
    starts = {(r.chr, r.s) for r in exons.select("chr", "s").collect()}
    assert starts | {(c, s + 5) for c, s in starts} == got.keys()
    assert all((got[p] != "NA") == (p in starts) for p in got)


@pytest.mark.parametrize("name", ["a10_rarefaction", "a11_rarefaction_by_category"])
def test_curves_are_of_a_hundred_draws(spark, monkeypatch, name):
    drawn, plain = [], rarefaction.subsample

    def subsample(counts, key, step=10_000, iterations=100, **rest):
        drawn.append(iterations)
        return plain(counts, key, step, iterations, **rest)

    monkeypatch.setattr(rarefaction, "subsample", subsample)
    assert run(spark, name).count() > 0
    assert drawn == [100]


def test_orphans_are_counted_by_table_and_day(spark):
    found = {tuple(r) for r in run(spark, "p2_found").select("ref_table", "ref_field", "ref_day", "reason", "ref_key").collect()}
    counted = run(spark, "p2_counts").collect()
    assert all(r.n_references >= r.n_keys for r in counted)
    assert counted and Counter(r[:4] for r in found) == Counter({tuple(r)[:4]: r.n_keys for r in counted})


def test_variants_are_called_by_significance(spark, monkeypatch):
    given, plain = [], phasing.call_variants
    monkeypatch.setattr(phasing, "call_variants", lambda clean, sites, **rest: given.append(rest) or plain(clean, sites, **rest))
    run(spark, "e19_called_variants")
    assert given == [{}]
    assert run(spark, "e19_called_by_rank").filter("rank > 1").count() > 0
    # One odd base in forty is error; ten are a variant.
    counts = [("a", 1, "A", "A", 39), ("a", 1, "A", "C", 1), ("a", 2, "A", "A", 30), ("a", 2, "A", "C", 10)]
    clean = spark.createDataFrame(counts, "chr string, pos bigint, ref string, base string, n bigint")
    sites = spark.createDataFrame([("a", 1, 40, 2), ("a", 2, 40, 2)], "chr string, pos bigint, cov bigint, n_types bigint")
    assert {(r.pos, r.base) for r in plain(clean, sites).collect()} == {(2, "A"), (2, "C")}


def test_second_inputs_are_read(spark):
    loci = run(spark, "a24_locus_summary").collect()
    assert any(r.num_hap_partial > 0 for r in loci)
    variants = run(spark, "k08_snp_vcf").collect()
    assert not any("N" in r.ref + r.alt for r in variants) and any(len(r.ref) > 2 for r in variants) and any(len(r.alt) > 2 for r in variants)
    assert run(spark, "s24_repair_map").count() > 0
