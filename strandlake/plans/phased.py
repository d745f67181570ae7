"""Queries over phasing from aligned reads to variant lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import phasing
from strandlake.plans.registry import Tables, query
from strandlake.session import stage
from strandlake.sources import sinks

SITES = (102, 104, 106, 108, 110)
#: The CIGAR of a read by the remainder of its id, and the bases of the reference that it spans.
SHAPES = (("12M", 12), ("2S10M", 10), ("5M2D7M", 14), ("5M1I6M", 11))


def _number() -> str:
    """The number whose digits to the base of 4 are the bases of a read: some templates a locus, now and then with an odd base."""
    return "(o_custkey % 40 * 101 + o_custkey % 5 * 7) * 104729 % 16777216 + CASE WHEN o_orderkey % 13 = 0 THEN 262144 ELSE 0 END"


def _reads(t: Tables) -> DataFrame:
    """Reads in the columns of SAM; loci are numbers."""
    k, cigars, spans = F.col("o_orderkey"), F.array(*(F.lit(c) for c, _ in SHAPES)), F.array(*(F.lit(n) for _, n in SHAPES))
    at = (k % 4 + 1).cast("int")
    flag = F.when(k % 11 == 0, 4).when(k % 7 == 0, 16).when(k % 5 == 0, 256).otherwise(0).cast("bigint")
    bases = F.expr(f"array_join(transform(sequence(0, 11), i -> substr('ACGT', cast(({_number()}) div cast(pow(4, i) as bigint) % 4 as int) + 1, 1)), '')")
    s = 100 + k % 3
    return t.orders.select(k.alias("read_id"), (F.col("o_custkey") % 40).alias("chr"), flag.alias("flag"), s.alias("s"), (s + F.element_at(spans, at)).alias("e"), F.element_at(cigars, at).alias("cigar"), bases.alias("seq"))


def _variants(t: Tables) -> DataFrame:
    """At each site of each locus all bases but one are called, the reference being the first of them."""
    sites = t.spark.createDataFrame([(j, p, b) for j, p in enumerate(SITES) for b in range(4)], "j bigint, pos bigint, b bigint")
    rows = t.orders.select((F.col("o_custkey") % 40).alias("chr")).distinct().crossJoin(F.broadcast(sites)).filter("b <> (chr + j) % 4")
    base = lambda c: F.substring(F.lit("ACGT"), (c + 1).cast("int"), F.lit(1))
    first = F.when((F.col("chr") + F.col("j")) % 4 == 0, 1).otherwise(0)
    rank = F.when(F.col("b") > (F.col("chr") + F.col("j")) % 4, F.col("b")).otherwise(F.col("b") + 1)
    return rows.select("chr", "pos", base(first).alias("ref"), base(F.col("b")).alias("base"), (F.lit(50) - F.col("b") * 10).alias("n"), rank.alias("rank"))


_SITE = "VALUES " + ", ".join(f"({j}, {p})" for j, p in enumerate(SITES))


def _phased_sql(partial: bool, strand: bool, secondary: bool) -> str:
    """The CTEs of phasing: ``h`` (the reads' strings), ``c`` (called ones by their first read) and ``x`` (reads with the one they get)."""
    span = "" if partial else "WHEN s > 102 OR e < 110 THEN 'aln too short'"
    turned = "WHEN flag & 16 > 0 THEN 'strand is -'" if strand else ""
    whole = "" if partial else "AND hap NOT LIKE '%?%'"
    return f"""r0 AS (SELECT o_orderkey AS read_id, o_custkey % 40 AS chr, CASE WHEN o_orderkey % 11 = 0 THEN 4 WHEN o_orderkey % 7 = 0 THEN 16 WHEN o_orderkey % 5 = 0 THEN 256 ELSE 0 END AS flag,
    100 + o_orderkey % 3 AS s, o_orderkey % 4 AS shape, {_number()} AS k FROM orders),
  r1 AS (SELECT *, s + list_extract([12, 10, 14, 11], CAST(shape + 1 AS INT)) AS e FROM r0 {"" if secondary else "WHERE flag <> 256"}),
  r AS (SELECT *, CASE WHEN flag = 4 THEN 'unmapped' {turned} {span} END AS early FROM r1),
  sites(j, pos) AS ({_SITE}),
  q AS (SELECT *, CASE shape WHEN 0 THEN pos - s WHEN 1 THEN pos - s + 2 WHEN 2 THEN CASE WHEN pos - s < 5 THEN pos - s WHEN pos - s >= 7 THEN pos - s - 2 END ELSE CASE WHEN pos - s < 5 THEN pos - s ELSE pos - s + 1 END END AS q
    FROM r CROSS JOIN sites WHERE early IS NULL),
  b AS (SELECT *, CASE WHEN pos >= s AND pos < e AND q IS NOT NULL THEN substr('ACGT', CAST(k // CAST(pow(4, q) AS BIGINT) % 4 AS INT) + 1, 1) ELSE '?' END AS base FROM q),
  h AS (SELECT read_id, chr, string_agg(base, '' ORDER BY pos) AS hap, min(CASE WHEN base = '?' THEN pos END) AS gap,
    max(CASE WHEN base = substr('ACGT', CAST((chr + j) % 4 + 1 AS INT), 1) THEN 1 ELSE 0 END) AS odd FROM b GROUP BY read_id, chr),
  u AS (SELECT * FROM h WHERE hap <> '?????' {whole}),
  c AS (SELECT chr, hap, min(read_id) AS first, row_number() OVER (PARTITION BY chr ORDER BY min(read_id)) - 1 AS hap_idx FROM u WHERE odd = 0 GROUP BY chr, hap),
  m AS (SELECT u.read_id, u.chr, c.hap, c.hap_idx, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN u.hap[i] = c.hap[i] THEN 1 ELSE 0 END)) AS score FROM u JOIN c ON u.chr = c.chr AND c.first < u.read_id WHERE u.odd = 1),
  best AS (SELECT read_id, max(score) AS score FROM m GROUP BY 1),
  i AS (SELECT m.read_id, min(m.hap) AS hap, min(m.hap_idx) AS hap_idx FROM m JOIN best USING (read_id, score) WHERE score >= 3 GROUP BY m.read_id HAVING count(*) = 1),
  x AS (SELECT r.read_id, r.chr, CASE WHEN r.early IS NULL AND h.hap <> '?????' THEN coalesce(c.hap, i.hap, h.hap) END AS hap, coalesce(c.hap_idx, i.hap_idx) AS hap_idx,
    CASE WHEN early IS NOT NULL THEN early WHEN coalesce(c.hap_idx, i.hap_idx) IS NOT NULL THEN NULL WHEN u.read_id IS NOT NULL THEN 'not called' {"WHEN true THEN 'no variant base'" if partial else ""} ELSE 'no base at ' || h.gap END AS reason
    FROM r LEFT JOIN h USING (read_id) LEFT JOIN u USING (read_id) LEFT JOIN c ON u.odd = 0 AND c.chr = u.chr AND c.hap = u.hap LEFT JOIN i ON i.read_id = r.read_id)"""


@query(f"WITH {_phased_sql(False, True, True)} SELECT read_id, chr, hap, hap_idx, reason FROM x")
def e20_read_phases(t: Tables) -> DataFrame:
    """From SAM rows through CIGAR: bases at the sites, haplotypes by first read, imputation, and reasons."""
    return phasing.phase_reads(_reads(t), _variants(t))


@query(f"WITH {_phased_sql(True, False, False)} SELECT read_id, chr, hap, hap_idx, reason FROM x")
def e21_metagenome_phases(t: Tables) -> DataFrame:
    """Any strand, partial reads, no secondary alignments."""
    return phasing.phase_reads(_reads(t), _variants(t), strand=None, partial=True, secondary=False)


def _assigned(t: Tables) -> DataFrame:
    """Phased reads, partial ones too; staged, as several steps read them."""
    return stage(phasing.phase_reads(_reads(t), _variants(t), partial=True).filter("hap_idx is not null"), "assigned")


def _haps(assigned: DataFrame) -> DataFrame:
    return assigned.select("chr", "hap_idx", "hap").distinct()


_HAPS = f"{_phased_sql(True, True, True)}, a AS (SELECT * FROM x WHERE hap_idx IS NOT NULL), d AS (SELECT DISTINCT chr, hap_idx, hap FROM a)"

_VARIANTS = f"""v AS (SELECT chr, j, pos, substr('ACGT', CAST(CASE WHEN (chr + j) % 4 = 0 THEN 2 ELSE 1 END AS INT), 1) AS ref, substr('ACGT', CAST(b + 1 AS INT), 1) AS base, 50 - b * 10 AS n, row_number() OVER (PARTITION BY chr, j ORDER BY b) AS rank
    FROM (SELECT DISTINCT o_custkey % 40 AS chr FROM orders) CROSS JOIN ({_SITE}) s(j, pos) CROSS JOIN (SELECT unnest(range(4)) AS b) WHERE b <> (chr + j) % 4)"""

_ALLELES = """f AS (SELECT d.chr, s.pos, s.j, substr(d.hap, CAST(s.j + 1 AS INT), 1) AS base, min(hap_idx) AS first FROM d CROSS JOIN sites s GROUP BY 1, 2, 3, 4),
  al AS (SELECT v.chr, v.pos, v.j AS place, v.ref, v.base, CAST(row_number() OVER (PARTITION BY v.chr, v.pos ORDER BY CASE WHEN v.base = v.ref THEN 0 ELSE 1 END, f.first NULLS LAST, v.n DESC, v.base) - 1 AS BIGINT) AS allele, v.n
    FROM v LEFT JOIN f ON f.chr = v.chr AND f.pos = v.pos AND f.base = v.base)"""


@query(f"WITH {_HAPS}, {_VARIANTS}, {_ALLELES} SELECT chr, pos, place, ref, base, allele, n FROM al")
def e23_alleles(t: Tables) -> DataFrame:
    return phasing.alleles(_haps(_assigned(t)), _variants(t))


@query(
    f"""WITH {_HAPS}, {_VARIANTS}, o AS (SELECT d.*, list_transform(range(1, 6), lambda i: hap[i]) AS letters FROM d),
  two AS (SELECT chr, list(b ORDER BY pos) AS two FROM (SELECT chr, pos, list(base ORDER BY rank)[1:2] AS b FROM v GROUP BY 1, 2) GROUP BY chr),
  p AS (SELECT o.chr, hap_idx, hap, array_to_string(list_transform(range(1, 6), lambda i: CASE WHEN hap[i] = two[i][1] THEN two[i][2] ELSE two[i][1] END), '') AS other FROM o JOIN two USING (chr) WHERE hap NOT LIKE '%?%'),
  s AS (SELECT p.chr, p.hap_idx, p.hap AS hap1, p.other AS hap2, CAST(sum(least(hamming(d.hap, p.hap), hamming(d.hap, p.other))) AS BIGINT) AS distance FROM p JOIN d USING (chr) GROUP BY ALL)
  SELECT chr, hap1, hap2, distance FROM s QUALIFY row_number() OVER (PARTITION BY chr ORDER BY distance, hap_idx) = 1"""
)
def e24_diploid_pairs(t: Tables) -> DataFrame:
    return phasing.diploid_pairs(_haps(_assigned(t)), _variants(t))


_CHOSEN = """n AS (SELECT chr, hap, count(*) AS n FROM a GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY n DESC, hap) AS rk, sum(n) OVER (PARTITION BY chr) AS total FROM n WHERE hap NOT LIKE '%?%'),
  g AS (SELECT k1.chr, k1.hap AS h1, k2.hap AS h2, k2.n * 6 >= k2.total AS enough, sum(hamming(n.hap, k1.hap)) - sum(least(hamming(n.hap, k1.hap), hamming(n.hap, k2.hap))) AS gain
    FROM k k1 JOIN k k2 ON k1.chr = k2.chr AND k1.rk = 1 AND k2.rk = 2 JOIN n ON n.chr = k1.chr GROUP BY ALL),
  ch AS (SELECT chr, 0 AS rk, hap FROM k WHERE rk = 1 UNION ALL SELECT chr, 1, h2 FROM g WHERE enough AND gain >= 1),
  co AS (SELECT n.chr, n.hap, ch.hap AS corrected, hamming(n.hap, ch.hap) AS distance, row_number() OVER (PARTITION BY n.chr, n.hap ORDER BY hamming(n.hap, ch.hap), ch.rk) AS o FROM n JOIN ch ON n.chr = ch.chr)"""


@query(f"WITH {_HAPS}, {_CHOSEN} SELECT a.read_id, a.chr, a.hap, corrected, distance FROM a JOIN co ON a.chr = co.chr AND a.hap = co.hap AND co.o = 1")
def e25_clean_phasing(t: Tables) -> DataFrame:
    """Two haplotypes for each locus at most, by gain and share, and the nearest for each read."""
    return phasing.clean_phasing(_assigned(t)).select("read_id", "chr", "hap", "corrected", "distance")


def _members(t: Tables) -> DataFrame:
    return t.orders.select(F.concat(F.lit("PB."), F.col("o_custkey") % 40, F.lit("."), F.col("o_custkey") % 3).alias("pbid"), F.col("o_orderkey").alias("member"))


_MEMBERS = "mb AS (SELECT 'PB.' || o_custkey % 40 || '.' || o_custkey % 3 AS pbid, o_orderkey AS member FROM orders)"


@query(f"WITH {_HAPS}, {_CHOSEN}, {_MEMBERS} SELECT a.chr, pbid, corrected, count(*) AS n FROM a JOIN co ON a.chr = co.chr AND a.hap = co.hap AND co.o = 1 JOIN mb ON mb.member = a.read_id GROUP BY ALL")
def e26_corrected_tally(t: Tables) -> DataFrame:
    return phasing.retally(phasing.clean_phasing(_assigned(t)), _members(t))


@query(
    f"""WITH {_HAPS}, {_VARIANTS}, {_ALLELES}, {_MEMBERS}, tl AS (SELECT a.chr, pbid, hap_idx, count(*) AS n FROM a JOIN mb ON mb.member = a.read_id GROUP BY ALL),
  ha AS (SELECT d.chr, d.hap_idx, s.pos, al.allele FROM d CROSS JOIN sites s LEFT JOIN al ON al.chr = d.chr AND al.pos = s.pos AND al.base = substr(d.hap, CAST(s.j + 1 AS INT), 1)),
  sm AS (SELECT chr, pos, pbid, string_agg(coalesce(CAST(allele AS STRING), '.'), '|' ORDER BY hap_idx) || ':' || string_agg(CAST(n AS STRING), ',' ORDER BY hap_idx) AS t FROM ha JOIN tl USING (chr, hap_idx) GROUP BY ALL),
  si AS (SELECT chr, pos, ref, string_agg(base, ',' ORDER BY allele) FILTER (WHERE allele > 0) AS alt, string_agg(printf('%.2f', n / total), ',' ORDER BY allele) FILTER (WHERE allele > 0) AS af, min(total) AS dp
    FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY chr, pos) AS BIGINT) AS total FROM al) GROUP BY ALL)
  SELECT chr, pos, concat_ws(chr(9), chr, pos + 1, '.', ref, alt, '.', 'PASS', 'AF=' || af || ';DP=' || dp, 'GT:HQ', t) AS value
  FROM si JOIN (SELECT chr, pos, string_agg(t, chr(9) ORDER BY pbid) AS t FROM sm GROUP BY ALL) USING (chr, pos)"""
)
def k07_vcf_lines(t: Tables) -> DataFrame:
    assigned = _assigned(t)
    haps = _haps(assigned)
    found = phasing.alleles(haps, _variants(t))
    return sinks.vcf_lines(found, phasing.haplotype_alleles(haps, found), phasing.tally(assigned, _members(t)))


@query(
    f"""WITH {_HAPS}, {_VARIANTS}, {_ALLELES} SELECT d.hap, d.hap_idx, d.chr, s.pos + 1 AS pos1, s.j + 1 AS var_idx, CASE WHEN allele = 0 THEN 'REF' ELSE 'ALT' || (allele - 1) END AS base_kind, al.base, al.n
  FROM d CROSS JOIN sites s JOIN al ON al.chr = d.chr AND al.pos = s.pos AND al.base = substr(d.hap, CAST(s.j + 1 AS INT), 1)"""
)
def k09_bases_of_haplotypes(t: Tables) -> DataFrame:
    assigned = _assigned(t)
    haps = _haps(assigned)
    return phasing.haplotype_tables(haps, phasing.alleles(haps, _variants(t)), assigned)["by_pos"]


@query(f"WITH {_HAPS} SELECT hap, hap_idx, chr, count(*) AS n_reads FROM a GROUP BY ALL")
def k09_reads_of_haplotypes(t: Tables) -> DataFrame:
    assigned = _assigned(t)
    haps = _haps(assigned)
    return phasing.haplotype_tables(haps, phasing.alleles(haps, _variants(t)), assigned)["by_hap"]
