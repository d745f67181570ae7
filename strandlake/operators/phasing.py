"""From pileups to variants, from variants and reads to haplotypes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.alignment import cigar_ops, is_unmapped, sam_flag
from strandlake.functions.sequence import hamming, reverse_complement
from strandlake.operators.grouped import map_groups
from strandlake.operators.intervals import islands, overlap_join
from strandlake.operators.ranges import prefix_sums
from strandlake.session import prepare, stage

_POSITION = ["chr", "pos"]


def clean_counts(counts: DataFrame, strand: str = "+-") -> DataFrame:
    """Counts of bases on the expected strand: upper case forward, lower case reverse, both added up for ``+-``.

    ``counts``: ``chr``, ``pos``, ``ref``, ``base``, ``n``.  Rows: the same with ``base`` in upper case.
    """
    wanted = {"+": list("ACGT"), "-": list("acgt"), "+-": list("ACGTacgt")}[strand]
    return counts.filter(F.col("base").isin(wanted)).groupBy(*_POSITION, "ref", F.upper("base").alias("base")).agg(F.sum("n").alias("n"))


def base_counts(pile: DataFrame) -> DataFrame:
    """``n`` of each base at each position, from one row for each read's base."""
    return pile.groupBy(*_POSITION, "ref", "base").agg(F.count("*").alias("n"))


def near_homopolymer(positions: DataFrame, least: int = 4, stretch: int = 1 << 16) -> DataFrame:
    """Add ``near_hp``: whether the position or a neighbour lies in a run of at least ``least`` equal reference bases.

    Positions (``chr``, ``pos``, ``ref``) are distinct.  They are looked at in stretches of fixed
    size that overlap by more than ``least``, so no task has a whole chromosome.
    """
    halo = least + 1
    parts = F.array_distinct(F.array(*(F.floor((F.col("pos") + d) / stretch) for d in (-halo, 0, halo))))
    rows = positions.withColumn("_part", F.explode(parts))
    order = Window.partitionBy("chr", "_part").orderBy("pos")
    new = F.when((F.lag("ref").over(order) == F.col("ref")) & (F.lag("pos").over(order) == F.col("pos") - 1), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    sized = runs.withColumn("_hp", F.count("*").over(Window.partitionBy("chr", "_part", "_run")) >= least)
    beside = lambda f, d: F.coalesce(F.when(f("pos").over(order) == F.col("pos") + d, f("_hp").over(order)), F.lit(False))
    near = sized.withColumn("near_hp", F.col("_hp") | beside(F.lag, -1) | beside(F.lead, 1))
    return near.filter(F.floor(F.col("pos") / stretch) == F.col("_part")).drop("_new", "_run", "_hp", "_part")


def callable_positions(clean: DataFrame, positions: DataFrame, min_cov: int = 10, hp: int = 4) -> DataFrame:
    """Positions with two bases at least, enough coverage and no homopolymer nearby: ``chr``, ``pos``, ``ref``, ``cov``, ``n_types``.

    ``positions``: all positions with their ``ref``, for the homopolymers.
    """
    sums = clean.groupBy(*_POSITION, "ref").agg(F.sum("n").alias("cov"), F.count("*").alias("n_types"))
    away = near_homopolymer(positions.select(*_POSITION, "ref").distinct(), hp).filter("NOT near_hp").select(*_POSITION)
    return sums.filter((F.col("n_types") >= 2) & (F.col("cov") >= min_cov)).join(away, _POSITION, "left_semi")


def ranked_bases(clean: DataFrame) -> DataFrame:
    """Bases of each position by count, ties by base: adds ``rank`` from 1."""
    order = Window.partitionBy(*_POSITION).orderBy(F.desc("n"), "base")
    return clean.withColumn("rank", F.row_number().over(order).cast("bigint"))


def fisher_greater(a: int, b: int, c: int, d: int, logs: np.ndarray | None = None) -> float:
    """One-sided Fisher exact test of a 2 x 2 table: the chance of ``a`` or more, all sums being fixed.

    ``logs``, if given, has the logarithms of the factorials from 0 on.
    """
    row, other, column = a + b, c + d, a + c
    g = log_factorials(row + other) if logs is None else logs
    k = np.arange(max(a, column - other), min(row, column) + 1)
    if not len(k):
        return 0.0
    choose = lambda n, k: g[n] - g[k] - g[n - k]
    return min(1.0, float(np.exp(choose(row, k) + choose(other, column - k) - choose(row + other, column)).sum()))


def log_factorials(most: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])


def call_variants(clean: DataFrame, sites: DataFrame, p_cut: float = 0.01, error: float = 0.005, fdr: float | None = None) -> DataFrame:
    """Bases that stand out from sequencing error at the callable ``sites``, the most frequent base always
    among them: ``chr``, ``pos``, ``ref``, ``base``, ``n``, ``rank``, ``pvalue`` (null for the first base).

    The expected table is rounded down.  P values are multiplied by the number of tests and must
    then lie below ``p_cut``.  With ``fdr``, those of at most ``p_cut`` are ranked, and all up to
    the largest one that lies below ``fdr`` times its share of the ranks pass.  A position where no
    other base stands out gives no row.
    """
    prepare(clean.sparkSession)
    rows = ranked_bases(clean).join(sites.select(*_POSITION, "cov", "n_types"), _POSITION)

    @F.pandas_udf("double")
    def pvalue(n: pd.Series, cov: pd.Series) -> pd.Series:
        # Each different pair of counts is tested once.
        pairs, at = np.unique(np.stack([n.to_numpy(dtype=np.int64), cov.to_numpy(dtype=np.int64)]), axis=1, return_inverse=True)
        logs = log_factorials(2 * int(pairs[1].max())) if pairs.size else None
        found = [fisher_greater(x, c - x, int(c * error), int(c * (1 - error)), logs) for x, c in pairs.T.tolist()]
        return pd.Series(np.array(found, dtype=float)[at.ravel()])

    rows = rows.withColumn("pvalue", F.when(F.col("rank") > 1, pvalue(F.col("n"), F.col("cov"))))
    if fdr is not None:
        rows = stage(rows, "tested-bases")
        tested = rows.filter((F.col("rank") > 1) & (F.col("pvalue") <= p_cut))
        placed = prefix_sums(tested.groupBy("pvalue").agg(F.count("*").alias("_k")), [], ["pvalue"], "_k", "_before")
        total = tested.count()
        last = placed.filter(F.col("pvalue") < (F.col("_before") + F.col("_k")) / F.lit(float(max(total, 1))) * fdr).agg(F.max("pvalue")).first()[0]
        rows = rows.withColumn("_ok", F.col("pvalue") <= F.lit(last).cast("double"))
    else:
        tests = sites.agg(F.sum("n_types").alias("_tests"))
        rows = rows.crossJoin(F.broadcast(tests)).withColumn("_ok", F.col("pvalue") * F.col("_tests") < p_cut).drop("_tests")
    rows = rows.withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    called = F.max("_ok").over(Window.partitionBy(*_POSITION))
    return rows.withColumn("_any", called).filter(F.col("_any") & (F.col("_ok") | (F.col("rank") == 1))).select(*_POSITION, "ref", "base", "n", "rank", "pvalue")


def numbered_sites(variants: DataFrame, by: str = "chr") -> DataFrame:
    """The variant positions of each locus, numbered from 0: by, ``pos``, ``place``.  A locus has few by nature."""
    order = Window.partitionBy(by).orderBy("pos")
    return variants.select(by, "pos").distinct().withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))


def site_bases(reads: DataFrame, sites: DataFrame, by: str = "chr") -> DataFrame:
    """Base of each read at each variant position that it aligns to: ``read_id``, by, ``place``, ``base``.

    ``reads``: ``read_id``, by, ``s`` (0-based), ``cigar`` and ``seq`` in the direction of the reference.
    Only the aligned blocks meet the positions, and only where they overlap.
    """
    ops = reads.filter("seq is not null").select("read_id", by, "s", "seq", cigar_ops("cigar").alias("_ops"))
    zero = F.struct(F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("q"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("op"))

    def step(done: Column, x: Column) -> Column:
        # The block of this operation begins where the one before ends.
        last = F.element_at(done, -1)
        r = last["r"] + F.when(last["op"].isin("M", "D", "N", "=", "X"), last["n"]).otherwise(0)
        q = last["q"] + F.when(last["op"].isin("M", "I", "S", "=", "X"), last["n"]).otherwise(0)
        return F.concat(done, F.array(F.struct(r.alias("r"), q.alias("q"), x["n"].cast("bigint").alias("n"), x["op"].alias("op"))))

    placed = ops.select("read_id", by, "s", "seq", F.explode(F.aggregate("_ops", F.array(zero), step)).alias("_b")).filter(F.col("_b.op").isin("M", "=", "X"))
    blocks = placed.select("read_id", by, "seq", (F.col("s") + F.col("_b.r")).alias("_from"), F.col("_b.q").alias("_q"), (F.col("s") + F.col("_b.r") + F.col("_b.n")).alias("_to"))
    points = sites.withColumn("_next", F.col("pos") + 1)
    met = overlap_join(blocks, points, [by], ("_from", "_to"), ("pos", "_next"))
    base = F.upper(F.substring("seq", (F.col("_q") + F.col("pos") - F.col("_from") + 1).cast("int"), F.lit(1)))
    return met.select("read_id", by, "place", base.alias("base")).filter("base <> ''")


def haplotype_strings(bases: DataFrame, sites: DataFrame, by: str = "chr") -> DataFrame:
    """The bases of each read at the variant positions of its locus, in order: ``read_id``, by, ``hap``, ``n_missing``.

    ``bases`` as ``site_bases`` gives them.  A position without a base of the read is ``?``; a read
    without any base has no row.
    """
    sizes = sites.groupBy(by).agg(F.count("*").alias("_size"))
    array = F.array_sort(F.collect_list(F.struct("place", "base")))
    rows = bases.groupBy("read_id", by).agg(array.alias("_a")).join(sizes, by)
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))
    gap = lambda n: F.repeat(F.lit("?"), n.cast("int"))
    # A place that comes twice, by two alignments of one read, counts once.
    text = F.aggregate(
        "_a", start, lambda acc, x: F.when(x["place"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["text"], gap(x["place"] - acc["at"]), F.coalesce(x["base"], F.lit("?"))).alias("text"), (x["place"] + 1).alias("at")))
    )
    rows = rows.withColumn("_t", text).withColumn("hap", F.concat("_t.text", gap(F.col("_size") - F.col("_t.at"))))
    return rows.select("read_id", by, "hap", (F.length("hap") - F.length(F.translate("hap", "?", ""))).cast("bigint").alias("n_missing"))


def impute(hap: str, known: Sequence[str], least: int = 3) -> int | None:
    """Number of the known haplotype that agrees with ``hap`` at most places, if at ``least`` that many and more than any other."""
    scores = sorted(((sum(x == y for x, y in zip(hap, other)), -i) for i, other in enumerate(known)), reverse=True)
    if not scores or scores[0][0] < least or len(scores) > 1 and scores[1][0] == scores[0][0]:
        return None
    return -scores[0][1]


def phase(haps: DataFrame, variants: DataFrame, by: str = "chr") -> DataFrame:
    """Number the haplotypes of a locus in the order of read ids and assign reads: ``read_id``, by, ``hap``, ``hap_idx`` (from 0).

    A read with a base that was not called (``variants``: by, ``pos``, ``base``) is given the known
    haplotype that it clearly resembles among those of the reads before it; where there is
    none, ``hap`` stays and ``hap_idx`` is null.  One task has the different haplotypes of a locus, not its reads.
    """
    prepare(haps.sparkSession)
    called = variants.groupBy(by, "pos").agg(F.concat_ws("", F.collect_set(F.upper("base"))).alias("_b")).groupBy(by)
    called = called.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_b"))), lambda x: x["_b"]).alias("_v"))
    kinds = haps.groupBy(by, "hap").agg(F.min("read_id").alias("_first"))
    letters = F.filter(F.split("hap", ""), lambda x: x != "")
    odd = F.exists(F.zip_with(letters, "_v", lambda b, ok: F.coalesce((b != "?") & ~F.contains(ok, b), F.lit(True))), lambda x: x)
    kinds = kinds.join(called, by).select(by, "_first", "hap", odd.alias("_odd"))

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda x: (x[0], x[1]))
        known: list[str] = []
        out = []
        open_haps: dict[str, int | None] = {}
        for first, hap, is_odd in rows:
            if is_odd:
                open_haps[hap] = impute(hap, known)
                out.append((*key, hap, first, None if open_haps[hap] is None else known[open_haps[hap]], open_haps[hap]))
            else:
                known.append(hap)
                out.append((*key, hap, first, hap, len(known) - 1))
                # From here on a read with an odd base may resemble another haplotype.
                for other, before in list(open_haps.items()):
                    now = impute(other, known)
                    if now != before:
                        open_haps[other] = now
                        out.append((*key, other, first, None if now is None else known[now], now))
        return out

    kind, read = (haps.schema[c].dataType.simpleString() for c in (by, "read_id"))
    found = map_groups(kinds, [by], run, f"`{by}` {kind}, hap string, _from {read}, _as string, hap_idx bigint")
    latest = F.max_by(F.struct("_as", "hap_idx"), "_from").alias("_x")
    met = haps.select("read_id", by, "hap").join(found, [by, "hap"]).filter(F.col("_from") <= F.col("read_id")).groupBy("read_id", by, "hap").agg(latest)
    return met.select("read_id", by, F.coalesce("_x._as", "hap").alias("hap"), F.col("_x.hap_idx").alias("hap_idx"))


def phase_reads(reads: DataFrame, variants: DataFrame, by: str = "chr", strand: str | None = "+", partial: bool = False, secondary: bool = True, read_direction: bool = False) -> DataFrame:
    """Haplotypes of aligned reads, and why a read has none: ``read_id``, by, ``hap``, ``hap_idx``, ``reason``.

    ``reads``: ``read_id``, by (the locus, such as the chromosome), ``flag``, ``s``, ``e`` (0-based,
    half-open), ``cigar``, ``seq``; ``variants``: by, ``pos``, ``base``.  The first reason that holds
    counts: ``unmapped``; ``strand is +`` or ``-``, if ``strand`` expects the other one; ``aln too short``
    if the read doesn't span all positions; ``no base at <pos>`` for a position that it has no base at;
    ``no variant base``; ``not called`` for a base that was not called and could not be imputed.  With
    ``partial`` a read need not cover all positions.  Metagenomes take ``strand=None`` and
    ``secondary=False``, which leaves secondary alignments out.  ``seq`` has the direction of the
    reference, as in SAM, or with ``read_direction`` that of the read.  Reads of a locus without
    variants have no row; a null ``seq`` has no base.
    """
    sites = stage(numbered_sites(variants, by), "sites")
    ends = sites.groupBy(by).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    turned = sam_flag("flag")["strand"]
    rows = reads if secondary else reads.filter(F.col("flag").bitwiseAND(F.lit(256)) == 0)
    if read_direction:
        rows = rows.withColumn("seq", F.when(turned == "-", reverse_complement("seq")).otherwise(F.col("seq")))
    reason = F.when(is_unmapped("flag"), "unmapped")
    if strand is not None:
        reason = reason.when(turned != strand, F.concat(F.lit("strand is "), turned))
    if not partial:
        reason = reason.when((F.col("s") > F.col("_lo")) | (F.col("e") < F.col("_hi")), "aln too short")
    rows = rows.select("read_id", by, "flag", "s", "e", "cigar", "seq").join(ends, by).withColumn("reason", reason)
    kept = rows.filter("reason is null")
    haps = stage(haplotype_strings(site_bases(kept, sites, by), sites, by), "haplotypes")
    whole = haps if partial else haps.filter("n_missing = 0")
    phased = phase(whole, variants, by)
    out = kept.select("read_id", by).distinct().join(haps, ["read_id", by], "left").join(phased.select("read_id", by, F.col("hap").alias("_hap"), "hap_idx", F.lit(True).alias("_met")), ["read_id", by], "left")
    if not partial:
        # The first position without a base.
        gaps = out.filter("_met is null").select("read_id", by, F.greatest(F.coalesce(F.instr("hap", "?"), F.lit(1)) - 1, F.lit(0)).cast("bigint").alias("place"))
        missing = gaps.join(sites, [by, "place"]).select("read_id", by, F.concat(F.lit("no base at "), "pos").alias("_gap"))
        out = out.join(missing, ["read_id", by], "left")
    else:
        out = out.withColumn("_gap", F.lit(None).cast("string"))
    why = F.when(F.col("hap_idx").isNotNull(), None).when(F.col("_met"), "not called").when(F.col("hap").isNull() & F.lit(partial), "no variant base").otherwise(F.col("_gap"))
    out = out.select("read_id", by, F.coalesce("_hap", "hap").alias("hap"), "hap_idx", why.alias("reason"))
    rejected = rows.filter("reason is not null").select("read_id", by, F.lit(None).cast("string").alias("hap"), F.lit(None).cast("bigint").alias("hap_idx"), "reason")
    return out.unionByName(rejected)


def tally(assigned: DataFrame, members: DataFrame, by: str = "chr") -> DataFrame:
    """Reads by isoform and haplotype: by, ``pbid``, ``hap_idx``, ``n``."""
    return assigned.join(members.select("pbid", F.col("member").alias("read_id")), "read_id").groupBy(by, "pbid", "hap_idx").agg(F.count("*").alias("n"))


def alleles(haps: DataFrame, variants: DataFrame, by: str = "chr") -> DataFrame:
    """Alleles at each variant position of each locus: by, ``pos``, ``place``, ``ref``, ``base``, ``allele``, ``n``.

    ``haps``: by, ``hap_idx``, ``hap``; ``variants``: by, ``pos``, ``ref``, ``base``, ``n`` (reads).  The reference
    base is 0; others count from 1 in the order of the haplotypes that have them; called
    bases that no haplotype has follow, most frequent first.
    """
    sites = numbered_sites(variants, by).join(variants.groupBy(by, "pos").agg(F.min(F.upper("ref")).alias("ref")), [by, "pos"])
    letters = haps.select(by, "hap_idx", F.posexplode(F.filter(F.split("hap", ""), lambda x: x != "")).alias("place", "base"))
    used = letters.filter("base <> '?'").groupBy(by, F.col("place").cast("bigint").alias("place"), "base").agg(F.min("hap_idx").alias("_first")).join(sites, [by, "place"])
    called = variants.groupBy(by, "pos", F.upper("base").alias("base")).agg(F.sum("n").alias("n")).join(sites, [by, "pos"])
    key = [by, "pos", "place", "ref", "base"]
    rows = used.select(*key, "_first", F.lit(0).cast("bigint").alias("n")).unionByName(called.select(*key, F.lit(None).cast("bigint").alias("_first"), "n"))
    rows = rows.unionByName(sites.select(by, "pos", "place", "ref", F.col("ref").alias("base"), F.lit(None).cast("bigint").alias("_first"), F.lit(0).cast("bigint").alias("n")))
    rows = rows.groupBy(*key).agg(F.min("_first").alias("_first"), F.sum("n").alias("n"))
    order = Window.partitionBy(by, "pos").orderBy(F.when(F.col("base") == F.col("ref"), 0).otherwise(1), F.asc_nulls_last("_first"), F.desc("n"), "base")
    return rows.select(*key, (F.row_number().over(order) - 1).cast("bigint").alias("allele"), "n")


def haplotype_alleles(haps: DataFrame, found: DataFrame, by: str = "chr") -> DataFrame:
    """Allele of each haplotype at each variant position: by, ``hap_idx``, ``hap``, ``pos``, ``place``, ``base``, ``allele`` (null for ``?``)."""
    letters = haps.select(by, "hap_idx", "hap", F.posexplode(F.filter(F.split("hap", ""), lambda x: x != "")).alias("place", "base")).withColumn("place", F.col("place").cast("bigint"))
    sites = found.select(by, "pos", "place").distinct()
    return letters.join(sites, [by, "place"]).join(found.select(by, "place", "base", "allele"), [by, "place", "base"], "left").select(by, "hap_idx", "hap", "pos", "place", "base", "allele")


def haplotype_tables(haps: DataFrame, found: DataFrame, assigned: DataFrame, by: str = "chr") -> dict[str, DataFrame]:
    """Tables to read by eye: ``by_pos`` (a row for each base of a haplotype, with its kind REF or ALTn and its
    reads), ``by_hap`` (reads of each haplotype) and ``by_read``."""
    reads = assigned.filter("hap_idx is not null").groupBy(by, "hap_idx").agg(F.count("*").alias("n_reads"))
    rows = haplotype_alleles(haps, found, by).filter("allele is not null").join(found.select(by, "place", "allele", "n"), [by, "place", "allele"])
    kind = F.when(F.col("allele") == 0, "REF").otherwise(F.concat(F.lit("ALT"), F.col("allele") - 1))
    by_pos = rows.select("hap", "hap_idx", by, (F.col("pos") + 1).alias("pos1"), (F.col("place") + 1).alias("var_idx"), kind.alias("base_kind"), "base", "n")
    return {
        "by_pos": by_pos,
        "by_hap": haps.select("hap", "hap_idx", by).join(reads, [by, "hap_idx"], "left").fillna(0, ["n_reads"]).select("hap", "hap_idx", by, "n_reads"),
        "by_read": assigned.filter("hap_idx is not null").select("read_id", "hap", "hap_idx"),
    }


def complement_haplotype(hap: str, alleles: Sequence[Sequence[str]]) -> str:
    """The other allele at each place: the second one where ``hap`` has the first, else the first; where there is one only, that."""
    return "".join(two[1] if len(two) > 1 and b == two[0] else two[0] for b, two in zip(hap, alleles))


def differences(a: str, b: str) -> int:
    """Places at which two haplotypes differ; ``?`` differs from any base."""
    return sum(x != y for x, y in zip(a, b))


def diploid_pair(haps: Sequence[str], alleles: Sequence[Sequence[str]]) -> tuple[str, str, int] | None:
    """The first complete haplotype that lies, with its complement, nearest to all: the pair and the summed distance."""
    best = None
    for hap in haps:
        if "?" not in hap:
            other = complement_haplotype(hap, alleles)
            total = sum(min(differences(h, hap), differences(h, other)) for h in haps)
            if best is None or total < best[2]:
                best = (hap, other, total)
    return best


def diploid_pairs(haps: DataFrame, variants: DataFrame, by: str = "chr") -> DataFrame:
    """The two haplotypes of each diploid locus: by, ``hap1``, ``hap2``, ``distance`` to all its different haplotypes.

    ``haps``: by, ``hap_idx``, ``hap``; ``variants``: by, ``pos``, ``base``, ``rank``, the first two of which count.
    Ties go to the lower ``hap_idx``; a locus without a complete haplotype has no row.
    """
    prepare(haps.sparkSession)
    per_site = variants.groupBy(by, "pos").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.upper("base").alias("b")))), lambda x: x["b"]), 1, 2), "").alias("_two"))
    two = per_site.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_two"))), lambda x: x["_two"]).alias("_v"))
    lists = haps.groupBy(by, "hap").agg(F.min("hap_idx").alias("_i")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "hap"))), lambda x: x["hap"]).alias("_h"))

    @F.pandas_udf("hap1 string, hap2 string, distance bigint")
    def pair(h: pd.Series, v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([diploid_pair(list(x), list(y)) or (None, None, None) for x, y in zip(h, v)], columns=["hap1", "hap2", "distance"])

    return lists.join(two, by).select(by, pair("_h", "_v").alias("_p")).select(by, "_p.*").filter("hap1 is not null")


def choose_haplotypes(counts: dict[str, int], ploidy: int, max_diff: int = 3, min_share: float | None = None) -> list[str]:
    """Add complete haplotypes by frequency until there are ``ploidy`` or the next one brings too little.

    It brings too little if fewer than ``min_share`` of the reads with a complete haplotype have it, or
    if the sum of the distances of all different haplotypes, partial ones too, to the nearest
    chosen one falls by less than ``max_diff`` (1 for haplotypes of less than twice that length).
    """
    min_share = min(0.25, 1 / (ploidy + 4)) if min_share is None else min_share
    order = sorted((h for h in counts if "?" not in h), key=lambda h: (-counts[h], h))
    if not order:
        return []
    total = sum(counts[h] for h in order)
    limit = 1 if len(order[0]) < 2 * max_diff else max_diff
    chosen = order[:1]
    nearest = [differences(h, order[0]) for h in counts]
    for hap in order[1:ploidy]:
        with_it = [min(d, differences(h, hap)) for d, h in zip(nearest, counts)]
        if counts[hap] < min_share * total or sum(nearest) - sum(with_it) < limit:
            break
        chosen.append(hap)
        nearest = with_it
    return chosen


def correct_haplotypes(haps: DataFrame, chosen: DataFrame, by: str = "chr") -> DataFrame:
    """Replace each haplotype by the nearest chosen one (ties: the first): by, ``hap``, ``corrected``, ``distance``.

    ``haps``: by, ``hap``; ``chosen``: by, ``rank``, ``hap``, a few for each locus.
    """
    pairs = haps.select(by, "hap").distinct().join(chosen.select(by, "rank", F.col("hap").alias("corrected")), by).withColumn("distance", hamming("hap", "corrected"))
    best = Window.partitionBy(by, "hap").orderBy("distance", "rank")
    return pairs.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(by, "hap", "corrected", "distance")


def clean_phasing(assigned: DataFrame, ploidy: int = 2, max_diff: int = 3, by: str = "chr") -> DataFrame:
    """Choose the haplotypes of each locus and give each read the nearest: ``read_id``, by, ``hap``, ``corrected``, ``distance``.

    One task has the different haplotypes of a locus with their reads counted.  A locus without a
    complete haplotype has no row.
    """
    prepare(assigned.sparkSession)
    counts = assigned.groupBy(by, "hap").agg(F.count("*").alias("n"))

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        return [(*key, rank, hap) for rank, hap in enumerate(choose_haplotypes(dict(rows), ploidy, max_diff))]

    kind = counts.schema[by].dataType.simpleString()
    chosen = map_groups(counts, [by], run, f"`{by}` {kind}, rank bigint, hap string")
    return assigned.select("read_id", by, "hap").join(correct_haplotypes(counts, chosen, by), [by, "hap"])


def retally(cleaned: DataFrame, members: DataFrame, by: str = "chr") -> DataFrame:
    """Reads by isoform and corrected haplotype: by, ``pbid``, ``corrected``, ``n``.  ``cleaned`` as ``clean_phasing`` gives it."""
    return cleaned.join(members.select("pbid", F.col("member").alias("read_id")), "read_id").groupBy(by, "pbid", "corrected").agg(F.count("*").alias("n"))


def adjacent_bases(haps: DataFrame, by: str = "chr") -> DataFrame:
    """How often two bases follow each other at neighbouring variant positions: by, ``place``, ``base``, ``next_base``, ``n``."""
    rows = haps.withColumn("_n", F.length("hap")).filter("_n > 1").select(by, "hap", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)).alias("place"))
    pair = lambda d: F.substring("hap", F.col("place") + d, F.lit(1))
    return rows.select(by, (F.col("place") - 1).cast("bigint").alias("place"), pair(0).alias("base"), pair(1).alias("next_base")).groupBy(by, "place", "base", "next_base").agg(F.count("*").alias("n"))


def fake_genome(exons: DataFrame, keys: Sequence[str], flank: int = 50, pad: int = 10) -> DataFrame:
    """Map of a joined genome of exon regions, widened by ``flank``: keys, ``fake_start``, ``ref_start``, ``ref_end`` of each region, in order.

    The first region of a key begins and the last one ends ``pad`` further out; nothing begins before 0.
    """
    keys = list(keys)
    wide = exons.select(*keys, F.greatest(F.col("s") - flank, F.lit(0)).alias("s"), (F.col("e") + flank).alias("e"))
    regions = islands(wide, keys).groupBy(*keys, "island").agg(F.min("s").alias("ref_start"), F.max("e").alias("ref_end"))
    regions = stage(regions, "regions")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    last = regions.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("island").alias("_last"))
    regions = regions.join(last, same, "left") if keys else regions.crossJoin(F.broadcast(last))
    first = F.when(F.col("island") == 1, F.greatest(F.col("ref_start") - pad, F.lit(0))).otherwise(F.col("ref_start"))
    final = F.when(F.col("island") == F.col("_last"), F.col("ref_end") + pad).otherwise(F.col("ref_end"))
    regions = regions.select(*keys, "island", first.alias("ref_start"), final.alias("ref_end")).withColumn("_size", F.col("ref_end") - F.col("ref_start"))
    return prefix_sums(regions, keys, ["island"], "_size", "fake_start").select(*keys, "fake_start", "ref_start", "ref_end")


def fake_sequence(regions: DataFrame, genome: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sequence of the joined genome of each key, which has the column ``chr``: keys and ``sequence``.

    ``genome``: ``chr`` and ``sequence``, or windows of it as ``sequence_windows`` gives them.
    """
    from strandlake.operators.seqtools import cut_sequences

    pieces = cut_sequences(regions.withColumns({"_s": F.col("ref_start"), "_e": F.col("ref_end")}), genome, "_s", "_e")
    array = F.array_sort(F.collect_list(F.struct("fake_start", "piece")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(array, lambda x: x["piece"]), "").alias("sequence"))


def strictly_within(transcripts: DataFrame, chr: str, start: int, end: int, strand: str) -> DataFrame:
    """Transcripts (``exons``) of several exons that lie within a region on its strand."""
    return transcripts.filter(
        (F.col("chr") == chr) & (F.col("strand") == strand) & (F.size("exons") > 1) & (F.col("exons")[0]["start"] >= start) & (F.element_at("exons", -1)["end"] <= end)
    )


def loci_to_phase(read_stat: DataFrame, reads: DataFrame, min_reads: int = 40) -> tuple[DataFrame, DataFrame]:
    """Loci with enough reads, and their reads: (``locus``, ``n_reads``, ``n_zmw``) and (``locus``, ``pbid``, ``zmw``, ``seq``).

    ``read_stat``: ``id``, ``pbid`` (PB.i.j); ``reads``: ``id``, ``seq``.  Rows of ``read_stat`` whose well
    (``movie/zmw``) has no read don't count; a locus needs ``min_reads`` rows.  A well that comes
    several times gives its read once, with the least ``pbid``.
    """
    well = lambda c: F.regexp_extract(c, r"^([^/]+/[0-9]+)", 1)
    zmw = lambda c: F.when(well(c) != "", well(c)).otherwise(F.col(c))
    known = reads.groupBy(zmw("id").alias("zmw")).agg(F.min_by("seq", "id").alias("seq"))
    rows = read_stat.filter("pbid is not null").select("pbid", zmw("id").alias("zmw"), F.regexp_extract("pbid", r"^(.*)\.[0-9]+$", 1).alias("locus"))
    rows = rows.join(known.select("zmw"), "zmw", "left_semi")
    loci = rows.groupBy("locus").agg(F.count("*").alias("n_reads"), F.countDistinct("zmw").alias("n_zmw")).filter(F.col("n_reads") >= min_reads)
    kept = rows.join(loci.select("locus"), "locus", "left_semi").groupBy("locus", "zmw").agg(F.min("pbid").alias("pbid"))
    return loci, kept.join(known, "zmw").select("locus", "pbid", "zmw", "seq")


def locus_configs(loci: DataFrame, records: DataFrame, lengths: DataFrame, flank: int = 50, pad: int = 10) -> DataFrame:
    """Configuration of each locus: ``pbid``, ``ref_chr``, ``ref_strand``, ``ref_start``, ``ref_end``.

    ``records``: ``pbid`` (PB.i.j), ``chr``, ``strand``, ``exons``; ``lengths``: ``chr``, ``length``.  The region is that of the
    fake genome, within the chromosome; a locus without records is left out.
    """
    rows = records.withColumn("locus", F.regexp_extract("pbid", r"^(.*)\.[0-9]+$", 1)).join(loci.select("locus"), "locus", "left_semi")
    rows = rows.groupBy("locus", "chr", "strand").agg(F.min(F.col("exons")[0]["start"]).alias("_s"), F.max(F.element_at("exons", -1)["end"]).alias("_e")).join(lengths, "chr")
    return rows.select(
        F.col("locus").alias("pbid"), F.col("chr").alias("ref_chr"), F.col("strand").alias("ref_strand"),
        F.greatest(F.col("_s") - flank - pad, F.lit(0)).alias("ref_start"), F.least(F.col("_e") + flank + pad, "length").alias("ref_end"),
    )


def lift(positions: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positions of the joined genome (keys, ``pos``) on the real one: adds ``ref_pos``; others are left out."""
    spans = regions.withColumn("_f1", F.col("fake_start") + F.col("ref_end") - F.col("ref_start"))
    at = positions.withColumn("_p1", F.col("pos") + 1)
    met = overlap_join(at, spans, keys, ("pos", "_p1"), ("fake_start", "_f1"))
    return met.withColumn("ref_pos", F.col("ref_start") + F.col("pos") - F.col("fake_start")).drop("_p1", "_f1", "fake_start", "ref_start", "ref_end")


def compare_variants(ours: DataFrame, truth: DataFrame, coverage: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """Full outer comparison of positions: ``chr``, ``pos``, ``status`` (both, only_ours, only_truth), ``cov`` and ``in_repeat``."""
    a, b = (x.select(*_POSITION).distinct().withColumn(n, F.lit(1)) for x, n in ((ours, "_a"), (truth, "_b")))
    rows = a.join(b, _POSITION, "full_outer")
    status = F.when(F.col("_a").isNull(), "only_truth").when(F.col("_b").isNull(), "only_ours").otherwise("both")
    rows = rows.select(*_POSITION, status.alias("status")).join(coverage.select(*_POSITION, "cov"), _POSITION, "left").fillna(0, ["cov"])
    if repeats is None:
        return rows.withColumn("in_repeat", F.lit("NA"))
    hit = overlap_join(rows.withColumn("_p1", F.col("pos") + 1), repeats.select("chr", "s", "e"), ["chr"], ("pos", "_p1"), ("s", "e")).select(*_POSITION).distinct()
    return rows.join(hit.withColumn("in_repeat", F.lit("Y")), _POSITION, "left").fillna("N", ["in_repeat"])


def merge_genotypes(records: DataFrame) -> DataFrame:
    """Add up the reads of each allele over samples: ``chr``, ``pos``, ``allele``, ``hq``.

    ``records``: ``chr``, ``pos``, ``gt`` (alleles joined by ``|``) and ``hq`` (reads joined by commas).
    """
    pairs = F.arrays_zip(F.split("gt", r"\|").alias("allele"), F.split("hq", ",").alias("hq"))
    rows = records.select("chr", "pos", F.explode(pairs).alias("x"))
    return rows.groupBy("chr", "pos", F.col("x.allele").alias("allele")).agg(F.sum(F.col("x.hq").cast("bigint")).alias("hq"))


def locus_summary(loci: DataFrame, variants: DataFrame, haps: DataFrame, by: str = "chr") -> DataFrame:
    """Reads, variant positions, complete and partial haplotypes of each locus: by, ``size``, ``num_snp``, ``num_hap``, ``num_hap_partial``."""
    snp = variants.groupBy(by).agg(F.countDistinct("pos").alias("num_snp"))
    partial = F.col("hap").contains("?")
    kinds = haps.groupBy(by).agg(F.countDistinct(F.when(~partial, F.col("hap"))).alias("num_hap"), F.countDistinct(F.when(partial, F.col("hap"))).alias("num_hap_partial"))
    return loci.join(snp, by, "left").join(kinds, by, "left").fillna(0, ["num_snp", "num_hap", "num_hap_partial"])


def phase_switches(genotypes: DataFrame, by: Sequence[str] = ("chr", "sample")) -> DataFrame:
    """How often the genotype of a sample changes along the positions of a locus: by, ``n_switch``.

    Heterozygous phased genotypes are compared with the one before them; the first genotype of
    a sample counts as that one whatever it is.  A sample has few positions in a locus by nature.
    """
    parts = F.split("gt", r"\|")
    order = Window.partitionBy(*by).orderBy("pos")
    het = F.coalesce(F.col("gt").contains("|") & (F.try_element_at(parts, F.lit(1)) != F.try_element_at(parts, F.lit(2))), F.lit(False))
    rows = genotypes.withColumns({"_first": F.row_number().over(order) == 1, "_het": het}).filter("_first OR _het")
    changed = F.col("_het") & ~F.lag("gt").over(order).eqNullSafe(F.col("gt")) & ~F.col("_first")
    return rows.withColumn("_c", changed.cast("int")).groupBy(*by).agg(F.sum("_c").alias("n_switch"))


def tag_reads(reads: DataFrame, assigned: DataFrame, cells: DataFrame | None = None, missing: str = "NA") -> DataFrame:
    """Add the tags ``rg`` (haplotype) and, given cells, ``xc`` (cell type) to reads; ``missing`` where there is none."""
    rows = reads.join(assigned.select("read_id", F.col("hap_idx").cast("string").alias("rg")), "read_id", "left").fillna(missing, ["rg"])
    return rows if cells is None else rows.join(cells.select("read_id", F.col("celltype").alias("xc")), "read_id", "left").fillna(missing, ["xc"])


def snp_table(called: DataFrame) -> DataFrame:
    """Unphased variants: ``chr``, ``pos1`` (from 1), ``bases`` and ``counts`` joined by slashes, by rank."""
    array = F.array_sort(F.collect_list(F.struct("rank", "base", "n")))
    rows = called.groupBy(*_POSITION).agg(array.alias("_a"))
    text = lambda f: F.array_join(F.transform("_a", lambda x: x[f].cast("string")), "/")
    return rows.select("chr", (F.col("pos") + 1).alias("pos1"), text("base").alias("bases"), text("n").alias("counts"))
