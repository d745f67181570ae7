"""Saturation curves: how many kinds are seen among so many reads."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import prepare


def counted(rows: DataFrame, by: Sequence[str], count: str = "fl_count", min_count: int = 1, length: tuple[int, int] | None = None) -> DataFrame:
    """Reads of each kind, after leaving out rows below ``min_count`` or outside the lengths (inclusive)."""
    kept = rows.filter(F.col(count) >= min_count)
    if length:
        kept = kept.filter(F.col("length").between(*length))
    return kept.groupBy(*by).agg(F.sum(count).alias("n"))


def steps(total: int, step: int, first: int = 0) -> list[int]:
    """The sizes from ``first`` on, each ``step`` more, up to the number of reads."""
    return list(range(first, total + 1, step))


#: Reads of one kind that one row stands for while the reads are spread.
BLOCK = 1 << 20


def subsample(counts: DataFrame, key: str, step: int = 10_000, iterations: int = 100, seed: int = 0, category: str | None = None, first: int = 0) -> DataFrame:
    """Draw reads without replacement and count the kinds: ``size``, [category,] ``min``, ``max``, ``mean``, ``sd``.

    ``counts`` has one row for each kind and ``n``.  In each iteration the reads are put into a
    random order by a seeded hash; a kind is seen by a size if its first read has at most
    that place.  So one order serves all sizes.  The place of a read is found by counting in
    buckets of the hash, so no task sorts all reads.  A category that an iteration lacks
    at a size gives no sample.
    """
    spark = counts.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    by = [category] if category else []
    n = F.col("n").cast("bigint")
    blocks = counts.filter("n > 0").select(key, *by, n.alias("n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / BLOCK))).alias("_block"))
    reads = blocks.select(key, *by, F.explode(F.sequence(F.col("_block") * BLOCK + 1, F.least(F.col("n"), (F.col("_block") + 1) * BLOCK))).alias("_read"))
    runs = spark.range(iterations).withColumnRenamed("id", "run")
    order = F.xxhash64(key, *by, "_read", "run", F.lit(seed))
    rows = reads.crossJoin(F.broadcast(runs)).withColumn("_h", order).withColumn("_bucket", F.shiftrightunsigned("_h", 56))
    # Places: reads in lower buckets, and those before it in its own bucket.
    sizes_of = rows.groupBy("run", "_bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("run").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes_of.select("run", "_bucket", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("run", "_bucket").orderBy("_h", key, "_read"))
    placed = rows.withColumn("_within", within).join(F.broadcast(offsets) if iterations <= 1000 else offsets, ["run", "_bucket"])
    seen = placed.groupBy("run", key, *by).agg(F.min(F.col("_within") + F.col("_before")).alias("_first"))
    sizes = spark.createDataFrame([(s,) for s in steps(total, step, first)], "size bigint")
    found = seen.join(F.broadcast(sizes), F.col("_first") <= F.col("size"), "right" if not by else "inner")
    if not by:
        every = runs.crossJoin(F.broadcast(sizes))
        found = every.join(found.filter("run is not null").groupBy("run", "size").agg(F.count("*").alias("k")), ["run", "size"], "left").fillna(0, ["k"])
    else:
        found = found.groupBy("run", "size", *by).agg(F.count("*").alias("k"))
    return found.groupBy("size", *by).agg(F.min("k").alias("min"), F.max("k").alias("max"), F.avg("k").alias("mean"), F.stddev_pop("k").alias("sd"))


def expected_richness(counts: DataFrame, step: int = 10_000, category: str | None = None) -> DataFrame:
    """The exact mean that ``subsample`` estimates: ``size``, [category,] ``expected``.

    Of N reads, n of one kind, s drawn reads miss the kind with probability C(N - n, s) / C(N, s).
    """
    prepare(counts.sparkSession)
    spark = counts.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    by = [category] if category else []

    @F.pandas_udf("double")
    def seen(n: pd.Series, s: pd.Series) -> pd.Series:
        g = math.lgamma

        def one(x: int, draw: int) -> float:
            if total - x < draw:
                return 1.0
            return 1.0 - math.exp(g(total - x + 1) - g(total - x - draw + 1) - g(total + 1) + g(total - draw + 1))

        return pd.Series([one(int(x), int(y)) for x, y in zip(n, s)])

    sizes = spark.createDataFrame([(s,) for s in steps(total, step)], "size bigint")
    # Kinds with equal counts have equal chances, so only the different counts meet the sizes.
    kinds = counts.groupBy(*by, "n").agg(F.count("*").alias("k"))
    return kinds.crossJoin(F.broadcast(sizes)).groupBy("size", *by).agg(F.sum(seen("n", "size") * F.col("k")).alias("expected"))


def subsampling_input(counts: DataFrame, lengths: DataFrame, classes: DataFrame | None = None, exons: DataFrame | None = None) -> DataFrame:
    """Input of the curves: ``pbid``, ``pbgene``, ``length``, ``refisoform``, ``refgene``, ``category``, ``fl_count``.

    Mono-exonic isoforms (``exons``: ``pbid``, ``n_exons``) are left out if exons are given.  A novel gene or
    transcript gets a name of its own; without classes these fields are null.
    """
    rows = counts.join(lengths.select("pbid", "length"), "pbid")
    if exons is not None:
        rows = rows.join(exons.filter("n_exons > 1").select("pbid"), "pbid", "left_semi")
    gene = F.concat_ws(".", F.lit("PB"), F.split("pbid", r"\.")[1])
    if classes is None:
        none = F.lit(None).cast("string")
        return rows.select("pbid", gene.alias("pbgene"), "length", none.alias("refisoform"), none.alias("refgene"), none.alias("category"), F.col("count_fl").alias("fl_count"))
    named = rows.join(classes.select(F.col("isoform").alias("pbid"), "associated_gene", "associated_transcript", "structural_category"), "pbid")
    own = lambda c: F.when(F.col(c).isNull() | (F.lower(c) == "novel"), F.concat(F.lit("novel_"), "pbid")).otherwise(F.col(c))
    return named.select(
        "pbid", gene.alias("pbgene"), "length", own("associated_transcript").alias("refisoform"), own("associated_gene").alias("refgene"), F.col("structural_category").alias("category"), F.col("count_fl").alias("fl_count")
    )
